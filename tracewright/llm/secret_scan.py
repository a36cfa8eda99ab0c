"""Secret scans over a trigram inverted index.

Each rule is a regex over UTF-8 bytes. A Boolean trigram query is derived from its syntax tree (which trigrams any match
must contain), with ASCII case folded. Every slice of texts in an Arrow batch is an index segment: postings (trigram ->
texts) are built for the trigrams that some query names, the queries are answered by intersecting and uniting
postings, and only the candidates are verified with the regex, over their whole text. A rule without mandatory
trigrams (a bare character class) scans every text. Segments are independent, so nothing is shuffled and a lost
executor costs its own segments only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import spans as sp
from tracewright.llm.common import by_bytes, id_field, ids_and_texts, map_texts, ship_with, table, utf8

#: Strings that a finite part of a regex may stand for before its query is cut there.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the regex, and what a match must meet beyond it. `secret` is the group that is redacted."""

    kind: str
    pattern: bytes
    keep: Callable[[re.Match], bool] = lambda m: True
    secret: int = 0


BASE_RULES = (
    Rule(
        "assign",
        rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: m.end(2) - m.start(2) >= 8,
        2,
    ),
    Rule("access", rb"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 16),
    Rule("hex", rb"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that are long enough
)
MORE_RULES = (
    Rule("pem", rb"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = [r.kind for r in BASE_RULES]


def _fold(c: int) -> int:
    return c + 32 if 65 <= c <= 90 else c


def _strings(item) -> set[bytes] | None:
    """The folded strings that a parsed item stands for, where they are few."""
    op, arg = item
    if op is sre.LITERAL:
        return {bytes([_fold(arg)])} if arg < 256 else None
    if op is sre.IN:
        found = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(bytes([_fold(value)]))
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                found |= {bytes([_fold(c)]) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 4 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is sre.MAX_REPEAT and arg[1] <= 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({b""} if arg[0] == 0 else set())
    return None


def _sequence_strings(items) -> set[bytes] | None:
    found = {b""}
    for item in items:
        more = _strings(item)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def _any_of(strings: set[bytes]):
    if any(len(s) < 3 for s in strings):
        return True
    return ("or", [("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])


def trigram_query(pattern: bytes):
    """True (every text may match) or a tree of ("and" | "or", children) whose leaves are folded trigrams."""
    return _sequence_query(sre_parser.parse(pattern))


def _sequence_query(items):
    parts, held = [], {b""}
    for item in items:
        more = _strings(item)
        if more is not None and len(held) * len(more) <= MOST_STRINGS:
            held = {a + b for a in held for b in more}
            continue
        parts.append(_any_of(held))
        held = more if more is not None else {b""}
        if more is None:
            op, arg = item
            if op is sre.SUBPATTERN:
                parts.append(_sequence_query(arg[3]))
            elif op is sre.BRANCH:
                each = [_sequence_query(x) for x in arg[1]]
                parts.append(True if True in each else ("or", each))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                parts.append(_sequence_query(arg[2]))
    parts.append(_any_of(held))
    parts = [p for p in parts if p is not True]
    return ("and", parts) if parts else True


def leaves(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(leaves, query[1]))


class SegmentIndex:
    """Postings of a slice of texts for a set of trigrams: for each trigram, which texts hold it."""

    def __init__(self, grams: list[bytes]):
        self.grams = {g: i for i, g in enumerate(grams)}
        self.number = np.zeros(1 << 24, np.uint8 if len(grams) < 255 else np.uint16)
        for g, i in self.grams.items():
            for variant in range(8):  # the table takes text as it is: each letter of a trigram in either case
                c = [x - 32 if variant >> k & 1 and 97 <= x <= 122 else x for k, x in enumerate(g)]
                self.number[c[0] << 16 | c[1] << 8 | c[2]] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = np.zeros((len(self.grams), len(offsets) - 1), bool)
        if len(data) >= 3:
            code = data[:-2].astype(np.uint32) << 16
            code |= data[1:-1].astype(np.uint32) << 8
            code |= data[2:]
            number = self.number[code]
            at = np.flatnonzero(number)
            text = np.searchsorted(offsets, at, "right") - 1
            whole = at + 3 <= offsets[text + 1]
            found[number[at[whole]].astype(int) - 1, text[whole]] = True
        return found

    def answer(self, query, postings: np.ndarray) -> np.ndarray:
        """Which texts may match."""
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.grams[query]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.answer(q, postings) for q in query[1]])


class Scanner:
    """All rules over slices of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.index = SegmentIndex(sorted(set().union(*(leaves(q) for *_, q in self.rules))))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """By text with any: (start, rule number, end, secret's start, secret's end) in bytes, in order."""
        postings, found = self.index.postings(data, offsets), {}
        view, ends = memoryview(data), offsets.tolist()
        for number, rule, regex, query in self.rules:
            for text in np.flatnonzero(self.index.answer(query, postings)).tolist():
                for m in regex.finditer(view[ends[text] : ends[text + 1]]):
                    if rule.keep(m):
                        found.setdefault(text, []).append((m.start(), number, m.end(), m.start(rule.secret), m.end(rule.secret)))
        return {k: sorted(v) for k, v in found.items()}


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and spans, an array of (kind, start, end) in code points, by start, then in the rules' order.

    Matches of a rule are leftmost and do not overlap; those of different rules may. A null or empty text has no
    spans. Repeated rows repeat; an empty table gives an empty one; further columns are ignored.
    """
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("spans", sp.SPANS)])
    held: list[Scanner] = []

    def scan(part: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scanner(rules))
        data, offsets = utf8(part.column("text"))
        rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
        for text, found in held[0].matches(data, offsets).items():
            at = sp.CodePoints(data[offsets[text] : offsets[text + 1]].tobytes())
            rows[text] = [{"kind": rules[number].kind, "start": at(a), "end": at(b)} for a, number, b, _, _ in found]
        spans = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([part.column("id"), spans], ["doc_id", "spans"])

    return map_texts(ids_and_texts(docs, id_col, text_col), scan, schema)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, placeholder: str = "[SECRET]", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, with each secret in the text replaced (overlapping ones by one placeholder).

    Of an assignment the value goes and the name stays. Null and empty texts stay as they are; repeated rows repeat; an
    empty table gives an empty one. The length column, where one is named, follows the new text; all others stay.
    """
    schema, held = docs.schema, []
    position = docs.columns.index(text_col)

    def redact(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scanner(rules))
        texts = batch.column(position)
        data, offsets = utf8(texts)
        changed = {}
        for text, found in held[0].matches(data, offsets).items():
            own, out, done = data[offsets[text] : offsets[text + 1]].tobytes(), [], 0
            for a, b in sorted((a, b) for *_, a, b in found):
                if a >= done:
                    out += [own[done:a], placeholder.encode()]
                done = max(done, b)
            changed[text] = b"".join([*out, own[done:]]).decode()
        if changed:
            values = texts.to_pylist()
            for k, v in changed.items():
                values[k] = v
            texts = pa.array(values, texts.type)
        columns = [texts if i == position else batch.column(i) for i in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, column=text_col):
                yield redact(part)

    out = ship_with(docs).mapInArrow(run, schema)
    if length_col is not None:
        out = out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return out


def op2_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(sp.count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(sp.joined(spans, BASE_KINDS), 256).alias("base_sha256"),
        sp.joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )
