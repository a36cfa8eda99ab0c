"""Language identification of mixed-language texts.

Words are scored by hashed letter n-grams (orders 1 to 4, with word ends) whose frequencies in each language are learned
from the labelled text. Script ranges narrow the candidates of a word first: a language is one only if it uses every
script the word has letters of. Viterbi over the word scores, with a penalty for switching, labels spans; all texts
of a slice take their steps together in numpy, long texts in stretches, and each distinct word is scored once. The
language of a text is the one whose spans hold most of its letters, the score their share.

Learning reads a sample of at most DOCS_EACH documents of a language (by hash of the id); count vectors of bounded size
come back to the driver. Labelling is one Arrow pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import by_bytes, cut, id_field, ids_and_texts, is_held_out, map_texts, remainder, ship_with, table, utf8
from tracewright.llm.words import Words

#: Most documents of each language that are learned from, in how many parts, and buckets of each n-gram order.
DOCS_EACH, PARTS, BUCKET_BITS = 3_000, 8, 14
#: Languages whose counts (512 KB each) a task holds before it passes them on.
COUNTED_AT_ONCE = 64
#: Languages whose shares are sent to every task; with more of them texts are shuffled by language.
SENT_LANGUAGES = 100_000
ORDERS = (1, 2, 3, 4)
#: Log-probability that a change of language must gain.
SWITCH = 8.0
#: Words of a stretch of a long text, and bytes for the stretches that are looked at side by side.
STRETCH, STRETCH_BYTES = 1024, 32 << 20
UNDETERMINED = "und"
# Starts of script ranges by code point, fixed values: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Indic,
# Thai and Lao, Tibetan and Burmese, Georgian, Hangul, Ethiopic, Khmer and Mongolian, Latin, Greek, other signs, kana,
# Hangul, Han, Hangul, other.
_RANGES = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00C0, "latin"), (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0F00, "tibetan"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"),
    (0x18B0, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3130, "hangul"), (0x3190, ""), (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, ""),
]
_SCRIPTS = sorted({s for _, s in _RANGES if s})
_STARTS = np.array([a for a, _ in _RANGES])
_BIT = np.array([1 << _SCRIPTS.index(s) if s else 0 for _, s in _RANGES], np.uint32)


def script_bits(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each string of a UTF-8 buffer the scripts it has letters of, as bits."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)))
    bits = np.append(_BIT[np.searchsorted(_STARTS, code, "right") - 1], np.uint32(0))
    at = np.searchsorted(lead, offsets)
    out = np.bitwise_or.reduceat(bits, np.minimum(at[:-1], len(bits) - 1)) if len(offsets) > 1 else np.zeros(0, np.uint32)
    return np.where(np.diff(at) > 0, out, 0).astype(np.uint32)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, hashed n-gram) pairs of lower-cased strings; whatever is no letter parts words."""
    letter = ((data >= 97) & (data < 123)) | (data >= 128)
    # each string between two blanks
    n = np.diff(offsets)
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(len(n)), n) + 1
    text = np.full(len(data) + 2 * len(n) + 4, 32, np.uint64)
    text[place] = np.where(letter, data, 32)
    owner = np.repeat(np.arange(len(n)), n + 2)
    size, hashed, strings = len(owner), [], []
    whole = text[:size] != 32
    code, any_letter = np.zeros(size, np.uint64), np.zeros(size, bool)
    for order in ORDERS:
        nxt = text[order - 1 : order - 1 + size]
        code = code * np.uint64(257) + nxt
        any_letter = any_letter | (nxt != 32)
        inside = np.ones(size, bool)
        if order > 1:
            inside[size - order + 1 :] = False
            inside[: size - order + 1] = owner[order - 1 :] == owner[: size - order + 1]
        kept = inside & any_letter & (whole if order == 1 else True)
        mixed = (code[kept] + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        hashed.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + ((order - 1) << BUCKET_BITS))
        strings.append(owner[kept])
    return np.concatenate(strings), np.concatenate(hashed)


@dataclass
class Languages:
    """What is learned: names, log-frequencies by n-gram and language, and the scripts of each language as bits."""

    names: list[str]
    weight: np.ndarray = field(repr=False)
    scripts: np.ndarray = field(repr=False)

    @classmethod
    def from_counts(cls, names: list[str], counts: np.ndarray, scripts: np.ndarray) -> Languages:
        """counts: n-grams by language; scripts: words with letters of each script by language."""
        per_order = counts.reshape(len(names), len(ORDERS), -1) + 0.5
        logs = np.log(per_order / per_order.sum(axis=2, keepdims=True)).reshape(len(names), -1).T
        used = scripts >= np.maximum(1, 0.002 * scripts.sum(axis=1, keepdims=True))
        return cls(names, np.ascontiguousarray(logs - logs.mean(axis=1, keepdims=True), np.float32) / np.float32(len(ORDERS) / 2), (used * (1 << np.arange(scripts.shape[1]))).sum(axis=1).astype(np.uint32))

    def word_scores(self, words: Words) -> np.ndarray:
        """Scores of the distinct words by language; zeros for those without letters.

        A language that lacks a script of the word is none, unless all do.
        """
        data, offsets = words.lowered()
        out = np.zeros((len(words.distinct), len(self.names)), np.float32)
        if len(data):
            owner, gram = ngrams(data, offsets)
            for k in range(len(self.names)):
                out[:, k] = np.bincount(owner, self.weight[gram, k], minlength=len(out))
            has = script_bits(data, offsets)
            foreign = (has[:, None] & ~self.scripts[None, :]) != 0
            out[foreign & ~foreign.all(axis=1, keepdims=True)] = -np.inf
        return out


def viterbi(scores: np.ndarray, code: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word occurrence: texts side by side, one word a step, long ones in stretches."""
    n = np.diff(bounds)
    label = np.zeros(len(code), np.int16)
    usual = np.flatnonzero((n > 0) & (n <= STRETCH))
    side_by_side(scores, code, bounds[:-1][usual], n[usual], switch, label)
    long = np.flatnonzero(n > STRETCH)
    if len(long):
        in_stretches(scores, code, bounds[:-1][long], n[long], switch, label)
    return label


def side_by_side(scores, code, begin, n, switch, label, first=None, last=None) -> np.ndarray:
    """Fills in the label of the words begin to begin + n of each text; first and last: languages that they must have.

    Returns, by text, the value of the best path that ends in each language.
    """
    ended = np.zeros((len(n), scores.shape[1]))
    if not len(n):
        return ended
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], begin[order]
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # texts that have a word at each step
    value = scores[code[begin]].astype(np.float64)
    if first is not None:
        value = np.where(np.arange(scores.shape[1]) == first[order][:, None], value, -np.inf)
    stay: list[np.ndarray] = []  # which states were reached without a switch
    best: list[np.ndarray] = []  # the state that a switch came from
    for t in range(1, n[0]):
        k = active[t]
        ended[k : len(value)] = value[k:]
        value = value[:k]
        top = value.argmax(axis=1)
        high = value[np.arange(k), top][:, None] - switch
        kept = value >= high
        stay.append(kept)
        best.append(top.astype(np.int16))
        value = np.where(kept, value, high) + scores[code[begin[:k] + t]]
    ended[: len(value)] = value
    ends = ended.argmax(axis=1) if last is None else last[order]
    state = np.zeros(len(n), np.int64)
    for t in range(n[0] - 1, -1, -1):
        k = active[t]
        low = active[t + 1] if t + 1 < n[0] else 0
        state[low:k] = ends[low:k]
        label[begin[:k] + t] = state[:k]
        if t:
            own = state[:k]
            state[:k] = np.where(stay[t - 1][np.arange(k), own], own, best[t - 1])
    back = np.empty_like(ended)
    back[order] = ended
    return back


def in_stretches(scores, code, begin, n, switch, label) -> None:
    """As side_by_side, for long texts, cut into stretches of STRETCH words, of which STRETCH_BYTES hold as many as fit.

    A stretch is first run from every language that its first word may have; what it is worth from each language to each
    tells the best ones at all ends of stretches. Then each is run again between these.
    """
    size, each = scores.shape[1], -(-n // STRETCH)
    text = np.repeat(np.arange(len(n)), each)
    place = (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * STRETCH
    begin, n = begin[text] + place, np.minimum(STRETCH, n[text] - place)
    most = max(1, STRETCH_BYTES // (STRETCH * size * (size + 2)))
    blocks = [slice(a, a + most) for a in range(0, len(begin), most)]
    worth = np.empty((len(begin), size, size))
    for own in blocks:
        every = np.tile(np.arange(size), len(n[own]))
        worth[own] = side_by_side(scores, code, np.repeat(begin[own], size), np.repeat(n[own], size), switch, label, first=every).reshape(-1, size, size)
    came, before = np.empty((len(begin), size), np.int64), np.empty((len(begin), size), np.int64)
    first, last = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
    for k in range(len(begin)):  # value: of the best path to each last language; came: the first one of the stretch
        if place[k] == 0:
            came[k], value = worth[k].argmax(axis=0), worth[k].max(axis=0)
            continue
        high = value.max() - switch
        before[k] = np.where(value >= high, np.arange(size), value.argmax())
        paths = np.maximum(value, high)[:, None] + worth[k]
        came[k], value = paths.argmax(axis=0), paths.max(axis=0)
        value = value - value.max()
        if k + 1 == len(begin) or place[k + 1] == 0:
            last[k] = value.argmax()
    for k in range(len(begin) - 1, -1, -1):
        if k + 1 < len(begin) and place[k + 1]:
            last[k] = before[k + 1][first[k + 1]]
        first[k] = came[k][last[k]]
    for own in blocks:
        side_by_side(scores, code, begin[own], n[own], switch, label, first=first[own], last=last[own])


def letters_of(words: Words) -> np.ndarray:
    """Letters of each distinct word, of any script."""
    data, offsets = utf8(words.distinct.cast(pa.large_string()))
    ascii_letter = ((data >= 65) & (data < 91)) | ((data >= 97) & (data < 123))
    n = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[offsets])
    other = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(data >= 0x80)])[offsets]))
    if len(other):
        n[other] = [sum(map(str.isalpha, w)) for w in words.distinct.cast(pa.large_string()).take(pa.array(other)).to_pylist()]
    return n


def train(docs: DataFrame, docs_each: int = DOCS_EACH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages | None:
    """Learn from documents with text and language whose id is not held out; None where there are none."""
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    own = own.where((remainder(F.col("id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = cut(own.groupBy("lang").agg(F.least(F.lit(1.0), docs_each / F.count(F.lit(1))).alias("share")))
    few = shares.count() <= SENT_LANGUAGES  # then texts stay where they are until they are chosen
    chosen = own.join(F.broadcast(shares) if few else shares, "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    size, n_scripts = len(ORDERS) << BUCKET_BITS, len(_SCRIPTS)
    schema = "lang string, place binary, n binary, scripts binary"

    def row(lang, grams, scripts):
        place = np.flatnonzero(grams)
        return {"lang": lang, "place": place.astype(np.int32).tobytes(), "n": grams[place].astype(np.float64).tobytes(), "scripts": scripts.astype(np.float64).tobytes()}

    def packed(rows):
        return pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("place", pa.binary()), ("n", pa.binary()), ("scripts", pa.binary())]))

    def count(batches):
        held = {}
        for part in (p for batch in batches for p in by_bytes(batch)):
            words = Words.of(part.column("text"))
            data, offsets = words.lowered()
            if not len(data):
                continue
            coded = part.column("lang").dictionary_encode()
            of_word = coded.indices.to_numpy()[np.searchsorted(words.bounds, np.arange(len(words.code)), "right") - 1]
            owner, gram = ngrams(data, offsets)
            has = script_bits(data, offsets)
            for k, lang in enumerate(coded.dictionary.to_pylist()):
                seen = np.bincount(words.code[of_word == k], minlength=len(words.distinct))
                grams, scripts = held.setdefault(lang, (np.zeros(size), np.zeros(n_scripts)))
                grams += np.bincount(gram, seen[owner], minlength=size)
                scripts += [(seen * (has >> s & 1)).sum() for s in range(n_scripts)]
            if len(held) > COUNTED_AT_ONCE:
                yield packed([row(lang, *own) for lang, own in held.items()])
                held = {}
        if held:
            yield packed([row(lang, *own) for lang, own in held.items()])

    def add(rows: pa.Table) -> pa.Table:
        grams, scripts = np.zeros(size), np.zeros(n_scripts)
        for place, n, own in zip(*(rows.column(c).to_pylist() for c in ("place", "n", "scripts")), strict=True):
            grams[np.frombuffer(place, np.int32)] += np.frombuffer(n)
            scripts += np.frombuffer(own)
        return pa.Table.from_batches([packed([row(rows.column("lang")[0].as_py(), grams, scripts)])])

    found = ship_with(chosen).select("text", "lang").repartition(PARTS).mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema)
    found = sorted(found.collect(), key=lambda r: r["lang"])  # a row for each language
    if not found:
        return None
    counts = np.zeros((len(found), size), np.float32 if len(found) > COUNTED_AT_ONCE else np.float64)
    for k, r in enumerate(found):
        counts[k, np.frombuffer(r["place"], np.int32)] = np.frombuffer(r["n"])
    return Languages.from_counts([r["lang"] for r in found], counts, np.stack([np.frombuffer(r["scripts"]) for r in found]))


def identify(docs: DataFrame, model: Languages | None, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score and spans, an array of (lang, start, end) in code points.

    A null text, one without letters and any text where nothing was learned give `und`, score 0 and no spans. Between
    languages with as many letters the first by name wins. Repeated rows repeat; an empty table gives an empty one;
    further columns are ignored; a null id is not held out.
    """
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow_spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    known = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = part.column("text"), known.value
        pred, score, spans = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[]] * len(texts)
        if model is not None:
            words = Words.of(part.column("text"))
            label = viterbi(model.word_scores(words), words.code, words.bounds, switch)
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            n_letters = letters_of(words)[words.code]  # of each word occurrence
            for i in range(len(texts)):
                a, b = words.bounds[i], words.bounds[i + 1]
                held = np.bincount(label[a:b], n_letters[a:b], minlength=len(model.names))
                if not held.sum():
                    continue
                best = int(held.argmax())
                pred[i], score[i] = model.names[best], float(held[best] / held.sum())
                new = np.flatnonzero(np.diff(label[a:b], prepend=-1))
                at = points[np.append(words.starts[a + new], words.offsets[i + 1])] - points[words.offsets[i]]
                spans[i] = [{"lang": model.names[label[a + k]], "start": int(s), "end": int(e)} for k, s, e in zip(new, at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, arrow_spans)], ["doc_id", "lang_pred", "score", "spans"])

    found = map_texts(ids_and_texts(docs, id_col, text_col), work, schema)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", "held_out", "lang_pred", "score")
