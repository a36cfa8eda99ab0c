"""Best-fit packing of documents into sequences under several capacities.

Every piece of a document needs tokens, one place, and attention work (its length squared); a sequence has so much of
each. What matters of a piece is its length, so the plan is made from the number of pieces of each length: a table as long
as a sequence has tokens, whatever the corpus. Lengths go from the longest down; the sequences that have room and the
best score (least weighted norm of what would be left, or greatest weighted dot product of need and room) take as many
as they can. Sequences that look alike are planned together, as a range of numbers. Of several rules and weights the
plan with the fewest sequences is taken. Pieces are numbered within their length by a range partitioning, and each
finds its sequence and place in the plan by that number; nothing else is shuffled, and no text or id is.

Ids come from the distinct units of a slice of texts: white space separates the tokenizer's words, and a letter and a stop
after it never share one, so texts are cut there (a very long one in parts), each distinct unit is encoded once, and ids are
joined back by position. Plain words of small letters are merged all together in numpy, a merge of each at a time; the
tokenizer itself encodes all other units, and a table keeps these.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import cut, id_field, ids_and_texts, map_texts, table, utf8
from tracewright.llm.keyed import before, in_order, run_places

MODEL, END, TOKENS = "word_bpe_49k.json", 1, 4096
#: Distinct units, and their bytes, of each of the two generations that a worker keeps, from slice to slice and task to task;
#: bytes of a slice, and of a part of a long text.
TABLE_UNITS, TABLE_BYTES, SLICE_BYTES = 300_000, 5_000_000, 4 << 20
#: Weights of tokens, places and attention work that plans are tried with.
WEIGHTS = ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.25, 0.25))
_SPACE, _LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[97:123] = True
_STOP[[ord(c) for c in ".,:;!?"]] = True
_AFTER_C3 = np.zeros(256, bool)  # second bytes of the small letters of Latin-1
_AFTER_C3[[0x9F, *range(0xA0, 0xB7), *range(0xB8, 0xC0)]] = True
#: Bytes of the longest plain word; the rank of a pair that doesn't merge.
PLAIN_BYTES, NEVER = 48, 2**31 - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of texts one after another, and the n + 1 bounds of the texts among them.

    A unit has no white space, and ASCII letters in lower case (but in words with `<`, which may be special tokens);
    it begins behind white space, or with a stop right behind an ASCII letter.
    """
    lower, space = _LOWER[data], _SPACE[data]
    opens = ~space
    opens[1:] &= space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    opens[first] = ~space[first]
    marks = np.flatnonzero(data == ord("<"))
    if len(marks):
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        for w in np.unique(np.searchsorted(starts, marks, "right") - 1):
            lower[starts[w] : ends[w]] = data[starts[w] : ends[w]]
    stop = _STOP[lower[1:]] & _LETTER[lower[:-1]]
    opens[1:] |= stop  # at the start of a text it opens one anyway
    starts = np.flatnonzero(opens)
    kept = np.cumsum(~space)
    bounds = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(lower[~space]))])
    return held, np.searchsorted(starts, offsets)


class Merges:
    """The merges of a byte-level tokenizer whose words end in `</w>`, for many words at once."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text())["model"]
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes are written as they are, the others from 256 on
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[sign[b] + "</w>"] for b in range(256)], np.int32)
        first = self.inner[:, None].repeat(256, axis=1).ravel()
        self.pairs = np.stack([self.rank(first, np.tile(second, 256)) for second in (self.inner, self.last)]).reshape(2, 256, 256)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER).astype(np.int32)

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has. Of each word the leftmost pair of the lowest rank merges, round by round."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes) - 1
        final = np.zeros(len(data), bool)
        final[ends] = True
        sign = np.where(final, self.last[data], self.inner[data])
        rank = np.full(len(data), NEVER, np.int32)
        rank[:-1] = np.where(final[:-1], NEVER, self.pairs[final[1:].astype(np.int8), data[:-1], data[1:]])
        done = []
        while len(word):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least, count = np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word)))
            live = least < NEVER
            if not live.all():
                kept = np.repeat(live, count)
                done.append((word[~kept], sign[~kept]))
                word, sign, rank, least, count = word[kept], sign[kept], rank[kept], least[live], count[live]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
            sign[hit] = self.merged[least]
            left, right = hit - 1, np.minimum(hit + 2, len(word) - 1)
            more = (right == hit + 2) & (word[right] == word[hit])
            rank[hit] = np.where(more, self.rank(sign[hit], sign[right]), NEVER)
            left, own = left[(left >= 0) & (word[left] == word[hit])], hit[(left >= 0) & (word[left] == word[hit])]
            rank[left] = self.rank(sign[left], sign[own])
            kept = np.ones(len(word), bool)
            kept[hit + 1] = False
            word, sign, rank = word[kept], sign[kept], rank[kept]
        word, sign = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        return sign[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(sizes))


class UnitTable:
    """Ids of distinct units. Plain words are merged anew for each slice; of other units a table keeps the ids, as bytes
    of 32-bit integers. When those of late are too many they become the older ones, which are forgotten when that happens
    again; units in use move on."""

    def __init__(self, path: str):
        self.model, self.merges = tokenizer(path), Merges(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def rows(self, found: list[bytes]) -> list[bytes]:
        if len(self.known) > TABLE_UNITS or self.size > TABLE_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        out = list(map(self.known.get, found))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = []
        for i in missing:
            u = found[i]
            out[i] = ids = self.older.get(u)
            if ids is None:
                new.append(i)
            else:
                self.known[u] = ids
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            for i, x in zip(part, self.model.encode_batch_fast([found[i].decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = self.known[found[i]] = array("I", x.ids).tobytes()
        self.size += sum(len(found[i]) for i in missing)
        return out

    def ids_of(self, found: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after another, and how many each has."""
        n = len(found)
        bounds = np.frombuffer(found.buffers()[1], np.int64, n + 1, found.offset * 8)
        data = np.frombuffer(found.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds, sizes = bounds - bounds[0], np.diff(bounds)
        fine = _LETTER[data]
        pair = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]  # a unit does not end within a character
        fine[:-1] |= pair
        fine[1:] |= pair
        odd = np.concatenate([[0], np.cumsum(~fine)])
        plain = (odd[bounds[1:]] == odd[bounds[:-1]]) & (sizes <= PLAIN_BYTES) & (sizes > 0)
        ids, counts = self.merges.encode(data[np.repeat(plain, sizes)], sizes[plain])
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, counts
        rows = self.rows(found.take(pa.array(rest)).to_pylist())
        each = np.zeros(n, np.int64)
        each[plain] = counts
        each[rest] = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        out, of_plain = np.zeros(int(each.sum()), np.uint32), np.repeat(plain, each)
        out[of_plain] = ids
        out[~of_plain] = np.frombuffer(b"".join(rows), "<u4")
        return out, each

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 offsets of the texts among them."""
        found, bounds = units(data, offsets)
        if not len(found):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = found.dictionary_encode()
        ids, sizes = self.ids_of(coded.dictionary)
        each = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(ids))
        ids = each.take(coded.indices).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy(zero_copy_only=False)])]).astype(np.int64)
        return ids, ends[bounds]

    def encode_parts(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long text, some megabytes at once, cut at white space."""
        out, start = [], 0
        while start < len(data):
            end = min(len(data), start + SLICE_BYTES)
            while end < len(data):  # on to the next white space
                gap = np.flatnonzero(_SPACE[data[end : end + SLICE_BYTES]])
                end += int(gap[0]) if len(gap) else min(SLICE_BYTES, len(data) - end)
                if len(gap):
                    break
            out.append(self.encode(data[start:end], np.array([0, end - start]))[0])
            start = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pieces(docs: DataFrame, tokens: int = TOKENS, end_id: int = END, model_path: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids) of each document's ids and the end id; digest: ids_crc32 in place of ids."""
    path = model_path or public_tokenizers.path(MODEL)
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), last])
    end = np.array([end_id], "<u4")

    def code(part: pa.RecordBatch) -> pa.RecordBatch:
        units_of = unit_table(path)
        data, offsets = utf8(part.column("text"))
        if len(data) > SLICE_BYTES and part.num_rows == 1:
            ids = units_of.encode_parts(data)
            offsets = np.array([0, len(ids)])
        else:
            ids, offsets = units_of.encode(data, offsets)
        rows, starts, lengths, kept = [], [], [], []
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = np.concatenate([ids[a:b], end]).astype("<u4")
            for start in range(0, len(own), tokens):
                one = own[start : start + tokens]
                rows.append(row)
                starts.append(start)
                lengths.append(len(one))
                kept.append(zlib.crc32(one.data) if digest else one.view("<i4"))
        columns = [part.column("id").take(pa.array(rows, pa.int64())), pa.array([s // tokens for s in starts], pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kept, pa.int64() if digest else pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", last.name])

    return map_texts(ids_and_texts(docs, id_col, text_col), code, schema, SLICE_BYTES)


@lru_cache(maxsize=1)
def unit_table(path: str) -> UnitTable:
    """The table of this process, which tasks share one after another."""
    return UnitTable(path)


@dataclass
class Plan:
    """Where pieces go: those of a length with numbers from `low` on, `each` to a sequence, from sequence `first` on, at `offset`."""

    n: int
    length: np.ndarray
    low: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number."""
        step = np.searchsorted(self.length * (1 << 40) + self.low, length * (1 << 40) + number, "right") - 1
        beyond, each = number - self.low[step], self.each[step]
        return self.first[step] + beyond // each, self.offset[step] + beyond % each * length


def best_fit(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, ...], rule: str) -> Plan:
    """A plan from the number of pieces of each length; capacity and weights: tokens, pieces and attention work.

    Its steps depend on how many lengths there are, not on how many pieces.
    """
    room = np.zeros((0, 3), np.int64)  # of one sequence of each range
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, scale, steps, n = np.array(capacity, np.int64), np.sqrt(np.array(weights)) / np.array(capacity, float), [], 0
    for length in sorted(counts, reverse=True):
        need, left, low = np.array([length, 1, length * length], np.int64), counts[length], 0
        open_ = (room >= 1).all(axis=1)
        room, first, many = room[open_], first[open_], many[open_]
        while left:
            fits = np.flatnonzero((room >= need).all(axis=1))
            if not len(fits):
                each = int((size // need).min())
                bins = -(-left // each)
                room, first, many = np.vstack([room, size]), np.append(first, n), np.append(many, bins)
                n += bins
                continue
            if rule == "norm":
                best = fits[np.argmin((((room[fits] - need) * scale) ** 2).sum(axis=1))]
            else:
                scaled = room[fits] * scale
                best = fits[np.argmax(scaled @ (need * scale) / np.sqrt((scaled**2).sum(axis=1)))]
            each = int((room[best] // need).min())
            whole = min(int(many[best]), left // each)
            taken, put = (whole, each) if whole else (1, left)
            steps.append((length, low, first[best], put, size[0] - room[best, 0]))
            if taken < many[best]:  # the rest of the range stays as it is
                room, first, many = np.vstack([room, room[best]]), np.append(first, first[best] + taken), np.append(many, many[best] - taken)
                many[best] = taken
            room[best] -= put * need
            low, left = low + taken * put, left - taken * put
    steps = np.array(sorted(steps), np.int64).reshape(-1, 5)
    return Plan(n, *steps.T)


def fewest(counts: dict[int, int], capacity: tuple[int, int, int]) -> Plan:
    plans = (best_fit(counts, capacity, weights, rule) for rule in ("norm", "dot") for weights in WEIGHTS)
    return min(plans, key=lambda plan: plan.n)


def packed(found: DataFrame, tokens: int = TOKENS, most_pieces: int | None = None, most_work: int | None = None) -> DataFrame:
    """pieces (with piece and length; lengths of 1 to `tokens`) and their sequence_id and offset.

    A sequence holds at most `tokens` tokens, most_pieces pieces and most_work of squared lengths, the last two at least
    1 and tokens squared; where they are not given they don't bind. Offsets of a sequence have no gaps.
    """
    capacity = (tokens, most_pieces or tokens, most_work or tokens * tokens)
    if capacity[1] < 1 or capacity[2] < tokens * tokens:
        raise ValueError("a sequence must have room for a piece of its length")
    schema, names = found.schema, found.columns
    rows = cut(found)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            if not len(length):
                continue
            start, place = run_places(length)
            place = place + held * ((start == 0) & (length == last))
            last, held = length[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(place.astype(np.int64))], [*batch.schema.names, "part", "place"])

    order = F.xxhash64(*(c for c in ("doc_id", "piece") if c in names))
    numbered = in_order(rows.withColumn("order", order), "length", "order").drop("order")
    numbered = cut(numbered.mapInArrow(number, T.StructType([*schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])))
    # one row for each length and partition that share rows: at most as many as there are lengths and partitions
    shares = [(r["length"], r["part"], r["n"]) for r in numbered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()]
    counts: dict[int, int] = {}
    for length, _, n in shares:
        counts[length] = counts.get(length, 0) + n
    ahead = before(shares, lambda held, n: (held or 0) + n)
    keys = np.array(sorted((length << 32) + part for length, part in ahead), np.int64)
    known = found.sparkSession.sparkContext.broadcast((keys, np.array([ahead[k >> 32, k & 0xFFFFFFFF] or 0 for k in keys.tolist()], np.int64), fewest(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ahead, plan = known.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            share = np.searchsorted(keys, (length << 32) + batch.column("part").to_numpy())
            sequence, offset = plan.places(length, batch.column("place").to_numpy() + ahead[share]) if len(length) else (length, length)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokens: int = TOKENS, most_pieces: int | None = None, most_work: int | None = None, end_id: int = END, model_path: str | None = None, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids (or ids_crc32), sequence_id, offset.

    A null text is as an empty one: a piece that holds the end id only. Every input row is a document of its own, with
    null and repeated ids too; documents longer than `tokens` are cut into pieces of that many, and the rest. Texts of
    any length are worked on in parts of some megabytes, ended by white space; a run without any is one part. An empty
    table gives an empty one; further columns are ignored.
    """
    return packed(pieces(docs, tokens, end_id, model_path, digest, id_col, text_col), tokens, most_pieces, most_work)


def sequences(found: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) of pack_documents: ids of all pieces by offset, and the length of each piece."""
    own = found.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("x"))
    return own.select("sequence_id", F.flatten(F.col("x.ids")).alias("ids"), F.col("x.length").alias("lengths"))


def op13_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), digest=True)
