"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a text is predicted from the two words on either side, and the log-probabilities are summed. The softmax
has two levels: P(word | both sides) = P(cluster | both sides) * P(word | cluster, both sides) for the most frequent
words, which have embeddings of their own, in clusters of equal size that are learned from the words beside them over
all documents. The words beyond these are in bands of about equal mass by count: a band takes the place of a cluster
and of an embedding, and P(word | band) follows from the count of the word itself over all documents. The network
(word embeddings by position, one tanh layer, two softmaxes) is trained in numpy.

Passes, all over every document: word counts by 64-bit hash, a table in the shared folder that grows with the
vocabulary; coding, which turns each text into the numbers of its words, two bytes each (the most frequent words are
known to every task, the others are joined with the table, each once for a slice of texts), and deals texts out to
slices; neighbour counts for the clusters; training rounds; and scoring.

Nothing depends on how rows are partitioned. Training deals texts out to slices by a hash of id and words, about
SLICE_WORDS words each; a slice is learned in the order of that hash, in steps of a fixed number of windows, and the
parameters of all slices are averaged as whole numbers, whose sums have no order. Rounds take turns, so each word of
each text is a target once. Scoring rounds hidden values and weights to fixed steps, so that the products are exact in
any order and a text's score depends on the text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import by_bytes, cut, discard, id_field, ids_and_texts, one_blas_thread, ship_with, table
from tracewright.llm.words import Words

#: Clusters, words of each, and bands for the words beyond; codes of words, bands and the pad between texts.
CLUSTERS, MEMBERS, BANDS = 64, 128, 16
MODELLED = CLUSTERS * MEMBERS
CODES, PAD, RARE = MODELLED + BANDS, MODELLED + BANDS, 65_535  # RARE stands for a word that no task knows
SIDE, EMBED, HIDDEN = 2, 12, 24
SHIFTS = [k for k in range(-SIDE, SIDE + 1) if k]
#: Rounds (each trains on every ROUNDS-th word, together on all); words of a slice; windows of a step; Adagrad's rate.
ROUNDS, SLICE_WORDS, STEP_WINDOWS, RATE = 2, 1 << 21, 8192, 0.1
#: Tasks that slices are dealt out to at most; each learns its slices one after another.
TASKS = 20_000
#: The most frequent words whose places beside a word tell its cluster.
BESIDE = 64
#: Most words that every task knows; distinct words that a task counts before it passes them on; bytes of a slice of coded texts.
KNOWN, COUNTED, CODED = 1 << 19, 1 << 19, 1 << 20
#: Words scored at once; a logit is cut off beyond this.
AT_ONCE, MOST = 8192, 60.0
#: Lanes of the steps in which arrays are added up.
LANES = (512, 16, 1)
#: Whole numbers in 1 that hidden values, weights and averaged parameters are rounded to, and the largest weight.
HIDDEN_STEPS, WEIGHT_STEPS, MEAN_STEPS, MOST_WEIGHT = 128, 64, 1 << 20, 15.0


def word_hashes(words: Words) -> np.ndarray:
    """64 bits of each distinct word: lower-cased, without the white space after it."""
    data, offsets = words.lowered()
    if not len(data):
        return np.zeros(0, np.int64)
    place = (np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    each = (place << np.uint64(8)) + data + np.uint64(1)
    each *= np.uint64(0x9E3779B97F4A7C15)
    each = (each ^ each >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    each = (each ^ each >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    each ^= each >> np.uint64(31)
    each[(data == 32) | ((data >= 9) & (data <= 13))] = 0
    return np.add.reduceat(each, offsets[:-1]).view(np.int64)


# --- what is known of words


@dataclass
class Known:
    """What tasks know of the words: the most frequent ones, and the code and its mass for any count.

    Every task gets it: KNOWN words at most, and a step for each count that some word has (d different counts need a corpus
    of d * d / 2 words, so 10^13 words give 5 million at most).

    hashes (sorted), n and code of the known words; steps are the counts (ascending) that words have in the corpus, band
    is their code unless a word has one of its own; total is the mass of each code.
    """

    hashes: np.ndarray
    n: np.ndarray
    code: np.ndarray
    steps: np.ndarray
    band: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, n: np.ndarray, steps: np.ndarray, words: np.ndarray) -> Known:
        """words: how many there are of each count."""
        own = np.lexsort([hashes, -n])[:MODELLED]
        rest = words - np.bincount(np.searchsorted(steps, n[own]), minlength=len(steps)).astype(np.int64)
        mass = (steps + 0.5) * rest
        before = mass[::-1].cumsum()[::-1] - mass / 2  # of more frequent words and half of these
        band = MODELLED + np.minimum(before / max(mass.sum(), 1) * BANDS, BANDS - 1).astype(int)
        total = np.bincount(band, mass, minlength=CODES)
        total[: len(own)] = n[own] + 0.5
        total[CODES - 1] += 0.5  # words that are not in the corpus
        order = np.argsort(hashes)
        at = band[np.searchsorted(steps, n)] if len(n) else np.zeros(0, int)
        at[own] = np.arange(len(own))
        return cls(hashes[order], n[order], at[order].astype(np.uint16), steps, band, total)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code (RARE for unknown words), log-share of it (0 for them), and whether the corpus has the word once."""
        if not len(self.hashes):
            return np.full(len(hashes), RARE, np.uint16), np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        code = np.where(there, self.code[at], np.uint16(RARE))
        return code, np.where(there, np.log((self.n[at] + 0.5) / self.total[self.code[at]]), 0), there & (self.n[at] == 1)

    def by_count(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and log-share of words that are not known but occur n times (maybe 0) in the corpus."""
        code = np.full(len(n), CODES - 1, np.uint16)
        seen = n > 0
        code[seen] = self.band[np.searchsorted(self.steps, n[seen])]
        return code, np.log((n + 0.5) / self.total[code])


@dataclass
class CorpusVocabulary:
    """Known words, the count of every other word as a table (hash, n), and the word occurrences in all."""

    known: Known
    others: DataFrame
    occurrences: int

    @property
    def slices(self) -> int:
        return max(1, -(-self.occurrences // SLICE_WORDS))

    @classmethod
    def from_counts(cls, counts: DataFrame) -> CorpusVocabulary:
        found = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow()
        steps, words = (found.column(c).to_numpy() for c in ("n", "words"))
        order = np.argsort(steps)
        steps, words = steps[order], words[order]
        most = words[::-1].cumsum()[::-1]  # words that occur as often or more
        least = int(steps[most <= KNOWN][0]) if (most <= KNOWN).any() else 1 << 62
        known = counts.where(F.col("n") >= least).toArrow()
        hashes, n = (known.column(c).to_numpy() for c in ("hash", "n"))
        return cls(Known.of(hashes, n, steps, words), counts.where(F.col("n") < least), int((steps * words).sum()))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return hashes, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(hashes)).astype(np.int64)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(hash, n): how often each word occurs in all texts."""
    ship_with(texts)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = lambda part: pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["hash", "n"])
        for batch in batches:
            for part in by_bytes(batch):
                words = Words.of(part.column("text"))
                held.append((word_hashes(words), np.bincount(words.code, minlength=len(words.distinct))))
                if sum(len(h) for h, _ in held) > 2 * COUNTED:
                    held = [summed(held)]
                    if len(held[0][0]) > COUNTED:
                        yield rows(held.pop())
        if held:
            yield rows(summed(held))

    return texts.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def gathered(texts: DataFrame) -> CorpusVocabulary:
    return CorpusVocabulary.from_counts(cut(corpus_counts(texts)))


# --- texts as codes


def coded(texts: DataFrame, vocabulary: CorpusVocabulary, slices: int) -> DataFrame:
    """(id, slice, codes, share, once) from (id, text): a text's words as 16-bit codes, the sum of their log-shares of these,
    and how many of its words the corpus has once at most.

    Texts are dealt out to slices by a hash of id and words; each slice is whole and in the order of that hash in one task.
    Rows with the same id and words are in one slice, in any order, as they are the same. Counts of the words that no task
    knows come along with the texts of their slice, so texts are shuffled once, as codes.
    """
    ship_with(texts)
    known = texts.sparkSession.sparkContext.broadcast(vocabulary.known)
    of_id = T.StructField("id", texts.schema["id"].dataType)
    schema = T.StructType([of_id, T.StructField("codes", T.BinaryType()), T.StructField("share", T.DoubleType()), T.StructField("once", T.LongType()), T.StructField("rare", T.BinaryType())])

    def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        ends = (bounds * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])

    def code(batches):
        """rare has the hashes of the words that are not known, in the order of the text."""
        for batch in batches:
            for part in by_bytes(batch):
                words = Words.of(part.column("text"))
                hashes = word_hashes(words)
                own, share, once = known.value.look_up(hashes)
                unknown = (own == RARE)[words.code]
                text = np.repeat(np.arange(part.num_rows), np.diff(words.bounds))
                total = np.bincount(text, share[words.code], minlength=part.num_rows)
                single = np.bincount(text, once[words.code], minlength=part.num_rows).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(unknown)])[words.bounds]
                yield pa.RecordBatch.from_arrays([part.column("id"), binary(own[words.code], words.bounds), pa.array(total.astype(np.float64)), pa.array(single), binary(hashes[words.code[unknown]], before)], schema.fieldNames())

    def wanted(batches):
        """(slice, hash), each once for a slice and a batch."""
        for batch in batches:
            lists = batch.column("rare").to_pylist()
            hashes = np.frombuffer(b"".join(lists), np.int64)
            of_slice = np.repeat(batch.column("slice").to_numpy(), [len(x) // 8 for x in lists])
            order = np.lexsort([hashes, of_slice])
            hashes, of_slice = hashes[order], of_slice[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (of_slice[1:] != of_slice[:-1]))[: len(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array(of_slice[new]), pa.array(hashes[new])], ["slice", "hash"])

    def filled(batches):
        """Texts of a slice come after the counts of its rare words."""
        number, parts, table_of = None, [], None
        for batch in batches:
            for part in by_bytes(batch, CODED, "codes"):
                of_row, is_text = part.column("slice").to_numpy(), part.column("order").is_valid().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((of_row[1:] != of_row[:-1]) | (is_text[1:] != is_text[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows], strict=True):
                    if a == b:
                        continue
                    if of_row[a] != number:
                        number, parts, table_of = of_row[a], [], None
                    own = part.slice(a, b - a)
                    if not is_text[a]:
                        parts.append((own.column("hash").to_numpy(), own.column("n").to_numpy()))
                        continue
                    if table_of is None:
                        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.int64)
                        order = np.argsort(hashes)
                        table_of = hashes[order], np.concatenate([n for _, n in parts])[order] if parts else np.zeros(0, np.int64)
                    codes, bounds = words_of(own)
                    lists = own.column("rare").to_pylist()
                    share, single = own.column("share").to_numpy().copy(), own.column("once").to_numpy().copy()
                    asked = np.frombuffer(b"".join(lists), np.int64)
                    if len(asked):
                        at = np.minimum(np.searchsorted(table_of[0], asked), max(len(table_of[0]) - 1, 0))
                        n = np.where(table_of[0][at] == asked, table_of[1][at], 0) if len(table_of[0]) else np.zeros(len(asked), np.int64)
                        of_word, share_of_word = known.value.by_count(n)
                        codes = codes.copy()
                        codes[codes == RARE] = of_word
                        text = np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists])
                        share += np.bincount(text, share_of_word, minlength=len(lists))
                        single += np.bincount(text, n <= 1, minlength=len(lists)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([own.column("id"), own.column("slice"), binary(codes, bounds), pa.array(share), pa.array(single)], ["id", "slice", "codes", "share", "once"])

    own = texts.mapInArrow(code, schema).withColumn("order", F.xxhash64(F.col("id").cast("string"), "codes", "rare"))
    own = cut(own.withColumn("slice", F.pmod("order", F.lit(slices)).cast("int")))
    counts = own.where("length(rare) > 0").select("slice", "rare").mapInArrow(wanted, "slice int, hash long").repartition("hash").distinct().join(vocabulary.others, "hash")
    both = own.unionByName(counts.select("slice", "hash", "n"), allowMissingColumns=True)
    tasks = min(slices, TASKS)
    both = both.repartitionById(tasks, F.col("slice") % tasks).sortWithinPartitions("slice", "order", F.col("id").cast("string"), "codes", "rare")
    out = cut(both.mapInArrow(filled, T.StructType([of_id, T.StructField("slice", T.IntegerType()), *schema.fields[1:4]])))
    discard(own)
    return out


def slices_of(texts: DataFrame) -> int:
    """Slices of texts whose words are not counted yet, by their bytes."""
    return max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (SLICE_WORDS * 6)))


def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes of coded texts, one after another, and the bounds of the texts."""
    own = part.column("codes").to_pylist()
    return np.frombuffer(b"".join(own), np.uint16), np.cumsum([0, *(len(x) // 2 for x in own)])


def windows(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with SIDE pads (PAD) between texts, and the place of each word among them."""
    place = np.arange(len(codes)) + SIDE * (np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + 1)
    padded = np.full(len(codes) + SIDE * (len(bounds) + 1), PAD, np.uint16)
    padded[place] = codes
    return padded, place


# --- whole numbers summed over tasks


def total_of(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], part: int = 1 << 16) -> np.ndarray | None:
    """The sum of the arrays of whole numbers that work gives for each task, exact in any order; None without any.

    Arrays travel in compressed parts, which are added up lane by lane in a tree, so no task reads a part of every task.
    """
    ship_with(frame)

    def packed(batches):
        for own in work(batches):
            for k, start in enumerate(range(0, len(own), part)):
                data = zlib.compress(own[start : start + part].astype(np.int64).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["lane", "part", "data"])

    def added(rows: pa.Table) -> pa.Table:
        total = 0
        for data in rows.column("data"):
            total = total + np.frombuffer(zlib.decompress(data.as_py()), np.int64)
        return pa.table([rows.column("lane").slice(0, 1), rows.column("part").slice(0, 1), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["lane", "part", "data"])

    schema = "lane int, part int, data binary"
    rows = frame.mapInArrow(packed, schema)
    for lanes in LANES:
        rows = rows.withColumn("lane", F.col("lane") % lanes).groupBy("lane", "part").applyInArrow(added, schema)
    found = rows.collect()
    if not found:
        return None
    return np.concatenate([np.frombuffer(zlib.decompress(r["data"]), np.int64) for r in sorted(found, key=lambda r: r["part"])])


# --- clusters of words


def beside(texts: DataFrame) -> np.ndarray:
    """How often each of the BESIDE most frequent words stands before and after each modelled word."""

    def count(batches):
        total = np.zeros(2 * MODELLED * BESIDE, np.int64)
        for batch in batches:
            for part in by_bytes(batch, CODED, "codes"):
                padded, place = windows(*words_of(part))
                own = padded[place].astype(np.int64)
                for side, shift in enumerate((-1, 1)):
                    next_to = padded[place + shift]
                    kept = (own < MODELLED) & (next_to < BESIDE)
                    slot, n = np.unique((own[kept] * 2 + side) * BESIDE + next_to[kept], return_counts=True)
                    total[slot] += n
        yield total

    found = total_of(texts.select("codes"), count)
    return (np.zeros(2 * MODELLED * BESIDE, np.int64) if found is None else found).reshape(MODELLED, 2 * BESIDE)


def clusters_of(counts: np.ndarray, clusters: int = CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each word and its place there, by halving words along the main direction of their neighbour shares."""
    x = counts + 0.01
    x = np.sqrt(x / x.sum(axis=1, keepdims=True))
    groups = [np.arange(len(x))]
    while len(groups) < clusters:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            axis = axis * np.sign(axis[np.abs(axis).argmax()])
            ordered = g[np.argsort(np.round(y @ axis, 9), kind="stable")]
            halves += [np.sort(ordered[: len(g) // 2]), np.sort(ordered[len(g) // 2 :])]
        groups = halves
    cluster, member = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for k, g in enumerate(groups):
        cluster[g], member[g] = k, np.arange(len(g))
    return cluster, member


# --- the network

class Room:
    """Arrays that a step leaves and the next one fills again, so that memory is asked for and its pages are touched once."""

    def __init__(self, kind: np.dtype | type = np.float32):
        self.kind, self.held = kind, {}

    def of(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if len(self.held.get(name, ())) < n:
            self.held[name] = np.empty(n, self.kind)
        return self.held[name][:n].reshape(shape)


OUTER = CLUSTERS + BANDS
#: The last column of outer and own is the bias.
SHAPES = {"embed": (CODES + 1, EMBED), "inner": (len(SHIFTS) * EMBED, HIDDEN), "inner_bias": (HIDDEN,), "outer": (OUTER, HIDDEN + 1), "own": (CLUSTERS, MEMBERS, HIDDEN + 1)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


@dataclass
class Network:
    """Parameters, and where the words are: cluster and member by code (a band's cluster lies behind the clusters)."""

    flat: np.ndarray
    cluster: np.ndarray
    member: np.ndarray

    @classmethod
    def initial(cls, cluster: np.ndarray, member: np.ndarray, mass: np.ndarray, seed: int = 7) -> Network:
        """Random first layers; the biases say how often each code (mass) occurs, so it starts as the unigram model."""
        rng, flat = np.random.default_rng(seed), np.zeros(SIZE, np.float32)
        p = unpack(flat)
        p["embed"][:] = rng.normal(0, 0.25, p["embed"].shape)
        p["inner"][:] = rng.normal(0, 1.5 / np.sqrt(p["inner"].shape[0]), p["inner"].shape)
        cluster = np.append(cluster, CLUSTERS + np.arange(BANDS))
        mass = np.maximum(mass, 1e-9)
        of_cluster = np.bincount(cluster, mass, minlength=OUTER)
        p["outer"][:, -1] = np.maximum(np.log(of_cluster / of_cluster.sum()), -30)
        p["own"][cluster[:MODELLED], member, -1] = np.maximum(np.log(mass[:MODELLED] / of_cluster[cluster[:MODELLED]]), -30)
        return cls(flat, cluster, member)

    def gradient(self, context: np.ndarray, target: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, float]:
        """Of the mean negative log-probability of the targets; and the sum. context: codes by window and shift. With a room
        the gradient is there until the next one."""
        room = room or Room(self.flat.dtype)
        p, flat = unpack(self.flat), room.of("flat", SIZE)
        flat[:] = 0
        g, n = unpack(flat), len(target)
        at, target = np.arange(n), target.astype(np.int64)
        x = np.take(p["embed"], context.ravel(), axis=0, out=room.of("x", context.size, EMBED), mode="clip").reshape(n, -1)
        hidden = room.of("hidden", n, HIDDEN + 1)
        hidden[:, -1] = 1
        hidden[:, :-1] = np.tanh(x @ p["inner"] + p["inner_bias"])
        # clusters and bands
        cluster = self.cluster[target]
        z = np.matmul(p["outer"], hidden.T, out=room.of("z", OUTER, n))
        np.clip(z, -MOST, MOST, out=z)
        loss = -z[cluster, at]
        np.exp(z, out=z)
        total = z.sum(axis=0)
        loss += np.log(total)
        z /= total * n
        z[cluster, at] -= 1 / n
        np.matmul(z, hidden, out=g["outer"])
        back = z.T @ p["outer"]
        # words of their clusters
        own = np.flatnonzero(target < MODELLED)
        own = own[np.argsort(cluster[own].astype(np.uint8), kind="stable")]
        its, member, there = cluster[own], self.member[target[own]], hidden[own]
        cuts = np.searchsorted(its, np.arange(CLUSTERS + 1)).tolist()
        used = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        z, at, more = room.of("words", len(own), MEMBERS), np.arange(len(own)), room.of("more", *there.shape)
        for k, part in used:
            np.matmul(there[part], p["own"][k].T, out=z[part])
        np.clip(z, -MOST, MOST, out=z)
        loss[own] -= z[at, member]
        np.exp(z, out=z)
        total = z.sum(axis=1)
        loss[own] += np.log(total)
        z /= (total * n)[:, None]
        z[at, member] -= 1 / n
        for k, part in used:
            np.matmul(z[part].T, there[part], out=g["own"][k])
            np.matmul(z[part], p["own"][k], out=more[part])
        back[own] += more
        # below
        back = back[:, :-1] * (1 - hidden[:, :-1] ** 2)
        g["inner"][:], g["inner_bias"][:] = x.T @ back, back.sum(axis=0)
        back = (back @ p["inner"].T).reshape(-1, EMBED)
        codes = context.ravel()
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        g["embed"][codes[first]] = np.add.reduceat(np.take(back, order, axis=0, out=room.of("back", *back.shape), mode="clip"), first)
        return flat, float(loss.sum())

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Log-probabilities from rounded parameters; products are sums of few whole numbers, exact in single precision."""

    def __init__(self, network: Network):
        p = {k: v.astype(np.float64) for k, v in unpack(network.flat).items()}
        self.tables = [np.rint((p["embed"] @ p["inner"][i * EMBED : (i + 1) * EMBED]) * 4096).astype(np.float32) / 4096 for i in range(len(SHIFTS))]
        self.inner_bias = p["inner_bias"].astype(np.float32)
        self.outer, self.own = self._whole(p["outer"]), np.ascontiguousarray(self._whole(p["own"]).transpose(0, 2, 1))
        self.cluster, self.member, self.room = network.cluster, network.member, Room()

    @staticmethod
    def _whole(weights: np.ndarray) -> np.ndarray:
        out = np.rint(np.clip(weights, -MOST_WEIGHT, MOST_WEIGHT) * WEIGHT_STEPS)
        out[..., -1] = np.rint(np.clip(weights[..., -1], -MOST, MOST) * (WEIGHT_STEPS * HIDDEN_STEPS))
        return out.astype(np.float32)

    @staticmethod
    def _logits(z: np.ndarray) -> None:
        z *= np.float32(1 / (WEIGHT_STEPS * HIDDEN_STEPS))  # a power of two, so nothing is lost
        np.clip(z, -MOST, MOST, out=z)

    def log_probs(self, padded: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-probability of the code at each place, given the codes on both sides."""
        out = np.zeros(len(place), np.float32)
        for start in range(0, len(place), AT_ONCE):
            at = place[start : start + AT_ONCE]
            target = padded[at].astype(np.int64)
            inner, more = (self.room.of(name, len(at), HIDDEN) for name in ("inner", "more"))
            np.take(self.tables[0], padded[at + SHIFTS[0]], axis=0, out=inner, mode="clip")
            for table_of, shift in zip(self.tables[1:], SHIFTS[1:], strict=True):
                inner += np.take(table_of, padded[at + shift], axis=0, out=more, mode="clip")
            inner += self.inner_bias
            np.tanh(inner, out=inner)
            inner *= np.float32(HIDDEN_STEPS)
            hidden = self.room.of("hidden", len(at), HIDDEN + 1)
            hidden[:, -1] = 1
            np.rint(inner, out=hidden[:, :-1])
            # clusters by row, added up one after another
            cluster = self.cluster[target]
            z = np.matmul(self.outer, hidden.T, out=self.room.of("z", OUTER, len(at)))
            self._logits(z)
            own = z[cluster, np.arange(len(at))]
            np.exp(z, out=z)
            total = z[0].copy()
            for more in z[1:]:
                total += more
            own -= np.log(total)
            # words of a cluster by column, each row added up by itself
            words = np.flatnonzero(target < MODELLED)
            words = words[np.argsort(cluster[words].astype(np.uint8), kind="stable")]
            there = hidden[words]
            cuts = np.searchsorted(cluster[words], np.arange(CLUSTERS + 1)).tolist()
            z = self.room.of("words", len(words), MEMBERS)
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    np.matmul(there[a:b], self.own[k], out=z[a:b])
            self._logits(z)
            of_word = z[np.arange(len(words)), self.member[target[words]]]
            np.exp(z, out=z)
            own[words] += of_word - np.log(z.sum(axis=1))
            out[start : start + AT_ONCE] = own
        return out


class Descent:
    """Adagrad over the windows of a slice as they come, a fixed number a step."""

    def __init__(self, start: Network):
        self.network = Network(start.flat.copy(), start.cluster, start.member)
        self.squares, self.seen = np.full(SIZE, 1e-8, np.float32), 0
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.room = Room()

    def learn(self, context: np.ndarray, target: np.ndarray) -> None:
        self.held.append((context, target))
        if sum(len(t) for _, t in self.held) >= STEP_WINDOWS:
            self._steps(whole=True)

    def _steps(self, whole: bool) -> None:
        context, target = (np.concatenate(x) for x in zip(*self.held, strict=True))
        end = len(target) // STEP_WINDOWS * STEP_WINDOWS if whole else len(target)
        for start in range(0, end, STEP_WINDOWS):
            own = slice(start, min(start + STEP_WINDOWS, end))
            g, _ = self.network.gradient(context[own], target[own], self.room)
            more = np.multiply(g, g, out=self.room.of("squares", SIZE))
            self.squares += more
            g /= np.sqrt(self.squares, out=more)
            g *= RATE
            self.network.flat -= g
        self.held = [(context[end:], target[end:])] if end < len(target) else []
        self.seen += end

    def finished(self) -> np.ndarray:
        """Parameters in whole steps times the windows that they come from, and the number of these."""
        if self.held:
            self._steps(whole=False)
        return np.append(np.rint(self.network.flat.astype(np.float64) * MEAN_STEPS).astype(np.int64) * self.seen, self.seen)


def training_round(texts: DataFrame, start: Network, shift: int, stride: int) -> Network:
    """Parameters after each slice of coded texts has been learned from the same start, averaged by its windows."""
    held = texts.sparkSession.sparkContext.broadcast(start)

    def descend(batches):
        one_blas_thread()
        total, own, number = np.zeros(SIZE + 1, np.int64), None, None
        for batch in batches:
            for part in by_bytes(batch, CODED, "codes"):
                of_row = part.column("slice").to_numpy()
                cuts = [0, *(np.flatnonzero(of_row[1:] != of_row[:-1]) + 1).tolist(), len(of_row)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if own is None or of_row[a] != number:
                        total += own.finished() if own is not None else 0
                        own, number = Descent(held.value), of_row[a]
                    codes, bounds = words_of(part.slice(a, b - a))
                    padded, place = windows(codes, bounds)
                    at = place[(np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))) % stride == shift]
                    if len(at):
                        own.learn(np.stack([padded[at + k] for k in SHIFTS], axis=1), padded[at])
        if own is not None:
            yield total + own.finished()

    total = total_of(texts.select("slice", "codes"), descend)
    if total is None or not total[-1]:
        return start
    return Network((total[:-1] / total[-1] / MEAN_STEPS).astype(np.float32), start.cluster, start.member)


def fitted(texts: DataFrame, vocabulary: CorpusVocabulary, rounds: int) -> Network:
    """A network learned from coded texts; after no round the unigram model."""
    network = Network.initial(*clusters_of(beside(texts)), vocabulary.known.total)
    for k in range(rounds):
        network = training_round(texts, network, shift=k, stride=rounds)
    return network


@dataclass
class WindowModel:
    vocabulary: CorpusVocabulary
    network: Network


def train(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> WindowModel:
    """Counts over all documents, then rounds of training, whose windows together are those of every word."""
    texts = ids_and_texts(docs, id_col, text_col)
    vocabulary = gathered(texts)
    return WindowModel(vocabulary, fitted(coded(texts, vocabulary, vocabulary.slices), vocabulary, rounds))


def scored(texts: DataFrame, network: Network, id_field: T.StructField) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(network)

    def work(batches):
        one_blas_thread()
        scorer = None
        for batch in batches:
            scorer = scorer or held.value.scorer()
            for part in by_bytes(batch, CODED, "codes"):
                codes, bounds = words_of(part)
                each = scorer.log_probs(*windows(codes, bounds))
                text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                total = np.bincount(text, each, minlength=part.num_rows) + part.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(total.astype(np.float64)), part.column("once")], ["doc_id", "n_words", "pll", "n_once"])

    schema = T.StructType([id_field, T.StructField("n_words", T.LongType()), T.StructField("pll", T.DoubleType()), T.StructField("n_once", T.LongType())])
    return texts.select("id", "codes", "share", "once").mapInArrow(work, schema).withColumn("pll_per_word", F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words")))


def score(docs: DataFrame, model: WindowModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, pll (the sum of log-probabilities), n_once (words that the corpus has once at most) and
    pll_per_word.

    A null, empty or blank text has no words: pll 0, pll_per_word null. Equal texts have equal scores. Repeated rows
    repeat; an empty table gives an empty one (and an untrained model); further columns are ignored.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    return scored(coded(texts, model.vocabulary, slices_of(texts)), model.network, id_field(docs, id_col, "doc_id"))


def op3_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = ids_and_texts(docs, "doc_id", "text")
    vocabulary = gathered(texts)
    own = coded(texts, vocabulary, vocabulary.slices)
    return scored(own, fitted(own, vocabulary, ROUNDS), id_field(docs, "doc_id", "doc_id"))
