"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence and frequency levels of hashed words and word beginnings is trained in numpy on the
driver from confirmed toxic documents and unlabelled text. With class prior p and logistic loss, the risk is
p * E_pos[loss(f)] + max(0, E_unl[loss(-f)] - p * E_pos[loss(-f)]): the unlabelled risk is corrected for the toxic share
it holds, and the corrected part is kept from going negative. The prior is the toxic share of the labels that learning
may see.

Both training samples are bounded (POSITIVES, UNLABELLED documents, chosen by a hash of the id); the features are
selected from document frequencies in the samples, so the driver sees two count vectors (compressed) per sample part and the
selected features of the sampled documents. Scoring is one Arrow pass over all documents without a shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import by_bytes, id_field, ids_and_texts, is_held_out, map_texts, remainder, ship_with, table
from tracewright.llm.simhash_dedup import shingle_hashes
from tracewright.llm.words import Words, first_bytes, letter_runs, low_bytes

#: Most documents that the classifier is fitted on, confirmed toxic and unlabelled.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Parts that a sample is read in, hashed features, and how many of them are selected.
PARTS, HASH_BITS, SELECTED = 8, 20, 4_096
PREFIX_BYTES = (4, 5, 6, 7)
#: Bytes of text at once; each takes some 50 bytes of memory for its features.
SLICE_BYTES = 1 << 20
#: Standard deviations by which a selected feature's frequency in toxic documents exceeds the expected one.
SIGMAS = 5.0
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, hashed feature) pairs: each run of letters as a whole, and its beginnings."""
    data, offsets = words.lowered()
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lengths, word = letter_runs(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = first_bytes(data, starts, lengths)
    letters = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = (letters - np.repeat(starts, lengths)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    spread = (data[letters].astype(np.uint64) + np.uint64(1)) * (place * _MIX ^ (place << np.uint64(29)))
    whole = np.add.reduceat(spread, np.cumsum(lengths) - lengths)
    shift = np.uint64(64 - HASH_BITS)
    hashed = [((whole ^ whole >> np.uint64(31)) * _MIX) >> shift]
    owner = [word]
    for k in PREFIX_BYTES:
        longer = lengths > k
        start = (head[longer] & low_bytes(np.array(k))) + np.uint64(k)
        start = (start ^ start >> np.uint64(32)) * _MIX
        hashed.append(((start ^ start >> np.uint64(29)) * _MIX) >> shift)
        owner.append(word[longer])
    return np.concatenate(owner), np.concatenate(hashed).astype(np.int64)


def leveled(feature: np.ndarray, level: int) -> np.ndarray:
    """The hashed feature that says a feature is at least at a level; level 0 is presence."""
    return feature if level == 0 else (feature * (2 * level * 0x9E37 + 1) + level * 0x3C6EF) & ((1 << HASH_BITS) - 1)


def reached(count: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Which (text, feature) pairs reach each level, from the feature's count in the text and the text's words."""
    again = count >= 2
    return [count >= 1, again, count >= 4, again & (count * 200 >= words), again & (count * 50 >= words)]


LEVELS = len(reached(np.zeros(1), np.zeros(1)))


def base_of(number: np.ndarray) -> np.ndarray:
    """Features of which some level is selected (number >= 0)."""
    every = np.arange(1 << HASH_BITS)
    return np.logical_or.reduce([number[leveled(every, k)] >= 0 for k in range(LEVELS)])


def present(texts: pa.Array, number: np.ndarray | None = None, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text. number: the place of a feature among the selected ones, or -1."""
    words = Words.of(texts)
    word, feature = features(words)
    if number is not None:
        kept = (base_of(number) if base is None else base)[feature]
        word, feature = word[kept], feature[kept]
    # occurrences of the distinct words that have features
    order = np.argsort(word, kind="stable")
    word, feature = word[order], feature[order]
    begin = np.searchsorted(word, np.arange(len(words.distinct) + 1))
    first, n = begin[words.code], (begin[1:] - begin[:-1])[words.code]
    used = np.flatnonzero(n)
    text = np.repeat(np.searchsorted(words.bounds, used, "right") - 1, n[used])
    at = np.repeat(first[used], n[used]) + np.arange(n[used].sum()) - np.repeat(np.cumsum(n[used]) - n[used], n[used])
    pair, count = np.unique(text.astype(np.int64) << HASH_BITS | feature[at], return_counts=True)
    text, feature = pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1)
    levels = reached(count, np.diff(words.bounds)[text])
    pair = np.concatenate([text[k] << HASH_BITS | leveled(feature[k], i) for i, k in enumerate(levels)])
    if number is not None:
        place = number[pair & ((1 << HASH_BITS) - 1)]
        pair = (pair >> HASH_BITS << HASH_BITS | place)[place >= 0]
    pair = np.unique(pair)
    return pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1)


@dataclass
class Classifier:
    weights: np.ndarray  # by hashed feature; zero for those not selected
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not hasattr(self, "base"):
            self.number = np.where(self.weights != 0, np.arange(len(self.weights)), -1)
            self.base = base_of(self.number)
        text, feature = present(texts, self.number, self.base)
        raw = self.bias + np.bincount(text, self.weights[feature], minlength=len(texts)) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def select(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, most: int = SELECTED) -> np.ndarray:
    """Features that confirmed toxic documents have far more often than chance would give them at the unlabelled rate."""
    rate = (unl + 0.5) / (n_unl + 1)
    expected = n_pos * rate
    score = np.where(pos >= 3, (pos - expected) / np.sqrt(expected * (1 - rate) + 0.5), 0)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] >= SIGMAS])


def nnpu_risk(f: np.ndarray, is_pos: np.ndarray, prior: float) -> tuple[float, np.ndarray, bool]:
    """The corrected risk for the outputs f of the rows, its gradient by output, and whether the unlabelled part is
    below zero: the gradient is then that of climbing back, the negative of the part's own."""
    s, negative = 1 / (1 + np.exp(-np.clip(f, -40, 40))), np.logaddexp(0, f)  # negative: the loss of calling a row that
    n_pos, n_unl = is_pos.sum(), (~is_pos).sum()
    rest = negative[~is_pos].mean() - prior * negative[is_pos].mean()
    g = np.where(is_pos, -prior * s / n_pos, s / n_unl)
    if rest < 0:
        return prior * float((negative - f)[is_pos].mean()), -g, True
    g[is_pos] += prior * (s[is_pos] - 1) / n_pos
    return prior * float((negative - f)[is_pos].mean()) + float(rest), g, False


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], size: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the least non-negative positive-unlabelled risk (Adam)."""
    rows = [*pos, *unl]
    n = np.array([len(r) for r in rows])
    at, owner, is_pos = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), n), np.arange(len(rows)) < len(pos)
    w, b = np.zeros(size), float(np.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        _, g, _ = nnpu_risk(b + np.bincount(owner, w[at], minlength=len(rows)), is_pos, prior)
        grad = np.append(np.bincount(at, g[owner], minlength=size) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _share(ids, most: int, there: int):
    """A condition that a share most / there of ids meets, by hash; all where they are fewer."""
    return F.lit(True) if there <= most else F.pmod(F.xxhash64(F.lit("sample"), ids), F.lit(1_000_000)) < int(1_000_000 * most / there)


def _sketch(batches):
    """Adds the least hash of each text's three-word shingles."""
    for batch in batches:
        key = [min((int(h.min()) for h in shingle_hashes(t)), default=0) - (1 << 63) for t in batch.column("text").to_pylist()]
        yield batch.append_column("key", pa.array(key, pa.int64()))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Fit on documents whose id is not held out. An id is confirmed toxic if all its label rows say so."""
    nothing = Classifier(np.zeros(1 << HASH_BITS), -40.0)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).where((remainder(F.col("id")) != 2) & F.col("y").isNotNull())
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    there, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not toxic:
        return nothing
    texts = ids_and_texts(docs, id_col, text_col).where(remainder(F.col("id")) != 2)
    chosen = known.where("y = 1").where(_share(F.col("id"), positives, toxic)).select("id").limit(2 * positives)
    pos = texts.join(F.broadcast(chosen), "id").select("text", F.lit(1).alias("y"))
    unl = texts.where(_share(F.col("id"), unlabelled, texts.count())).select("text", F.lit(0).alias("y"))
    # of copies and near copies one: else whatever words they share looks toxic
    sample = ship_with(pos.unionByName(unl)).mapInArrow(_sketch, "text string, y int, key long").groupBy("y", "key").agg(F.min("text").alias("text")).select("text", "y").repartition(PARTS).persist()
    try:
        counts = {0: (0, 0), 1: (0, 0)}
        for r in sample.mapInArrow(_frequencies, "y int, n long, seen binary").collect():
            n, seen = counts[r["y"]]
            counts[r["y"]] = n + r["n"], seen + np.frombuffer(zlib.decompress(r["seen"]), np.int32)
        if not counts[1][0] or not counts[0][0]:
            return nothing
        chosen_features = select(counts[1][1], counts[0][1], counts[1][0], counts[0][0])

        def selected(batches):
            number = np.full(1 << HASH_BITS, -1)
            number[chosen_features] = np.arange(len(chosen_features))
            base = base_of(number)
            for batch in batches:
                for part in by_bytes(batch, SLICE_BYTES):
                    text, feature = present(part.column("text"), number, base)
                    cut = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("y"), pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))], ["y", "x"])

        rows = sample.mapInArrow(selected, "y int, x array<int>").toArrow()
    finally:
        sample.unpersist()
    y, x = rows.column("y").to_numpy(), rows.column("x").combine_chunks()
    x = np.split(x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy()[1:-1] - x.offsets.to_numpy()[0])
    order = sorted(range(len(y)), key=lambda i: (len(x[i]), x[i].tobytes()))  # the sums don't depend on the order of arrival
    w, b = fit_nnpu([x[i] for i in order if y[i] == 1], [x[i] for i in order if y[i] == 0], len(chosen_features), toxic / there)
    weights = np.zeros(1 << HASH_BITS)
    weights[chosen_features] = w
    return Classifier(weights, b)


def _frequencies(batches):
    """Documents and document frequencies of the features (compressed) by class, one row of each for a sample part."""
    counts = {y: [0, np.zeros(1 << HASH_BITS, np.int32)] for y in (0, 1)}
    for batch in batches:
        for part in by_bytes(batch, SLICE_BYTES):
            y = part.column("y").to_numpy()
            text, feature = present(part.column("text"))
            for k, own in counts.items():
                own[0] += int((y == k).sum())
                np.add.at(own[1], feature[y[text] == k], 1)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([n for n, _ in counts.values()]), pa.array([zlib.compress(s.tobytes(), 1) for _, s in counts.values()])], ["y", "n", "seen"])


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (score >= 0.3).

    A null or empty text has no features and gets the score of the bias. Repeated rows repeat; an empty table gives
    an empty one; further columns are ignored; a null id is not held out.
    """
    used = np.flatnonzero(model.weights)
    small, bias, size = model.weights[used].copy(), model.bias, len(model.weights)
    schema = T.StructType([id_field(docs, id_col, "doc_id"), T.StructField("score", T.DoubleType())])
    held: list[Classifier] = []

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            weights = np.zeros(size)
            weights[used] = small
            held.append(Classifier(weights, bias))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(held[0].scores(part.column("text")))], ["doc_id", "score"])

    scored = map_texts(ids_and_texts(docs, id_col, text_col), work, schema, SLICE_BYTES)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all columns, in one pass; nothing is joined.

    Null and empty texts have the score of the bias; repeated rows stay or go alike; an empty table gives an empty one;
    columns other than the text may have any name.
    """
    used = np.flatnonzero(model.weights)
    small, bias, size = model.weights[used].copy(), model.bias, len(model.weights)
    held: list[Classifier] = []

    def run(batches):
        if not held:
            weights = np.zeros(size)
            weights[used] = small
            held.append(Classifier(weights, bias))
        for batch in batches:
            for part in by_bytes(batch, SLICE_BYTES, text_col):
                yield part.filter(pa.array(held[0].scores(part.column(text_col)) < threshold))

    return ship_with(docs).mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
