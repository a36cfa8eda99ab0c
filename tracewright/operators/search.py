"""Exact top-k search of a stated query set over all rows, in blocks.

Documents and queries are packed into blocks of bounded size, and each pair of blocks is one matrix product, of which
only the k best documents of each query leave: no frame ever has a row for each query and document. In hybrid search a
task holds the query blocks of a pass and reads each of its documents once. Texts are tokenized
once, in numpy. Scores are rounded before they are compared, and ties
go to the smaller id, in blocks and over all of them alike. Search by words alone goes through an index: see postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.tokens import identifier_hashes
from tracewright.operators.retrieval import B, EPSILON, K1, PATH_BOOST
from tracewright.session import cut, discard, ship

#: Bytes of query blocks that are broadcast at once; with more of them there are more passes.
PASS_BYTES = 32 << 20
#: Queries and documents of a block; bytes of text tokenized at once; distinct terms that a task counts before it passes them on.
QUERIES, ROWS, TEXT_BYTES, COUNTED = 128, 1024, 4 << 20, 1 << 19
#: Queries of a block that a term of so many of them is a column of a product for.
SHARED = 8


def _packed(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pa.Table | None:
    return None if data is None else pa.ipc.open_stream(data).read_all().combine_chunks()


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each; a longer text is one of its own."""
    start, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def counts_of(blocks: DataFrame) -> DataFrame:
    """(hash, df, tokens) from text_blocks: documents with each term; the row with a null hash has the documents and tokens in all."""

    def count(batches):
        held, n, documents, tokens = [], 0, 0, 0
        rows = lambda h, c: pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(np.zeros(len(h), np.int64))], ["hash", "df", "tokens"])
        for batch in batches:
            held.append(np.unique(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64), return_counts=True))
            n += len(held[-1][0])
            documents, tokens = documents + batch.num_rows, tokens + int(batch.column("tokens").to_numpy().sum())
            if n > 2 * COUNTED:
                held = [_added(held)]
                n = len(held[0][0])
                if n > COUNTED:
                    yield rows(*held.pop())
                    n = 0
        if held:
            yield rows(*_added(held))
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([documents]), pa.array([tokens])], ["hash", "df", "tokens"])

    ship(blocks.sparkSession)
    return blocks.select("tokens", "hashes").mapInArrow(count, "hash long, df long, tokens long").groupBy("hash").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def _added(parts):
    hashes, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
    return hashes, np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(hashes)).astype(np.int64)


def weighted_terms(queries: DataFrame, query: str, text: str, counts: DataFrame) -> DataFrame:
    """(query, hash, weight, mean_terms): each query's terms that some document has, times in the query times idf.

    A negative idf becomes EPSILON times the mean over the vocabulary (of the values as they were).
    """

    def terms(batches):
        for batch in batches:
            hashes, bounds = identifier_hashes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))), pa.array(hashes)], ["query", "hash"])

    own = queries.select(F.col(query).cast("long").alias("query"), F.col(text).cast("string").alias("text")).mapInArrow(terms, "query long, hash long")
    own = own.groupBy("query", "hash").agg(F.count(F.lit(1)).alias("times"))
    corpus = counts.where("hash is null").select(F.col("df").alias("documents"), (F.col("tokens") / F.col("df")).alias("mean_terms"))
    raw = counts.where("hash is not null").crossJoin(F.broadcast(corpus)).select("hash", "mean_terms", (F.log(F.col("documents") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.hint("merge").join(own, "hash").crossJoin(F.broadcast(mean)).select("query", "hash", (F.col("times") * idf).alias("weight"), "mean_terms")


def _blocks_of(frame: DataFrame, blocks: int, name: str) -> DataFrame:
    """(block, name): rows of each query block in one value."""
    pack = lambda rows: pa.table([rows.column("block").slice(0, 1), pa.array([_packed(rows)], pa.binary())], ["block", name])
    return frame.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, f"block int, {name} binary")


def blocks_for(count: int) -> int:
    return max(1, -(-count // QUERIES))


def query_blocks(blocks: int, **frames: DataFrame) -> DataFrame:
    """(block, one value by frame) from frames with a column query."""
    out = None
    for name, frame in frames.items():
        own = _blocks_of(frame, blocks, name)
        out = own if out is None else out.join(own, "block", "full")
    return out


def text_blocks(docs: DataFrame, doc: str, text: str, *also: str) -> DataFrame:
    """(doc, tokens, hashes, times): what BM25 needs of each document; hashes and times as packed whole numbers. Strings named
    in `also` come along."""
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for part in _slices(batch, "text", TEXT_BYTES):
                hashes, bounds = identifier_hashes(part.column("text"))
                found, times = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    h, n = np.unique(hashes[a:b], return_counts=True)
                    found.append(h.tobytes())
                    times.append(n.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(found, pa.binary()), pa.array(times, pa.binary()), *map(part.column, also)], ["doc", "tokens", "hashes", "times", *also])

    own = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), *also)
    return own.mapInArrow(count, ", ".join(["doc long, tokens long, hashes binary, times binary", *(f"{name} string" for name in also)]))


def row_blocks(rows: DataFrame) -> DataFrame:
    """(rows): blocks of at most ROWS rows in one value each."""
    ship(rows.sparkSession)

    def pack(batches):
        for batch in batches:
            values = [_packed(batch.slice(k, ROWS)) for k in range(0, batch.num_rows, ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], ["rows"])

    return rows.mapInArrow(pack, "rows binary")


def unit_vectors(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision (zero ones stay zero), and which are there; all of the first's length."""
    whole = values.combine_chunks()
    if len(whole) and not whole.null_count and not whole.values.null_count and len(whole.flatten()) % len(whole) == 0 and (np.diff(whole.offsets.to_numpy()) == len(whole.flatten()) // len(whole)).all():
        out = whole.flatten().to_numpy().reshape(len(whole), -1).astype(float)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1), np.ones(len(out), bool)
    lists = values.to_pylist()
    size = next((len(v) for v in lists if v is not None), 0)
    there = np.array([v is not None and len(v) == size and None not in v for v in lists], bool)
    out = np.zeros((len(lists), size))
    if there.any():
        out[there] = np.array([v for v, t in zip(lists, there, strict=True) if t], float)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1), there


class Rows:
    """A slice of documents: unit vectors, and the postings in the order of their hashes with what BM25 makes of them."""

    def __init__(self, part: pa.RecordBatch, mean: float | None):
        self.docs, self.paths = part.column("doc").to_numpy(), part.column("path")
        self.vectors, self.there = unit_vectors(pa.chunked_array([part.column("vector")]))
        found = [np.frombuffer(x or b"", np.int64) for x in part.column("hashes").to_pylist()]
        hashes, times = np.concatenate(found), np.frombuffer(b"".join(x or b"" for x in part.column("times").to_pylist()), np.int32).astype(float)
        order = np.argsort(hashes)
        text, tokens = np.repeat(np.arange(len(found)), [len(x) for x in found]), part.column("tokens").to_numpy(zero_copy_only=False)
        self.hashes, self.text, times = hashes[order], text[order], times[order]
        self.part = times * (K1 + 1) / (times + K1 * (1 - B + B * tokens[self.text] / (mean or 1)))


class Asked:
    """A query block: the ids (ascending) and what each asks for."""

    def __init__(self, terms: pa.Table | None, vectors: pa.Table | None, paths: pa.Table | None, ranges: pa.Table | None = None):
        numbers = [t.column("query").to_numpy() for t in (terms, vectors) if t is not None]
        self.ids = np.unique(np.concatenate([*numbers, np.zeros(0, np.int64)]))
        self.mean = terms.column("mean_terms")[0].as_py() if terms is not None else None
        self.hashes = np.zeros(0, np.int64)
        if terms is not None:
            terms = terms.sort_by([("hash", "ascending"), ("query", "ascending")])
            own = terms.column("hash").to_numpy()
            self.hashes, first, self.n = np.unique(own, return_index=True, return_counts=True)
            self.first, self.column, self.weight = first, np.searchsorted(self.ids, terms.column("query").to_numpy()), terms.column("weight").to_numpy()
            self.shared = np.flatnonzero(self.n >= SHARED)
            self.weights = np.zeros((len(self.shared), len(self.ids)))
            for k, t in enumerate(self.shared):
                self.weights[k, self.column[first[t] : first[t] + self.n[t]]] = self.weight[first[t] : first[t] + self.n[t]]
        self.vectors = None
        if vectors is not None:
            y, asked = unit_vectors(vectors.column("vector"))
            self.vectors = np.zeros((len(self.ids), y.shape[1]))
            self.vectors[np.searchsorted(self.ids, vectors.column("query").to_numpy()[asked])] = y[asked]
        self.paths: dict[str, list[int]] = {}
        if paths is not None:
            place = {q: k for k, q in enumerate(self.ids.tolist())}
            for q, p in sorted(set(zip(paths.column("query").to_pylist(), paths.column("path").to_pylist(), strict=True)), key=str):
                if q in place and p is not None:
                    self.paths.setdefault(p, []).append(place[q])
        if ranges is not None:
            ranges = ranges.sort_by("query")  # of the same queries
            self.limits = [ranges.column(name).to_numpy() for name in RANGES]

    def dense(self, rows: Rows) -> np.ndarray:
        """Cosine by document and query; 0 where a side lacks its vector."""
        if self.vectors is None or rows.vectors.shape[1] != self.vectors.shape[1]:
            return np.zeros((len(rows.docs), len(self.ids)))
        out = rows.vectors @ self.vectors.T
        if not rows.there.all():
            out[~rows.there] = 0
        return out

    def lexical(self, rows: Rows) -> np.ndarray:
        """BM25 by document and query: what the postings of the documents add for the queries that ask for their terms.

        Terms that many queries of the block ask for are a matrix product, the others go to their cells.
        """
        out = np.zeros((len(rows.docs), len(self.ids)))
        if not len(self.hashes):
            return out
        low, high = np.searchsorted(rows.hashes, self.hashes, "left"), np.searchsorted(rows.hashes, self.hashes, "right")
        found = [k for k, t in enumerate(self.shared) if high[t] > low[t]]
        if found:
            of_term = np.zeros((len(rows.docs), len(found)))
            for at, k in enumerate(found):
                own = slice(low[self.shared[k]], high[self.shared[k]])
                of_term[rows.text[own], at] = rows.part[own]
            np.matmul(of_term, self.weights[found], out=out)
        few = np.flatnonzero((self.n < SHARED) & (high > low))
        if len(few):
            count = high[few] - low[few]
            posting = np.repeat(low[few] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            n, first = np.repeat(self.n[few], count), np.repeat(self.first[few], count)
            each = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            posting = np.repeat(posting, n)
            cell, at = np.unique(rows.text[posting] * len(self.ids) + self.column[each], return_inverse=True)
            out.ravel()[cell] += np.bincount(at, rows.part[posting] * self.weight[each], minlength=len(cell))
        return out


class Top:
    """The k best documents of each query of a block among those seen so far, by rounded score, then id."""

    def __init__(self, queries: int, k: int, places: int):
        self.k, self.places, self.most = k, places, 4 * queries * k
        self.bar = np.full(queries, -np.inf)  # what a score must reach
        self.held, self.waiting = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0)], []

    def add(self, docs: np.ndarray, score: np.ndarray, dense: np.ndarray, lexical: np.ndarray) -> None:
        i, j = np.nonzero(score >= self.bar - 10.0**-self.places)
        if len(i) > self.most:
            i, j = best(np.round(score, self.places), score >= self.bar - 10.0**-self.places, docs, self.k)
        if len(i):
            self.waiting.append([j, docs[i], np.round(score[i, j], self.places), dense[i, j], lexical[i, j]])
            if sum(len(x[0]) for x in self.waiting) > self.most or np.isneginf(self.bar).any():
                self.settle()

    def settle(self) -> list[np.ndarray]:
        """(query number, document, score, dense, lexical) of the best, by query, the best first."""
        query, docs, score, dense, lexical = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort([docs, -score, query])
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.held, self.waiting = [x[order] for x in (query, docs, score, dense, lexical)], []
        last = order[rank == self.k - 1]
        self.bar[query[last]] = score[last]
        return self.held


def best(scores: np.ndarray, there: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, query number) of the k best of each query, by score, then id."""
    own = np.where(there, scores, -np.inf)
    if len(own) > k:
        own = np.where(own >= np.partition(own, len(own) - k, axis=0)[len(own) - k], own, -np.inf)
    i, j = np.nonzero(own > -np.inf)
    order = np.lexsort([docs[i], -scores[i, j], j])
    i, j = i[order], j[order]
    rank = np.arange(len(j)) - np.searchsorted(j, j)
    return i[rank < k], j[rank < k]


def _passes(queries: DataFrame) -> list[list[int]]:
    """Blocks that are broadcast together, by their measured sizes; a larger one is a pass of its own."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in queries.columns if c != "block"), F.lit(0).cast("long"))
    out, held = [], PASS_BYTES
    for block, n in queries.select("block", size).orderBy("block").collect():  # a row for QUERIES queries
        if held + n > PASS_BYTES:
            out.append([])
            held = 0
        out[-1].append(block)
        held += n
    return out or [[]]


def _scored(rows: DataFrame, queries: DataFrame, work, schema: str) -> DataFrame:
    """What work gives for every block of rows with every block of queries; the queries are broadcast, some bytes a pass.

    Both are materialized: every pass reads them.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one at a time is copied
                own = {name: _unpacked(batch.column(name)[k].as_py()) for name in batch.schema.names}
                yield from work(own.pop("rows"), own)

    passes = _passes(queries)
    parts = [queries if len(passes) == 1 else queries.where(F.col("block").isin(own)) for own in passes]
    return reduce(DataFrame.unionByName, (rows.crossJoin(F.broadcast(part.drop("block"))).mapInArrow(run, schema) for part in parts))


def _held(rows: DataFrame, queries: DataFrame, work: Callable, schema: str, settled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work gives for the batches of each task and the query blocks of a pass, which all tasks hold; settled puts tasks together.

    Both are materialized. With several passes each is done before the next one's queries go through the driver.
    """
    ship(rows.sparkSession)
    passes, parts = _passes(queries), []
    for blocks in passes:
        own = queries.where(F.col("block").isin(blocks)).drop("block").collect()  # PASS_BYTES at most, or one block
        held = rows.sparkSession.sparkContext.broadcast([{name: bytes(value) for name, value in r.asDict().items() if value is not None} for r in own])

        def run(batches, held=held):
            yield from work(batches, [{name: _unpacked(value) for name, value in r.items()} for r in held.value])

        part = settled(rows.mapInArrow(run, schema))
        if len(passes) > 1:
            part = cut(part)
            held.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from tracewright.operators.retrieval import top_k

    return top_k(found, k, places=12)


def lexical_top(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, k: int, places: int = 6) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by BM25, of those that share a term with it.

    The index is built for this query set alone; postings.Postings keeps one for many.
    """
    from tracewright.operators.postings import Postings

    return Postings.build(docs, doc, text).top(queries, query, query_text, k, places)


def dense_top(vectors: DataFrame, doc: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, places: int = 6) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by cosine; 0 for zero vectors, none for null ones."""

    def work(rows, own):
        x, there = unit_vectors(rows.column("vector"))
        y, asked = unit_vectors(own["vectors"].column("vector"))
        ids, docs_of = own["vectors"].column("query").to_numpy(), rows.column("doc").to_numpy()
        if x.shape[1] != y.shape[1]:
            return
        score = np.round(x @ y.T, places)
        i, j = best(score, there[:, None] & asked[None, :], docs_of, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(docs_of[i]), pa.array(score[i, j])], ["query", "doc", "score"])

    blocks = blocks_for(queries.count())
    asked = query_blocks(blocks, vectors=queries.select(F.col(query).cast("long").alias("query"), F.col(query_vector).alias("vector")))
    own = vectors.select(F.col(doc).cast("long").alias("doc"), F.col(vector).alias("vector"))
    return _ranked(_scored(row_blocks(own), cut(asked), work, "query long, doc long, score double"), k)


def _unit(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Columns between their low and high as 0..1; 0 where these are about equal."""
    flat = high - low < 1e-9
    out = x - low
    out /= np.where(flat, 1.0, high - low)
    if flat.any():
        out[:, flat] = 0
    return out


RANGES = ("dense_low", "dense_high", "lexical_low", "lexical_high")


def hybrid_top(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, places: int = 6) -> DataFrame:
    """(query, doc, score, dense, lexical, rank): the k best of each query by both scores, each normalised over the query's
    documents to 0..1 and added, and PATH_BOOST for documents whose path the query names.

    docs: doc, text, path. vectors: doc, vector. queries: query, text, vector, paths. Every document of either side takes
    part; a score that it lacks is 0. Where all scores of a query are about equal they count 0.
    """

    def slices(batches, blocks):
        """(rows, query blocks) for slices of a task's documents."""
        asked = [Asked(own.get("terms"), own.get("vectors"), own.get("paths"), own.get("ranges")) for own in blocks]
        asked = [own for own in asked if len(own.ids)]
        mean = next((own.mean for own in asked if own.mean is not None), None)  # of the corpus
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield Rows(batch.slice(start, ROWS), mean), asked

    def ranges(batches, blocks):
        found: dict[int, list[np.ndarray]] = {}
        for rows, asked in slices(batches, blocks):
            for k, own in enumerate(asked):
                dense, lexical = own.dense(rows), own.lexical(rows)
                new = [dense.min(axis=0), dense.max(axis=0), lexical.min(axis=0), lexical.max(axis=0)]
                old = found.get(k, [own.ids, *new])[1:]
                found[k] = [own.ids, *(f(x, y) for f, x, y in zip((np.minimum, np.maximum) * 2, old, new, strict=True))]
        for own in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], ["query", *RANGES])

    def work(batches, blocks):
        found: dict[int, Top] = {}
        ids: dict[int, np.ndarray] = {}
        for rows, asked in slices(batches, blocks):
            paths = rows.paths.to_pylist()
            for n, own in enumerate(asked):
                dense, lexical = own.dense(rows), own.lexical(rows)
                a, b, c, d = own.limits
                score = _unit(dense, a, b)
                score += _unit(lexical, c, d)
                for i, p in enumerate(paths) if own.paths else ():
                    if p in own.paths:
                        score[i, own.paths[p]] += PATH_BOOST
                if n not in found:
                    found[n], ids[n] = Top(len(own.ids), k, places), own.ids
                found[n].add(rows.docs, score, dense, lexical)
        for n, top in found.items():
            query, *rest = top.settle()
            yield pa.RecordBatch.from_arrays([pa.array(ids[n][query]), *map(pa.array, rest)], ["query", "doc", "score", "dense", "lexical"])

    blocks, long = blocks_for(queries.count()), F.col("query").cast("long").alias("query")
    texts = cut(text_blocks(docs, "doc", "text", "path"))
    asked = query_blocks(
        blocks,
        terms=weighted_terms(queries, "query", "text", counts_of(texts)),
        vectors=queries.where("vector is not null").select(long, "vector"),
        paths=queries.select(long, F.explode("paths").alias("path")),
    )
    asked = cut(asked)
    rows = cut(texts.join(vectors.select(F.col("doc").cast("long").alias("doc"), "vector"), "doc", "full"))
    discard(texts)
    limits = lambda found: found.groupBy("query").agg(*((F.min if c.endswith("low") else F.max)(c).alias(c) for c in RANGES))
    limits = _held(rows, asked, ranges, "query long, " + ", ".join(f"{c} double" for c in RANGES), limits)
    asked = cut(asked.join(_blocks_of(limits, blocks, "ranges"), "block", "left"))
    return _held(rows, asked, work, "query long, doc long, score double, dense double, lexical double", lambda found: _ranked(found, k))
