"""Exact BM25 top-k from an inverted index with block maxima, built once and asked many times.

Documents are cut into segments as they are tokenized. A row of the index is a term in a segment: the places of the
documents that have it, what it adds to the score of each before its weight, and the most that it adds. A query set is
answered in passes of bounded size: a few promising segments of each query are scored first, and the k-th best score
there is a threshold; terms that cannot reach it together are not followed (they only add to bounds); a segment whose
terms' maxima stay below it is skipped. Segments that are left are scored with all terms, in numpy, and only the k best of each
leave. Rows are stored by ranges of term hashes, a folder for each 256th of them, so a query set reads its own folders.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.tokens import identifier_hashes
from tracewright.operators.retrieval import B, EPSILON, K1, top_k
from tracewright.operators.search import best, text_blocks
from tracewright.session import cut, ship

#: Documents of a segment; terms of queries that a pass takes to every task; terms and segments that thresholds come from.
SEGMENT, ASKED, SEED_TERMS, SEEDS = 128, 500_000, 6, 4
_ROW = "hash long, segment long, top double, at array<int>, parts array<double>, docs array<long>"


@dataclass
class Postings:
    """rows (hash, segment, top, at, parts; one with a null hash and docs for each segment), terms (hash, df, top), and totals."""

    rows: DataFrame
    terms: DataFrame
    documents: int
    mean_terms: float
    mean_idf: float

    @classmethod
    def build(cls, docs: DataFrame, doc: str, text: str) -> Postings:
        """Texts are tokenized once. Null and empty texts are documents without terms; repeated ids are documents of their own."""
        tokenized = cut(text_blocks(docs, doc, text))
        documents, tokens = tokenized.agg(F.count(F.lit(1)), F.sum("tokens")).first()
        mean = (tokens or 0) / documents if documents else 0.0

        def invert(batches):
            number = TaskContext.get().partitionId() << 33
            for whole in batches:
                for batch in (whole.slice(k, SEGMENT) for k in range(0, whole.num_rows, SEGMENT)):
                    found = [np.frombuffer(x, np.int64) for x in batch.column("hashes").to_pylist()]
                    hashes, times = np.concatenate(found), np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int32).astype(float)
                    at, tokens = np.repeat(np.arange(len(found)), [len(x) for x in found]), batch.column("tokens").to_numpy()
                    parts = times * (K1 + 1) / (times + K1 * (1 - B + B * tokens[at] / mean)) if len(at) else times
                    order = np.argsort(hashes, kind="stable")
                    hashes, at, parts = hashes[order], at[order], parts[order]
                    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))[: len(hashes)]
                    ends = np.append(starts, len(hashes)).astype(np.int32)
                    n = len(starts)
                    lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                    tops = np.maximum.reduceat(parts, starts) if n else parts
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[starts]), pa.array(np.full(n, number)), pa.array(tops), lists(at.astype(np.int32)), lists(parts), pa.nulls(n, pa.list_(pa.int64()))], ["hash", "segment", "top", "at", "parts", "docs"])
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([number]), pa.nulls(1, pa.float64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.float64())), pa.array([batch.column("doc").to_pylist()], pa.list_(pa.int64()))], ["hash", "segment", "top", "at", "parts", "docs"])
                    number += 1

        rows = cut(tokenized.mapInArrow(invert, _ROW))
        return cls._of(rows, documents, mean)

    @classmethod
    def _of(cls, rows: DataFrame, documents: int, mean: float) -> Postings:
        terms = cut(rows.where("hash is not null").groupBy("hash").agg(F.sum(F.size("at")).alias("df"), F.max("top").alias("top")))
        raw = F.log(F.lit(documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return cls(rows, terms, documents, mean, terms.agg(F.avg(raw)).first()[0] or 0.0)

    def save(self, path: str) -> None:
        """Rows by ranges of hashes, so that a common term is in several files, and totals beside them."""
        bucket = F.coalesce(F.shiftright("hash", 56), F.lit(128)).cast("int")  # segments' own rows are a folder of their own
        self.rows.withColumn("bucket", bucket).repartitionByRange("bucket", "hash", "segment").sortWithinPartitions("bucket", "hash", "segment").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
        self.rows.sparkSession.createDataFrame([(self.documents, self.mean_terms)], "documents long, mean_terms double").write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Postings:
        documents, mean = spark.read.parquet(f"{path}/totals").first()
        return cls._of(spark.read.schema(f"{_ROW}, bucket int").parquet(f"{path}/rows"), documents, mean)

    def asked(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        """(query, hash, weight, most): each query's terms that some document has, times in the query times idf, and the
        most that they add to a score. A negative idf becomes EPSILON times the mean over the vocabulary."""

        def terms(batches):
            for batch in batches:
                hashes, bounds = identifier_hashes(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds)))), pa.array(hashes)], ["query", "hash"])

        ship(queries.sparkSession)
        own = queries.select(F.col(query).cast("long").alias("query"), F.col(text).cast("string").alias("text")).mapInArrow(terms, "query long, hash long")
        own = own.groupBy("query", "hash").agg(F.count(F.lit(1)).alias("times"))
        raw = F.log(F.lit(self.documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, EPSILON * self.mean_idf).otherwise(raw)
        return self.terms.join(own, "hash").select("query", "hash", (F.col("times") * idf).alias("weight"), F.greatest(F.col("times") * idf * F.col("top"), F.lit(0.0)).alias("most"))

    def top(self, queries: DataFrame, query: str, text: str, k: int, places: int = 6) -> DataFrame:
        """(query, doc, score, rank): the k best documents of each query, of those that share a term with it; ties go to the smaller id."""
        asked = cut(self.asked(queries, query, text))
        passes = max(1, -(-asked.count() // ASKED))
        block = F.pmod(F.xxhash64("query"), F.lit(passes))
        found = [Pass(self, asked if passes == 1 else asked.where(block == p), k, places).scores() for p in range(passes)]
        return top_k(reduce(DataFrame.unionByName, found), k, places)


class Pass:
    """A bounded part of a query set. Its terms are known to the driver and to every task."""

    def __init__(self, index: Postings, asked: DataFrame, k: int, places: int):
        held = asked.orderBy("query", "hash").toArrow()
        self.query, self.hash, self.weight, self.most = (held.column(c).to_numpy() for c in ("query", "hash", "weight", "most"))
        self.spark, self.k, self.places = asked.sparkSession, k, places
        #: A bound that is less than the threshold by no more than rounding does not count.
        self.margin = 2 * 10.0**-places
        wanted = self.spark.createDataFrame([(int(h),) for h in np.unique(self.hash)], "hash long")
        rows = index.rows
        if "bucket" in rows.columns:
            buckets = np.unique(self.hash >> 56).tolist()
            rows = rows.where(F.col("bucket").isin([*buckets, 128])).drop("bucket")
        self.rows = rows.join(F.broadcast(wanted), "hash", "left_semi")
        self.members = rows.where("hash is null")

    def terms(self, kept: np.ndarray, **more: np.ndarray) -> DataFrame:
        columns = {"query": self.query[kept], "hash": self.hash[kept], "weight": self.weight[kept]} | more
        return F.broadcast(self.spark.createDataFrame(pa.table(columns)))

    def bounds(self, terms: DataFrame) -> DataFrame:
        """(query, segment, bound, ...) from the maxima of some terms; other columns of `terms` are the query's."""
        more = [c for c in terms.columns if c not in ("query", "hash", "weight")]
        found = self.rows.select("hash", "segment", "top").join(terms, "hash")
        return found.groupBy("query", "segment").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"), *(F.max(c).alias(c) for c in more))

    def evaluated(self, pairs: DataFrame) -> DataFrame:
        """(query, doc, score): the k best documents of each pair of query and segment, by all terms."""
        query, term, weight, k, places = self.query, self.hash, self.weight, self.k, self.places

        def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
            empty = pa.table({"query": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            own = rows.filter(pa.compute.is_valid(rows.column("hash"))).sort_by("hash").combine_chunks()
            queries = np.sort(asked.column("query").to_numpy())
            if not own.num_rows or not len(queries):
                return empty
            docs = rows.filter(pa.compute.is_null(rows.column("hash"))).column("docs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            hashes, at, parts = own.column("hash").to_numpy(), own.column("at").combine_chunks(), own.column("parts").combine_chunks().flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(at).to_numpy())])
            at = at.flatten().to_numpy()
            place = np.minimum(np.searchsorted(hashes, term), len(hashes) - 1)
            column = np.minimum(np.searchsorted(queries, query), len(queries) - 1)
            kept = np.flatnonzero((hashes[place] == term) & (queries[column] == query))
            place, n = place[kept], np.diff(starts)[place[kept]]
            each = np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # postings of every term asked for
            cell = at[each] * len(queries) + np.repeat(column[kept], n)
            shape = (len(docs), len(queries))
            total = np.bincount(cell, parts[each] * np.repeat(weight[kept], n), minlength=shape[0] * shape[1]).reshape(shape)
            shared = np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape) > 0
            total = np.round(total, places)
            i, j = best(total, shared, docs, k)
            return pa.table({"query": queries[j], "doc": docs[i], "score": total[i, j]})

        pairs = pairs.select("query", F.col("segment").alias("chosen"))
        rows = self.rows.unionByName(self.members)
        rows = rows.join(pairs.select("chosen").distinct(), F.col("segment") == F.col("chosen"), "left_semi")
        ship(self.spark)
        return rows.groupBy("segment").cogroup(pairs.groupBy("chosen")).applyInArrow(score, "query long, doc long, score double")

    def seeds(self) -> DataFrame:
        """(query, segment): the most promising segments by the weightiest terms of each query."""
        order = np.lexsort([-self.most, self.query])
        rank = np.arange(len(order)) - np.searchsorted(self.query[order], self.query[order])
        found = self.bounds(self.terms(np.sort(order[rank < SEED_TERMS])))
        number = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "segment"))
        return found.withColumn("n", number).where(F.col("n") <= SEEDS).select("query", "segment")

    def thresholds(self) -> dict[int, float]:
        """A score that the k-th best document of a query has at least; none where too few were seen."""
        first = top_k(self.evaluated(cut(self.seeds())), self.k, self.places)
        found = first.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == self.k)
        return {r["query"]: r["least"] for r in found.collect()}  # a row for each query of the pass

    def segments(self) -> DataFrame:
        """(query, segment) of all segments that can hold one of the k best documents."""
        known = self.thresholds()
        least = np.array([known.get(q, 0.0) for q in self.query.tolist()]) - self.margin
        order = np.lexsort([self.most, self.query])  # the least weighty terms of each query first
        query, most = self.query[order], self.most[order]
        total = np.cumsum(most)
        upto = total - (total - most)[np.searchsorted(query, query)]  # what a term and all before it add at most
        followed = (upto >= least[order]) | (least[order] <= 0)
        rest = np.zeros(len(order))
        ends = np.append(np.flatnonzero(query[1:] != query[:-1]), len(query) - 1)
        starts = np.append(0, ends[:-1] + 1)
        for a, b in zip(starts, ends, strict=True):
            rest[a : b + 1] = np.sum(most[a : b + 1][~followed[a : b + 1]])
        kept = order[followed]
        found = self.bounds(self.terms(kept, rest=rest[followed], least=least[kept]))
        return found.where(F.col("bound") + F.col("rest") >= F.col("least")).select("query", "segment")

    def scores(self) -> DataFrame:
        if not len(self.query):
            return self.spark.createDataFrame([], "query long, doc long, score double")
        return self.evaluated(cut(self.segments()))
