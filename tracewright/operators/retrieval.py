"""Hybrid retrieval from scores: cosine of a row, equal-weight fusion, pool and final top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B, EPSILON = 1.5, 0.75, 0.25
POOL, FINAL, PATH_BOOST, EMBED_CHARS = 20, 5, 0.25, 6000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """A vector of length 1 in the same direction; a zero vector stays."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors in a row, in double precision; 0 where a side is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def min_max(scores: DataFrame, *columns: str) -> DataFrame:
    """Each column per query to 0..1; 0 where all scores of a query are about equal.

    Least and greatest values are aggregated, a row for each query, and joined back: no query is gathered in one task.
    """
    limits = scores.groupBy("query").agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))))
    low, high = (lambda c: F.col(f"__low_{c}")), (lambda c: F.col(f"__high_{c}"))
    out = scores.join(limits, "query")
    unit = {c: F.when(high(c) - low(c) < 1e-9, 0.0).otherwise((F.col(c) - low(c)) / (high(c) - low(c))) for c in columns}
    return out.withColumns(unit).select(*scores.columns)


def fuse(lexical: DataFrame, dense: DataFrame, boosted: DataFrame | None = None) -> DataFrame:
    """(query, doc, score): both scores normalised per query and added; a score that a document lacks is 0 before that.

    Documents of either side are candidates. boosted (query, doc) get the path boost. For scores that exist already; over
    whole tables search.hybrid_top does the same without a row for each query and document.
    """
    both = dense.withColumnRenamed("score", "dense").join(lexical.withColumnRenamed("score", "lexical"), ["query", "doc"], "full").fillna(0.0, ["dense", "lexical"])
    out = min_max(both, "dense", "lexical").select("query", "doc", (F.col("dense") + F.col("lexical")).alias("score"))
    if boosted is None:
        return out
    marked = out.join(boosted.select("query", "doc").distinct().withColumn("__boost", F.lit(PATH_BOOST)), ["query", "doc"], "left")
    return marked.select("query", "doc", (F.col("score") + F.coalesce("__boost", F.lit(0.0))).alias("score"))


def top_k(scores: DataFrame, k: int, places: int = 6) -> DataFrame:
    """The k best of each query with rank; scores are rounded first and ties go to the smaller id.

    The rank filter becomes a group limit, so tasks send k rows of each query to the shuffle at most.
    """
    rounded = scores.withColumn("score", F.round("score", places))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(lexical: DataFrame, dense: DataFrame, rerank: DataFrame, boosted: DataFrame | None = None, pool: int = POOL, k: int = FINAL) -> DataFrame:
    """Pool by fused score, then the k best by a rerank score (query, doc, score) that a model supplies; 0 where it has none."""
    pooled = top_k(fuse(lexical, dense, boosted), pool).select("query", "doc")
    return top_k(pooled.join(rerank, ["query", "doc"], "left").fillna(0.0, ["score"]), k)
