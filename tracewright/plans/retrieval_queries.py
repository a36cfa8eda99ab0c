"""Lexical and dense retrieval: benchmark items query the documents, some vectors query all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import retrieval, search
from tracewright.plans import query
from tracewright.plans.trace_queries import table

def bm25_of(documents: str, queries: str) -> str:
    """CTEs up to score (query, doc, score): BM25 of documents (doc_id, text) for queries (item_id, text)."""
    return f"""
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*') AS w FROM ({documents})),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w))::DOUBLE AS mean_len FROM tok),
post AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, stats GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS query, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*')) AS term FROM ({queries})) GROUP BY ALL),
score AS (SELECT query, doc_id AS doc, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_len))) AS score FROM q JOIN idf USING (term) JOIN post USING (term), stats GROUP BY ALL)
"""


_BM25 = bm25_of("SELECT * FROM documents", "SELECT * FROM benchmark")
_COS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
cosines AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_inner_product(a.e, b.e) / (a.n * b.n) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
"""


def top_of(source, k, places):
    return f"SELECT query, doc, score, rank::INT AS rank FROM (SELECT query, doc, round(score, {places}) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, {places}) DESC, doc) AS rank FROM {source}) WHERE rank <= {k}"


@query("bm25_topk", f"WITH {_BM25} {top_of('score', 20, 6)}")
def bm25_topk(spark, sf_dir):
    return search.lexical_top(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 20)


@query("cosine_topk", f"WITH {_COS} {top_of('cosines', 20, 5)}")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.dense_top(e, "vec_id", "embedding", e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 20, places=5)


_FUSED = f"""
{_BM25}, {_COS},
asked AS (SELECT item_id AS query FROM benchmark WHERE item_id % 50 = 0 AND item_id IN (SELECT vec_id FROM embeddings)),
every AS (SELECT doc_id AS doc FROM documents UNION SELECT vec_id FROM embeddings),
both2 AS (SELECT query, doc, coalesce(c.score, 0) AS d, coalesce(l.score, 0) AS l FROM (SELECT * FROM asked, every) x LEFT JOIN cosines c USING (query, doc) LEFT JOIN score l USING (query, doc)),
mm AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(l) OVER w AS l0, max(l) OVER w AS l1 FROM both2 WINDOW w AS (PARTITION BY query)),
fused AS (SELECT query, doc, CASE WHEN d1 - d0 < 1e-9 THEN 0 ELSE (d - d0) / (d1 - d0) END + CASE WHEN l1 - l0 < 1e-9 THEN 0 ELSE (l - l0) / (l1 - l0) END + CASE WHEN doc % 10 = 0 THEN 0.25 ELSE 0 END AS score FROM mm)
"""


def fused(spark, sf_dir, k, places):
    """Items with a vector ask. Documents with ids divisible by ten stand for those whose path was named; documents
    without a vector take part with their text."""
    e = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", F.when(F.col("doc_id") % 10 == 0, "named.py").alias("path"))
    vectors = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = vectors.where(F.col("doc") % 50 == 0).withColumnRenamed("doc", "query")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", F.array(F.lit("named.py")).alias("paths"))
    return search.hybrid_top(docs, vectors, items.join(asked, "query"), k, places)


@query("hybrid_topk", f"WITH {_FUSED} {top_of('fused', 20, 5)}")
def hybrid_topk(spark, sf_dir):
    return fused(spark, sf_dir, 20, 5).select("query", "doc", "score", "rank")


@query("retrieve_rerank", f"WITH {_FUSED}, pool AS ({top_of('fused', 20, 6)}), again AS (SELECT query, doc, d AS score FROM both2 JOIN pool USING (query, doc)) {top_of('again', 5, 6)}")
def retrieve_rerank(spark, sf_dir):
    pool = fused(spark, sf_dir, retrieval.POOL, 6)
    return retrieval.top_k(pool.select("query", "doc", F.col("dense").alias("score")), retrieval.FINAL)
