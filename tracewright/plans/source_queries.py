"""Collected records, what is left to collect, dead letters, replaced rows, and outcomes of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import routing
from tracewright.plans import query
from tracewright.plans.trace_queries import table
from tracewright.sources import issues, sinks


def raw_issues(spark, sf_dir):
    """Documents as raw issues; two thirds name another issue, half of them a merged one."""
    n = F.col("doc_id")
    merged = F.struct(F.when(n % 2 == 0, "2024-01-01").alias("merged_at"))
    event = F.struct(F.when(n % 3 < 2, "cross-referenced").otherwise("closed").alias("event"), F.struct(F.struct((n + 1000).alias("number"), merged.alias("pull_request")).alias("issue")).alias("source"))
    comment = F.struct(F.struct(F.when(n % 5 > 0, F.col("lang")).alias("login")).alias("user"), F.col("text").alias("body"), F.lit(None).cast("string").alias("created_at"))
    return table(spark, sf_dir, "documents").select(
        n.alias("number"), F.when(n % 7 > 0, F.col("source")).alias("title"), F.col("text").alias("body"), F.lit(None).cast("string").alias("state"), F.array(F.struct(F.col("lang").alias("name"))).alias("labels"),
        F.lit("2023").alias("created_at"), F.lit("2024").alias("closed_at"), F.lit(None).cast("string").alias("html_url"), (F.col("n_chars") % 1000).alias("updated_at"),
        F.when(n % 10 == 0, F.struct(F.lit("u").alias("url"))).alias("pull_request"), F.array(event).alias("timeline"), F.when(n % 4 > 0, F.array(comment)).alias("comments"),
    )


@query(
    "issue_normalize",
    """
    SELECT doc_id::VARCHAR AS source_id, CASE WHEN doc_id % 7 > 0 THEN coalesce(source, '') ELSE '' END AS title, coalesce(text, '') AS body, 'closed' AS state, lang AS labels, (doc_id + 1000)::VARCHAR AS linked_fix_id,
           'https://github.com/o/r/pull/' || (doc_id + 1000) || '.diff' AS linked_fix_diff_url, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'unknown' END ELSE '' END AS authors
    FROM documents WHERE doc_id % 3 < 2 AND doc_id % 2 = 0
    """,
)
def issue_normalize(spark, sf_dir):
    found = issues.normalize(raw_issues(spark, sf_dir), "github", "o/r")
    return found.select("source_id", "title", "body", "state", F.array_join("labels", "|").alias("labels"), "linked_fix_id", "linked_fix_diff_url", F.array_join("comments.author", "|").alias("authors"))


@query("not_collected", "SELECT doc_id AS number FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars % 1000 DESC, doc_id LIMIT 50")
def not_collected(spark, sf_dir):
    """The limit is the collection's own: the most recently updated issues that are not done."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("source_id"))
    return issues.not_collected(raw_issues(spark, sf_dir), done, 50).select("number")


@query("dead_letters", "SELECT event_id, CASE WHEN value > 10 THEN 'too much' END AS error, value > 10 AS dead FROM events")
def dead_letters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 10, "too much").alias("error"))
    good, bad = sinks.dead_letters(rows)
    return good.select("event_id", F.lit(None).cast("string").alias("error"), F.lit(False).alias("dead")).unionByName(bad.withColumn("dead", F.lit(True)))


@query("keyed_upsert", "SELECT doc_id, coalesce(quality, -1)::INT AS quality, quality IS NOT NULL AS is_new FROM documents LEFT JOIN labels USING (doc_id)")
def keyed_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(False).alias("is_new"))
    return sinks.keyed_upsert(old, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.lit(True).alias("is_new")), "doc_id")


_KIND = "CASE l_returnflag WHEN 'A' THEN 'malformed_edit' WHEN 'R' THEN 'stale_chunks' ELSE CASE WHEN l_linestatus = 'O' THEN 'api_error' ELSE 'unsafe_pattern_detected' END END"


@query(
    "run_outcomes",
    f"""
    WITH a AS (SELECT l_orderkey AS r, l_linenumber - 1 AS n, bool_or(l_quantity > 45) AS ok, min({_KIND}) AS reason FROM lineitem GROUP BY ALL),
    s AS (SELECT *, CASE WHEN ok THEN 'applied' WHEN reason = 'api_error' THEN 'provider_error' WHEN reason = 'unsafe_pattern_detected' THEN 'not_retryable' WHEN n + 1 > 3 THEN 'retry_exhausted' END AS step FROM a),
    d AS (SELECT r, arg_min(step, n) AS step, arg_min(reason, n) AS reason, min(n) AS n FROM s WHERE step IS NOT NULL GROUP BY r),
    o AS (SELECT o_orderkey AS run_id, o_orderstatus = 'P' AS off, o_orderpriority LIKE '1%' AS fixed, step, reason, n FROM orders LEFT JOIN d ON r = o_orderkey)
    SELECT run_id, CASE WHEN off THEN 'not_actionable' WHEN step IS NULL THEN 'open' WHEN step = 'applied' THEN 'applied' WHEN step = 'not_retryable' THEN 'escalated' WHEN fixed THEN 'applied' ELSE 'escalated' END AS outcome,
           CASE WHEN NOT off AND step = 'applied' THEN n END::INT AS attempts_used, NOT off AND coalesce(step IN ('provider_error', 'retry_exhausted'), false) AS fallback_triggered,
           CASE WHEN off OR step IS NULL OR step = 'applied' THEN NULL WHEN step = 'not_retryable' THEN 'guardrail_trip' WHEN NOT fixed THEN 'capability_exhausted' END AS escalation FROM o
    """,
)
def run_outcomes(spark, sf_dir):
    """Orders are runs and the numbers of their items attempts."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") != "P").alias("is_actionable"))
    fallbacks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").startswith("1").alias("applied"), F.lit("malformed_edit").alias("failure_reason"))
    flag = F.col("l_returnflag")
    reason = F.when(flag == "A", "malformed_edit").when(flag == "R", "stale_chunks").otherwise(F.when(F.col("l_linestatus") == "O", "api_error").otherwise("unsafe_pattern_detected"))
    attempts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") - 1).alias("attempt")).agg(F.bool_or(F.col("l_quantity") > 45).alias("applied"), F.min(reason).alias("failure_reason"))
    return routing.run_outcomes(runs, attempts, fallbacks)
