"""Trace metrics over the events table: run = user, order = event id, node and outcome from the event type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.operators import routing, traces
from tracewright.plans import query
from tracewright.sources import trace_log


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_of_events(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "patch_application").when(kind == "error", "escalate").when(kind == "signup", "retry").otherwise("resolve").alias("node_name"),
        F.when(kind.isin("purchase", "signup"), "success").otherwise("failure").alias("outcome"),
        (F.col("value") - 10.0).alias("duration_ms"),
    )


def usage_of_events(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "view", "llama-3.3-70b-versatile").otherwise("gemini-3.6-flash").alias("model"),
        F.floor(F.col("value") * 100).alias("prompt_tokens"),
        (F.col("event_id") % 997).alias("completion_tokens"),
    )


VERDICT = "arg_min(event_type = 'purchase', event_id) FILTER (WHERE event_type IN ('purchase', 'error'))"
COST = """
SELECT user_id AS run_id, round(sum(CASE event_type WHEN 'view' THEN floor(value * 100) / 1e6 * 0.59 + (event_id % 997) / 1e6 * 0.79
                                                    ELSE floor(value * 100) / 1e6 * 1.50 + (event_id % 997) / 1e6 * 7.50 END), 9) AS usd
FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id
"""


@query("task_success", f"SELECT user_id AS run_id, {VERDICT} AS passed FROM events GROUP BY user_id")
def task_success(spark, sf_dir):
    return traces.task_success(trace_of_events(spark, sf_dir))


@query(
    "task_success_rotated",
    """
    WITH e AS (SELECT *, 'log.' || (31 - day(ts)) AS file, row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) AS place FROM events), f AS (SELECT file, min(ts) AS began FROM e GROUP BY file)
    SELECT user_id AS run_id, arg_min(event_type = 'purchase', (began, file, place)) FILTER (WHERE event_type IN ('purchase', 'error')) AS passed FROM e JOIN f USING (file) GROUP BY user_id
    """,
)
def task_success_rotated(spark, sf_dir):
    """A file for each day, the last with the smallest number, as rotation names them; rows count anew in each."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy(F.day("ts")).orderBy("ts", "event_id"))
    own = e.select("event_id", F.concat(F.lit("log."), (31 - F.day("ts")).cast("string")).alias("file"), place.alias("place"), F.col("ts").cast("string").alias("timestamp"))
    log = trace_of_events(spark, sf_dir).withColumnRenamed("seq", "event_id").join(own, "event_id").withColumnRenamed("place", "seq")
    return traces.task_success(trace_log.one_order(log))


@query("task_success_with_retry", "SELECT user_id AS run_id, arg_min(event_type IN ('purchase', 'signup'), event_id) FILTER (WHERE event_type IN ('purchase', 'error', 'signup')) AS passed FROM events GROUP BY user_id")
def task_success_with_retry(spark, sf_dir):
    return traces.task_success(trace_of_events(spark, sf_dir), include_retry=True)


@query("retries", "SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'signup' AND value - 10 > 0) AS retries, count(*) FILTER (WHERE event_type = 'signup' AND NOT value - 10 > 0) AS excluded FROM events GROUP BY user_id")
def retries(spark, sf_dir):
    return traces.retries(trace_of_events(spark, sf_dir))


@query("latency", "SELECT user_id AS run_id, round(sum(value - 10.0), 6) AS latency_ms, count(*) AS steps, count(*) FILTER (WHERE value IS NULL) AS no_duration FROM events GROUP BY user_id")
def latency(spark, sf_dir):
    return traces.latency(trace_of_events(spark, sf_dir)).withColumn("latency_ms", F.round("latency_ms", 6))


@query("cost", COST)
def cost(spark, sf_dir):
    return traces.cost(usage_of_events(spark, sf_dir), traces.price_table(spark)).select("run_id", F.round("usd", 9).alias("usd"))


@query(
    "run_scorecard",
    f"""
    WITH t AS (SELECT user_id AS run_id, {VERDICT} AS passed, count(*) FILTER (WHERE event_type = 'signup' AND value - 10 > 0) AS retries, round(sum(value - 10.0), 6) AS latency_ms FROM events GROUP BY user_id),
    c AS ({COST}), r AS (SELECT DISTINCT c_custkey AS run_id FROM customer)
    SELECT r.run_id, passed, coalesce(retries, 0)::BIGINT AS retries, coalesce(latency_ms, 0.0)::DOUBLE AS latency_ms, coalesce(usd, 0.0)::DOUBLE AS usd FROM r LEFT JOIN t USING (run_id) LEFT JOIN c USING (run_id)
    """,
)
def run_scorecard(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    out = traces.scorecard(trace_of_events(spark, sf_dir), usage_of_events(spark, sf_dir), traces.price_table(spark), runs)
    return out.withColumns({"latency_ms": F.round("latency_ms", 6), "usd": F.round("usd", 9)})


@query("terminal_state", "SELECT user_id AS run_id, CASE arg_min(event_type IN ('purchase', 'signup'), event_id) FILTER (WHERE event_type IN ('purchase', 'error', 'signup')) WHEN true THEN 'applied' WHEN false THEN 'escalated' ELSE 'open' END AS state FROM events GROUP BY user_id")
def terminal_state(spark, sf_dir):
    return traces.terminal_state(trace_of_events(spark, sf_dir))


@query("attempt_numbers", "SELECT user_id AS run_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS attempt FROM events WHERE event_type = 'signup'")
def attempt_numbers(spark, sf_dir):
    return traces.attempt_numbers(trace_of_events(spark, sf_dir)).select("run_id", "seq", "attempt")


REASONS = {"click": "unsafe_pattern_detected", "error": "io_error", "purchase": "malformed_edit", "signup": "api_error"}
REASON_SQL = "CASE event_type WHEN 'click' THEN 'unsafe_pattern_detected' WHEN 'error' THEN 'io_error' WHEN 'purchase' THEN 'malformed_edit' WHEN 'signup' THEN 'api_error' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'stale_chunks' END END"


def failures(spark, sf_dir):
    reason = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_type") == "view", "stale_chunks"))
    for kind, name in REASONS.items():
        reason = F.when(F.col("event_type") == kind, name).otherwise(reason)
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"), F.when(F.col("event_id") % 2 == 0, "fallback_failed").otherwise("not_retryable").alias("outcome"), (F.col("event_id") % 5 + 1).alias("attempt"))


@query(
    "escalation_category",
    f"""
    WITH f AS (SELECT event_id, {REASON_SQL} AS reason, event_id % 2 = 0 AS fell FROM events)
    SELECT event_id, CASE WHEN reason = 'unsafe_pattern_detected' THEN 'guardrail_trip' WHEN reason = 'io_error' THEN 'infra_failure' WHEN fell THEN 'capability_exhausted' ELSE 'unrecognized' END AS category FROM f
    """,
)
def escalation_category(spark, sf_dir):
    return failures(spark, sf_dir).select("event_id", routing.escalation_category(F.col("reason"), F.col("outcome")).alias("category"))


@query(
    "retry_route",
    f"""
    WITH f AS (SELECT event_id, {REASON_SQL} AS reason, event_id % 5 + 1 AS attempt FROM events)
    SELECT event_id, CASE WHEN reason = 'api_error' THEN 'provider_error' WHEN reason IS NULL OR reason NOT IN ('malformed_edit', 'io_error', 'stale_chunks') THEN 'not_retryable'
                          WHEN attempt > 3 THEN 'retry_exhausted' WHEN reason = 'stale_chunks' THEN 'attempt_fresh_retrieval' ELSE 'attempt' END AS route FROM f
    """,
)
def retry_route(spark, sf_dir):
    return failures(spark, sf_dir).select("event_id", routing.retry_route(F.col("reason"), F.col("attempt")).alias("route"))


@query("resolve_outcome", f"WITH f AS (SELECT event_id, {REASON_SQL} AS reason FROM events) SELECT event_id, CASE WHEN reason IS NOT NULL THEN 'failure' WHEN event_id % 7 = 0 THEN 'insufficient_context' ELSE 'success' END AS outcome FROM f")
def resolve_outcome(spark, sf_dir):
    return failures(spark, sf_dir).select("event_id", routing.resolve_outcome(F.col("reason"), F.col("event_id") % 7 == 0).alias("outcome"))


@query("actionable", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'bug' WHEN 1 THEN 'documentation' WHEN 2 THEN 'question' WHEN 3 THEN 'other' WHEN 4 THEN 'feature_request' END AS category, doc_id % 6 IN (0, 1) AS is_actionable FROM documents")
def actionable(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("bug", "documentation", "question", "other", "feature_request", "nonsense"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", routing.as_category(raw).alias("category"), routing.is_actionable(raw).alias("is_actionable"))
