"""Ordered decisions over failure reasons, and checks of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CATEGORIES = ("bug", "feature_request", "documentation", "question", "other")
ACTIONABLE = ("bug", "documentation")
INFRASTRUCTURE = ("dirty_worktree", "rollback_failed", "io_error")
RETRYABLE = ("malformed_edit", "io_error", "stale_chunks")
MOST_ATTEMPTS = 3
EDIT_KEYS = ("chunk_id", "file_path", "old_source", "new_source")


def _otherwise(strict: bool, message: Column) -> Column:
    return F.raise_error(message).cast("string") if strict else F.lit("unrecognized")


def escalation_category(reason: Column, outcome: Column, strict: bool = False) -> Column:
    """What kind of escalation a failure is; where no rule holds an error when strict, else `unrecognized`."""
    return (
        F.when(reason == "unsafe_pattern_detected", "guardrail_trip")
        .when(reason.isin(*INFRASTRUCTURE), "infra_failure")
        .when(outcome == "fallback_failed", "capability_exhausted")
        .otherwise(_otherwise(strict, F.concat(F.lit("unrecognized escalation state: "), F.coalesce(reason, F.lit("null")), F.lit(", "), F.coalesce(outcome, F.lit("null")))))
    )


def retry_route(reason: Column, attempt: Column) -> Column:
    """What to do after a failure at an attempt number; stale code is retrieved anew before another attempt."""
    return (
        F.when(reason == "api_error", "provider_error")
        .when(~F.coalesce(reason.isin(*RETRYABLE), F.lit(False)), "not_retryable")
        .when(attempt > MOST_ATTEMPTS, "retry_exhausted")
        .when(reason == "stale_chunks", "attempt_fresh_retrieval")
        .otherwise("attempt")
    )


def resolve_outcome(reason: Column, insufficient: Column) -> Column:
    return F.when(reason.isNotNull(), "failure").when(F.coalesce(insufficient, F.lit(False)), "insufficient_context").otherwise("success")


def as_category(value: Column, strict: bool = False) -> Column:
    """A known category; otherwise an error when strict, else null."""
    known = F.when(value.isin(*CATEGORIES), value)
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(value, F.lit("null")))).cast("string")) if strict else known


def is_actionable(category: Column) -> Column:
    return F.coalesce(category.isin(*ACTIONABLE), F.lit(False))


def missing_edit_keys(present: Column) -> Column:
    """Required keys that an edit lacks, sorted; `present` is an array of the keys it has."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, EDIT_KEYS)), present))


def enforce_contract(responses: DataFrame) -> DataFrame:
    """Responses (edits, insufficient_context, follow_up_query, chunk_ids) made consistent.

    An edit of an unknown chunk fails the whole response; insufficient context leaves no edits; no edits mean
    insufficient context; an empty follow-up query is null.
    """
    edits = F.coalesce("edits", F.array().cast(responses.schema["edits"].dataType))
    unknown = F.exists(edits, lambda e: ~F.coalesce(F.array_contains(F.col("chunk_ids"), e["chunk_id"]), F.lit(False)))
    insufficient = F.coalesce("insufficient_context", F.lit(False)) | (F.size(edits) == 0)
    nothing = F.array().cast(responses.schema["edits"].dataType)
    return responses.withColumns({
        "failure_reason": F.when(unknown & ~F.coalesce("insufficient_context", F.lit(False)), F.lit("malformed_edit")),
        "insufficient_context": insufficient | unknown,
        "follow_up_query": F.when(F.trim("follow_up_query") != "", F.col("follow_up_query")),
        "edits": F.when(insufficient | unknown, nothing).otherwise(edits),
    })


def run_outcomes(runs: DataFrame, attempts: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Per run: outcome (not_actionable, applied, escalated, open), attempts_used, fallback_triggered and escalation.

    runs: run_id, is_actionable. attempts: run_id, attempt (0 is the first pass), applied, failure_reason. fallbacks: run_id,
    applied, failure_reason. The first attempt that is applied, or that is not tried again, settles a run; failures of the
    provider and of all tries go to the fallback, others to escalation. Rows behind that one do not count; a run without it
    is open, as is one whose fallback has no row.
    """
    route = F.when(F.col("applied"), "applied").otherwise(retry_route(F.col("failure_reason"), F.col("attempt") + 1))
    steps = attempts.select("run_id", "attempt", "failure_reason", route.alias("route")).where(~F.col("route").startswith("attempt"))
    first = steps.groupBy("run_id").agg(F.min_by(F.struct("route", "failure_reason", "attempt"), "attempt").alias("s"))
    out = runs.join(first, "run_id", "left").join(fallbacks.select("run_id", F.col("applied").alias("__fixed"), F.col("failure_reason").alias("__why")), "run_id", "left")
    runs_on, settled = F.coalesce("is_actionable", F.lit(False)), F.col("s.route")
    falls = F.coalesce(settled.isin("provider_error", "retry_exhausted"), F.lit(False))
    outcome = (
        F.when(~runs_on, "not_actionable").when(settled == "applied", "applied").when(settled == "not_retryable", "escalated")
        .when(falls & F.col("__fixed"), "applied").when(falls & ~F.col("__fixed"), "escalated").otherwise("open")
    )
    escalation = F.when(falls, escalation_category(F.col("__why"), F.lit("fallback_failed"))).otherwise(escalation_category(F.col("s.failure_reason"), settled))
    out = out.withColumn("outcome", outcome)
    return out.select("run_id", "outcome", F.when(runs_on & (settled == "applied"), F.col("s.attempt").cast("int")).alias("attempts_used"), (runs_on & falls).alias("fallback_triggered"), F.when(F.col("outcome") == "escalated", escalation).alias("escalation"))
