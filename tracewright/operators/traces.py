"""Run-level metrics over execution traces.

A trace table has one row per executed step: ``run_id``, ``seq`` (file order), ``node_name``, ``outcome``,
``duration_ms``. Every metric is one keyed aggregation, so all runs are evaluated in a single scan with map-side
partial aggregation; ``seq`` is carried inside the aggregate instead of sorting the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUCCESS_NODES = ("patch_application", "fallback")
#: USD per million tokens by model (prompt, completion). Fixed values.
PRICES = {"llama-3.3-70b-versatile": (0.59, 0.79), "gemini-3.6-flash": (1.50, 7.50)}


def terminal_verdict(node: Column, outcome: Column, include_retry: bool = False) -> Column:
    """True for a success of a terminal node, false for an escalation, null for rows that settle nothing."""
    nodes = [*SUCCESS_NODES, "retry"] if include_retry else list(SUCCESS_NODES)
    return F.when(node == "escalate", F.lit(False)).when(node.isin(*nodes) & (outcome == "success"), F.lit(True))


def _passed(include_retry: bool) -> Column:
    verdict = terminal_verdict(F.col("node_name"), F.col("outcome"), include_retry)
    return F.min_by(verdict, F.when(verdict.isNotNull(), F.col("seq")))


def _retries(over_ms: float) -> tuple[Column, Column]:
    is_retry = F.col("node_name") == "retry"
    worked = F.coalesce(F.col("duration_ms") > over_ms, F.lit(False))
    return F.count_if(is_retry & worked), F.count_if(is_retry & ~worked)


def task_success(trace: DataFrame, include_retry: bool = False) -> DataFrame:
    """One row per run: ``passed`` of the first settling row in ``seq`` order; null where no row settles the run.

    A successful retry settles a run only with include_retry. Rows with a null ``seq`` cannot be ordered and settle
    nothing. A null run id is a run of its own.
    """
    return trace.groupBy("run_id").agg(_passed(include_retry).alias("passed"))


def retries(trace: DataFrame, over_ms: float = 0.0) -> DataFrame:
    """Per run: retry rows that took longer than over_ms, and the excluded ones (bookkeeping, or without a duration)."""
    count, excluded = _retries(over_ms)
    return trace.groupBy("run_id").agg(count.alias("retries"), excluded.alias("excluded"))


def latency(trace: DataFrame) -> DataFrame:
    """Per run: the sum of durations (0 where none), the number of rows, and how many have no duration."""
    return trace.groupBy("run_id").agg(
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("latency_ms"),
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col("duration_ms").isNull()).alias("no_duration"),
    )


def price_table(spark, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    rows = [(m, a, b) for m, (a, b) in (prices or PRICES).items()]
    return spark.createDataFrame(rows, "model string, usd_in double, usd_out double")


def cost(usage: DataFrame, prices: DataFrame, strict: bool = True) -> DataFrame:
    """Per run: USD over all usage rows. An unknown model is an error when strict, else its rows cost null and are counted.

    ``prices`` is a configuration table with a row per model; it is small by nature, and the optimizer sees its size.
    """
    priced = usage.join(prices, "model", "left")
    usd = F.col("prompt_tokens") / 1e6 * F.col("usd_in") + F.col("completion_tokens") / 1e6 * F.col("usd_out")
    if strict:
        usd = F.when(F.col("usd_in").isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model", F.lit("null")))).cast("double")).otherwise(usd)
    return priced.groupBy("run_id").agg(F.coalesce(F.sum(usd), F.lit(0.0)).alias("usd"), F.count_if(F.col("usd_in").isNull()).alias("unpriced"))


def scorecard(trace: DataFrame, usage: DataFrame, prices: DataFrame, runs: DataFrame | None = None, include_retry: bool = False, over_ms: float = 0.0) -> DataFrame:
    """All metrics of every run in one row; runs without rows keep a null verdict and zeros.

    The trace metrics share one aggregation; trace, usage and runs meet on the same key, so each is shuffled once.
    """
    count, _ = _retries(over_ms)
    own = trace.groupBy("run_id").agg(_passed(include_retry).alias("passed"), count.alias("retries"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("latency_ms"))
    spent = cost(usage, prices).select("run_id", "usd")
    base = runs.select("run_id").distinct() if runs is not None else own.select("run_id")
    out = base.join(own, "run_id", "left").join(spent, "run_id", "left")
    return out.select("run_id", "passed", F.coalesce("retries", F.lit(0)).alias("retries"), F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), F.coalesce("usd", F.lit(0.0)).alias("usd"))


def terminal_state(trace: DataFrame) -> DataFrame:
    """Per run: how it ended — applied, escalated, not_actionable or open."""
    verdict = _passed(include_retry=True)
    stopped = F.bool_or((F.col("node_name") == "classify") & (F.col("outcome") == "not_actionable"))
    return trace.groupBy("run_id").agg(F.when(verdict, "applied").when(~verdict, "escalated").when(stopped, "not_actionable").otherwise("open").alias("state"))


def attempt_numbers(trace: DataFrame) -> DataFrame:
    """Retry rows with their number within the run, from 1, in ``seq`` order."""
    return trace.where(F.col("node_name") == "retry").withColumn("attempt", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))
