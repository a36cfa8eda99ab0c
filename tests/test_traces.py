import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import routing, traces
from tracewright.sources import trace_log

# run -> node/outcome(duration) in file order, task_success, retries, latency
RUNS = {
    "r1": ([("classify", "success", 100), ("retrieve", "success", 50), ("resolve", "success", 900), ("patch_application", "success", 20)], True, 0, 1070),
    "r2": ([("classify", "success", 100), ("retrieve", "success", 50), ("resolve", "success", 800), ("patch_application", "failure", 10), ("retry", "success", 700)], None, 1, 1660),
    "r3": ([("patch_application", "failure", 10), ("retry", "failure", 600), ("retry", "failure", 500), ("retry", "failure", 400), ("retry", "failure", 0), ("fallback", "success", 900)], True, 3, 2410),
    "r3b": ([("patch_application", "failure", 10), ("retry", "failure", 600), ("retry", "failure", 500), ("retry", "failure", 400), ("retry", "failure", 0.004), ("fallback", "success", 900)], True, 4, 2410.004),
    "r4": ([("patch_application", "failure", 10), ("retry", "failure", 0.01), ("escalate", "success", 5)], False, 1, 15.01),
    "r5": ([("classify", "success", 100)], None, 0, 100),
    "r6": ([("escalate", "success", 1), ("fallback", "success", 1)], False, 0, 2),
    "r7": ([("fallback", "success", 1), ("escalate", "success", 1)], True, 0, 2),
    "r8": ([("fallback", "failure", 1)], None, 0, 1),
}
TRACE = "run_id string, seq long, node_name string, outcome string, duration_ms double"
USAGE = "run_id string, model string, prompt_tokens long, completion_tokens long"


def trace(spark):
    rows = [(r, i, n, o, float(d)) for r, (steps, *_) in RUNS.items() for i, (n, o, d) in enumerate(steps)]
    return spark.createDataFrame(rows, TRACE).orderBy(F.rand(1))  # file order is in seq only


def test_metrics_by_hand(spark):
    t = trace(spark)
    passed = dict(traces.task_success(t).collect())
    assert passed == {r: v for r, (_, v, _, _) in RUNS.items()}
    assert {r["run_id"]: r["retries"] for r in traces.retries(t).collect()} == {r: n for r, (_, _, n, _) in RUNS.items()}
    assert {r["run_id"]: pytest.approx(r["latency_ms"]) for r in traces.latency(t).collect()} == {r: n for r, (_, _, _, n) in RUNS.items()}


def test_options(spark):
    t = trace(spark)
    assert dict(traces.task_success(t, include_retry=True).collect())["r2"] is True
    assert {r["run_id"]: r["retries"] for r in traces.retries(t, over_ms=1).collect()}["r3b"] == 3
    assert dict(traces.terminal_state(t).collect())["r5"] == "open"
    assert [r["attempt"] for r in traces.attempt_numbers(t).where("run_id = 'r3'").orderBy("seq").collect()] == [1, 2, 3, 4]


def test_cost(spark):
    usage = spark.createDataFrame([("a", "llama-3.3-70b-versatile", 10**6, 5 * 10**5), ("b", "llama-3.3-70b-versatile", 10**5, 10**4), ("b", "gemini-3.6-flash", 2 * 10**5, 2 * 10**4)], USAGE)
    prices = traces.price_table(spark)
    assert {r["run_id"]: pytest.approx(r["usd"]) for r in traces.cost(usage, prices).collect()} == {"a": 0.985, "b": 0.5169}
    unknown = usage.withColumn("model", F.lit("unknown"))
    with pytest.raises(Exception, match="no price"):
        traces.cost(unknown, prices).collect()
    assert {r["unpriced"] for r in traces.cost(unknown, prices, strict=False).collect()} == {1, 2}


def test_scorecard_keeps_runs_without_rows(spark):
    runs = spark.createDataFrame([("r1",), ("r9",)], "run_id string")
    usage = spark.createDataFrame([], USAGE)
    got = {r["run_id"]: tuple(r)[1:] for r in traces.scorecard(trace(spark), usage, traces.price_table(spark), runs).collect()}
    assert got == {"r1": (True, 0, 1070.0, 0.0), "r9": (None, 0, 0.0, 0.0)}


def test_routing(spark):
    cases = [
        ("unsafe_pattern_detected", "fallback_failed", "guardrail_trip"), ("io_error", "fallback_failed", "infra_failure"), ("dirty_worktree", "not_retryable", "infra_failure"),
        (None, "fallback_failed", "capability_exhausted"), ("malformed_edit", "fallback_failed", "capability_exhausted"), ("insufficient_context", "not_retryable", "unrecognized"), ("reset_failed", "not_retryable", "unrecognized"),
    ]
    frame = spark.createDataFrame(cases, "reason string, outcome string, want string")
    assert all(r["want"] == r["got"] for r in frame.withColumn("got", routing.escalation_category(F.col("reason"), F.col("outcome"))).collect())
    with pytest.raises(Exception, match="unrecognized escalation state"):
        frame.select(routing.escalation_category(F.col("reason"), F.col("outcome"), strict=True)).collect()
    routes = spark.createDataFrame([("api_error", 9, "provider_error"), ("dirty_worktree", 9, "not_retryable"), ("malformed_edit", 3, "attempt"), ("malformed_edit", 4, "retry_exhausted"), ("stale_chunks", 1, "attempt_fresh_retrieval"), (None, 1, "not_retryable")], "reason string, attempt int, want string")
    assert all(r["want"] == r["got"] for r in routes.withColumn("got", routing.retry_route(F.col("reason"), F.col("attempt"))).collect())


def test_a_run_over_rotated_files_has_one_order(spark, tmp_path):
    """The first file by time is the last by name and holds the longer lines; listing order does not matter."""
    row = lambda at, run, node, outcome, pad="": json.dumps({"timestamp": at, "node_name": node, "run_id": run, "outcome": outcome, "source_id": pad})
    (tmp_path / "log.9.jsonl").write_text("\n".join(["", row("2024-01-01T00:00:05+02:00", "x", "resolve", "success", "p" * 500), row("2024-01-01T00:00:06+02:00", "r", "escalate", "failure"), row("2024-01-01T01:00:00+02:00", "q", "patch_application", "success")]))
    (tmp_path / "log.1.jsonl").write_text("\n".join([row("2023-12-31T23:30:00+00:00", "r", "patch_application", "success"), row(None, "q", "escalate", "failure")]))
    (tmp_path / "log.0.jsonl").write_text(row(None, "late", "patch_application", "success") + "\n" + row("no time", "r", "patch_application", "success"))
    log = trace_log.one_order(trace_log.read_json_lines(spark, str(tmp_path), trace_log.PIPELINE_LOG))
    assert {r["run_id"]: r["passed"] for r in traces.task_success(log).collect()} == {"x": None, "r": False, "q": True, "late": True}
    assert [r["outcome"] for r in trace_log.rows_of_run(log, "r").collect()] == ["failure", "success", "success"]
    assert log.columns == trace_log.read_json_lines(spark, str(tmp_path), trace_log.PIPELINE_LOG).columns
