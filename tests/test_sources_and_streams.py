import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import joins, retrieval, traces
from tracewright.plans.trace_queries import trace_of_events
from tracewright.sources import code_files, issues, sinks, trace_log
from tracewright.streaming import trace_stream

DATA = "/root/testdata/sf0.001"


def test_json_lines_keep_order(spark, tmp_path):
    rows = [{"run_id": "a", "node_name": n, "outcome": "success", "duration_ms": 1.5} for n in ("classify", "fallback", "escalate")]
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(rows[0]), "", json.dumps(rows[1]), "  ", json.dumps(rows[2]), ""]))
    log = trace_log.read_json_lines(spark, str(tmp_path / "log.jsonl"), trace_log.PIPELINE_LOG)
    assert [r["node_name"] for r in trace_log.rows_of_run(log, "a").collect()] == ["classify", "fallback", "escalate"]
    assert traces.task_success(log).first()["passed"] is True
    assert trace_log.read_json_lines(spark, str(tmp_path / "none.jsonl"), trace_log.PIPELINE_LOG).count() == 0


def test_issue_records(spark):
    raw = [
        json.dumps({"number": 1, "title": None, "labels": [{"name": "bug"}], "timeline": [{"event": "cross-referenced", "source": {"issue": {"number": 7, "pull_request": {"merged_at": "x"}}}}], "comments": [{"body": "hi"}], "updated_at": "2"}),
        json.dumps({"number": 2, "timeline": [{"event": "cross-referenced", "source": {"issue": {"number": 8, "pull_request": {"merged_at": None}}}}], "updated_at": "3"}),
        json.dumps({"number": 3, "pull_request": {"url": "u"}, "timeline": [], "updated_at": "1"}),
    ]
    schema = "number long, title string, body string, state string, labels array<struct<name:string>>, created_at string, closed_at string, html_url string, updated_at string, pull_request struct<url:string>, timeline array<struct<event:string,source:struct<issue:struct<number:long,pull_request:struct<merged_at:string>>>>>, comments array<struct<user:struct<login:string>,body:string,created_at:string>>"
    frame = spark.createDataFrame([(x,) for x in raw], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
    got = issues.normalize(frame, "github", "o/r").collect()
    assert [(r["source_id"], r["title"], r["labels"], r["linked_fix_id"], r["comments"][0]["author"]) for r in got] == [("1", "", ["bug"], "7", "unknown")]
    done = spark.createDataFrame([("1",)], "source_id string")
    assert [r["number"] for r in issues.not_collected(frame, done, 5).collect()] == [2]
    seen, grading = sinks.vertical_split(issues.normalize(frame, "github", "o/r"))
    assert set(seen.columns) & set(grading.columns) == {"source_id"} and "comments" in grading.columns


def test_python_files_and_chunk_cache(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a.py": "def f(): pass", "tests/t.py": "x = 1", "build/b.py": "x = 1", "p/test_c.py": "x = 1", "p/d.py": "class A: pass"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert sorted(r["file_path"] for r in code_files.python_files(spark, str(root)).collect()) == ["a.py", "p/d.py"]
    assert code_files.python_files(spark, str(root), include_tests=True).count() == 4
    files = code_files.python_files(spark, str(root))
    first = code_files.cached_chunks(spark, str(tmp_path / "cache"), "s1", files)
    assert sorted(r["name"] for r in first.collect()) == ["A", "f"]
    assert code_files.cached_chunks(spark, str(tmp_path / "cache"), "s1", files.limit(0)).count() == 2


def test_sinks(spark, tmp_path):
    usage = spark.createDataFrame([("n", 1, 2)], "node_name string, prompt_tokens long, completion_tokens long")
    sinks.append_usage(usage, str(tmp_path / "u"))
    sinks.append_usage(usage, str(tmp_path / "u"))
    assert [r["total_tokens"] for r in spark.read.json(str(tmp_path / "u")).collect()] == [3, 3]
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.keyed_upsert(old, new, "k").collect())) == [("a", 1), ("b", 2)]
    good, bad = sinks.dead_letters(spark.createDataFrame([("a", None), ("b", "e")], "k string, error string"))
    assert (good.columns, good.count(), bad.count()) == (["k"], 1, 1)


def test_strict_join_fails_on_a_miss(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.strict_inner(left.where("k = 1"), right, "k").count() == 1
    with pytest.raises(Exception, match="no match for k"):
        joins.strict_inner(left, right, "k").collect()


def test_asof_takes_equal_times_and_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 3)], "k string, u int, v int")
    assert sorted(map(tuple, joins.asof_backward(left, right, "k", "t", "u", ["v"], tie="v").collect()), key=str) == [("a", 1, None), ("a", 5, 2), ("b", 5, None)]


def test_top_k_is_limited_before_the_shuffle(spark):
    scores = spark.range(1000).selectExpr("id % 2 AS query", "id AS doc", "CAST(id % 7 AS DOUBLE) AS score")
    top = retrieval.top_k(scores, 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert sorted((r["query"], r["doc"]) for r in top.collect()) == [(0, 6), (0, 20), (0, 34), (1, 13), (1, 27), (1, 41)]


def test_filters_reach_the_scan(spark):
    plan = traces.task_success(trace_of_events(spark, DATA).where("run_id = 3"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan
    assert "props" not in plan.split("ReadSchema")[-1]


def test_stream_gives_the_batch_result(spark, tmp_path):
    batch = trace_of_events(spark, DATA)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = trace_stream.read_trace_stream(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "), per_trigger=1)
    got = trace_stream.drain(trace_stream.running_verdicts(stream), "verdicts", str(tmp_path / "check"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, traces.task_success(batch).collect()))


def test_a_versioned_table_changes_in_one_step(spark, tmp_path):
    table, schema = sinks.VersionedTable(spark, str(tmp_path / "t")), "id long"
    content = lambda: sorted(r["id"] for r in table.read(schema).collect())
    assert content() == []
    assert (table.replace(spark.range(3)), table.append(spark.range(10, 12)), content()) == (1, 2, [0, 1, 2, 10, 11])

    def fails(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("a task is lost")

    with pytest.raises(Exception, match="a task is lost"):
        table.replace(spark.range(100, 200, 1, 4).mapInArrow(fails, schema))
    assert content() == [0, 1, 2, 10, 11] and table.versions() == [1, 2]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # nothing of the failed write is left
    late, seen = sinks.VersionedTable(spark, str(tmp_path / "t")), []
    plain = late.versions
    late.versions = lambda: plain() if seen else seen.append(1) or [1]  # it has not seen the second version yet
    assert (late.append(spark.range(20, 22)), content()) == (3, [0, 1, 2, 10, 11, 20, 21])
    assert table.replace(spark.range(1)) == 4 and content() == [0]
    assert len(table.read(schema, 3).collect()) == 7
    table.expire(1)
    assert table.versions() == [4] and content() == [0] and len(list((tmp_path / "t" / "data").iterdir())) == 1
