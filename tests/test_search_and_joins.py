"""Search in blocks, joins with hot keys, logs in blocks, against plain Python."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.functions.tokens import identifier_hashes
from tracewright.operators import joins, models, postings, retrieval, routing, search, traces
from tracewright.plans.trace_queries import trace_of_events
from tracewright.sources import code_files, issues, sinks, trace_log
from tracewright.streaming import trace_stream

TOKEN = re.compile("[a-z_][a-z0-9_]*")
DATA = "/root/testdata/sf0.001"


def test_identifiers_equal_the_pattern():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab9_ Zé.\n-0") for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, "9", "99a", "a" * 5000, "123 456", "x"]
    hashes, bounds = identifier_hashes(pa.array(texts))
    want = [TOKEN.findall((t or "").lower()) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    by_word = {}
    for word, h in zip([w for own in want for w in own], hashes.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert [x.tolist() for x in identifier_hashes(pa.array([], pa.string()))] == [[], [0]]


def plain_bm25(docs, query):
    words = {i: TOKEN.findall((t or "").lower()) for i, t in docs.items()}
    df = Counter(w for own in words.values() for w in set(own))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, length = sum(raw.values()) / len(raw), sum(map(len, words.values())) / len(docs)
    idf = {w: 0.25 * mean if r < 0 else r for w, r in raw.items()}
    asked = Counter(w for w in TOKEN.findall((query or "").lower()) if w in idf)
    out = {}
    for i, own in words.items():
        tf = Counter(own)
        if set(tf) & set(asked):
            out[i] = sum(n * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / length)) for w, n in asked.items())
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "ROWS", 7)
    monkeypatch.setattr(search, "PASS_BYTES", 2000)  # and several passes
    monkeypatch.setattr(postings, "SEGMENT", 5)
    monkeypatch.setattr(postings, "ASKED", 4)


def corpus(n=60):
    rng = random.Random(1)
    words = ["the", "alpha", "beta_2", "gamma", "delta", "x9"]
    docs = {i: " ".join(rng.choices(words, [8, 3, 3, 2, 1, 1], k=rng.randrange(30))) for i in range(n)}
    return docs | {n: None, n + 1: "", n + 2: docs[3], n + 3: docs[3]}, {0: "alpha the the", 1: "delta x9 nowhere", 2: None, 3: "none of these", 4: "gamma beta_2 beta_2"}


def best(scores, k):
    return [(d, pytest.approx(s, abs=1e-6)) for d, s in sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]


def test_lexical_search(spark, small_blocks):
    docs, queries = corpus()
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "item int, text string")
    got = search.lexical_top(frame, "doc_id", "text", asked, "item", "text", 5).orderBy("query", "rank").collect()
    for q, text in queries.items():
        assert [(r["doc"], r["score"]) for r in got if r["query"] == q] == best(plain_bm25(docs, text), 5)
    assert search.lexical_top(frame.limit(0), "doc_id", "text", asked, "item", "text", 5).count() == 0
    assert search.lexical_top(frame, "doc_id", "text", asked.limit(0), "item", "text", 5).count() == 0


def test_dense_search(spark, small_blocks):
    rng = np.random.default_rng(0)
    x = {i: rng.normal(size=4).tolist() for i in range(40)} | {40: None, 41: [0.0] * 4, 42: [1.0, None, 0.0, 0.0]}
    x[43] = x[5]
    frame = spark.createDataFrame(list(x.items()), "id long, v array<double>").repartition(3)
    asked = frame.where("id in (0, 5, 40, 41)")
    got = search.dense_top(frame, "id", "v", asked, "id", "v", 6).orderBy("query", "rank").collect()
    there = {i: np.array(v, float) for i, v in x.items() if v is not None and None not in v}
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    for q in (0, 5, 41):
        assert [(r["doc"], r["score"]) for r in got if r["query"] == q] == best({i: cosine(there[q], v) for i, v in there.items()}, 6)
    assert not [r for r in got if r["query"] == 40]


def test_hybrid_search(spark, small_blocks):
    docs, queries = corpus()
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=3) for i in [*range(0, 50, 2), 900, 901]}  # some documents have no vector, some vectors no document
    ask = {q: rng.normal(size=3) if q != 1 else None for q in queries}
    frame = spark.createDataFrame([(i, t, f"p{i % 3}.py" if i % 4 else None) for i, t in docs.items()], "doc long, text string, path string").repartition(2)
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "doc long, vector array<double>")
    asked = spark.createDataFrame([(q, t, ask[q].tolist() if ask[q] is not None else None, ["p1.py"] if q else []) for q, t in queries.items()], "query long, text string, vector array<double>, paths array<string>")
    got = search.hybrid_top(frame, vecs, asked, 5).orderBy("query", "rank").collect()
    every = sorted(set(docs) | set(vectors))
    unit = lambda x: {i: 0.0 if max(x.values()) - min(x.values()) < 1e-9 else (v - min(x.values())) / (max(x.values()) - min(x.values())) for i, v in x.items()}
    for q, text in queries.items():
        lexical, dense = plain_bm25(docs, text), {i: float(v @ ask[q] / np.linalg.norm(v) / np.linalg.norm(ask[q])) for i, v in vectors.items()} if ask[q] is not None else {}
        a, b = unit({i: dense.get(i, 0.0) for i in every}), unit({i: lexical.get(i, 0.0) for i in every})
        named = lambda i: 0.25 if q and i in docs and i % 4 and i % 3 == 1 else 0.0
        assert [(r["doc"], r["score"]) for r in got if r["query"] == q] == best({i: a[i] + b[i] + named(i) for i in every}, 5)


def test_hybrid_search_reads_documents_once(spark, monkeypatch):
    """Documents don't travel once for each query block; equal texts are many, and terms are in few queries or in most."""
    monkeypatch.setattr(search, "QUERIES", 12)
    monkeypatch.setattr(search, "ROWS", 7)
    docs = {i: f"all w{i % 5} w{i % 3} " + ("rare" if i in (31, 140) else "") for i in range(150)}
    queries = {q: f"all all w{q % 5} " + ("rare" if q == 3 else "") for q in range(40)}
    vector = {i: [1.0, float(i % 4)] for i in docs}
    frame = spark.createDataFrame([(i, t, f"p{i % 50}.py") for i, t in docs.items()], "doc long, text string, path string").repartition(3)
    vecs = spark.createDataFrame(list(vector.items()), "doc long, vector array<double>")
    asked = spark.createDataFrame([(q, t, [1.0, float(q % 3)], [f"p{q}.py"]) for q, t in queries.items()], "query long, text string, vector array<double>, paths array<string>")
    found = search.hybrid_top(frame, vecs, asked, 6)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.orderBy("query", "rank").collect()
    unit = lambda x: {i: 0.0 if max(x.values()) - min(x.values()) < 1e-9 else (v - min(x.values())) / (max(x.values()) - min(x.values())) for i, v in x.items()}
    for q, text in queries.items():
        y, lexical = np.array([1.0, q % 3]), plain_bm25(docs, text)
        a, b = unit({i: float(np.dot(v, y) / np.linalg.norm(v) / np.linalg.norm(y)) for i, v in vector.items()}), unit({i: lexical.get(i, 0.0) for i in docs})
        assert [(r["doc"], r["score"]) for r in got if r["query"] == q] == best({i: a[i] + b[i] + 0.25 * (i % 50 == q) for i in docs}, 6)


def test_dense_search_has_no_row_for_each_query_and_document(spark):
    """Blocks meet, in a broadcast join."""
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "id long, v array<double>")
    plan = search.dense_top(frame, "id", "v", frame.where("id < 9"), "id", "v", 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin BuildRight, Cross" in plan and "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def topics(spark):
    """400 documents, ten after another about one thing, each with common words too."""
    rng = random.Random(4)
    common, special = [f"w{i}" for i in range(30)], [[f"t{t}_{i}" for i in range(6)] for t in range(40)]
    docs = {i: " ".join(rng.choices(common, k=20) + rng.choices(special[i // 10], k=rng.randrange(1, 12))) for i in range(400)}
    return docs, spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)


def test_postings_skip_segments_below_the_threshold(spark, topics, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 10)
    docs, frame = topics
    queries = {t: f"t{t}_0 t{t}_1 w1 w2 t{t}_2" for t in range(0, 40, 4)} | {100: "w1 w2 w3", 101: "nowhere", 102: ""}
    asked = spark.createDataFrame(list(queries.items()), "item int, text string")
    index = postings.Postings.build(frame, "doc_id", "text")
    assert (index.documents, index.rows.where("hash is null").count()) == (400, 40)
    own = postings.Pass(index, index.asked(asked, "item", "text"), 5, 6)
    chosen = own.segments().groupBy("query").count().collect()
    touched = own.bounds(own.terms(np.arange(len(own.hash)))).groupBy("query").count().collect()
    assert all(r["count"] == 40 for r in touched)
    assert all(r["count"] <= 10 for r in chosen if r["query"] < 100)  # of 40
    got = index.top(asked, "item", "text", 5).orderBy("query", "rank").collect()
    for q, text in queries.items():
        assert [(r["doc"], r["score"]) for r in got if r["query"] == q] == best(plain_bm25(docs, text), 5)


def test_postings_are_kept_and_read_by_folders(spark, topics, tmp_path):
    docs, frame = topics
    postings.Postings.build(frame, "doc_id", "text").save(str(tmp_path / "index"))
    index = postings.Postings.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "t3_1 w7"), (2, "t9_0")], "item int, text string")
    got = index.top(asked, "item", "text", 3).orderBy("query", "rank").collect()
    for q, text in ((1, "t3_1 w7"), (2, "t9_0")):
        assert [(r["doc"], r["score"]) for r in got if r["query"] == q] == best(plain_bm25(docs, text), 3)
    own = postings.Pass(index, index.asked(asked, "item", "text"), 3, 6)
    files = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in own.rows.select("hash").inputFiles()}
    every = {p.name.split("=")[1] for p in (tmp_path / "index" / "rows").glob("bucket=*")}
    assert files <= every and len(every) > 50
    plan = own.rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def plain_asof(left, right):
    out = []
    for i, (k, t) in enumerate(left):
        own = [(u, v) for key, u, v in right if key == k and key is not None and t is not None and u is not None and u <= t]
        out.append((i, max(own)[1] if own else None))
    return out


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_asof_in_stretches(spark, width):
    rng = random.Random(3)
    left = [(rng.choice(["hot"] * 5 + ["b", "c", None]), rng.choice([rng.randrange(100), None])) for _ in range(300)]
    right = [(rng.choice(["hot"] * 5 + ["b", None]), rng.choice([rng.randrange(-50, 100), None]), v) for v in range(80)]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, k string, t int")
    b = spark.createDataFrame([(k, u, v, v + 100000) for k, u, v in right], "k string, u int, v int, i int")
    got = joins.asof_backward(a, b, "k", "t", "u", ["v", "i"], tie="i", width=width)
    assert got.columns == ["i", "k", "t", "v", "i_right"]
    assert sorted((r["i"], r["v"]) for r in got.collect()) == plain_asof(left, right)


@pytest.mark.parametrize("width", [None, 5])
def test_positions_in_stretches(spark, width):
    rng = random.Random(4)
    sides = [[(rng.choice([1, 1, 1, 2]), t) for t in rng.sample(range(200), 60)] for _ in range(2)]
    frames = [spark.createDataFrame(s, "k int, t int") for s in sides]
    got = joins.positional_full(*frames, ["k"], "t", width=width).select("k", "pos", F.col("left.t").alias("a"), F.col("right.t").alias("b")).collect()
    want = []
    for k in (1, 2):
        a, b = (sorted(t for key, t in s if key == k) for s in sides)
        want += [(k, i + 1, a[i] if i < len(a) else None, b[i] if i < len(b) else None) for i in range(max(len(a), len(b)))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_overlaps_of_long_intervals(spark):
    rng = random.Random(5)

    def some(n):
        out = []
        for i in range(n):
            a = rng.randrange(-5000, 10**6)
            out.append((rng.choice("xy"), i, a, a + rng.choice([-1, 0, 3, 70, 1000, 40_000, 10**9])))
        return out

    a, b = some(150), some(150)
    frames = [spark.createDataFrame(x, f"g string, {n} int, {n}_s long, {n}_e long") for x, n in ((a, "a"), (b, "b"))]
    got = joins.overlap_join(*frames, "g", ("a_s", "a_e"), ("b_s", "b_e"), 64)
    want = sorted((i, j) for g, i, s, e in a for h, j, u, v in b if g == h and s <= e and u <= v and s <= v and u <= e)
    assert sorted((r["a"], r["b"]) for r in got.select("a", "b").collect()) == want
    long = spark.createDataFrame([("x", 0, 0, 10**15)], "g string, a int, a_s long, a_e long")
    per_row = joins.overlap_join(long.limit(1), frames[1], "g", ("a_s", "a_e"), ("b_s", "b_e"), 10**6)
    assert per_row.count() == sum(1 for g, _, u, v in b if g == "x" and u <= v and v >= 0)


def test_one_large_log_is_read_in_blocks(spark, tmp_path):
    rows = [{"run_id": str(i % 3), "node_name": f"n{i}", "outcome": "é" * (i % 5)} for i in range(3000)]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) + ("\n" if i % 7 == 0 else "") for i, r in enumerate(rows)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        log = trace_log.read_json_lines(spark, str(tmp_path / "log.jsonl"), trace_log.PIPELINE_LOG)
        assert log.rdd.getNumPartitions() > 5
        got = log.orderBy("seq").select("node_name", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["node_name"] for r in got] == [r["node_name"] for r in rows] and len({r["seq"] for r in got}) == len(rows)


def test_checkpoint_versions(spark, tmp_path):
    path = str(tmp_path / "done")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id string")
    for n in range(4):
        sinks.write_checkpoint(ids(*map(str, range(n + 1))), path)
        assert sinks.read_checkpoint(spark, path).count() == n + 1
    versions = sorted(p.name for p in (tmp_path / "done").iterdir())
    assert len(versions) == 2
    (tmp_path / "done" / "version-000000000099").mkdir()  # a run that was cut off
    assert sinks.read_checkpoint(spark, path).count() == 4
    with pytest.raises(Exception, match="other"):
        sinks.read_checkpoint(spark, path, key="other").collect()


def test_run_outcomes(spark):
    runs = spark.createDataFrame([("off", False), ("first", True), ("third", True), ("blocked", True), ("spent", True), ("fixed", True), ("open", True), ("provider", True), ("none", None)], "run_id string, is_actionable boolean")
    bad = lambda run, reasons: [(run, k, False, r) for k, r in enumerate(reasons)]
    attempts = [("first", 0, True, None), ("off", 0, True, None), *bad("third", ["malformed_edit", "stale_chunks"]), ("third", 2, True, None), *bad("blocked", ["malformed_edit", "unsafe_pattern_detected", "x"]), *bad("spent", ["io_error"] * 4), *bad("fixed", ["io_error"] * 4), *bad("open", ["io_error"]), *bad("provider", ["api_error"])]
    frame = spark.createDataFrame(attempts, "run_id string, attempt int, applied boolean, failure_reason string")
    fallbacks = spark.createDataFrame([("spent", False, "stale_chunks"), ("fixed", True, None), ("provider", False, "io_error")], "run_id string, applied boolean, failure_reason string")
    got = {r["run_id"]: tuple(r)[1:] for r in routing.run_outcomes(runs, frame, fallbacks).collect()}
    assert got == {
        "off": ("not_actionable", None, False, None), "none": ("not_actionable", None, False, None), "first": ("applied", 0, False, None), "third": ("applied", 2, False, None), "blocked": ("escalated", None, False, "guardrail_trip"),
        "spent": ("escalated", None, True, "capability_exhausted"), "fixed": ("applied", None, True, None), "open": ("open", None, False, None), "provider": ("escalated", None, True, "infra_failure"),
    }


def test_query_of_an_issue(spark):
    records = spark.createDataFrame([("1", "KeyError: in `pkg.core.load`", "### Bug\nsee `core/x.py` and `nope`\n`load`"), ("2", None, None)], "source_id string, title string, body string")
    chunks = spark.createDataFrame([("load", "pkg/core/x.py"), ("other", "pkg/y.py")], "name string, file_path string")
    got = {r["source_id"]: r for r in issues.build_query(records, chunks).collect()}
    assert (got["1"]["identifiers"], got["1"]["file_paths"], got["1"]["exception_types"], got["1"]["lexical"]) == (["load"], ["pkg/core/x.py"], ["KeyError"], "load pkg/core/x.py keyerror")
    assert (got["2"]["semantic"], got["2"]["identifiers"], got["2"]["lexical"]) == ("", [], "")


def test_embedding_cache(spark, tmp_path):
    calls = tmp_path / "calls"

    def factory():
        def model(texts):
            assert len(texts) <= 8
            with calls.open("a") as out:
                out.write("x\n")
            return [[len(t), 1] for t in texts]

        return model

    chunks = spark.createDataFrame([(i, "s" * (i * 500)) for i in range(20)], "chunk_id int, source string").coalesce(1)
    get = lambda: {r["chunk_id"]: r["vector"] for r in code_files.cached_embeddings(spark, str(tmp_path / "cache"), "7", "2024-01-01T00:00:00", chunks, factory).collect()}
    first = get()
    made = calls.read_text()
    assert first == {i: [float(min(i * 500, retrieval.EMBED_CHARS)), 1.0] for i in range(20)} and made.count("x") == 3
    assert get() == first and calls.read_text() == made


def test_logs_records_and_prompts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, seq int")
    sinks.append_log(rows, str(tmp_path / "log"))
    sinks.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    records = spark.createDataFrame([("github", "1", "t", "fix")], "source string, source_id string, title string, linked_fix_id string")
    sinks.write_split(records, str(tmp_path / "seen"), str(tmp_path / "grading"))
    assert sorted(spark.read.json(str(tmp_path / "seen")).columns) == ["source", "source_id", "title"]
    assert sorted(spark.read.json(str(tmp_path / "grading")).columns) == ["linked_fix_id", "source_id"]
    failed = spark.createDataFrame([("1", "o", "why", None, None)], "source_id string, outcome string, original_failure_reason string, fallback_failure_reason string, detail string")
    record = sinks.escalation_record(failed, F.lit("infra_failure")).first()
    assert (record["failure_reason"], record["detail"], record["category"]) == ("why", "", "infra_failure")
    log = trace_log.read_json_lines(spark, str(tmp_path / "log"), "run_id string")
    with pytest.raises(KeyError):
        trace_log.one_issue(log.withColumnRenamed("run_id", "source_id"), "none")
    asked = spark.createDataFrame([("t", "s", ["a", "b"], "again"), ("t", None, [], None)], "t string, s string, c array<string>, n string")
    assert [r[0] for r in asked.select(tx.prompt(F.col("t"), F.col("s"), F.col("c"), F.col("n"))).collect()] == ["Issue: t\n\ns\n\na\n---\nb\n\nagain", "Issue: t"]
    assert [r[0] for r in spark.createDataFrame([("tests/a.py",), ("x/test_a.py",), ("b_test.py",)], "p string").select(tx.is_test_file(F.col("p"), "file")).collect()] == [False, True, True]


def test_edits_of_a_file_in_order(spark):
    from tracewright.operators import edits

    rows = spark.createDataFrame([("p", "f", 1, "b", "c"), ("p", "f", 0, "a", "b"), ("p", "g", 0, "x", "y")], "patch_id string, file_path string, pos int, old string, new string")
    own = edits.group_by_file(rows).withColumn("text", F.lit("a x b"))
    fixed = own.select("file_path", edits.apply_in_order(F.col("text"), F.col("edits")).alias("t"))
    assert dict(map(tuple, fixed.collect())) == {"f": "c x b", "g": "a y b"}


def test_running_latency(spark, tmp_path):
    batch = trace_of_events(spark, DATA)
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = trace_stream.read_trace_stream(spark, str(tmp_path / "in"), batch.schema.simpleString()[7:-1].replace(":", " "), per_trigger=1)
    got = trace_stream.drain(trace_stream.running_latency(stream), "latencies", str(tmp_path / "check"))
    key = lambda r: (r["run_id"], round(r["latency_ms"], 6), r["steps"])
    assert sorted(map(key, got.collect())) == sorted(map(key, traces.latency(batch).collect()))


def test_model_errors_belong_to_rows(spark):
    frame = spark.createDataFrame([("1",), ("x",), (None,)], "t string")
    got = models.with_model(frame, lambda: lambda t: str(int(t) + 1), "t", "out").collect()
    assert [r["out"]["value"] for r in got] == ["2", None, None] and [r["out"]["ok"] for r in got] == [True, False, False]


def test_files_of_patches_out_of_git(spark, tmp_path):
    import subprocess

    from tracewright.operators import patches
    from tracewright.sources import git_files

    tree = tmp_path / "tree"
    tree.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tree / "a.py").write_text("def f(x):\n    return x\n")
    (tree / "é b.py").write_text("x = 1\n")
    (tree / "gone.py").write_text("y = 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tree / "a.py").write_text("def f(x, y):\n    return x\n")
    (tree / "é b.py").write_text("x = 2\n")
    (tree / "gone.py").unlink()
    (tree / "new.py").write_text("z = 1\n")
    (tree / "note.txt").write_text("no code\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    asked = spark.createDataFrame([("p", str(tree), "HEAD~1", "HEAD"), ("same", str(tree), "HEAD", "HEAD"), ("bad", str(tree), "nope", "HEAD"), ("none", str(tmp_path / "no"), "a", "b")], "patch_id string, worktree string, base_ref string, head_ref string")
    got = git_files.file_versions(asked).collect()
    own = {r["file_path"]: r for r in got if r["patch_id"] == "p"}
    assert set(own) == {"a.py", "é b.py", "gone.py", "new.py"} and "@@ -1 +1 @@" in own["a.py"]["diff_text"]
    assert (own["new.py"]["old_source"], own["gone.py"]["new_source"], own["é b.py"]["new_source"]) == (None, None, "x = 2\n")
    assert {r["patch_id"] for r in got if r["error"]} == {"bad", "none"} and not [r for r in got if r["patch_id"] == "same"]
    assert patches.signature_unchanged(git_files.file_versions(asked.where("patch_id = 'p'"))).first()["passed"] is False
    (tree / "dirty.txt").write_text("x")
    clean = {r["patch_id"]: r["clean"] for r in git_files.clean_trees(asked).collect()}
    assert clean == {"p": False, "same": False, "bad": False, "none": None}


def test_collection_goes_on_where_it_ended(spark, tmp_path):
    from tracewright.plans.source_queries import raw_issues
    from tracewright.sources import config

    raw = raw_issues(spark, DATA)
    raw = raw.unionByName(raw.limit(1).withColumn("number", F.lit(None).cast("long")))
    seen, path = [], str(tmp_path / "done")
    for _ in range(3):
        records, skipped = issues.collect_new(raw, "github", "o/r", path, 40)
        ids = [r["source_id"] for r in records.collect()]
        assert {(r["source_id"] is None, r["error"]) for r in skipped.collect()} >= {(True, "no number")}
        seen += ids + [r["source_id"] for r in skipped.where("source_id is not null").collect()]
    assert len(seen) == len(set(seen)) == 120 and sinks.read_checkpoint(spark, path).count() == 120
    first, second = ([r["number"] for r in issues.page(raw.where("number is not null"), k, 10).collect()] for k in (0, 1))
    assert len(set(first + second)) == 20
    with pytest.raises(ValueError, match="repository"):
        config.collection(spark)
    spark.conf.set(config.PREFIX + "repository", "o/r")
    assert config.collection(spark) == config.Collection("o/r", None, "collected", "issues", 50)
    spark.conf.unset(config.PREFIX + "repository")


def test_formats_and_unit_vectors(spark, tmp_path):
    frame = spark.createDataFrame([(12.25,), (12.35,), (0.1234565,), (None,)], "x double")
    assert [r[0] for r in frame.where("x is not null").select(tx.fixed(F.col("x"), 1)).collect()] == ["12.2", "12.4", "0.1"]
    at = spark.sql("SELECT timestamp'2024-01-02 03:04:05.5' AS t")
    assert tuple(at.select(tx.utc_iso(F.col("t")), tx.epoch_seconds(F.col("t"))).first()) == ("2024-01-02T03:04:05Z", 1704164645.5)
    vectors = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in vectors.select(retrieval.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    for n in (1, 2):
        sinks.replace_json(spark.range(n), str(tmp_path / "out"))
        assert spark.read.json(str(tmp_path / "out")).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_suffixes_both_ways(spark):
    """Against all pairs: nested endings, many ranges, equal texts, an empty candidate, characters of several bytes."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abé/") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    asked, known = [*words[:200], "", "zzz", None, "x" + words[300], "a" * 60], [*words[150:], "a" * 40, None]
    got = joins.any_suffix_match(spark.createDataFrame([(w,) for w in asked], "c string").repartition(3), spark.createDataFrame([(w,) for w in known], "p string"), "c", "p")
    want = {c: min((k for k in known if k is not None and (k.endswith(c) or c.endswith(k))), default=None) for c in asked if c is not None}
    assert dict(got.collect()) == {c: k for c, k in want.items() if k is not None}
    few = spark.createDataFrame([("b",)], "c string"), spark.createDataFrame([], "p string")
    assert joins.any_suffix_match(*few, "c", "p").collect() == []
