import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tracewright.operators import models
from tracewright.sources import paged, sinks


@pytest.fixture(scope="module")
def server():
    refused = set()

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.strip("/"))
            if n == 2 and n not in refused:
                refused.add(n)
                self.send_response(429)
                self.end_headers()
                return
            if n == 9:
                self.send_response(403)
                self.end_headers()
                return
            self.send_response(200)
            if n < 3:
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/{n + 1}>; rel="next"')
            self.end_headers()
            self.wfile.write(json.dumps([{"number": n * 10 + k} for k in range(2)]).encode())

        def log_message(self, *args):
            pass

    own = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_paged_source(spark, server):
    paged.register(spark)
    rows = spark.read.format("paged_json").option("urls", f"{server}/1 {server}/3 {server}/9").option("wait", "0.01").option("tries", "2").load()
    got = [(r["start"][-1], r["seq"], json.loads(r["json"])["number"]) for r in rows.collect()]
    assert sorted(got) == [("1", 0, 10), ("1", 1, 11), ("1", 2, 20), ("1", 3, 21), ("1", 4, 30), ("1", 5, 31), ("3", 0, 30), ("3", 1, 31)]


def test_model_errors_stay_in_their_row(spark):
    def factory():
        return lambda text: str(1 // len(text))

    frame = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: tuple(r["m"]) for r in models.with_model(frame, factory, "text", "m").collect()}
    assert got[1] == (True, "1", None) and got[2][0] is False and "ZeroDivisionError" in got[2][2] and "TypeError" in got[3][2]


def test_responses(spark):
    texts = ['```json\n{"edits": [{"chunk_id": "c"}], "insufficient_context": false}\n```', '{"summary": "a\nb"}', "no json", None]
    got = [r["r"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", models.parse_response(F.col("t")).alias("r")).orderBy("i").collect()]
    assert got[0]["edits"][0]["chunk_id"] == "c" and got[1]["summary"] == "a\nb"
    assert got[3] is None and (got[2] is None or got[2]["edits"] is None)


def test_counters_and_checkpoints(spark, tmp_path):
    frame, seen = models.counted(spark.range(10), "counted", even=F.col("id") % 2 == 0)
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}
    done = spark.createDataFrame([("b",), ("a",), ("a",)], "source_id string")
    sinks.write_checkpoint(done, str(tmp_path / "c"))
    assert sorted(r[0] for r in sinks.read_checkpoint(spark, str(tmp_path / "c")).collect()) == ["a", "b"]
    assert sinks.read_checkpoint(spark, str(tmp_path / "none")).count() == 0
    runs = models.new_runs(done)
    assert runs.count() == 3


def test_prompts_have_the_facts_that_are_there(spark):
    chunk = "chunk_id string, file_path string, start_line int, end_line int, class_name string, imports array<string>, class_context string, decorators array<string>, source string"
    full = ("a.py ::A.m", "a.py", 3, 9, "A", ["import os", "import re"], "    def __init__(self): pass", ["@x"], "    def m(self): pass")
    bare = ("a.py :: f", "a.py", 1, 2, None, [], None, None, "def f(): pass")
    rows = [(1, "T", "B", [full, bare], (2, "malformed_edit", "no such text")), (2, None, None, [], None), (3, "T", "B", None, None)]
    frame = spark.createDataFrame(rows, f"id int, title string, body string, chunks array<struct<{', '.join(c.replace(' ', ':', 1) for c in chunk.split(', '))}>>, retry struct<attempt:int,reason:string,detail:string>")
    got = {r["id"]: r["p"] for r in frame.select("id", models.chunk_prompt(F.col("title"), F.col("body"), F.col("chunks"), F.col("retry")).alias("p")).collect()}
    assert got[1] == (
        "ISSUE TITLE: T\n\nISSUE BODY:\nB\n\n=== CANDIDATE CHUNKS ===\n\nchunk_id: a.py ::A.m\nfile_path: a.py\nlines: 3-9\nclass_name: A\nimports: import os, import re\nclass __init__ context:\n    def __init__(self): pass\ndecorators: @x\n\nsource:\n    def m(self): pass"
        "\n\n---\n\nchunk_id: a.py :: f\nfile_path: a.py\nlines: 1-2\n\nsource:\ndef f(): pass\n\n=== PREVIOUS ATTEMPT FAILED ===\nThis is retry attempt 2.\nFailure reason: malformed_edit\nDetail: no such text\nDo not repeat the same old_source that was rejected. Address the specific reason above before proposing a fix."
    )
    assert got[2] == "ISSUE TITLE: \n\nISSUE BODY:\n\n\n=== CANDIDATE CHUNKS ===\n\n" and got[3] == "ISSUE TITLE: T\n\nISSUE BODY:\nB\n\n=== CANDIDATE CHUNKS ===\n\n"


def test_rerank_sees_the_pool_only(spark):
    """Twenty of forty chunks are pooled, and each pair of them is scored once, some at a time."""
    seen = spark.sparkContext.accumulator(0)

    def rerank():
        def score(pairs):
            assert len(pairs) <= 32
            seen.add(len(pairs))
            return [float(b.split("_")[1].split("(")[0]) for _, b in pairs]

        return score

    chunks = spark.createDataFrame([(i, f"def f_{i}(a): return b{i % 4}", f"p/m{i % 5}.py", f"f_{i}") for i in range(40)], "doc long, source string, file_path string, name string")
    asked = spark.createDataFrame([(7, "what is b1", "b1 f_3", ["p/m3.py"]), (8, "nothing", "", [])], "query long, semantic string, lexical string, file_paths array<string>")
    got = models.retrieve_chunks(chunks, asked, lambda: lambda texts: [[float(len(t)), float(t.count("b")), 1.0] for t in texts], rerank).orderBy("query", "rank").collect()
    assert seen.value == 40 and [r["rank"] for r in got if r["query"] == 7] == [1, 2, 3, 4, 5]
    scores = [r["score"] for r in got if r["query"] == 7]
    assert scores == sorted(scores, reverse=True) and all(r["score"] == r["doc"] for r in got)


def test_sources_of_chunks_stay_off_the_driver(spark, tmp_path):
    """Spark takes strings to be 20 bytes long; joins that trust this would broadcast all sources."""
    rows = [(i, f"def f_{i}(a): return {'x' * 5000}", f"p/m{i}.py", f"f_{i}") for i in range(40)]
    spark.createDataFrame(rows, "doc long, source string, file_path string, name string").write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    asked = spark.createDataFrame([(7, "what is f_7", "f_7", ["p/m7.py"])], "query long, semantic string, lexical string, file_paths array<string>")
    found = models.retrieve_chunks(chunks, asked, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], lambda: lambda pairs: [float("f_7(" in b) for _, b in pairs])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "NestedLoop" not in plan
    assert [r["doc"] for r in found.orderBy("rank").collect()] == [7, 0, 1, 2, 3]
