import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewright.functions import pyast
from tracewright.functions import text as tx
from tracewright.operators import edits, guardrail, patches


def column(spark, values, make, schema="t string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r["x"] for r in frame.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_clean_description(spark):
    cases = {"intro\n# H\nrest": "intro", "### Bug\nfoo\n### Version\n1": "foo", "### Only": "Only", "a ```x``` b": "a  b", "": "", None: "", "a\n```\nx\n# y\n```\n": "a\n```\nx", "#nope": "#nope"}
    assert column(spark, list(cases), tx.clean_description) == list(cases.values())


def test_entities(spark):
    assert column(spark, ["KeyError: x", "should raise ValueError if"], tx.exception_types) == [["KeyError"], []]
    assert column(spark, ["`foo.bar` `print` `bar`"], tx.identifiers) == [["bar"]]
    assert column(spark, ["/x/pkg/a/pkg/b.py", "b.py", "/usr/c.py"], lambda c: tx.canonical_path(c, "pkg")) == ["pkg/b.py", "b.py", None]
    assert column(spark, ["a\nb\x0cc d\n", "", "\n"], tx.lines) == [["a", "b", "c", "d"], [], [""]]
    assert column(spark, ["```json\n{}\n```", "{}", "```x```"], tx.without_fence) == ["{}", "{}", "x"]
    assert column(spark, ["tests/a.py", "a/test_b.py", "a/b_test.py", "a/contest.py"], tx.is_test_file) == [True, True, True, False]
    assert column(spark, ["tests/a.py", "a/test_b.py", "a/b_test.py"], lambda c: tx.is_test_file(c, "folder")) == [True, True, False]


def test_diff_ranges(spark):
    heads = ["@@ -2,7 +2,6 @@ a", "@@ -5 +4,0 @@ d", "@@ -1 +1 @@", "@@ -12,3 +12,5 @@ def foo():"]
    as_pairs = lambda rows: [[tuple(r) for r in x] for x in rows]
    assert as_pairs(column(spark, heads, tx.added_ranges)) == [[(2, 7)], [], [(1, 1)], [(12, 16)]]
    assert as_pairs(column(spark, heads, lambda c: tx.added_ranges(c, drop_empty=False))) == [[(2, 7)], [(4, 3)], [(1, 1)], [(12, 16)]]


GUARD = {
    'os.system("rm -rf /")': (guardrail.CODE, True),
    'subprocess.run(["rm", "-rf", p])': (guardrail.DESTRUCTIVE, True),
    'k = os.environ["X"]\nprint(k)': (guardrail.CREDENTIALS, True),
    'print(1)\nk = os.environ["X"]': (None, True),
    'k = os.environ["X"]' + "\n" * 10 + "print(k)": (guardrail.CREDENTIALS, True),
    'k = os.environ["X"]' + "\n" * 11 + "print(k)": (None, True),
    "subprocess.run(\ncmd,\ncheck=True,\ntimeout=5,\nshell=True,\n)": (guardrail.CODE, True),
    "def f(:\n  eval(x)": (guardrail.CODE, False),
    "retrieval(x)\nconfirm_rf": (None, True),
    "model.eval()": (guardrail.CODE, True),
    "x = 1": (None, True),
    None: (None, True),
}


def test_first_pair_against_all_pairs(spark):
    rng = random.Random(0)
    rows = [(i, "\n".join(rng.choice(["x", "x", "x", "open", "close", "open close"]) for _ in range(rng.randrange(25)))) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, t string")
    for window in (1, 3, 10):
        got = dict(frame.select("i", guardrail.first_pair(F.split("t", "\n"), "open", "close", window)).collect())
        for i, text in rows:
            lines = text.split("\n")
            pairs = [(a + 1, b + 1) for a in range(len(lines)) for b in range(a, min(len(lines), a + window + 1)) if "open" in lines[a] and "close" in lines[b]]
            assert (tuple(got[i]) if got[i] else None) == min(pairs, default=None)


def test_pair_search_is_linear_and_patterns_run_once(spark):
    started = time.time()
    text = "k = os.environ['X']\n" * 100_000 + "print(k)\n"
    found = guardrail.scan_text(spark.createDataFrame([(text,)], "source string")).first()
    assert found["detail"] == "lines 99991 and 100001" and time.time() - started < 20
    plan = guardrail.scan_text(spark.createDataFrame([("x",)], "source string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 17 + 2 * 3  # a line's second pattern stands beside and behind its first


def test_required_parts_are_in_what_patterns_find():
    """Whatever part of a pattern's text is changed, no text that it finds lacks the part."""
    samples = ["rm  -rf /", "rm -f a/*", "git push --force", "git 'push' -f", "git reset --hard", "dd if=/dev/x", "mkfs /dev", "> /dev/sda", "chmod -R 777 /", "chown -R a b", "AKIA" + "A" * 16, "sk-" + "a" * 20, "api_key = '" + "x" * 20 + "'", "eval (", "exec(", "os.system (", "pickle.loads(", "__import__("]
    for k, patterns in guardrail.PATTERNS.items():
        for p, part in zip(patterns, guardrail.REQUIRED[k], strict=True):
            hits = [s for s in samples if re.search(p, s)]
            assert hits and all(part in s for s in hits)
            assert not any(re.search(p, s.replace(part, "")) for s in hits)


def test_guardrail(spark):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(GUARD)], "i int, source string")
    got = [(r["category"], r["ast_parse_ok"]) for r in guardrail.scan(frame).orderBy("i").collect()]
    assert got == list(GUARD.values())


EDITS = [
    ("a = f(x)", "a = f(x)", "grounded"), ("a = f(x)", "a = f(x)  # bug", "repaired"), ("a = f(\n    x)", "a = f( x)  # bug", "comment"), ("a = f(\n    x)", "a = f( x)", "whitespace"), ("a = f(x)", "b = g(y)", "hallucinated"), ("", "x", "hallucinated"),
]


def test_edits(spark):
    frame = spark.createDataFrame(EDITS, "source string, old string, want string")
    assert all(r["want"] == r["got"] for r in frame.withColumn("got", edits.grounding(F.col("old"), F.col("source"))).collect())
    stale = spark.createDataFrame([("b", "a", "missing"), ("a b", "a", "apply"), ("a a", "a", "ambiguous"), ("a", "", "empty"), (None, "a", "missing")], "text string, old string, want string")
    assert all(r["want"] == r["got"] for r in stale.withColumn("got", edits.staleness(F.col("old"), F.col("text"))).collect())


def test_evaluate_reports_the_first_failing_check(spark):
    keys = ["chunk_id", "file_path", "old_source", "new_source"]
    row = lambda p, old, new, **k: (p, "s", 0, k.get("chunk", "c"), "f.py", old, new, k.get("keys", keys), k.get("insufficient", False), k.get("clean", True))
    proposed = spark.createDataFrame(
        [row("ok", "a = 1", "a = 2"), row("fixed", "a = 1  # c", "a = 2"), row("shape", "a = 1", "x", keys=keys[:3]), row("chunk", "a = 1", "x", chunk="none"), row("bad", "zzz", "eval(x)"), row("unsafe", "a = 1", "eval(x)", clean=False), row("dirty", "a = 1", "x", clean=False), row("stale", "b = 1", "x"), row("none", "zzz", "x", insufficient=True)],
        "patch_id string, source_id string, pos int, chunk_id string, file_path string, old_source string, new_source string, keys array<string>, insufficient_context boolean, clean boolean",
    )
    chunks = spark.createDataFrame([("s", "c", 0, "a = 1\nb = 1"), ("s", "c", 1, "other")], "source_id string, chunk_id string, pos int, source string")
    files = spark.createDataFrame([(p, "f.py", "a = 1") for p in ("ok", "fixed", "shape", "chunk", "bad", "unsafe", "dirty", "stale", "none")], "patch_id string, file_path string, text string")
    got = {r["patch_id"]: (r["applied"], r["failure_reason"], r["auto_repaired"]) for r in edits.evaluate(proposed, chunks, files).collect()}
    assert got == {
        "ok": (True, None, []), "fixed": (True, None, ["c"]), "shape": (False, "malformed_edit", []), "chunk": (False, "malformed_edit", []), "bad": (False, "malformed_edit", []), "unsafe": (False, "unsafe_pattern_detected", []),
        "dirty": (False, "dirty_worktree", []), "stale": (False, "stale_chunks", []), "none": (False, "insufficient_context", []),
    }


BODY = "def f():\n    try:\n        {body}\n    except ValueError{as_}:\n        {handler}\n"


def source(body="go()", handler="pass", extra="", as_=""):
    return BODY.format(body=body, handler=handler, as_=as_) + extra


FINDINGS = [
    (source(), "def f():\n    go()\n", ["removed_try_block"]),
    (source(extra="    except KeyError:\n        pass\n"), source(), ["removed_except_clause"]),
    (source(handler="raise"), source(), ["removed_raise"]),
    (source(handler="raise A"), source(handler="raise B"), []),
    (source(body="raise A"), source(), ["removed_raise"]),
    (source(handler="logger.error(1)"), source(), ["error_logging_removed"]),
    (source(handler="logger.error(1)"), source(handler="logger.info(1)"), ["error_logging_downgraded"]),
    (source(handler="logger.error(1)"), source(handler="logger.exception(1)"), []),
    ("x = 1\n", "def g(u):\n    return requests.get(u)\n", ["missing_error_handling_new_code"]),
    ("x = 1\n", "def g(u):\n    try:\n        return requests.get(u)\n    finally:\n        pass\n", []),
    ("def f():\n    def g():\n        try:\n            go()\n        except ValueError:\n            pass\n    g()\n", "def f():\n    def g():\n        go()\n    g()\n", ["removed_try_block"]),
]


FILES = "patch_id string, file_path string, old_source string, new_source string, diff_text string"


def test_error_handling(spark):
    files = spark.createDataFrame([(str(k), "a/b.py", old, new, "@@ -1 +1,50 @@") for k, (old, new, _) in enumerate(FINDINGS)], FILES)
    got = {r["patch_id"]: r for r in patches.error_handling(files).collect()}
    for k, (_, _, kinds) in enumerate(FINDINGS):
        assert got[str(k)]["error"] is None and [f["kind"] for f in got[str(k)]["findings"]] == kinds
    found = {f["kind"]: (f["location"], f["detail"]) for r in got.values() for f in r["findings"]}
    assert found["error_logging_downgraded"] == ("f:L4", "from error to info") and found["missing_error_handling_new_code"] == ("g:L1", "calls get without any try")


def test_exception_changes(spark):
    broader = [("KeyError", "LookupError"), ("ValueError", "Exception"), ("ValueError", ""), ("(KeyError, IndexError)", "LookupError"), ("IOError", "Exception")]
    other = [("", "ValueError"), ("Exception", "ValueError"), ("ValueError", "OSError"), ("(ValueError, KeyError)", "LookupError"), ("IOError", "OSError"), ("CustomError", "Exception"), ("os.error", "Exception"), ("", ""), ("e[0]", "Exception")]
    code = lambda x: source().replace("except ValueError", f"except {x}".rstrip())
    files = spark.createDataFrame([(f"{a}>{b}", "a.py", code(a), code(b), "@@ +1,9 @@") for a, b in broader + other], FILES)
    assert {r["patch_id"]: [f["kind"] for f in r["findings"]] for r in patches.error_handling(files).collect()} == {f"{a}>{b}": ["broadened_except"] for a, b in broader} | {f"{a}>{b}": [] for a, b in other}


def test_error_handling_scope_of_a_diff(spark):
    late = "def f():\n    x = 1\n\n\nclass A:\n    def f(self):\n        go()\n"
    early = "class A:\n    def f(self):\n        try:\n            go()\n        except ValueError:\n            pass\n\n\ndef f():\n    try:\n        x = 1\n    except* KeyError:\n        pass\n"
    rows = [
        ("p", "a.py", source(), "def f():\n    go()\n", "@@ -1,6 +1,2 @@\n"), ("q", "a.py", None, None, None), ("gone", "a.py", source(), "def f():\n    go()\n", "@@ -1,6 +4,0 @@"), ("test", "tests/b.py", "x = 1\n", "def g(u):\n    return requests.get(u)\n", "@@ +1,9 @@"),
        ("bad", "a.py", "def f(:", "x", "@@ +1 @@"), ("two", "a.py", source(handler="raise"), source(), "@@ +1,9 @@"), ("two", "b.py", source(extra="    except KeyError:\n        pass\n"), source(), "@@ +1,9 @@"), ("both", "a.py", early, late, "@@ +1,9 @@"),
        ("many", "a.py", source(handler="logger.critical(1)\n        log.error(2)\n        raise"), source(handler="logger.warning(1)"), "@@ +1,9 @@"), ("names", "a.py", source().replace("ValueError", "(KeyError, IndexError)"), source().replace("ValueError", "LookupError"), "@@ +1,9 @@"),
    ]
    got = {(r["patch_id"], r["file_path"]): [f["kind"] for f in r["findings"]] if r["error"] is None else r["error"][:11] for r in patches.error_handling(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("p", "a.py"): ["removed_try_block"], ("q", "a.py"): [], ("gone", "a.py"): [], ("test", "tests/b.py"): [], ("bad", "a.py"): "SyntaxError", ("two", "a.py"): ["removed_raise"], ("two", "b.py"): ["removed_except_clause"],
        ("both", "a.py"): [], ("many", "a.py"): ["removed_raise", "error_logging_downgraded"], ("names", "a.py"): ["broadened_except"],
    }
    by_qualname = patches.error_handling(spark.createDataFrame(rows[7:8], FILES), by_qualname=True).first()
    assert [f["location"] for f in by_qualname["findings"]] == ["f:L3"]


def test_deep_sources_are_rows_like_others(spark):
    """Long sums and many nested blocks: facts as of any source, and no job fails."""
    terms = "x = " + "+".join(["a"] * 3000) + "\ndef f(p=" + "+".join(["b"] * 3000) + "):\n    return 1\n"
    nested = "def g():\n" + "".join(" " * (k + 1) + "if a:\n" for k in range(90)) + " " * 91 + "raise A\n"
    deeper = "x = " + "(" * 5000 + ")" * 5000
    rows = [("t", "t.py", terms, terms.replace("return 1", "return 2"), "@@ +1,9 @@"), ("n", "n.py", nested, nested, "@@ +1,99 @@"), ("d", "d.py", deeper, deeper, "@@ +1,9 @@"), ("u", "u.py", "-" * 20_000 + "1", "not " * 20_000 + "1", "@@ +1 @@"), ("ok", "ok.py", "x = 1", "x = 1", "")]
    files = spark.createDataFrame(rows, FILES)
    chunks, errors = patches.chunk_files(files, source="new_source")
    assert {r["name"] for r in chunks.collect()} == {"f", "g"}
    assert {r["file_path"] for r in errors.collect()} <= {"d.py", "u.py"}
    assert {r["patch_id"]: r["passed"] for r in patches.signature_unchanged(files).collect()} == dict.fromkeys("tndu", True) | {"ok": True}
    assert {r["patch_id"] for r in patches.error_handling(files).collect()} == {"t", "n", "d", "u", "ok"}
    assert len(patches.syntax_valid(files).collect()) == 5


def test_chunks_and_signatures(spark):
    code = "import os as o\nfrom . import b\n\n@dec\ndef f(a, *, b=1) -> int:\n    'doc'\n\nclass A(B):\n    x: int = 1\n    def __init__(self): pass\n    async def m(self): pass\n"
    files = spark.createDataFrame([("p/a.py", code), ("p/bad.py", "def f(:"), ("p/none.py", None)], "file_path string, source string")
    chunks, errors = patches.chunk_files(files)
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert set(rows) == {"p/a.py :: f", "p/a.py::A", "p/a.py ::A.__init__", "p/a.py ::A.m"}
    f = rows["p/a.py :: f"]
    assert (f["source"].split("\n")[0], f["signature"], f["docstring"], f["decorators"], f["imports"]) == ("@dec", "def f(a, *, b=1) -> int:", "doc", ["@dec"], ["import os as o", "from . import b"])
    assert (rows["p/a.py::A"]["bases"], rows["p/a.py::A"]["class_attributes"], rows["p/a.py ::A.m"]["class_context"]) == (["B"], ["    x: int = 1"], "    def __init__(self): pass")
    assert [r["file_path"] for r in errors.collect()] == ["p/bad.py"]
    assert pyast.signatures(code) == {"f": "a, *, b=1", "A.__init__": "self", "A.m": "self"}


def test_patch_verdicts(spark):
    files = spark.createDataFrame([("a", "m.py", "def f(x): pass", "def f(x, y): pass", ""), ("b", "m.py", "def f(x): pass", "def f(x): return 1", ""), ("c", "new.py", None, "def f(): pass", ""), ("d", "bad.py", "", "def f(:", "")], "patch_id string, file_path string, old_source string, new_source string, diff_text string")
    assert {r["patch_id"]: r["passed"] for r in patches.signature_unchanged(files).collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert {r["patch_id"]: r["passed"] for r in patches.syntax_valid(files).collect()} == {"a": True, "b": True, "c": True, "d": False}
    existing = spark.createDataFrame([("pkg/tests/test_x.py",), ("pkg/test_x.py",)], "file_path string")
    src = spark.createDataFrame([("pkg/x.py",), ("pkg/y.py",)], "file_path string")
    assert dict(patches.test_files(src, existing).collect()) == {"pkg/x.py": "pkg/tests/test_x.py", "pkg/y.py": None}


def test_fusion_keeps_documents_without_a_vector(spark):
    from tracewright.operators import retrieval

    scores = lambda rows: spark.createDataFrame(rows, "query long, doc long, score double")
    lexical, dense = scores([(1, 1, 2.0), (1, 9, 4.0), (2, 9, 1.0)]), scores([(1, 1, 0.5), (1, 2, 1.0)])
    got = {(r["query"], r["doc"]): r["score"] for r in retrieval.fuse(lexical, dense).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 9): 1.0, (2, 9): 0.0}
    best = retrieval.retrieve(lexical, dense, scores([(1, 2, -1.0), (1, 9, 3.0)])).collect()
    assert [r["doc"] for r in sorted(best, key=lambda r: (r["query"], r["rank"]))] == [9, 1, 2, 9]


def test_chunk_errors_have_type_and_place(spark):
    files = spark.createDataFrame([("bad.py", "x = 1\ndef f(:"), ("good.py", "x = 1"), ("null.py", "a\0")], "file_path string, source string")
    got = {r["file_path"]: r for r in patches.chunk_files(files)[1].collect()}
    assert set(got) == {"bad.py", "null.py"}
    bad = got["bad.py"]
    assert (bad["error_type"], bad["lineno"], bad["offset"]) == ("SyntaxError", 2, 7) and bad["error"].startswith("SyntaxError: ") and bad["traceback"].startswith("Traceback")
    with pytest.raises(Exception, match="bad.py"):
        patches.chunk_files(files.where("file_path = 'bad.py'"), strict=True)[0].collect()
