"""Before-and-after checks of patches. Files are rows (patch_id, file_path, old_source, new_source, diff_text).

Verdicts are three-valued: passed is null where a check does not apply. Details of several files are joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import pyast
from tracewright.functions import text as tx
from tracewright.operators.joins import first_existing, in_ranges, unique_suffix_match
from tracewright.operators.names import unused_names
from tracewright.session import ship


def _fold(frame: DataFrame, bad: Column, label: Column) -> DataFrame:
    """Per patch: passed (no row is bad) and the labels of the bad rows, sorted and joined."""
    labels = F.array_sort(F.array_compact(F.collect_list(F.when(bad, label))))
    return frame.groupBy("patch_id").agg((F.size(labels) == 0).alias("passed"), F.array_join(labels, "; ").alias("detail"))


def chunk_files(files: DataFrame, path: str = "file_path", source: str = "source", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors): a row for every function, class and method; and the files that don't parse.

    strict: a file that doesn't parse fails the job that reads it.
    """
    ship(files.sparkSession)
    fields = "chunk_id string, type string, name string, class_name string, file_path string, start_line int, end_line int, source string, class_context string, signature string, docstring string, decorators array<string>, bases array<string>, class_attributes array<string>, imports array<string>"

    def split(p, s):
        rows, error = pyast.chunks(p, s)
        if error is not None and strict:
            raise ValueError(f"{p}: {error['error']}")
        return {"rows": rows, "error": error}

    row = "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"
    udf = F.udf(split, f"rows array<{row}>, error struct<error:string,error_type:string,traceback:string,lineno:int,offset:int>", useArrow=True)
    kept = files.select(F.col(path).alias("__path"), udf(F.col(path), F.coalesce(F.col(source), F.lit(""))).alias("__c"))
    return kept.select(F.explode("__c.rows").alias("c")).select("c.*"), kept.where("__c.error is not null").select(F.col("__path").alias("file_path"), "__c.error.*")


def signatures(source: Column) -> Column:
    """Arguments by qualified name."""
    return F.udf(pyast.signatures, "map<string,string>", useArrow=True)(source)


def signature_unchanged(files: DataFrame) -> DataFrame:
    """Per patch: whether every function that both sides have keeps its arguments; changed names in detail."""
    ship(files.sparkSession)
    both = files.where(F.col("old_source").isNotNull()).withColumns({"__old": signatures(F.col("old_source")), "__new": signatures(F.coalesce("new_source", F.lit("")))})
    changed = F.filter(F.map_keys("__old"), lambda k: F.map_contains_key(F.col("__new"), k) & (F.col("__old")[k] != F.col("__new")[k]))
    own = both.withColumn("__changed", F.array_join(F.array_sort(changed), ", "))
    found = _fold(own, F.col("__changed") != "", F.concat_ws(": ", "file_path", "__changed"))
    return files.select("patch_id").distinct().join(found, "patch_id", "left").select("patch_id", F.coalesce("passed", F.lit(True)).alias("passed"), F.coalesce("detail", F.lit("")).alias("detail"))


def syntax_valid(files: DataFrame) -> DataFrame:
    """Per patch: whether every changed Python file parses; parse errors by file in detail."""
    ship(files.sparkSession)
    error = F.udf(lambda s: pyast.parse(s)[1], "string", useArrow=True)
    own = files.where(F.col("file_path").endswith(".py")).withColumn("__error", error(F.coalesce("new_source", F.lit(""))))
    return _fold(own, F.col("__error").isNotNull(), F.concat_ws(": ", "file_path", "__error"))


def dependency_changed(files: DataFrame, anywhere: bool = False) -> DataFrame:
    """Per patch: passed unless a dependency file at the root (or, if asked, anywhere) changed; those in fixed order."""
    name = F.element_at(F.split("file_path", "/"), -1) if anywhere else F.col("file_path")
    hit = F.collect_set(F.when(name.isin(*tx.DEPENDENCY_FILES), name))
    ordered = F.filter(F.array(*map(F.lit, tx.DEPENDENCY_FILES)), lambda d: F.array_contains(F.col("__hit"), d))
    own = files.groupBy("patch_id").agg(hit.alias("__hit"))
    return own.select("patch_id", (F.size("__hit") == 0).alias("passed"), F.array_join(ordered, ", ").alias("detail"))


def no_unused_code(files: DataFrame, lint: DataFrame | None = None) -> DataFrame:
    """Per patch: no unused import or variable on an added line. lint: patch_id, line (`path:line:col: message`) of a linter;
    without one the names that sources bind and use are looked at themselves (see names.unused_names)."""
    if lint is None:
        unused = unused_names(files).select("patch_id", "file_path", F.col("line").alias("n"), "message")
    else:
        parsed = lint.select("patch_id", tx.lint_finding(F.col("line")).alias("f")).where("f is not null").select("patch_id", F.col("f.path").alias("file_path"), F.col("f.line").alias("n"), F.col("f.message").alias("message"))
        unused = parsed.where(F.contains("message", F.lit("imported but unused")) | F.contains("message", F.lit("assigned to but never used")))
    own = files.select("patch_id", "file_path", tx.added_ranges(F.col("diff_text")).alias("ranges")).join(unused, ["patch_id", "file_path"], "left")
    bad = F.coalesce(in_ranges(F.col("n"), F.col("ranges")), F.lit(False))
    return _fold(own, bad, F.concat_ws(":", "file_path", F.col("n").cast("string"), "message"))


def test_files(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Each source file with its test file by convention, the first of three places that exists; null where none does."""
    parts = F.split("file_path", "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    name = F.concat(F.lit("test_"), F.element_at(parts, -1))
    path = lambda *p: F.array_join(F.filter(F.array(*p), lambda x: x != ""), "/")
    places = F.array(path(F.lit("tests"), folder, name), path(folder, F.lit("tests"), name), path(folder, name))
    found = first_existing(files, places, existing.select(F.col("file_path").alias("test_file")), "test_file", "file_path")
    return found


def scope_check(files: DataFrame, issues: DataFrame, repo: DataFrame, root: str) -> DataFrame:
    """Per patch: whether every changed file is named in the issue; null where no file can be told from the text.

    files: patch_id, file_path. issues: patch_id, issue_text. repo: file_path of all repository files. root: the
    component that full paths are cut at.
    """
    named = issues.select("patch_id", F.explode(tx.referenced_paths(F.coalesce("issue_text", F.lit("")))).alias("raw")).select("patch_id", tx.canonical_path(F.col("raw"), root).alias("named")).where("named is not null").distinct()
    real = unique_suffix_match(named, repo.select(F.col("file_path").alias("__real")), "named", "__real").select("patch_id", F.col("__real").alias("file_path")).distinct()
    judged = real.groupBy("patch_id").agg(F.count(F.lit(1)).alias("__n"))
    outside = files.select("patch_id", "file_path").distinct().join(real, ["patch_id", "file_path"], "left_anti").groupBy("patch_id").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("outside"))
    out = issues.select("patch_id").distinct().join(judged, "patch_id", "left").join(outside, "patch_id", "left")
    return out.select("patch_id", F.when(F.col("__n").isNotNull(), F.col("outside").isNull()).alias("passed"), F.when(F.col("__n").isNotNull(), F.coalesce("outside", F.lit(""))).otherwise("no file can be told from the issue").alias("detail"))


CALL = "struct<owner:string,name:string>"
HANDLER = f"struct<line:int,caught:array<string>,raises:boolean,calls:array<{CALL}>>"
FUNCTION = f"struct<place:int,name:string,qualname:string,line:int,end_line:int,has_try:boolean,calls:array<{CALL}>,tries:array<struct<line:int,raises:boolean,handlers:array<{HANDLER}>>>>"


def _named_like(owner: Column, names) -> Column:
    """Whether one of the names is a part of an owner."""
    return F.coalesce(F.lower(owner).rlike("|".join(names)), F.lit(False))


def _tail(a: Column, b: Column) -> Column:
    """What of array a lies beyond the length of b."""
    return F.slice(a, F.size(b) + 1, F.greatest(F.size(a) - F.size(b), F.lit(0)))


def _paired(a: Column, b: Column) -> Column:
    """Elements of two arrays by their place, as far as both go."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def _finding(kind: str, line: Column, *detail) -> Column:
    return F.struct(F.lit(kind).alias("kind"), line.alias("line"), F.concat(*(F.lit(d) if isinstance(d, str) else d for d in detail)).alias("detail"))


def _caught(handler: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(handler["caught"], ", "), F.lit("]"))


def _loudest(handler: Column) -> Column:
    """(rank, place, name) of the logging call with the highest rank in a handler, the first of equal ones; null for none."""
    rank = F.create_map(*(F.lit(x) for pair in pyast.SEVERITY.items() for x in pair))
    logged = F.filter(handler["calls"], lambda c: c["owner"].isNotNull() & rank[c["name"]].isNotNull() & _named_like(c["owner"], pyast.LOGGER_NAMES))
    return F.array_max(F.transform(logged, lambda c, i: F.struct(rank[c["name"]].alias("rank"), (-i).alias("place"), c["name"].alias("name"))))


def _broadened(old: Column, new: Column) -> Column:
    """Whether new names catch all that the old ones do and more. Names that are no builtin exceptions compare with none."""
    above = F.create_map(*(x for name, names in pyast.exception_ancestors().items() for x in (F.lit(name), F.array(*map(F.lit, names)))))
    bare = lambda names: F.array_contains(names, "*")
    known = lambda names: F.forall(names, lambda x: above[x].isNotNull())
    within = lambda p, q: F.forall(p, lambda x: F.exists(q, lambda y: F.array_contains(above[x], y)))
    return F.when(bare(old) | bare(new), bare(new) & ~bare(old)).when(known(old) & known(new), within(old, new) & ~within(new, old)).otherwise(False)


def _weakened(old: Column, new: Column) -> Column:
    """Findings (kind, line, detail) of a function that both sides have, from its facts."""
    blocks = _paired(old["tries"], new["tries"])
    handlers = F.flatten(F.transform(blocks, lambda p: _paired(p["a"]["handlers"], p["b"]["handlers"])))
    logs = F.transform(handlers, lambda h: F.struct(_loudest(h["a"]).alias("was"), _loudest(h["b"]).alias("now"), h["b"]["line"].alias("line")))
    logs = F.filter(logs, lambda x: x["was"].isNotNull() & (x["now"].isNull() | (x["now"]["rank"] < x["was"]["rank"])))
    return F.concat(
        F.transform(_tail(old["tries"], new["tries"]), lambda t: _finding("removed_try_block", t["line"], "the block's body runs unguarded")),
        F.flatten(F.transform(blocks, lambda p: F.transform(_tail(p["a"]["handlers"], p["b"]["handlers"]), lambda h: _finding("removed_except_clause", h["line"], "no handler in the place of ", _caught(h))))),
        F.transform(F.filter(handlers, lambda h: h["a"]["raises"] & ~h["b"]["raises"]), lambda h: _finding("removed_raise", h["b"]["line"], _caught(h["a"]), " was raised again and is swallowed")),
        F.transform(logs, lambda x: F.when(x["now"].isNull(), _finding("error_logging_removed", x["line"], x["was"]["name"], " was logged, nothing is")).otherwise(_finding("error_logging_downgraded", x["line"], "from ", x["was"]["name"], " to ", F.coalesce(x["now"]["name"], F.lit(""))))),
        F.transform(F.filter(handlers, lambda h: _broadened(h["a"]["caught"], h["b"]["caught"])), lambda h: _finding("broadened_except", h["b"]["line"], "from ", _caught(h["a"]), " to ", _caught(h["b"]))),
        F.transform(F.filter(blocks, lambda p: p["a"]["raises"] & ~p["b"]["raises"]), lambda p: _finding("removed_raise", p["b"]["line"], "the guarded body raised and no longer does")),
    )


def _unguarded(new: Column, path: Column) -> Column:
    """Findings of a function that the old side lacks: risky calls without any try, outside test files."""
    risky = F.filter(new["calls"], lambda c: F.when(c["owner"].isNull(), c["name"] == "open").otherwise(c["name"].isin(*sorted(pyast.RISKY_METHODS)) & _named_like(c["owner"], pyast.RISKY_OWNERS)))
    names = F.array_sort(F.array_distinct(F.transform(risky, lambda c: c["name"])))
    found = F.array(_finding("missing_error_handling_new_code", new["line"], "calls ", F.array_join(names, ", "), " without any try"))
    return F.when((F.size(names) > 0) & ~new["has_try"] & ~tx.is_test_file(F.regexp_replace(path, r"\\", "/"), "folder"), found).otherwise(F.slice(found, 1, 0))


def error_handling(files: DataFrame, by_qualname: bool = False) -> DataFrame:
    """Per file: signal, findings (kind, location, detail) in their order, and the parse error where there is one.

    Facts of functions are rows: the old side's and the touched ones of the new side meet by file and name (the bare
    name, of several old ones the first in breadth-first order; or the qualified one), try blocks and handlers by their
    places, and what was lost is told by expressions. A hunk without new lines gives an empty range, so a pure deletion
    without context touches no function.
    """
    ship(files.sparkSession)

    def facts(old, new):
        before, error = pyast.function_facts(old)
        after, other = pyast.function_facts(new)
        return {"old": [] if other else before, "new": [] if error else after, "error": error or other}

    udf = F.udf(facts, f"old array<{FUNCTION}>, new array<{FUNCTION}>, error string", useArrow=True)
    ranges = tx.added_ranges(F.col("diff_text"), drop_empty=False)
    own = files.select("patch_id", "file_path", ranges.alias("ranges"), udf(F.coalesce("old_source", F.lit("")), F.coalesce("new_source", F.lit(""))).alias("f"), F.monotonically_increasing_id().alias("file"))
    touched = F.filter("f.new", lambda n: F.exists("ranges", lambda r: (r["start"] <= n["end_line"]) & (r["end"] >= n["line"]) & (r["start"] <= r["end"])))
    wanted = F.array_distinct(F.transform(touched, lambda n: n["qualname" if by_qualname else "name"]))
    known = F.filter("f.old", lambda o: F.array_contains(wanted, o["qualname" if by_qualname else "name"]))
    side = lambda functions, name: F.transform(functions, lambda x: F.struct(x.alias("x"), F.lit(name).alias("side")))
    rows = own.select("file", "patch_id", "file_path", F.col("f.error").alias("error"), F.explode_outer(F.concat(side(known, "old"), side(touched, "new"))).alias("s"))
    name = F.col("s.x.qualname" if by_qualname else "s.x.name")
    met = rows.groupBy("file", name.alias("name")).agg(
        F.first("patch_id").alias("patch_id"), F.first("file_path").alias("file_path"), F.first("error").alias("error"),
        F.min_by(F.when(F.col("s.side") == "old", F.col("s.x")), F.when(F.col("s.side") == "old", F.col("s.x.place"))).alias("old"), F.collect_list(F.when(F.col("s.side") == "new", F.col("s.x"))).alias("new"),
    )
    each = met.select("file", "patch_id", "file_path", "error", "old", F.explode_outer("new").alias("new"))
    found = F.when(F.col("new").isNull(), F.array().cast("array<struct<kind:string,line:int,detail:string>>")).when(F.col("old").isNull(), _unguarded(F.col("new"), F.coalesce("file_path", F.lit("")))).otherwise(_weakened(F.col("old"), F.col("new")))
    found = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), F.concat(F.col("new.name"), F.lit(":L"), x["line"].cast("string")).alias("location"), x["detail"].alias("detail")))
    each = each.select("file", "patch_id", "file_path", "error", F.struct(F.col("new.place").alias("place"), found.alias("found")).alias("own"))
    out = each.groupBy("file").agg(F.first("patch_id").alias("patch_id"), F.first("file_path").alias("file_path"), F.first("error").alias("error"), F.flatten(F.array_sort(F.collect_list("own"))["found"]).alias("findings"))
    return out.select("patch_id", "file_path", (F.size("findings") > 0).alias("signal"), "findings", "error")
