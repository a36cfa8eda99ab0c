"""Unused names and imports that lead nowhere, from facts about source: joins up the scope chain and over the module graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.pynames import name_facts
from tracewright.session import cut, ship

FACTS = (
    "scopes array<struct<scope:int,kind:string,chain:array<int>>>, bindings array<struct<scope:int,name:string,line:int,col:int,what:string,label:string>>, uses array<struct<scope:int,name:string>>, "
    "imports array<struct<scope:int,line:int,level:int,module:string,name:string,bound:string>>, error string"
)
FILE = ["patch_id", "file_path"]
ROOT_FILES = ("pyproject.toml", "setup.py")


def facts_of(files: DataFrame, source: str = "new_source") -> DataFrame:
    """files with a column facts; each source is parsed once."""
    ship(files.sparkSession)
    return files.withColumn("facts", F.udf(name_facts, FACTS, useArrow=True)(F.coalesce(source, F.lit(""))))


def unused_names(files: DataFrame) -> DataFrame:
    """(patch_id, file_path, line, col, message): imports that nothing uses, and local variables that are assigned only.

    A use belongs to the nearest scope of its chain that binds the name. All bindings of a used name in its scope count as
    used, whatever their order; names in __all__ are used. Variables are looked at in functions only, and not where locals()
    is called; those of tuples, loops and walrus expressions may stay unused. Sources that don't parse have no names.
    """
    known = cut(facts_of(files).select(*FILE, "facts.scopes", "facts.bindings", "facts.uses"))
    bindings = known.select(*FILE, F.inline("bindings"))
    scopes = known.select(*FILE, F.inline("scopes"))
    uses = known.select(*FILE, F.inline("uses")).join(scopes.select(*FILE, "scope", "chain"), [*FILE, "scope"])
    looked = uses.select(*FILE, F.col("scope").alias("at"), "name", F.posexplode("chain").alias("far", "scope"))
    found = looked.join(bindings.select(*FILE, "scope", "name").distinct(), [*FILE, "scope", "name"])
    used = found.groupBy(*FILE, "at", "name").agg(F.min_by("scope", "far").alias("scope")).select(*FILE, "scope", "name").distinct()
    open_scopes = uses.where("name = 'locals'").select(*FILE, "scope").distinct()
    left = bindings.where("what <> 'other'").join(used, [*FILE, "scope", "name"], "left_anti").join(scopes.select(*FILE, "scope", "kind"), [*FILE, "scope"])
    imports = left.where("what = 'import'").withColumn("message", F.concat(F.lit("'"), "label", F.lit("' imported but unused")))
    variables = left.where("what = 'except' or (what = 'assign' and kind = 'function' and name <> '_')").join(open_scopes, [*FILE, "scope"], "left_anti")
    variables = variables.withColumn("message", F.concat(F.lit("local variable '"), "name", F.lit("' is assigned to but never used")))
    return imports.unionByName(variables).select(*FILE, "line", "col", "message")


def _dotted(*parts) -> F.Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), ".")


def module_names(tree: DataFrame) -> DataFrame:
    """The Python files of a tree (patch_id, file_path, ...) with root (the nearest folder above that has a project file, or the
    tree's own, an empty text), module (dotted name below the root) and package (that relative imports start from)."""
    parts = F.split("file_path", "/")
    folder = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    roots = tree.where(F.element_at(parts, -1).isin(*ROOT_FILES)).select("patch_id", folder(F.size(parts) - 1).alias("root")).distinct()
    own = tree.where(F.col("file_path").endswith(".py"))
    above = own.select(*FILE, F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), folder)).alias("depth", "root"))
    nearest = above.join(roots, ["patch_id", "root"], "left_semi").groupBy(*FILE).agg(F.max_by("root", "depth").alias("root"))
    named = own.join(nearest, FILE, "left").withColumn("root", F.coalesce("root", F.lit("")))
    path = F.when(F.col("root") == "", F.col("file_path")).otherwise(F.substring(F.col("file_path"), F.length("root") + 2, F.length("file_path")))
    named = named.withColumn("is_package", path.rlike(r"(^|/)__init__\.py$"))
    named = named.withColumn("module", F.replace(F.regexp_replace(path, r"(/__init__|^__init__)?\.py$", ""), F.lit("/"), F.lit(".")))
    return named.withColumn("package", F.when(F.col("is_package"), F.col("module")).otherwise(F.regexp_replace("module", r"(^|\.)[^.]*$", ""))).drop("is_package")


def unresolved_imports(tree: DataFrame) -> DataFrame:
    """(patch_id, file_path, line, imported) of imports in changed files that no file of the tree gives.

    tree: patch_id, file_path, source, changed: all files of a patch's repository. An import is judged if it is relative, or
    if its first part is a module of the same root; others come from elsewhere. `from m import n` needs a module m, and there a
    module m.n or a name n; a name that m itself imports is followed, and so are star imports: a frontier of (module, name)
    moves along re-exports until it finds a definition or has been everywhere. Modules with a __getattr__ give every name.
    """
    return _unresolved(_module_facts(tree))


def _module_facts(tree: DataFrame) -> DataFrame:
    """What is asked of each file of a tree, from one parse of it."""
    own = F.filter("facts.bindings", lambda b: (b["scope"] == 0) & (b["what"] != "import"))
    return cut(facts_of(module_names(tree), "source").select(*FILE, "changed", "root", "module", "package", "facts.imports", own.alias("own"), "facts.error"))


def _unresolved(files: DataFrame) -> DataFrame:
    on = ["patch_id", "root"]
    modules = cut(files.select(*on, "module").distinct())
    packages = modules.select(*on, F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("module", r"\."))), lambda i: F.array_join(F.slice(F.split("module", r"\."), 1, i), "."))).alias("module")).where("module <> ''").distinct()
    modules = cut(modules.unionByName(packages).distinct())  # a folder without __init__ is a package too
    tops = modules.select(*on, F.split("module", r"\.")[0].alias("top")).distinct()
    defined = files.select(*on, "module", F.explode("own.name").alias("name")).distinct()
    depth = F.when(F.col("package") == "", 0).otherwise(F.size(F.split("package", r"\.")))
    base = F.array_join(F.slice(F.split("package", r"\."), F.lit(1), F.greatest(depth - F.col("level") + 1, F.lit(0))), ".")
    target = F.when(F.col("level") == 0, F.col("target")).when(depth - F.col("level") + 1 < 0, "..").otherwise(_dotted(base, F.col("target")))
    facts = files.select(*FILE, "changed", "root", F.col("module").alias("home"), "package", F.inline("imports")).withColumnRenamed("module", "target")
    facts = cut(facts.withColumn("target", target))
    top = F.split("target", r"\.")[0]
    judged = facts.where("changed").withColumn("top", top).join(tops.withColumn("inside", F.lit(True)), [*on, "top"], "left").where("inside or level > 0")
    judged = cut(judged.select(*FILE, "root", "line", "target", "name", F.monotonically_increasing_id().alias("fact")))
    # re-exports: what a module's own top-level imports give it
    first = F.split("target", r"\.")[0]
    leads_to = F.when(F.col("name").isNull() & (F.col("bound") == first), first).otherwise(F.col("target"))
    given = facts.where("scope = 0 and bound <> '*'").select(*on, F.col("home").alias("module"), F.col("bound").alias("name"), leads_to.alias("next"), F.col("name").alias("next_name"))
    stars = facts.where("scope = 0 and bound = '*'").select(*on, F.col("home").alias("module"), F.col("target").alias("next"))
    given, stars, defined = cut(given), cut(stars), cut(defined)
    frontier = seen = judged.select("fact", *on, F.col("target").alias("module"), "name")
    good = []
    while not frontier.isEmpty():
        there = frontier.join(modules, [*on, "module"], "left_semi")
        whole = there.where("name is null or name = '*'")
        one = there.where("name is not null and name <> '*'")
        as_module = one.withColumn("full", _dotted(F.col("module"), F.col("name"))).join(modules.withColumnRenamed("module", "full"), [*on, "full"], "left_semi")
        as_name = one.join(defined, [*on, "module", "name"], "left_semi")
        anything = one.join(defined.where("name = '__getattr__'").select(*on, "module"), [*on, "module"], "left_semi")
        good.append(cut(reduce(DataFrame.unionByName, (f.select("fact") for f in (whole, as_module, as_name, anything))).distinct()))
        left = one.join(good[-1], "fact", "left_anti")
        by_name = left.join(given, [*on, "module", "name"]).select("fact", *on, F.col("next").alias("module"), F.col("next_name").alias("name"))
        elsewhere = by_name.withColumn("top", F.split("module", r"\.")[0]).join(tops, [*on, "top"], "left_anti").select("fact").distinct()  # from outside the tree
        good.append(cut(elsewhere))
        by_star = left.join(stars, [*on, "module"]).select("fact", *on, F.col("next").alias("module"), "name")
        moved = by_name.unionByName(by_star).distinct()
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("fact", "patch_id", "root", "module", "name")]
        frontier = cut(moved.alias("a").join(seen.alias("b"), reduce(lambda x, y: x & y, same), "left_anti"))
        seen = cut(seen.unionByName(frontier))
    found = reduce(DataFrame.unionByName, good).distinct() if good else judged.select("fact").limit(0)
    bad = judged.join(found, "fact", "left_anti")
    return bad.select(*FILE, "line", F.concat_ws(".", F.when(F.col("target") != "", F.col("target")), "name").alias("imported"))


def imports_resolve(tree: DataFrame) -> DataFrame:
    """Per patch: whether all judged imports of its changed files are given by a file of the tree; null where none is judged
    and all changed files parse. A changed file that doesn't parse does not import."""
    files = _module_facts(tree)
    broken = files.where("changed and error is not null").select("patch_id", F.concat_ws(": ", "file_path", "error").alias("label"))
    bad = _unresolved(files).select("patch_id", F.concat(F.col("file_path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), "imported").alias("label"))
    wrong = bad.unionByName(broken).groupBy("patch_id").agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("detail"))
    tops = files.select("patch_id", "root", F.split("module", r"\.")[0].alias("top")).distinct()
    own = files.where("changed").select("patch_id", "root", F.explode("imports").alias("i")).select("patch_id", "root", F.split("i.module", r"\.")[0].alias("top"), "i.level")
    judged = own.join(tops.withColumn("inside", F.lit(True)), ["patch_id", "root", "top"], "left").where("inside or level > 0").select("patch_id").distinct().withColumn("judged", F.lit(True))
    out = tree.select("patch_id").distinct().join(wrong, "patch_id", "left").join(judged, "patch_id", "left")
    return out.select("patch_id", F.when(F.col("detail").isNotNull(), False).when(F.col("judged"), True).alias("passed"), F.coalesce("detail", F.lit("")).alias("detail"))
