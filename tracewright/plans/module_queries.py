"""Names and imports of modules that are made of the words of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import models, names, patches
from tracewright.plans import query
from tracewright.plans.retrieval_queries import bm25_of, top_of
from tracewright.plans.sources_of_text import Module
from tracewright.plans.text_queries import CHUNKS_SQL, code_files
from tracewright.plans.trace_queries import table
from tracewright.session import cut
from tracewright.sources import issues

#: Imports and variables that are used or not.
NAMES = Module(
    "import os\n\n",
    (
        "# {w}", "import {w}{i}", "def f{i}(a):\n    {w}{i} = a\n    return {w}{i}", "def g{i}(a):\n    {w}{i} = a\n    return a", "from os import {w} as v{i}\nprint(v{i})",
        "def h{i}():\n    import {w}\n    def k():\n        return {w}.x\n    return k", "class C{i}:\n    import {w}\n    def m(self):\n        return {w}",
    ),
)
#: Lines of a module that a patch added.
ADDED = 400


@query(
    "unused_names",
    f"""
    WITH {NAMES.pieces_sql()},
    u AS (SELECT doc_id, line AS n, '''' || w || i || ''' imported but unused' AS m FROM p WHERE k = 1 UNION ALL SELECT doc_id, line + 1, 'local variable ''' || w || i || ''' is assigned to but never used' FROM p WHERE k = 3
          UNION ALL SELECT doc_id, line + 1, '''' || w || ''' imported but unused' FROM p WHERE k = 6 UNION ALL SELECT doc_id, 1, '''os'' imported but unused' FROM documents),
    b AS (SELECT doc_id, list_sort(list('src/m' || doc_id || '.py:' || n || ':' || m)) AS d FROM u WHERE n <= {ADDED} GROUP BY doc_id)
    SELECT doc_id AS patch_id, d IS NULL AS passed, coalesce(array_to_string(d, '; '), '') AS detail FROM documents LEFT JOIN b USING (doc_id)
    """,
)
def unused_names(spark, sf_dir):
    """No linter is asked; the names that sources bind and use are looked at."""
    n = F.col("doc_id").cast("string")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("patch_id"), F.concat(F.lit("src/m"), n, F.lit(".py")).alias("file_path"), NAMES.source(F.col("text")).alias("new_source"), F.lit(f"@@ -1 +1,{ADDED} @@\n").alias("diff_text"))
    return patches.no_unused_code(files)


#: A package of three files: what __init__ passes on from defs, and what is imported from it.
DEFS = Module("", ("# {w}", "def {w}{i}():\n    return {n}", "# {w}", "def {w}{i}():\n    return {n}", "class {w}{i}:\n    pass"))
INIT = Module("", ("# {w}", "from .defs import {w}{i}", "from .defs import {w}{i}", "# {w}", "from . import defs as {w}{i}"))
USER = Module("import os.path\n", ("# {w}", "from pkg import {w}{i}", "from pkg import {w}{i}", "from pkg import {w}{i}", "from pkg import {w}{i}, nothing{i} as x"))


@query(
    "imports_resolve",
    f"""
    WITH {DEFS.pieces_sql("d")}, {INIT.pieces_sql("n")}, {USER.pieces_sql("u")},
    bad AS (SELECT doc_id, 'lib/pkg/__init__.py:' || line || ': pkg.defs.' || w || i AS l FROM n WHERE k = 2 UNION ALL SELECT doc_id, 'lib/use/u.py:' || line || ': pkg.' || w || i FROM u WHERE k IN (2, 3)
            UNION ALL SELECT doc_id, 'lib/use/u.py:' || line || ': pkg.nothing' || i FROM u WHERE k = 4),
    b AS (SELECT doc_id, array_to_string(list_sort(list(l)), '; ') AS detail FROM bad GROUP BY doc_id), j AS (SELECT DISTINCT doc_id FROM u WHERE k > 0)
    SELECT d.doc_id AS patch_id, CASE WHEN detail IS NOT NULL THEN false WHEN j.doc_id IS NOT NULL THEN true END AS passed, coalesce(detail, '') AS detail
    FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id
    """,
)
def imports_resolve(spark, sf_dir):
    """The project's file is in lib, so names of modules begin below it."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    file = lambda path, source: F.struct(F.lit(path).alias("file_path"), source.alias("source"), F.lit(path.endswith(("u.py", "__init__.py"))).alias("changed"))
    files = F.array(file("lib/setup.py", F.lit("")), file("lib/pkg/__init__.py", INIT.source(t)), file("lib/pkg/defs.py", DEFS.source(t)), file("lib/use/u.py", USER.source(t)))
    return names.imports_resolve(d.select(F.col("doc_id").alias("patch_id"), F.explode(files).alias("f")).select("patch_id", "f.*"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts():
    """Stands for an embedding model: how often each letter occurs."""
    return lambda texts: [[float(t.lower().count(c)) for c in LETTERS] for t in texts]


def like_in_length():
    """Stands for a rerank model: texts of like length are alike."""
    return lambda pairs: [-abs(float(len(a) - len(b))) for a, b in pairs]


_COUNTS = lambda t: f"list_transform({list(LETTERS)}, lambda c: (length({t}) - length(replace(lower({t}), c, '')))::DOUBLE)"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


@query(
    "retrieve_chunks",
    f"""
    WITH chunks AS ({CHUNKS_SQL}),
    c AS (SELECT *, doc_of * 1000000 + start_line AS doc, source || ' ' || file_path || ' ' || name AS text FROM (SELECT *, regexp_extract(file_path, '([0-9]+)', 1)::BIGINT AS doc_of FROM chunks)),
    named AS (SELECT doc_of, arg_min(name, start_line) AS f, any_value(file_path) AS p FROM c WHERE name LIKE 'f%' AND type = 'function' AND doc_of % 50 = 0 GROUP BY doc_of),
    asked AS (SELECT doc_of AS query, 'Issue' || chr(10) || chr(10) || 'ValueError: raised in `' || f || '` of `' || p || '`' AS semantic, lower(f || ' ' || p || ' ValueError') AS lexical, p FROM named),
    {bm25_of("SELECT doc AS doc_id, text FROM c", "SELECT query AS item_id, lexical AS text FROM asked")},
    v AS (SELECT doc, {_COUNTS("left(source, 6000)")} AS e FROM c), qv AS (SELECT query, {_COUNTS("semantic")} AS e FROM asked),
    cosines AS (SELECT query, doc, list_inner_product(qv.e, v.e) / ({_NORM("qv.e")} * {_NORM("v.e")}) AS score FROM qv, v),
    both2 AS (SELECT query, doc, d.score AS d, coalesce(l.score, 0) AS l FROM cosines d LEFT JOIN score l USING (query, doc)),
    mm AS (SELECT *, min(d) OVER w AS d0, max(d) OVER w AS d1, min(l) OVER w AS l0, max(l) OVER w AS l1 FROM both2 WINDOW w AS (PARTITION BY query)),
    fused AS (SELECT query, doc, CASE WHEN d1 - d0 < 1e-9 THEN 0 ELSE (d - d0) / (d1 - d0) END + CASE WHEN l1 - l0 < 1e-9 THEN 0 ELSE (l - l0) / (l1 - l0) END + CASE WHEN doc // 1000000 = query THEN 0.25 ELSE 0 END AS score FROM mm),
    pool AS ({top_of("fused", 20, 6)}), again AS (SELECT query, doc, -abs(length(semantic) - length(source))::DOUBLE AS score FROM pool JOIN asked USING (query) JOIN c USING (doc))
    {top_of("again", 5, 6)}
    """,
)
def retrieve_chunks(spark, sf_dir):
    """Issues that name a function and its file ask for chunks of modules made of the words of whole texts."""
    found, _ = patches.chunk_files(code_files(spark, sf_dir), source="new_source")
    number = F.regexp_extract("file_path", "([0-9]+)", 1).cast("long")
    chunks = cut(found.select((number * 1_000_000 + F.col("start_line")).alias("doc"), number.alias("doc_of"), "start_line", "type", "source", "file_path", "name"))  # files are parsed once
    named = chunks.where("name like 'f%' and type = 'function' and doc_of % 50 = 0").groupBy("doc_of").agg(F.min_by("name", "start_line").alias("f"), F.first("file_path").alias("p"))
    body = F.concat(F.lit("ValueError: raised in `"), "f", F.lit("` of `"), "p", F.lit("`"))
    records = named.select(F.col("doc_of").alias("source_id"), F.lit("Issue").alias("title"), body.alias("body"))
    asked = issues.build_query(records, chunks).withColumnRenamed("source_id", "query")
    return models.retrieve_chunks(chunks, asked, letter_counts, like_in_length)
