"""Hooks for models that live outside the engine: a callable over batches, with errors kept per row."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import without_fence
from tracewright.operators.retrieval import EMBED_CHARS
from tracewright.session import cut, ship

RESPONSE = "edits array<struct<chunk_id:string,file_path:string,old_source:string,new_source:string,reasoning:string>>, summary string, insufficient_context boolean, follow_up_query string"


def with_model(frame: DataFrame, factory: Callable[[], Callable[[str], str]], column: str, out: str) -> DataFrame:
    """Adds `out`: (ok, value, error) of a model over a text column. The factory runs once in a task; a failing row is
    a row with an error, never a failing job."""
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))])
    kind = pa.struct([("ok", pa.bool_()), ("value", pa.string()), ("error", pa.string())])

    def run(batches):
        model = None
        for batch in batches:
            model = model or factory()
            rows = []
            for text in batch.column(column).to_pylist():
                try:
                    rows.append({"ok": True, "value": model(text), "error": None})
                except Exception as e:  # whatever a caller's model raises belongs to its row
                    rows.append({"ok": False, "value": None, "error": f"{type(e).__name__}: {e}"})
            yield batch.append_column(out, pa.array(rows, kind))

    return ship_with(frame).mapInArrow(run, schema)


def embedded(frame: DataFrame, factory: Callable[[], Callable[[list[str]], list[list[float]]]], column: str, out: str, at_once: int = 8) -> DataFrame:
    """Adds `out`: the vectors that a model gives for a text column, `at_once` texts a call. The factory runs once in a task."""
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = None
        for batch in batches:
            model = model or factory()
            texts = [x or "" for x in batch.column(column).to_pylist()]
            vectors = [list(map(float, v)) for k in range(0, len(texts), at_once) for v in model(texts[k : k + at_once])]
            yield batch.append_column(out, pa.array(vectors, pa.list_(pa.float64())))

    return ship_with(frame).mapInArrow(run, schema)


def ship_with(frame: DataFrame) -> DataFrame:
    ship(frame.sparkSession)
    return frame


def embedding_text(source: Column) -> Column:
    """What of a chunk an embedding model sees."""
    return F.left(source, F.lit(EMBED_CHARS))


def parse_response(text: Column) -> Column:
    """A model's response as a struct, with or without a fence and with raw control characters; null where it is no JSON."""
    return F.from_json(without_fence(text), RESPONSE, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true", "columnNameOfCorruptRecord": "_bad"})


def new_runs(issues: DataFrame) -> DataFrame:
    """A run of each issue with an id of its own. Ids are random: write the result before using it twice."""
    return issues.select(F.uuid().alias("run_id"), "source_id", F.current_timestamp().alias("started_at"))


def counted(frame: DataFrame, name: str, **conditions: Column):
    """The frame with counters that are filled when it is first written: (frame, observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return frame.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items())), seen


def scored_pairs(pairs: DataFrame, factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], left: str, right: str, out: str = "score", at_once: int = 32) -> DataFrame:
    """Adds `out`: the score that a model gives each pair of texts, `at_once` pairs a call. The factory runs once in a task."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        model = None
        for batch in batches:
            model = model or factory()
            texts = [(a or "", b or "") for a, b in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True)]
            scores = [float(x) for k in range(0, len(texts), at_once) for x in model(texts[k : k + at_once])]
            yield batch.append_column(out, pa.array(scores, pa.float64()))

    return ship_with(pairs).mapInArrow(run, schema)


def retrieve_chunks(chunks: DataFrame, asked: DataFrame, embed: Callable, rerank: Callable, pool: int | None = None, k: int | None = None, places: int = 6) -> DataFrame:
    """(query, doc, score, rank): for each query the k chunks that a rerank model likes best among a pool by hybrid search.

    chunks: doc, source, file_path, name; their source, path and name are searched, and the embedding model sees the beginning
    of the source. asked: query, and semantic, lexical, file_paths as issues.build_query gives them. The rerank model sees
    the pairs of the pool only. Ids are whole numbers; chunks that share one are not told apart. Joins with chunks are
    merged: what Spark takes their sources to measure is far too little, and it would send them all through the driver.
    """
    from tracewright.operators import retrieval, search

    text = F.concat_ws(" ", "source", "file_path", "name")
    docs = chunks.select(F.col("doc").cast("long").alias("doc"), text.alias("text"), F.col("file_path").alias("path"))
    vectors = embedded(chunks.select(F.col("doc").cast("long").alias("doc"), embedding_text(F.col("source")).alias("text")), embed, "text", "vector").select("doc", "vector")
    own = asked.select(F.col("query").cast("long").alias("query"), "semantic", F.col("lexical").alias("text"), F.col("file_paths").alias("paths"))
    queries = cut(embedded(own, embed, "semantic", "vector"))
    pooled = search.hybrid_top(docs, vectors, queries.drop("semantic"), pool or retrieval.POOL, places).select("query", "doc")
    pairs = pooled.join(queries.select("query", "semantic").hint("merge"), "query").join(chunks.select(F.col("doc").cast("long").alias("doc"), "source").hint("merge"), "doc")
    return retrieval.top_k(scored_pairs(pairs, rerank, "semantic", "source").select("query", "doc", "score"), k or retrieval.FINAL, places)


def chunk_prompt(title: Column, body: Column, chunks: Column, retry: Column | None = None) -> Column:
    """What a model is asked: the issue, then its candidate chunks, each with the facts that are there, then why the attempt
    before failed. chunks: an array of rows of patches.chunk_files; retry: (attempt, reason, detail), or null."""

    def block(c):
        lists = lambda name: F.when(F.size(c[name]) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c[name], ", ")))
        filled = lambda name, label: F.when(F.length(c[name]) > 0, F.concat(F.lit(label), c[name]))
        place = F.concat(F.lit("lines: "), c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string"))
        head = F.concat_ws("\n", F.concat(F.lit("chunk_id: "), c["chunk_id"]), F.concat(F.lit("file_path: "), c["file_path"]), place, filled("class_name", "class_name: "), lists("imports"), filled("class_context", "class __init__ context:\n"), lists("decorators"))
        return F.concat(head, F.lit("\n\nsource:\n"), c["source"])

    asked = F.concat(F.lit("ISSUE TITLE: "), F.coalesce(title, F.lit("")), F.lit("\n\nISSUE BODY:\n"), F.coalesce(body, F.lit("")), F.lit("\n\n=== CANDIDATE CHUNKS ===\n\n"), F.coalesce(F.array_join(F.transform(chunks, block), "\n\n---\n\n"), F.lit("")))
    if retry is None:
        return asked
    again = F.concat(
        F.lit("\n\n=== PREVIOUS ATTEMPT FAILED ===\nThis is retry attempt "), retry["attempt"].cast("string"), F.lit(".\nFailure reason: "), retry["reason"], F.lit("\nDetail: "), retry["detail"],
        F.lit("\nDo not repeat the same old_source that was rejected. Address the specific reason above before proposing a fix."),
    )
    return F.concat(asked, F.coalesce(again, F.lit("")))
