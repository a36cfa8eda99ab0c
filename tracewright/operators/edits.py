"""Checks of proposed edits against retrieved chunks and current files, and their application; no files are written.

The order of checks decides which failure is reported: insufficient context, shape, grounding, guardrail, clean
worktree, staleness. Each check is a column over all edits; a patch's outcome is the first failure in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators import guardrail


def grounding(old: Column, source: Column) -> Column:
    """grounded, repaired (exact once a comment is taken out), comment, whitespace or hallucinated; null without source."""
    bare = tx.without_comments(old)
    commented = bare != old
    plain = tx.one_space(source)
    return (
        F.when(source.isNull(), F.lit(None))
        .when(F.contains(source, old), "grounded")
        .when(commented & F.contains(source, bare), "repaired")
        .when(commented & F.contains(plain, tx.one_space(bare)), "comment")
        .when(F.contains(plain, tx.one_space(old)), "whitespace")
        .otherwise("hallucinated")
    )


def repaired(old: Column, source: Column) -> Column:
    """What an edit looks for: itself, or without the comments where that alone makes it exact."""
    return F.when(grounding(old, source) == "repaired", tx.without_comments(old)).otherwise(old)


def staleness(old: Column, current: Column) -> Column:
    """apply where the current text has old exactly once; missing, ambiguous, or empty (which fits anywhere) otherwise."""
    n = tx.occurrences(current, old)
    return F.when(old == "", "empty").when(current.isNull() | (n == 0), "missing").when(n > 1, "ambiguous").otherwise("apply")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk ids may repeat: of each the first by position."""
    return chunks.groupBy("source_id", "chunk_id").agg(F.min_by("source", "pos").alias("chunk_source"))


def apply_in_order(text: Column, edits: Column) -> Column:
    """A text with all edits (old, new) applied one after another, each at its first occurrence."""
    return F.aggregate(edits, text, lambda acc, e: tx.replace_first(acc, e["old"], e["new"]))


def group_by_file(edits: DataFrame) -> DataFrame:
    """Edits (patch_id, file_path, pos, old, new) of each file as an array in their order."""
    kept = F.sort_array(F.collect_list(F.struct("pos", "old", "new")))
    return edits.groupBy("patch_id", "file_path").agg(kept.alias("edits"))


def evaluate(edits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Per patch: applied, failure_reason, detail and auto_repaired chunk ids.

    edits: patch_id, source_id, pos, chunk_id, file_path, old_source, new_source, keys (those that the edit has),
    insufficient_context, clean (of the patch's worktree). chunks: source_id, chunk_id, pos, source. files: patch_id,
    file_path, text. Of several failing edits the first by position is reported.
    """
    own = edits.join(first_chunks(chunks), ["source_id", "chunk_id"], "left").join(files, ["patch_id", "file_path"], "left")
    lacking = F.array_except(F.array(*map(F.lit, ("chunk_id", "file_path", "old_source", "new_source"))), F.col("keys"))
    ground = F.coalesce(grounding(F.col("old_source"), F.col("chunk_source")), F.lit("unknown_chunk"))
    own = own.withColumns({"lacking": F.array_join(F.array_sort(lacking), ", "), "ground": ground, "wanted": repaired(F.col("old_source"), F.col("chunk_source"))})
    own = guardrail.scan(own, "new_source").withColumn("stale", staleness(F.col("wanted"), F.col("text")))
    checks = [
        ("insufficient_context", F.col("insufficient_context"), F.lit("")),
        ("malformed_edit", F.col("lacking") != "", F.concat(F.lit("missing "), F.col("lacking"))),
        ("malformed_edit", ~F.col("ground").isin("grounded", "repaired"), F.col("ground")),
        ("unsafe_pattern_detected", F.col("tripped"), F.concat_ws(": ", "category", "detail")),
        ("dirty_worktree", ~F.coalesce("clean", F.lit(True)), F.lit("")),
        ("stale_chunks", F.col("stale") != "apply", F.col("stale")),
    ]
    failed = [F.when(bad, F.struct(F.lit(rank).alias("rank"), F.col("pos").alias("pos"), F.lit(reason).alias("reason"), detail.alias("detail"))) for rank, (reason, bad, detail) in enumerate(checks)]
    first = F.min(F.array_min(F.array_compact(F.array(*failed))))
    fixed = F.array_sort(F.collect_set(F.when(F.col("ground") == "repaired", F.col("chunk_id"))))
    out = own.groupBy("patch_id").agg(first.alias("f"), fixed.alias("auto_repaired"))
    return out.select("patch_id", F.col("f").isNull().alias("applied"), F.col("f.reason").alias("failure_reason"), F.coalesce("f.detail", F.lit("")).alias("detail"), "auto_repaired")
