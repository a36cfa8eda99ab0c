"""Issue records from raw API rows: normalising, linked fixes, comments, incremental collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.operators.joins import any_suffix_match
from tracewright.sources.sinks import read_checkpoint, write_checkpoint


def linked_fix(timeline: Column) -> Column:
    """(number) of the first merged pull request that a timeline cross-references; null where there is none.

    timeline: array of (event, source: (issue: (number, pull_request: (merged_at)))).
    """
    hits = F.filter(timeline, lambda e: (e["event"] == "cross-referenced") & e["source"]["issue"]["pull_request"]["merged_at"].isNotNull() & e["source"]["issue"]["number"].isNotNull())
    return F.get(hits, F.lit(0))["source"]["issue"]["number"]


def comments_of(raw: Column) -> Column:
    """Comments with defaults for what is missing."""
    return F.transform(F.coalesce(raw, F.array().cast("array<struct<user:struct<login:string>,body:string,created_at:string>>")), lambda c: F.struct(
        F.coalesce(c["user"]["login"], F.lit("unknown")).alias("author"), F.coalesce(c["body"], F.lit("")).alias("body"), F.coalesce(c["created_at"], F.lit("")).alias("created_at")))


def normalize(raw: DataFrame, source: str, repository: str) -> DataFrame:
    """Issue records; issues without a merged linked fix go."""
    fix = linked_fix(F.col("timeline"))
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    return raw.withColumn("__fix", fix).where("__fix is not null").select(
        F.lit(source).alias("source"), F.col("number").cast("string").alias("source_id"), text("title").alias("title"), text("body").alias("body"), text("state", "closed").alias("state"),
        F.transform(F.coalesce("labels", F.array().cast(raw.schema["labels"].dataType)), lambda x: x["name"]).alias("labels"), "created_at", F.col("closed_at").alias("closed_At"), F.col("__fix").cast("string").alias("linked_fix_id"),
        F.concat(F.lit(f"https://github.com/{repository}/pull/"), F.col("__fix").cast("string"), F.lit(".diff")).alias("linked_fix_diff_url"), comments_of(F.col("comments")).alias("comments"), text("html_url").alias("url"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_At"),
    )


def not_collected(raw: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Issues that are no pull requests and whose number is not in the checkpoint; most recently updated first if limited."""
    new = raw.where(F.col("pull_request").isNull()).join(done, raw["number"].cast("string") == done["source_id"], "left_anti")
    return new if limit is None else new.orderBy(F.col("updated_at").desc(), "number").limit(limit)


def page(raw: DataFrame, number: int, rows: int = 50) -> DataFrame:
    """A page of raw issues, 0 the first, the most recently updated first."""
    return raw.orderBy(F.col("updated_at").desc(), "number").offset(number * rows).limit(rows)


def collect_new(raw: DataFrame, source: str, repository: str, checkpoint: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, skipped) of issues that are not in the checkpoint, which has them from then on.

    The checkpoint is written before records are given out, so an issue is given out once at most. Skipped rows
    (source_id, error) have no number or no merged fix; the latter are not looked at again either.
    """
    spark = raw.sparkSession
    done = read_checkpoint(spark, checkpoint)
    new = not_collected(raw.where("number is not null"), done, limit).select(F.col("number").cast("string").alias("source_id"))
    write_checkpoint(done.unionByName(new), checkpoint)
    taken = read_checkpoint(spark, checkpoint).join(done, "source_id", "left_anti")
    own = raw.join(taken, raw["number"].cast("string") == taken["source_id"], "left_semi")
    skipped = own.where(linked_fix(F.col("timeline")).isNull()).select(F.col("number").cast("string").alias("source_id"), F.lit("no merged fix").alias("error"))
    unnumbered = raw.where("number is null").select(F.lit(None).cast("string").alias("source_id"), F.lit("no number").alias("error"))
    return normalize(own, source, repository), skipped.unionByName(unnumbered)


def build_query(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """What retrieval asks for each issue: semantic text, identifiers, file_paths, exception_types, and lexical, all of the
    last three one after another (words in several of them count again).

    records: source_id, title, body. chunks: name, file_path. Of the names in backticks those stay that a chunk has, of the
    paths those that a chunk's path ends in or that end in it; the chunk's path is given, the least of several.
    """
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    own = records.select("source_id", tx.semantic_text(F.col("title"), F.col("body")).alias("semantic"), tx.exception_types(text).alias("exception_types"))
    named = records.select("source_id", F.explode(tx.identifiers(text)).alias("name")).join(chunks.select("name").distinct().hint("merge"), "name", "left_semi")
    paths = records.select("source_id", F.explode(tx.python_paths(text)).alias("candidate"))
    known = any_suffix_match(paths.select("candidate").distinct(), chunks.select("file_path").distinct(), "candidate", "file_path")
    by_name = named.groupBy("source_id").agg(F.array_sort(F.collect_set("name")).alias("identifiers"))
    by_path = paths.join(known.hint("merge"), "candidate").groupBy("source_id").agg(F.array_sort(F.collect_set("file_path")).alias("file_paths"))
    out = own.join(by_name, "source_id", "left").join(by_path, "source_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("identifiers", "file_paths")})
    return out.withColumn("lexical", F.lower(F.array_join(F.concat("identifiers", "file_paths", "exception_types"), " ")))
