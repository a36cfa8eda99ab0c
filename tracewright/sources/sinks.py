"""What leaves the engine: logs, split records, notifications, dead letters, checkpoints."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import head

#: Fields that an agent may see; all others are for grading only. The key is in both. Fixed values.
AGENT_VISIBLE = ("source", "source_id", "title", "body", "state", "labels", "created_at", "url", "collected_At")
DETAIL_CHARS = 500


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, appended task by task: a reader may see a part of what is being written. VersionedTable has no such moment."""
    rows.write.mode("append").json(path)


def replace_json(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what is at a path: written beside it, then moved there, so a run that is cut off changes nothing.

    Plain files for plain readers; between the two moves nothing is at the path. VersionedTable has no such moment.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = (place(f"{path.rstrip('/')}.{ending}") for ending in ("new", "old"))
    fs.delete(old, True)
    rows.write.mode("overwrite").json(new.toString())
    if fs.exists(place(path)) and not fs.rename(place(path), old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, place(path)):
        raise OSError(f"{new.toString()} can't be moved to {path}")
    fs.delete(old, True)


class VersionedTable:
    """A table whose content changes in one step: readers see the whole of what was there before, or the whole of the new.

    Every write goes to a folder of its own. A version is a small file that names the folders of the table; the one with the
    highest number counts, and writing it is the commit. Two writers cannot make the same version: the later one takes the
    next number, and an append takes in what the other one wrote (where the file system's rename refuses a target that is there,
    as HDFS's does). A write that fails leaves no version, and its folder is removed.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "json"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._place(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def folders(self, version: int) -> list[str]:
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/versions/{version:020}").collect()))

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        """The table, or a version of it that is still kept; without any version an empty one."""
        found = self.versions() if version is None else [version]
        folders = self.folders(found[-1]) if found else []
        return self.spark.read.schema(schema).format(self.kind).load([f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def replace(self, rows: DataFrame) -> int:
        return self._write(rows, False)

    def append(self, rows: DataFrame) -> int:
        return self._write(rows, True)

    def _write(self, rows: DataFrame, keep: bool) -> int:
        own = f"data/{uuid.uuid4().hex}"
        try:
            rows.write.format(self.kind).save(f"{self.path}/{own}")
        except Exception:
            self._fs.delete(self._place(f"{self.path}/{own}"), True)
            raise
        while True:
            last = max(self.versions(), default=0)
            if self._commit(last + 1, [*(self.folders(last) if keep and last else []), own]):
                return last + 1

    def _commit(self, version: int, folders: list[str]) -> bool:
        """Written beside, then moved: a version is whole as soon as it can be seen. False if there is one already."""
        target, written = self._place(f"{self.path}/versions/{version:020}"), self._place(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(written, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if not self._fs.exists(target) and self._fs.rename(written, target):
            return True
        self._fs.delete(written, False)
        return False

    def expire(self, keep: int = 2) -> None:
        """Removes all but the last versions, and the folders that only these named. Not while others write."""
        found = self.versions()
        gone, kept = found[: max(0, len(found) - keep)], found[max(0, len(found) - keep) :]
        named = {f for v in kept for f in self.folders(v)}
        stale = {f for v in gone for f in self.folders(v)} - named
        for v in gone:
            self._fs.delete(self._place(f"{self.path}/versions/{v:020}"), False)
        for f in sorted(stale):
            self._fs.delete(self._place(f"{self.path}/{f}"), True)


def append_usage(rows: DataFrame, path: str) -> None:
    append_log(with_total(rows), path)


def with_total(usage: DataFrame) -> DataFrame:
    return usage.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def vertical_split(records: DataFrame, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(agent-visible, grading-only) columns of records, both with the key."""
    seen = [c for c in records.columns if c in AGENT_VISIBLE]
    return records.select(*seen), records.select(*(c for c in records.columns if c not in seen or c == key))


def write_split(records: DataFrame, visible: str, grading: str) -> None:
    a, b = vertical_split(records)
    a.write.mode("overwrite").json(visible)
    b.write.mode("overwrite").json(grading)


def notification(source_id: Column, category: Column, reason: Column, detail: Column) -> Column:
    """The text of an escalation notice; long details are cut. Sending it is the caller's."""
    line = lambda name, value: F.concat(F.lit(f"*{name}:* `"), F.coalesce(value, F.lit("None")), F.lit("`"))
    return F.concat_ws("\n", F.lit(":rotating_light: *Issue Escalated*"), line("source_id", source_id), line("category", category), line("failure_reason", reason), F.concat(F.lit("*detail:* "), head(F.coalesce(detail, F.lit("(none)")), DETAIL_CHARS)))


def escalation_record(rows: DataFrame, category: Column) -> DataFrame:
    """Escalations with both failure reasons, ready for the log or a notice."""
    return rows.select("source_id", category.alias("category"), F.coalesce("fallback_failure_reason", "original_failure_reason").alias("failure_reason"), "outcome", "original_failure_reason", "fallback_failure_reason", F.coalesce("detail", F.lit("")).alias("detail"))


def dead_letters(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by an error column; the good ones without it."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def _versions(spark: SparkSession, path: str) -> tuple[object, list[str]]:
    """The file system, and the folders of complete versions below a path, oldest first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return fs, []
    found = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("version-")]
    return fs, sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_checkpoint(done: DataFrame, path: str, key: str = "source_id") -> None:
    """The set of finished ids as a new version below path; ids are distinct and sorted.

    A version counts once it is complete, and only then do those before the last one go: a run that is cut off leaves the
    set as it was.
    """
    spark = done.sparkSession
    fs, there = _versions(spark, path)
    number = int(there[-1].rsplit("-", 1)[1]) + 1 if there else 1
    done.select(key).distinct().sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version-{number:012d}")
    for old in there[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)


def keyed_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones: reruns replace and do not duplicate."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def read_checkpoint(spark: SparkSession, path: str, key: str = "source_id") -> DataFrame:
    """Finished ids of the last complete version; none where there is none. What can't be read is an error."""
    _, there = _versions(spark, path)
    return spark.read.parquet(there[-1]).select(key) if there else spark.createDataFrame([], f"{key} string")
