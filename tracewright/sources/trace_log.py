"""JSON-lines logs as tables whose rows keep their order in the file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracewright.session import ship

PIPELINE_LOG = "timestamp string, node_name string, source_id string, run_id string, outcome string, failure_reason string, duration_ms double, attempt int"
LLM_USAGE = "node_name string, provider string, model string, source_id string, run_id string, timestamp double, prompt_tokens long, completion_tokens long, total_tokens long"
GOLDEN_SET = "source_id string, passes_golden_filter boolean, reasoning string"
CLASSIFICATIONS = "source_id string, category string, is_actionable boolean, reasoning string"
RAW_ISSUES = "source string, source_id string, title string, body string, state string, labels array<string>, created_at string, url string, collected_At string"
GRADING_KEY = "source_id string, closed_At string, linked_fix_id string, linked_fix_diff_url string, comments array<struct<author:string,body:string,created_at:string>>"
PATCH_ID = "patch_id"
#: Files whose beginnings are sent to every task; with more of them the log is shuffled by file.
MOST_FILES = 100_000


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of one or more JSON-lines files with `file` and `seq`, which grows with the row's line in its file.

    Files of any size are read in blocks by many tasks: seq is the block's first byte and the line's number in the block,
    which is less than the next block's first byte, as a line has a byte at least. Blank lines are skipped (a malformed
    row has all nulls, or is an error if strict). A missing path gives an empty table.
    """
    ship(spark)
    try:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("seq"), F.col("value").alias("line"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, file string, seq long")
    rows = lines.mapInArrow(_numbered, "file string, seq long, line string").where(F.trim("line") != "")
    parsed = rows.select(F.from_json("line", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE", "allowUnquotedControlChars": "true"}).alias("r"), "file", "seq")
    return parsed.select("r.*", "file", "seq")


def _numbered(batches):
    """Adds to the block's first byte the number of the line in its block; a task's blocks come one after another."""
    block, number = None, 0
    for batch in batches:
        names, starts = batch.column("file").dictionary_encode(), batch.column("seq").to_numpy()
        codes = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows]
        seq = np.empty(batch.num_rows, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = (names.dictionary[int(codes[a])].as_py(), int(starts[a])) if b > a else block
            number = number if own == block else 0
            seq[a:b] = starts[a] + number + np.arange(b - a) if b > a else 0
            block, number = own, number + b - a
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(seq), batch.column("line")], ["file", "seq", "line"])


def one_order(log: DataFrame, at: str = "timestamp") -> DataFrame:
    """A log of several files (with file and seq) whose seq is one order over all of them: files go by the first time in
    them, then by name; rows of a file by their own seq.

    Whatever takes the first or last row by seq (verdicts, last wins) then sees a log that was rotated as one file. Files
    without any time come last. A row without a seq keeps none.
    """
    time = F.try_to_timestamp(F.col(at).cast("string"))
    files = log.groupBy("file").agg(F.min_by(time, F.when(time.isNotNull(), F.col("seq"))).alias("__began"))
    began = F.coalesce(F.col("__began"), F.lit("9999-12-31").cast("timestamp"))
    few = files.limit(MOST_FILES + 1).count() <= MOST_FILES
    marked = log.join(F.broadcast(files) if few else files, "file", "left")
    order = F.struct(began.alias("began"), F.col("file").alias("file"), F.col("seq").alias("place"))
    return marked.withColumn("seq", F.when(F.col("seq").isNotNull(), order)).drop("__began").select(*log.columns)


def rows_of_run(log: DataFrame, run_id: str) -> DataFrame:
    """One run's rows in order; the filter is pushed to columnar copies of the log."""
    return log.where(F.col("run_id") == run_id).orderBy("seq")


def golden_ids(golden: DataFrame) -> DataFrame:
    return golden.where(F.col("passes_golden_filter")).select("source_id")


def one_issue(issues: DataFrame, source_id: str, order: str = "seq") -> DataFrame:
    """The first row of an id; using the result fails where there is none."""
    found = issues.where(F.col("source_id") == source_id).orderBy(order).limit(1)
    if found.isEmpty():
        raise KeyError(source_id)
    return found
