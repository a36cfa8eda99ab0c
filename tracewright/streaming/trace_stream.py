"""Extension: the run metrics over a stream of trace rows, as update-mode aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import traces


def read_trace_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def running_verdicts(trace: DataFrame, include_retry: bool = False) -> DataFrame:
    """The verdict of every run so far. State is one value with its order per run, so late rows change nothing else."""
    return traces.task_success(trace, include_retry)


def running_latency(trace: DataFrame) -> DataFrame:
    return traces.latency(trace)


def drain(frame: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there and return the final table."""
    query = frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
