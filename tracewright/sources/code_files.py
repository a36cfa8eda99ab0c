"""Python files of a source tree as rows, and a cache of their chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracewright.functions.text import is_test_file
from tracewright.operators.models import embedded, embedding_text
from tracewright.operators.patches import chunk_files

SKIPPED_FOLDERS = (".git", "__pycache__", "build", "dist")


def python_files(spark: SparkSession, root: str, include_tests: bool = False) -> DataFrame:
    """(file_path relative to root, source) of every *.py below root; source is null where it is no UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    base = root.rstrip("/").split("://")[-1].split("file:")[-1]
    path = F.substring_index("path", base + "/", -1)
    files = raw.select(path.alias("file_path"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("source"))
    kept = files.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    return kept if include_tests else kept.where(~is_test_file(F.col("file_path")))


def _cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, built and written there if absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_chunks(spark: SparkSession, cache: str, source_id: str, files: DataFrame) -> DataFrame:
    """Chunks of a source from the cache's partition, built and written there if absent."""
    own = f"{cache.rstrip('/')}/source_id={source_id}"
    return _cached(spark, own, lambda: chunk_files(files)[0]).withColumn("source_id", F.lit(source_id))


def cached_embeddings(spark: SparkSession, cache: str, source_id: str, created_at: str, chunks: DataFrame, factory) -> DataFrame:
    """Chunks of a source as of a time with `vector`, from the cache; built by a model of models.embedded if absent."""
    own = f"{cache.rstrip('/')}/source_id={source_id}/created_at={created_at.replace('/', '-').replace(':', '-')}"

    def build():
        asked = chunks.withColumn("__text", embedding_text(F.col("source")))
        return embedded(asked, factory, "__text", "vector").drop("__text")

    return _cached(spark, own, build)
