"""What the operators of this subpackage share: reading tables, text batches for Arrow functions, checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.session import ship

#: Bytes of text that an Arrow function works on at once; bounds a Python worker's memory whatever the batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_with(frame: DataFrame) -> DataFrame:
    """The frame, whose Python functions may import this package on the executors from now on."""
    ship(frame.sparkSession)
    return frame


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null id is not held out (and nothing is learned from it either)."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so further columns of any name cannot clash with its own."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def id_field(docs: DataFrame, id_col: str, name: str) -> T.StructField:
    return T.StructField(name, docs.schema[id_col].dataType, True)


def by_bytes(batch: pa.RecordBatch, most: int = BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each; a longer text is a slice of its own."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(n.tolist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(n):
        yield batch.slice(start)


def map_texts(frame: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow over slices bounded by bytes of text; fn may be a factory's product holding a model."""

    def run(batches):
        give_back_memory()
        for batch in batches:
            for part in by_bytes(batch, most):
                yield fn(part)

    return ship_with(frame).mapInArrow(run, schema)


def give_back_memory() -> None:
    """What earlier tasks of this worker have freed goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(taken: list[str], name: str) -> str:
    """A column name like `name` that is none of those taken, whatever their case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Matrix products of this process in one thread, where numpy's own library is OpenBLAS.

    Each core of an executor has a task of its own; further threads would only wait for one another and burn its time.
    """
    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array one after another, and the n + 1 offsets of its texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts, pa.array([], pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; where none is, a temporary one on a local master only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewright-checkpoint-"))


def cut(frame: DataFrame) -> DataFrame:
    """Materialize a frame in the shared checkpoint folder; it survives the loss of any executor."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that cut() gave and that no plan still to run reads."""
    held = frame._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
