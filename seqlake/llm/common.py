"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine (tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shared(df: DataFrame, name: str, releasable: bool = True) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and lost executors cost nothing.

    The shuffle files of the write are removed at its end; ``discard`` or
    ``release_shared`` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    if releasable:
        _written.append((spark, path))
    made = spark.read.schema(schema).parquet(path)
    made.shared_path = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if (spark, path) in _written:
        _written.remove((spark, path))


def discard(*tables: DataFrame) -> None:
    """Deletes tables of write_shared that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.shared_path)


def release_shared(spark: SparkSession) -> None:
    """Deletes the tables of write_shared; for callers that have stored every result made from them."""
    for _, path in [x for x in _written if x[0] is spark]:
        _delete(spark, path)


def partitions_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for a shuffle of df: as many as the session asks for, more where Catalyst's estimate of its bytes calls for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # Catalyst gives an absurd size where it has no estimate
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each) if known else 1)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about limit bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, written as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """A sample of about ``most`` rows at most, chosen by a hash of ``key``: the same rows on every run."""
    n = df.count()
    if n <= most:
        return df
    cut = int(most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < cut)


def workers_quiet() -> None:
    """Keeps native libraries in a Python worker to its one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


_of_worker: dict[Hashable, Any] = {}


def of_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between the tasks of one operator; what another operator kept is freed first."""
    if key not in _of_worker:
        _of_worker.clear()
        give_back()
        _of_worker[key] = make()
    return _of_worker[key]


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back at the end of each task: the worker goes on to other tasks beside the executor's JVM."""

    def frugally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return frugally
