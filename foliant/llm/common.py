"""What the operators of this package share: the shared folder, tables in it, and text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: UTF-8 bytes of text that one step of a Python worker handles at a time (a longer text makes a step of its own).
STEP_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; elsewhere executors could not see it.
    """
    context = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if set_dir:
        if not context.getCheckpointDir():
            context.setCheckpointDir(set_dir)
        return set_dir
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="foliant-")
    context.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation. The files go with
    the session's last reference to them where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a checkpoint that nothing reads any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant-tables/{spark.sparkContext.applicationId}"


def table(df: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed column table: for the larger intermediate results. See ``drop_tables``."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. For when the results that were built on them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch in the pipeline.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of BATCH_BYTES at most (or one row), unless it is set to less.
    By rows alone, as by default, a batch of texts has tens of MB, which stand twice in a task's worker and, outside of the
    heap, several times in the executor's JVM, which gives little of it back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes in ``column`` each, or one row."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    start = 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives free memory back: workers live on after a task, and what
    one stage has used would add to what the next one needs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Drops this worker's tables of powers and returns free memory to the system, where the C library can."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, a separator byte (newline) after each, and each text's start; null reads as empty.

    The last start is the length, so text ``i`` is ``data[starts[i]:starts[i + 1] - 1]``.
    """
    values = [v.encode() if v is not None else b"" for v in column.to_pylist()]
    data = b"\n".join([*values, b""])
    starts = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) + 1 for v in values], out=starts[1:])
    return np.frombuffer(data, dtype=np.uint8), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64. A worker keeps the first few million of each base."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = np.full(max(1, n), base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n <= 2 * STEP_BYTES:
            _POWERS[base] = out
    return out[: max(1, n)]


#: Odd multipliers of the polynomial hashes and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[starts[i]:ends[i]]`` for each i, equal for equal content, from prefix sums."""
    n = len(values)
    power = powers(BASES[which], n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * power, out=sums[1:])
    inverse = powers(INVERSES[which], n + 1)
    body = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
