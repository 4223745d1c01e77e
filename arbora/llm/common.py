"""Shared helpers: scratch tables in the cluster's shared folder, partition counts, Arrow text."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on at a time; a longer text is a step of its own.
CHUNK_BYTES = 3 << 18
#: Bounds of one Arrow batch: at some kilobytes a text, Spark's defaults are tens of MB, held several times.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_FREE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# setting: Spark's default and ours
_SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(BATCH_BYTES))}
#: Bytes of a table that a join may broadcast.
BROADCAST_BYTES = 1 << 20
_held: dict = {}
_lock = threading.Lock()


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one, in local mode (tests) only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = getattr(spark, "_arbora_scratch", None)
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='arbora-')}"
            spark._arbora_scratch = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a new scratch table and read it back.

    Cuts the lineage: a lost executor costs a re-read of the table, not a rerun of the job."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    small_batches(spark)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbora_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again: their successors are written."""
    for t in tables:
        if path := getattr(t, "_arbora_path", None):
            remove_folder(t.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table with the hint that its measured size asks for: broadcast up to limit bytes of text and numbers, else merge.

    Spark's own choice goes by compressed file sizes, which say little of the size in memory."""
    size = table.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in table.columns), F.lit(0)))).first()[0]
    return table.hint("broadcast" if (size or 0) <= limit else "merge")


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Hold settings of a session. Blocks of several threads share them: the last one to end puts the old values back."""
    key = (id(spark), *values)
    with _lock:
        n, old = _held.get(key, (0, None))
        if not n:
            old = {k: spark.conf.get(k, None) for k in values}
            for k, v in values.items():
                spark.conf.set(k, v)
        _held[key] = (n + 1, old)
    try:
        yield
    finally:
        with _lock:
            n, old = _held.pop(key)
            if n > 1:
                _held[key] = (n - 1, old)
            else:
                for k, v in old.items():
                    spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def freed_shuffles(spark: SparkSession):
    """Within, Spark removes the shuffle files of each query as soon as it has ended.

    For writes only, after which nothing asks for those files; else they stay until the driver
    happens to collect its garbage, and the disk holds all steps' files at once."""
    return _settings(spark, _FREE)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_ROWS rows and some BATCH_BYTES, where they are still Spark's defaults.

    The setting stays, as the caller runs an operator's last step."""
    for k, (default, v) in _SMALL.items():
        if spark.conf.get(k, default) == default:
            spark.conf.set(k, v)


def trimmed(run):
    """A function for mapInArrow whose worker gives freed memory back to the system when a task ends.

    Workers live on and serve later steps; what their allocators keep would count against the executor."""

    @functools.wraps(run)
    def with_trim(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return with_trim


def width(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: what the session sets for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key for a row that has no reliable id: rows that share it have equal doc_id and text."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def chunks(sizes, limit: int = CHUNK_BYTES):
    """Row ranges (from, to) of at most limit bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def steps(column: pa.Array, limit: int = CHUNK_BYTES, as_bytes: bool = False):
    """(from, to, texts) for runs of rows of at most limit bytes; null is empty.

    Only one step's texts are Python objects at a time: a batch may hold thousands of long texts."""
    column = pc.fill_null(column, "")
    sizes = pc.binary_length(column).to_pylist()
    if as_bytes:
        column = column.cast(pa.large_binary())
    for s, e in chunks(sizes, limit):
        yield s, e, column.slice(s, e - s).to_pylist()


def int64(column: pa.Array, null: int = 2**63 - 1) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)
