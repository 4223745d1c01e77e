"""Tables that an operator writes and reads again: what must not differ between two runs of a plan, or should not run twice."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_held: dict = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder only in local mode, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = f"file://{tempfile.mkdtemp(prefix='arbora-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession):
    """Within, shuffle files go with the query that made them. Of several threads the last one to end puts the session's setting back."""
    key = id(spark)
    with _lock:
        n, old = _held.get(key, (0, None))
        if not n:
            old = spark.conf.get(_FREE)
            spark.conf.set(_FREE, "true")
        _held[key] = (n + 1, old)
    try:
        yield
    finally:
        with _lock:
            n, old = _held.pop(key)
            if n > 1:
                _held[key] = (n - 1, old)
            else:
                spark.conf.set(_FREE, old)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again. Its shuffle files, often many times its own size, go when it is written.

    The table's path is in the attribute `stored_at`, for removed()."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with _freed_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        sc, path = t.sparkSession.sparkContext, getattr(t, "stored_at", None)
        if path:
            hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)
