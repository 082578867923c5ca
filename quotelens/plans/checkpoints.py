"""Tables stored in the shared folder: the only way lineage is cut in this library."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Paths of stored tables that still exist: those of the innermost `scratch` block of this thread, and all others.
_BLOCK: ContextVar[list[str] | None] = ContextVar("stored tables of a block", default=None)
_STORED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir or by SparkContext.setCheckpointDir.

    There is no fallback: a machine-local folder is lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; `release` deletes what is there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = _BLOCK.get()
    (_STORED if own is None else own).append(path)
    return path


PACKED = "zstd"
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
# Per session: how many writes are under way, and the setting before the first of them.
_WRITES: dict[str, tuple[int, str | None]] = {}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a write inside the block shuffles is dropped when the write ends, not when the driver collects its garbage.

    A write plans its frame anew, so nothing later reads those files; one planned meanwhile that needs them makes them again.
    """
    key = str(spark._jsparkSession.sessionUUID())
    with _LOCK:
        count, before = _WRITES.get(key, (0, None))
        if not count:
            before = spark.conf.get(_DROP, None)
            spark.conf.set(_DROP, "true")
        _WRITES[key] = (count + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            count, before = _WRITES.pop(key)
            if count > 1:
                _WRITES[key] = (count - 1, before)
            elif before is None:
                spark.conf.unset(_DROP)
            else:
                spark.conf.set(_DROP, before)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back, so later jobs never recompute it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with shuffles_dropped(spark):
        writer.option("compression", PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by_key(df: DataFrame, path: str, key: str) -> str:
    """Write to a path of the shared folder, in as many buckets of `key` as a shuffle has partitions; the name of the table."""
    table = path.rsplit("/", 1)[1].replace("-", "_")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(df.sparkSession):
        df.write.format("parquet").option("path", path).option("compression", PACKED).bucketBy(parts, key).saveAsTable(table)
    return table


def written_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """As `written`, in buckets of `key`: a join on `key` alone moves only the other side."""
    return df.sparkSession.table(stored_by_key(df, scratch_path(df.sparkSession, name), key))


def release(spark: SparkSession, stored: list[str]) -> None:
    """Delete the tables at the paths of `stored`, emptying it; frames that read them end with them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while stored:
        path = jvm.org.apache.hadoop.fs.Path(stored.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop what this thread stores inside the block when it ends; consume results inside it.

    Tables of other threads and of blocks around it stay.
    """
    own: list[str] = []
    token = _BLOCK.set(own)
    try:
        yield
    finally:
        _BLOCK.reset(token)
        release(spark, own)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _STORED else None
    if spark is not None:
        release(spark, _STORED)


atexit.register(_at_exit)
