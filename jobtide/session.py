"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SCALE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Aggregate and shuffle stages of one plan are re-planned at run time; small sides become
    # broadcasts only when their measured size is below this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}


def build_session(app_name: str = "jobtide", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the plans assume; on a cluster pass no master."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SCALE_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets
    a temporary folder, because there the driver's disk is the executors' disk.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="jobtide-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write narrow rows to the checkpoint folder once and continue from the stored rows.

    Used where several branches read the same rows, and where a value depends on physical placement (a
    range slice, a row number inside it): a lost executor then re-reads the same rows.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def store_wide(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Like :func:`cut_lineage` for rows with long texts: a Parquet table in the checkpoint folder, so
    that each reader scans only the columns it needs. The shuffle files of the write are deleted when it is done; without that
    they wait for the driver's garbage collection. With ``by``, the last columns, there is a folder for each of their values."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_go(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scopes():
        _FOLDERS[out] = path
        _scopes()[-1][path] = spark
    return out


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is run inside are deleted when it is done."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_OPEN = threading.local()


def _scopes() -> list[dict[str, SparkSession]]:
    """By thread, the tables of each open :func:`passing`, innermost last."""
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`store_wide` writes inside are deleted at the end, but those handed to the function that is given: they pass to
    the block around, or stay where there is none. What leaves the block may read kept tables only."""
    own: dict[str, SparkSession] = {}
    _scopes().append(own)

    def keep(table: DataFrame) -> DataFrame:
        path = _FOLDERS[table]
        spark = own.pop(path)
        if len(_scopes()) > 1:
            _scopes()[-2][path] = spark
        return table

    try:
        yield keep
    finally:
        _scopes().pop()
        for path, spark in own.items():
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/jobtide/{spark.sparkContext.applicationId}"


def drop_wide(spark: SparkSession) -> None:
    """Delete the tables :func:`store_wide` wrote for this application, once nothing reads them."""
    _delete(spark, _own_folder(spark))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
