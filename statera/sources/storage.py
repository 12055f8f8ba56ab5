"""Shared storage: where intermediate tables go, and folders that appear whole or not at all."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_lock = threading.Lock()
#: Intermediate tables of each application that release() may delete.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    with _lock:  # one temporary folder, however many threads ask at once
        path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if path is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            path = "file://" + tempfile.mkdtemp(prefix="statera-")
            spark.sparkContext.setCheckpointDir(path)
        return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread only. See :func:`release`."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _lock:
        _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that the session's operators have written so far; their number.

    For use between jobs, when results are written: DataFrames that rest on these tables can't be read any more.
    """
    with _lock:
        paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def _java_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _java_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_file_system(spark, path).exists(_java_path(spark, path)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    _file_system(spark, path).delete(_java_path(spark, path), True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    return sorted(s.getPath().getName() for s in _file_system(spark, path).listStatus(_java_path(spark, path))) if exists(spark, path) else []


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """Let ``write`` fill a folder aside of ``path`` and give it that name by one rename; False if another writer has taken the name.

    Readers see a whole folder or none. What a writer that fails has written is deleted; what one that dies has written stays below
    ``_aside`` beside ``path``, which Spark's readers skip. The rename fails where the name exists: HDFS and local disks do so, plain object stores don't.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    aside = f"{parent}/_aside/{name}-{uuid.uuid4().hex}"
    try:
        write(aside)
        if exists(spark, path):
            return False
        hadoop = spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(_file_system(spark, path).getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(_java_path(spark, aside), _java_path(spark, path), options)
        except Py4JJavaError:
            if not exists(spark, path):
                raise
            return False
        return True
    finally:
        remove(spark, aside)
