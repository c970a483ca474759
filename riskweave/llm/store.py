"""Cutting lineage with tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set (tests, local mode)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="riskweave-"))
        at = _own[0]
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, written as a table in the shared folder and read from there."""
    spark = df.sparkSession
    if not _written:
        atexit.register(drop_all, spark)
    _written.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for known in [w for w in _written if path.endswith(w.rpartition("/")[2])]:
            _written.remove(known)
            _delete(df.sparkSession, known)


def settle(spark: SparkSession) -> None:
    """Have shuffles that nothing reads any more deleted now.

    Spark deletes them once the driver's objects for them are collected, which a driver with memory to spare does rarely: without
    this, an iteration keeps the shuffles of all its steps on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_all(spark: SparkSession) -> None:
    """Delete the tables of this process, as far as its session still lives."""
    if spark.sparkContext._jsc is None:
        return
    while _written:
        _delete(spark, _written.pop())


def partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions, from which group counts follow."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
