"""Tables with one row for each identity, which later records replace: buckets of a Parquet folder, rewritten where they change."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"
_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, for the time of this process; a local one only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="riskweave-")
    if not _made:
        atexit.register(_delete, spark)
    _made.append(path := f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


def _delete(spark: SparkSession) -> None:
    while _made and spark.sparkContext._jsc is not None:
        at, system = _path(spark, _made.pop())
        system.delete(at, True)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.parquet(path).drop(BUCKET)


def upsert(changes: DataFrame, path: str, identity: list[str], order: list[str], buckets: int = 64) -> None:
    """Rows of ``changes`` added to the table at ``path`` or put in the place of those of the same identity (null parts are
    equal), where their ``order`` is not lower: of one identity the greatest order stays, of equal orders the latest upsert's.

    Only buckets that changes fall into are read and written, side by side with what is there; Spark puts them in place when all
    are written, so that a failed write leaves the old rows.  A reader meanwhile reads the old ones.  ``buckets`` must stay the
    same for a table: give it in proportion to the table's size.  Changes of one identity among themselves follow ``order``."""
    spark = changes.sparkSession
    columns = changes.columns
    new = changes.withColumn(BUCKET, F.pmod(F.xxhash64(*identity), F.lit(buckets)).cast("int")).withColumn("__age", F.lit(1))
    at, system = _path(spark, path)
    both = new
    if system.exists(at):
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).withColumn("__age", F.lit(0))
        both = old.unionByName(new)
    rest = [c for c in columns if c not in identity]
    last = F.max_by(F.struct(*rest), F.struct(*order, "__age", *(c for c in rest if c not in order)))
    kept = both.groupBy(BUCKET, *identity).agg(last.alias("__row")).select(BUCKET, *identity, "__row.*").select(*columns, BUCKET)
    kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
