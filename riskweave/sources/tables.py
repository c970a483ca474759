"""The shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed value: rows of the table that a job is dealt by, in one task.
ROWS = 250_000


def dealt(rows: DataFrame, spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """``rows`` by ``key`` in parts whose number grows with the rows of table ``name`` (counted in its files' footers).

    A task's memory stays the same at any size, whatever ``spark.sql.shuffle.partitions`` says and adaptive execution joins."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf_dir, name).count() // ROWS))
    return rows.repartition(parts, key)
