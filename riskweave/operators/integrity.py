"""Constraints as violation rows, reference checks, key differences and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """A row (keys, code) for every rule that a row breaks, in one pass."""
    codes = F.array_compact(F.array(*(F.when(broken, F.lit(code)) for code, broken in rules)))
    return rows.select(*keys, F.explode(codes).alias("code"))


def unresolved(refs: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """References that no known row answers."""
    return refs.join(known.select(*on), on, "left_anti")


def key_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of one side only, with ``side``: ``missing`` on the right, or ``extra`` there."""
    missing = left.select(*on).distinct().join(right.select(*on), on, "left_anti").withColumn("side", F.lit("missing"))
    extra = right.select(*on).distinct().join(left.select(*on), on, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def duplicates(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Keys that come more than once, with their count ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def reconcile(expected: DataFrame, actual: DataFrame, on: list[str], value: str) -> DataFrame:
    """Keys whose value differs between a manifest and what is there, with both values."""
    both = expected.withColumnRenamed(value, "expected").join(actual.withColumnRenamed(value, "actual"), on, "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))
