"""Choosing and ordering rows: best and latest per group, caps, interleaving, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every group by ``order``; the order should end in a key."""
    spot = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(spot)).where("__n = 1").drop("__n")


def split_at_cap(rows: DataFrame, keys: list[str], cap: int, *order: Column) -> DataFrame:
    """Rows with their ``ordinal`` in the group (from 1) and whether it is within ``cap``."""
    spot = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("ordinal", F.row_number().over(spot)).withColumn("kept", F.col("ordinal") <= cap)


def round_robin(rows: DataFrame, batch: str, *order: Column) -> DataFrame:
    """Rows with ``turn``: their place when batches take turns, one row each."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))


def interleaved(rows: DataFrame, batch: str, *order: Column) -> DataFrame:
    """Rows with ``turn`` and ``place``: the order in which batches take turns, from 1.

    A turn's places follow those of the turns before, which are counted: one row for each turn."""
    turns = round_robin(rows, batch, *order)
    sizes = turns.groupBy("turn").agg(F.count("*").alias("__n"))
    before = sizes.select("turn", F.coalesce(F.sum("__n").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = turns.join(before, "turn").withColumn("place", F.col("__before") + F.row_number().over(Window.partitionBy("turn").orderBy(batch)))
    return placed.drop("__before")


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """``rows``, to be broadcast: an error if there are more than ``most``."""
    if len(rows.head(most + 1)) > most:
        raise ValueError(f"more than {most} rows are no small side")
    return F.broadcast(rows)


def placed(rows: DataFrame, group: str, key: str, width: int = 1 << 16) -> DataFrame:
    """``rows`` with ``place``: from 1 by a whole-number ``key`` in each group.

    Keys are ranked in blocks of ``width``, and offset by the counts of the blocks before, so that a group of any size is
    ranked by many tasks; what one window orders is a row for each block."""
    block = rows.withColumn("__b", F.floor(F.col(key) / width))
    counts = block.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    spot = F.row_number().over(Window.partitionBy(group, "__b").orderBy(key))
    return block.join(offsets, [group, "__b"]).withColumn("place", F.col("__before") + spot).drop("__b", "__before")
