"""Sharding by a hypergeometric communication matrix, with DataFrame functions only.

Rows lie in logical partitions by a hash of all their columns.  The driver draws how many rows of each partition go to
each shard: the counts of a uniformly random deal into shards whose sizes differ by one at most (a multivariate
hypergeometric draw, row by row).  Rows are ranked in their partition by a second hash (the local permutation), cut at
the counts, exchanged, and ranked in their shard by a third hash (the second permutation), which gives gapless slots.
All draws and hashes follow from ``seed``, so that a lost task gives the same rows again.

Only the partitions' counts and the matrix (partitions times shards, both set by configuration) pass the driver or are
broadcast.  Ranks in a shard are taken in ranges of the third hash, with the counts of the ranges before, so that no
task sorts a whole shard.

Null texts or keys are values like others; equal rows are counted and numbered first, and dealt each on its own, so that
columns must be of types that can be grouped; an empty table gives an empty table;
with fewer rows than shards some shards stay empty.  Other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import store

SHARDS = 16
CHUNK = 1 << 20


def hypergeometric(good: int, bad: int, n: int, u: float) -> int:
    """How many of ``n`` rows drawn from ``good`` and ``bad`` ones are good: the hypergeometric law inverted at ``u``.

    Probabilities follow from the mode's by the law's own ratios, over all counts whose weight a 53-bit ``u`` can tell
    (40 standard deviations and more), so that one rule holds for urns of any size."""
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = 64 + int(40 * math.sqrt(n * share * (1 - share) * (good + bad - n) / max(1, good + bad - 1)))
    low, high = max(low, mode - reach), min(high, mode + reach)
    up, down = np.arange(mode, high, dtype=np.float64), np.arange(mode, low, -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) * (n - up)) - np.log((up + 1) * (bad - n + up + 1)))
    fall = np.cumsum(np.log(down * (bad - n + down)) - np.log((good - down + 1) * (n - down + 1)))
    weight = np.cumsum(np.exp(np.concatenate([fall[::-1], [0.0], rise])))
    return low + int(np.searchsorted(weight, u * weight[-1], "right").clip(0, high - low))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows of each partition go to each shard; shard sizes differ by one at most.

    Each partition's row splits off by halves of the shards, one hypergeometric draw each."""
    total = sum(counts)
    left = np.full(shards, total // shards, np.int64) + (np.arange(shards) < total % shards)
    rng = np.random.Generator(np.random.PCG64(seed))

    def draw(good: int, bad: int, n: int) -> int:
        return hypergeometric(good, bad, n, float(rng.random())) if good and bad and n else min(n, good)

    out = np.zeros((len(counts), shards), np.int64)

    def deal(row: int, low: int, high: int, n: int) -> None:
        if high - low == 1:
            out[row, low] = n
            left[low] -= n
        else:
            mid = (low + high) // 2
            k = draw(int(left[low:mid].sum()), int(left[mid:high].sum()), n)
            deal(row, low, mid, k)
            deal(row, mid, high, n - k)

    for row, n in enumerate(counts):
        deal(row, 0, shards, n)
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    spark = docs.sparkSession
    names = [f"__{i}" for i in range(len(docs.columns))]
    parts = 4 * store.partitions(spark)
    ranges = max(1, parts // shards)
    counted = docs.toDF(*names).groupBy(*names).agg(F.count("*").alias("__n"))
    numbered = lambda d, *c: d.select(*names, *c, F.explode(F.sequence(F.lit(1).cast("long"), F.least("__n", F.lit(CHUNK).cast("long")))).alias("__nth"))
    # Equal rows are numbered; what a row repeats beyond a chunk is spread by chunks first.
    chunks = counted.where(F.col("__n") > CHUNK).select(*names, "__n", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"(__n - 1) div {CHUNK}"))).alias("__c"))
    chunks = chunks.repartition(parts, *names, "__c").withColumn("__n", F.col("__n") - F.col("__c") * CHUNK)
    more = numbered(chunks, "__c").select(*names, (F.col("__nth") + F.col("__c") * CHUNK).alias("__nth"))
    row = numbered(counted).unionByName(more)
    row = row.withColumns({"__h": F.xxhash64(*names, "__nth", F.lit(seed))}).drop("__nth")
    row = row.withColumns({"__part": F.pmod("__h", F.lit(parts)).cast("int"), "__local": F.xxhash64("__h", F.lit(1)), "__order": F.xxhash64("__h", F.lit(2))})
    counts = {r[0]: r[1] for r in row.groupBy("__part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    edges = spark.createDataFrame([(p, e) for p, e in enumerate(matrix.cumsum(1).tolist())], "__part int, __edges array<long>")
    ranked = row.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__local", *names)))
    ranked = ranked.join(F.broadcast(edges), "__part")  # parts rows of shards counts
    dealt = ranked.withColumn("__shard", F.size(F.filter("__edges", lambda e: e < F.col("__rank"))))
    dealt = dealt.withColumn("__range", F.pmod(F.shiftrightunsigned("__order", 33), F.lit(ranges)).cast("int")).drop("__edges", "__rank", "__local", "__part")
    sizes = dealt.groupBy("__shard", "__range").count()
    before = Window.partitionBy("__shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__shard", "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    placed = dealt.withColumn("__place", F.row_number().over(Window.partitionBy("__shard", "__range").orderBy("__order", *names)))
    placed = placed.join(F.broadcast(sizes), ["__shard", "__range"])  # at most parts rows
    slot = (F.col("__before") + F.col("__place") - 1).cast("long")
    return placed.select(*names, F.col("__shard"), slot.alias("__slot")).toDF(*docs.columns, store.fresh(docs, "shard"), store.fresh(docs, "slot"))
