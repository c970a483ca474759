"""Connected components of a link table by alternating large and small stars, each step a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskweave.llm import store

MOST_STEPS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the least node that links reach.

    Steps grow with the logarithm of the longest path; each is written to the shared folder, so that a lost executor
    costs one step.  Null ends are dropped."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges, before = store.written(pairs, "links"), None
    for _ in range(MOST_STEPS):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        seen = Observation()  # of the rows as they are written
        edges = store.written(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "links")
        now = (seen.get["n"], seen.get["sum"])
        store.settle(edges.sparkSession)
        if now == before:
            root = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(root)
        before = now
    raise RuntimeError("components: links didn't settle")
