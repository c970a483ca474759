"""Identities, groups, splits and leakage of labelled datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case with runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def identity_groups(identities: DataFrame, record: str, identity: str, most_rounds: int = 50) -> DataFrame:
    """(record, component): records that share identities, directly or through others; component is the least record.

    Labels travel record -> identity -> record; every round also follows the label's own label, so that rounds grow
    with the logarithm of a chain.  Each is checkpointed in the cluster's shared folder."""
    spark = identities.sparkSession
    edges = identities.select(F.col(record).alias("r"), F.col(identity).alias("i")).where("r is not null and i is not null").distinct()
    edges, kept = _cut(edges)  # every round reads them twice: their texts are read and hashed once
    labels, before, old = edges.select("r", F.col("r").alias("c")).distinct(), None, None
    for _ in range(most_rounds):
        least = edges.join(labels, "r").groupBy("i").agg(F.min("c").alias("c"))
        found = edges.join(least, "i").groupBy("r").agg(F.min("c").alias("c"))
        hop = found.select(F.col("r").alias("c"), F.col("c").alias("cc"))
        labels = found.join(hop, "c", "left").select("r", F.least("c", F.coalesce("cc", "c")).alias("c"))
        labels, path = _cut(labels)
        now = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        _drop(spark, old)
        old = path or labels
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("identity_groups: labels didn't settle")
    _drop(spark, kept or edges)
    return labels.select(F.col("r").alias(record), F.col("c").alias("component"))


def _drop(spark: SparkSession, old: DataFrame | str | None) -> None:
    """Give up a table that nothing reads any more."""
    if isinstance(old, str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    elif old is not None:
        old.unpersist()


def _cut(df: DataFrame) -> tuple[DataFrame, str | None]:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names, where it is set, and read again; and its path."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        return df.persist(), None
    df.write.parquet(path := f"{at.rstrip('/')}/groups-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path), path


def apportion(counts: DataFrame, count: str, shares: list[tuple[str, int]]) -> DataFrame:
    """(split, n): a total dealt by shares, which need not sum to 100, with the largest remainder method; ties go to the
    greater name; without a positive share all goes to the first split."""
    shares = [(name, max(p, 0)) for name, p in shares]
    whole = sum(p for _, p in shares) or 1
    shares = shares if any(p for _, p in shares) else [(name, int(i == 0)) for i, (name, _) in enumerate(shares)]
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(name).alias("split"), F.lit(p).cast("long").alias("percent")) for i, (name, p) in enumerate(shares)))).alias("s")
    total = counts.agg(F.sum(count).cast("long").alias("total")).select("total", rows).select("total", "s.*")
    base = total.withColumn("base", F.expr(f"CAST(total AS DECIMAL(20,0)) * percent div {whole}")).withColumn("rest", F.expr(f"CAST(total AS DECIMAL(20,0)) * percent % {whole}"))
    left = F.max("total").over(Window.partitionBy()) - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), F.desc("split")))
    return base.select("split", (F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("n"))


def hash_order(seed: str, key: Column) -> Column:
    """A portable pseudo-random order: sha-256 of seed and key."""
    return F.sha2(F.concat(F.lit(seed), F.lit("|"), key.cast("string")), 256)


def hash_split(key: Column, seed: str, bounds: list[tuple[str, int]]) -> Column:
    """A split from the key alone: its hash as a number from 0 to 99 against upper bounds, in order."""
    spot = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") % 100
    return F.coalesce(*(F.when(spot < top, F.lit(name)) for name, top in bounds))


def leaked(rows: DataFrame, value: str, split: str) -> DataFrame:
    """Values found in more than one split, with the sorted splits as text."""
    found = rows.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("s"))
    return found.where(F.size("s") > 1).select(value, F.array_join("s", ",").alias("splits"))
