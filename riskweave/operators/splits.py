"""Decontaminated splits: identities, group ids, excluded groups, consecutive ranges over a hash order, viability, stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.dataset import hash_order


def identity_values(scalars: list[Column], composites: list[tuple[Column, Column]]) -> Column:
    """A record's identities: present scalars and ``a::b`` of pairs that are both there, each once."""
    pair = lambda a, b: F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), F.concat(a, F.lit("::"), b))
    every = F.array_compact(F.array(*scalars, *(pair(a, b) for a, b in composites)))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def group_ids(identities: DataFrame, groups: DataFrame, record: str, identity: str) -> DataFrame:
    """(component, group_id, n_identities): a digest of a component's identities in order."""
    rows = identities.join(groups, record).select("component", identity).distinct()
    listed = F.array_join(F.array_sort(F.collect_list(identity)), "|")
    return rows.groupBy("component").agg(F.concat(F.lit("DG_"), F.upper(F.substring(F.sha2(listed, 256), 1, 16))).alias("group_id"), F.count("*").alias("n_identities"))


def ranges(groups: DataFrame, group: str, sizes: list[tuple[str, int]], seed: str, digits: int = 2) -> DataFrame:
    """``groups`` with ``split``: consecutive ranges, of the given numbers of groups, over their order by a seeded hash.

    Places are counted within buckets of the hash's first ``digits`` and offset by the buckets before, so that no task
    sorts all groups."""
    h = groups.withColumn("__h", hash_order(seed, F.col(group))).withColumn("__b", F.substring("__h", 1, digits))
    counts = h.groupBy("__b").count()
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** digits rows
    offsets = counts.select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    placed = h.join(F.broadcast(offsets), "__b").withColumn("__at", F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy("__h", group)))
    top, split = 0, F.lit(None).cast("string")
    for name, n in sizes:
        split = F.when(split.isNotNull(), split).when((F.col("__at") > top) & (F.col("__at") <= top + n), name)
        top += n
    return placed.withColumn("split", split).drop("__h", "__b", "__before", "__at")


def viability(counts: DataFrame, shares: list[tuple[str, int]], tolerance_bp: int) -> DataFrame:
    """(split, n, wanted_bp, actual_bp, code): splits asked for and empty, or off their share by more than the tolerance."""
    total = sum(p for _, p in shares)
    wanted = counts.sparkSession.createDataFrame([(s, p * 10000 // total) for s, p in shares], "split string, wanted_bp long")
    every = counts.agg(F.sum("n").alias("total"))  # one row
    rows = wanted.join(counts, "split", "left").join(F.broadcast(every)).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    actual = F.expr("n * 10000 div total")
    code = F.when((F.col("wanted_bp") > 0) & (F.col("n") == 0), "empty_requested_split").when(F.abs(actual - F.col("wanted_bp")) > tolerance_bp, "outside_tolerance").otherwise("viable")
    return rows.select("split", "n", "wanted_bp", actual.alias("actual_bp"), code.alias("code"))


def stamped(records: DataFrame, metadata: str, split: Column, group: Column, packet: Column, rationale: Column, seed: int) -> DataFrame:
    """Records whose nested ``metadata`` tells split, seed, hashes, group and whether they may be trained on."""
    m = F.col(metadata)
    fields = {"split": split, "split_seed": F.lit(seed), "packet_content_hash": F.sha2(packet, 256), "assessment_rationale_hash": F.sha2(F.trim(F.regexp_replace(F.lower(rationale), r"\s+", " ")), 256), "usable_for_training": split != "excluded", "exclusion_reason": F.when(split == "excluded", "excluded"), "decontamination_group_id": group}
    for name, value in fields.items():
        m = m.withField(name, value)
    return records.withColumn(metadata, m)


def split_rank(split: Column) -> Column:
    """The order of splits; unknown ones come last."""
    return F.coalesce(*(F.when(split == s, F.lit(i)) for i, s in enumerate(("train", "validation", "test", "holdout", "excluded"))), F.lit(99))
