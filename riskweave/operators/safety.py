"""Whether cached sources may be reused: a fold over roles in order with ten ordered checks, each with its own record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What blocks a cached source, in the order in which it is looked for: (code, outcome, ask for the source again).
CHECKS = (
    ("recent_source_refresh_unavailable", "invalid_blocked", False),
    ("recent_source_refresh_invalid", "invalid_blocked", False),
    ("ambiguous_source_requires_resolution", "ambiguous_source_requires_resolution", False),
    ("refreshed_source_metadata_missing", "invalid_blocked", False),
    ("refreshed_source_fingerprint_missing", "invalid_blocked", False),
    ("refreshed_source_fingerprint_changed", "stale_rebuild_required", True),
    ("refreshed_source_identity_changed", "stale_rebuild_required", True),
    ("refreshed_source_status_changed", "stale_rebuild_required", True),
    ("refreshed_source_superseded", "stale_rebuild_required", True),
    ("refreshed_source_corrected", "stale_rebuild_required", True),
)
# The code that a check is reported under where it differs, and the prefix of all.
REPORTED = {"refreshed_source_fingerprint_missing": "refreshed_source_metadata_missing"}
PREFIX = "filing_cache_lookup_"
UNCLEAR = ("hitl_needed", "ambiguous")
CORRECTIONS = ("corrected_source_id", "operative_corrected_source_id", "correction_status", "corrected_value_status")
FLAGS = ("is_corrected", "has_corrected_values")


def _told(column: Column) -> Column:
    """A text that says something."""
    return F.coalesce(column, F.lit("")) != ""


def first_check() -> Column:
    """The place in ``CHECKS`` of the first that a slot fails, from 0; null for a safe one.

    A slot has year and quarter, refreshable (whether a refresh can be asked for), cached (source_id, fingerprint,
    filing_status) and refreshed (null where the refresh gave nothing; status, fingerprint, canonical_id, filing_status,
    superseded and the fields of ``CORRECTIONS`` and ``FLAGS``)."""
    old, new = (lambda n: F.col(f"cached.{n}")), (lambda n: F.col(f"refreshed.{n}"))
    corrected = F.lit(False)
    for name in CORRECTIONS:
        corrected = corrected | _told(new(name))
    for name in FLAGS:
        corrected = corrected | F.coalesce(new(name), F.lit(False))
    changed = lambda a, b: _told(a) & ~a.eqNullSafe(b)
    fails = [
        ~F.coalesce(F.col("refreshable"), F.lit(False)),
        F.col("refreshed").isNull(),
        F.coalesce(new("status").isin(*UNCLEAR), F.lit(False)),
        ~new("status").eqNullSafe(F.lit("selected")),
        ~_told(old("fingerprint")) | ~_told(new("fingerprint")),
        old("fingerprint") != new("fingerprint"),
        changed(new("canonical_id"), old("source_id")),
        changed(new("filing_status"), old("filing_status")),
        F.coalesce(F.array_contains(new("superseded"), old("source_id")), F.lit(False)),
        corrected,
    ]
    return F.coalesce(*(F.when(f, F.lit(i)) for i, f in enumerate(fails)))


def source_safety(slots: DataFrame, latest: list[tuple[int, int]], key: str = "case") -> DataFrame:
    """Per case: outcome (``safe`` or why not), code, role and whether the source must be confirmed again.

    Slots of ``latest`` quarters, and those without a whole year and quarter, are checked; of the roles (0, 1, ...) the first
    unsafe one ends the search.  One aggregation: nothing is sorted."""
    recent = F.lit(False)
    for year, quarter in latest:
        recent = recent | ((F.col("year") == year) & (F.col("quarter") == quarter))
    asked = F.col("year").isNull() | F.col("quarter").isNull() | recent
    found = slots.select(key, "role", F.when(asked, first_check()).alias("failed"))
    stop = F.min(F.when(F.col("failed").isNotNull(), F.struct("role", "failed")))
    rows = F.array(*(F.struct(F.lit(PREFIX + REPORTED.get(code, code)).alias("code"), F.lit(outcome).alias("outcome"), F.lit(again).alias("again")) for code, outcome, again in CHECKS))
    per = found.groupBy(key).agg(stop.alias("stop")).withColumn("check", F.try_element_at(rows, F.col("stop.failed") + 1))
    return per.select(key, F.coalesce("check.outcome", F.lit("safe")).alias("outcome"), F.col("check.code").alias("code"), F.col("stop.role").alias("role"), F.coalesce("check.again", F.lit(False)).alias("reconfirm"))
