"""Year-over-year pairing and threshold checks over integer amounts (minor units), exact in every engine.

Percentages are whole hundredths of a percent ("basis points"), rounded half away from zero on integers; comparisons
come after rounding and are strict.  A zero base has no percentage (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def growth_text(now: str, before: str) -> str:
    """Growth from ``before`` to ``now`` in basis points, as SQL; of amounts of up to 33 digits."""
    wide = f"CAST(abs(CAST({now} AS DECIMAL(38,0)) - {before}) AS DECIMAL(33,0))"
    return f"CASE WHEN {before} <> 0 THEN CASE WHEN {now} < {before} THEN -1 ELSE 1 END * (({wide} * 20000 + abs({before})) div (2 * CAST(abs({before}) AS DECIMAL(38,0)))) END"


def share_text(part: str, whole: str) -> str:
    """part / |whole| in basis points, as SQL; of amounts of up to 33 digits."""
    return f"CASE WHEN {whole} <> 0 THEN CASE WHEN {part} < 0 THEN -1 ELSE 1 END * ((CAST(abs({part}) AS DECIMAL(33,0)) * 20000 + abs({whole})) div (2 * CAST(abs({whole}) AS DECIMAL(38,0)))) END"


def growth_bp(now: str, before: str) -> Column:
    """Growth from ``before`` to ``now`` in basis points."""
    return F.expr(growth_text(now, before))


def share_bp(part: str, whole: str) -> Column:
    """part / |whole| in basis points, rounded half away from zero; null for a zero base."""
    return F.expr(share_text(part, whole))


def prior_year(periods: DataFrame, keys: list[str], values: list[str], year: str = "y") -> DataFrame:
    """Every row with a row of the same keys one year before: an equi-join on keys and year; values get ``_prior``."""
    before = periods.select(*keys, (F.col(year) + 1).alias(year), *(F.col(v).alias(f"{v}_prior") for v in values))
    return periods.join(before, [*keys, year])


def first_failing(*rules: tuple[Column, str], default: str) -> Column:
    """The code of the first rule that holds, in order; nulls don't hold."""
    return F.coalesce(*(F.when(condition, F.lit(code)) for condition, code in rules), F.lit(default))
