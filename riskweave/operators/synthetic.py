"""Grounded synthetic packets: injected values, family thresholds, variants by slot, matched pairs, metadata rows.

Ratios are basis points on integers; a value follows from its report's own values and the scenario's target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.checks import first_failing, growth_bp, share_bp

# Slots of variants, in order, and what a family's metric is measured against, in basis points.
SLOTS = (
    "V1_easy_quantitative_clear", "V2_easy_quantitative_contradiction", "V3_medium_partial_secondary_evidence", "V4_hard_missing_required_context",
    "V5_note_or_disclosure_quality", "V6_tool_finding_contradiction", "V7_profile_specific_mapping", "V8_language_or_account_label_style",
)
THRESHOLDS = {
    "revenue_receivables": ("above", 1000), "earnings_cashflow": ("below", 8000), "receivables_credit_quality": ("below", 300), "inventory_cost_asset_flow": ("above", 1500),
    "expense_liability_understatement": ("above", 2000), "asset_quality_valuation": ("above", 3500), "related_party_disclosure": ("above", 500), "disclosure_inconsistency": ("above", 500),
}
WEAK_LEAD_BP = 1050


def injected_receivables(multiplier_bp: Column) -> Column:
    """The receivables that a scenario puts in: revenue times the multiplier, for a weak target a growth just above
    revenue's; always above what was there.  Columns: revenue, revenue_prior, receivables, receivables_prior, target."""
    scaled = F.floor((F.col("revenue") * multiplier_bp + 5000) / 10000).cast("long")
    weak = F.floor((F.col("receivables_prior") * (10000 + growth_bp("revenue", "revenue_prior") + WEAK_LEAD_BP) + 5000) / 10000).cast("long")
    return F.greatest(F.col("receivables") + 1, F.when(F.col("target") == "weakly_supported", weak).otherwise(scaled))


def injected_cash(multiplier_bp: Column) -> Column:
    return F.floor((F.col("profit") * multiplier_bp + 5000) / 10000).cast("long")


#: The other six families: the account that is changed, how its metric is measured (``growth`` of the account, the account's growth
#: over revenue's or revenue's over the account's, or its ``share`` of a base), and the base or the account's year before.
# The bases as hundredths of revenue, of the year before for growth; receivables where there is none.
FAMILIES = {
    "receivables_credit_quality": ("receivables_allowance", "share", None),
    "inventory_cost_asset_flow": ("inventory", "growth_over_revenue", 45),
    "expense_liability_understatement": ("operating_expenses", "revenue_over_growth", 60),
    "asset_quality_valuation": ("soft_assets", "growth", 55),
    "related_party_disclosure": ("related_party_balance", "share", 200),
    "disclosure_inconsistency": ("note_value", "growth", None),
}
FAR_BP = 2500


def solved_text(base: str, least_bp: str, side: str) -> str:
    """The whole number nearest to a threshold for which 10000 * it / ``base``, rounded half away from zero, is strictly above
    (below) ``least_bp`` or, for ``not_above`` (``not_below``), isn't; as SQL over a positive base of up to 30 digits."""
    edge = f"(CAST({base} AS DECIMAL(38,0)) * (2 * {least_bp} {'+' if side.endswith('above') else '-'} 1))"
    lower, upper = f"(({edge} - pmod({edge}, 20000)) div 20000)", f"(({edge} + pmod(-{edge}, 20000)) div 20000)"
    return f"{lower} + 1" if side in ("above", "not_below") else f"{upper} - 1"


def family_values(rows: DataFrame) -> DataFrame:
    """A synthetic value for each of ``FAMILIES``: family, account, base, value, metric_bp and exceeded, with the rows' columns.

    rows has revenue, revenue_prior, receivables (whole amounts, positive) and target.  The value is solved for: a weak target
    lands just beyond the family's threshold, a supported one ``FAR_BP`` further, any other just within.  A value below 0 becomes
    0, where the wanted side can't be reached."""
    growth = "(CASE WHEN revenue_prior <> 0 THEN growth_of_revenue ELSE 0 END)"
    rows = rows.withColumn("growth_of_revenue", growth_bp("revenue", "revenue_prior"))
    made = []
    for family, (account, form, part) in FAMILIES.items():
        side, at = THRESHOLDS[family]
        year = "revenue_prior" if "growth" in form else "revenue"
        base = f"greatest(1, {'receivables' if part is None else f'CAST(({year} * {part}) div 100 AS BIGINT)'})"
        shift = {"growth_over_revenue": f"{at} + {growth}", "revenue_over_growth": f"{growth} - {at}"}.get(form, str(at))
        up = side == "above" and form != "revenue_over_growth"
        beyond, within = ("above", "not_above") if up else ("below", "not_below")
        far = f"(({shift}) {'+' if up else '-'} {FAR_BP})" if form != "share" or up else f"(({shift}) div 3)"
        found = f"CASE WHEN target = 'weakly_supported' THEN {solved_text(base, f'({shift})', beyond)} WHEN target = 'supported' THEN {solved_text(base, far, beyond)} ELSE {solved_text(base, f'({shift})', within)} END"
        value = f"greatest(0, {found} + {base if form != 'share' else '0'})"
        made.append(F.struct(F.lit(family).alias("family"), F.lit(account).alias("account"), F.lit(form).alias("form"), F.expr(base).cast("long").alias("base"), F.expr(value).cast("long").alias("value")))
    kept = [c for c in rows.columns if c != "growth_of_revenue"]
    out = rows.select(*kept, "growth_of_revenue", F.explode(F.array(*made)).alias("m")).select(*kept, "growth_of_revenue", "m.*")
    own = growth_bp("value", "base")
    metric = F.when(F.col("form") == "share", share_bp("value", "base")).when(F.col("form") == "growth_over_revenue", own - F.expr(growth)).when(F.col("form") == "revenue_over_growth", F.expr(growth) - own).otherwise(own)
    out = out.withColumn("metric_bp", metric)
    return out.select(*kept, "family", "account", "base", "value", "metric_bp", exceeded(F.col("family"), F.col("metric_bp")).alias("exceeded"))


def exceeded(family: Column, metric_bp: Column) -> Column:
    """Whether a metric is beyond its family's threshold; null for an unknown family."""
    return F.coalesce(*(F.when(family == name, metric_bp > at if side == "above" else metric_bp < at) for name, (side, at) in THRESHOLDS.items()))


def family_flag(family: Column, metric_bp: Column, target: Column) -> Column:
    """A finding's flag: measured for the two families with values of their own, else what the target says."""
    return F.when(family.isin("revenue_receivables", "earnings_cashflow"), exceeded(family, metric_bp)).otherwise(target != "not_supported")


def mutated(packet: str, slot: Column, target: Column) -> Column:
    """A nested packet (findings: finding_id, flag, refs; notes; spans; rows; priority; signals; reason) for a target and a
    slot: without evidence for insufficient ones; then contradiction, one note, no findings, poor notes, unflagged findings,
    renamed rows and references, or another label style."""
    p = F.col(packet)
    empty = lambda name: F.slice(p[name], 1, 0)
    bare = target == "insufficient_evidence"
    is_slot = lambda i: slot == SLOTS[i - 1]
    none = bare | is_slot(4)
    findings = F.when(none, empty("findings")).when(is_slot(6), F.transform(p["findings"], lambda f: f.withField("flag", F.lit(False)))).when(is_slot(7), F.transform(p["findings"], lambda f: f.withField("refs", F.transform(f["refs"], lambda r: F.concat(r, F.lit("_ALT")))))).otherwise(p["findings"])
    notes = F.when(bare, empty("notes")).when(is_slot(3), F.slice(p["notes"], 1, 1)).when(is_slot(5), F.transform(p["notes"], lambda n: F.concat(n, F.lit(" Little detail is disclosed.")))).otherwise(p["notes"])
    spans = F.when(is_slot(2), F.array(F.lit("Billing at the end of the quarter explains it."))).otherwise(p["spans"])
    rows = F.when(is_slot(7), F.transform(p["rows"], lambda r: F.concat(r, F.lit("_ALT")))).otherwise(p["rows"])
    signals = F.when(none, empty("signals")).otherwise(p["signals"])
    priority = F.when(none | is_slot(3), "medium").otherwise(p["priority"])
    told = F.coalesce(*(F.when(is_slot(i), F.concat(p["reason"], F.lit(f" ({text})"))) for i, text in ((2, "timing"), (3, "one note"), (5, "little detail"), (6, "not flagged"), (7, "other map"))), F.when(is_slot(8), F.concat(F.lit("Doanh thu: "), p["reason"])), p["reason"])
    reason = F.when(none, F.lit("Rows alone suggest a review.")).otherwise(told)
    out = p
    for name, value in (("findings", findings), ("notes", notes), ("spans", spans), ("rows", rows), ("signals", signals), ("priority", priority), ("reason", reason)):
        out = out.withField(name, value)
    return out


def complete_pairs(records: DataFrame) -> DataFrame:
    """(pair, state): complete when two records of one role cover supported and weakly_supported; a pair with any label
    that isn't its target is a mismatch.  records: pair, role, target, level."""
    g = records.groupBy("pair").agg(F.count("*").alias("n"), F.bool_or(~F.col("level").eqNullSafe(F.col("target"))).alias("wrong"), F.array_sort(F.collect_set("target")).alias("targets"), F.countDistinct("role").alias("roles"))
    whole = (F.col("n") == 2) & (F.col("roles") == 1) & (F.array_join("targets", ",") == "supported,weakly_supported")
    return g.select("pair", first_failing((F.col("wrong"), "label_mismatch"), (whole, "complete"), default="incomplete").alias("state"))


def metadata_rows(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Classified items (ticker, period, item, kind; kind null: not of it) of every wanted ticker and period, or one row
    ``no_quarterly_metadata_hit``."""
    found = items.where("kind is not null")
    out = wanted.join(found, ["ticker", "period"], "left")
    return out.select("ticker", "period", "item", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.when(F.col("item").isNull(), "no_quarterly_metadata_hit").otherwise("metadata_hit").alias("coverage"))
