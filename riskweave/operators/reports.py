"""Nested financial reports: flattening, pairing with the prior year, the check suite, gating, quality and packets.

Reports keep their order everywhere: a lookup takes the first row in (table, row) order and its first cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.checks import first_failing, growth_bp, share_bp

SCHEMA = (
    "report_id string, company string, period string, profile string, basis string, "
    "tables array<struct<table_id:string, period_basis:string, rows:array<struct<row_id:string, standard_account:string, label:string, "
    "cells:array<struct<cell_id:string, period:string, value:decimal(38,0), unit:string>>>>>>, "
    "notes array<struct<note_id:string, note_type:string, text:string>>, spans array<struct<span_id:string, text:string>>, "
    "cell_index map<string, struct<table_id:string, row_id:string, period:string, value:decimal(38,0)>>"
)
# Accounts of the checks, in natural order.
ACCOUNTS = (
    "revenue trade_receivables profit_after_tax operating_cash_flow "
    "fvtpl_assets fvtpl_unrealized_gain afs_assets htm_assets margin_lending margin_impairment "
    "gross_written_premium premium_receivables claims_expense insurance_reserves reinsurance_recoverables reinsurance_payables "
    "loans_to_customers npl_loans loan_loss_allowance general_provision specific_provision "
    "loan_group_1 loan_group_2 loan_group_3 loan_group_4 loan_group_5"
).split()
STANDARD, SECURITIES, INSURANCE, CREDIT = "standard_corporate", "securities", "insurance", "credit_institution"


def cells(reports: DataFrame) -> DataFrame:
    """A row for each cell, with its places in the report."""
    t = reports.select("report_id", "period", F.posexplode("tables").alias("table_pos", "t"))
    r = t.select("report_id", F.col("period").alias("report_period"), "table_pos", "t.table_id", "t.period_basis", F.posexplode("t.rows").alias("row_pos", "r"))
    return r.select("report_id", "report_period", "table_pos", "table_id", "period_basis", "row_pos", "r.row_id", "r.standard_account", "r.label", F.posexplode("r.cells").alias("cell_pos", "c")).select("*", "c.*").drop("c")


def year_quarter(period: Column) -> tuple[Column, Column]:
    """Year and quarter of ``YYYY-Qn``; another form raises."""
    good = period.rlike(r"^\d{4}-Q[1-4]$")
    checked = F.when(good, period).otherwise(F.raise_error(F.concat(F.lit("bad period: "), F.coalesce(period, F.lit("null")))))
    return F.substring(checked, 1, 4).cast("int"), F.substring(checked, 7, 1).cast("int")


def amounts(reports: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """The wide row of a report: each account's first cell of the report's own period; ``bases`` are tried in order."""
    rows = cells(reports).where(F.col("standard_account").isin(*ACCOUNTS) & (F.col("period") == F.col("report_period")))
    rank = F.lit(0) if not bases else F.coalesce(*(F.when(F.col("period_basis") == b, F.lit(i)) for i, b in enumerate(bases)), F.lit(len(bases)))
    value = F.min_by(F.col("value").cast("long"), F.struct(rank, "table_pos", "row_pos", "cell_pos"))
    return rows.groupBy("report_id").pivot("standard_account", ACCOUNTS).agg(value)


def pairs(reports: DataFrame) -> DataFrame:
    """Reports with those of the same company, quarter, profile and basis one year before: ids ``target`` and ``prior``."""
    y, q = year_quarter(F.col("period"))
    keyed = reports.select("report_id", "company", "profile", "basis", y.alias("y"), q.alias("q"))
    before = keyed.select("company", "profile", "basis", (F.col("y") + 1).alias("y"), "q", F.col("report_id").alias("prior"))
    return keyed.withColumnRenamed("report_id", "target").join(before, ["company", "profile", "basis", "y", "q"])


def wide_pairs(reports: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """Pairs with every account of both sides (null where a report doesn't show it): ``x`` and ``x_prior``, and the
    report's disclosures."""
    own = amounts(reports, bases)
    prior = own.select(F.col("report_id").alias("prior"), *(F.col(a).alias(f"{a}_prior") for a in ACCOUNTS))
    told = reports.select(F.col("report_id").alias("target"), "notes", "spans")
    return pairs(reports).join(own.withColumnRenamed("report_id", "target"), "target", "left").join(prior, "prior", "left").join(told, "target")


def _g(account: str) -> Column:
    return growth_bp(account, f"{account}_prior")


def _s(part: str, whole: str) -> Column:
    return share_bp(part, whole)


def _notes(*kinds: str) -> Column:
    return F.coalesce(F.size(F.filter("notes", lambda n: n["note_type"].isin(*kinds))), F.lit(0)).cast("long")


def _says(text: Column, *words: str) -> Column:
    found = F.lit(True)
    for w in words:
        found = found & F.lower(text).contains(w)
    return found


def narrative_tension() -> Column:
    """Whether the first note speaks of receivables and cash collection, and the first explanation of revenue alone."""
    note, told = F.try_element_at("notes", F.lit(1))["text"], F.try_element_at("spans", F.lit(1))["text"]
    return _says(note, "receivable", "cash collection") & _says(told, "revenue") & ~_says(told, "receivable") & ~_says(told, "cash")


def weak_explanation() -> Column:
    """Whether profit moved by more than a fifth and the first explanation doesn't speak of it."""
    told = F.try_element_at("spans", F.lit(1))["text"]
    return (F.abs(_g("profit_after_tax")) > 2000) & ~(_says(told, "profit") | _says(told, "net income"))


def weak_valuation_disclosure() -> Column:
    return F.exists("notes", lambda n: _says(n["text"], "concentrated", "no issuer-level"))


#: (signal, profile or any, accounts of both periods, of the report alone, disclosures, metric, condition over ``m``): metrics
#: are basis points, counts or amounts; a null one is a zero base.
def checks_of(dialect: str = "research") -> list[tuple]:
    m = F.col("m")
    profit, cash = F.col("profit_after_tax"), F.col("operating_cash_flow")
    ratio = _s("operating_cash_flow", "profit_after_tax")
    both = (profit > 0) & (cash < 0)
    premium = ("insurance_premium_receivables_outpace_gwp" if dialect == "runtime" else "premium_receivables_growth_outpaces_premium_growth", INSURANCE, ["gross_written_premium", "premium_receivables"], [], [], _g("premium_receivables") - _g("gross_written_premium"), m > 2000)
    growth = [
        ("revenue_growth_high", STANDARD, ["revenue"], [], [], _g("revenue"), m > 2000),
        ("receivables_growth_outpaces_revenue", STANDARD, ["revenue", "trade_receivables"], [], [], _g("trade_receivables") - _g("revenue"), m > 1000),
        ("positive_profit_negative_cfo", STANDARD, [], ["profit_after_tax", "operating_cash_flow"], [], ratio, both),
        ("cfo_net_income_gap_high", STANDARD, [], ["profit_after_tax", "operating_cash_flow"], [], ratio, (m < 7000) & ~both),
    ]
    if dialect == "runtime":
        npl = _s("npl_loans", "loans_to_customers") - _s("npl_loans_prior", "loans_to_customers_prior")
        cover = _s("loan_loss_allowance", "npl_loans") - _s("loan_loss_allowance_prior", "npl_loans_prior")
        return [
            *growth,
            ("securities_fvtpl_profit_bridge_high", SECURITIES, [], ["fvtpl_unrealized_gain", "profit_after_tax", "operating_cash_flow"], [], _s("abs(fvtpl_unrealized_gain)", "profit_after_tax"), (m > 3000) & ((cash < 0) | (ratio < 7000))),
            premium,
            ("credit_institution_npl_ratio_rising_without_coverage_improvement", CREDIT, ["npl_loans", "loans_to_customers", "loan_loss_allowance"], [], [], F.when(cover.isNotNull(), npl), (m > 100) & (cover <= 0)),
            ("related_party_disclosure_present", "any", [], [], [], _notes("related_party_note"), m > 0),
            ("accounting_policy_disclosure_present", "any", [], [], [], _notes("accounting_policy_change", "generic_accounting_policy"), m > 0),
            ("variance_explanation_present", "any", [], [], [], F.coalesce(F.size("spans"), F.lit(0)).cast("long"), m > 0),
        ]
    groups = [f"loan_group_{i}" for i in range(1, 6)]
    bad, all_loans = (" + ".join(f"{g}{{0}}" for g in gs) for gs in (groups[2:], groups))
    quality = _s(f"({bad.format('')})", f"({all_loans.format('')})") - _s(f"({bad.format('_prior')})", f"({all_loans.format('_prior')})")
    provisions = growth_bp("(general_provision + specific_provision)", "(general_provision_prior + specific_provision_prior)")
    margin, margin_prior = _s("margin_impairment", "margin_lending"), _s("margin_impairment_prior", "margin_lending_prior")
    share = _s("fvtpl_assets", "(fvtpl_assets + afs_assets + htm_assets)")
    exposure = F.floor((_g("gross_written_premium") + _g("claims_expense")) / 2).cast("long")
    return [
        *growth[:3],
        ("disclosure_narrative_tension", STANDARD, [], [], ["notes", "spans"], narrative_tension().cast("long"), m > 0),
        ("variance_explanation_weak_connection", STANDARD, ["profit_after_tax"], [], ["spans"], _g("profit_after_tax"), weak_explanation()),
        ("loan_quality_deterioration", CREDIT, groups, [], [], quality, m > 75),
        ("provision_growth_lags_risk_assets", CREDIT, ["loans_to_customers", "general_provision", "specific_provision"], [], [], _g("loans_to_customers") - provisions, m > 1000),
        ("ctck_margin_book_provision_gap", SECURITIES, ["margin_lending", "margin_impairment"], [], [], _g("margin_lending") - _g("margin_impairment"), (m > 1500) & (margin < margin_prior)),
        ("ctck_trading_book_valuation_concentration_with_weak_disclosure", SECURITIES, ["fvtpl_assets", "afs_assets", "htm_assets"], [], [], share, (m > 6000) & (_g("fvtpl_assets") > 2000) & weak_valuation_disclosure()),
        ("ctck_profit_supported_by_noncash_fvtpl_with_weak_cash_support", SECURITIES, [], ["fvtpl_unrealized_gain", "profit_after_tax", "operating_cash_flow"], [], _s("fvtpl_unrealized_gain", "profit_after_tax"), (m > 3000) & both),
        ("ctck_fvtpl_volatility_context_only", SECURITIES, [], ["fvtpl_unrealized_gain"], ["notes"], F.col("fvtpl_unrealized_gain"), F.lit(False)),
        premium,
        ("claims_reserve_growth_lags_claims_and_premium_exposure", INSURANCE, ["gross_written_premium", "claims_expense", "insurance_reserves"], [], [], exposure - _g("insurance_reserves"), m > 2000),
        ("reinsurance_recoverables_expand_with_weak_cash_support", INSURANCE, ["reinsurance_recoverables"], ["operating_cash_flow"], [], _g("reinsurance_recoverables"), (m > 3000) & (cash < 0)),
    ]


def run_checks(reports: DataFrame, bases: list[str] | None = None, dialect: str = "research") -> DataFrame:
    """A row for every pair and check: status (``flagged``, ``clear`` or why it abstains), metric_bp.

    One pass over the wide pairs; ordered reasons to abstain: another profile (``runtime`` says so, ``research`` leaves
    such checks out), missing evidence, then a zero base."""
    suite, rows = checks_of(dialect), []
    for name, profile, two, one, told, metric, _ in suite:
        missing = F.lit(False)
        for account in [*two, *one]:
            missing = missing | F.col(account).isNull()
        for account in two:
            missing = missing | F.col(f"{account}_prior").isNull()
        for surface in told:
            missing = missing | (F.coalesce(F.size(surface), F.lit(0)) <= 0)
        rows.append(F.struct(F.lit(name).alias("check"), F.lit(profile).alias("for_profile"), missing.alias("missing"), metric.alias("m")))
    stacked = wide_pairs(reports, bases).withColumn("c", F.explode(F.array(*rows))).select("*", "c.*")
    other = ~F.col("for_profile").isin("any") & (F.col("for_profile") != F.col("profile"))
    stacked = stacked if dialect == "runtime" else stacked.where(~other)
    flagged = F.coalesce(*(F.when(F.col("check") == name, F.coalesce(condition, F.lit(False))) for name, *_, condition in suite))
    status = first_failing((other, "wrong_profile"), (F.col("missing"), "missing_evidence"), (F.col("m").isNull(), "zero_denominator"), (flagged, "flagged"), default="clear")
    return stacked.select("target", "prior", "profile", "check", F.when(~F.col("missing") & ~other, F.col("m")).alias("metric_bp"), status.alias("status"))


#: (tool, accounts of both periods, disclosures): sixteen tools; a tool's first word names its profile.
TOOLS = (
    ("standard_corporate_revenue_growth_tool", ["revenue"], []),
    ("standard_corporate_receivables_vs_revenue_growth_tool", ["revenue", "trade_receivables"], []),
    ("standard_corporate_earnings_cashflow_mismatch_tool", ["profit_after_tax", "operating_cash_flow"], []),
    ("standard_corporate_disclosure_consistency_tool", [], ["notes", "spans"]),
    ("standard_corporate_variance_explanation_quality_tool", ["profit_after_tax"], ["spans"]),
    ("standard_corporate_related_party_exposure_tool", [], ["related_party_note"]),
    ("standard_corporate_accounting_policy_change_tool", [], ["accounting_policy_change"]),
    ("credit_institution_loan_quality_tool", [f"loan_group_{i}" for i in range(1, 6)], []),
    ("credit_institution_provision_movement_tool", ["loans_to_customers", "general_provision", "specific_provision"], []),
    ("ctck_margin_book_quality_tool", ["margin_lending", "margin_impairment"], []),
    ("ctck_trading_book_valuation_bridge_tool", ["fvtpl_assets", "afs_assets", "htm_assets"], []),
    ("ctck_earnings_cash_bridge_tool", ["profit_after_tax", "operating_cash_flow", "fvtpl_unrealized_gain"], []),
    ("ctck_disclosure_consistency_tool", ["fvtpl_unrealized_gain"], ["notes"]),
    ("insurance_premium_receivable_coherence_tool", ["gross_written_premium", "premium_receivables"], []),
    ("insurance_reserve_movement_tool", ["gross_written_premium", "claims_expense", "insurance_reserves"], []),
    ("insurance_reinsurance_balance_tool", ["reinsurance_recoverables", "reinsurance_payables", "operating_cash_flow"], []),
)
PROFILE_OF = (("credit_institution_", CREDIT), ("ctck_", SECURITIES), ("insurance_", INSURANCE), ("", STANDARD))


def gating(reports: DataFrame, bases: list[str] | None = None) -> DataFrame:
    """A row for every pair and tool: enabled, or disabled for its profile, its accounts (named) or its disclosures."""
    rows = []
    for tool, accounts, told in TOOLS:
        own = next(name for start, name in PROFILE_OF if tool.startswith(start))
        missing = F.array_compact(F.array(*(F.when(F.col(a).isNull() | F.col(f"{a}_prior").isNull(), F.lit(a)) for a in accounts))) if accounts else F.array().cast("array<string>")
        shown = F.lit(True)
        for kind in told:
            shown = shown & ((F.coalesce(F.size(kind), F.lit(0)) > 0) if kind in ("notes", "spans") else (_notes(kind) > 0))
        rows.append(F.struct(F.lit(tool).alias("tool"), F.lit(own).alias("for_profile"), missing.alias("lost"), shown.alias("shown")))
    out = wide_pairs(reports, bases).withColumn("t", F.explode(F.array(*rows))).select("target", "prior", "profile", "t.*")
    status = first_failing((F.col("profile") != F.col("for_profile"), "disabled_not_applicable"), (F.size("lost") > 0, "disabled_missing_context"), (~F.col("shown"), "skipped_missing_disclosure_context"), default="enabled")
    return out.select("target", "prior", "tool", status.alias("status"), F.when(F.col("profile") == F.col("for_profile"), F.array_join("lost", ", ")).otherwise("").alias("missing"))


# Candidates of both dialects: name, risk category, priority, and the signals that must all be flagged.
CANDIDATES = {
    "runtime": (
        ("REV_REC", "revenue_income_recognition_risk", "high", ["revenue_growth_high", "receivables_growth_outpaces_revenue"]),
        ("CASH", "earnings_cashflow_mismatch", "high", ["positive_profit_negative_cfo"]),
        ("CASH", "earnings_cashflow_mismatch", "high", ["cfo_net_income_gap_high"]),
        ("SEC_FVTPL_CASH", "earnings_cashflow_mismatch", "high", ["securities_fvtpl_profit_bridge_high"]),
        ("INS_PREM_REC", "receivables_credit_quality_risk", "high", ["insurance_premium_receivables_outpace_gwp"]),
        ("BANK_LOAN", "receivables_credit_quality_risk", "high", ["credit_institution_npl_ratio_rising_without_coverage_improvement"]),
        ("RELATED", "related_party_disclosure_risk", "medium", ["related_party_disclosure_present"]),
        ("POLICY", "disclosure_inconsistency_or_obfuscation", "medium", ["accounting_policy_disclosure_present"]),
        ("VARIANCE", "disclosure_inconsistency_or_obfuscation", "medium", ["variance_explanation_present"]),
    ),
    "research": (
        ("REV_REC", "revenue_income_recognition_risk", "high", ["revenue_growth_high", "receivables_growth_outpaces_revenue"]),
        ("EARN_CASH", "earnings_cashflow_mismatch", "high", ["positive_profit_negative_cfo"]),
        ("DISC_VAR", "disclosure_inconsistency_or_obfuscation", "medium", ["disclosure_narrative_tension", "variance_explanation_weak_connection"]),
        ("LOAN_QUALITY", "receivables_credit_quality_risk", "high", ["loan_quality_deterioration"]),
        ("PROVISION", "expense_liability_understatement_risk", "high", ["provision_growth_lags_risk_assets"]),
        ("MARGIN_BOOK", "receivables_credit_quality_risk", "high", ["ctck_margin_book_provision_gap"]),
        ("TRADING_VAL", "asset_quality_valuation_risk", "high", ["ctck_trading_book_valuation_concentration_with_weak_disclosure"]),
        ("EARN_CASH", "earnings_cashflow_mismatch", "high", ["ctck_profit_supported_by_noncash_fvtpl_with_weak_cash_support"]),
        ("PREM_REC", "receivables_credit_quality_risk", "high", ["premium_receivables_growth_outpaces_premium_growth"]),
        ("RESERVE_MOVE", "expense_liability_understatement_risk", "high", ["claims_reserve_growth_lags_claims_and_premium_exposure"]),
        ("REINS_CASH", "earnings_cashflow_mismatch", "high", ["reinsurance_recoverables_expand_with_weak_cash_support"]),
    ),
}


def candidates(findings: DataFrame, dialect: str = "research") -> DataFrame:
    """Candidates of a report: rules all of whose signals are flagged (a relational division by the set of flags)."""
    flags = findings.where("status = 'flagged'").groupBy("target").agg(F.collect_set("check").alias("flags"))
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("risk_category"), F.lit(p).alias("priority"), F.array(*map(F.lit, s)).alias("signals")) for n, c, p, s in CANDIDATES[dialect]))
    out = flags.select("target", "flags", F.explode(rules).alias("r")).where(F.size(F.array_except("r.signals", "flags")) == 0)
    return out.select("target", F.concat(F.lit("CAND_"), "target", F.lit("_"), "r.name", F.lit("_001")).alias("candidate_id"), "r.risk_category", "r.priority", F.array_join("r.signals", ",").alias("signals")).dropDuplicates(["target", "candidate_id"])


def support(findings: DataFrame) -> DataFrame:
    """Per pair, by the number of flagged checks (2 or more, 1, none): support level, confidence in percent, severity."""
    n = F.col("n_flagged")
    out = findings.groupBy("target", "prior").agg(F.count_if(F.col("status") == "flagged").alias("n_flagged"))
    level = lambda a, b, c: F.when(n >= 2, a).when(n == 1, b).otherwise(c)
    return out.select("target", "prior", "n_flagged", level("supported", "weak", "insufficient").alias("support"), level(85, 60, 30).alias("confidence_pct"), level("high", "medium", "low").alias("severity"))


def packets(findings: DataFrame, cap: int = 5) -> DataFrame:
    """Flagged findings of a report by check name: the first ``cap`` in a packet, the others as ``omitted`` rows' names; the
    packets of a company (what precedes the year in a report's id) are numbered by report."""
    spot = Window.partitionBy("target").orderBy("check")
    rows = findings.where("status = 'flagged'").withColumn("n", F.row_number().over(spot))
    listed = lambda kept: F.array_sort(F.collect_list(F.when(kept, F.col("check"))))
    out = rows.groupBy("target").agg(listed(F.col("n") <= cap).alias("checks"), listed(F.col("n") > cap).alias("omitted"))
    number = F.row_number().over(Window.partitionBy(F.regexp_replace("target", r"\d{4}.*$", "")).orderBy("target"))
    return out.select(F.format_string("PACKET_%s_%03d", "target", number).alias("packet_id"), "target", "checks", "omitted")


def quality(reports: DataFrame) -> DataFrame:
    """Reasons against reports (report_id, code, detail): empty tables, duplicate or unindexed cells, stale index entries,
    values that differ from the index, and cells without value (the first of a report only)."""
    flat = cells(reports).select("report_id", "cell_id", "value", F.struct("table_pos", "row_pos", "cell_pos").alias("at"))
    index = reports.select("report_id", F.explode("cell_index").alias("cell_id", "e")).select("report_id", "cell_id", F.col("e.value").alias("indexed"), F.lit(True).alias("there"))
    code = lambda d, name, detail: d.select("report_id", F.lit(name).alias("code"), F.col(detail).alias("detail"))
    counted = flat.groupBy("report_id", "cell_id").agg(F.count("*").alias("n"), F.min_by("value", "at").alias("value"))
    both = counted.join(index, ["report_id", "cell_id"], "full_outer")
    blank = flat.where("value is null").groupBy("report_id").agg(F.min_by("cell_id", "at").alias("cell_id"))
    empty = reports.where(F.coalesce(F.size("tables"), F.lit(-1)) <= 0).select("report_id", F.lit(None).cast("string").alias("cell_id"))
    found = [
        code(empty, "no_tables", "cell_id"), code(both.where("n > 1"), "duplicate_cell", "cell_id"), code(both.where("there is null"), "cell_not_indexed", "cell_id"), code(both.where("n is null"), "index_without_cell", "cell_id"),
        code(both.where("n is not null and there and not (value <=> indexed)"), "index_value_differs", "cell_id"), code(blank, "cell_without_value", "cell_id"),
    ]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out
