"""Findings of report pairs with their evidence: which cells, notes and spans a tool read, what it computed from them, and why
it abstains.

A pair is one row; a tool looks its accounts up in the nested tables by expression (the first row of the account in table and row
order, by the first of its period bases that has one, and that row's first cell), so that nothing but the pairing is shuffled."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.checks import first_failing, growth_text, share_text
from riskweave.operators.reports import CREDIT, INSURANCE, SECURITIES, STANDARD, pairs

ANY = "any"


@dataclass(frozen=True)
class Tool:
    """What a tool reads and says: ``both`` accounts of both reports, ``own`` of the target alone, or ``notes`` of kinds or
    ``spans``; ``zero`` names the amounts that must not be zero; ``bases`` the period bases to try (any where empty).  metric and
    flag are expressions over the accounts' names (``_prior`` for the year before) and ``m``; signals are ids by outcome, of
    which ``flags`` are tried in order."""

    code: str
    name: str
    category: str
    profile: str
    metric_name: str
    unit: str
    threshold: tuple[str, int]
    metric: str
    flags: tuple[tuple[str, str], ...]
    clear: str
    stem: str
    both: tuple[str, ...] = ()
    own: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()
    spans: bool = False
    zero: tuple[str, ...] = ()
    bases: dict = field(default_factory=dict)
    suffixes: dict = field(default_factory=dict)

    def signal(self, outcome: str) -> str:
        return f"{self.stem}_{self.suffixes.get(outcome, outcome)}"


def _growth(account: str) -> str:
    return f"growth({account}, {account}_prior)"


# The tools, what they are called, their thresholds (hundredths of a percent, or counts) and the ids of their signals.
TOOLS = (
    Tool("REV_GROWTH", "standard_corporate_revenue_growth_tool", "revenue_income_recognition_risk", STANDARD, "revenue_growth_pct", "percent", ("greater_than", 2000), _growth("revenue"),
         (("revenue_growth_high", "m > 2000"),), "revenue_growth_not_high", "standard_corporate_revenue", both=("revenue",), zero=("revenue_prior",)),
    Tool("REC_VS_REV", "standard_corporate_receivables_vs_revenue_growth_tool", "revenue_income_recognition_risk", STANDARD, "receivables_growth_minus_revenue_growth_pct_points", "percentage_points", ("greater_than", 1000), f"{_growth('trade_receivables')} - {_growth('revenue')}",
         (("receivables_growth_outpaces_revenue", "m > 1000"),), "receivables_growth_not_outpacing_revenue", "standard_corporate_receivables_vs_revenue", both=("trade_receivables", "revenue"), zero=("trade_receivables_prior", "revenue_prior")),
    Tool("CASH", "standard_corporate_earnings_cashflow_mismatch_tool", "earnings_cashflow_mismatch", STANDARD, "operating_cash_flow_to_abs_profit", "ratio", ("less_than", 7000), "share(operating_cash_flow, profit_after_tax)",
         (("positive_profit_negative_cfo", "profit_after_tax > 0 AND operating_cash_flow < 0"), ("cfo_net_income_gap_high", "m < 7000")), "earnings_cashflow_support_not_weak", "earnings_cashflow", own=("profit_after_tax", "operating_cash_flow"), zero=("profit_after_tax",)),
    Tool("SEC_FVTPL_CASH", "ctck_earnings_cash_bridge_tool", "earnings_cashflow_mismatch", SECURITIES, "fvtpl_unrealized_gain_to_abs_profit", "ratio", ("greater_than", 3000), "share(abs(fvtpl_unrealized_gain), profit_after_tax)",
         (("securities_fvtpl_profit_bridge_high", "m > 3000 AND (operating_cash_flow < 0 OR share(operating_cash_flow, profit_after_tax) < 7000)"),), "securities_fvtpl_cash_bridge_not_high", "securities_fvtpl", own=("profit_after_tax", "fvtpl_unrealized_gain", "operating_cash_flow"), zero=("profit_after_tax",)),
    Tool("INS_PREM_REC", "insurance_premium_receivable_reserve_coherence_tool", "receivables_credit_quality_risk", INSURANCE, "premium_receivables_growth_minus_gwp_growth_pct_points", "percentage_points", ("greater_than", 2000), f"{_growth('premium_receivables')} - {_growth('gross_written_premium')}",
         (("insurance_premium_receivables_outpace_gwp", "m > 2000"),), "insurance_premium_receivables_not_outpacing_gwp", "insurance_premium_receivables", both=("premium_receivables", "gross_written_premium"), zero=("premium_receivables_prior", "gross_written_premium_prior"),
         bases={"premium_receivables": ("balance_sheet_date", "year_to_date")}, suffixes={"zero_denominator": "zero_comparison"}),
    Tool("BANK_LOAN_QUALITY", "credit_institution_loan_quality_tool", "receivables_credit_quality_risk", CREDIT, "npl_ratio_change_pct_points", "percentage_points", ("greater_than", 100), "share(npl_loans, loans_to_customers) - share(npl_loans_prior, loans_to_customers_prior)",
         (("credit_institution_npl_ratio_rising_without_coverage_improvement", "m > 100 AND share(loan_loss_allowance, npl_loans) - share(loan_loss_allowance_prior, npl_loans_prior) <= 0"),), "credit_institution_loan_quality_not_flagged", "credit_institution_loan_quality",
         both=("loans_to_customers", "npl_loans", "loan_loss_allowance"), zero=("loans_to_customers", "loans_to_customers_prior", "npl_loans", "npl_loans_prior")),
    Tool("RPT_DISC", "related_party_exposure_tool", "related_party_disclosure_risk", ANY, "source_bound_related_party_note_count", "count", ("greater_than", 0), "n_texts", (("related_party_disclosure_present", "m > 0"),), "related_party_disclosure_missing_or_unsupported", "related_party_disclosure", notes=("related_party_note",)),
    Tool("POLICY_DISC", "accounting_policy_change_tool", "disclosure_inconsistency_or_obfuscation", ANY, "source_bound_accounting_policy_note_count", "count", ("greater_than", 0), "n_texts", (("accounting_policy_disclosure_present", "m > 0"),), "accounting_policy_disclosure_missing_or_unsupported", "accounting_policy_disclosure", notes=("accounting_policy_change", "generic_accounting_policy")),
    Tool("VAR_DISC", "variance_explanation_quality_tool", "disclosure_inconsistency_or_obfuscation", ANY, "source_bound_variance_explanation_count", "count", ("greater_than", 0), "n_texts", (("variance_explanation_present", "m > 0"),), "variance_explanation_missing_or_unsupported", "variance_explanation", spans=True),
)
#: Evidence types of the texts that a tool cites.
TEXT_TYPES = {"related_party_note": "related_party_note_span", "accounting_policy_change": "accounting_policy_span", "generic_accounting_policy": "accounting_policy_span", "spans": "variance_explanation_span"}


def account_cells(reports: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per report (report_id, period): for every account of ``wanted`` the first cell (cell_id, period, value) of its first row, by
    the first of the account's period bases that has one, else in any table.  A row without cells isn't there.

    The nested rows are flattened once: a generator keeps Spark from writing them out again for every account."""
    rows = F.flatten(F.transform("tables", lambda t: F.transform(t["rows"], lambda r: F.struct(t["period_basis"].alias("basis"), r["standard_account"].alias("account"), F.try_element_at(r["cells"], F.lit(1)).alias("cell")))))
    kept = F.filter(rows, lambda r: r["account"].isin(*wanted) & r["cell"].isNotNull())
    flat = reports.select("report_id", "period", F.explode(F.array(kept)).alias("rows"))

    def first(account: str, basis: str | None = None) -> Column:
        of = lambda r: (r["account"] == account) & (r["basis"] == basis if basis else F.lit(True))
        return F.try_element_at(F.filter("rows", of), F.lit(1))["cell"]

    return flat.select("report_id", "period", *(F.coalesce(*(first(a, b) for b in bases), first(a)).alias(a) for a, bases in wanted.items()))


def expanded(rule: str) -> str:
    """An expression with its ``growth(x, y)`` and ``share(x, y)`` written out as hundredths of a percent."""
    for name, write in (("growth", growth_text), ("share", share_text)):
        rule = re.sub(rf"{name}\(((?:abs\(\w+\)|\w+)), (\w+)\)", lambda m: f"({write(m[1], m[2])})", rule)
    return rule


def _ref(report: str, kind: Column | str, local: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("evidence_ref_type"), F.concat(F.col(report), F.lit(":"), local).alias("ref_id"), F.col(report).alias("report_id"), local.alias("local_evidence_id"), F.lit("input").alias("role"))


def _finding(tool: Tool) -> Column:
    """What one tool reads of a pair with its accounts' cells (those of the year before end in ``_prior``), notes and spans."""
    cells = [(a, "target", "period") for a in tool.own] + [x for a in tool.both for x in ((a, "target", "period"), (f"{a}_prior", "prior", "period_prior"))]
    texts = F.lit(None)
    if tool.notes:
        texts = F.transform(F.filter("notes", lambda n: n["note_type"].isin(*tool.notes) & (F.trim(F.coalesce(n["text"], F.lit(""))) != "")), lambda n: F.struct(n["note_id"].alias("id"), n["note_type"].alias("kind")))
    elif tool.spans:
        texts = F.transform(F.filter("spans", lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != ""), lambda s: F.struct(s["span_id"].alias("id"), F.lit("spans").alias("kind")))
    kind = "array<struct<id:string,kind:string>>"
    inputs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n)["value"].cast("decimal(38,0)").alias("value"), F.col(n)["cell_id"].alias("cell_id"), (F.col(n)["period"] == F.col(p)).alias("in_period"), F.col(r).alias("report_id")) for n, r, p in cells))
    return F.struct(F.lit(tool.code).alias("code"), F.coalesce(texts.cast(kind), F.array().cast(kind)).alias("texts"), inputs.cast("array<struct<name:string,value:decimal(38,0),cell_id:string,in_period:boolean,report_id:string>>").alias("inputs"))


def findings(reports: DataFrame) -> DataFrame:
    """A row for each pair and tool: what it read (``inputs``, ``refs``), its metric in hundredths of a percent (or a count), the
    signal, whether it is flagged, and ``status`` (flagged, clear, or why it abstains: wrong_profile, missing_evidence,
    wrong_period, zero_denominator).  A tool that abstains for a wrong profile or missing evidence cites nothing.

    Amounts are exact whole numbers of up to 38 digits."""
    wanted = {a: t.bases.get(a, ()) for t in TOOLS for a in (*t.own, *t.both)}
    own = account_cells(reports, wanted)
    told = reports.select(F.col("report_id").alias("target"), "notes", "spans")
    prior = own.select(F.col("report_id").alias("prior"), F.col("period").alias("period_prior"), *(F.col(a).alias(f"{a}_prior") for a in wanted))
    both = pairs(reports).select("target", "prior", "profile").join(own.withColumnRenamed("report_id", "target"), "target").join(prior, "prior").join(told, "target")
    stacked = both.select("target", "prior", "profile", F.explode(F.array(*(_finding(t) for t in TOOLS))).alias("f")).select("target", "prior", "profile", "f.*")
    names = sorted({n for t in TOOLS for n in (*t.own, *t.both, *(f"{a}_prior" for a in t.both))})
    amount = lambda name: F.try_element_at(F.filter("inputs", lambda i: i["name"] == name), F.lit(1))["value"]
    rows = stacked.withColumns({n: amount(n) for n in names} | {"n_texts": F.size("texts")})
    by_tool = lambda pick: F.coalesce(*(F.when(F.col("code") == t.code, pick(t)) for t in TOOLS))
    rows = rows.withColumn("m", by_tool(lambda t: F.expr(expanded(t.metric)).cast("long")))
    zero = by_tool(lambda t: F.expr(" OR ".join(f"{z} = 0" for z in t.zero) or "false"))
    flag = by_tool(lambda t: F.coalesce(*(F.when(F.expr(expanded(c)), F.lit(s)) for s, c in t.flags)))
    other = by_tool(lambda t: F.lit(t.profile)) != F.col("profile")
    mine = by_tool(lambda t: F.lit(t.profile == ANY))
    lost = F.exists("inputs", lambda i: i["value"].isNull())
    stale = F.exists("inputs", lambda i: ~F.coalesce(i["in_period"], F.lit(False)))
    abstain = first_failing((other & ~mine, "wrong_profile"), (lost, "missing_evidence"), (stale, "wrong_period"), (zero, "zero_denominator"), default="")
    rows = rows.withColumn("abstains", abstain).withColumn("raised", F.when(F.col("abstains") == "", flag))
    cites = ~F.col("abstains").isin("wrong_profile", "missing_evidence")
    cell_refs = F.transform("inputs", lambda i: F.struct(F.lit("table_cell").alias("evidence_ref_type"), F.concat(i["report_id"], F.lit(":"), i["cell_id"]).alias("ref_id"), i["report_id"].alias("report_id"), i["cell_id"].alias("local_evidence_id"), F.lit("input").alias("role")))
    kinds = F.create_map(*(F.lit(x) for pair in TEXT_TYPES.items() for x in pair))
    text_refs = F.transform(F.slice("texts", 1, 1), lambda t: _ref("target", F.try_element_at(kinds, t["kind"]), t["id"]))
    said = F.when(F.col("abstains") != "", by_tool(lambda t: F.coalesce(*(F.when(F.col("abstains") == o, F.lit(t.signal(o))) for o in ("wrong_profile", "missing_evidence", "wrong_period", "zero_denominator")))))
    return rows.select(
        "target",
        "prior",
        F.concat(F.lit("TOOL_"), "target", F.lit("_"), "code", F.lit("_001")).alias("tool_result_id"),
        by_tool(lambda t: F.lit(t.name)).alias("tool"),
        by_tool(lambda t: F.lit(t.category)).alias("risk_category"),
        F.coalesce(said, "raised", by_tool(lambda t: F.lit(t.clear))).alias("signal_id"),
        F.col("raised").isNotNull().alias("flag"),
        F.when(F.col("abstains") != "", F.col("abstains")).when(F.col("raised").isNotNull(), "flagged").otherwise("clear").alias("status"),
        by_tool(lambda t: F.lit(t.metric_name)).alias("metric_name"),
        F.when(F.col("abstains") == "", F.col("m")).alias("metric"),
        by_tool(lambda t: F.lit(t.unit)).alias("unit"),
        by_tool(lambda t: F.lit(t.threshold[0])).alias("threshold_type"),
        by_tool(lambda t: F.lit(t.threshold[1])).alias("threshold"),
        F.when(cites, F.concat(cell_refs, text_refs)).otherwise(F.array().cast("array<struct<evidence_ref_type:string,ref_id:string,report_id:string,local_evidence_id:string,role:string>>")).alias("refs"),
        F.when(cites, F.transform("inputs", lambda i: F.struct(i["name"].alias("name"), i["value"].alias("value"), i["cell_id"].alias("cell_id")))).otherwise(F.array().cast("array<struct<name:string,value:decimal(38,0),cell_id:string>>")).alias("inputs"),
    )


# What a report must say and show before tools may run.
CURRENCIES, UNITS = ("VND",), ("vnd", "thousand_vnd", "million_vnd", "billion_vnd")
STATEMENTS = ("balance_sheet", "income_statement", "cash_flow_statement")
HAND_AUTHORED = ("hand_authored_reference_v1",)
PRIOR_KEYS = ("prior_period_value", "prior_year_value", "comparison_value")


def gate(sets: DataFrame) -> DataFrame:
    """What keeps a pair from analysis: case, role (target, prior_year), code and detail, a row for each of the eleven reasons.

    sets has case, role (0: target, 1: prior year) and the report's metadata (company_name, period, profile, basis, currency, unit,
    method), keys (all keys that occur in it), attachments (source_id, operative, status), records (record_type, severity,
    row_id), tables (table_type, cells of cell_id, value and resolves, an attachment's id) and indexed (ids of its cell
    index).  Of cells without a number the first is named; of duplicate, unindexed and unmet ids only the first kind that occurs."""
    cells = F.flatten(F.transform(F.coalesce("tables", F.array()), lambda t: F.coalesce(t["cells"], F.array())))
    rows = sets.withColumn("cells", cells).withColumn("cell_ids", F.transform("cells", lambda c: c["cell_id"]))
    told = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    blocking = F.filter(F.coalesce("records", F.array()), lambda r: (r["record_type"] == "note_reference_match_failure") & (r["severity"] == "blocking"))
    resolved = F.transform("cells", lambda c: c["resolves"])
    open_ = F.filter(F.coalesce("attachments", F.array()), lambda a: F.coalesce(a["operative"], F.lit(False)) & ~(F.coalesce(a["status"] == "resolved", F.lit(False)) & F.coalesce(F.array_contains(resolved, a["source_id"]), F.lit(False))))
    shown = F.transform(F.coalesce("tables", F.array()), lambda t: t["table_type"])
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, STATEMENTS)), shown))
    blank = F.filter("cells", lambda c: c["value"].isNull())
    ids, index = F.array_distinct("cell_ids"), F.coalesce("indexed", F.array().cast("array<string>"))
    missing, extra = F.array_sort(F.array_except(ids, index)), F.array_sort(F.array_except(index, ids))
    listed = lambda x: F.array_join(x, ", ")
    registry = (
        F.when(F.size("cell_ids") != F.size(ids), F.lit("duplicate cell evidence IDs"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing cell_index entries for "), listed(missing)))
        .when(F.size(extra) > 0, F.concat(F.lit("cell_index entries do not point to table cells: "), listed(extra)))
    )
    keys = F.array_intersect(F.coalesce("keys", F.array().cast("array<string>")), F.array(*map(F.lit, PRIOR_KEYS)))
    one = lambda when, code, detail=None: F.when(when, F.array(F.struct(F.lit(code).alias("code"), (F.lit("") if detail is None else detail).alias("detail"))))
    found = [
        one(~told("company_name"), "missing_company_identity"),
        one(~told("period"), "missing_period_identity"),
        one(F.col("profile") == "unknown", "unknown_report_profile"),
        one(F.col("basis") == "unknown", "unknown_report_basis"),
        one(~(F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False)) & F.coalesce(F.col("unit").isin(*UNITS), F.lit(False))), "invalid_unit_currency_normalization"),
        one(F.size(keys) > 0, "current_filing_prior_comparison_column_leakage", listed(F.array_sort(keys))),
        one(F.size(open_) > 0, "amendment_context_corrected_value_resolution_required", listed(F.transform(open_, lambda a: F.coalesce(a["source_id"], F.lit("unknown_attachment"))))),
        F.transform(blocking, lambda r: F.struct(F.lit("required_note_reference_match_failed").alias("code"), F.coalesce(r["row_id"], F.lit("unknown row")).alias("detail"))),
        one(~F.coalesce(F.col("method").isin(*HAND_AUTHORED), F.lit(False)) & (F.size(lacking) > 0), "missing_required_main_statement", listed(lacking)),
        one(F.size(blank) > 0, "numeric_parse_requirement_failed", F.coalesce(F.try_element_at(blank, F.lit(1))["cell_id"], F.lit(""))),
        one(registry.isNotNull(), "invalid_evidence_registry", registry),
    ]
    empty = F.array().cast("array<struct<code:string,detail:string>>")
    every = F.concat(*(F.coalesce(f.cast("array<struct<code:string,detail:string>>"), empty) for f in found))
    role = F.when(F.col("role") == 0, "target").otherwise("prior_year")
    return rows.select("case", role.alias("role"), F.explode(every).alias("r")).select("case", "role", "r.code", "r.detail")
