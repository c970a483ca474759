"""Findings with their evidence on golden reports, every abstention with its signal, and every reason of the extraction gate."""

from decimal import Decimal

import pytest

from riskweave.operators import checks, findings, reports


def report(company, year, profile, accounts, basis="quarter", periods=None, notes=(), spans=()):
    rid, period = f"{company}-{year}", f"{year}-Q3"
    rows = [(f"r{i}", a, a, [(f"C_{a}", (periods or {}).get(a, period), None if v is None else Decimal(v), "VND")]) for i, (a, v) in enumerate(accounts.items())]
    return (rid, company, period, profile, "separate", [("t1", basis, rows)], list(notes), list(spans), {})


def pair(company, profile, accounts, **more):
    return [report(company, y, profile, {a: v[i] for a, v in accounts.items()}, **more) for i, y in enumerate((2025, 2024))]


def found(spark, rows):
    frame = spark.createDataFrame(rows, reports.SCHEMA)
    return {(r["target"].split("-")[0], r["tool_result_id"].split("_", 2)[2].rsplit("_", 1)[0]): r for r in findings.findings(frame).collect()}


BANK = {"loans_to_customers": (1000, 800), "npl_loans": (50, 20), "loan_loss_allowance": (30, 16)}
PREMIUM = {"premium_receivables": (680000, 310000), "gross_written_premium": (1920000, 1360000)}
CASH = {"profit_after_tax": (120000, 100000), "operating_cash_flow": (-30000, 70000)}


@pytest.fixture(scope="module")
def got(spark):
    rows = pair("std", reports.STANDARD, {"revenue": (150000, 100000), "trade_receivables": (90000, 45000), **CASH})
    rows += pair("low", reports.STANDARD, {"profit_after_tax": (100, 90), "operating_cash_flow": (69, 1)}) + pair("calm", reports.STANDARD, {"revenue": (120, 100), "profit_after_tax": (100, 90), "operating_cash_flow": (70, 1)})
    rows += pair("bank", reports.CREDIT, BANK) + pair("ins", reports.INSURANCE, PREMIUM) + pair("sec", reports.SECURITIES, {"fvtpl_unrealized_gain": (-210000, 84000), "profit_after_tax": (330000, 240000), "operating_cash_flow": (-125000, 98000)})
    rows += pair("late", reports.STANDARD, CASH, periods={"profit_after_tax": "2020-Q1"}) + pair("zero", reports.STANDARD, {"revenue": (5, 0), "profit_after_tax": (0, 1), "operating_cash_flow": (3, 1)}) + pair("nil", reports.INSURANCE, {**PREMIUM, "gross_written_premium": (1920000, 0)})
    told = dict(notes=[("n0", "generic_accounting_policy", " "), ("n1", "generic_accounting_policy", "Policy."), ("n2", "related_party_note", "Party."), ("n3", "accounting_policy_change", "Change.")], spans=[("s1", "Sales."), ("s2", None)])
    return found(spark, rows + pair("told", "other", {}, **told) + pair("huge", reports.STANDARD, {"revenue": (6 * 10**14, 10**14)}))


def of(row):
    return row["signal_id"], row["flag"], row["status"], row["metric"]


def test_metrics_and_signals(got):
    assert of(got["std", "REV_GROWTH"]) == ("revenue_growth_high", True, "flagged", 5000)
    assert of(got["std", "REC_VS_REV"]) == ("receivables_growth_outpaces_revenue", True, "flagged", 5000)
    assert of(got["std", "CASH"]) == ("positive_profit_negative_cfo", True, "flagged", -2500)
    assert of(got["low", "CASH"]) == ("cfo_net_income_gap_high", True, "flagged", 6900)
    assert of(got["calm", "CASH"]) == ("earnings_cashflow_support_not_weak", False, "clear", 7000)
    assert of(got["calm", "REV_GROWTH"]) == ("revenue_growth_not_high", False, "clear", 2000)
    assert of(got["bank", "BANK_LOAN_QUALITY"]) == ("credit_institution_npl_ratio_rising_without_coverage_improvement", True, "flagged", 250)
    assert of(got["ins", "INS_PREM_REC"]) == ("insurance_premium_receivables_outpace_gwp", True, "flagged", 7817)
    assert of(got["sec", "SEC_FVTPL_CASH"]) == ("securities_fvtpl_profit_bridge_high", True, "flagged", 6364)
    assert of(got["huge", "REV_GROWTH"]) == ("revenue_growth_high", True, "flagged", 50000)


def test_evidence_in_order(got):
    refs = lambda row: [(r["evidence_ref_type"], r["ref_id"], r["role"]) for r in row["refs"]]
    cell = lambda report, account: ("table_cell", f"{report}:C_{account}", "input")
    assert refs(got["std", "REC_VS_REV"]) == [cell(f"std-{y}", a) for a in ("trade_receivables", "revenue") for y in (2025, 2024)]
    assert refs(got["bank", "BANK_LOAN_QUALITY"]) == [cell(f"bank-{y}", a) for a in ("loans_to_customers", "npl_loans", "loan_loss_allowance") for y in (2025, 2024)]
    assert refs(got["std", "CASH"]) == [cell("std-2025", a) for a in ("profit_after_tax", "operating_cash_flow")]
    assert [(i["name"], int(i["value"]), i["cell_id"]) for i in got["ins", "INS_PREM_REC"]["inputs"]][:2] == [("premium_receivables", 680000, "C_premium_receivables"), ("premium_receivables_prior", 310000, "C_premium_receivables")]
    assert refs(got["told", "POLICY_DISC"]) == [("accounting_policy_span", "told-2025:n1", "input")] and got["told", "POLICY_DISC"]["metric"] == 2
    assert refs(got["told", "RPT_DISC"]) == [("related_party_note_span", "told-2025:n2", "input")] and refs(got["told", "VAR_DISC"]) == [("variance_explanation_span", "told-2025:s1", "input")]


def test_every_abstention(got):
    assert of(got["bank", "REV_GROWTH"])[:3] == ("standard_corporate_revenue_wrong_profile", False, "wrong_profile") and got["bank", "REV_GROWTH"]["refs"] == []
    assert of(got["std", "SEC_FVTPL_CASH"])[0] == "securities_fvtpl_wrong_profile" and of(got["std", "BANK_LOAN_QUALITY"])[0] == "credit_institution_loan_quality_wrong_profile"
    assert of(got["low", "REC_VS_REV"]) == ("standard_corporate_receivables_vs_revenue_missing_evidence", False, "missing_evidence", None) and got["low", "REC_VS_REV"]["refs"] == []
    assert of(got["late", "CASH"]) == ("earnings_cashflow_wrong_period", False, "wrong_period", None) and len(got["late", "CASH"]["refs"]) == 2
    assert of(got["zero", "CASH"]) == ("earnings_cashflow_zero_denominator", False, "zero_denominator", None) and len(got["zero", "CASH"]["refs"]) == 2
    assert of(got["nil", "INS_PREM_REC"]) == ("insurance_premium_receivables_zero_comparison", False, "zero_denominator", None)
    assert of(got["std", "VAR_DISC"]) == ("variance_explanation_missing_or_unsupported", False, "clear", 0) and got["std", "VAR_DISC"]["refs"] == []


def test_period_bases_are_tried_in_order(spark):
    table = lambda name, basis, value: (name, basis, [("r", "premium_receivables", "x", [(f"C_{name}", "2025-Q3", Decimal(value), "VND")])])
    rows = [("R", "c", "2025-Q3", reports.INSURANCE, "separate", [table("a", "quarter", 1), table("b", "year_to_date", 2), table("d", "balance_sheet_date", 3)][:n], [], [], {}) for n in (1, 2, 3)]
    frame = spark.createDataFrame([(f"R{i}", *r[1:]) for i, r in enumerate(rows)], reports.SCHEMA)
    got = {r["report_id"]: r["premium_receivables"]["cell_id"] for r in findings.account_cells(frame, {"premium_receivables": ("balance_sheet_date", "year_to_date")}).collect()}
    assert got == {"R0": "C_a", "R1": "C_b", "R2": "C_d"}


SETS = (
    "case string, role int, company_name string, period string, profile string, basis string, currency string, unit string, method string, keys array<string>, "
    "attachments array<struct<source_id:string,operative:boolean,status:string>>, records array<struct<record_type:string,severity:string,row_id:string>>, "
    "tables array<struct<table_type:string,cells:array<struct<cell_id:string,value:bigint,resolves:string>>>>, indexed array<string>"
)
GOOD = ("FPT", "2025-Q3", "standard_corporate", "separate", "VND", "vnd", "ocr", ["value"], [], [], [(t, [(f"c{i}", i, None)]) for i, t in enumerate(findings.STATEMENTS)], ["c0", "c1", "c2"])
NAMES = "company_name period profile basis currency unit method keys attachments records tables indexed".split()
WRONG = {
    "missing_company_identity": (dict(company_name=" "), ""),
    "missing_period_identity": (dict(period=None), ""),
    "unknown_report_profile": (dict(profile="unknown"), ""),
    "unknown_report_basis": (dict(basis="unknown"), ""),
    "invalid_unit_currency_normalization": (dict(unit="usd"), ""),
    "current_filing_prior_comparison_column_leakage": (dict(keys=["value", "prior_year_value", "comparison_value"]), "comparison_value, prior_year_value"),
    "amendment_context_corrected_value_resolution_required": (dict(attachments=[("A1", True, "open"), ("A2", False, "open"), (None, True, None), ("A3", True, "resolved")]), "A1, unknown_attachment, A3"),
    "required_note_reference_match_failed": (dict(records=[("note_reference_match_failure", "blocking", None), ("note_reference_match_failure", "warning", "r2")]), "unknown row"),
    "missing_required_main_statement": (dict(tables=[("income_statement", [("c0", 1, None)])], indexed=["c0"]), "balance_sheet, cash_flow_statement"),
    "numeric_parse_requirement_failed": (dict(tables=[(t, [(f"c{i}", None, None)]) for i, t in enumerate(findings.STATEMENTS)]), "c0"),
    "invalid_evidence_registry": (dict(indexed=["c0", "c2", "zz"]), "missing cell_index entries for c1"),
}


def test_every_reason_of_the_gate(spark):
    rows = [("good", 0, *GOOD), ("hand", 0, *GOOD[:6], "hand_authored_reference_v1", *GOOD[7:10], [], []), ("solved", 0, *GOOD[:8], [("A1", True, "resolved")], [], [(t, [(f"c{i}", i, "A1")]) for i, t in enumerate(findings.STATEMENTS)], GOOD[-1])]
    rows += [(code, 1, *(changes.get(n, v) for n, v in zip(NAMES, GOOD))) for code, (changes, _) in WRONG.items()]
    rows += [("twice", 1, *GOOD[:10], [(t, [("c0", 1, None)]) for t in findings.STATEMENTS], ["c0"]), ("extra", 1, *GOOD[:11], ["c0", "c1", "c2", "x"])]
    got = {(r["case"], r["role"], r["code"], r["detail"]) for r in findings.gate(spark.createDataFrame(rows, SETS)).collect()}
    want = {(code, "prior_year", code, detail) for code, (_, detail) in WRONG.items()}
    assert got == want | {("twice", "prior_year", "invalid_evidence_registry", "duplicate cell evidence IDs"), ("extra", "prior_year", "invalid_evidence_registry", "cell_index entries do not point to table cells: x")}


def test_growth_of_large_amounts(spark):
    frame = spark.createDataFrame([(6 * 10**14, 10**14), (-(9 * 10**18), 9 * 10**18), (5, 0)], "a long, b long")
    assert [r[0] for r in frame.select(checks.growth_bp("a", "b")).collect()] == [50000, -20000, None]
    assert [r[0] for r in frame.select(checks.share_bp("a", "b")).collect()] == [60000, -10000, None]
