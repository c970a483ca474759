"""Queries of reports, checks, extraction and source selection; reports are nations' quarters, raw tables and source
documents are lines of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import dialects
from riskweave.operators import extraction, reports, selection
from riskweave.plans.market import _growth_sql, _named_orders, _share_sql
from riskweave.sources import html
from riskweave.sources.tables import dealt, read

PROFILES = {"AFRICA": reports.STANDARD, "AMERICA": reports.CREDIT, "ASIA": reports.SECURITIES, "EUROPE": reports.INSURANCE}
# Which sums stand for which account, as SQL over total, by status (sf, so, sp) and by priority (p1 to p5).
VALUES = {
    "revenue": "total", "trade_receivables": "so", "profit_after_tax": "p1 + p2 - p3", "operating_cash_flow": "p4 - p5", "fvtpl_assets": "p1", "fvtpl_unrealized_gain": "p2 - p4", "afs_assets": "p3", "htm_assets": "p5",
    "margin_lending": "so", "margin_impairment": "p1", "gross_written_premium": "total", "premium_receivables": "sf", "claims_expense": "p2", "insurance_reserves": "p3", "reinsurance_recoverables": "p4", "reinsurance_payables": "p5",
    "loans_to_customers": "total", "npl_loans": "sp", "loan_loss_allowance": "p1", "general_provision": "p2", "specific_provision": "p3", **{f"loan_group_{i}": f"p{i}" for i in range(1, 6)},
}
_SUMS = {"total": "amount", **{f"s{c.lower()}": f"CASE WHEN o_orderstatus = '{c}' THEN amount ELSE 0 END" for c in "FOP"}, **{f"p{i}": f"CASE WHEN urgency = '{i}' THEN amount ELSE 0 END" for i in range(1, 6)}}
NOTES = (("related_party_note", "n >= 3", "Receivables grew while cash collection slowed."), ("generic_accounting_policy", "sp > 0", "Holdings are concentrated, no issuer-level detail."))


STALE = "CASE WHEN n % 7 = 0 THEN 'before' ELSE period END"


def _reports(spark, sf, stale: bool = False) -> DataFrame:
    """Nested reports of nations' quarters; an account whose sum is 0 isn't shown; ``stale``: some cash flows are of another period."""
    urgency = read(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("urgency"))
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    profile = F.coalesce(*(F.when(F.col("r_name") == k, F.lit(v)) for k, v in PROFILES.items()), F.lit(reports.STANDARD))
    entities = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), profile.alias("profile"))
    sums = [F.expr(f"CAST(sum({v}) AS BIGINT)").alias(k) for k, v in _SUMS.items()]
    g = _named_orders(spark, sf).join(urgency, "o_orderkey").groupBy("entity", "y", "q").agg(*sums, F.count("*").alias("n")).join(entities, "entity")
    period = F.format_string("%d-Q%d", "y", "q")
    when = lambda a: STALE if stale and a == "operating_cash_flow" else "period"
    cell = lambda a: f"array(named_struct('cell_id', '{a}', 'period', {when(a)}, 'value', CAST({VALUES[a]} AS DECIMAL(38,0)), 'unit', 'VND'))"
    row = lambda a: F.expr(f"CASE WHEN {VALUES[a]} <> 0 THEN named_struct('row_id', 'r_{a}', 'standard_account', '{a}', 'label', '{a}', 'cells', {cell(a)}) END")
    g = g.withColumn("period", period)
    tables = F.array(F.struct(F.lit("t1").alias("table_id"), F.lit("quarter").alias("period_basis"), F.array_compact(F.array(*(row(a) for a in reports.ACCOUNTS))).alias("rows")))
    notes = F.array_compact(F.array(*(F.expr(f"CASE WHEN {c} THEN named_struct('note_id', 'n{i}', 'note_type', '{k}', 'text', '{t}') END") for i, (k, c, t) in enumerate(NOTES))))
    span = F.expr("CASE WHEN p1 > p2 THEN 'Revenue grew with sales volume.' WHEN p3 > 0 THEN 'Profit rose on price.' END")
    spans = F.array_compact(F.array(F.when(span.isNotNull(), F.struct(F.lit("s1").alias("span_id"), span.alias("text")))))
    index = F.expr("map('revenue', named_struct('table_id', 't1', 'row_id', 'r_revenue', 'period', period, 'value', CAST(CASE WHEN n = 4 THEN total + 1 ELSE total END AS DECIMAL(38,0))))")
    return g.select(F.concat("entity", "period").alias("report_id"), F.col("entity").alias("company"), "period", "profile", F.lit("separate").alias("basis"), tables.alias("tables"), notes.alias("notes"), spans.alias("spans"), index.alias("cell_index"))


def check_suite_research(spark, sf):
    return reports.run_checks(_reports(spark, sf))


def check_suite_runtime(spark, sf):
    return reports.run_checks(_reports(spark, sf), dialect="runtime")


def tool_gating(spark, sf):
    return reports.gating(_reports(spark, sf))


def suite_support(spark, sf):
    return reports.support(reports.run_checks(_reports(spark, sf)))


def suite_candidates(spark, sf):
    return reports.candidates(reports.run_checks(_reports(spark, sf), dialect="runtime"), "runtime")


def suite_packets(spark, sf):
    """Packets of at most two findings, with the names of those left out."""
    p = reports.packets(reports.run_checks(_reports(spark, sf)), cap=2)
    return p.select("packet_id", "target", F.array_join("checks", ",").alias("checks"), F.array_join("omitted", ",").alias("omitted"))


def report_quality(spark, sf):
    return reports.quality(_reports(spark, sf)).groupBy("report_id", "code").agg(F.count("*").alias("n"), F.min("detail").alias("first"))


def report_cells(spark, sf):
    """Flattened cells, counted and summed by account."""
    return reports.cells(_reports(spark, sf)).groupBy("standard_account").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


# Codes and labels of raw rows, by the part's number.
RAW = (
    ("131", "Phai thu ngan han cua khach hang"), ("60", "Luu chuyen tien trong ky"), ("114", "Cac khoan cho vay"), ("116", "Du phong suy giam"), ("112", "Tai san FVTPL"), ("115", "San sang de ban"), ("113", "Nam giu den ngay dao han"),
    ("01.2", "Danh gia lai FVTPL"), ("10", "Doanh thu thuan"), ("01", "Doanh thu"), ("60", "Loi nhuan sau thue"), ("20", "Luu chuyen tien thuan tu hoat dong kinh doanh"), ("421", "Loi nhuan sau thue chua phan phoi"), ("iv", "Luy ke khac"),
)


RAW_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _raw_cells() -> list:
    at = (F.col("l_partkey") % len(RAW) + 1).cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    note = F.when(F.col("l_discount") > 0.05, F.col("l_quantity").cast("int").cast("string")).otherwise("")
    return [F.element_at(F.array(*(F.lit(c) for c, _ in RAW)), at), F.element_at(F.array(*(F.lit(t) for _, t in RAW)), at), note, dialects.grouped(cents), dialects.grouped(F.floor(cents / 2).cast("long"), "."), dialects.grouped(-F.floor(cents / 3).cast("long"))]


def _raw_table():
    return F.when(F.col("l_linestatus") == "F", 0).otherwise(1)


def _raw_rows(spark, sf) -> DataFrame:
    spot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*RAW_ORDER))
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), _raw_table().alias("table"), spot.alias("pos"), F.array(*_raw_cells()).alias("cells"))


def statement_rows(spark, sf):
    return extraction.statement_rows(_raw_rows(spark, sf)).select("doc", "table", "pos", "code", "account", "bucket", F.col("value").cast("long").alias("value"))


def page_statement_rows(spark, sf):
    """The same rows by way of HTML: every order is a text with a page for each of two tables, broken declarations among them,
    which is parsed back into cells."""
    tr = F.concat(F.lit("<tr>"), F.concat_ws("\n", *(F.concat(F.lit("<td> "), c, F.lit("</td>")) for c in _raw_cells())), F.lit("</tr>"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", *RAW_ORDER, "l_linestatus", "l_discount", "l_quantity")
    rows = dealt(lines, spark, sf, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("doc"), *RAW_ORDER, _raw_table().alias("table"), tr.alias("tr"))
    of = lambda t: F.array_join(F.sort_array(F.collect_list(F.when(F.col("table") == t, F.struct(*RAW_ORDER, "tr"))))["tr"], "")
    whole = F.concat(F.lit("<h2>Page 1</h2><table>"), of(0), F.lit("</table><![><p>x<![ y]]><h2>Page 2</h2><TABLE class='t'>"), of(1), F.lit("</TABLE>"))
    pages = rows.groupBy("doc").agg(whole.alias("html"))
    packed = dealt(html.packed(pages, "doc"), spark, sf, "lineitem", "doc")
    found = extraction.statement_rows(html.unpacked(packed, "doc"))
    return found.select("doc", "table", "code", "account", "bucket", F.col("value").cast("long").alias("value"))


def assembled_reports(spark, sf):
    a = extraction.assembled(extraction.statement_rows(_raw_rows(spark, sf)))
    return a.select("doc", F.array_join("sections", ",").alias("sections"), F.size("tables").cast("long").alias("tables"), F.size("cell_index").cast("long").alias("cells"), F.aggregate(F.map_values("cell_index"), F.lit(0).cast("decimal(38,0)"), lambda x, v: (x + v).cast("decimal(38,0)")).cast("long").alias("total"))


def surface_statuses(spark, sf):
    """Orders' surfaces by event-like states: of several the last stands."""
    docs = read(spark, sf, "customer").select(F.col("c_custkey").alias("doc"))
    e = read(spark, sf, "events")
    told = e.select(F.col("user_id").alias("doc"), F.element_at(F.array(*map(F.lit, extraction.SURFACES)), (F.floor("value").cast("int") % 5 + 1)).alias("surface"), F.when(F.col("event_type") == "error", "absent_in_source").otherwise("extracted").alias("state"), F.col("event_id").alias("pos"))
    return extraction.surface_status(docs, told)


def corrected_cells(spark, sf):
    """Order totals after corrections from their lines of the first supplier digits."""
    cells = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("revenue").alias("account"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    fixes = read(spark, sf, "lineitem").where("l_discount > 0.07").join(cells, F.col("l_orderkey") == F.col("doc")).select("doc", "account", F.when(F.col("l_returnflag") == "A", F.col("value") + 1).otherwise(F.col("value")).alias("original"), (F.col("value") + F.col("l_partkey")).alias("corrected"), (F.col("l_tax") < 0.07).alias("resolved"))
    return extraction.corrected(cells, fixes)


def linked_notes(spark, sf):
    """Lines' note hints against notes of the same order: numerals and numbers meet, and so do titles of any case."""
    lines = read(spark, sf, "lineitem")
    tens = F.element_at(F.array(*map(F.lit, ("", "X", "XX", "XXX", "XL"))), (F.floor(F.col("l_linenumber") / 10) % 5 + 1).cast("int"))
    ones = F.element_at(F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), (F.col("l_linenumber") % 10 + 1).cast("int"))
    numeral = F.when(F.col("l_linenumber") < 50, F.concat(tens, ones)).otherwise(F.col("l_linenumber").cast("string"))
    notes = lines.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("note_id"), numeral.alias("number"), F.concat(F.lit("Note "), "l_linestatus").alias("title"))
    rows = lines.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row"), F.col("l_linenumber").cast("string").alias("note"), F.concat(F.lit("NOTE "), "l_linestatus").alias("title")).distinct()
    return extraction.note_links(rows, notes)


def _sources(spark, sf) -> DataFrame:
    spot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_custkey") % 2 == 0, "consolidated").otherwise("separate").alias("requested"))
    c = F.col
    placed = dealt(read(spark, sf, "lineitem"), spark, sf, "lineitem", "l_orderkey").withColumn("spot", spot)
    rows = placed.join(dealt(o, spark, sf, "lineitem", "l_orderkey"), "l_orderkey")
    return rows.select(
        c("l_orderkey").alias("package"), c("spot").alias("doc"), F.when(c("l_quantity") < 3, None).when(c("l_quantity") < 6, "inconclusive").otherwise("classified").alias("state"),
        F.when(c("l_partkey") % 5 == 0, "variance_explanation").when(c("l_partkey") % 11 == 0, "amendment_context_attachment").otherwise("financial_statement").alias("role"), F.when(c("l_suppkey") % 5 == 0, "en").when(c("l_suppkey") % 7 == 0, "mixed").otherwise("vi").alias("language"),
        F.when(c("l_returnflag") == "A", "consolidated").when(c("l_returnflag") == "N", "parent").otherwise("separate").alias("basis"), "requested", (c("l_discount") < 0.09).alias("full"), (c("l_partkey") % 5 == 0).alias("supporting"), (c("l_tax") > 0.06).alias("searchable"),
        (c("l_linestatus") == "F").alias("confirmed"), (c("l_partkey") % 13 > 0).alias("same"), (c("l_tax") < 0.02).alias("amended"), (c("l_partkey") % 3 == 0).alias("reviewed"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("fetched"),
    )


def source_selection(spark, sf):
    return selection.selected(_sources(spark, sf))


def source_records(spark, sf):
    return selection.named(_sources(spark, sf)).select("package", "doc", "kind")


def source_confirmation(spark, sf):
    docs = _sources(spark, sf)
    return selection.confirmation(selection.selected(docs), selection.named(docs))


NAMES = "check_suite_research check_suite_runtime tool_gating suite_support suite_candidates suite_packets report_quality report_cells statement_rows page_statement_rows assembled_reports surface_statuses corrected_cells linked_notes source_selection source_records source_confirmation".split()
QUERIES = {name: globals()[name] for name in NAMES}

_ACCOUNTS = ", ".join(f"nullif({VALUES[a]}, 0) AS {a}" for a in reports.ACCOUNTS)
_WIDE = f"""
WITH o AS (
  SELECT n_name AS entity, CASE r_name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PROFILES.items())} ELSE '{reports.STANDARD}' END AS profile, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderstatus, substring(o_orderpriority, 1, 1) AS urgency, CAST(round(o_totalprice * 100) AS BIGINT) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT entity, profile, y, q, {', '.join(f'CAST(sum({v}) AS BIGINT) AS {k}' for k, v in _SUMS.items())}, count(*) AS n FROM o GROUP BY entity, profile, y, q),
r AS (SELECT entity || y || '-Q' || q AS report_id, entity, profile, y, q, n, n >= 3 AS related, sp > 0 AS policy, n >= 3 OR sp > 0 AS noted, p1 > p2 AS by_revenue, p1 > p2 OR p3 > 0 AS told, {_ACCOUNTS} FROM g),
w AS (SELECT a.report_id AS target, b.report_id AS prior, a.profile, a.related, a.policy, a.noted, a.told, a.by_revenue, {', '.join(f'a.{x}, b.{x} AS {x}_prior' for x in reports.ACCOUNTS)} FROM r a JOIN r b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1)"""


def _grown(x: str) -> str:
    return f"({_growth_sql(x, x + '_prior')})"


_RATIO = f"({_share_sql('operating_cash_flow', 'profit_after_tax')})"
_BOTH = "profit_after_tax > 0 AND operating_cash_flow < 0"
_S, _C, _T, _I = reports.STANDARD, reports.CREDIT, reports.SECURITIES, reports.INSURANCE
_BAD, _ALL = (" + ".join(f"loan_group_{i}{{0}}" for i in r) for r in (range(3, 6), range(1, 6)))
_PREMIUM = (_I, "gross_written_premium premium_receivables", "", "true", f"{_grown('premium_receivables')} - {_grown('gross_written_premium')}", "m > 2000")
_GROWTH = [
    ("revenue_growth_high", _S, "revenue", "", "true", _grown("revenue"), "m > 2000"),
    ("receivables_growth_outpaces_revenue", _S, "revenue trade_receivables", "", "true", f"{_grown('trade_receivables')} - {_grown('revenue')}", "m > 1000"),
    ("positive_profit_negative_cfo", _S, "", "profit_after_tax operating_cash_flow", "true", _RATIO, _BOTH),
    ("cfo_net_income_gap_high", _S, "", "profit_after_tax operating_cash_flow", "true", _RATIO, f"m < 7000 AND NOT ({_BOTH})"),
]
_COVER = f"({_share_sql('loan_loss_allowance', 'npl_loans')}) - ({_share_sql('loan_loss_allowance_prior', 'npl_loans_prior')})"
_RUNTIME = [
    *_GROWTH,
    ("securities_fvtpl_profit_bridge_high", _T, "", "fvtpl_unrealized_gain profit_after_tax operating_cash_flow", "true", _share_sql("abs(fvtpl_unrealized_gain)", "profit_after_tax"), f"m > 3000 AND (operating_cash_flow < 0 OR {_RATIO} < 7000)"),
    ("insurance_premium_receivables_outpace_gwp", *_PREMIUM),
    ("credit_institution_npl_ratio_rising_without_coverage_improvement", _C, "npl_loans loans_to_customers loan_loss_allowance", "", "true", f"CASE WHEN {_COVER} IS NOT NULL THEN ({_share_sql('npl_loans', 'loans_to_customers')}) - ({_share_sql('npl_loans_prior', 'loans_to_customers_prior')}) END", f"m > 100 AND {_COVER} <= 0"),
    ("related_party_disclosure_present", "any", "", "", "true", "CASE WHEN related THEN 1 ELSE 0 END", "m > 0"),
    ("accounting_policy_disclosure_present", "any", "", "", "true", "CASE WHEN policy THEN 1 ELSE 0 END", "m > 0"),
    ("variance_explanation_present", "any", "", "", "true", "CASE WHEN told THEN 1 ELSE 0 END", "m > 0"),
]
_RESEARCH = [
    *_GROWTH[:3],
    ("disclosure_narrative_tension", _S, "", "", "noted AND told", "CASE WHEN related AND by_revenue THEN 1 ELSE 0 END", "m > 0"),
    ("variance_explanation_weak_connection", _S, "profit_after_tax", "", "told", _grown("profit_after_tax"), "abs(m) > 2000 AND by_revenue"),
    ("loan_quality_deterioration", _C, " ".join(f"loan_group_{i}" for i in range(1, 6)), "", "true", f"({_share_sql(f'({_BAD.format(str())})', f'({_ALL.format(str())})')}) - ({_share_sql(f'''({_BAD.format('_prior')})''', f'''({_ALL.format('_prior')})''')})", "m > 75"),
    ("provision_growth_lags_risk_assets", _C, "loans_to_customers general_provision specific_provision", "", "true", f"{_grown('loans_to_customers')} - ({_growth_sql('(general_provision + specific_provision)', '(general_provision_prior + specific_provision_prior)')})", "m > 1000"),
    ("ctck_margin_book_provision_gap", _T, "margin_lending margin_impairment", "", "true", f"{_grown('margin_lending')} - {_grown('margin_impairment')}", f"m > 1500 AND ({_share_sql('margin_impairment', 'margin_lending')}) < ({_share_sql('margin_impairment_prior', 'margin_lending_prior')})"),
    ("ctck_trading_book_valuation_concentration_with_weak_disclosure", _T, "fvtpl_assets afs_assets htm_assets", "", "true", _share_sql("fvtpl_assets", "(fvtpl_assets + afs_assets + htm_assets)"), f"m > 6000 AND {_grown('fvtpl_assets')} > 2000 AND policy"),
    ("ctck_profit_supported_by_noncash_fvtpl_with_weak_cash_support", _T, "", "fvtpl_unrealized_gain profit_after_tax operating_cash_flow", "true", _share_sql("fvtpl_unrealized_gain", "profit_after_tax"), f"m > 3000 AND {_BOTH}"),
    ("ctck_fvtpl_volatility_context_only", _T, "", "fvtpl_unrealized_gain", "noted", "fvtpl_unrealized_gain", "false"),
    ("premium_receivables_growth_outpaces_premium_growth", *_PREMIUM),
    ("claims_reserve_growth_lags_claims_and_premium_exposure", _I, "gross_written_premium claims_expense insurance_reserves", "", "true", f"CAST(floor(({_grown('gross_written_premium')} + {_grown('claims_expense')}) / 2) AS BIGINT) - {_grown('insurance_reserves')}", "m > 2000"),
    ("reinsurance_recoverables_expand_with_weak_cash_support", _I, "reinsurance_recoverables", "operating_cash_flow", "true", _grown("reinsurance_recoverables"), "m > 3000 AND operating_cash_flow < 0"),
]


def _suite(suite: list[tuple], dialect: str) -> str:
    """All checks stacked over the wide pairs ``w`` as ``f``."""
    out = []
    for name, profile, two, one, told, metric, condition in suite:
        there = " AND ".join([told, *(f"{a} IS NOT NULL" for a in (two + " " + one).split()), *(f"{a}_prior IS NOT NULL" for a in two.split())])
        mine = "true" if profile == "any" else f"profile = '{profile}'"
        out.append(f"SELECT target, prior, profile, '{name}' AS \"check\", CASE WHEN {mine} AND {there} THEN CAST(m AS BIGINT) END AS metric_bp, CASE WHEN NOT ({mine}) THEN 'wrong_profile' WHEN NOT ({there}) THEN 'missing_evidence' WHEN m IS NULL THEN 'zero_denominator' WHEN coalesce({condition}, false) THEN 'flagged' ELSE 'clear' END AS status FROM (SELECT *, {metric} AS m FROM w) WHERE {mine if dialect == 'research' else 'true'}")
    return f"{_WIDE}, f AS ({' UNION ALL '.join(out)})"


_TOLD = {"notes": "noted", "spans": "told", "related_party_note": "related", "accounting_policy_change": "false"}


def _gates() -> str:
    out = []
    for tool, accounts, told in reports.TOOLS:
        own = next(name for start, name in reports.PROFILE_OF if tool.startswith(start))
        lost = f"array_to_string(list_filter([{', '.join(f'''CASE WHEN {a} IS NULL OR {a}_prior IS NULL THEN '{a}' END''' for a in accounts)}], lambda x: x IS NOT NULL), ', ')" if accounts else "''"
        shown = " AND ".join(_TOLD[t] for t in told) or "true"
        out.append(f"SELECT target, prior, '{tool}' AS tool, CASE WHEN profile <> '{own}' THEN 'disabled_not_applicable' WHEN lost <> '' THEN 'disabled_missing_context' WHEN NOT ({shown}) THEN 'skipped_missing_disclosure_context' ELSE 'enabled' END AS status, CASE WHEN profile = '{own}' THEN lost ELSE '' END AS missing FROM (SELECT *, {lost} AS lost FROM w)")
    return f"{_WIDE} {' UNION ALL '.join(out)}"


_CAND = ", ".join(f"('{n}', '{c}', '{p}', ['{chr(39).join(s).replace(chr(39), chr(39) + ', ' + chr(39))}'])" for n, c, p, s in reports.CANDIDATES["runtime"])
_RAWROWS = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(l_partkey % {len(RAW)} AS INTEGER) AS k, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS tab, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
x AS (SELECT l_orderkey, tab, bool_or(k IN (1, 11)) AS cash, bool_or(k = 13) AS ytd FROM l GROUP BY 1, 2),
a AS (SELECT l.*, cash, ytd, CASE WHEN k = 0 THEN 'trade_receivables' WHEN k IN (1, 11) OR (k = 10 AND cash) OR (k = 13 AND cash AND l_discount > 0.05 AND CAST(l_quantity AS INTEGER) = 20) THEN 'operating_cash_flow' WHEN k = 2 THEN 'margin_lending' WHEN k = 3 THEN 'margin_impairment' WHEN k = 4 THEN 'fvtpl_assets' WHEN k = 5 THEN 'afs_assets' WHEN k = 6 THEN 'htm_assets' WHEN k = 7 THEN 'fvtpl_unrealized_gain' WHEN k IN (8, 9) THEN 'revenue' WHEN k = 10 THEN 'profit_after_tax' END AS account FROM l JOIN x ON l.l_orderkey = x.l_orderkey AND l.tab = x.tab),
b AS (SELECT *, ['{"', '".join(c for c, _ in RAW)}'][k + 1] AS own, CASE WHEN k = 13 THEN '20' ELSE own END AS code, CASE WHEN account = 'profit_after_tax' OR (account = 'fvtpl_unrealized_gain' AND ytd) THEN -(cents // 3) ELSE cents END AS value,
  CASE WHEN account IN ('fvtpl_unrealized_gain', 'profit_after_tax') THEN 'income_to_date' WHEN account = 'revenue' THEN 'income_quarter' WHEN account = 'operating_cash_flow' THEN 'cash_flow' ELSE 'balance' END AS bucket FROM a WHERE account IS NOT NULL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, bucket, account ORDER BY CASE WHEN bucket = 'income_quarter' AND k = 9 THEN 1 ELSE 0 END, tab, pos) AS n FROM b) WHERE n = 1)"""
_SOURCES = """WITH d AS (SELECT l_orderkey AS package, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS doc, CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 6 THEN 'inconclusive' ELSE 'classified' END AS state,
  CASE WHEN l_partkey % 5 = 0 THEN 'variance_explanation' WHEN l_partkey % 11 = 0 THEN 'amendment_context_attachment' ELSE 'financial_statement' END AS role, CASE WHEN l_suppkey % 5 = 0 THEN 'en' WHEN l_suppkey % 7 = 0 THEN 'mixed' ELSE 'vi' END AS lang, CASE l_returnflag WHEN 'A' THEN 'consolidated' ELSE 'own' END AS basis, CASE WHEN o_custkey % 2 = 0 THEN 'consolidated' ELSE 'own' END AS requested,
  l_discount < 0.09 AS complete, l_partkey % 5 = 0 AS supporting, l_tax > 0.06 AS searchable, l_linestatus = 'F' AS confirmed, l_partkey % 13 > 0 AS same, l_tax < 0.02 AS amended, l_partkey % 3 = 0 AS reviewed, strftime(l_shipdate, '%Y-%m-%d') AS fetched FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT *, role = 'financial_statement' AND complete AND basis = requested AS main FROM d),
h AS (SELECT package, bool_or(main AND lang IN ('vi', 'mixed')) AS has_main FROM m GROUP BY 1),
t AS (SELECT DISTINCT package, role, basis FROM m WHERE state = 'classified' AND supporting AND lang = 'vi'),
k AS (SELECT m.*, CASE WHEN state IS NULL THEN 'missing_classifier_record' WHEN state <> 'classified' THEN 'inconclusive_classifier_record' WHEN m.role <> 'financial_statement' AND lang = 'en' AND (has_main OR t.role IS NOT NULL) THEN 'english_supporting_duplicate_ignored' WHEN m.role <> 'financial_statement' THEN 'supporting'
  WHEN main AND lang IN ('vi', 'mixed') THEN 'candidate' WHEN main AND lang = 'en' THEN 'english_financial_statement_duplicate_ignored' ELSE 'ignored' END AS kind FROM m JOIN h ON h.package = m.package LEFT JOIN t ON t.package = m.package AND t.role = m.role AND t.basis = m.basis)"""
_SELECTED = f"""{_SOURCES},
g AS (SELECT package, count(*) FILTER (WHERE kind = 'candidate') AS n, count(*) FILTER (WHERE kind = 'candidate' AND amended) AS na, count(*) FILTER (WHERE kind = 'candidate' AND reviewed) AS nr, count(*) FILTER (WHERE kind = 'candidate' AND searchable) AS ns, count(*) FILTER (WHERE kind = 'candidate' AND searchable AND confirmed) AS nk,
  bool_and(same AND lang = 'vi') FILTER (WHERE kind = 'candidate') AS same, max(fetched) FILTER (WHERE kind = 'candidate' AND reviewed) AS fr, max(fetched) FILTER (WHERE kind = 'candidate' AND NOT reviewed) AS fu, bool_or(coalesce(state = 'inconclusive', false) AND role = 'financial_statement' AND lang = 'vi' AND basis = requested AND reviewed) AS doubt,
  min(doc) FILTER (WHERE kind = 'candidate') AS d1, min(doc) FILTER (WHERE kind = 'candidate' AND amended) AS da, min(doc) FILTER (WHERE kind = 'candidate' AND reviewed) AS dr, min(doc) FILTER (WHERE kind = 'candidate' AND searchable AND confirmed) AS dk, min(doc) FILTER (WHERE kind = 'candidate' AND NOT searchable) AS dd,
  count(*) FILTER (WHERE kind = 'supporting') AS supporting, count(*) FILTER (WHERE kind NOT IN ('supporting', 'candidate')) AS ignored FROM k GROUP BY package),
c AS (SELECT *, CASE WHEN n = 1 AND ns = 1 AND nk = 0 THEN 'searchable_identity_not_confirmed' WHEN doubt AND n > 0 THEN 'inconclusive_reviewed_full_fs_identity' WHEN n = 1 THEN 'canonical_source_selected' WHEN na = 1 AND n > 1 AND same THEN 'amended_full_fs_supersedes_original'
  WHEN nr = 1 AND n > 1 AND same AND fr > fu THEN 'reviewed_full_fs_supersedes_unreviewed' WHEN nk = 1 AND n - ns <= 1 THEN 'searchable_version_selected' WHEN ns = 1 AND n - ns = 1 THEN 'searchable_identity_not_confirmed_fallback' WHEN nr = 1 AND n > 1 AND same THEN 'ambiguous_reviewed_supersession_order'
  WHEN n > 1 THEN 'ambiguous_financial_statement_candidates' ELSE 'missing_requested_basis_vietnamese_financial_statement' END AS code FROM g),
e AS (SELECT package, code, CASE code WHEN 'canonical_source_selected' THEN d1 WHEN 'amended_full_fs_supersedes_original' THEN da WHEN 'reviewed_full_fs_supersedes_unreviewed' THEN dr WHEN 'searchable_version_selected' THEN dk WHEN 'searchable_identity_not_confirmed_fallback' THEN dd END AS doc, CASE WHEN code IN ('amended_full_fs_supersedes_original', 'reviewed_full_fs_supersedes_unreviewed') THEN n - 1 ELSE 0 END AS superseded, supporting, ignored FROM c),
z AS (SELECT package, CASE WHEN doc IS NOT NULL THEN 'selected' WHEN code LIKE 'ambiguous%' THEN 'hitl_needed' ELSE 'recoverable_data_error' END AS status, code, doc, superseded, supporting, ignored FROM e)"""

SQL = {
    "check_suite_research": f"{_suite(_RESEARCH, 'research')} SELECT * FROM f",
    "check_suite_runtime": f"{_suite(_RUNTIME, 'runtime')} SELECT * FROM f",
    "tool_gating": _gates(),
    "suite_support": f"{_suite(_RESEARCH, 'research')}, n AS (SELECT target, prior, count(*) FILTER (WHERE status = 'flagged') AS n_flagged FROM f GROUP BY 1, 2) SELECT *, CASE WHEN n_flagged >= 2 THEN 'supported' WHEN n_flagged = 1 THEN 'weak' ELSE 'insufficient' END AS support, CASE WHEN n_flagged >= 2 THEN 85 WHEN n_flagged = 1 THEN 60 ELSE 30 END AS confidence_pct, CASE WHEN n_flagged >= 2 THEN 'high' WHEN n_flagged = 1 THEN 'medium' ELSE 'low' END AS severity FROM n",
    "suite_candidates": f"{_suite(_RUNTIME, 'runtime')}, flags AS (SELECT target, list(\"check\") AS l FROM f WHERE status = 'flagged' GROUP BY 1), rules(name, risk_category, priority, signals) AS (VALUES {_CAND}) SELECT target, 'CAND_' || target || '_' || name || '_001' AS candidate_id, risk_category, priority, array_to_string(signals, ',') AS signals FROM flags JOIN rules ON list_has_all(l, signals)",
    "suite_packets": f"{_suite(_RESEARCH, 'research')}, p AS (SELECT target, list(\"check\" ORDER BY \"check\") AS l FROM f WHERE status = 'flagged' GROUP BY 1) SELECT 'PACKET_' || target || '_' || lpad(CAST(row_number() OVER (PARTITION BY regexp_replace(target, '[0-9]{{4}}.*$', '') ORDER BY target) AS VARCHAR), 3, '0') AS packet_id, target, array_to_string(l[1:2], ',') AS checks, array_to_string(l[3:], ',') AS omitted FROM p",
    "report_quality": f"{_WIDE}, cells AS (SELECT report_id, unnest(['{chr(39).join(reports.ACCOUNTS).replace(chr(39), chr(39) + ', ' + chr(39))}']) AS id, unnest([{', '.join(reports.ACCOUNTS)}]) AS value, n FROM r), v AS (SELECT report_id, id FROM cells WHERE value IS NOT NULL AND id <> 'revenue') SELECT report_id, 'cell_not_indexed' AS code, count(*) AS n, min(id) AS first FROM v GROUP BY 1 UNION ALL SELECT report_id, 'index_value_differs', 1, 'revenue' FROM r WHERE n = 4 AND revenue IS NOT NULL",
    "report_cells": f"{_WIDE}, cells AS (SELECT unnest(['{chr(39).join(reports.ACCOUNTS).replace(chr(39), chr(39) + ', ' + chr(39))}']) AS standard_account, unnest([{', '.join(reports.ACCOUNTS)}]) AS value FROM r) SELECT standard_account, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM cells WHERE value IS NOT NULL GROUP BY 1",
    "page_statement_rows": f"{_RAWROWS} SELECT l_orderkey AS doc, tab AS \"table\", code, account, bucket, value FROM s",
    "statement_rows": f"{_RAWROWS} SELECT l_orderkey AS doc, tab AS \"table\", CAST(pos AS INTEGER) AS pos, code, account, bucket, value FROM s",
    "assembled_reports": f"{_RAWROWS} SELECT l_orderkey AS doc, array_to_string(list_filter([CASE WHEN bool_or(bucket = 'balance') THEN 'balance_sheet' END, CASE WHEN bool_or(bucket = 'cash_flow') THEN 'cash_flow_statement' END, CASE WHEN bool_or(bucket LIKE 'income%') THEN 'income_statement' END], lambda x: x IS NOT NULL), ',') AS sections, count(DISTINCT bucket) AS tables, count(*) AS cells, CAST(sum(value) AS BIGINT) AS total FROM s GROUP BY 1",
    "surface_statuses": f"WITH t AS (SELECT user_id, ['{chr(39).join(extraction.SURFACES).replace(chr(39), chr(39) + ', ' + chr(39))}'][CAST(floor(value) AS INTEGER) % 5 + 1] AS surface, event_id, CASE WHEN event_type = 'error' THEN 'absent_in_source' ELSE 'extracted' END AS state FROM events), l AS (SELECT user_id, surface, arg_max(state, event_id) AS state FROM t GROUP BY 1, 2), d AS (SELECT c_custkey AS doc, unnest(['{chr(39).join(extraction.SURFACES).replace(chr(39), chr(39) + ', ' + chr(39))}']) AS surface FROM customer) SELECT doc, d.surface, coalesce(state, 'unsupported_by_extraction_path') AS state FROM d LEFT JOIN l ON user_id = doc AND l.surface = d.surface",
    "corrected_cells": "WITH c AS (SELECT o_orderkey AS doc, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders), f AS (SELECT doc, count(*) AS n, min(CASE WHEN l_returnflag = 'A' THEN value + 1 ELSE value END) AS original, min(value + l_partkey) AS corrected, bool_and(l_tax < 0.07) AS resolved FROM lineitem JOIN c ON l_orderkey = doc WHERE l_discount > 0.07 GROUP BY 1), k AS (SELECT c.doc, value, corrected, CASE WHEN n IS NULL THEN 'as_filed' WHEN n > 1 THEN 'duplicate_correction' WHEN NOT resolved THEN 'unresolved_correction' WHEN original <> value THEN 'original_value_differs' ELSE 'corrected' END AS code FROM c LEFT JOIN f ON f.doc = c.doc) SELECT doc, 'revenue' AS account, CASE WHEN code = 'corrected' THEN corrected ELSE value END AS value, code FROM k",
    "linked_notes": "WITH r AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS row, l_linestatus AS t FROM lineitem), n AS (SELECT l_orderkey AS doc, l_linenumber AS row, l_linestatus AS t, l_partkey || '-' || l_suppkey AS note_id FROM lineitem WHERE l_returnflag <> 'A'), f AS (SELECT r.doc, r.row, count(note_id) AS n, min(note_id) AS note_id FROM r LEFT JOIN n ON n.doc = r.doc AND n.row = r.row AND n.t = r.t GROUP BY 1, 2) SELECT doc, row, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'linked' END AS status, CASE WHEN n = 1 THEN note_id END AS note_id FROM f",
    "source_selection": f"{_SELECTED} SELECT package, status, code, CAST(doc AS INTEGER) AS doc, superseded, supporting, ignored FROM z",
    "source_records": f"{_SOURCES} SELECT package, CAST(doc AS INTEGER) AS doc, kind FROM k",
    "source_confirmation": f"{_SELECTED}, r AS (SELECT package, count(*) FILTER (WHERE kind IN ('missing_classifier_record', 'inconclusive_classifier_record')) AS errors, count(*) FILTER (WHERE kind LIKE 'english%') AS warnings, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY doc) FILTER (WHERE kind = 'candidate') AS c FROM k GROUP BY 1) SELECT z.package, status, errors, warnings, CASE WHEN status = 'hitl_needed' THEN coalesce(c, '') ELSE '' END AS asked FROM z JOIN r ON r.package = z.package",
}
