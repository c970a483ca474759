"""Queries of synthetic packets, matched pairs and metadata rows over orders, lines, nations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import synthetic as op
from riskweave.operators.checks import growth_bp, prior_year
from riskweave.plans.market import _PROFIT, _REVENUE, _growth_sql, _share_sql, periods, with_profit
from riskweave.sources.tables import read

TARGETS = ("supported", "weakly_supported", "not_supported", "insufficient_evidence")


def _paired(spark, sf) -> DataFrame:
    """Revenue and receivables with those of the year before, and a target that goes by the quarter."""
    rows = prior_year(periods(spark, sf), ["entity", "q"], ["revenue", "receivables"])
    return rows.withColumn("target", F.element_at(F.array(*map(F.lit, TARGETS)), F.col("q")))


def injected_values(spark, sf):
    """Synthetic receivables, the lead of their growth and whether it is beyond the threshold."""
    rows = _paired(spark, sf).withColumn("synthetic", op.injected_receivables(F.lit(9000)))
    lead = growth_bp("synthetic", "receivables_prior") - growth_bp("revenue", "revenue_prior")
    return rows.select("entity", "y", "q", "target", "synthetic", lead.alias("lead_bp"), op.family_flag(F.lit("revenue_receivables"), lead, F.col("target")).alias("flag"))


def injected_cash_flows(spark, sf):
    rows = with_profit(spark, sf).withColumn("synthetic", op.injected_cash(F.lit(-2500)))
    ratio = F.expr("CASE WHEN profit <> 0 THEN synthetic * 10000 div abs(profit) END")
    return rows.select("entity", "y", "q", "synthetic", op.exceeded(F.lit("earnings_cashflow"), ratio).alias("exceeded"))


def family_values(spark, sf):
    """The other six families' synthetic values over nations' quarters, and which side of the threshold they are on."""
    return op.family_values(_paired(spark, sf)).select("entity", "y", "q", "target", "family", "account", "base", "value", "metric_bp", "exceeded")


def family_flags(spark, sf):
    """Every family's threshold against parts' sizes, and the flag that the target gives."""
    rows = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 200).alias("metric_bp"), F.element_at(F.array(*map(F.lit, TARGETS)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("target"), F.explode(F.array(*map(F.lit, op.THRESHOLDS))).alias("family"))
    out = rows.withColumns({"over": op.exceeded(F.col("family"), F.col("metric_bp")), "flag": op.family_flag(F.col("family"), F.col("metric_bp"), F.col("target"))})
    return out.groupBy("family", "over", "flag").agg(F.count("*").alias("n"))


def packet_variants(spark, sf):
    """Orders' packets in every slot, as one line each; the target goes by the order's status."""
    spot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    ref = F.concat(F.lit("R"), F.col("pos").cast("string"))
    lines = read(spark, sf, "lineitem").withColumn("pos", spot).withColumn("ref", ref)
    array = lambda c, w=None: F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("v")) if w is None else F.when(w, F.struct("pos", c.alias("v"))))), lambda x: x["v"])
    finding = F.struct(F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("finding_id"), (F.col("l_returnflag") == "R").alias("flag"), F.array("ref").alias("refs"))
    g = lines.groupBy("l_orderkey").agg(array(finding).alias("findings"), array(F.concat(F.lit("N"), F.col("l_partkey").cast("string")), F.col("l_quantity") > 10).alias("notes"), array(F.col("ref")).alias("rows"))
    target = F.when(F.col("o_orderstatus") == "P", "insufficient_evidence").otherwise("supported")
    o = read(spark, sf, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    packet = F.struct("findings", "notes", F.array().cast("array<string>").alias("spans"), "rows", F.lit("high").alias("priority"), F.array(F.lit("S1")).alias("signals"), F.col("o_orderpriority").alias("reason"))
    rows = o.select("o_orderkey", target.alias("target"), packet.alias("p"), F.explode(F.array(*map(F.lit, op.SLOTS))).alias("slot"))
    m = rows.select("o_orderkey", "slot", op.mutated("p", F.col("slot"), F.col("target")).alias("m"))
    found = F.array_join(F.transform("m.findings", lambda f: F.concat_ws("/", f["finding_id"], f["flag"].cast("string"), F.array_join(f["refs"], "+"))), ",")
    return m.select("o_orderkey", "slot", F.concat_ws("|", found, F.array_join("m.notes", ","), F.array_join("m.spans", ","), F.array_join("m.rows", ","), F.array_join("m.signals", ","), "m.priority", "m.reason").alias("packet"))


def calibration_pairs(spark, sf):
    """Orders of two lines and others as matched pairs, by their lines' targets and labels."""
    c = F.col
    rows = read(spark, sf, "lineitem").select(c("l_orderkey").alias("pair"), F.when(c("l_partkey") % 5 > 0, "train").otherwise("development").alias("role"), F.when(c("l_linestatus") == "F", "supported").otherwise("weakly_supported").alias("target"), F.when(c("l_discount") > 0.09, None).when(c("l_linestatus") == "F", "supported").otherwise("weakly_supported").alias("level"))
    return op.complete_pairs(rows)


def metadata_rows(spark, sf):
    """Nations' years of suppliers' items, with a row for what nothing was found for."""
    wanted = read(spark, sf, "nation").select(F.col("n_nationkey").alias("ticker"), F.explode(F.array(F.lit("Q1"), F.lit("Q2"))).alias("period"))
    items = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("ticker"), F.when(F.col("s_suppkey") % 2 == 0, "Q1").otherwise("Q2").alias("period"), F.col("s_suppkey").alias("item"), F.when(F.col("s_acctbal") > 0, "financial_statement").alias("kind"))
    return op.metadata_rows(wanted, items)


def evidence_matching(spark, sf):
    """Whether an order's words name its period, company and basis, by patterns over what they are written as."""
    said = F.concat(F.lit("Report of "), F.col("c_name"), F.lit(" Q"), F.quarter("o_orderdate").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderstatus") == "O", " consolidated").otherwise(" separate"))
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey").withColumn("said", said)
    period = F.concat(F.regexp_extract("said", r"Q([1-4])/(\d{4})", 2), F.lit("-Q"), F.regexp_extract("said", r"Q([1-4])/(\d{4})", 1))
    wanted = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), (F.col("c_nationkey") % 4 + 1).cast("string"))
    hit = {"by_period": period == wanted, "by_company": F.lower("said").contains(F.lower("c_name")), "by_basis": F.col("said").contains("separate")}
    out = o.withColumns(hit)
    state = F.when(F.col("by_period") & F.col("by_company") & F.col("by_basis"), "matched").when(F.col("by_company"), "company_only").otherwise("none")
    return out.groupBy(state.alias("state"), "by_period", "by_basis").agg(F.count("*").alias("n"))


NAMES = "injected_values family_values injected_cash_flows family_flags packet_variants calibration_pairs metadata_rows evidence_matching".split()
QUERIES = {name: globals()[name] for name in NAMES}

_T = "['supported', 'weakly_supported', 'not_supported', 'insufficient_evidence']"
_OVER = " ".join(f"WHEN '{name}' THEN m {'>' if side == 'above' else '<'} {at}" for name, (side, at) in op.THRESHOLDS.items())



def _nearest(base: str, at: str, side: str) -> str:
    """The whole number strictly over (1), or strictly under (-1), ``base`` times ``at`` and a half basis point."""
    edge = f"(CAST({base} AS HUGEINT) * (2 * ({at}) {'+' if side[1] == 'above' else '-'} 1))"
    floor = f"(({edge} - (({edge} % 20000) + 20000) % 20000) // 20000)"
    return f"{floor} + 1" if side[0] > 0 else f"{floor} - CASE WHEN {edge} % 20000 = 0 THEN 1 ELSE 0 END"


def _family_sql() -> str:
    out = []
    for family, (account, form, part) in op.FAMILIES.items():
        at = op.THRESHOLDS[family][1]
        over = op.THRESHOLDS[family][0] == "above" and form != "revenue_over_growth"
        base = "greatest(1, receivables)" if part is None else f"greatest(1, {'revenue_prior' if 'growth' in form else 'revenue'} * {part} // 100)"
        t = {"growth_over_revenue": f"{at} + g", "revenue_over_growth": f"g - {at}"}.get(form, str(at))
        kind = "above" if over else "below"
        far = f"{t} + 2500" if over else f"({t}) // 3" if form == "share" else f"{t} - 2500"
        d = f"CASE target WHEN 'weakly_supported' THEN {_nearest('base', t, (1 if over else -1, kind))} WHEN 'supported' THEN {_nearest('base', far, (1 if over else -1, kind))} ELSE {_nearest('base', t, (-1 if over else 1, kind))} END"
        grown = f"({_growth_sql('value', 'base')})"
        metric = {"share": _share_sql("value", "base"), "growth_over_revenue": f"{grown} - g", "revenue_over_growth": f"g - {grown}"}.get(form, grown)
        test = f"metric_bp {'>' if op.THRESHOLDS[family][0] == 'above' else '<'} {at}"
        out.append(f"SELECT entity, y, q, target, '{family}' AS family, '{account}' AS account, base, value, metric_bp, {test} AS exceeded FROM (SELECT *, {metric} AS metric_bp FROM (SELECT *, CAST(greatest(0, {d} + {'0' if form == 'share' else 'base'}) AS BIGINT) AS value FROM (SELECT *, CAST({base} AS BIGINT) AS base FROM s)))")
    return " UNION ALL ".join(out)


SQL = {
    "family_values": f"{_REVENUE}, a AS (SELECT a.entity, a.y, a.q, {_T}[a.q] AS target, a.revenue, b.revenue AS revenue_prior, a.receivables FROM p a JOIN p b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1), s AS (SELECT *, coalesce({_growth_sql('revenue', 'revenue_prior')}, 0) AS g FROM a) {_family_sql()}",
    "injected_values": f"{_REVENUE}, a AS (SELECT a.entity, a.y, a.q, {_T}[a.q] AS target, a.revenue, b.revenue AS revenue_prior, a.receivables, b.receivables AS receivables_prior FROM p a JOIN p b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1), s AS (SELECT *, {_growth_sql('revenue', 'revenue_prior')} AS g FROM a), k AS (SELECT *, CAST(greatest(receivables + 1, CASE WHEN target = 'weakly_supported' THEN floor((receivables_prior * (10000 + g + 1050) + 5000) / 10000) ELSE floor((revenue * 9000 + 5000) / 10000) END) AS BIGINT) AS synthetic FROM s), l AS (SELECT *, ({_growth_sql('synthetic', 'receivables_prior')}) - g AS lead_bp FROM k) SELECT entity, y, q, target, synthetic, lead_bp, lead_bp > 1000 AS flag FROM l",
    "injected_cash_flows": f"{_PROFIT}, s AS (SELECT entity, y, q, profit, CAST(floor((profit * -2500 + 5000) / 10000) AS BIGINT) AS synthetic FROM r) SELECT entity, y, q, synthetic, CASE WHEN profit <> 0 THEN trunc(synthetic * 10000 / abs(profit)) < 8000 END AS exceeded FROM s",
    "family_flags": f"WITH f AS (SELECT p_partkey, p_size * 200 AS m, {_T}[CAST(p_partkey % 4 + 1 AS INTEGER)] AS target, unnest(['{chr(39).join(op.THRESHOLDS).replace(chr(39), chr(39) + ', ' + chr(39))}']) AS family FROM part), o AS (SELECT *, CASE family {_OVER} END AS over_ FROM f) SELECT family, over_ AS \"over\", CASE WHEN family IN ('revenue_receivables', 'earnings_cashflow') THEN over_ ELSE target <> 'not_supported' END AS flag, count(*) AS n FROM o GROUP BY 1, 2, 3",
    "packet_variants": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem),
s AS (SELECT slot, i FROM (SELECT unnest(['{chr(39).join(op.SLOTS).replace(chr(39), chr(39) + ', ' + chr(39))}']) AS slot, unnest(range(1, 9)) AS i)),
x AS (SELECT o_orderkey, o_orderpriority, slot, i, o_orderstatus = 'P' AS bare, pos, l_suppkey, l_partkey, l_quantity, l_returnflag = 'R' AND i <> 6 AS flag, 'R' || pos || CASE WHEN i = 7 THEN '_ALT' ELSE '' END AS ref FROM orders JOIN l ON l_orderkey = o_orderkey CROSS JOIN s),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, slot, l_quantity > 10 ORDER BY pos) AS nth FROM x),
g AS (SELECT o_orderkey, slot, max(i) AS i, bool_or(bare) AS bare, max(o_orderpriority) AS reason, string_agg('T' || l_suppkey || '/' || CASE WHEN flag THEN 'true' ELSE 'false' END || '/' || ref, ',' ORDER BY pos) AS findings, coalesce(string_agg('N' || l_partkey || CASE WHEN i = 5 THEN ' Little detail is disclosed.' ELSE '' END, ',' ORDER BY pos) FILTER (WHERE l_quantity > 10 AND (i <> 3 OR nth = 1)), '') AS notes, string_agg(ref, ',' ORDER BY pos) AS refs FROM n GROUP BY 1, 2)
SELECT o_orderkey, slot, CASE WHEN bare OR i = 4 THEN '' ELSE findings END || '|' || CASE WHEN bare THEN '' ELSE notes END || '|' || CASE WHEN i = 2 THEN 'Billing at the end of the quarter explains it.' ELSE '' END || '|' || refs || '|' || CASE WHEN bare OR i = 4 THEN '' ELSE 'S1' END || '|' || CASE WHEN bare OR i IN (3, 4) THEN 'medium' ELSE 'high' END || '|' ||
  CASE WHEN bare OR i = 4 THEN 'Rows alone suggest a review.' WHEN i = 8 THEN 'Doanh thu: ' || reason ELSE reason || CASE i WHEN 2 THEN ' (timing)' WHEN 3 THEN ' (one note)' WHEN 5 THEN ' (little detail)' WHEN 6 THEN ' (not flagged)' WHEN 7 THEN ' (other map)' ELSE '' END END AS packet FROM g""",
    "calibration_pairs": "WITH g AS (SELECT l_orderkey AS pair, count(*) AS n, bool_or(l_discount > 0.09) AS wrong, count(DISTINCT l_linestatus) AS targets, count(DISTINCT l_partkey % 5 > 0) AS roles FROM lineitem GROUP BY 1) SELECT pair, CASE WHEN wrong THEN 'label_mismatch' WHEN n = 2 AND roles = 1 AND targets = 2 THEN 'complete' ELSE 'incomplete' END AS state FROM g",
    "metadata_rows": "WITH w AS (SELECT n_nationkey AS ticker, unnest(['Q1', 'Q2']) AS period FROM nation) SELECT ticker, period, s_suppkey AS item, CASE WHEN s_suppkey IS NULL THEN 'unknown' ELSE 'financial_statement' END AS kind, CASE WHEN s_suppkey IS NULL THEN 'no_quarterly_metadata_hit' ELSE 'metadata_hit' END AS coverage FROM w LEFT JOIN supplier ON s_nationkey = ticker AND s_acctbal > 0 AND CASE WHEN s_suppkey % 2 = 0 THEN 'Q1' ELSE 'Q2' END = period",
    "evidence_matching": "WITH o AS (SELECT quarter(o_orderdate) = c_nationkey % 4 + 1 AS by_period, o_orderstatus <> 'O' AS by_basis FROM orders JOIN customer ON c_custkey = o_custkey) SELECT CASE WHEN by_period AND by_basis THEN 'matched' ELSE 'company_only' END AS state, by_period, by_basis, count(*) AS n FROM o GROUP BY 1, 2, 3",
}
