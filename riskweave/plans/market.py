"""Risk-signal queries over orders, as analogue of company filings: entity = nation, period = quarter of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import checks
from riskweave.sources import tables

KEYS = ["entity", "q"]


def _named_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer, nation = (tables.read(spark, sf, t) for t in ("orders", "customer", "nation"))
    named = orders.join(customer.select("c_custkey", "c_nationkey"), orders["o_custkey"] == customer["c_custkey"])
    named = named.join(nation.select("n_nationkey", F.col("n_name").alias("entity")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("entity", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), "o_orderkey", "o_orderstatus", checks.cents(F.col("o_totalprice")).alias("amount"))


def periods(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue and receivables by entity, year and quarter."""
    open_amount = F.sum(F.when(F.col("o_orderstatus") == "O", F.col("amount")).otherwise(0)).cast("long")
    return _named_orders(spark, sf).groupBy("entity", "y", "q").agg(F.sum("amount").cast("long").alias("revenue"), open_amount.alias("receivables"), F.count("*").alias("n_orders"))


def with_profit(spark: SparkSession, sf: str) -> DataFrame:
    """Periods with profit and cash flow; returned lines count against cash."""
    lines = tables.read(spark, sf, "lineitem")
    gain = checks.cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    cash = F.when(F.col("l_returnflag") == "R", -gain).when(F.col("l_linestatus") == "F", gain).otherwise(0)
    by_order = lines.groupBy("l_orderkey").agg(F.sum(gain).cast("long").alias("profit"), F.sum(cash).cast("long").alias("cash"))
    named = _named_orders(spark, sf).join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return named.groupBy("entity", "y", "q").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("profit", "cash")), F.sum("amount").cast("long").alias("revenue"))


_REVENUE = """
WITH o AS (
  SELECT n_name AS entity, year(o_orderdate) AS y, quarter(o_orderdate) AS q, o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (
  SELECT entity, y, q, CAST(sum(amount) AS BIGINT) AS revenue, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN amount ELSE 0 END) AS BIGINT) AS receivables, count(*) AS n_orders
  FROM o GROUP BY entity, y, q)"""
_PROFIT = _REVENUE + """,
l AS (
  SELECT l_orderkey, l_returnflag, l_linestatus, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS gain FROM lineitem),
b AS (
  SELECT l_orderkey, CAST(sum(gain) AS BIGINT) AS profit, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -gain WHEN l_linestatus = 'F' THEN gain ELSE 0 END) AS BIGINT) AS cash FROM l GROUP BY l_orderkey),
r AS (
  SELECT entity, y, q, CAST(coalesce(sum(profit), 0) AS BIGINT) AS profit, CAST(coalesce(sum(cash), 0) AS BIGINT) AS cash, CAST(sum(amount) AS BIGINT) AS revenue
  FROM o LEFT JOIN b ON o_orderkey = l_orderkey GROUP BY entity, y, q)"""


def _growth_sql(now: str, before: str) -> str:
    return f"CASE WHEN {before} <> 0 THEN CAST(sign({now} - {before}) AS BIGINT) * CAST((abs({now} - {before})::HUGEINT * 20000 + abs({before})) // (2 * abs({before})::HUGEINT) AS BIGINT) END"


def _share_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN CAST(sign({part}) AS BIGINT) * CAST((abs({part})::HUGEINT * 20000 + abs({whole})) // (2 * abs({whole})::HUGEINT) AS BIGINT) END"


_PAIR = "FROM p a JOIN p b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1"
_PAIR_R = "FROM r a JOIN r b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1"
_FLAGS = f"""{_REVENUE},
g AS (
  SELECT a.entity, a.y, a.q, {_growth_sql('a.revenue', 'b.revenue')} AS g_rev, {_growth_sql('a.receivables', 'b.receivables')} AS g_rec {_PAIR}),
s AS (
  SELECT entity, y, q, CASE WHEN g_rev > 2000 THEN 1 ELSE 0 END AS s1, CASE WHEN g_rec - g_rev > 1000 THEN 1 ELSE 0 END AS s2, CASE WHEN g_rec > 3000 THEN 1 ELSE 0 END AS s3 FROM g)"""


def yoy_growth_flag(spark, sf):
    pairs = checks.prior_year(periods(spark, sf), KEYS, ["revenue"])
    out = pairs.select("entity", "y", "q", "revenue", "revenue_prior", checks.growth_bp("revenue", "revenue_prior").alias("growth_bp"))
    return out.withColumn("flag", F.coalesce(F.col("growth_bp") > 2000, F.lit(False)))


def growth_gap_two_metrics(spark, sf):
    pairs = checks.prior_year(periods(spark, sf), KEYS, ["revenue", "receivables"])
    out = pairs.select("entity", "y", "q", checks.growth_bp("revenue", "revenue_prior").alias("g_rev"), checks.growth_bp("receivables", "receivables_prior").alias("g_rec"))
    return out.withColumn("gap_bp", F.col("g_rec") - F.col("g_rev")).withColumn("flag", F.coalesce(F.col("gap_bp") > 1000, F.lit(False)))


def cash_ratio_case(spark, sf):
    out = with_profit(spark, sf).withColumn("ratio_bp", checks.share_bp("cash", "profit"))
    signal = checks.first_failing(
        (F.col("profit") == 0, "zero_denominator"),
        ((F.col("profit") > 0) & (F.col("cash") < 0), "positive_profit_negative_cash"),
        (F.col("ratio_bp") < 7000, "cash_gap_high"),
        default="none",
    )
    return out.select("entity", "y", "q", "profit", "cash", "ratio_bp", signal.alias("signal"))


def ratio_change_pp(spark, sf):
    shares = periods(spark, sf).withColumn("share", checks.share_bp("receivables", "revenue"))
    pairs = checks.prior_year(shares, KEYS, ["share"]).withColumn("change_bp", F.col("share") - F.col("share_prior"))
    return pairs.select("entity", "y", "q", "share", "share_prior", "change_bp", F.coalesce(F.col("change_bp") > 75, F.lit(False)).alias("flag"))


def avg_growth_lag(spark, sf):
    pairs = checks.prior_year(with_profit(spark, sf), KEYS, ["profit", "cash", "revenue"])
    out = pairs.select("entity", "y", "q", *(checks.growth_bp(c, f"{c}_prior").alias(f"g_{c}") for c in ("revenue", "profit", "cash")))
    lag = F.expr("floor((g_revenue + g_profit) / 2) - g_cash").cast("long")
    return out.withColumn("lag_bp", lag).withColumn("flag", F.coalesce(F.col("lag_bp") > 2000, F.lit(False)))


def concentration_share(spark, sf):
    lines = tables.read(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", checks.cents(F.col("l_extendedprice")).alias("amount"))
    sums = lines.groupBy("l_suppkey").agg(F.sum("amount").cast("long").alias("total"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("amount")).otherwise(0)).cast("long").alias("part"), F.count("*").alias("n_lines"))
    out = sums.withColumn("share_bp", checks.share_bp("part", "total"))
    return out.withColumn("flag", (F.col("share_bp") > 6000) & (F.col("total") > 100_000_000) & (F.col("n_lines") >= 5))


def _flags(spark, sf):
    """The signals of every pair, one row: s1 growth, s2 gap, s3 receivables."""
    g = growth_gap_two_metrics(spark, sf)
    mark = lambda c: F.when(c, 1).otherwise(0)
    return g.select("entity", "y", "q", mark(F.col("g_rev") > 2000).alias("s1"), mark(F.col("gap_bp") > 1000).alias("s2"), mark(F.col("g_rec") > 3000).alias("s3"))


def tool_candidates_division(spark, sf):
    """Pairs that flagged every signal a rule requires: relational division over rules and flags."""
    flags = _flags(spark, sf).select("entity", "y", "q", F.explode(F.array_compact(F.array(*(F.when(F.col(s) == 1, F.lit(s)) for s in ("s1", "s2", "s3"))))).alias("signal"))
    rules = spark.sql("SELECT * FROM VALUES ('REV_REC', 's2', 2), ('REV_REC', 's3', 2), ('ALL', 's1', 3), ('ALL', 's2', 3), ('ALL', 's3', 3), ('GROWTH', 's1', 1) AS t(rule, signal, needs)")
    met = flags.join(F.broadcast(rules), "signal").groupBy("entity", "y", "q", "rule").agg(F.count("*").alias("met"), F.max("needs").alias("needs"))
    return met.where("met = needs").select("entity", "y", "q", "rule")


def detector_support_level(spark, sf):
    n = F.col("s1") + F.col("s2") + F.col("s3")
    level = lambda two, one, none: F.when(n >= 2, two).when(n == 1, one).otherwise(none)
    return _flags(spark, sf).select("entity", "y", "q", n.alias("n_flags"), level("supported", "weak", "insufficient").alias("level"), level(85, 60, 30).alias("confidence_pct"), level("high", "medium", "low").alias("severity"))


def assessment_buckets(spark, sf):
    d = detector_support_level(spark, sf)
    n = lambda v: F.count_if(F.col("level") == v)
    out = d.groupBy("entity").agg(n("supported").alias("n_supported"), n("weak").alias("n_weak"), n("insufficient").alias("n_insufficient"), F.count("*").alias("n_all"))
    return out.withColumn("status", F.when(F.col("n_supported") > 0, "supported").when(F.col("n_weak") > 0, "weak").otherwise("none"))


def severity_rollup(spark, sf):
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    out = detector_support_level(spark, sf).groupBy("entity").agg(F.min(rank).alias("r"))
    return out.select("entity", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("r") + 1).alias("severity"))


def primary_per_group(spark, sf):
    """Per entity the assessment of best severity, most flags, then earliest period."""
    d = detector_support_level(spark, sf)
    key = F.struct(-F.col("n_flags"), F.col("y"), F.col("q"))
    return d.groupBy("entity").agg(F.min_by(F.struct("y", "q", "level"), key).alias("p")).select("entity", "p.y", "p.q", "p.level")


def gating_status(spark, sf):
    """Ordered gates for every entity and period pair: profile, missing prior, too few records, enabled."""
    now = periods(spark, sf)
    prior = now.select("entity", (F.col("y") + 1).alias("y"), "q", F.col("n_orders").alias("n_prior"))
    nation, region = tables.read(spark, sf, "nation"), tables.read(spark, sf, "region")
    profile = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("entity"), "r_name")
    status = checks.first_failing(
        (F.col("r_name") == "ASIA", "skipped_profile"), (F.col("n_prior").isNull(), "skipped_missing_prior"), (F.least("n_orders", "n_prior") < 3, "skipped_few_records"), default="enabled"
    )
    return now.join(prior, ["entity", "y", "q"], "left").join(profile, "entity").select("entity", "y", "q", "n_orders", "n_prior", status.alias("status"))


def pivot_accounts(spark, sf):
    sums = _named_orders(spark, sf).groupBy("entity", "y").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("amount").cast("long"))
    out = sums.select("entity", "y", *(F.coalesce(c, F.lit(0).cast("long")).alias(f"amount_{c.lower()}") for c in ("F", "O", "P")))
    return out.withColumn("state", checks.first_failing((F.col("amount_o") > F.col("amount_f"), "mostly_open"), (F.col("amount_p") > 0, "partly"), default="closed"))


def latest_period_gap(spark, sf):
    """First and latest period of each entity and the number of quarters missing between."""
    spot = F.col("y") * 4 + F.col("q")
    out = periods(spark, sf).groupBy("entity").agg(F.min(spot).alias("first_q"), F.max(spot).alias("last_q"), F.count("*").alias("n"))
    return out.select("entity", "first_q", "last_q", (F.col("last_q") - F.col("first_q") + 1 - F.col("n")).cast("long").alias("missing"))


QUERIES = {f.__name__: f for f in (yoy_growth_flag, growth_gap_two_metrics, cash_ratio_case, ratio_change_pp, avg_growth_lag, concentration_share, tool_candidates_division, detector_support_level, assessment_buckets, severity_rollup, primary_per_group, gating_status, pivot_accounts, latest_period_gap)}

_LEVEL = f"""{_FLAGS},
d AS (
  SELECT entity, y, q, s1 + s2 + s3 AS n_flags, CASE WHEN s1 + s2 + s3 >= 2 THEN 'supported' WHEN s1 + s2 + s3 = 1 THEN 'weak' ELSE 'insufficient' END AS level,
    CASE WHEN s1 + s2 + s3 >= 2 THEN 85 WHEN s1 + s2 + s3 = 1 THEN 60 ELSE 30 END AS confidence_pct, CASE WHEN s1 + s2 + s3 >= 2 THEN 'high' WHEN s1 + s2 + s3 = 1 THEN 'medium' ELSE 'low' END AS severity FROM s)"""

SQL = {
    "yoy_growth_flag": f"{_REVENUE}, g AS (SELECT a.entity, a.y, a.q, a.revenue, b.revenue AS revenue_prior, {_growth_sql('a.revenue', 'b.revenue')} AS growth_bp {_PAIR}) SELECT *, coalesce(growth_bp > 2000, false) AS flag FROM g",
    "growth_gap_two_metrics": f"{_REVENUE}, g AS (SELECT a.entity, a.y, a.q, {_growth_sql('a.revenue', 'b.revenue')} AS g_rev, {_growth_sql('a.receivables', 'b.receivables')} AS g_rec {_PAIR}) SELECT *, g_rec - g_rev AS gap_bp, coalesce(g_rec - g_rev > 1000, false) AS flag FROM g",
    "cash_ratio_case": f"{_PROFIT}, s AS (SELECT entity, y, q, profit, cash, {_share_sql('cash', 'profit')} AS ratio_bp FROM r) SELECT *, CASE WHEN profit = 0 THEN 'zero_denominator' WHEN profit > 0 AND cash < 0 THEN 'positive_profit_negative_cash' WHEN ratio_bp < 7000 THEN 'cash_gap_high' ELSE 'none' END AS signal FROM s",
    "ratio_change_pp": f"{_REVENUE}, h AS (SELECT entity, y, q, {_share_sql('receivables', 'revenue')} AS share FROM p) SELECT a.entity, a.y, a.q, a.share, b.share AS share_prior, a.share - b.share AS change_bp, coalesce(a.share - b.share > 75, false) AS flag FROM h a JOIN h b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1",
    "avg_growth_lag": f"{_PROFIT}, g AS (SELECT a.entity, a.y, a.q, {', '.join(_growth_sql(f'a.{c}', f'b.{c}') + f' AS g_{c}' for c in ('revenue', 'profit', 'cash'))} {_PAIR_R}), w AS (SELECT *, CAST(floor((g_revenue + g_profit) / 2) - g_cash AS BIGINT) AS lag_bp FROM g) SELECT *, coalesce(lag_bp > 2000, false) AS flag FROM w",
    "concentration_share": f"WITH s AS (SELECT l_suppkey, CAST(sum(amount) AS BIGINT) AS total, CAST(sum(CASE WHEN l_returnflag = 'N' THEN amount ELSE 0 END) AS BIGINT) AS part, count(*) AS n_lines FROM (SELECT l_suppkey, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem) GROUP BY l_suppkey), t AS (SELECT *, {_share_sql('part', 'total')} AS share_bp FROM s) SELECT *, share_bp > 6000 AND total > 100000000 AND n_lines >= 5 AS flag FROM t",
    "tool_candidates_division": f"{_FLAGS} SELECT entity, y, q, 'REV_REC' AS rule FROM s WHERE s2 = 1 AND s3 = 1 UNION ALL SELECT entity, y, q, 'ALL' FROM s WHERE s1 + s2 + s3 = 3 UNION ALL SELECT entity, y, q, 'GROWTH' FROM s WHERE s1 = 1",
    "detector_support_level": f"{_LEVEL} SELECT * FROM d",
    "assessment_buckets": f"{_LEVEL}, c AS (SELECT entity, CAST(sum(CASE WHEN level = 'supported' THEN 1 ELSE 0 END) AS BIGINT) AS n_supported, CAST(sum(CASE WHEN level = 'weak' THEN 1 ELSE 0 END) AS BIGINT) AS n_weak, CAST(sum(CASE WHEN level = 'insufficient' THEN 1 ELSE 0 END) AS BIGINT) AS n_insufficient, count(*) AS n_all FROM d GROUP BY entity) SELECT *, CASE WHEN n_supported > 0 THEN 'supported' WHEN n_weak > 0 THEN 'weak' ELSE 'none' END AS status FROM c",
    "severity_rollup": f"{_LEVEL} SELECT entity, CASE min(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM d GROUP BY entity",
    "primary_per_group": f"{_LEVEL} SELECT entity, y, q, level FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n_flags DESC, y, q) AS n FROM d) WHERE n = 1",
    "gating_status": f"{_REVENUE} SELECT a.entity, a.y, a.q, a.n_orders, b.n_orders AS n_prior, CASE WHEN r_name = 'ASIA' THEN 'skipped_profile' WHEN b.n_orders IS NULL THEN 'skipped_missing_prior' WHEN least(a.n_orders, b.n_orders) < 3 THEN 'skipped_few_records' ELSE 'enabled' END AS status FROM p a JOIN nation ON n_name = a.entity JOIN region ON n_regionkey = r_regionkey LEFT JOIN p b ON a.entity = b.entity AND a.q = b.q AND a.y = b.y + 1",
    "pivot_accounts": f"{_REVENUE}, t AS (SELECT entity, y, {', '.join(f'''CAST(sum(CASE WHEN o_orderstatus = '{c}' THEN amount ELSE 0 END) AS BIGINT) AS amount_{c.lower()}''' for c in 'FOP')} FROM o GROUP BY entity, y) SELECT *, CASE WHEN amount_o > amount_f THEN 'mostly_open' WHEN amount_p > 0 THEN 'partly' ELSE 'closed' END AS state FROM t",
    "latest_period_gap": f"{_REVENUE} SELECT entity, min(y * 4 + q) AS first_q, max(y * 4 + q) AS last_q, CAST(max(y * 4 + q) - min(y * 4 + q) + 1 - count(*) AS BIGINT) AS missing FROM p GROUP BY entity",
}
