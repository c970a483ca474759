"""Queries of findings with their evidence and of the extraction gate: nations' quarters and orders are reports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from riskweave.operators import findings
from riskweave.plans import filings
from riskweave.plans.market import _growth_sql, _share_sql
from riskweave.sources.tables import read


def suite_findings(spark, sf):
    """Every tool over every pair: signal, metric, the evidence that it cites and the amounts that it read."""
    f = findings.findings(filings._reports(spark, sf, stale=True))
    refs = F.array_join(F.transform("refs", lambda r: F.concat_ws("=", r["evidence_ref_type"], r["ref_id"])), " ")
    inputs = F.array_join(F.transform("inputs", lambda i: F.concat_ws("=", i["name"], i["value"].cast("string"))), " ")
    return f.select("target", "prior", "tool_result_id", "tool", "signal_id", "flag", "status", "metric", refs.alias("refs"), inputs.alias("inputs"))


LATE, OPEN, LOOSE = 48, 0.08, 0.1


def _gate_sets(spark, sf):
    """Orders as reports, each with the customer's order before it as its prior year."""
    c = F.col
    cell_id = F.concat_ws("-", c("l_partkey").cast("string"), c("l_suppkey").cast("string"))
    value = F.when(c("l_quantity") < 50, F.round(c("l_extendedprice") * 100).cast("long"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(c("l_returnflag") == "A", "balance_sheet").when(c("l_returnflag") == "N", "income_statement").otherwise("cash_flow_statement")
    lines = read(spark, sf, "lineitem").withColumns({"cell_id": cell_id, "value": value, "line": line, "kind": kind, "part": c("l_partkey").cast("string")})
    of = lambda when, what: F.array_sort(F.collect_list(F.when(when, what)))
    g = lines.groupBy(c("l_orderkey").alias("o_orderkey")).agg(
        of(F.lit(True), F.struct("kind", "line", "cell_id", "value", F.when(c("l_discount") < 0.005, c("part")).alias("resolves"))).alias("all"),
        of((c("l_returnflag") == "R") & (c("l_quantity") > LATE), F.lit("prior_year_value")).alias("keys"),
        of(c("l_tax") > OPEN - 0.005, F.struct("line", c("part").alias("source_id"), (c("l_linestatus") == "O").alias("operative"), F.when(c("l_returnflag") == "A", "resolved").otherwise("open").alias("status"))).alias("attachments"),
        of(c("l_discount") > LOOSE - 0.005, F.struct(F.lit("note_reference_match_failure").alias("record_type"), F.lit("blocking").alias("severity"), F.concat(F.lit("r"), c("l_linenumber").cast("string")).alias("row_id"))).alias("records"),
        F.array_sort(F.collect_set(F.when(c("l_quantity") > 2, c("cell_id")))).alias("indexed"),
    )
    tables = F.transform(F.array_distinct(F.transform("all", lambda x: x["kind"])), lambda k: F.struct(k.alias("table_type"), F.transform(F.filter("all", lambda x: x["kind"] == k), lambda x: F.struct(x["cell_id"].alias("cell_id"), x["value"].alias("value"), x["resolves"].alias("resolves"))).alias("cells")))
    indexed = F.when(F.size("all") >= 7, F.concat("indexed", F.array(F.lit("x")))).otherwise(c("indexed"))
    names = read(spark, sf, "customer").select(c("c_custkey").alias("o_custkey"), F.when(c("c_acctbal") >= -900, c("c_name")).alias("company_name"))
    o = read(spark, sf, "orders").join(names, "o_custkey").join(g, "o_orderkey", "left")
    return o.select(
        "o_custkey", "o_orderkey", "o_orderdate", "company_name", F.when(c("o_totalprice") >= 5000, F.concat_ws("-Q", F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"))).alias("period"),
        F.when(c("o_orderpriority") == "5-LOW", "unknown").otherwise("standard_corporate").alias("profile"), F.when(c("o_orderpriority").startswith("4"), "unknown").otherwise("separate").alias("basis"),
        F.when(c("o_orderstatus") != "P", "VND").alias("currency"), F.lit("million_vnd").alias("unit"), F.when(c("o_orderstatus") == "F", "ocr_v1").otherwise("hand_authored_reference_v1").alias("method"), "keys", "attachments", "records", tables.alias("tables"), indexed.alias("indexed"),
    )


def extraction_gate(spark, sf):
    """What keeps customers' orders and the orders before them from analysis."""
    from pyspark.sql import Window

    sets = _gate_sets(spark, sf)
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("case"), F.lag("o_orderkey").over(order).alias("before")).where("before is not null")
    roles = pairs.select("case", F.lit(0).alias("role"), F.col("case").alias("o_orderkey")).union(pairs.select("case", F.lit(1), "before"))
    return findings.gate(roles.join(sets, "o_orderkey"))


NAMES = "suite_findings extraction_gate".split()
QUERIES = {name: globals()[name] for name in NAMES}


def _expanded(rule: str) -> str:
    for name, write in (("growth", _growth_sql), ("share", _share_sql)):
        rule = re.sub(rf"{name}\(((?:abs\(\w+\)|\w+)), (\w+)\)", lambda m: f"({write(m[1], m[2])})", rule)
    return rule


def _tool_sql(t: findings.Tool) -> str:
    inputs = [(a, "target") for a in t.own] + [x for a in t.both for x in ((a, "target"), (f"{a}_prior", "prior"))]
    lost = " OR ".join(f"{a} IS NULL" for a, _ in inputs) or "false"
    stale = "n % 7 = 0" if "operating_cash_flow" in t.own else "false"
    text = {"RPT_DISC": ("related", "related_party_note_span", "n0"), "POLICY_DISC": ("policy", "accounting_policy_span", "n1"), "VAR_DISC": ("told", "variance_explanation_span", "s1")}.get(t.code)
    refs = " || ' ' || ".join(f"'table_cell=' || {r} || ':{a.removesuffix('_prior')}'" for a, r in inputs)
    refs = refs or f"CASE WHEN {text[0]} THEN '{text[1]}=' || target || ':{text[2]}' ELSE '' END"
    shown = " || ' ' || ".join(f"'{a}=' || {a}" for a, _ in inputs) or "''"
    metric = f"CASE WHEN {text[0]} THEN 1 ELSE 0 END" if text else _expanded(t.metric)
    mine = "true" if t.profile == findings.ANY else f"profile = '{t.profile}'"
    raised = " ".join(f"WHEN {_expanded(c)} THEN '{s}'" for s, c in t.flags)
    return f"""SELECT target, prior, 'TOOL_' || target || '_{t.code}_001' AS tool_result_id, '{t.name}' AS tool,
  CASE a WHEN 'wrong_profile' THEN '{t.signal('wrong_profile')}' WHEN 'missing_evidence' THEN '{t.signal('missing_evidence')}' WHEN 'wrong_period' THEN '{t.signal('wrong_period')}' ELSE CASE {raised} ELSE '{t.clear}' END END AS signal_id,
  a = '' AND CASE {raised} ELSE '' END <> '' AS flag, CASE WHEN a <> '' THEN a WHEN CASE {raised} ELSE '' END <> '' THEN 'flagged' ELSE 'clear' END AS status,
  CASE WHEN a = '' THEN CAST(m AS BIGINT) END AS metric, CASE WHEN a IN ('wrong_profile', 'missing_evidence') THEN '' ELSE {refs} END AS refs, CASE WHEN a IN ('wrong_profile', 'missing_evidence') THEN '' ELSE {shown} END AS inputs
FROM (SELECT *, {metric} AS m, CASE WHEN NOT ({mine}) THEN 'wrong_profile' WHEN {lost} THEN 'missing_evidence' WHEN {stale} THEN 'wrong_period' ELSE '' END AS a FROM v)"""


SQL = {
    "suite_findings": f"{filings._WIDE}, v AS (SELECT w.*, r.n FROM w JOIN r ON r.report_id = w.target) {' UNION ALL '.join(map(_tool_sql, findings.TOOLS))}",
    "extraction_gate": f"""WITH l AS (SELECT *, l_partkey || '-' || l_suppkey AS cell_id, CASE l_returnflag WHEN 'A' THEN 'balance_sheet' WHEN 'N' THEN 'income_statement' ELSE 'cash_flow_statement' END AS kind FROM lineitem),
a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT cell_id) AS cells, bool_or(l_returnflag = 'R' AND l_quantity > {LATE}) AS leak, list(DISTINCT kind) AS kinds,
  arg_min(cell_id, (kind, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (WHERE l_quantity >= 50) AS blank, list(CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_discount < 0.005) AS resolves,
  list_distinct(list(cell_id)) AS ids, coalesce(list_distinct(list(cell_id) FILTER (WHERE l_quantity > 2)), []) AS known FROM l GROUP BY 1),
u AS (SELECT l.l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS open FROM l JOIN a ON a.l_orderkey = l.l_orderkey
  WHERE l_tax > {OPEN - 0.005} AND l_linestatus = 'O' AND NOT (l_returnflag = 'A' AND list_contains(coalesce(resolves, []), CAST(l_partkey AS VARCHAR))) GROUP BY 1),
p AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders),
s AS (SELECT o_orderkey AS c, 'target' AS role, o_orderkey AS k FROM p WHERE before IS NOT NULL UNION ALL SELECT o_orderkey, 'prior_year', before FROM p WHERE before IS NOT NULL),
x AS (SELECT s.c, s.role, s.k, o.*, c_acctbal, a.*, open, list_sort(list_filter(['balance_sheet', 'cash_flow_statement', 'income_statement'], lambda t: NOT list_contains(coalesce(kinds, []), t))) AS lacking,
  list_sort(list_filter(coalesce(ids, []), lambda i: NOT list_contains(known, i))) AS missing FROM s JOIN orders o ON o.o_orderkey = s.k JOIN customer ON c_custkey = o_custkey LEFT JOIN a ON a.l_orderkey = s.k LEFT JOIN u ON u.l_orderkey = s.k)
SELECT c AS "case", role, 'missing_company_identity' AS code, '' AS detail FROM x WHERE NOT c_acctbal >= -900
UNION ALL SELECT c, role, 'missing_period_identity', '' FROM x WHERE NOT o_totalprice >= 5000
UNION ALL SELECT c, role, 'unknown_report_profile', '' FROM x WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT c, role, 'unknown_report_basis', '' FROM x WHERE o_orderpriority LIKE '4%'
UNION ALL SELECT c, role, 'invalid_unit_currency_normalization', '' FROM x WHERE o_orderstatus = 'P'
UNION ALL SELECT c, role, 'current_filing_prior_comparison_column_leakage', 'prior_year_value' FROM x WHERE leak
UNION ALL SELECT c, role, 'amendment_context_corrected_value_resolution_required', open FROM x WHERE open IS NOT NULL
UNION ALL SELECT c, role, 'required_note_reference_match_failed', 'r' || l_linenumber FROM x JOIN lineitem i ON i.l_orderkey = k WHERE i.l_discount > {LOOSE - 0.005}
UNION ALL SELECT c, role, 'missing_required_main_statement', array_to_string(lacking, ', ') FROM x WHERE o_orderstatus = 'F' AND len(lacking) > 0
UNION ALL SELECT c, role, 'numeric_parse_requirement_failed', blank FROM x WHERE blank IS NOT NULL
UNION ALL SELECT c, role, 'invalid_evidence_registry', CASE WHEN n <> cells THEN 'duplicate cell evidence IDs' WHEN len(missing) > 0 THEN 'missing cell_index entries for ' || array_to_string(missing, ', ') ELSE 'cell_index entries do not point to table cells: x' END FROM x WHERE n <> cells OR len(missing) > 0 OR n >= 7""",
}
