"""Queries of assembled reports' cells and surfaces: orders are reports, their lines by return flag tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import assembly as op
from riskweave.sources.tables import read


def memory_cells(spark, sf):
    """Every cell id of an order: its first cell, what it inherits from row and table, and the table's periods."""
    c = F.col
    text = lambda name: F.lit(None).cast(name)
    cell = F.struct(c("l_partkey").cast("string").alias("cell_id"), F.year("l_shipdate").cast("string").alias("period"), F.round(c("l_extendedprice") * 100).cast("long").alias("value"), F.when(c("l_tax") > 0.065, "thousand_vnd").alias("unit"), F.when(c("l_quantity") > 40, c("l_quantity").cast("int")).alias("page"), text("string").alias("excerpt"))
    row = F.struct(c("l_linenumber").cast("string").alias("row_id"), text("string").alias("unit"), F.when(c("l_quantity") < 10, c("l_linenumber").cast("int")).alias("page"), F.when(c("l_discount") < 0.035, F.concat(F.lit("line "), c("l_suppkey").cast("string"))).alias("excerpt"), F.array(cell).alias("cells"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", row.alias("row"))
    t = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("doc"), "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["row"]).alias("rows"))
    table = F.struct(c("l_returnflag").alias("table_id"), F.when(c("l_returnflag") != "N", "vnd").alias("unit"), F.when(c("l_returnflag") == "R", 3).alias("page"), F.concat(F.lit("table "), "l_returnflag").alias("excerpt"), "rows")
    reports = t.groupBy("doc").agg(F.array_sort(F.collect_list(table)).alias("tables"))
    found = op.cell_index(reports)
    return found.select("doc", "cell_id", "n", "table_id", "row_id", F.array_join("periods", ",").alias("periods"), "period", "value", "unit", "page", "excerpt", "code")


def memory_surfaces(spark, sf):
    """Users' surfaces as their events tell them: those that name a known surface and state, evidence and their own source."""
    e = read(spark, sf, "events")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int"))
    n = F.floor("value").cast("long")
    surface = F.struct(
        "event_id", pick((*op.SURFACES, "pages"), n % 6 + 1).alias("surface"), pick((*op.STATES, "lost"), F.length("props") % 7 + 1).alias("state"), F.when(F.col("event_type") == "error", "elsewhere").when(F.col("event_type") == "click", F.col("user_id").cast("string")).alias("source_document_id"),
        F.when(F.col("value") > 10, F.col("props")).otherwise(" ").alias("evidence_ref"),
    )
    reports = e.groupBy(F.col("user_id").alias("doc")).agg(F.array_sort(F.collect_list(surface)).alias("surfaces")).withColumn("source", F.col("doc").cast("string"))
    return op.projected_surfaces(reports).select("doc", "pos", "surface", "state", "source_document_id", "evidence_ref")


NAMES = "memory_cells memory_surfaces".split()
QUERIES = {name: globals()[name] for name in NAMES}
_ARRAY = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
SQL = {
    "memory_cells": """WITH l AS (SELECT *, CAST(year(l_shipdate) AS VARCHAR) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
f AS (SELECT l_orderkey, l_returnflag, y, min(i) AS spot FROM l GROUP BY 1, 2, 3), p AS (SELECT l_orderkey, l_returnflag, string_agg(y, ',' ORDER BY spot) AS periods FROM f GROUP BY 1, 2),
c AS (SELECT l.*, periods, count(*) OVER (PARTITION BY l.l_orderkey, l_partkey) AS n, row_number() OVER (PARTITION BY l.l_orderkey, l_partkey ORDER BY i) AS nth FROM l JOIN p ON p.l_orderkey = l.l_orderkey AND p.l_returnflag = l.l_returnflag)
SELECT l_orderkey AS doc, CAST(l_partkey AS VARCHAR) AS cell_id, n, l_returnflag AS table_id, CAST(l_linenumber AS VARCHAR) AS row_id, periods, y AS period, CAST(round(l_extendedprice * 100) AS BIGINT) AS value,
  CASE WHEN l_tax > 0.065 THEN 'thousand_vnd' WHEN l_returnflag <> 'N' THEN 'vnd' END AS unit, CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS INTEGER) WHEN l_quantity < 10 THEN CAST(l_linenumber AS INTEGER) WHEN l_returnflag = 'R' THEN 3 END AS page,
  CASE WHEN l_discount < 0.035 THEN 'line ' || l_suppkey ELSE 'table ' || l_returnflag END AS excerpt, CASE WHEN n > 1 THEN 'duplicate_cell_id' ELSE 'indexed' END AS code FROM c WHERE nth = 1""",
    "memory_surfaces": f"""WITH e AS (SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, {_ARRAY((*op.SURFACES, 'pages'))}[CAST(floor(value) AS BIGINT) % 6 + 1] AS surface, {_ARRAY((*op.STATES, 'lost'))}[length(props) % 7 + 1] AS state, event_type, value, props FROM events)
SELECT doc, pos, surface, state, CAST(doc AS VARCHAR) AS source_document_id, props AS evidence_ref FROM e WHERE surface <> 'pages' AND state <> 'lost' AND event_type <> 'error' AND value > 10""",
}
