"""A query of the normaliser's contract: orders are outputs, their lines rows that point into raw tables by return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import normaliser as op
from riskweave.sources.tables import read

VERSION = "v1"


def normaliser_violations(spark, sf):
    """What in orders' outputs breaks the contract, by path."""
    c = F.col
    lines = read(spark, sf, "lineitem")
    key = c("l_orderkey").cast("string")
    period = F.year("l_shipdate").cast("string")
    cell = F.struct(c("l_partkey").cast("string").alias("cell_id"), period.alias("period"), F.when(c("l_quantity") < 50, F.round(c("l_extendedprice") * 100).cast("decimal(38,0)")).alias("value"), key.alias("source_document_id"))
    origin = F.struct(
        key.alias("source_document_id"), F.when(c("l_returnflag") != "A", c("l_returnflag")).when(c("l_quantity") > 3, F.lit("A")).alias("raw_table_id"), (c("l_linenumber") - 1).cast("int").alias("raw_row_index"),
        F.when(c("l_tax") > 0.075, "v0").otherwise(VERSION).alias("normalizer_version"), F.round(1 - c("l_discount") * 4, 2).alias("confidence"),
    )
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(c("l_linenumber").cast("string").alias("row_id"), F.lit("revenue").alias("standard_account"), origin.alias("provenance"), F.when(c("l_discount") < 0.065, F.array(cell)).otherwise(F.array().cast("array<struct<cell_id:string,period:string,value:decimal(38,0),source_document_id:string>>")).alias("cells")).alias("row"))
    g = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]).alias("rows"))
    o = read(spark, sf, "orders").join(g, c("o_orderkey") == c("l_orderkey"), "left")
    doc = c("o_orderkey").cast("string")
    year = F.year("o_orderdate").cast("string")
    basis, unit = F.substring("o_orderpriority", 3, 50), F.when(c("o_totalprice") > 300000, "usd").otherwise("vnd")
    meta = F.struct(F.when(c("o_custkey") % 10 > 0, year).otherwise("never").alias("period"), F.when(c("o_orderpriority") == "5-LOW", "HIGH").otherwise(basis).alias("report_basis"), F.when(c("o_orderstatus") == "P", "other").otherwise("securities").alias("report_profile"), F.lit("VND").alias("currency"), unit.alias("unit"), F.lit("quarterly").alias("report_period_type"), F.lit(VERSION).alias("normalizer_version"), F.when(c("o_totalprice") < 5000, F.array().cast("array<string>")).otherwise(F.array(F.lit("tag"))).alias("business_context_tags"))
    tables = F.when(c("rows").isNotNull(), F.array(F.struct(F.lit("t").alias("table_id"), F.when(c("o_totalprice") > 10000, doc).alias("source_document_id"), "rows")))
    outputs = o.select(doc.alias("doc"), year.alias("period"), basis.alias("basis"), F.lit(VERSION).alias("version"), meta.alias("metadata"), tables.alias("tables"))
    raw = lines.groupBy(key.alias("doc"), c("l_returnflag").alias("raw_table_id")).agg(F.count("*").alias("n_rows"))
    return op.violations(outputs, raw)


NAMES = ["normaliser_violations"]
QUERIES = {name: globals()[name] for name in NAMES}
SQL = {
    "normaliser_violations": f"""WITH o AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS doc, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders),
n AS (SELECT l_orderkey, l_returnflag AS raw, count(*) AS n_rows FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS j, CASE WHEN l_returnflag <> 'A' THEN l_returnflag WHEN l_quantity > 3 THEN 'A' END AS raw FROM lineitem),
r AS (SELECT l.*, n_rows, doc, y FROM l JOIN o ON o_orderkey = l.l_orderkey LEFT JOIN n ON n.l_orderkey = l.l_orderkey AND n.raw = l.raw),
m AS (SELECT doc, CASE WHEN o_custkey % 10 = 0 THEN 'ambiguous_period/period' WHEN o_orderpriority = '5-LOW' THEN 'basis_mismatch/report_basis' WHEN o_orderstatus = 'P' THEN 'unsupported_report_profile/report_profile' WHEN o_totalprice > 300000 THEN 'unit_ambiguity/unit' WHEN o_totalprice < 5000 THEN 'missing_required_fields/business_context_tags' END AS v FROM o),
w AS (SELECT doc, j, CASE WHEN raw IS NULL THEN 'weak_provenance/raw_table_id' WHEN n_rows IS NULL THEN 'weak_provenance/raw_table_id not found' WHEN l_linenumber - 1 < 0 OR l_linenumber - 1 >= n_rows THEN 'weak_provenance/raw_row_index' WHEN l_tax > 0.075 THEN 'weak_provenance/normalizer_version' WHEN round(1 - l_discount * 4, 2) < 0.7 THEN 'weak_provenance/confidence' WHEN NOT l_discount < 0.065 THEN 'missing_required_fields/cells' END AS v FROM r),
k AS (SELECT doc, j, CASE WHEN CAST(year(l_shipdate) AS VARCHAR) <> y THEN 'ambiguous_period/period' WHEN NOT l_quantity < 50 THEN 'missing_required_fields/value' END AS v FROM r WHERE l_discount < 0.065),
e AS (SELECT doc, 'metadata' AS path, v FROM m UNION ALL SELECT doc, 'tables', 'missing_required_fields/tables' FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT doc, 'tables[0]', 'weak_provenance/source_document_id' FROM o WHERE NOT o_totalprice > 10000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT doc, 'tables[0].rows[' || j || ']', v FROM w UNION ALL SELECT doc, 'tables[0].rows[' || j || '].cells[0]', v FROM k)
SELECT doc, path, split_part(v, '/', 1) AS code, split_part(v, '/', 2) AS detail FROM e WHERE v IS NOT NULL""",
}
