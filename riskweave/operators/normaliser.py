"""The contract of a normaliser's output: what it made of raw tables must point back into them, row by row.

Nested outputs are flattened level by level, and rows meet the raw tables that they name in an equi-join; every item that breaks a
rule is a row with its path and the first rule that it breaks, where a reference engine stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What metadata may say, and how sure a row must be.
PROFILES = ("standard_corporate", "credit_institution", "securities", "insurance")
UNITS = ("vnd", "thousand_vnd", "million_vnd", "billion_vnd")
LEAST_CONFIDENCE = 0.70
SCHEMA = (
    "doc string, period string, basis string, version string, "
    "metadata struct<period:string,report_basis:string,report_profile:string,currency:string,unit:string,report_period_type:string,normalizer_version:string,business_context_tags:array<string>>, "
    "tables array<struct<table_id:string,source_document_id:string,rows:array<struct<row_id:string,standard_account:string,"
    "provenance:struct<source_document_id:string,raw_table_id:string,raw_row_index:int,normalizer_version:string,confidence:double>,"
    "cells:array<struct<cell_id:string,period:string,value:decimal(38,0),source_document_id:string>>>>>>"
)


def _first(*rules: tuple[Column, str, str]) -> Column:
    """(code, detail) of the first rule that is broken; a rule that can't be told is broken."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"))) for broken, code, detail in rules))


def _empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(-1)) <= 0


def _broken(rows: DataFrame, path: Column, *rules: tuple[Column, str, str]) -> DataFrame:
    return rows.select("doc", path.alias("path"), _first(*rules).alias("v")).where("v is not null").select("doc", "path", "v.code", "v.detail")


def violations(outputs: DataFrame, raw_tables: DataFrame) -> DataFrame:
    """(doc, path, code, detail) for outputs (``SCHEMA``; period, basis and version are what is asked for) over raw_tables (doc,
    raw_table_id, n_rows).  Items below one that is missing aren't there; one that breaks a rule is still looked into."""
    m = lambda n: F.col(f"metadata.{n}")
    differs = lambda a, b: ~a.eqNullSafe(b)
    named = ("period", "report_basis", "report_profile", "currency", "unit", "report_period_type", "normalizer_version")
    lacks = F.lit(False)
    for n in named:
        lacks = lacks | m(n).isNull()
    meta = _broken(
        outputs, F.lit("metadata"),
        (F.col("metadata").isNull(), "schema_invalid", "metadata"), (lacks | m("business_context_tags").isNull(), "missing_required_fields", "metadata"), (differs(m("period"), F.col("period")), "ambiguous_period", "period"),
        (differs(m("report_basis"), F.col("basis")), "basis_mismatch", "report_basis"), (~m("report_profile").isin(*PROFILES), "unsupported_report_profile", "report_profile"), ((m("currency") != "VND") | ~m("unit").isin(*UNITS), "unit_ambiguity", "unit"),
        (m("report_period_type") != "quarterly", "ambiguous_period", "report_period_type"), (differs(m("normalizer_version"), F.col("version")), "weak_provenance", "normalizer_version"), (_empty(m("business_context_tags")), "missing_required_fields", "business_context_tags"),
    )
    none = _broken(outputs, F.lit("tables"), (_empty(F.col("tables")), "missing_required_fields", "tables"))
    t = outputs.select("doc", "period", "version", F.posexplode("tables").alias("i", "t"))
    at_table = F.format_string("tables[%d]", "i")
    tables = _broken(t, at_table, (F.col("t.table_id").isNull(), "missing_required_fields", "table_id"), (differs(F.col("t.source_document_id"), F.col("doc")), "weak_provenance", "source_document_id"), (_empty(F.col("t.rows")), "missing_required_fields", "rows"))
    r = t.select("doc", "period", "version", "i", F.posexplode("t.rows").alias("j", "r"))
    at_row = F.format_string("tables[%d].rows[%d]", "i", "j")
    p = lambda n: F.col(f"r.provenance.{n}")
    raw = raw_tables.select("doc", F.col("raw_table_id").alias("raw"), "n_rows")
    met = r.withColumn("raw", p("raw_table_id")).join(raw, ["doc", "raw"], "left")
    rows = _broken(
        met, at_row,
        (F.col("r.row_id").isNull() | F.col("r.standard_account").isNull(), "missing_required_fields", "row"), (F.col("r.provenance").isNull(), "weak_provenance", "provenance"), (differs(p("source_document_id"), F.col("doc")), "weak_provenance", "source_document_id"),
        (F.coalesce(p("raw_table_id"), F.lit("")) == "", "weak_provenance", "raw_table_id"), (F.col("n_rows").isNull(), "weak_provenance", "raw_table_id not found"), ((p("raw_row_index") < 0) | (p("raw_row_index") >= F.col("n_rows")), "weak_provenance", "raw_row_index"),
        (differs(p("normalizer_version"), F.col("version")), "weak_provenance", "normalizer_version"), (F.isnan(p("confidence")) | (p("confidence") < LEAST_CONFIDENCE), "weak_provenance", "confidence"), (_empty(F.col("r.cells")), "missing_required_fields", "cells"),
    )
    c = r.select("doc", "period", "i", "j", F.posexplode("r.cells").alias("k", "c"))
    cells = _broken(
        c, F.format_string("tables[%d].rows[%d].cells[%d]", "i", "j", "k"),
        (F.col("c.cell_id").isNull() | F.col("c.period").isNull() | F.col("c.source_document_id").isNull(), "missing_required_fields", "cell"), (differs(F.col("c.period"), F.col("period")), "ambiguous_period", "period"),
        (differs(F.col("c.source_document_id"), F.col("doc")), "weak_provenance", "source_document_id"), (F.col("c.value").isNull(), "missing_required_fields", "value"),
    )
    return meta.union(none).union(tables).union(rows).union(cells)
