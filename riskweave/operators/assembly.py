"""A report's memory from an artifact's nested tables: what a table or row says counts for its cells, every table knows its
periods, every cell its place, and notes and surfaces keep only what tools may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Surfaces and their states, and the fields of a note that tools see.
SURFACES = ("notes", "variance_explanations", "related_party_evidence", "accounting_policy_evidence", "extraction_quality")
STATES = ("present", "absent_in_source", "not_applicable", "unsupported_by_extraction_path", "not_extracted_yet", "ambiguous_failed_closed")
NOTE_FIELDS = ("note_id", "section_id", "note_type", "note_number", "title", "source_document_id", "text", "linked_row_ids", "periods", "status")
INHERITED = ("unit", "page", "excerpt")


def inherited(tables: Column) -> Column:
    """``tables`` whose rows and cells have the unit, page and excerpt of what holds them where they say none themselves."""

    def given(inner: Column, outer: Column) -> Column:
        for name in INHERITED:
            inner = inner.withField(name, F.coalesce(inner[name], outer[name]))
        return inner

    def filled(table: Column) -> Column:
        rows = F.transform(table["rows"], lambda r: given(r, table))
        return table.withField("rows", F.transform(rows, lambda r: r.withField("cells", F.transform(r["cells"], lambda c: given(c, r)))))

    return F.transform(tables, filled)


def periods(table: Column) -> Column:
    """The periods of a table's cells in the order in which they first come."""
    return F.array_compact(F.array_distinct(F.flatten(F.transform(table["rows"], lambda r: F.transform(r["cells"], lambda c: c["period"])))))


def cell_index(reports: DataFrame) -> DataFrame:
    """A row for every cell id of a report (doc, tables): where its first cell is and what it inherits, the table's periods, and
    ``code``: ``indexed``, ``duplicate_cell_id`` where several cells have it, ``missing_cell_id``."""
    t = reports.select("doc", F.posexplode(inherited(F.col("tables"))).alias("i", "t")).select("doc", "i", "t", periods(F.col("t")).alias("periods"))
    r = t.select("doc", "i", "periods", F.col("t.table_id").alias("table_id"), F.posexplode("t.rows").alias("j", "r"))
    c = r.select("doc", "i", "j", "periods", "table_id", F.col("r.row_id").alias("row_id"), F.posexplode("r.cells").alias("k", "c"))
    what = F.struct("table_id", "row_id", "periods", F.col("c.period").alias("period"), F.col("c.value").alias("value"), *(F.col(f"c.{n}").alias(n) for n in INHERITED))
    g = c.groupBy("doc", F.col("c.cell_id").alias("cell_id")).agg(F.count("*").alias("n"), F.min_by(what, F.struct("i", "j", "k")).alias("first"))
    code = F.when(F.col("cell_id").isNull(), "missing_cell_id").when(F.col("n") > 1, "duplicate_cell_id").otherwise("indexed")
    return g.select("doc", "cell_id", "n", "first.*", code.alias("code"))


def projected_notes(reports: DataFrame) -> DataFrame:
    """Notes of reports (doc, source, notes) with the fields that tools see; without a source of their own they have the report's."""
    notes = reports.select("doc", "source", F.posexplode("notes").alias("pos", "n"))
    kept = [F.coalesce("n.source_document_id", "source").alias(f) if f == "source_document_id" else F.col(f"n.{f}").alias(f) for f in NOTE_FIELDS]
    return notes.select("doc", "pos", *kept)


def projected_surfaces(reports: DataFrame) -> DataFrame:
    """Surface statuses of reports (doc, source, surfaces of surface, state, source_document_id, evidence_ref) that name a known
    surface and state, evidence, and no other source."""
    s = reports.select("doc", "source", F.posexplode("surfaces").alias("pos", "s"))
    own = F.coalesce("s.source_document_id", "source")
    good = F.col("s.surface").isin(*SURFACES) & F.col("s.state").isin(*STATES) & (own == F.col("source")) & (F.trim(F.coalesce("s.evidence_ref", F.lit(""))) != "")
    return s.where(good).select("doc", "pos", "s.surface", "s.state", own.alias("source_document_id"), "s.evidence_ref")
