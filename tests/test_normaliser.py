"""Every rule of the normaliser's contract, on outputs that break one at a time."""

from decimal import Decimal

from riskweave.operators import normaliser

META = dict(period="2025-Q3", report_basis="separate", report_profile="securities", currency="VND", unit="vnd", report_period_type="quarterly", normalizer_version="v1", business_context_tags=["x"])
FROM = dict(source_document_id="D", raw_table_id="R1", raw_row_index=1, normalizer_version="v1", confidence=0.7)
CELL = dict(cell_id="C", period="2025-Q3", value=Decimal(5), source_document_id="D")


def output(doc, meta=META, tables=None, table=None, row=None, origin=FROM, cell=CELL):
    fix = lambda d: d and {k: (doc if v == "D" else v) for k, v in d.items()}
    r = dict(row_id="r", standard_account="revenue", provenance=fix(origin), cells=[fix(cell)]) | (row or {})
    t = dict(table_id="t", source_document_id=doc, rows=[r]) | (table or {})
    return (doc, "2025-Q3", "separate", "v1", meta, [t] if tables is None else tables)


WRONG = {
    "no metadata": (dict(meta=None), ("metadata", "schema_invalid")), "no unit": (dict(meta=META | {"unit": None}), ("metadata", "missing_required_fields")), "period": (dict(meta=META | {"period": "2024-Q3"}), ("metadata", "ambiguous_period")),
    "basis": (dict(meta=META | {"report_basis": "consolidated"}), ("metadata", "basis_mismatch")), "profile": (dict(meta=META | {"report_profile": "unknown"}), ("metadata", "unsupported_report_profile")), "unit": (dict(meta=META | {"unit": "usd"}), ("metadata", "unit_ambiguity")),
    "yearly": (dict(meta=META | {"report_period_type": "annual"}), ("metadata", "ambiguous_period")), "version": (dict(meta=META | {"normalizer_version": "v0"}), ("metadata", "weak_provenance")), "tags": (dict(meta=META | {"business_context_tags": []}), ("metadata", "missing_required_fields")),
    "no tables": (dict(tables=[]), ("tables", "missing_required_fields")), "table source": (dict(table={"source_document_id": "E"}), ("tables[0]", "weak_provenance")), "no rows": (dict(table={"rows": []}), ("tables[0]", "missing_required_fields")),
    "no account": (dict(row={"standard_account": None}), ("tables[0].rows[0]", "missing_required_fields")), "no origin": (dict(origin=None), ("tables[0].rows[0]", "weak_provenance")), "row source": (dict(origin=FROM | {"source_document_id": "E"}), ("tables[0].rows[0]", "weak_provenance")),
    "no raw": (dict(origin=FROM | {"raw_table_id": ""}), ("tables[0].rows[0]", "weak_provenance")), "raw lost": (dict(origin=FROM | {"raw_table_id": "R9"}), ("tables[0].rows[0]", "weak_provenance")), "beyond": (dict(origin=FROM | {"raw_row_index": 2}), ("tables[0].rows[0]", "weak_provenance")),
    "before": (dict(origin=FROM | {"raw_row_index": -1}), ("tables[0].rows[0]", "weak_provenance")), "no index": (dict(origin=FROM | {"raw_row_index": None}), ("tables[0].rows[0]", "weak_provenance")), "row version": (dict(origin=FROM | {"normalizer_version": "v2"}), ("tables[0].rows[0]", "weak_provenance")),
    "unsure": (dict(origin=FROM | {"confidence": 0.69}), ("tables[0].rows[0]", "weak_provenance")), "nan": (dict(origin=FROM | {"confidence": float("nan")}), ("tables[0].rows[0]", "weak_provenance")), "no cells": (dict(row={"cells": []}), ("tables[0].rows[0]", "missing_required_fields")),
    "no cell id": (dict(cell=CELL | {"cell_id": None}), ("tables[0].rows[0].cells[0]", "missing_required_fields")), "cell period": (dict(cell=CELL | {"period": "2024-Q3"}), ("tables[0].rows[0].cells[0]", "ambiguous_period")),
    "cell source": (dict(cell=CELL | {"source_document_id": "E"}), ("tables[0].rows[0].cells[0]", "weak_provenance")), "no value": (dict(cell=CELL | {"value": None}), ("tables[0].rows[0].cells[0]", "missing_required_fields")),
}


def test_every_rule(spark):
    outputs = [output("good"), output("first", origin=FROM | {"raw_row_index": 0})] + [output(name, **changes) for name, (changes, _) in WRONG.items()]
    raw = spark.createDataFrame([(o[0], "R1", 2) for o in outputs], "doc string, raw_table_id string, n_rows long")
    got = {(r["doc"], r["path"], r["code"]) for r in normaliser.violations(spark.createDataFrame(outputs, normaliser.SCHEMA), raw).collect()}
    assert got == {(name, *want) for name, (_, want) in WRONG.items()}
    assert normaliser.violations(spark.createDataFrame([], normaliser.SCHEMA), raw).count() == 0
