"""Queries over the shared tables, with the DuckDB SQL that says the same."""

from riskweave.plans import assembly, assessments, curation, evidence, evidence_findings, filings, marker_scans, market, nested_json, normaliser, records, runs, sourcing, synthetic, texts

MODULES = (market, evidence, records, texts, assessments, filings, curation, runs, synthetic, sourcing, evidence_findings, nested_json, marker_scans, normaliser, assembly)
