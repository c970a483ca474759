"""Source safety check by check, and texts that contain names against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import linking, safety

SLOT = (
    "case string, role int, year int, quarter int, refreshable boolean, cached struct<source_id:string,fingerprint:string,filing_status:string>, "
    "refreshed struct<status:string,fingerprint:string,canonical_id:string,filing_status:string,superseded:array<string>,corrected_source_id:string,"
    "operative_corrected_source_id:string,correction_status:string,corrected_value_status:string,is_corrected:boolean,has_corrected_values:boolean>"
)
FRESH = ("selected", "aa", "DOC_1", "original", ["DOC_0"], None, None, None, None, None, False)
OLD = ("DOC_1", "aa", "original")


def fresh(**changes):
    names = "status fingerprint canonical_id filing_status superseded corrected_source_id operative_corrected_source_id correction_status corrected_value_status is_corrected has_corrected_values".split()
    return tuple(changes.get(n, v) for n, v in zip(names, FRESH))


CASES = {
    "safe": ((True, OLD, FRESH), ("safe", None, None, False)),
    "no id to compare": ((True, OLD, fresh(canonical_id=None, filing_status="")), ("safe", None, None, False)),
    "no refresh": ((False, OLD, FRESH), ("invalid_blocked", "recent_source_refresh_unavailable", 0, False)),
    "nothing came": ((True, OLD, None), ("invalid_blocked", "recent_source_refresh_invalid", 0, False)),
    "asks": ((True, OLD, fresh(status="hitl_needed", fingerprint=None)), ("ambiguous_source_requires_resolution", "ambiguous_source_requires_resolution", 0, False)),
    "not selected": ((True, OLD, fresh(status="failed")), ("invalid_blocked", "refreshed_source_metadata_missing", 0, False)),
    "no status": ((True, OLD, fresh(status=None)), ("invalid_blocked", "refreshed_source_metadata_missing", 0, False)),
    "no print": ((True, ("DOC_1", "", "original"), FRESH), ("invalid_blocked", "refreshed_source_metadata_missing", 0, False)),
    "other print": ((True, OLD, fresh(fingerprint="bb", canonical_id="DOC_2")), ("stale_rebuild_required", "refreshed_source_fingerprint_changed", 0, True)),
    "other id": ((True, OLD, fresh(canonical_id="DOC_2", filing_status="amended")), ("stale_rebuild_required", "refreshed_source_identity_changed", 0, True)),
    "other status": ((True, OLD, fresh(filing_status="amended", superseded=["DOC_1"])), ("stale_rebuild_required", "refreshed_source_status_changed", 0, True)),
    "superseded": ((True, OLD, fresh(superseded=["DOC_0", "DOC_1"], is_corrected=True)), ("stale_rebuild_required", "refreshed_source_superseded", 0, True)),
    "corrected": ((True, OLD, fresh(has_corrected_values=True)), ("stale_rebuild_required", "refreshed_source_corrected", 0, True)),
    "corrected by id": ((True, OLD, fresh(operative_corrected_source_id="DOC_9")), ("stale_rebuild_required", "refreshed_source_corrected", 0, True)),
}


def test_every_check_in_order(spark):
    rows = [(name, 0, 2025, 3, *slot) for name, (slot, _) in CASES.items()]
    got = {r["case"]: tuple(r)[1:] for r in safety.source_safety(spark.createDataFrame(rows, SLOT), [(2025, 3), (2025, 2)]).collect()}
    assert got == {name: (o, c and safety.PREFIX + c, r, a) for name, (_, (o, c, r, a)) in CASES.items()}


def test_roles_in_order_and_recent_quarters_only(spark):
    bad, worse = (False, OLD, FRESH), (True, OLD, fresh(fingerprint="bb"))
    rows = [("old", 0, 2024, 3, *bad), ("old", 1, 2023, 3, *worse), ("second", 0, 2025, 2, True, OLD, FRESH), ("second", 1, None, 2, *worse), ("both", 1, 2025, 3, *worse), ("both", 0, 2025, None, *bad)]
    got = {r["case"]: (r["outcome"], r["role"], r["reconfirm"]) for r in safety.source_safety(spark.createDataFrame(rows, SLOT), [(2025, 3), (2025, 2)]).collect()}
    assert got == {"old": ("safe", None, False), "second": ("stale_rebuild_required", 1, True), "both": ("invalid_blocked", 0, False)}
    assert safety.source_safety(spark.createDataFrame([], SLOT), []).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_contained_is_what_comparing_all_pairs_gives(spark, seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [(i, some(rng.randint(0, 30))) for i in range(60)] + [(99, None), (98, "aaa" * 400)]
    names = [some(rng.randint(0, 5)) for _ in range(30)] + ["a", "b a", "zz", None, ""]
    got = {tuple(r) for r in linking.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(i, n) for i, t in texts for n in names if n and t is not None and n in t}


def test_containing_joins_by_an_index(spark):
    plan = linking.contained(spark.range(9).selectExpr("id", "concat('t', id) AS text"), spark.range(9).selectExpr("concat('t', id) AS name"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_links_need_one_language_and_the_basis(spark):
    docs = spark.createDataFrame([(1, "financial_statement", "vi", "separate"), (2, "variance_explanation", "vi", "parent"), (3, "variance_explanation", "en", "parent"), (4, "amendment_context_attachment", "vi", "consolidated"), (5, "amendment_context_attachment", "vi", "separate"), (6, "financial_statement", "vi", "separate")], "id int, role string, language string, basis string")
    packages = spark.createDataFrame([("P", 1, ["abc", "ab jsc"], "parent")], "package string, canonical int, names array<string>, basis string")
    found = spark.createDataFrame([(i, "abc") for i in range(1, 5)] + [(5, "ab jsc"), (5, "abc"), (6, "abc")], "id int, name string")
    got = sorted(tuple(r) for r in linking.supporting_links(docs, packages, found).collect())
    assert got == [("P", 1, 2, False), ("P", 1, 5, True)]
    assert linking.supporting_links(docs, packages, found.where(F.lit(False))).count() == 0
