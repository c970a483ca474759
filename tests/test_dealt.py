"""Work that is dealt by the rows of its table, and what iterations and rules work out once."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import assessments, dataset
from riskweave.plans import assessments as packets
from riskweave.plans import curation, filings, sourcing
from riskweave.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [curation.promotion, curation.gate_outcomes, curation.negative_controls, filings.source_records, filings.source_selection, filings.source_confirmation, packets.visible_ids, packets.assessment_validation])
def test_parts_grow_with_the_rows(spark, monkeypatch, made):
    monkeypatch.setattr(tables, "ROWS", 500)
    wanted = -(-tables.read(spark, SF, "lineitem").count() // 500)
    assert wanted > 4 and f", {wanted})" in made(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_identities_are_kept_for_all_rounds(spark, monkeypatch):
    kept, cut = [], dataset._cut
    monkeypatch.setattr(dataset, "_cut", lambda df: kept.append(tuple(df.columns)) or cut(df))
    got = dataset.identity_groups(spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "k int, i string"), "k", "i")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4)] and kept[0] == ("r", "i") and kept.count(("r", "i")) == 1


def test_an_assessment_is_written_as_json_once(spark):
    rows = packets._assessed(spark, SF).select(assessments.assessment_violation().alias("code"))
    assert rows._jdf.queryExecution().analyzed().toString().count("to_json") == 1
    assert rows.where(F.col("code").isNull()).count() >= 0


def test_a_repair_looks_a_reference_up_once(spark):
    rows = assessments.repaired(packets._assessed(spark, SF))
    assert rows._jdf.queryExecution().analyzed().toString().count("substring_index") <= 4  # the packets' own, the references, the signals'


def test_page_texts_are_kept_for_all_uses(spark, monkeypatch):
    kept, cut = [], dataset._cut
    monkeypatch.setattr(dataset, "_cut", lambda df: kept.append(df) or cut(df))
    assert sourcing.supporting_links(spark, SF).columns == ["package", "canonical", "supporting", "correction"] and len(kept) == 1
