"""The pipeline on the smallest tables: stages keep columns, their decisions hold, and the last packs what is left."""

from importlib.util import find_spec

import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(find_spec("corpus_pipeline") is None, reason="corpus_pipeline.py isn't there")


def test_stages_and_run(spark):
    import corpus_pipeline as pipeline

    from riskweave.llm import decontamination, jaccard_join, line_dedup, store, toxicity
    from riskweave.llm.queries import table

    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, store.written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        ids, was = {r["doc_id"] for r in kept.collect()}, {r["doc_id"]: r for r in before.collect()}
        assert kept.count() == len(ids)
        if name == "toxicity":
            assert ids == {k for k, s in scores.items() if s < pipeline.REJECTED}
        elif name == "line_dedup":
            left = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(before).collect()}
            assert all(r["text"] == left[r["doc_id"]] for r in kept.collect())
            assert all(r["n_chars"] == len(r["text"]) for r in kept.collect() if r["text"] != was[r["doc_id"]]["text"])
        elif name == "ngram_jaccard_join":
            assert ids == {r["component_id"] for r in jaccard_join.join(before).collect()}
        else:
            assert ids == set(was) - {r["doc_id"] for r in decontamination.find_leaks(before, table(spark, SF, "benchmark")).collect()}
    rows = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == ids
    size = {}
    for r in rows:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    assert all(size[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_stages_take_nulls_and_empty_tables(spark):
    import corpus_pipeline as pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (3, "same text of six words here", "en", "s", 27), (4, "same text of six words here", "en", "s", 27)]
    for rows, left in ((odd, {None, 1, 2, 3}), ([], set())):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == schema.names
        assert {r["doc_id"] for r in docs.collect()} == left
        assert {r["doc_id"] for r in pipeline.STAGES[-1][1](spark, docs, SF).collect()} == left


def test_texts_of_one_key_stay_and_leaks_without_a_key_go(spark):
    import corpus_pipeline as pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (8, b, "en", "s", 1), (7, a, "en", "s", 1), (None, item, "en", "s", 1), (None, a, "en", "s", 1), (9, item, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = pipeline.near_copies(spark, docs, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, a), (7, b), (9, item), (None, item), (None, a)], key=str)
    clean = pipeline.leaks(spark, kept, SF)
    assert clean.columns == schema.names
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted([(7, a), (7, b), (None, a)], key=str)
