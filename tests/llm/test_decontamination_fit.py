"""The latent space of operator 8 is fitted on whole blocks of items, on no sample of documents."""

import random

import numpy as np

from riskweave.llm import decontamination


def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choices(words, k=40))) for i in range(12)]
    docs = [" ".join(draw.choices(words, k=60)) for _ in range(450)]
    for i, item in items:
        docs[i * 30] += " " + item + " " + " ".join(draw.choices(words, k=20))
    return items, docs


def test_scores_do_not_depend_on_keys(spark):
    items, docs = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [
        sorted((r["doc_id"] - shift, r["item_id"], r["cosine"], r["common"]) for r in decontamination.find_leaks(spark.createDataFrame([(i + shift, t) for i, t in enumerate(docs)], "doc_id long, text string"), bench).collect())
        for shift in (0, 10**6)
    ]
    assert {x[:2] for x in found[0]} == {(i * 30, i) for i, _ in items}
    assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
    assert np.allclose([x[2:] for x in found[0]], [x[2:] for x in found[1]], atol=1e-6, rtol=0)
