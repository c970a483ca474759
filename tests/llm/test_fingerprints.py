"""Fingerprints against the contract's plain version, exact similarities, and odd tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import fingerprints, queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def by_rows(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in fingerprints.fingerprints(frame).collect()), key=str)


def components(texts):
    """By exact similarity: {key: least key}."""
    least = {k: k for k in texts}
    sets = {k: shingles(t) for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_op13_keeps_its_contract(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in queries.op13_fingerprints(spark, SF).collect()}
    keys = sorted(texts)
    assert sorted(rows) == keys
    prints, off = {}, []
    for k, after in zip(keys, [*keys[1:], keys[0]]):
        r, t = rows[k], texts[k]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        own = [x.tobytes().hex() for x in fingerprints.signatures(pa.array([t, edited]))[0]]
        assert own == [r["fingerprint"], r["edited_fingerprint"]]
        off += [abs(r["near_edited"] - jaccard(t, edited)), abs(r["near_next"] - jaccard(t, texts[after]))]
    assert max(off) < 0.2 and np.mean(off) < 0.03
    want = components(texts)
    assert {k: r["component_id"] for k, r in rows.items()} == want


def test_both_ways_to_the_next_document_agree(spark):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice("the of and to in ä ß 学").upper() * rng.randint(1, 3) for _ in range(n))
    rows = [(i * 7, some(rng.randint(0, 60))) for i in range(90)]
    in_order = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id AS key", "text")
    runs = fingerprints._runs(in_order)
    assert runs is not None and len(runs[0]) >= 1
    columns = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n"]
    got = lambda f: sorted(tuple(r) for r in f.select(*columns).collect())
    first = fingerprints._in_order(in_order, *runs)
    joined = fingerprints._by_joins(in_order)
    assert got(first) == got(joined) and len(got(first)) == 90
    assert fingerprints._runs(in_order.repartition(4)) is None
    assert got(fingerprints.sign(in_order.repartition(4))) == got(first)
    # Runs that another order of rows was found in: the pass notices and gives way.
    wrong = (np.array([0, 301]), np.array([294, 623]))
    assert fingerprints._in_order(in_order.coalesce(1).orderBy("key", ascending=False).coalesce(1), *wrong) is None


def test_odd_tables(spark):
    long = "wort " * 40_000
    rows = [(None, "x y z"), (1, None), (2, ""), (3, " \n "), (4, "A b C"), (4, "a B c"), (5, long), (5, long), (9, long.upper())]
    got = by_rows(spark, rows)
    assert len(got) == len(rows)
    one = {r[0]: r for r in got}
    assert one[1][3] == one[2][3] == one[3][3] and one[1][5] == 1.0
    assert one[None][7] is None and one[9][7] == 5 and one[1][7] == 1 and one[4][7] == 4
    assert one[None][2] == hashlib.sha256(b"x y").hexdigest()  # the first document is empty
    assert by_rows(spark, []) == [] and len(by_rows(spark, [(None, "a b"), (None, None)])) == 2
    single = by_rows(spark, [(7, "one two three four five six seven")])
    assert single[0][5] < 1 and single[0][6] == 1.0
    clash = spark.createDataFrame([(1, "a b c", "x", 0.5)], "doc_id long, text string, fingerprint string, near_next double")
    assert [r["component_id"] for r in fingerprints.fingerprints(clash).collect()] == [1]


@pytest.mark.parametrize("tile", [2048, 16])
def test_components_follow_exact_similarity(spark, tile, monkeypatch):
    monkeypatch.setattr(fingerprints, "TILE", tile)
    rng = random.Random(tile)
    word = lambda: f"w{rng.randint(0, 5000)}"
    base = [[word() for _ in range(120)] for _ in range(6)]
    texts, key = {}, 0
    for words in base:
        for _ in range(40):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = word()
            texts[key] = " ".join(own)
            key += rng.randint(1, 4)
    got = {r[0]: r[7] for r in by_rows(spark, list(texts.items()), 5)}
    assert got == components(texts)


def test_a_common_token_is_one_entry_a_batch(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{words} end{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "key long, text string").coalesce(1)
    signed = fingerprints.sign(frame)
    sent = fingerprints._met(signed.where("n > 0").select("key", "n", "fingerprint", "sketch"))
    assert sent.select("key").distinct().count() == 2999  # all but the first, whichever leads
    assert sent.count() <= 24 * 2999 * 1.2
    near = fingerprints.near_copies(frame, signed)
    assert near.select("component").distinct().collect()[0][0] == 0 and near.count() == 3000
