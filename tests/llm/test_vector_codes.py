"""Vector codes against plain whole-number arithmetic, and odd tables."""

import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=vector_codes.ROUNDS):
    """The contract, row by row: {row index: (code, error)} and the codebooks' digest."""
    kept = [(i, k, [math.floor(4096 * x) for x in v], lab) for i, (k, v, lab) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v, _ in kept), default=0) // 8) * 8
    cut = lambda v: [(v + [0] * (width - len(v)))[p * width // 8 : (p + 1) * width // 8] for p in range(8)]
    parts = {i: cut(v) for i, _, v, _ in kept}
    firsts = sorted((k, i) for i, k, _, _ in kept if k is not None)[:16]
    books = [[parts[i][p] for _, i in firsts] for p in range(8)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            where = {i: best(parts[i][p], books[p])[1] for i in parts}
            for k in range(len(firsts)):
                own = [parts[i][p] for i in parts if where[i] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = {i: [best(parts[i][p], books[p]) for p in range(8)] for i in parts}
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, digest


def coded(spark, rows):
    done, books = vector_codes.encode(spark.createDataFrame(rows, KIND).repartition(3))
    return done.collect(), books


def test_codes_follow_the_plain_version(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 3, [round(float(x), 3) for x in rng.normal(0, 1, 16).astype(np.float32)], int(rng.integers(0, 3)) if i % 5 else None) for i in range(120)]
    rows += [(900 + i, rows[0][1], 1) for i in range(60)]  # a common vector
    rows = [(k, [float(np.float32(x)) for x in v], lab) for k, v, lab in rows]
    want, digest = plain(rows)
    got, books = coded(spark, rows)
    assert {r["key"]: (r["code"], r["error"]) for r in got} == {rows[i][0]: x for i, x in want.items()}
    assert vector_codes.digest(books) == digest
    for r in got:
        assert r["label_error"] == sum(want[i][1] for i, x in enumerate(rows) if x[2] == r["label"])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf], 1), (5, [-inf], 2), (None, [0.5] * 8, None), (6, [], 2), (7, [0.25] * 9, None), (8, [-0.1] * 8, 2), (8, [-0.1] * 8, 2), (9, [1e30], 3)]
    got, books = coded(spark, rows)
    assert sorted(str(r["key"]) for r in got) == ["6", "7", "8", "8", "9", "None"]
    assert books.shape == (8, 5, 2) and all(len(r["code"]) == 16 for r in got)
    assert {r["label_error"] for r in got if r["label"] is None} == {sum(r["error"] for r in got if r["label"] is None)}
    assert coded(spark, [(1, None, 1)]) == ([], None)
    got, books = coded(spark, [(None, [0.5] * 8, 1), (None, [0.5] * 8, 1)])
    assert [(r["code"], r["error"]) for r in got] == [("00" * 8, 0)] * 2
    clash = spark.createDataFrame([(1, [1.0] * 8, 1, "x", 2)], KIND + ", code string, error int")
    assert vector_codes.encode(clash)[0].columns == ["key", "label", "code", "error", "label_error"]


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 6), st.integers(1, 16), st.integers(0, 10**6))
def test_nearest_with_partial_distances_is_nearest(width, entries, seed):
    rng = np.random.default_rng(seed)
    rows, book = rng.integers(-3, 4, (40, width)), rng.integers(-3, 4, (entries, width))
    which, best = vector_codes.nearest(rows, book)
    every = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (which == every.argmin(1)).all() and (best == every.min(1)).all()


def test_means_are_floored_and_unused_entries_stay(spark):
    rows = [(i, [float(i)] * 8, 0) for i in range(2)] + [(2, [0.0] * 8, 0)]
    _, books = coded(spark, rows)
    assert books[0].tolist() == [[0], [4096], [0]]
    assert vector_codes.fit(vector_codes.whole_numbers(spark.createDataFrame([(0, [-0.5] * 8, 0), (1, [-0.3] * 8, 0), (2, [9.0] * 8, 0)][:2] * 2, KIND), "vec_id", "embedding", "label"), 8).shape == (8, 4, 1)
