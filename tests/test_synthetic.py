"""Synthetic values: the wanted side of every family's threshold, as near to it as whole numbers allow."""

import random
from fractions import Fraction

import pytest

from riskweave.operators import synthetic


def rounded(x: Fraction) -> int:
    return int(abs(x) + Fraction(1, 2)) * (1 if x >= 0 else -1)


@pytest.mark.parametrize("side", ["above", "not_above", "below", "not_below"])
def test_solved_values_are_nearest(spark, side):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 7, 100, 12345, 10**15 + 7]), rng.randint(-12000, 12000)) for _ in range(400)]
    frame = spark.createDataFrame(rows, "b long, t long").selectExpr("b", "t", f"CAST({synthetic.solved_text('b', 't', side)} AS BIGINT) AS v")
    holds = {"above": lambda m, t: m > t, "not_above": lambda m, t: m <= t, "below": lambda m, t: m < t, "not_below": lambda m, t: m >= t}[side]
    step = -1 if side in ("above", "not_below") else 1
    for b, t, v in frame.collect():
        metric = lambda v: rounded(Fraction(10000 * v, b))
        assert holds(metric(v), t) and (b > 10000 or not holds(metric(v + 2 * step), t)), (b, t, v)


def test_every_family_lands_on_the_wanted_side(spark):
    rng = random.Random(6)
    targets = ["supported", "weakly_supported", "not_supported", "insufficient_evidence"]
    rows = [(i, rng.randint(2000, 10**9), rng.randint(2000, 10**9), rng.randint(50, 10**9), targets[i % 4]) for i in range(300)]
    got = synthetic.family_values(spark.createDataFrame(rows, "i int, revenue long, revenue_prior long, receivables long, target string")).collect()
    assert {r["family"] for r in got} == set(synthetic.FAMILIES) and len(got) == 300 * 6
    for r in got:
        wanted = r["target"] in targets[:2]
        assert r["exceeded"] == wanted or r["value"] == 0, r
        if r["target"] != "supported" and r["value"] > 0 and r["base"] > 20000:
            assert abs(r["metric_bp"] - synthetic.THRESHOLDS[r["family"]][1]) <= 1, r
