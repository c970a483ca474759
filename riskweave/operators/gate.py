"""The label gate: why a judged candidate may not be promoted, and the best one of each example that may.

Candidates have example, idx, decision, score (percent), dims (array of hard dimensions' scores), total, target and
assessed support level, target and assessed category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores from which a candidate may be promoted, in percent, and what a hard dimension must reach.
SCORE, WEAK_SCORE, HARD = 90, 70, 5


def rejections() -> Column:
    """Reason codes in order; empty for an eligible candidate."""
    weak = (F.col("target") == "weakly_supported") & (F.col("assessed") == "weakly_supported")
    least = F.when(F.coalesce(weak, F.lit(False)), WEAK_SCORE).otherwise(SCORE)
    decision = F.when(~F.coalesce(F.col("decision") == "keep", F.lit(False)), F.concat(F.lit("judge_decision_"), F.coalesce("decision", F.lit("missing"))))
    score = F.when(F.coalesce(F.col("score") < least, F.lit(True)), "judge_score_below_promotion_threshold")
    hard = F.when(F.exists("dims", lambda d: ~F.coalesce(d == HARD, F.lit(False))), "judge_hard_dimension_below_promotion_threshold")
    return F.array_compact(F.array(decision, score, hard))


def promoted(candidates: DataFrame) -> DataFrame:
    """Per example the eligible candidate of the greatest (support match, category match, score, total, -idx), if any."""
    match = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")
    key = F.struct(match("target", "assessed"), match("target_category", "category"), "score", "total", -F.col("idx"))
    free = F.size(rejections()) == 0
    out = candidates.groupBy("example").agg(F.max_by(F.when(free, F.struct("idx", "assessed", "score")), F.when(free, key)).alias("best"), F.count_if(free).alias("eligible"), F.count("*").alias("candidates"))
    return out.select("example", F.col("best.idx").alias("idx"), F.col("best.assessed").alias("assessed"), "eligible", "candidates", F.when(F.col("eligible") > 0, "promoted").otherwise("filtered").alias("outcome"))


def judged(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates with their batched judge results (example, idx, decision, score, reasons); a missing one is a reject."""
    lost = F.col("r.idx").isNull()
    known = F.col("r.decision").isin("keep", "revise", "reject", "abstain")
    joined = candidates.alias("c").join(results.alias("r"), (F.col("c.example") == F.col("r.example")) & (F.col("c.idx") == F.col("r.idx")), "left")
    decision = F.when(lost | ~F.coalesce(known, F.lit(False)), "reject").otherwise(F.col("r.decision"))
    return joined.select("c.example", "c.idx", decision.alias("decision"), F.when(lost, 0).otherwise(F.col("r.score")).alias("score"), F.when(lost, "missing_batched_judge_result").otherwise(F.coalesce("r.reasons", F.lit(""))).alias("reasons"))
