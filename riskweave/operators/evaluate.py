"""Classification metrics over gold and predicted labels: confusion, per-class scores, rates and gates.

Rates are basis points, rounded half up on integers; null where their base is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def rate_bp(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN ({part} * 20000 + {whole}) div (2 * {whole}) END")


def class_metrics(pairs: DataFrame, labels: list, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Per label of a fixed list: true and false positives, false negatives, precision, recall and F1."""
    one = F.explode(F.array(*map(F.lit, labels))).alias("label")
    counted = pairs.groupBy(gold, predicted).agg(F.count("*").alias("n")).select("*", one)
    is_gold, is_predicted = F.col(gold) == F.col("label"), F.col(predicted) == F.col("label")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    sums = counted.groupBy("label").agg(total(is_gold & is_predicted).alias("tp"), total(~is_gold & is_predicted).alias("fp"), total(is_gold & ~is_predicted).alias("fn"))
    return sums.select("*", rate_bp("tp", "(tp + fp)").alias("precision_bp"), rate_bp("tp", "(tp + fn)").alias("recall_bp"), rate_bp("(2 * tp)", "(2 * tp + fp + fn)").alias("f1_bp"))
