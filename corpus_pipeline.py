"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontamination, jaccard_join, line_dedup, packing, store, toxicity
from riskweave.llm.queries import table, vocabulary

REJECTED = 0.7


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from the labels' learnable rows, stays below ``REJECTED``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where(scored[scored.columns[-2]] < REJECTED).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeated runs; ``n_chars`` follows; documents that lose all their lines go."""
    done = line_dedup.dedup_lines(docs)
    left, gone = (F.col(f"`{c}`") for c in done.columns[-2:])
    kept = done.where((left > gone) | (gone == 0))
    size = F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest key of every component of near copies.

    Rows without a key stay; of rows of one key all different texts stay, equal texts once."""
    linked = jaccard_join.join(docs)
    first = linked.where("doc_id = component_id").select("doc_id").distinct()
    mark = store.fresh(docs, "__text")
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn(mark, F.xxhash64("text"))
    once = kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return once.unionByName(docs.where("doc_id is null"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a row without a key goes by its text."""
    mark = store.fresh(docs, "__key")
    keyed = docs.withColumn(mark, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)), F.lit("")))
    found = decontamination.find_leaks(keyed, table(spark, sf_dir, "benchmark"), key=mark)
    hit = store.written(found.select(mark).distinct(), "leaks")
    return keyed.join(hit, mark, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of ``packing.WINDOW`` tokens."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", leaks),
    ("packing", packed),
]

#: Models, tokenizers and retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return docs
