"""Nested JSON as rows: every value of a document with its path, by recursive descent over VARIANT, and what mustn't occur in it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys and phrases that a detector must not see, at whatever depth.
KEYS = (
    "raw_ocr_text full_raw_ocr_text raw_tables raw_pdf_coordinates raw_pdf_path raw_pdf_text raw_coordinates coordinates bbox bounding_box cache_record_id cache_key source_file_sha256 "
    "normalized_text_hash table_content_hash derived_from_report_artifact_id derived_from_source_document_id hidden_injection_details injection_scenario injection_scenario_id target_support_level "
    "modified_evidence_ids original_values synthetic_values generation_seed teacher_model judge_model hidden_reasoning chain_of_thought hidden_chain_of_thought omitted_evidence_records "
    "omitted_evidence_ids omitted_evidence_summaries dropped_comparison_columns final_report final_report_text final_report_payload external_context outside_context outside_knowledge"
).split()
PHRASES = ("hidden injection", "omitted evidence", "raw ocr", "raw pdf", "final report")


def walked(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Every value in ``json`` (text): ``key``, path (``$`` the whole, ``.name`` in objects, ``[i]`` in arrays), name (null in
    arrays), text (of a string, else null).

    What isn't JSON has no rows.  A level of nesting is a step of a recursive query over VARIANT; this session's limits of the
    rows and levels of such queries are lifted, as both follow the data."""
    spark = rows.sparkSession
    for limit in ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"):
        spark.conf.set(limit, "-1")
    start = rows.select(F.col(key).alias("k"), F.try_parse_json(json).alias("v")).where("v is not null")
    steps = """
    WITH RECURSIVE walk(k, path, name, v) AS (
      SELECT k, '$', CAST(NULL AS STRING), v FROM {start}
      UNION ALL
      SELECT w.k, w.path || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END, e.key, e.value FROM walk w, LATERAL variant_explode(w.v) e)
    SELECT k, path, name, CASE WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') END AS text FROM walk"""
    return spark.sql(steps, start=start).withColumnRenamed("k", key)


def prohibited(rows: DataFrame, key: str, json: str) -> DataFrame:
    """``key``, path and code (prohibited_key, prohibited_phrase) of everything in ``json`` that a detector must not see.

    A key is compared as it is, a phrase is looked for in lower case; what is under a prohibited key is looked at, too."""
    w = walked(rows, key, json)
    low, says = F.lower("text"), F.lit(False)
    for phrase in PHRASES:
        says = says | low.contains(phrase)
    codes = F.array_compact(F.array(F.when(F.col("name").isin(*KEYS), "prohibited_key"), F.when(says, "prohibited_phrase")))
    return w.select(key, "path", F.explode(codes).alias("code"))


def renamed_values(json: Column, names: dict[str, str]) -> Column:
    """JSON whose string values equal to a name of ``names`` are renamed, at whatever depth; keys and longer texts stay.

    A quote within a string is escaped, so that a name between two bare quotes is a whole string; one before a colon is a key."""
    for old, new in names.items():
        json = F.regexp_replace(json, f'"{re.escape(old)}"(?!\\s*:)', f'"{new}"')
    return json
