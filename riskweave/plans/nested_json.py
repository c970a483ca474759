"""Queries of nested JSON: events wrapped in objects and arrays, with what a detector must not see at some depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import nested
from riskweave.sources.tables import read

NAMES_OF = {"error": "bbox", "purchase": "final_report", "signup": "props"}


def prohibited_paths(spark, sf):
    """Keys and phrases that must not be seen, with their paths, in events' properties nested three deep."""
    e = read(spark, sf, "events")
    kind = F.col("event_type")
    name = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in NAMES_OF.items()), kind)
    note = F.when(F.col("value") > 60, F.concat(F.lit("Page of the Raw OCR, "), kind)).when(F.col("value") < 5, "Nothing but a final  report.").otherwise(kind)
    inner = F.concat(F.lit('[{"props":'), "props", F.lit(',"note":'), F.to_json(F.struct(note.alias("n"))), F.lit("},null]"))
    doc = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"log":{"'), name, F.lit('":'), inner, F.lit("}}"))
    return nested.prohibited(e.select("event_id", doc.alias("doc")), "event_id", "doc")


NAMES = ["prohibited_paths"]
QUERIES = {name: globals()[name] for name in NAMES}
_NAME = f"CASE event_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in NAMES_OF.items())} ELSE event_type END"
SQL = {
    "prohibited_paths": f"""WITH e AS (SELECT event_id, value, {_NAME} AS name FROM events)
SELECT event_id, '$.log.' || name AS path, 'prohibited_key' AS code FROM e WHERE name IN ('bbox', 'final_report')
UNION ALL SELECT event_id, '$.log.' || name || '[0].note.n', 'prohibited_phrase' FROM e WHERE value > 60""",
}
