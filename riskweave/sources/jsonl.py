"""JSON lines: scans with line numbers and errors as rows, sinks with sorted keys, releases of splits with sidecars."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskweave.operators.dataset import leaked

SIDECARS = ("manifest.json", "metrics.json", "filtered.jsonl")


def _ddl(schema: StructType | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def scan(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON-lines path; blank lines are skipped, and a broken line is a row with ``_corrupt_record``."""
    return spark.read.schema(f"{_ddl(schema)}, _corrupt_record string").json(path)


def scan_numbered(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """``scan`` with ``_file`` and ``_line`` (from 1, blank lines counted): places are counted in each block of a file, and
    offset by the lines of the blocks before, so that large files are read by many tasks."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    counts = rows.groupBy("_file", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("_file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = rows.join(offsets, ["_file", "__block"]).withColumn("_line", F.col("__before") + F.row_number().over(Window.partitionBy("_file", "__block").orderBy("__at")))
    parsed = F.from_json("value", f"{_ddl(schema)}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return placed.where(F.trim("value") != "").select("_file", "_line", parsed.alias("r")).select("_file", "_line", "r.*")


def document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def sorted_json(rows: DataFrame) -> DataFrame:
    """One column ``value``: every row as JSON with its keys sorted and nulls left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    sorted_json(rows).write.mode("overwrite").text(path)


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, name: str, text: str) -> None:
    at, files = _path(spark, name)
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_release(rows: DataFrame, split: str, path: str, value: str | None = None) -> DataFrame:
    """A folder of JSON lines for every split, ``filtered.jsonl`` (rows without a split), and as JSON the manifest, the
    metrics and, of ``value``, the leakage between splits; returns the manifest (split, n, checksum of its lines)."""
    spark = rows.sparkSession
    line = F.to_json(F.struct(*sorted(rows.columns)))
    made = rows.select(split, line.alias("value"))
    made.where(F.col(split).isNotNull()).write.mode("overwrite").partitionBy(split).text(f"{path}/data")
    made.where(F.col(split).isNull()).select("value").write.mode("overwrite").text(f"{path}/filtered.jsonl")
    manifest = made.where(F.col(split).isNotNull()).groupBy(split).agg(F.count("*").alias("n"), F.sum(F.crc32(F.encode("value", "UTF-8"))).alias("checksum"))
    known = {r[split]: {"n": r["n"], "checksum": r["checksum"]} for r in manifest.collect()}  # one row for each split
    leaks = leaked(rows.where(F.col(split).isNotNull()), value, split).count() if value else None
    _put(spark, f"{path}/manifest.json", json.dumps({"splits": known}, sort_keys=True))
    _put(spark, f"{path}/metrics.json", json.dumps({"rows": sum(v["n"] for v in known.values()), "splits": len(known)}, sort_keys=True))
    _put(spark, f"{path}/leakage_report.json", json.dumps({"values_in_several_splits": leaks}, sort_keys=True))
    return manifest


def read_release(spark: SparkSession, paths: list[str], schema: StructType | str, splits: list[str] | None = None) -> DataFrame:
    """The wanted splits of several releases, with ``split`` and ``release``; a release without one of its sidecars, or
    whose manifest lacks a wanted split, is an error."""
    out = None
    for path in paths:
        lost = [s for s in SIDECARS if not (lambda at, files: files.exists(at))(*_path(spark, f"{path}/{s}"))]
        if lost:
            raise ValueError(f"{path} lacks {', '.join(lost)}")
        listed = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest.json").collect()))["splits"]
        if unknown := set(splits or []) - listed.keys():
            raise ValueError(f"{path} has no split {', '.join(sorted(unknown))}")
        for name in splits or sorted(listed):
            part = scan(spark, f"{path}/data/split={name}", schema).withColumns({"split": F.lit(name), "release": F.lit(path)})
            out = part if out is None else out.unionByName(part)
    return out
