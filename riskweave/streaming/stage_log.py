"""Stage logs as streams: state per run from its events, with late events dropped by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from riskweave.operators.workflow import RESET_TO, STAGES, STATUS_AT_END


def read_events(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and errors by window and type; a window closes when the watermark passes it."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


def run_state(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per run (user): latest event, number of events and errors, for a sink in update mode."""
    return events.withWatermark("ts", late).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("latest"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of which each id counts once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


class RunProcessor(StatefulProcessor):
    """A run's state from its events: what was reset, started, completed and how it ended, as ``workflow.run_states`` has it.

    Events of a run come in the order of ``seq`` over the batches; within a batch they may come in any order."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "resets int, starts int, steps int, ended string")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        resets, starts, steps, ended = self.state.get() if self.state.exists() else (0, 0, 0, None)
        for row in sorted(rows, key=lambda r: r["seq"]):
            kind = row["kind"]
            if kind == "reset":
                resets, starts, steps, ended = resets + 1, 0, 0, None
            elif kind == "start":
                starts += 1
            elif ended is None and kind in STATUS_AT_END:
                ended = kind
            elif ended is None and kind == "complete_stage":
                steps += 1
        self.state.update((resets, starts, steps, ended))
        done = min(len(STAGES), (RESET_TO if resets else 0) + steps)
        waits = "awaiting_confirmation" if resets and not steps else "running" if starts or steps else "created"
        status = STATUS_AT_END[ended] if ended else "completed" if done == len(STAGES) else waits
        yield Row(run=key[0], status=status, done=done, stage=STAGES[done] if done < len(STAGES) else None)

    def close(self) -> None:
        pass


def run_states(log: DataFrame) -> DataFrame:
    """A log (run, seq, kind) as a stream of (run, status, done, stage), for a sink in update mode: the state of every run that
    a batch has events of.  State lives in the query's state store (RocksDB) and comes back from its checkpoint."""
    kind = dict(log.dtypes)["run"]
    schema = f"run {kind}, status string, done int, stage string"
    return log.select("run", "seq", "kind").groupBy("run").transformWithState(statefulProcessor=RunProcessor(), outputStructType=schema, outputMode="Update", timeMode="None")
