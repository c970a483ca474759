"""Runs as logs: status after resets and ends, cache decisions over roles in order, lookups by identity, audit sequences.

Everything follows from windows and aggregates over the log, so that a run's state needs no state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.checks import first_failing

# The stages of a run, in order; a reset goes back to the third.
STAGES = ("intake", "source_confirmation", "cache_lookup", "extraction", "tools", "detector", "aggregation", "report")
RESET_TO = 2
# The status that an end leaves.
STATUS_AT_END = {"fail": "failed", "cancel": "cancelled", "complete": "completed"}


def run_states(log: DataFrame) -> DataFrame:
    """(run, status, done, stage): log has run, seq and kind (start, complete_stage, fail, cancel, complete, reset).

    The last reset counts, then the first end after it; stages are completed one by one in between."""
    last = Window.partitionBy("run")
    of = lambda *kinds: F.col("kind").isin(*kinds)
    after = log.withColumn("reset", F.coalesce(F.max(F.when(of("reset"), F.col("seq"))).over(last), F.lit(-1))).where("seq > reset or kind = 'reset'")
    ended = after.withColumn("end", F.min(F.when(of("fail", "cancel", "complete"), F.col("seq"))).over(last))
    g = ended.groupBy("run").agg(
        F.max("reset").alias("reset"), F.min(F.when(F.col("seq") == F.col("end"), F.col("kind"))).alias("ended"), F.count_if(of("start")).alias("starts"),
        F.count_if(of("complete_stage") & (F.col("end").isNull() | (F.col("seq") < F.col("end")))).alias("steps"),
    )
    done = F.least(F.lit(len(STAGES)), F.when(F.col("reset") >= 0, RESET_TO).otherwise(0) + F.col("steps")).cast("int")
    status = first_failing((F.col("ended") == "fail", "failed"), (F.col("ended") == "cancel", "cancelled"), ((F.col("ended") == "complete") | (done == len(STAGES)), "completed"), ((F.col("reset") >= 0) & (F.col("steps") == 0), "awaiting_confirmation"), ((F.col("starts") > 0) | (F.col("steps") > 0), "running"), default="created")
    return g.select("run", status.alias("status"), done.alias("done"), F.try_element_at(F.array(*map(F.lit, STAGES)), done + 1).alias("stage"))


def lifecycle_violations(states: DataFrame) -> DataFrame:
    """What a status forbids: completed runs with an open stage, created ones with a done stage, failed ones with none open."""
    rules = [("completed_with_open_stage", (F.col("status") == "completed") & F.col("stage").isNotNull()), ("created_with_done_stage", (F.col("status") == "created") & (F.col("done") > 0)), ("failed_without_open_stage", (F.col("status") == "failed") & F.col("stage").isNull())]
    return states.select("run", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))).alias("code"))


def cache_outcomes(roles: DataFrame) -> DataFrame:
    """(run, outcome, roles): roles has run, role (0: target, 1: prior year) and booleans confirmed, safe, hit, blocked,
    stale, raw, by which the first role that is unsafe or blocked ends the search."""
    kind = F.when(~F.col("safe"), "unsafe").when(F.col("hit"), "hit").when(F.col("blocked"), "blocked").when(F.col("stale"), "stale").when(F.col("raw"), "raw").otherwise("none")
    g = roles.withColumn("kind", kind).groupBy("run").agg(F.bool_and("confirmed").alias("confirmed"), F.countDistinct("role").alias("n"), F.min_by("kind", F.when(F.col("kind").isin("unsafe", "blocked"), F.col("role"))).alias("stop"), *(F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("role")))), ",").alias(k) for k in ("hit", "stale", "raw")))
    outcome = first_failing(
        (~F.col("confirmed"), "miss"), (F.col("n") < 2, "incomplete_source_pair"), (F.col("stop") == "unsafe", "source_refresh_required"), (F.col("stop") == "blocked", "blocked"), (F.col("hit") == "0,1", "report_memory_reusable"),
        (F.col("hit") != "", "incomplete_report_memory_pair"), (F.col("stale") != "", "stale_rebuild_required"), (F.col("raw") != "", "source_only"), default="miss",
    )
    g = g.withColumn("outcome", outcome)
    return g.select("run", "outcome", F.when(F.col("outcome") == "stale_rebuild_required", F.col("stale")).when(F.col("outcome") == "source_only", F.col("raw")).otherwise(F.lit("")).alias("roles"))


def looked_up(wanted: DataFrame, records: DataFrame, identity: list[str]) -> DataFrame:
    """``wanted`` with the latest valid record of the same identity (null parts are equal): ``record``, null for a miss.

    records has the identity, record, created and valid."""
    latest = records.where("valid").groupBy(*identity).agg(F.max_by("record", F.struct("created", "record")).alias("record"))
    w, r = wanted.alias("w"), latest.alias("r")
    same = None
    for c in identity:
        part = F.col(f"w.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = part if same is None else same & part
    return w.join(r, same, "left").select("w.*", "r.record")


def audited(log: DataFrame, run: str, *order: Column | str) -> DataFrame:
    """A log with ``sequence`` from 1 in each run."""
    return log.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def verified(bodies: DataFrame, body: str, digest: str, size: str) -> Column:
    """Whether a stored body is what its record says: ``verified``, ``mismatch``, or ``unavailable`` without one."""
    return F.when(F.col(body).isNull(), "unavailable").when((F.sha2(body, 256) == F.col(digest)) & (F.octet_length(body) == F.col(size)), "verified").otherwise("mismatch")


def artifact_gaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(run, kind, expected, actual, missing): of several expectations of a kind the greatest."""
    e = expected.groupBy("run", "kind").agg(F.max("n").alias("expected"))
    a = actual.groupBy("run", "kind").agg(F.count("*").alias("actual"))
    out = e.join(a, ["run", "kind"], "full_outer").select("run", "kind", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "actual")))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("actual")).cast("long"))


#: Detectors by mode: functions from packets to assessments; ``register`` adds one, in Python by batches or in expressions.
MODES: dict[str, object] = {}


def register(mode: str, detector) -> None:
    MODES[mode] = detector


def detected(packets: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"no detector mode {mode!r}; known: {sorted(MODES)}")
    return MODES[mode](packets)
