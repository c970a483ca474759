"""Queries of runs, caches and navigation: users are runs, events their log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import workflow
from riskweave.sources.tables import read

KINDS = {"signup": "start", "view": "complete_stage", "click": "complete_stage", "purchase": "reset", "error": "fail"}


def _log(spark, sf) -> DataFrame:
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()))
    return read(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.when((F.col("event_type") == "error") & (F.col("value") < 10), "cancel").when((F.col("event_type") == "error") & (F.col("value") > 80), "complete").otherwise(kind).alias("kind"))


def run_states(spark, sf):
    return workflow.run_states(_log(spark, sf))


def lifecycle_violations(spark, sf):
    """Invariants of run states, against the events' own last word."""
    states = workflow.run_states(_log(spark, sf))
    last = read(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.max_by("event_type", "event_id").alias("t"))
    told = states.join(last, "run").withColumn("status", F.when(F.col("t") == "purchase", "completed").when(F.col("t") == "signup", "created").otherwise(F.col("status")))
    return workflow.lifecycle_violations(told)


def _roles(spark, sf) -> DataFrame:
    spot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    c = F.col
    rows = read(spark, sf, "lineitem").withColumn("role", spot).where("role < 2")
    o = read(spark, sf, "orders").select(c("o_orderkey").alias("l_orderkey"), (c("o_orderstatus") != "P").alias("confirmed"))
    return rows.join(o, "l_orderkey").select(c("l_orderkey").alias("run"), "role", "confirmed", (c("l_discount") > 0.005).alias("safe"), (c("l_partkey") % 3 > 0).alias("hit"), (c("l_suppkey") % 5 == 0).alias("blocked"), (c("l_returnflag") == "R").alias("stale"), (c("l_returnflag") == "N").alias("raw"))


def cache_decisions(spark, sf):
    return workflow.cache_outcomes(_roles(spark, sf))


def cache_lookup(spark, sf):
    """Customers' wanted records by segment, nation and a part that may be null."""
    part = lambda c: F.when(F.col(c) > 0, F.lit("positive"))
    wanted = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), part("c_acctbal").alias("balance"))
    records = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), part("s_acctbal").alias("balance"), F.col("s_suppkey").alias("record"), F.round(F.col("s_acctbal") * 100).cast("long").alias("created"), (F.col("s_suppkey") % 7 > 0).alias("valid"))
    return workflow.looked_up(wanted, records, ["nation", "balance"]).select("c_custkey", "record")


def pair_completeness(spark, sf):
    """Runs by how many of both roles hit."""
    return _roles(spark, sf).groupBy("run").agg(F.count_if("hit").alias("hits")).groupBy("hits").agg(F.count("*").alias("runs"))


def audit_log(spark, sf):
    """Every event with its place in the run's log and the kind before it."""
    a = workflow.audited(_log(spark, sf), "run", "seq")
    return a.select("run", "seq", "sequence", F.lag("kind").over(Window.partitionBy("run").orderBy("seq")).alias("before"))


def body_verification(spark, sf):
    """Stored texts against the digests and sizes that their records keep; some records are of an older text."""
    d = read(spark, sf, "documents")
    kept = F.when(F.col("n_chars") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    rows = d.select("doc_id", F.when(F.col("n_chars") % 7 > 0, F.col("text")).alias("body"), F.sha2(kept, 256).alias("digest"), F.octet_length("text").alias("size"))
    return rows.groupBy(workflow.verified(rows, "body", "digest", "size").alias("state")).agg(F.count("*").alias("n"))


def artifact_counts(spark, sf):
    """Expected events of a kind (the greatest expectation) against those that are there."""
    e = read(spark, sf, "events")
    expected = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("kind"), (F.floor("value") % 4).cast("int").alias("n"))
    return workflow.artifact_gaps(expected, e.where("value > 20").select(F.col("user_id").alias("run"), F.col("event_type").alias("kind")))


def audit_bundles(spark, sf):
    """A run's state, log size and artifacts as one row."""
    states, log = workflow.run_states(_log(spark, sf)), _log(spark, sf)
    sizes = log.groupBy("run").agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    gaps = artifact_counts(spark, sf).groupBy("run").agg(F.sum("missing").cast("long").alias("missing"))
    return states.join(sizes, "run", "left").join(gaps, "run", "left").select("run", "status", "done", "events", "kinds", "missing")


def ocr_navigation(spark, sf):
    """Order totals found in lines by value and label: one match, primary ones first, else none or ambiguous."""
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_quantity").cast("int").alias("value"), (F.col("l_linestatus") == "F").alias("primary"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("at"))
    wanted = read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 97 + 1).alias("label"), F.col("p_size").alias("value"))
    f = wanted.join(rows, ["label", "value"], "left").groupBy("p_partkey").agg(F.count("at").alias("n"), F.count_if("primary").alias("np"), F.min("at").alias("a"), F.min(F.when(F.col("primary"), F.col("at"))).alias("ap"))
    state = F.when(F.col("n") == 0, "none").when((F.col("np") == 1) | ((F.col("np") == 0) & (F.col("n") == 1)), "unique").otherwise("ambiguous")
    return f.select("p_partkey", state.alias("state"), F.when(state == "unique", F.coalesce("ap", "a")).alias("at"))


def source_bound_evidence(spark, sf):
    """Lines that are evidence of their order: same source, a text, a page, an allowed kind, not superseded."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus"))
    rows = read(spark, sf, "lineitem").join(o, "l_orderkey")
    bound = (F.col("l_linestatus") == F.col("o_orderstatus")) & (F.col("l_quantity") > 1) & (F.col("l_partkey") > 0) & F.col("l_returnflag").isin("A", "N", "R") & (F.col("l_tax") < 0.08)
    return rows.groupBy("l_orderkey").agg(F.count_if(bound).alias("bound"), F.count_if(~bound).alias("loose"))


def readiness_blockers(spark, sf):
    """Customers' records: one row for each thing that is missing, by whichever way it could be there."""
    orders = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("nf"))
    c = read(spark, sf, "customer").join(orders, "c_custkey", "left")
    rules = [("missing_orders", F.col("n").isNull()), ("missing_balance_or_final_order", (F.col("c_acctbal") <= 0) & (F.coalesce("nf", F.lit(0)) == 0)), ("missing_segment", ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"))]
    return c.select("c_custkey", F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in rules)))).alias("blocker"))


def terminal_status(spark, sf):
    """Orders' runs by their end: failed lines first, then waiting, then done."""
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") > 0.09).alias("failed"), F.count_if(F.col("l_linestatus") == "O").alias("waiting"))
    return g.groupBy(F.when(F.col("failed") > 0, "failed").when(F.col("waiting") > 0, "waiting").otherwise("packet_ready").alias("status")).agg(F.count("*").alias("n"))


def detector_modes(spark, sf):
    """Two registered detectors over the same packets, compared."""
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("flags"), F.max("l_quantity").cast("int").alias("most"))
    workflow.register("flags", lambda p: p.select("l_orderkey", F.when(F.col("flags") >= 2, "supported").when(F.col("flags") == 1, "weakly_supported").otherwise("insufficient_evidence").alias("level")))
    workflow.register("size", lambda p: p.select("l_orderkey", F.when(F.col("most") > 40, "supported").when(F.col("most") > 20, "weakly_supported").otherwise("insufficient_evidence").alias("level")))
    a, b = (workflow.detected(rows, m).withColumnRenamed("level", m) for m in ("flags", "size"))
    return a.join(b, "l_orderkey").groupBy("flags", "size").agg(F.count("*").alias("n"))


NAMES = "run_states lifecycle_violations cache_decisions cache_lookup pair_completeness audit_log body_verification artifact_counts audit_bundles ocr_navigation source_bound_evidence readiness_blockers terminal_status detector_modes".split()
QUERIES = {name: globals()[name] for name in NAMES}

_ST = f"""WITH g AS (SELECT user_id AS run, event_id AS seq, CASE WHEN event_type = 'error' AND value < 10 THEN 'cancel' WHEN event_type = 'error' AND value > 80 THEN 'complete' ELSE CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END END AS kind FROM events),
r AS (SELECT run, coalesce(max(CASE WHEN kind = 'reset' THEN seq END), -1) AS reset FROM g GROUP BY 1),
a AS (SELECT g.*, reset FROM g JOIN r ON r.run = g.run WHERE seq > reset OR kind = 'reset'),
e AS (SELECT run, min(seq) AS ending FROM a WHERE kind IN ('fail', 'cancel', 'complete') GROUP BY 1),
c AS (SELECT a.run, max(a.reset) AS reset, max(CASE WHEN seq = ending THEN kind END) AS ended, count(*) FILTER (WHERE kind = 'start') AS starts, count(*) FILTER (WHERE kind = 'complete_stage' AND (ending IS NULL OR seq < ending)) AS steps FROM a LEFT JOIN e ON e.run = a.run GROUP BY 1),
d AS (SELECT *, CAST(least(8, CASE WHEN reset >= 0 THEN 2 ELSE 0 END + steps) AS INTEGER) AS done FROM c),
states AS (SELECT run, CASE WHEN ended = 'fail' THEN 'failed' WHEN ended = 'cancel' THEN 'cancelled' WHEN ended = 'complete' OR done = 8 THEN 'completed' WHEN reset >= 0 AND steps = 0 THEN 'awaiting_confirmation' WHEN starts > 0 OR steps > 0 THEN 'running' ELSE 'created' END AS status, done, ['{"', '".join(workflow.STAGES)}'][done + 1] AS stage FROM d)"""
_RL = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS role FROM lineitem),
k AS (SELECT l_orderkey AS run, role, o_orderstatus <> 'P' AS confirmed, l_partkey % 3 > 0 AS hit, CASE WHEN NOT l_discount > 0.005 THEN 'unsafe' WHEN l_partkey % 3 > 0 THEN 'hit' WHEN l_suppkey % 5 = 0 THEN 'blocked' WHEN l_returnflag = 'R' THEN 'stale' WHEN l_returnflag = 'N' THEN 'raw' ELSE 'none' END AS kind FROM l JOIN orders ON o_orderkey = l_orderkey WHERE role < 2)"""
_ART = "WITH x AS (SELECT user_id AS run, event_type AS kind, max(CAST(floor(value) AS INTEGER) % 4) AS expected, count(*) FILTER (WHERE value > 20) AS actual FROM events GROUP BY 1, 2)"

SQL = {
    "run_states": f"{_ST} SELECT * FROM states",
    "lifecycle_violations": f"{_ST}, t AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), w AS (SELECT run, CASE t WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'created' ELSE status END AS status, done, stage FROM states JOIN t ON user_id = run) SELECT run, 'completed_with_open_stage' AS code FROM w WHERE status = 'completed' AND stage IS NOT NULL UNION ALL SELECT run, 'created_with_done_stage' FROM w WHERE status = 'created' AND done > 0 UNION ALL SELECT run, 'failed_without_open_stage' FROM w WHERE status = 'failed' AND stage IS NULL",
    "cache_decisions": f"{_RL}, g AS (SELECT run, bool_and(confirmed) AS confirmed, count(*) AS n, arg_min(kind, role) FILTER (WHERE kind IN ('unsafe', 'blocked')) AS stop, coalesce(string_agg(CAST(role AS VARCHAR), ',' ORDER BY role) FILTER (WHERE kind = 'hit'), '') AS hit, coalesce(string_agg(CAST(role AS VARCHAR), ',' ORDER BY role) FILTER (WHERE kind = 'stale'), '') AS stale, coalesce(string_agg(CAST(role AS VARCHAR), ',' ORDER BY role) FILTER (WHERE kind = 'raw'), '') AS raw FROM k GROUP BY 1), o AS (SELECT *, CASE WHEN NOT confirmed THEN 'miss' WHEN n < 2 THEN 'incomplete_source_pair' WHEN stop = 'unsafe' THEN 'source_refresh_required' WHEN stop = 'blocked' THEN 'blocked' WHEN hit = '0,1' THEN 'report_memory_reusable' WHEN hit <> '' THEN 'incomplete_report_memory_pair' WHEN stale <> '' THEN 'stale_rebuild_required' WHEN raw <> '' THEN 'source_only' ELSE 'miss' END AS outcome FROM g) SELECT run, outcome, CASE outcome WHEN 'stale_rebuild_required' THEN stale WHEN 'source_only' THEN raw ELSE '' END AS roles FROM o",
    "cache_lookup": "WITH r AS (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN 'positive' END AS b, s_suppkey, row_number() OVER (PARTITION BY s_nationkey, CASE WHEN s_acctbal > 0 THEN 'positive' END ORDER BY CAST(round(s_acctbal * 100) AS BIGINT) DESC, s_suppkey DESC) AS n FROM supplier WHERE s_suppkey % 7 > 0) SELECT c_custkey, s_suppkey AS record FROM customer LEFT JOIN r ON n = 1 AND s_nationkey = c_nationkey AND b IS NOT DISTINCT FROM CASE WHEN c_acctbal > 0 THEN 'positive' END",
    "pair_completeness": f"{_RL}, g AS (SELECT run, count(*) FILTER (WHERE hit) AS hits FROM k GROUP BY 1) SELECT hits, count(*) AS runs FROM g GROUP BY 1",
    "audit_log": f"{_ST} SELECT run, seq, CAST(row_number() OVER (PARTITION BY run ORDER BY seq) AS INTEGER) AS sequence, lag(kind) OVER (PARTITION BY run ORDER BY seq) AS before FROM g",
    "body_verification": "SELECT CASE WHEN n_chars % 7 = 0 THEN 'unavailable' WHEN n_chars % 5 = 0 THEN 'mismatch' ELSE 'verified' END AS state, count(*) AS n FROM documents GROUP BY 1",
    "artifact_counts": f"{_ART} SELECT run, kind, CAST(expected AS BIGINT) AS expected, actual, CAST(greatest(0, expected - actual) AS BIGINT) AS missing FROM x",
    "audit_bundles": f"{_ST}, z AS (SELECT run, count(*) AS events, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM g GROUP BY 1), x AS (SELECT user_id AS run, event_type, max(CAST(floor(value) AS INTEGER) % 4) AS expected, count(*) FILTER (WHERE value > 20) AS actual FROM events GROUP BY 1, 2), m AS (SELECT run, CAST(sum(greatest(0, expected - actual)) AS BIGINT) AS missing FROM x GROUP BY 1) SELECT states.run, status, done, events, kinds, missing FROM states LEFT JOIN z ON z.run = states.run LEFT JOIN m ON m.run = states.run",
    "ocr_navigation": "WITH r AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS q, l_linestatus = 'F' AS p, l_orderkey || ':' || l_partkey AS spot FROM lineitem), f AS (SELECT p_partkey, count(spot) AS n, count(*) FILTER (WHERE p) AS np, min(spot) AS a, min(spot) FILTER (WHERE p) AS ap FROM part LEFT JOIN r ON l_suppkey = p_partkey % 97 + 1 AND q = p_size GROUP BY 1), s AS (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN np = 1 OR (np = 0 AND n = 1) THEN 'unique' ELSE 'ambiguous' END AS state FROM f) SELECT p_partkey, state, CASE WHEN state = 'unique' THEN coalesce(ap, a) END AS \"at\" FROM s",
    "source_bound_evidence": "WITH r AS (SELECT l_orderkey, l_linestatus = o_orderstatus AND l_quantity > 1 AND l_partkey > 0 AND l_returnflag IN ('A', 'N', 'R') AND l_tax < 0.08 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT l_orderkey, count(*) FILTER (WHERE b) AS bound, count(*) FILTER (WHERE NOT b) AS loose FROM r GROUP BY 1",
    "readiness_blockers": "WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS nf FROM orders GROUP BY 1), c AS (SELECT * FROM customer LEFT JOIN o ON o_custkey = c_custkey) SELECT c_custkey, 'missing_orders' AS blocker FROM c WHERE n IS NULL UNION ALL SELECT c_custkey, 'missing_balance_or_final_order' FROM c WHERE c_acctbal <= 0 AND coalesce(nf, 0) = 0 UNION ALL SELECT c_custkey, 'missing_segment' FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')",
    "terminal_status": "WITH g AS (SELECT bool_or(l_discount > 0.09) AS failed, bool_or(l_linestatus = 'O') AS waiting FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN failed THEN 'failed' WHEN waiting THEN 'waiting' ELSE 'packet_ready' END AS status, count(*) AS n FROM g GROUP BY 1",
    "detector_modes": "WITH p AS (SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS f, max(CAST(l_quantity AS INTEGER)) AS m FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN f >= 2 THEN 'supported' WHEN f = 1 THEN 'weakly_supported' ELSE 'insufficient_evidence' END AS flags, CASE WHEN m > 40 THEN 'supported' WHEN m > 20 THEN 'weakly_supported' ELSE 'insufficient_evidence' END AS size, count(*) AS n FROM p GROUP BY 1, 2",
}
