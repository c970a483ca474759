"""Evidence, integrity, ranking and workflow queries over order lines, events, parts, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import checks, integrity, ranking
from riskweave.sources import keyed
from riskweave.sources.tables import read


def packet_cap_trim(spark, sf):
    """The first four lines of every order, largest price first, in a packet."""
    lines = ranking.split_at_cap(read(spark, sf, "lineitem"), ["l_orderkey"], 4, F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))
    return lines.where("kept").select("l_orderkey", "l_linenumber", "ordinal")


def packet_cap_omitted(spark, sf):
    lines = ranking.split_at_cap(read(spark, sf, "lineitem"), ["l_orderkey"], 4, F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))
    return lines.where("not kept").groupBy("l_orderkey").agg(F.count("*").alias("omitted"), F.min("ordinal").alias("first_omitted"))


def evidence_dedupe_keep_first(spark, sf):
    """References (part, supplier) of an order by role: the first line of each stays."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", "l_linenumber", "l_partkey")
    return ranking.best(rows, ["l_orderkey", "l_returnflag"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))


def group_by_first_link(spark, sf):
    """Orders grouped by the part of their first line, with the order where each group first appears."""
    first = ranking.best(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"))
    return first.groupBy("l_partkey").agg(F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order"))


def ordered_distinct_list(spark, sf):
    """Event types of every user in the order first seen."""
    first = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("l"))
    return listed.select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ">").alias("types"))


def ref_integrity_violations(spark, sf):
    """Lines whose order isn't among the visible ones (urgent orders are hidden)."""
    visible = read(spark, sf, "orders").where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return integrity.unresolved(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), visible, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


def missing_extra_keys(spark, sf):
    """Suppliers of lines against suppliers of parts' sizes: keys that one side alone has."""
    cited = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"))
    known = read(spark, sf, "part").select((F.col("p_size") * 2).cast("long").alias("key"))
    return integrity.key_difference(cited, known, ["key"])


def required_field_violations(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    rules = [("value_low", F.col("value") < 5), ("key_missing", k.isNull()), ("key_high", k > 95), ("error_event", F.col("event_type") == "error")]
    return integrity.violations(read(spark, sf, "events"), ["event_id"], rules)


def reason_histogram(spark, sf):
    return required_field_violations(spark, sf).groupBy("code").agg(F.count("*").alias("n"))


def manifest_reconcile(spark, sf):
    """Orders by year and status against a manifest that counts only those with lines."""
    orders = read(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderkey")
    count = lambda d: d.groupBy("y", "o_orderstatus").agg(F.count("*").alias("n"))
    with_lines = orders.join(read(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return integrity.reconcile(count(orders), count(with_lines), ["y", "o_orderstatus"], "n")


def best_of_n(spark, sf):
    """The best line of every order by quantity, then discount in percent, then lowest line number."""
    rank = F.struct(F.col("l_quantity"), F.round(F.col("l_discount") * 100).cast("long"), -F.col("l_linenumber"), -F.col("l_partkey"))
    best = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", "l_partkey"), rank).alias("b"), F.count("*").alias("candidates"))
    return best.select("l_orderkey", "b.l_linenumber", "b.l_partkey", "candidates")


def sweep_rank(spark, sf):
    balance = checks.cents(F.col("s_acctbal"))
    spot = Window.partitionBy("s_nationkey").orderBy(F.desc(balance), F.desc(F.col("s_suppkey") % 3), "s_suppkey")
    return read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.row_number().over(spot).alias("rank"))


def upserted_records(spark, sf):
    """A user's latest event of a kind, kept in a table by identity: an earlier part of the events first, then the rest."""
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    at = keyed.folder(spark, "records")
    for part in (e.where("cents >= 2000"), e.where("cents < 2000 and event_type <> 'signup'"), e.where("cents < 2000 and event_type = 'signup'")):
        keyed.upsert(part, at, ["user_id", "event_type"], ["event_id"], buckets=16)
    return keyed.read(spark, at)


def latest_per_identity(spark, sf):
    latest = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.count("*").alias("versions"))
    return latest.select("user_id", "event_type", "event_id", "versions")


def interleave_round_robin(spark, sf):
    """Nations' suppliers in turns: whose turn, and the place in the whole order."""
    turns = ranking.interleaved(read(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", F.col("s_suppkey"))
    return turns.select("s_nationkey", "s_suppkey", "turn", "place")


def scenario_cross(spark, sf):
    """Every region with every nation, ordered like a Latin square."""
    regions, nations = read(spark, sf, "region").select("r_regionkey"), read(spark, sf, "nation").select("n_nationkey")
    crossed = regions.crossJoin(ranking.bounded(nations, 10_000))
    return crossed.select("r_regionkey", "n_nationkey", F.pmod(F.col("n_nationkey") - F.col("r_regionkey"), F.lit(4)).cast("int").alias("turn"))


def matched_pairs_complete(spark, sf):
    """Orders whose returned and other lines form a complete pair of exactly two."""
    flags = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return flags.where("n = 2 and returned = 1").select("l_orderkey")


def number_parse(spark, sf):
    """Prices written as (1.234,50) and read back: parentheses are negative, dots group, a comma is decimal."""
    price = checks.cents(F.col("p_retailprice"))
    shown = F.concat(F.lit("("), F.floor(price / 100000).cast("long").cast("string"), F.lit("."), F.lpad((F.floor(price / 100).cast("long") % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((price % 100).cast("string"), 2, "0"), F.lit(")"))
    digits = F.regexp_replace(shown, "[^0-9]", "").cast("long")
    return read(spark, sf, "part").select("p_partkey", shown.alias("shown"), F.when(shown.startswith("("), -digits).otherwise(digits).alias("minor_units"))


def account_classify(spark, sf):
    kind = F.lower("p_type")
    label = checks.first_failing((kind.contains("promo"), "promotion"), (kind.contains("steel"), "metal"), (kind.contains("brass") | kind.contains("copper"), "alloy"), (F.col("p_size") > 25, "large"), default="other")
    return read(spark, sf, "part").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def basis_family_match(spark, sf):
    family = F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "consumer").when(F.col("c_mktsegment") == "AUTOMOBILE", "vehicle").otherwise("industry")
    rows = read(spark, sf, "customer").select("c_nationkey", family.alias("family"))
    return rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_if(F.col("family") == "industry").alias("n_industry"))


def suffix_repair(spark, sf):
    """References that lack their prefix, repaired where exactly one visible id ends with them: an equi-join on the suffix."""
    local = lambda part, number: F.concat_ws("-", F.col(part).cast("string"), F.col(number).cast("string"))
    lines = read(spark, sf, "lineitem")
    visible = lines.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), local("l_partkey", "l_linenumber")).alias("full"), local("l_partkey", "l_linenumber").alias("suffix"))
    refs = read(spark, sf, "part").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(local("p_partkey", "n").alias("suffix"))
    found = refs.join(visible.distinct(), "suffix", "left").groupBy("suffix").agg(F.count("full").alias("n"), F.min("full").alias("full"))
    return found.select("suffix", checks.first_failing((F.col("n") == 0, "missing"), (F.col("n") > 1, "ambiguous"), default="repaired").alias("status"), F.when(F.col("n") == 1, F.col("full")).alias("repaired"))


def note_match_cardinality(spark, sf):
    """Customers whose largest order status group matches exactly one order."""
    counted = read(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(counted, "o_custkey", "left")
    return out.select("o_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), checks.first_failing((F.col("n").isNull(), "none"), (F.col("n") == 1, "unique"), default="ambiguous").alias("status"))


def json_canonical_hash(spark, sf):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf, "events").select("event_id", F.sha2(F.concat(F.lit('{"event":"'), F.col("event_type"), F.lit('","k":'), F.coalesce(k, F.lit("null")), F.lit("}")), 256).alias("hash"))


def stage_machine_state(spark, sf):
    """Users as runs, event types as stages: latest state, stages done, and the first one that is open."""
    seen = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"), F.max_by("event_type", "event_id").alias("latest"), F.count_if(F.col("event_type") == "error").alias("errors"))
    order = ["signup", "view", "click", "purchase"]
    open_stage = F.coalesce(*(F.when(~F.array_contains("s", x), F.lit(x)) for x in order), F.lit("complete"))
    return seen.select("user_id", "latest", "errors", open_stage.alias("next_stage"))


def cache_outcome(spark, sf):
    """Per user an ordered decision: an error after the last purchase invalidates, a purchase hits, anything else misses."""
    last = lambda t: F.max(F.when(F.col("event_type") == t, F.col("event_id")))
    out = read(spark, sf, "events").groupBy("user_id").agg(last("purchase").alias("bought"), last("error").alias("failed"))
    status = checks.first_failing((F.col("bought").isNull(), "miss"), (F.col("failed") > F.col("bought"), "invalidated"), default="hit")
    return out.groupBy(status.alias("outcome")).agg(F.count("*").alias("n"))


def limitation_dedupe(spark, sf):
    rows = read(spark, sf, "events").where("event_type in ('error', 'view')").select(F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("limitation"), "event_id")
    return rows.groupBy("limitation").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


def period_clues(spark, sf):
    text = F.concat(F.lit("Report Q"), F.quarter("o_orderdate").cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(" status "), F.col("o_orderstatus"))
    period = F.concat(F.regexp_extract(text, r"Q([1-4])/(\d{4})", 2), F.lit("-Q"), F.regexp_extract(text, r"Q([1-4])/(\d{4})", 1))
    return read(spark, sf, "orders").select(period.alias("period"), "o_orderkey").groupBy("period").agg(F.count("*").alias("n"))


NAMES = "packet_cap_trim packet_cap_omitted evidence_dedupe_keep_first group_by_first_link ordered_distinct_list ref_integrity_violations missing_extra_keys required_field_violations reason_histogram manifest_reconcile best_of_n sweep_rank latest_per_identity upserted_records interleave_round_robin scenario_cross matched_pairs_complete number_parse account_classify basis_family_match suffix_repair note_match_cardinality json_canonical_hash stage_machine_state cache_outcome limitation_dedupe period_clues".split()
QUERIES = {name: globals()[name] for name in NAMES}

_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
_RULES = f"SELECT event_id, 'value_low' AS code FROM events WHERE value < 5 UNION ALL SELECT event_id, 'key_missing' FROM events WHERE {_K} IS NULL UNION ALL SELECT event_id, 'key_high' FROM events WHERE {_K} > 95 UNION ALL SELECT event_id, 'error_event' FROM events WHERE event_type = 'error'"
_CAP = "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS INTEGER) AS ordinal FROM lineitem"

SQL = {
    "packet_cap_trim": f"SELECT * FROM ({_CAP}) WHERE ordinal <= 4",
    "packet_cap_omitted": f"SELECT l_orderkey, count(*) AS omitted, min(ordinal) AS first_omitted FROM ({_CAP}) WHERE ordinal > 4 GROUP BY l_orderkey",
    "evidence_dedupe_keep_first": "SELECT l_orderkey, l_returnflag, l_suppkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1",
    "group_by_first_link": "SELECT l_partkey, count(*) AS n_orders, min(l_orderkey) AS first_order FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1 GROUP BY l_partkey",
    "ordered_distinct_list": "SELECT user_id, string_agg(event_type, '>' ORDER BY a) AS types FROM (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY user_id, event_type) GROUP BY user_id",
    "ref_integrity_violations": "SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority <> '1-URGENT') GROUP BY l_orderkey",
    "missing_extra_keys": "WITH a AS (SELECT DISTINCT l_suppkey AS key FROM lineitem), b AS (SELECT DISTINCT CAST(p_size * 2 AS BIGINT) AS key FROM part) SELECT key, 'missing' AS side FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL SELECT key, 'extra' FROM (SELECT key FROM b EXCEPT SELECT key FROM a)",
    "required_field_violations": _RULES,
    "reason_histogram": f"SELECT code, count(*) AS n FROM ({_RULES}) GROUP BY code",
    "manifest_reconcile": "WITH o AS (SELECT year(o_orderdate) AS y, o_orderstatus, o_orderkey FROM orders), e AS (SELECT y, o_orderstatus, count(*) AS expected FROM o GROUP BY y, o_orderstatus), a AS (SELECT y, o_orderstatus, count(*) AS actual FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) GROUP BY y, o_orderstatus) SELECT e.y, e.o_orderstatus, expected, actual FROM e LEFT JOIN a ON e.y = a.y AND e.o_orderstatus = a.o_orderstatus WHERE actual IS NULL OR actual <> expected",
    "best_of_n": "SELECT l_orderkey, l_linenumber, l_partkey, c AS candidates FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, CAST(round(l_discount * 100) AS BIGINT) DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1",
    "sweep_rank": "SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(round(s_acctbal * 100) AS BIGINT) DESC, s_suppkey % 3 DESC, s_suppkey) AS INTEGER) AS rank FROM supplier",
    "upserted_records": "SELECT user_id, event_type, max(event_id) AS event_id, CAST(round(arg_max(value, event_id) * 100) AS BIGINT) AS cents FROM events GROUP BY user_id, event_type",
    "latest_per_identity": "SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS versions FROM events GROUP BY user_id, event_type",
    "interleave_round_robin": "WITH t AS (SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS turn FROM supplier) SELECT *, row_number() OVER (ORDER BY turn, s_nationkey) AS place FROM t",
    "scenario_cross": "SELECT r_regionkey, n_nationkey, CAST(((n_nationkey - r_regionkey) % 4 + 4) % 4 AS INTEGER) AS turn FROM region CROSS JOIN nation",
    "matched_pairs_complete": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1",
    "number_parse": "WITH p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part) SELECT p_partkey, '(' || CAST(c // 100000 AS VARCHAR) || '.' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ')' AS shown, -c AS minor_units FROM p",
    "account_classify": "SELECT CASE WHEN lower(p_type) LIKE '%promo%' THEN 'promotion' WHEN lower(p_type) LIKE '%steel%' THEN 'metal' WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%copper%' THEN 'alloy' WHEN p_size > 25 THEN 'large' ELSE 'other' END AS label, count(*) AS n FROM part GROUP BY 1",
    "basis_family_match": "WITH f AS (SELECT c_nationkey, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'consumer' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'vehicle' ELSE 'industry' END AS family FROM customer) SELECT c_nationkey, string_agg(DISTINCT family, ',' ORDER BY family) AS families, CAST(sum(CASE WHEN family = 'industry' THEN 1 ELSE 0 END) AS BIGINT) AS n_industry FROM f GROUP BY c_nationkey",
    "suffix_repair": "WITH v AS (SELECT DISTINCT l_orderkey || ':' || l_partkey || '-' || l_linenumber AS f, l_partkey || '-' || l_linenumber AS suffix FROM lineitem), p AS (SELECT p_partkey || '-' || n AS ref FROM part CROSS JOIN range(1, 4) r(n)), m AS (SELECT ref AS suffix, count(f) AS n, min(f) AS f FROM p LEFT JOIN v ON v.suffix = ref GROUP BY 1) SELECT suffix, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'repaired' END AS status, CASE WHEN n = 1 THEN f END AS repaired FROM m",
    "note_match_cardinality": "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) SELECT c_custkey AS o_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM customer LEFT JOIN n ON o_custkey = c_custkey",
    "json_canonical_hash": "SELECT event_id, sha256('{\"event\":\"' || event_type || '\",\"k\":' || coalesce(json_extract_string(props, '$.k'), 'null') || '}') AS hash FROM events",
    "stage_machine_state": "WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS latest, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS a, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS b, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS c, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS d FROM events GROUP BY user_id) SELECT user_id, latest, errors, CASE WHEN a = 0 THEN 'signup' WHEN b = 0 THEN 'view' WHEN c = 0 THEN 'click' WHEN d = 0 THEN 'purchase' ELSE 'complete' END AS next_stage FROM s",
    "cache_outcome": "WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS bought, max(CASE WHEN event_type = 'error' THEN event_id END) AS failed FROM events GROUP BY user_id) SELECT CASE WHEN bought IS NULL THEN 'miss' WHEN failed > bought THEN 'invalidated' ELSE 'hit' END AS outcome, count(*) AS n FROM s GROUP BY 1",
    "limitation_dedupe": "SELECT event_type || ':' || json_extract_string(props, '$.k') AS limitation, min(event_id) AS first_event, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1",
    "period_clues": "SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, count(*) AS n FROM orders GROUP BY 1",
}
