"""Queries of dataset building, the label gate and evaluation: documents are records, lines are judged candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import dialects
from riskweave.operators import dataset, evaluate, gate, integrity, nested, ranking, splits
from riskweave.plans import records
from riskweave.sources.tables import dealt, read

SHARES = [("train", 70), ("validation", 15), ("test", 10), ("holdout", 10)]


def identity_sets(spark, sf):
    """Identities of every document: its text, its source with its language, and its label's pair where there is one."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    tag = F.when(F.col("quality").isNotNull(), F.concat(F.lit("q"), F.col("quality").cast("string")))
    ids = splits.identity_values([dataset.text_hash(F.col("text")), F.col("source"), F.when(F.col("lang") == "en", "")], [(F.col("source"), F.col("lang")), (tag, F.col("lang"))])
    return d.select("doc_id", ids.alias("i")).select("doc_id", F.size("i").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("i"), "|"), 256).alias("digest"))


def group_digests(spark, sf):
    """Decontamination groups' ids from their members' identities."""
    ids = records._identities(spark, sf)
    return splits.group_ids(ids, dataset.identity_groups(ids, "doc_id", "identity"), "doc_id", "identity").select("component", "group_id", "n_identities")


def reserved_groups(spark, sf):
    """Components any of whose documents holds a benchmark text are excluded, and so are all their documents."""
    groups = dataset.identity_groups(records._identities(spark, sf), "doc_id", "identity")
    hit = records.reserved_collision(spark, sf).select("doc_id").distinct().withColumn("hit", F.lit(1))
    out = groups.join(hit, "doc_id", "left").groupBy("component").agg(F.count("*").alias("documents"), F.count("hit").alias("reserved"))
    return out.where("reserved > 0").select("component", "documents", "reserved", F.lit("collides_with_reserved_real_manual").alias("reason"))


def split_ranges(spark, sf):
    """Texts' groups in consecutive ranges of a seeded order, sized by largest remainders of shares of 105."""
    groups = read(spark, sf, "documents").select(F.sha2("text", 256).alias("group_id")).distinct()
    sizes = dict(map(tuple, dataset.apportion(groups.agg(F.count("*").alias("n")), "n", list(SHARES)).collect()))  # one for each split
    return splits.ranges(groups, "group_id", [(name, sizes[name]) for name, _ in SHARES], "23").select("group_id", "split")


def split_viability(spark, sf):
    """Hash splits of documents against shares, one of which nothing fills."""
    counts = records._splits(spark, sf).groupBy("split").agg(F.count("*").alias("n"))
    return splits.viability(counts, [("train", 80), ("validation", 10), ("test", 5), ("holdout", 5)], 200)


def stamped_records(spark, sf):
    """Documents with their split's metadata; those of toxic labels are excluded."""
    s = records._splits(spark, sf).join(read(spark, sf, "labels").where("toxic = 1").select("doc_id", "toxic"), "doc_id", "left")
    rows = s.select("doc_id", "text", F.when(F.col("toxic") == 1, "excluded").otherwise(F.col("split")).alias("sp"), F.struct(F.col("source").alias("group_key"), F.lit("old").alias("split")).alias("metadata"), F.to_json(F.struct("lang", "source")).alias("packet"))
    done = splits.stamped(rows, "metadata", F.col("sp"), F.sha2("text", 256), F.col("packet"), F.col("text"), 23)
    return done.select("doc_id", "metadata.group_key", "metadata.split", "metadata.packet_content_hash", "metadata.assessment_rationale_hash", "metadata.usable_for_training", "metadata.exclusion_reason")


def split_order(spark, sf):
    """Documents' places by split, then id; an unknown split comes last."""
    rows = records._splits(spark, sf).withColumn("split", F.when(F.col("lang") == "fr", "archive").otherwise(F.col("split"))).withColumn("rank", splits.split_rank(F.col("split")))
    return ranking.placed(rows, "rank", "doc_id").select("doc_id", "split", "rank", "place")


def leakage_fields(spark, sf):
    """Values found in several splits, by field, without toxic rows."""
    rows = records._splits(spark, sf).join(read(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_anti")
    fields = {"text": F.sha2("text", 256), "normalised": dataset.text_hash(F.col("text")), "words": F.sha2(F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))), " "), 256), "digits": F.sha2(F.regexp_replace("text", "[^0-9]+", ""), 256), "size": F.concat_ws(":", "source", F.length("text").cast("string")), "line": F.sha2(F.substring_index("text", "\n", 1), 256)}
    long = rows.select("split", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()))).alias("f")).select("split", "f.*")
    found = long.groupBy("field", "value").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return found.where(F.size("s") > 1).groupBy("field", F.array_join("s", ",").alias("splits")).agg(F.count("*").alias("n"))


def composed_dataset(spark, sf):
    """Two releases as one, ordered by split and id; reserved test rows must stay, as many and the same."""
    rows = records._splits(spark, sf)
    first, extra = rows.where("lang <> 'de' or split = 'test'"), rows.where("lang = 'de' and split <> 'test'")
    both = first.select("doc_id", "split", F.lit("base").alias("origin")).unionByName(extra.select("doc_id", "split", F.lit("extra").alias("origin")))
    kept = both.where("split = 'test'").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
    wanted = rows.where("split = 'test'").groupBy("split").agg(F.count("*").alias("w"))
    same = kept.join(wanted, "split").select("split", ((F.col("n") == F.col("w")) & (F.col("ids") == F.col("w"))).alias("reserved_kept"))
    return both.groupBy("split", "origin").agg(F.count("*").alias("n")).join(same, "split", "left")


def scenario_variants(spark, sf):
    """Families by support level by slot, where the family has the level; in turns, with seeds."""
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("family"), F.col("n_regionkey").alias("region"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("support")
    slots = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot")
    rows = n.select("*", levels).where(F.pmod(F.col("family") + F.col("support"), F.lit(3)) > 0).select("*", slots)
    return rows.select("family", "support", "slot", F.pmod(F.col("support") - F.col("family"), F.lit(4)).cast("int").alias("turn"), (F.lit(1000) + F.col("family") * 32 + F.col("support") * 8 + F.col("slot")).cast("long").alias("seed"))


def _candidates(spark, sf) -> DataFrame:
    c = F.col
    spot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    o = read(spark, sf, "orders").select(c("o_orderkey").alias("l_orderkey"), F.when(c("o_orderstatus") == "F", "supported").when(c("o_orderstatus") == "O", "weakly_supported").otherwise("not_supported").alias("target"), F.substring("o_orderpriority", 1, 1).alias("target_category"))
    placed = dealt(read(spark, sf, "lineitem"), spark, sf, "lineitem", "l_orderkey").withColumn("spot", spot)
    rows = placed.join(dealt(o, spark, sf, "lineitem", "l_orderkey"), "l_orderkey")
    dims = F.array(F.when(c("l_partkey") % 7 == 0, 4).otherwise(5), F.when(c("l_suppkey") % 9 == 0, 3).otherwise(5))
    return rows.select(
        c("l_orderkey").alias("example"), c("spot").alias("idx"), F.when(c("l_returnflag") == "R", "reject").when(c("l_quantity") < 3, None).otherwise("keep").alias("decision"), (F.lit(60) + F.round(c("l_tax") * 100).cast("int") * 5).alias("score"),
        dims.alias("dims"), (dims[0] + dims[1]).alias("total"), "target", F.when(c("l_linestatus") == "F", "supported").otherwise("weakly_supported").alias("assessed"), "target_category", (c("l_partkey") % 5 + 1).cast("string").alias("category"),
    )


def eligibility_reasons(spark, sf):
    rows = _candidates(spark, sf).select(F.explode(F.when(F.size(gate.rejections()) > 0, gate.rejections()).otherwise(F.array(F.lit("eligible")))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def promotion(spark, sf):
    """The best eligible candidate of every example."""
    return gate.promoted(_candidates(spark, sf))


def batched_judgements(spark, sf):
    """Candidates with batched results, where one came; some decisions aren't known ones."""
    c = _candidates(spark, sf)
    r = c.where("total > 8").select("example", "idx", F.when(F.col("category") == "1", "maybe").otherwise(F.col("decision")).alias("decision"), "score", F.lit(None).cast("string").alias("reasons"))
    return gate.judged(c, r).groupBy("decision", "reasons").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("score"))


def replayed_candidates(spark, sf):
    """Recorded candidates of each example, in order."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "decision", "score")))
    out = _candidates(spark, sf).groupBy("example").agg(rows.alias("l"))
    return out.select("example", F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["idx"].cast("string"), F.coalesce(x["decision"], F.lit("none")), x["score"].cast("string"))), " ").alias("replay"))


def gate_outcomes(spark, sf):
    """Examples by outcome; examples without any candidate fail."""
    examples = read(spark, sf, "orders").select(F.col("o_orderkey").alias("example"))
    done = dealt(examples, spark, sf, "lineitem", "example").join(gate.promoted(_candidates(spark, sf)), "example", "left")
    return done.groupBy(F.coalesce("outcome", F.lit("no_candidates")).alias("outcome"), F.coalesce("assessed", F.lit("")).alias("assessed")).agg(F.count("*").alias("n"))


def distinct_assessments(spark, sf):
    """Different assessments by canonical JSON, and all of them, by outcome label."""
    c = _candidates(spark, sf)
    text = F.to_json(F.struct("score", "assessed", "category"))
    return c.groupBy("target").agg(F.countDistinct(F.sha2(dialects.canonical_json(text), 256)).alias("different"), F.count("*").alias("all"))


def family_metrics(spark, sf):
    """Per family of candidates: agreement with the target, guard hits, rates."""
    c = _candidates(spark, sf)
    g = c.groupBy("category", "target").agg(F.count("*").alias("n"), F.count_if(F.col("target") == F.col("assessed")).alias("agree"), F.count_if(F.exists("dims", lambda d: d < 5)).alias("guarded"))
    return g.withColumn("agree_bp", evaluate.rate_bp("agree", "n"))


def variant_summary(spark, sf):
    """One row per variant: rows, reasons that speak of scores, of decisions, the macro agreement."""
    c = _candidates(spark, sf).withColumn("r", gate.rejections())
    starts = lambda p: F.sum(F.size(F.filter("r", lambda x: x.startswith(p)))).cast("long")
    g = c.groupBy("assessed").agg(F.count("*").alias("n"), starts("judge_score").alias("by_score"), starts("judge_decision").alias("by_decision"), F.count_if(F.size("r") == 0).alias("eligible"))
    return g.withColumn("eligible_bp", evaluate.rate_bp("eligible", "n"))


def metric_gates(spark, sf):
    """Metrics of two variants side by side: at least a floor, no great drop, some increase; a missing one fails."""
    m = _candidates(spark, sf).groupBy("category").agg(*(F.expr(f"CASE WHEN count_if(assessed = '{a}') > 5 THEN count_if(assessed = '{a}' AND score >= 80) * 10000 div count_if(assessed = '{a}') END").alias(n) for a, n in (("supported", "base"), ("weakly_supported", "new"))))
    ok = lambda c: F.coalesce(c, F.lit(False))
    gates = {"floor": ok(F.col("new") >= 4000), "drop": ok(F.col("base") - F.col("new") <= 300), "increase": ok(F.col("new") - F.col("base") >= 1)}
    out = m.withColumns(gates)
    return out.withColumn("recommended", F.col("floor") & F.col("drop") & F.col("increase"))


def weak_error_cases(spark, sf):
    """Weak targets judged otherwise, by what was said; no decision counts as empty."""
    c = _candidates(spark, sf).where("target = 'weakly_supported' and assessed <> target")
    return c.groupBy(F.coalesce("decision", F.lit("")).alias("said"), "category").agg(F.count("*").alias("n"))


def set_overlaps(spark, sf):
    """Orders' flags against wanted ones: overlap, subset, what is missing."""
    s = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    wanted = F.array(F.lit("N"), F.lit("R"))
    return s.select("l_orderkey", F.arrays_overlap("s", wanted).alias("overlap"), (F.size(F.array_except("s", wanted)) == 0).alias("subset"), F.array_join(F.array_except(wanted, "s"), ",").alias("missing"))


def constraint_rows(spark, sf):
    """Enumerations, ranges, types and equal fields of orders and their lines as violations."""
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("least"), F.max("l_linestatus").alias("most"), F.max("l_quantity").alias("q"))
    rows = read(spark, sf, "orders").join(lines, "o_orderkey", "left")
    same = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("P")
    rules = [("status_not_of_lines", F.col("least").isNotNull() & (same != F.col("o_orderstatus"))), ("priority_not_allowed", ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")), ("total_out_of_range", ~F.col("o_totalprice").between(5000, 400000)), ("quantity_not_whole", F.col("q") != F.floor("q")), ("no_lines", F.col("least").isNull())]
    return integrity.violations(rows, ["o_orderkey"], rules)


def projected_fields(spark, sf):
    """Dotted paths of nested events, and the keys that a provider may see."""
    e = read(spark, sf, "events").select("event_id", F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.parse_json("props").alias("props")).alias("input"), F.struct(F.col("user_id").alias("secret_key"), F.col("value").cast("int").alias("value")).alias("output"))).alias("j"))
    v = F.parse_json("j")
    safe = F.struct(F.variant_get(v, "$.input.kind", "string").alias("kind"), F.variant_get(v, "$.output.value", "int").alias("value"))
    return e.select("event_id", F.variant_get(v, "$.input.props.k", "long").alias("k"), F.sha2(F.to_json(safe), 256).alias("safe"))


def requested_ids(spark, sf):
    """Wanted ids that are there, first ones first, and those that are missing."""
    wanted = read(spark, sf, "nation").select((F.col("n_nationkey") * 9).cast("long").alias("doc_id"))
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    return wanted.join(docs, "doc_id", "left").select("doc_id", F.when(F.col("lang").isNull(), "missing").otherwise("found").alias("state"))


def policy_filter(spark, sf):
    """Which sources may go into which split, and what breaks the policy."""
    rows = records._splits(spark, sf).select("source", "split", "lang")
    kind = F.when(F.length("source") % 2 == 0, "synthetic").otherwise("real")
    breaks = ((kind == "real") & (F.col("split") == "train") & (F.col("lang") == "de")) | ((kind == "synthetic") & (F.col("split") == "test"))
    return rows.groupBy(kind.alias("kind"), "split").agg(F.count("*").alias("n"), F.count_if(breaks).alias("violations"))


def sidecar_join(spark, sf):
    """Predictions with their invalid responses, where there are some, as rows of one kind."""
    p = read(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 300, 1).otherwise(0).alias("predicted"))
    s = read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("invalid_response").alias("sidecar"))
    out = p.join(s, "doc_id", "left")
    return out.groupBy("predicted", F.coalesce("sidecar", F.lit("none")).alias("sidecar")).agg(F.count("*").alias("n"))


def two_formats(spark, sf):
    """Records of documents and of chats as one kind of rows."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("example_id"), F.col("lang").alias("category"), F.length("text").cast("long").alias("size"), F.lit("record").alias("format"))
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("size"), F.max_by("role", "turn").alias("category"))
    return d.unionByName(c.select(F.concat(F.lit("chat-"), F.col("conv_id")).alias("example_id"), "category", "size", F.lit("chat").alias("format")))


def chat_messages(spark, sf):
    """Conversations as JSON of messages with metadata, keys in order, nulls left out."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["text"].alias("content"), x["role"].alias("role")))
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(m.alias("messages"), F.count("*").alias("n"))
    return c.select("conv_id", F.sha2(F.to_json(F.struct("messages", F.struct("n", F.lit(None).cast("string").alias("note")).alias("metadata"))), 256).alias("digest"))


def renamed_categories(spark, sf):
    """A category renamed wherever it is a whole JSON value, and nowhere else: keys and longer texts keep it."""
    e = read(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("a"), F.concat(F.lit("my "), "event_type").alias("b"), F.array("event_type", F.lit("x")).alias("c"), F.create_map("event_type", F.concat(F.lit('a "purchase": '), "event_type")).alias("purchase"))).alias("j"))
    return e.select("event_id", nested.renamed_values(F.col("j"), {"purchase": "sale"}).alias("renamed"))


def negative_controls(spark, sf):
    """Orders without a returned line get a control candidate."""
    hit = dealt(read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), spark, sf, "lineitem", "o_orderkey").distinct().withColumn("hit", F.lit(True))
    o = dealt(read(spark, sf, "orders").select("o_orderkey"), spark, sf, "lineitem", "o_orderkey")
    return o.join(hit, "o_orderkey", "left").select("o_orderkey", F.when(F.col("hit"), "candidate").otherwise("negative_control").alias("kind"))


def context_queries(spark, sf):
    """Declarative context queries, run: lines of an order's account group, at most so many."""
    spec = F.array(F.struct(F.lit("R").alias("flag"), F.lit(2).alias("most")), F.struct(F.lit("N").alias("flag"), F.lit(1).alias("most")))
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = read(spark, sf, "lineitem").withColumn("n", place).withColumn("q", F.explode(spec)).where((F.col("q.flag") == F.col("l_returnflag")) & (F.col("n") <= F.col("q.most")))
    return rows.select("l_orderkey", "l_returnflag", "n", "l_partkey")


def staged_batches(spark, sf):
    """Raw batches (an order's lines) staged whole, or not at all when one record breaks a rule."""
    bad = (F.col("l_discount") > 0.09) | (F.col("l_quantity") < 2)
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    return g.groupBy(F.when(F.col("bad") > 0, "refused").otherwise("staged").alias("state")).agg(F.count("*").alias("batches"), F.sum("n").cast("long").alias("records"))


NAMES = "identity_sets group_digests reserved_groups split_ranges split_viability stamped_records split_order leakage_fields composed_dataset scenario_variants eligibility_reasons promotion batched_judgements replayed_candidates gate_outcomes distinct_assessments family_metrics variant_summary metric_gates weak_error_cases set_overlaps constraint_rows projected_fields requested_ids policy_filter sidecar_join two_formats chat_messages renamed_categories negative_controls context_queries staged_batches".split()
QUERIES = {name: globals()[name] for name in NAMES}

_S = records._SPLIT
_COMPONENTS = records.SQL["identity_components"]
_COMP = _COMPONENTS[: _COMPONENTS.rindex("SELECT node")]
_CAND = """WITH c AS (SELECT l_orderkey AS example, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, CASE WHEN l_returnflag = 'R' THEN 'reject' WHEN l_quantity < 3 THEN NULL ELSE 'keep' END AS decision, 60 + CAST(round(l_tax * 100) AS INTEGER) * 5 AS score,
  CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 5 END AS d1, CASE WHEN l_suppkey % 9 = 0 THEN 3 ELSE 5 END AS d2, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'weakly_supported' ELSE 'not_supported' END AS target, CASE WHEN l_linestatus = 'F' THEN 'supported' ELSE 'weakly_supported' END AS assessed, substring(o_orderpriority, 1, 1) AS target_category, CAST(l_partkey % 5 + 1 AS VARCHAR) AS category FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
r AS (SELECT *, decision IS NULL OR decision <> 'keep' AS r1, score < CASE WHEN target = 'weakly_supported' AND assessed = 'weakly_supported' THEN 70 ELSE 90 END AS r2, d1 < 5 OR d2 < 5 AS r3 FROM c)"""
_PROMOTED = f"""{_CAND}, p AS (SELECT *, row_number() OVER (PARTITION BY example ORDER BY CASE WHEN target = assessed THEN 1 ELSE 0 END DESC, CASE WHEN target_category = category THEN 1 ELSE 0 END DESC, score DESC, d1 + d2 DESC, idx) AS k FROM r WHERE NOT r1 AND NOT r2 AND NOT r3),
g AS (SELECT example, count(*) FILTER (WHERE NOT r1 AND NOT r2 AND NOT r3) AS eligible, count(*) AS candidates FROM r GROUP BY 1),
promoted AS (SELECT g.example, CAST(idx AS INTEGER) AS idx, assessed, eligible, candidates, CASE WHEN eligible > 0 THEN 'promoted' ELSE 'filtered' END AS outcome FROM g LEFT JOIN p ON p.example = g.example AND k = 1)"""
_RATE = "CASE WHEN {1} > 0 THEN ({0} * 20000 + {1}) // (2 * {1}) END"

SQL = {
    "identity_sets": f"""WITH d AS (SELECT documents.doc_id, {records._HASH} AS h, source, lang, 'q' || quality AS tag FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id), i AS (SELECT doc_id, h AS x FROM d UNION SELECT doc_id, source FROM d UNION SELECT doc_id, source || '::' || lang FROM d UNION SELECT doc_id, tag || '::' || lang FROM d WHERE tag IS NOT NULL)
SELECT doc_id, count(*) AS n, sha256(string_agg(x, '|' ORDER BY x)) AS digest FROM i GROUP BY doc_id""",
    "group_digests": f"{_COMP}, m AS (SELECT node, min(c) AS component FROM r GROUP BY node), k AS (SELECT DISTINCT component, identity FROM i JOIN m ON i.doc_id = m.node) SELECT component, 'DG_' || upper(substring(sha256(string_agg(identity, '|' ORDER BY identity)), 1, 16)) AS group_id, count(*) AS n_identities FROM k GROUP BY component",
    "reserved_groups": f"{_COMP}, m AS (SELECT node, min(c) AS component FROM r GROUP BY node), h AS (SELECT DISTINCT doc_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)) SELECT component, count(*) AS documents, count(h.doc_id) AS reserved, 'collides_with_reserved_real_manual' AS reason FROM m LEFT JOIN h ON h.doc_id = m.node GROUP BY component HAVING count(h.doc_id) > 0",
    "split_ranges": """WITH g AS (SELECT DISTINCT sha256(text) AS group_id FROM documents), k AS (SELECT group_id, row_number() OVER (ORDER BY sha256('23|' || group_id), group_id) AS n FROM g), t AS (SELECT count(*) AS total FROM g),
s AS (SELECT i, split, p * total // 105 AS base, p * total % 105 AS rest, total FROM t CROSS JOIN (SELECT 0 AS i, 'train' AS split, 70 AS p UNION ALL SELECT 1, 'validation', 15 UNION ALL SELECT 2, 'test', 10 UNION ALL SELECT 3, 'holdout', 10)),
z AS (SELECT i, split, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, split DESC) <= total - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS n FROM s),
b AS (SELECT split, sum(n) OVER (ORDER BY i) AS top, sum(n) OVER (ORDER BY i) - n AS low FROM z) SELECT group_id, split FROM k JOIN b ON k.n > low AND k.n <= top""",
    "split_viability": f"{_S}, c AS (SELECT split, count(*) AS n FROM s GROUP BY 1), w AS (SELECT 'train' AS split, 8000 AS wanted_bp UNION ALL SELECT 'validation', 1000 UNION ALL SELECT 'test', 500 UNION ALL SELECT 'holdout', 500), v AS (SELECT w.split, coalesce(n, 0) AS n, CAST(wanted_bp AS BIGINT) AS wanted_bp, CAST(coalesce(n, 0) * 10000 // (SELECT sum(n) FROM c) AS BIGINT) AS actual_bp FROM w LEFT JOIN c ON c.split = w.split) SELECT *, CASE WHEN n = 0 THEN 'empty_requested_split' WHEN abs(actual_bp - wanted_bp) > 200 THEN 'outside_tolerance' ELSE 'viable' END AS code FROM v",
    "stamped_records": f"{_S}, k AS (SELECT s.*, CASE WHEN toxic = 1 THEN 'excluded' ELSE split END AS sp FROM s LEFT JOIN labels ON labels.doc_id = s.doc_id) SELECT doc_id, source AS group_key, sp AS split, sha256('{{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}}') AS packet_content_hash, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS assessment_rationale_hash, sp <> 'excluded' AS usable_for_training, CASE WHEN sp = 'excluded' THEN 'excluded' END AS exclusion_reason FROM k",
    "split_order": f"{_S}, k AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'archive' ELSE split END AS split FROM s), r AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 WHEN 'holdout' THEN 3 WHEN 'excluded' THEN 4 ELSE 99 END AS rank FROM k) SELECT doc_id, split, rank, row_number() OVER (PARTITION BY rank ORDER BY doc_id) AS place FROM r",
    "leakage_fields": f"{_S}, k AS (SELECT s.* FROM s LEFT JOIN labels ON labels.doc_id = s.doc_id AND toxic = 1 WHERE toxic IS NULL), l AS (SELECT split, 'text' AS field, sha256(text) AS value FROM k UNION ALL SELECT split, 'normalised', {records._HASH} FROM k UNION ALL SELECT split, 'words', sha256(array_to_string(list_sort(list_distinct(string_split_regex(lower(text), '[^a-z]+'))), ' ')) FROM k UNION ALL SELECT split, 'digits', sha256(regexp_replace(text, '[^0-9]+', '', 'g')) FROM k UNION ALL SELECT split, 'size', source || ':' || length(text) FROM k UNION ALL SELECT split, 'line', sha256(string_split(text, chr(10))[1]) FROM k), f AS (SELECT field, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM l GROUP BY 1, 2 HAVING count(DISTINCT split) > 1) SELECT field, splits, count(*) AS n FROM f GROUP BY 1, 2",
    "composed_dataset": f"{_S} SELECT split, CASE WHEN lang <> 'de' OR split = 'test' THEN 'base' ELSE 'extra' END AS origin, count(*) AS n, CASE WHEN split = 'test' THEN true END AS reserved_kept FROM s GROUP BY 1, 2",
    "scenario_variants": "SELECT n_nationkey AS family, CAST(support AS INTEGER) AS support, CAST(slot AS INTEGER) AS slot, CAST(((support - n_nationkey) % 4 + 4) % 4 AS INTEGER) AS turn, CAST(1000 + n_nationkey * 32 + support * 8 + slot AS BIGINT) AS seed FROM nation CROSS JOIN range(4) a(support) CROSS JOIN range(8) b(slot) WHERE (n_nationkey + support) % 3 > 0",
    "eligibility_reasons": f"{_CAND}, x AS (SELECT 'judge_decision_' || coalesce(decision, 'missing') AS reason FROM r WHERE r1 UNION ALL SELECT 'judge_score_below_promotion_threshold' FROM r WHERE r2 UNION ALL SELECT 'judge_hard_dimension_below_promotion_threshold' FROM r WHERE r3 UNION ALL SELECT 'eligible' FROM r WHERE NOT r1 AND NOT r2 AND NOT r3) SELECT reason, count(*) AS n FROM x GROUP BY 1",
    "promotion": f"{_PROMOTED} SELECT * FROM promoted",
    "batched_judgements": f"{_CAND}, j AS (SELECT *, d1 + d2 > 8 AS there, CASE WHEN category = '1' THEN 'maybe' ELSE decision END AS said FROM r) SELECT CASE WHEN there AND coalesce(said IN ('keep', 'revise', 'reject', 'abstain'), false) THEN said ELSE 'reject' END AS decision, CASE WHEN there THEN '' ELSE 'missing_batched_judge_result' END AS reasons, count(*) AS n, CAST(sum(CASE WHEN there THEN score ELSE 0 END) AS BIGINT) AS score FROM j GROUP BY 1, 2",
    "replayed_candidates": f"{_CAND} SELECT example, string_agg(idx || ':' || coalesce(decision, 'none') || ':' || score, ' ' ORDER BY idx) AS replay FROM c GROUP BY 1",
    "gate_outcomes": f"{_PROMOTED} SELECT coalesce(outcome, 'no_candidates') AS outcome, coalesce(assessed, '') AS assessed, count(*) AS n FROM orders LEFT JOIN promoted ON example = o_orderkey GROUP BY 1, 2",
    "distinct_assessments": f"{_CAND} SELECT target, count(DISTINCT assessed || '|' || category || '|' || score) AS different, count(*) AS \"all\" FROM c GROUP BY 1",
    "family_metrics": f"{_CAND}, g AS (SELECT category, target, count(*) AS n, count(*) FILTER (WHERE target = assessed) AS agree, count(*) FILTER (WHERE r3) AS guarded FROM r GROUP BY 1, 2) SELECT *, {_RATE.format('agree', 'n')} AS agree_bp FROM g",
    "variant_summary": f"{_CAND}, g AS (SELECT assessed, count(*) AS n, count(*) FILTER (WHERE r2) AS by_score, count(*) FILTER (WHERE r1) AS by_decision, count(*) FILTER (WHERE NOT r1 AND NOT r2 AND NOT r3) AS eligible FROM r GROUP BY 1) SELECT *, {_RATE.format('eligible', 'n')} AS eligible_bp FROM g",
    "metric_gates": f"{_CAND}, m AS (SELECT category, CASE WHEN count(*) FILTER (WHERE assessed = 'supported') > 5 THEN count(*) FILTER (WHERE assessed = 'supported' AND score >= 80) * 10000 // count(*) FILTER (WHERE assessed = 'supported') END AS base, CASE WHEN count(*) FILTER (WHERE assessed = 'weakly_supported') > 5 THEN count(*) FILTER (WHERE assessed = 'weakly_supported' AND score >= 80) * 10000 // count(*) FILTER (WHERE assessed = 'weakly_supported') END AS new FROM c GROUP BY 1), g AS (SELECT *, coalesce(new >= 4000, false) AS floor, coalesce(base - new <= 300, false) AS \"drop\", coalesce(new - base >= 1, false) AS increase FROM m) SELECT *, floor AND \"drop\" AND increase AS recommended FROM g",
    "weak_error_cases": f"{_CAND} SELECT coalesce(decision, '') AS said, category, count(*) AS n FROM c WHERE target = 'weakly_supported' AND assessed <> target GROUP BY 1, 2",
    "set_overlaps": "WITH s AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, n OR r AS overlap, NOT a AS subset, CASE WHEN n AND r THEN '' WHEN n THEN 'R' WHEN r THEN 'N' ELSE 'N,R' END AS missing FROM s",
    "constraint_rows": "WITH l AS (SELECT l_orderkey, min(l_linestatus) AS least, max(l_linestatus) AS most, max(l_quantity) AS q FROM lineitem GROUP BY 1), o AS (SELECT * FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT o_orderkey, 'status_not_of_lines' AS code FROM o WHERE least IS NOT NULL AND CASE WHEN least = most THEN least ELSE 'P' END <> o_orderstatus UNION ALL SELECT o_orderkey, 'priority_not_allowed' FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') UNION ALL SELECT o_orderkey, 'total_out_of_range' FROM o WHERE NOT o_totalprice BETWEEN 5000 AND 400000 UNION ALL SELECT o_orderkey, 'quantity_not_whole' FROM o WHERE q <> floor(q) UNION ALL SELECT o_orderkey, 'no_lines' FROM o WHERE least IS NULL",
    "projected_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256('{\"kind\":\"' || event_type || '\",\"value\":' || CAST(trunc(value) AS INTEGER) || '}') AS safe FROM events",
    "requested_ids": "SELECT CAST(n_nationkey * 9 AS BIGINT) AS doc_id, CASE WHEN lang IS NULL THEN 'missing' ELSE 'found' END AS state FROM nation LEFT JOIN documents ON doc_id = n_nationkey * 9",
    "policy_filter": f"{_S} SELECT CASE WHEN length(source) % 2 = 0 THEN 'synthetic' ELSE 'real' END AS kind, split, count(*) AS n, count(*) FILTER (WHERE (length(source) % 2 = 1 AND split = 'train' AND lang = 'de') OR (length(source) % 2 = 0 AND split = 'test')) AS violations FROM s GROUP BY 1, 2",
    "sidecar_join": "SELECT CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS predicted, CASE WHEN toxic = 1 THEN 'invalid_response' ELSE 'none' END AS sidecar, count(*) AS n FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id AND toxic = 1 GROUP BY 1, 2",
    "two_formats": "SELECT 'doc-' || doc_id AS example_id, lang AS category, CAST(length(text) AS BIGINT) AS size, 'record' AS format FROM documents UNION ALL SELECT 'chat-' || conv_id, arg_max(role, turn), CAST(sum(length(text)) AS BIGINT), 'chat' FROM conversations GROUP BY conv_id",
    "chat_messages": "SELECT conv_id, sha256('{\"messages\":[' || string_agg('{\"content\":' || to_json(text) || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn) || '],\"metadata\":{\"n\":' || count(*) || '}}') AS digest FROM conversations GROUP BY conv_id",
    "renamed_categories": "SELECT event_id, '{\"a\":\"' || CASE event_type WHEN 'purchase' THEN 'sale' ELSE event_type END || '\",\"b\":\"my ' || event_type || '\",\"c\":[\"' || CASE event_type WHEN 'purchase' THEN 'sale' ELSE event_type END || '\",\"x\"],\"purchase\":{\"' || event_type || '\":\"a \\\"purchase\\\": ' || event_type || '\"}}' AS renamed FROM events",
    "negative_controls": "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'candidate' ELSE 'negative_control' END AS kind FROM orders",
    "context_queries": "SELECT l_orderkey, l_returnflag, CAST(n AS INTEGER) AS n, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE (l_returnflag = 'R' AND n <= 2) OR (l_returnflag = 'N' AND n <= 1)",
    "staged_batches": "WITH g AS (SELECT count(*) AS n, bool_or(l_discount > 0.09 OR l_quantity < 2) AS bad FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN bad THEN 'refused' ELSE 'staged' END AS state, count(*) AS batches, CAST(sum(n) AS BIGINT) AS records FROM g GROUP BY 1",
}
