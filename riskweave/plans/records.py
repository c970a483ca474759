"""Dataset, evaluation and text queries over documents, labels, benchmark, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import checks, dataset, evaluate, integrity, ranking
from riskweave.plans.texts import _TEXT
from riskweave.sources import html
from riskweave.sources.tables import read

SPLITS = [("train", 80), ("validation", 10), ("test", 10)]
BOUNDS = [("train", 80), ("validation", 90), ("test", 100)]


def exact_text_hash_groups(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", dataset.text_hash(F.col("text")).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))


def duplicate_keys(spark, sf):
    return integrity.duplicates(read(spark, sf, "documents").select(F.sha2("text", 256).alias("hash")), ["hash"])


def _splits(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", "text", dataset.hash_split(F.col("doc_id"), "17", BOUNDS).alias("split"))


def split_assign_hash(spark, sf):
    return _splits(spark, sf).select("doc_id", "split")


def split_apportion(spark, sf):
    return dataset.apportion(read(spark, sf, "documents").groupBy().agg(F.count("*").alias("n")), "n", SPLITS)


def cross_split_leakage(spark, sf):
    rows = _splits(spark, sf).select("split", dataset.text_hash(F.col("text")).alias("hash"))
    return dataset.leaked(rows, "hash", "split")


def _identities(spark, sf):
    """Identities of a document: its normalised text, and every line of 200 characters or more."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 200)
    return docs.select("doc_id", dataset.text_hash(F.col("text")).alias("identity")).union(lines.select("doc_id", dataset.text_hash(F.col("line"))))


def identity_components(spark, sf):
    return dataset.identity_groups(_identities(spark, sf), "doc_id", "identity")


def reserved_collision(spark, sf):
    """Documents that hold a benchmark text anywhere.

    A held text's words, but for the first and the last, are whole words of the document: both sides meet on up to four of
    them, and only the texts of those that met are compared in full.  Texts of fewer than three words have no such word;
    they are few, which is checked, and are looked for in every document."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    words = F.split("text", " ")
    items = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"), words.alias("w")).withColumn("k", F.least(F.lit(4), F.size("w") - 2))
    keys = items.where("k > 0").select("item_id", "k", F.array_join(F.slice("w", F.lit(2), F.col("k")), " ").alias("gram"))
    sizes = ranking.bounded(keys.select("k").distinct(), 4)  # one to four
    # Only the runs of words are dealt out, not a copy of all words with each of them; a run counts once a document.
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " ")))
    grams = docs.select("doc_id", words.alias("w")).crossJoin(sizes).select("doc_id", "k", F.explode(F.when(F.size("w") >= F.col("k"), runs)).alias("gram"))
    met = grams.join(keys, ["k", "gram"]).select("doc_id", "item_id").distinct()
    long = met.join(docs, "doc_id").join(items.select("item_id", "passage"), "item_id").where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")
    short = docs.crossJoin(ranking.bounded(items.where("k <= 0").select("item_id", "passage"), 100_000)).where(F.col("text").contains(F.col("passage")))
    return long.unionByName(short.select("doc_id", "item_id"))


def group_manifest(spark, sf):
    rows = _splits(spark, sf).withColumn("hash", dataset.text_hash(F.col("text")))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("hash").agg(listed("split").alias("splits"), listed("source").alias("sources"), F.count("*").alias("n")).where("n > 1")


def source_manifest(spark, sf):
    rows = _splits(spark, sf)
    return rows.groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


def nested_counts(spark, sf):
    return _splits(spark, sf).groupBy("split", "lang").agg(F.count("*").alias("n"))


def multi_grouping(spark, sf):
    """Counts by several single and double keys in one pass: grouping sets."""
    rows = _splits(spark, sf)
    sets = [[rows.split], [rows.lang], [rows.split, rows.lang], []]
    out = rows.groupingSets(sets, rows.split, rows.lang).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    return out.select(F.coalesce("split", F.lit("*")).alias("split"), F.coalesce("lang", F.lit("*")).alias("lang"), "n")


def distinct_groups_by_split(spark, sf):
    rows = _splits(spark, sf).withColumn("hash", dataset.text_hash(F.col("text")))
    return rows.groupBy("split").agg(F.countDistinct("hash").alias("groups"), F.countDistinct("source").alias("sources"))


def oversample_minority(spark, sf):
    """Minority rows repeated until classes are about even: a factor from counts, then explode."""
    labels = read(spark, sf, "labels")
    factor = labels.agg(F.greatest(F.lit(1), F.floor(F.count_if(F.col("toxic") == 0) / F.greatest(F.lit(1), F.count_if(F.col("toxic") == 1)))).cast("int").alias("m"))
    rows = labels.join(F.broadcast(factor)).select("doc_id", "toxic", F.explode(F.sequence(F.lit(1), F.when(F.col("toxic") == 1, F.col("m")).otherwise(1))).alias("copy"))  # factor: one row
    return rows.select("doc_id", "toxic", "copy")


def _pairs(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") >= 300).cast("int").alias("predicted"))
    return read(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold")).join(docs, "doc_id")


def confusion_matrix(spark, sf):
    return evaluate.confusion(_pairs(spark, sf))


def class_metrics(spark, sf):
    return evaluate.class_metrics(_pairs(spark, sf), [0, 1, 2])


def macro_f1(spark, sf):
    """Mean of the F1 of classes that have one."""
    return class_metrics(spark, sf).agg(F.expr("CAST(sum(f1_bp) div count(f1_bp) AS BIGINT)").alias("macro_f1_bp"), F.count("f1_bp").alias("classes"))


def false_positive_rejection(spark, sf):
    n = lambda c: F.count_if(c)
    low = F.col("gold") == 0
    return _pairs(spark, sf).agg(n(low).alias("negatives"), n(low & (F.col("predicted") == 0)).alias("rejected")).withColumn("rate_bp", evaluate.rate_bp("rejected", "negatives"))


def metrics_by_group(spark, sf):
    out = _pairs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("exact"))
    return out.withColumn("rate_bp", evaluate.rate_bp("exact", "n"))


def threshold_gate(spark, sf):
    """Gates over the metrics of each class: at least 70 %; a missing metric fails."""
    m = class_metrics(spark, sf)
    ok = lambda c: F.coalesce(F.col(c) >= 7000, F.lit(False))
    return m.select("label", ok("precision_bp").alias("precision_ok"), ok("recall_bp").alias("recall_ok"), (ok("precision_bp") & ok("recall_bp")).alias("passed"))


def quality_reason_codes(spark, sf):
    """A row for every reason against a document, or one row ``eligible``."""
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 100, "short"), F.when(F.col("quality").isNull(), "unlabelled"), F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic")))
    return docs.select("doc_id", F.explode(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("eligible")))).alias("reason"))


def profile_markers(spark, sf):
    """Documents with at least two of a list of markers."""
    text = F.lower("text")
    hits = sum((text.contains(m).cast("int") for m in ("license", "copyright", "http", "@", "version")), F.lit(0))
    return read(spark, sf, "documents").select("doc_id", hits.alias("markers")).where("markers >= 2")


def prohibited_phrase_scan(spark, sf):
    text = F.lower("text")
    found = F.array_compact(F.array(*(F.when(text.contains(p), F.lit(p)) for p in ("all rights reserved", "licensed under", "password", "secret"))))
    return read(spark, sf, "documents").select("doc_id", F.explode(found).alias("phrase"))


def html_row_extract(spark, sf):
    """Paragraphs, headings and list items in order, without the tags inside."""
    return html.elements(read(spark, sf, "pages").select("page_id", "html")).select("page_id", "pos", "text")


def chat_export(spark, sf):
    """Conversations with their message count, characters, and whether users and assistants alternate from a user on."""
    rows = read(spark, sf, "conversations")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    bad = F.when(F.col("role") == "user", before == "user").when(F.col("role") == "assistant", F.coalesce(before, F.lit("none")) != "user").otherwise(before.isNotNull())
    marked = rows.withColumn("bad", F.coalesce(bad, F.lit(False)))
    return marked.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), (~F.bool_or("bad")).alias("valid"))


def token_preflight(spark, sf):
    sizes = read(spark, sf, "conversations").groupBy("conv_id").agg(F.expr("(sum(length(text)) + 3) div 4").alias("tokens"))
    return sizes.agg(F.max("tokens").alias("max_tokens"), F.sum("tokens").alias("all_tokens"), F.count_if(F.col("tokens") > 512).alias("too_long"), F.count("*").alias("n"))


def canonical_selection(spark, sf):
    """Per source the canonical document: the longest English one, else the longest; ties to the smallest id."""
    key = F.struct((F.col("lang") == "en").cast("int"), F.col("n_chars"), -F.col("doc_id"))
    out = read(spark, sf, "documents").groupBy("source").agg(F.max_by(F.struct("doc_id", "lang"), key).alias("d"), F.count_if(F.col("lang") == "en").alias("n_en"))
    return out.select("source", "d.doc_id", "d.lang", checks.first_failing((F.col("n_en") > 1, "preferred_among_many"), (F.col("n_en") == 1, "preferred"), default="fallback").alias("basis"))


NAMES = "exact_text_hash_groups duplicate_keys split_assign_hash split_apportion cross_split_leakage identity_components reserved_collision group_manifest source_manifest nested_counts multi_grouping distinct_groups_by_split oversample_minority confusion_matrix class_metrics macro_f1 false_positive_rejection metrics_by_group threshold_gate quality_reason_codes profile_markers prohibited_phrase_scan html_row_extract chat_export token_preflight canonical_selection".split()
QUERIES = {name: globals()[name] for name in NAMES}

_NORM = r"trim(regexp_replace(lower({0}), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_HASH = f"sha256({_NORM.format('text')})"
_SPLIT = "WITH h AS (SELECT *, CAST('0x' || substring(sha256('17|' || doc_id), 1, 8) AS BIGINT) % 100 AS spot FROM documents), s AS (SELECT *, CASE WHEN spot < 80 THEN 'train' WHEN spot < 90 THEN 'validation' ELSE 'test' END AS split FROM h)"
_EVAL = "WITH p AS (SELECT quality AS gold, lang, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"
_RATE = "CASE WHEN {1} > 0 THEN ({0} * 20000 + {1}) // (2 * {1}) END"
_CLASS = f"""{_EVAL}, c AS (
  SELECT label, CAST(sum(CASE WHEN gold = label AND predicted = label THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN gold <> label AND predicted = label THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN gold = label AND predicted <> label THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM p CROSS JOIN (SELECT 0 AS label UNION ALL SELECT 1 UNION ALL SELECT 2) GROUP BY label),
m AS (SELECT *, {_RATE.format('tp', '(tp + fp)')} AS precision_bp, {_RATE.format('tp', '(tp + fn)')} AS recall_bp, {_RATE.format('(2 * tp)', '(2 * tp + fp + fn)')} AS f1_bp FROM c)"""
_SUM = "CAST(sum(CASE WHEN {0} THEN 1 ELSE 0 END) AS BIGINT)"

SQL = {
    "exact_text_hash_groups": f"SELECT {_HASH} AS hash, min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY 1",
    "duplicate_keys": "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "split_assign_hash": f"{_SPLIT} SELECT doc_id, split FROM s",
    "split_apportion": "WITH t AS (SELECT count(*) AS n FROM documents), b AS (SELECT i, split, n * p // 100 AS base, n * p % 100 AS rest, n FROM t CROSS JOIN (SELECT 0 AS i, 'train' AS split, 80 AS p UNION ALL SELECT 1, 'validation', 10 UNION ALL SELECT 2, 'test', 10)) SELECT split, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, split DESC) <= n - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS n FROM b",
    "cross_split_leakage": f"{_SPLIT} SELECT {_HASH} AS hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "identity_components": f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
i AS (SELECT doc_id, {_HASH} AS identity FROM documents UNION SELECT doc_id, sha256({_NORM.format('line')}) FROM l WHERE length(line) >= 200),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM i a JOIN i b ON a.identity = b.identity),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a)
SELECT node AS doc_id, min(c) AS component FROM r GROUP BY node""",
    "reserved_collision": "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)",
    "group_manifest": f"{_SPLIT} SELECT {_HASH} AS hash, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1",
    "source_manifest": "SELECT source, min(doc_id) AS first_doc, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source",
    "nested_counts": f"{_SPLIT} SELECT split, lang, count(*) AS n FROM s GROUP BY split, lang",
    "multi_grouping": f"{_SPLIT} SELECT split, '*' AS lang, count(*) AS n FROM s GROUP BY split UNION ALL SELECT '*', lang, count(*) FROM s GROUP BY lang UNION ALL SELECT split, lang, count(*) FROM s GROUP BY split, lang UNION ALL SELECT '*', '*', count(*) FROM s",
    "distinct_groups_by_split": f"{_SPLIT} SELECT split, count(DISTINCT {_HASH}) AS groups, count(DISTINCT source) AS sources FROM s GROUP BY split",
    "oversample_minority": "WITH f AS (SELECT greatest(1, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) // greatest(1, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END))) AS m FROM labels) SELECT doc_id, toxic, CAST(copy AS INTEGER) AS copy FROM (SELECT doc_id, toxic, unnest(range(1, CASE WHEN toxic = 1 THEN CAST(m AS BIGINT) ELSE 1 END + 1)) AS copy FROM labels CROSS JOIN f)",
    "confusion_matrix": f"{_EVAL} SELECT gold, predicted, count(*) AS n FROM p GROUP BY gold, predicted",
    "class_metrics": f"{_CLASS} SELECT * FROM m",
    "macro_f1": f"{_CLASS} SELECT CAST(sum(f1_bp) // count(f1_bp) AS BIGINT) AS macro_f1_bp, count(f1_bp) AS classes FROM m",
    "false_positive_rejection": f"{_EVAL}, c AS (SELECT {_SUM.format('gold = 0')} AS negatives, {_SUM.format('gold = 0 AND predicted = 0')} AS rejected FROM p) SELECT *, {_RATE.format('rejected', 'negatives')} AS rate_bp FROM c",
    "metrics_by_group": f"{_EVAL}, c AS (SELECT lang, count(*) AS n, {_SUM.format('gold = predicted')} AS exact FROM p GROUP BY lang) SELECT *, {_RATE.format('exact', 'n')} AS rate_bp FROM c",
    "threshold_gate": f"{_CLASS} SELECT label, coalesce(precision_bp >= 7000, false) AS precision_ok, coalesce(recall_bp >= 7000, false) AS recall_ok, coalesce(precision_bp >= 7000, false) AND coalesce(recall_bp >= 7000, false) AS passed FROM m",
    "quality_reason_codes": "WITH d AS (SELECT documents.doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id) SELECT doc_id, 'short' AS reason FROM d WHERE n_chars < 100 UNION ALL SELECT doc_id, 'unlabelled' FROM d WHERE quality IS NULL UNION ALL SELECT doc_id, 'low_quality' FROM d WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic' FROM d WHERE toxic = 1 UNION ALL SELECT doc_id, 'eligible' FROM d WHERE n_chars >= 100 AND quality = 1 AND toxic = 0",
    "profile_markers": f"SELECT * FROM (SELECT doc_id, {' + '.join(f'''CASE WHEN contains(lower(text), '{m}') THEN 1 ELSE 0 END''' for m in ('license', 'copyright', 'http', '@', 'version'))} AS markers FROM documents) WHERE markers >= 2",
    "prohibited_phrase_scan": "SELECT doc_id, phrase FROM documents JOIN (SELECT 'all rights reserved' AS phrase UNION ALL SELECT 'licensed under' UNION ALL SELECT 'password' UNION ALL SELECT 'secret') ON contains(lower(text), phrase)",
    "html_row_extract": f"WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:p|li|h[1-6])(?: [^>]*)?>(.*?)</(?:p|li|h[1-6])>', 1) AS l FROM pages) SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {_TEXT.format('l[i]')} AS text FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM x)",
    "chat_export": "WITH x AS (SELECT conv_id, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, count(*) AS n_messages, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(CASE WHEN CASE WHEN role = 'user' THEN coalesce(b = 'user', false) WHEN role = 'assistant' THEN coalesce(b, 'none') <> 'user' ELSE b IS NOT NULL END THEN 1 ELSE 0 END) = 0 AS valid FROM x GROUP BY conv_id",
    "token_preflight": "WITH s AS (SELECT conv_id, CAST((sum(length(text)) + 3) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id) SELECT max(tokens) AS max_tokens, CAST(sum(tokens) AS BIGINT) AS all_tokens, CAST(sum(CASE WHEN tokens > 512 THEN 1 ELSE 0 END) AS BIGINT) AS too_long, count(*) AS n FROM s",
    "canonical_selection": "SELECT source, doc_id, lang, CASE WHEN e > 1 THEN 'preferred_among_many' WHEN e = 1 THEN 'preferred' ELSE 'fallback' END AS basis FROM (SELECT *, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS e, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 1 ELSE 0 END DESC, n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1",
}
