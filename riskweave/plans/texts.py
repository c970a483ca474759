"""Queries of the text dialects over documents, pages, conversations, benchmark items, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions import dialects as d
from riskweave.functions import markers
from riskweave.functions import text as t
from riskweave.sources.tables import read


def normalised_dialects(spark, sf):
    """A digest of every document's text in four dialects."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", *(F.sha2(d.normalised(F.col("text"), m), 256).alias(m) for m in ("mapper", "assembler", "selection", "fetched")))


def normalised_lengths(spark, sf):
    """Characters left by the other dialects, summed by language."""
    docs = read(spark, sf, "documents").select("lang", "text")
    sums = [F.sum(F.length(d.normalised(F.col("text"), m))).cast("long").alias(m) for m in ("classifier", "evidence", "discovery")]
    return docs.groupBy("lang").agg(*sums)


def whole_amounts(spark, sf):
    """Words with digits read as whole amounts: how many are, how many aren't, and their sum, by source."""
    words = read(spark, sf, "documents").select("source", F.explode(F.split("text", "[ \n\t\r]+")).alias("word")).where(F.col("word").rlike("[0-9]"))
    value = d.whole_amount(F.col("word"))
    return words.select("source", value.alias("v")).groupBy("source").agg(F.count("v").alias("amounts"), F.count_if(F.col("v").isNull()).alias("others"), F.sum((F.col("v") % 1000003).cast("long")).cast("long").alias("checksum"))


def narrative_numbers(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", d.number_tokens(F.col("text")).alias("n"))
    return docs.where(F.size("n") > 0).select("doc_id", F.array_join("n", " ").alias("numbers"))


def note_references(spark, sf):
    """Note numbers written in capitals, in numerals and with noise, and what they come to."""
    p = read(spark, sf, "part")
    sign = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XL", "A", "b"))), (F.col("p_size") % 13 + 1).cast("int"))
    shown = F.concat(F.lit("Note "), sign, F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 3, "0"), F.lit(" *"))
    return p.select("p_partkey", d.note_reference(F.regexp_replace(shown, "^Note ", "")).alias("note"), d.roman(sign).cast("long").alias("major"))


def sentence_counts(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", d.sentence_count(F.col("text")).cast("long").alias("sentences"), (d.sentence_count(F.col("text")) > 3).alias("too_long"))


def fenced_json(spark, sf):
    """Answers in a fence, or not, read back as JSON in canonical form and unwrapped."""
    e = read(spark, sf, "events").select("event_id", "event_type", "props")
    fence = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    read_back = d.canonical_json(d.without_fence(fence))
    return e.select("event_id", F.sha2(read_back, 256).alias("digest"), F.get_json_object(read_back, "$.k").cast("long").alias("k"))


def document_roles(spark, sf):
    """Roles, amendment hints, language and profile of every document from one scan of its normalised text."""
    docs = read(spark, sf, "documents").select("doc_id", d.normalised(F.col("text"), "fetched").alias("n"))
    docs = docs.withColumn("found", markers.found_in(F.col("n"), (*markers.SOURCE, *markers.PROFILE)))
    f = F.col("found")
    return docs.select("doc_id", markers.role(f).alias("role"), F.array_join(markers.amendment_hints(f), ",").alias("hints"), markers.language(f).alias("language"), markers.profile(f).alias("profile"), d.is_vietnamese(F.col("n")).alias("vietnamese"))


def role_counts(spark, sf):
    """Roles of conversations' turns, which speak of explanations and the like more than documents do."""
    found = read(spark, sf, "conversations").select(markers.found_in(F.lower("text"), (*markers.SOURCE, *markers.PROFILE)).alias("found"))
    return found.groupBy(markers.role(F.col("found")).alias("role"), markers.language(F.col("found")).alias("language")).agg(F.count("*").alias("n"))


def grouped_amounts(spark, sf):
    """Balances written with commas, and with dots, and read back."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    c = read(spark, sf, "customer").select("c_custkey", cents.alias("cents"))
    return c.select("c_custkey", d.grouped(F.col("cents")).alias("comma"), d.grouped(F.col("cents"), ".").alias("dot"), d.whole_amount(d.grouped(F.col("cents"), ".")).cast("long").alias("back"))


def page_texts(spark, sf):
    """Pages as one line of text each, with an excerpt for a table cell."""
    p = read(spark, sf, "pages").select("page_id", d.html_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"), d.markdown(d.excerpt(F.col("t"), 120)).alias("cell"))


def page_segments(spark, sf):
    """Pages cut at their second-level headings: segments with their place, heading and size."""
    parts = F.split("html", "<h2[^>]*>")
    p = read(spark, sf, "pages").select("page_id", F.posexplode(parts).alias("pos", "part"))
    heading = F.when(F.col("pos") > 0, d.html_text(F.substring_index("part", "</h2>", 1)))
    return p.select("page_id", "pos", heading.alias("heading"), F.length("part").cast("long").alias("chars"))


def tokens_and_titles(spark, sf):
    """Names as upper tokens and as titles of their snake case."""
    p = read(spark, sf, "part").select("p_partkey", "p_type")
    token = d.upper_token(F.col("p_type"))
    return p.select("p_partkey", token.alias("token"), d.title(F.lower(token)).alias("title"))


def run_seconds(spark, sf):
    """Seconds from each event of a user to the next one, never below 0, by kind."""
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    e = read(spark, sf, "events").select("event_type", "ts", after.alias("next"))
    return e.groupBy("event_type").agg(F.sum(d.seconds_between(F.col("ts"), F.col("next"))).cast("long").alias("seconds"), F.count("next").alias("n"))


def prior_periods(spark, sf):
    """Of every order's quarter: the one before, and the same a year before."""
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    rows = read(spark, sf, "orders").select(d.quarters_before(y, q, 0).alias("period"), d.quarters_before(y, q, 1).alias("before"), d.quarters_before(y, q, 4).alias("prior_year"))
    return rows.groupBy("period", "before", "prior_year").agg(F.count("*").alias("n"))


def intent_clues(spark, sf):
    """What a request asks for: ticker, quarter, year and basis out of free text."""
    o = read(spark, sf, "orders")
    letter = lambda step: F.char(97 + F.floor(F.col("o_custkey") % 5 / step) % 26)
    asked = F.concat(F.lit("please check "), letter(676), letter(26), letter(1), F.lit(" for q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderstatus") == "O", " consolidated").when(F.col("o_orderstatus") == "F", " parent company").otherwise(""))
    ticker = F.upper(F.regexp_extract(asked, r"(?i)check ([a-z]{3}) ", 1))
    basis = F.when(asked.contains("consolidated"), "consolidated").when(asked.contains("parent"), "parent").otherwise("unspecified")
    return o.select(ticker.alias("ticker"), F.coalesce(t.period(F.regexp_replace(asked, r"q([1-4]) (\d{4})", "q$1/$2")), F.lit("none")).alias("period"), basis.alias("basis")).groupBy("ticker", "period", "basis").agg(F.count("*").alias("n"))


NAMES = "normalised_dialects normalised_lengths whole_amounts narrative_numbers note_references sentence_counts fenced_json document_roles role_counts grouped_amounts page_texts page_segments tokens_and_titles run_seconds prior_periods intent_clues".split()
QUERIES = {name: globals()[name] for name in NAMES}

_FOLD = "replace(lower(strip_accents(text)), 'ß', 'ss')"
_FETCHED = "replace(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'), 'đ', 'd')"
_ROLE = """CASE WHEN contains({0}, 'business overview') OR contains({0}, 'tong quan tinh hinh kinh doanh') THEN 'business_overview'
  WHEN contains({0}, 'cong bo thong tin') OR contains({0}, 'information disclosure') THEN 'cover_or_disclosure'
  WHEN (contains({0}, 'thuyet minh') OR contains({0}, 'dieu chinh')) AND NOT (contains({0}, 'thay the toan bo') OR contains({0}, 'full replacement')) THEN 'amendment_context_attachment'
  WHEN contains({0}, 'giai trinh') OR contains({0}, 'explanation') THEN 'variance_explanation'
  WHEN contains({0}, 'bao cao tai chinh') OR contains({0}, 'financial statement') OR contains({0}, 'bctc') THEN 'financial_statement' ELSE 'out_of_scope' END"""


def _any_sql(text: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in names) + ")"


def language_sql(text: str) -> str:
    vi, en = _any_sql(text, markers.VIETNAMESE), _any_sql(text, markers.ENGLISH)
    return f"CASE WHEN {vi} AND {en} THEN 'mixed' WHEN {en} THEN 'en' WHEN {vi} OR {_any_sql(text, ('bao cao', 'cong bo', 'bctc'))} THEN 'vi' ELSE 'unknown' END"


def profile_sql(text: str) -> str:
    count = " + ".join(f"CAST(contains({text}, '{m}') AS INTEGER)" for m in markers.STANDARD)
    return f"CASE WHEN {_any_sql(text, markers.INSURANCE)} THEN 'insurance' WHEN {_any_sql(text, markers.SECURITIES)} THEN 'securities' WHEN {count} >= 3 THEN 'standard_corporate' ELSE 'unknown' END"


_WHOLE = "CASE WHEN regexp_full_match({c}, '-?[0-9]{{1,38}}') THEN CASE WHEN trim({0}) LIKE '(%)' THEN -1 ELSE 1 END * CAST({c} AS HUGEINT) END"
_CLEAN = "replace(replace(regexp_replace(trim({0}), '^[()]+|[()]+$', '', 'g'), '.', ''), ',', '')"
_NUMBER = """CASE WHEN contains(x, '.') AND contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.')
  WHEN contains(x, ',') THEN CASE WHEN regexp_full_match(x, '[^,]*,[0-9]{1,2}') THEN replace(x, ',', '.') WHEN regexp_full_match(x, '[^,]*(,[0-9]{3})+') THEN replace(x, ',', '') ELSE replace(x, ',', '.') END
  WHEN contains(x, '.') THEN CASE WHEN regexp_full_match(x, '[^.]*(\\.[0-9]{3}){2,}') OR regexp_full_match(x, '[^.]{1,3}\\.[0-9]{3}') THEN replace(x, '.', '') ELSE x END ELSE x END"""
_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"

SQL = {
    "normalised_dialects": f"WITH n AS (SELECT doc_id, text, {_FOLD} AS f FROM documents) SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(replace(trim(f), 'đ', 'd'), '[^\\pL\\pN_\\s.]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS mapper, sha256(trim(regexp_replace(regexp_replace(trim(f), '[^\\pL\\pN_\\s.]+', ' ', 'g'), '\\s+', ' ', 'g'), ' .')) AS assembler, sha256(trim(lower(regexp_replace(regexp_replace(strip_accents(text), '[^a-zA-Z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')))) AS selection, sha256({_FETCHED}) AS fetched FROM n",
    "normalised_lengths": "SELECT lang, CAST(sum(length(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS BIGINT) AS classifier, CAST(sum(length(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS BIGINT) AS evidence, CAST(sum(length(trim(regexp_replace(strip_accents(text), '[^a-zA-Z0-9]+', ' ', 'g')))) AS BIGINT) AS discovery FROM documents GROUP BY lang",
    "whole_amounts": f"WITH w AS (SELECT source, unnest(string_split_regex(text, '[ \\n\\t\\r]+')) AS word FROM documents), c AS (SELECT source, word, {_CLEAN.format('word')} AS c FROM w WHERE regexp_matches(word, '[0-9]')), v AS (SELECT source, {_WHOLE.format('word', c='c')} AS v FROM c) SELECT source, count(v) AS amounts, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS others, CAST(sum(v % 1000003) AS BIGINT) AS checksum FROM v GROUP BY source",
    "narrative_numbers": f"""WITH c AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS chunk FROM (SELECT doc_id, string_split_regex(text, '[^\\pL\\pN\\pM_.,-]+') AS l FROM documents)),
p AS (SELECT doc_id, i, unnest(range(1, len(q) + 1)) AS j, unnest(q) AS part, unnest(list_prepend('x', q)[1:len(q)]) AS before FROM (SELECT doc_id, i, string_split(chunk, '-') AS q FROM c)),
m AS (SELECT doc_id, i, j, CASE WHEN j > 1 AND before = '' THEN '-' ELSE '' END || regexp_extract(part, '^([0-9]+(?:[.,][0-9]+)*)(?:$|[.,]$|[.,][^0-9])', 1) AS x FROM p),
k AS (SELECT doc_id, i, j, {_NUMBER} AS x FROM m WHERE x NOT IN ('', '-')),
b AS (SELECT doc_id, i, j, 0 AS s, x FROM k UNION ALL SELECT doc_id, i, j, 1, substring(x, 2) FROM k WHERE x LIKE '-%'),
f AS (SELECT doc_id, x, min(i * 1000000 + j * 2 + s) AS spot FROM b GROUP BY doc_id, x)
SELECT doc_id, string_agg(x, ' ' ORDER BY spot) AS numbers FROM f GROUP BY doc_id""",
    "note_references": "WITH s AS (SELECT p_partkey, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XL', 'A', 'b'][CAST(p_size % 13 + 1 AS INTEGER)] AS sign, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 40, NULL, NULL][CAST(p_size % 13 + 1 AS INTEGER)] AS major FROM part) SELECT p_partkey, coalesce(CAST(major AS VARCHAR), lower(sign)) || '.' || CAST(p_partkey % 100 AS VARCHAR) AS note, CAST(major AS BIGINT) AS major FROM s",
    "sentence_counts": "WITH s AS (SELECT item_id, CAST(len(list_filter(string_split_regex(regexp_replace(regexp_replace(text, '([0-9])\\.([0-9])', '\\1<DECIMAL>\\2', 'g'), '([0-9])\\.([0-9])', '\\1<DECIMAL>\\2', 'g'), '[.!?]+'), lambda x: trim(x) <> '')) AS BIGINT) AS sentences FROM benchmark) SELECT *, sentences > 3 AS too_long FROM s",
    "fenced_json": "SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS digest, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "document_roles": f"WITH n AS (SELECT doc_id, {_FETCHED} AS n FROM documents) SELECT doc_id, {_ROLE.format('n')} AS role, array_to_string(list_slice(list_filter(['dieu chinh', 'bo sung', 'sua doi', 'thay the', 'adjusted', 'amended'], lambda m: contains(n, m)), 1, 4), ',') AS hints, {language_sql('n')} AS language, {profile_sql('n')} AS profile, regexp_matches(n, '[ăâđêôơư]') AS vietnamese FROM n",
    "role_counts": f"WITH n AS (SELECT lower(text) AS n FROM conversations) SELECT {_ROLE.format('n')} AS role, {language_sql('n')} AS language, count(*) AS n FROM n GROUP BY 1, 2",
    "grouped_amounts": "WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer), f AS (SELECT c_custkey, cents, format('{:,}', abs(cents)) AS s FROM c) SELECT c_custkey, CASE WHEN cents < 0 THEN '(' || s || ')' ELSE s END AS comma, CASE WHEN cents < 0 THEN '(' || replace(s, ',', '.') || ')' ELSE replace(s, ',', '.') END AS dot, cents AS back FROM f",
    "page_texts": f"WITH p AS (SELECT page_id, {_TEXT.format('html')} AS t FROM pages) SELECT page_id, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS digest, replace(CASE WHEN length(t) > 120 THEN rtrim(substring(t, 1, 117)) || '...' ELSE t END, '|', '\\|') AS cell FROM p",
    "page_segments": f"WITH p AS (SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS part FROM (SELECT page_id, string_split_regex(html, '<h2[^>]*>') AS l FROM pages)) SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos > 0 THEN {_TEXT.format('''string_split(part, '</h2>')[1]''')} END AS heading, CAST(length(part) AS BIGINT) AS chars FROM p",
    "tokens_and_titles": "WITH k AS (SELECT p_partkey, trim(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '_') AS token FROM part) SELECT p_partkey, token, array_to_string(list_transform(string_split(lower(token), '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM k",
    "run_seconds": "WITH e AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT event_type, CAST(sum(greatest(0, CAST(floor(epoch(n)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT))) FILTER (WHERE n IS NOT NULL) AS BIGINT) AS seconds, count(n) AS n FROM e GROUP BY event_type",
    "prior_periods": "WITH s AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS p FROM orders) SELECT CAST(p // 4 AS VARCHAR) || '-Q' || CAST(p % 4 + 1 AS VARCHAR) AS period, CAST((p - 1) // 4 AS VARCHAR) || '-Q' || CAST((p - 1) % 4 + 1 AS VARCHAR) AS before, CAST((p - 4) // 4 AS VARCHAR) || '-Q' || CAST((p - 4) % 4 + 1 AS VARCHAR) AS prior_year, count(*) AS n FROM s GROUP BY p",
    "intent_clues": "SELECT 'AA' || chr(CAST(65 + o_custkey % 5 AS INTEGER)) AS ticker, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, CASE o_orderstatus WHEN 'O' THEN 'consolidated' WHEN 'F' THEN 'parent' ELSE 'unspecified' END AS basis, count(*) AS n FROM orders GROUP BY 1, 2, 3",
}
