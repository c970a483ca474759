"""Queries of markers in texts: pages' tags with their places, orders' tables by profile, source documents by their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import dialects, markers
from riskweave.plans import filings
from riskweave.plans.texts import _ROLE, language_sql, profile_sql
from riskweave.sources.tables import read

PAGE = ("<script", "<style", "<nav", "<li", "<li>", "<article", "<a href=", "href", "<br>", "&amp;", "&nbsp;", "<footer", "<table", "<img", "cookie", "</p>", "</p></p>")


def page_markers(spark, sf):
    """Which of the markers every page holds, and where each first is."""
    found = read(spark, sf, "pages").select("page_id", F.explode(markers.found_in(F.col("html"), PAGE)).alias("m"))
    return found.select("page_id", "m.marker", "m.at")


def inferred_profiles(spark, sf):
    """Orders' tables by the profile that their cells' words tell."""
    rows = filings._raw_rows(spark, sf).select("doc", F.lower(F.array_join("cells", " ")).alias("text"))
    found = rows.withColumn("found", markers.found_in(F.col("text"), markers.PROFILE))
    # What a table's rows hold is gathered as markers, a few words each, and not as text.
    held = found.select("doc", F.explode_outer("found.marker").alias("marker")).groupBy("doc").agg(F.collect_set("marker").alias("m"))
    return held.select("doc", markers.profile(F.transform("m", lambda m: F.struct(m.alias("marker")))).alias("profile"), F.size("m").cast("long").alias("markers"))


# Titles of source documents, by the first digit of their order's priority and its status.
TITLES = {"1": "Báo cáo tài chính riêng", "2": "Consolidated financial statements", "3": "Công bố thông tin của Công ty", "4": "Giải trình chênh lệch lợi nhuận", "5": "Thuyết minh điều chỉnh"}
ENDS = {"F": "đã được kiểm toán", "O": "đã soát xét, thay thế toàn bộ", "P": "reviewed and amended (bổ sung)"}


def _documents(spark, sf) -> DataFrame:
    names = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment"))
    pick = lambda c, d: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in d.items()))
    title = F.concat_ws(" ", pick(F.substring("o_orderpriority", 1, 1), TITLES), "customer", pick(F.col("o_orderstatus"), ENDS))
    return read(spark, sf, "orders").join(names, "o_custkey").select("o_orderkey", title.alias("title"), "segment", "o_totalprice")


def source_classification(spark, sf):
    """Orders' titles as source documents: role, language, basis, assurance, hints and how sure the classification is."""
    docs = _documents(spark, sf).withColumn("found", markers.found_in(dialects.normalised(F.col("title"), "fetched"), markers.SOURCE))
    f = F.col("found")
    evidence = F.when(F.col("o_totalprice") < 30000, "none").when(F.col("o_totalprice") < 90000, "low").otherwise("medium")
    docs = docs.withColumn("role", markers.role(f))
    joined = lambda c: F.array_join(c, ",")
    sure = markers.confidence(F.col("role"), f, F.col("segment") != "FURNITURE", evidence)
    return docs.select("o_orderkey", "role", markers.language(f).alias("language"), joined(markers.clues(f, markers.BASES)).alias("bases"), joined(markers.clues(f, markers.ASSURANCE)).alias("assurance"), joined(markers.amendment_hints(f)).alias("hints"), sure.alias("confidence_pct"))


NAMES = "page_markers inferred_profiles source_classification".split()
QUERIES = {name: globals()[name] for name in NAMES}
_IN = lambda text, names: "(" + " OR ".join(f"contains({text}, '{m}')" for m in names) + ")"
_CLUES = lambda lists: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_IN('t', ms)} THEN '{name}' END" for name, ms in lists.items()) + "], lambda x: x IS NOT NULL), ',')"
_CELLS = filings._RAWROWS[: filings._RAWROWS.index("x AS (")].rstrip().rstrip(",")
_LABELS = ", ".join(f"'{t}'" for _, t in filings.RAW)

SQL = {
    "page_markers": f"SELECT page_id, marker, CAST(strpos(html, marker) - 1 AS INTEGER) AS \"at\" FROM pages, (SELECT unnest([{', '.join(f'''{chr(39)}{m}{chr(39)}''' for m in PAGE)}]) AS marker) WHERE strpos(html, marker) > 0",
    "inferred_profiles": f"{_CELLS}, t AS (SELECT l_orderkey AS doc, string_agg(lower([{_LABELS}][k + 1]), ' ') AS t FROM l GROUP BY 1) SELECT doc, {profile_sql('t')} AS profile, CAST({' + '.join(f'''CAST(contains(t, '{m}') AS INTEGER)''' for m in markers.PROFILE)} AS BIGINT) AS markers FROM t",
    "source_classification": f"""WITH d AS (SELECT o_orderkey, o_totalprice, c_mktsegment AS segment, replace(lower(strip_accents(CASE substring(o_orderpriority, 1, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items())} END || ' ' || c_name || ' ' || CASE o_orderstatus {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDS.items())} END)), 'đ', 'd') AS t FROM orders JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, {_ROLE.format('t')} AS role FROM d)
SELECT o_orderkey, role, {language_sql('t')} AS language, {_CLUES(markers.BASES)} AS bases, {_CLUES(markers.ASSURANCE)} AS assurance, array_to_string(list_slice(list_filter(['dieu chinh', 'bo sung', 'sua doi', 'thay the', 'adjusted', 'amended'], lambda m: contains(t, m)), 1, 4), ',') AS hints,
  CASE WHEN segment = 'FURNITURE' OR o_totalprice < 30000 THEN CASE WHEN role = 'financial_statement' AND {_IN('t', ('bao cao tai chinh', 'bctc'))} THEN 60 ELSE 0 END WHEN o_totalprice < 90000 THEN 45 WHEN role <> 'out_of_scope' THEN 86 ELSE 60 END AS confidence_pct FROM r""",
}
