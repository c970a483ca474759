"""Queries of cached sources and of documents linked by the names in them: customers' quarters are filings, pages documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import dialects
from riskweave.operators import dataset, linking, safety
from riskweave.sources.tables import read

CACHED, LATEST = 45, 2


def _slots(spark, sf) -> DataFrame:
    """Filings of a nation's segment and quarter, as cached (their first order) and as they are now (by their lines)."""
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("final"), F.min(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= CACHED), F.col("l_partkey"))).alias("corrected")
    )
    orders = read(spark, sf, "orders").join(customers, "o_custkey").join(lines, "o_orderkey", "left")
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "year", "quarter").orderBy("o_orderdate", "o_orderkey"))
    orders = orders.withColumns({"year": F.year("o_orderdate"), "quarter": F.quarter("o_orderdate")}).withColumn("superseded", later.isNotNull())
    key = F.col("o_orderkey").cast("string")
    print_of = F.when(F.col("o_totalprice") >= 20000, F.sha2("o_orderpriority", 256))
    has_lines = F.col("lines").isNotNull()
    at = F.struct("lines", "o_orderkey")
    per = orders.groupBy("nation", "segment", "year", "quarter").agg(
        F.min_by(F.struct(key.alias("source_id"), print_of.alias("fingerprint"), F.col("o_orderstatus").alias("filing_status")), F.struct("o_orderdate", "o_orderkey")).alias("cached"),
        F.max_by(F.struct(key.alias("canonical_id"), F.sha2("o_orderpriority", 256).alias("fingerprint"), "lines", "final", "corrected"), F.when(has_lines, at)).alias("now"),
        F.collect_list("lines").alias("sizes"),
        F.array_sort(F.collect_list(F.when(F.col("superseded"), key))).alias("superseded"),
    )
    ties = F.size(F.filter("sizes", lambda n: n == F.array_max("sizes")))
    nothing = lambda kind: F.lit(None).cast(kind)
    now = lambda n: F.col(f"now.{n}")
    status = F.when(ties > 1, "ambiguous").when(now("final") == 0, "missing").otherwise("selected")
    filed = F.when(now("final") == now("lines"), "F").otherwise("P")
    refreshed = F.struct(
        status.alias("status"), now("fingerprint").alias("fingerprint"), now("canonical_id").alias("canonical_id"), F.when(now("lines") > 1, filed).alias("filing_status"), "superseded",
        now("corrected").cast("string").alias("corrected_source_id"), *(nothing("string").alias(n) for n in safety.CORRECTIONS[1:]), *(nothing("boolean").alias(n) for n in safety.FLAGS),
    )
    asked = read(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("nation")).distinct().withColumn("refreshable", F.lit(True))
    own = per.join(asked, "nation", "left").select("nation", "segment", "year", "quarter", "cached", F.when(now("canonical_id").isNotNull(), refreshed).alias("refreshed"), "refreshable")
    name = lambda year: F.concat_ws("-", F.col("nation").cast("string"), "segment", year.cast("string"), F.col("quarter").cast("string"))
    prior = own.select(name(F.col("year") + 1).alias("case"), F.lit(1).alias("role"), "year", "quarter", "cached", "refreshed", "refreshable")
    target = own.select(name(F.col("year")).alias("case"), F.lit(0).alias("role"), "year", "quarter", "cached", "refreshed", "refreshable")
    return target.union(prior.join(target.select("case"), "case", "left_semi"))


def source_safety(spark, sf):
    """Filings with their prior years: whether what is cached may be reused, by the ten checks in order."""
    slots = _slots(spark, sf)
    last = read(spark, sf, "orders").agg(F.max(F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1)).first()[0]
    return safety.source_safety(slots, [] if last is None else [((last - i) // 4, (last - i) % 4 + 1) for i in range(LATEST)])


def _titled(spark, sf) -> DataFrame:
    """Pages with the name that their host begins with, language and normalised text."""
    pages = read(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)
    name = F.regexp_extract(F.regexp_replace(host, r"^(m|www)\.", ""), r"^([a-z]+)", 1)
    text = F.regexp_replace("html", "<[^>]*>", " ")
    return pages.select(F.col("page_id").alias("id"), name.alias("name"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("language"), dialects.normalised(text, "selection").alias("text"))


def supporting_links(spark, sf):
    """Pages whose texts speak of a host, linked to the first of the host's own pages: same language, host's name in both."""
    pages, _ = dataset._cut(_titled(spark, sf))  # texts are normalised once for all their uses
    found = linking.contained(pages.select("id", "text"), pages.select("name"))
    role = F.when(F.length("text") % 2 == 0, "amendment_context_attachment").otherwise("variance_explanation")
    documents = pages.select("id", role.alias("role"), "language", F.lit("parent").alias("basis"))
    in_own = found.join(pages.select("id", F.col("name").alias("own")), "id").where("name = own")
    first = in_own.groupBy("name").agg(F.min("id").alias("canonical"))
    packages = first.select(F.col("name").alias("package"), "canonical", F.array("name").alias("names"), F.lit("separate").alias("basis"))
    return linking.supporting_links(documents, packages, found)


NAMES = "source_safety supporting_links".split()
QUERIES = {name: globals()[name] for name in NAMES}

_TITLED = r"""t AS (SELECT page_id AS id, regexp_extract(regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^(m|www)\.', ''), '^([a-z]+)', 1) AS name, regexp_extract(html, 'lang="([a-z]+)"', 1) AS language,
  trim(lower(regexp_replace(regexp_replace(strip_accents(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[^a-zA-Z0-9]+', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages)"""

SQL = {
    "source_safety": f"""WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_linestatus = 'F') AS final, min(l_partkey) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= {CACHED}) AS corrected FROM lineitem GROUP BY 1),
o AS (SELECT *, year(o_orderdate) AS y, quarter(o_orderdate) AS q, lead(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate, o_orderkey) IS NOT NULL AS superseded FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey),
p AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, y, q, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS old, arg_max(o_orderkey, (lines, o_orderkey)) FILTER (WHERE lines IS NOT NULL) AS new, max(lines) AS most, list(lines) AS sizes, coalesce(list(o_orderkey) FILTER (WHERE superseded), []) AS gone FROM o GROUP BY 1, 2, 3, 4),
f AS (SELECT p.nation, segment, y, q, CASE
  WHEN nation NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) THEN 0 WHEN new IS NULL THEN 1 WHEN len(list_filter(sizes, lambda n: n = most)) > 1 THEN 2 WHEN n.final = 0 THEN 3
  WHEN c.o_totalprice < 20000 THEN 4 WHEN c.o_orderpriority <> r.o_orderpriority THEN 5 WHEN old <> new THEN 6 WHEN n.lines > 1 AND c.o_orderstatus <> CASE WHEN n.final = n.lines THEN 'F' ELSE 'P' END THEN 7
  WHEN list_contains(gone, old) THEN 8 WHEN n.corrected IS NOT NULL THEN 9 END AS failed
  FROM p JOIN orders c ON c.o_orderkey = old LEFT JOIN orders r ON r.o_orderkey = new LEFT JOIN l n ON n.l_orderkey = new),
m AS (SELECT max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS last FROM orders),
s AS (SELECT nation || '-' || segment || '-' || y || '-' || q AS c, 0 AS role, CASE WHEN y * 4 + q - 1 > last - {LATEST} THEN failed END AS failed FROM f, m UNION ALL
  SELECT nation || '-' || segment || '-' || (y + 1) || '-' || q, 1, CASE WHEN y * 4 + q - 1 > last - {LATEST} THEN failed END FROM f, m WHERE EXISTS (SELECT 1 FROM f x WHERE x.nation = f.nation AND x.segment = f.segment AND x.y = f.y + 1 AND x.q = f.q)),
g AS (SELECT c, min(role) FILTER (WHERE failed IS NOT NULL) AS role, arg_min(failed, role) FILTER (WHERE failed IS NOT NULL) AS failed FROM s GROUP BY 1)
SELECT c AS "case", CASE WHEN failed IS NULL THEN 'safe' WHEN failed = 2 THEN 'ambiguous_source_requires_resolution' WHEN failed < 5 THEN 'invalid_blocked' ELSE 'stale_rebuild_required' END AS outcome,
  'filing_cache_lookup_' || CASE failed WHEN 0 THEN 'recent_source_refresh_unavailable' WHEN 1 THEN 'recent_source_refresh_invalid' WHEN 2 THEN 'ambiguous_source_requires_resolution' WHEN 3 THEN 'refreshed_source_metadata_missing' WHEN 4 THEN 'refreshed_source_metadata_missing' WHEN 5 THEN 'refreshed_source_fingerprint_changed' WHEN 6 THEN 'refreshed_source_identity_changed' WHEN 7 THEN 'refreshed_source_status_changed' WHEN 8 THEN 'refreshed_source_superseded' WHEN 9 THEN 'refreshed_source_corrected' END AS code,
  role, coalesce(failed >= 5, FALSE) AS reconfirm FROM g""",
    "supporting_links": f"""WITH {_TITLED},
n AS (SELECT DISTINCT name FROM t WHERE name <> ''), f AS (SELECT t.id, n.name FROM t JOIN n ON contains(t.text, n.name)),
p AS (SELECT f.name, min(f.id) AS canonical FROM f JOIN t ON t.id = f.id AND t.name = f.name GROUP BY 1)
SELECT p.name AS package, canonical, f.id AS supporting, length(t.text) % 2 = 0 AS correction FROM p JOIN f ON f.name = p.name JOIN t ON t.id = f.id JOIN t c ON c.id = canonical WHERE f.id <> canonical AND c.language = t.language""",
}
