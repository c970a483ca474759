"""Texts that contain given names, and documents linked to a canonical one of the same identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of every text of ``texts`` (id, text) and name of ``names`` (name) that it contains, as characters.

    A join by an index of runs of ``GRAM`` characters instead of comparing all pairs: every name is looked up under the run of
    it that the fewest texts have (shorter names under themselves), and what is found is checked whole.  An empty name is in no
    text; nulls match nothing."""
    names = names.where(F.length("name") > 0).distinct()
    sizes = F.array(*(F.lit(i) for i in range(1, GRAM + 1)))
    short = F.least(F.length("name"), F.lit(GRAM))
    wanted = names.select("name", F.explode(F.coalesce(*(F.when(short == i, _grams(F.col("name"), i)) for i in range(1, GRAM + 1)))).alias("gram"))
    there = texts.select("id", "text", F.explode(F.filter(sizes, lambda s: s <= F.length("text"))).alias("size"))
    there = there.select("id", F.explode(F.coalesce(*(F.when(F.col("size") == i, _grams(F.col("text"), i)) for i in range(1, GRAM + 1)))).alias("gram"))
    # Names' runs (of an alphabet's letters, at most three) go to the texts, so that no other run is shuffled; one exchange serves both uses.
    there = there.join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi").repartition("gram")
    often = there.groupBy("gram").agg(F.count("id").alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return there.join(rarest, "gram").join(texts, "id").where(F.col("text").contains(F.col("name"))).select("id", "name")


def supporting_links(documents: DataFrame, packages: DataFrame, found: DataFrame) -> DataFrame:
    """Supporting documents of a package's canonical one: package, canonical, supporting, correction (to be resolved).

    documents: id, role, language, basis; packages: package, canonical, names (any of which must be in both documents'
    evidence), basis; found: (id, name) of ``contained``.  Both must be in one language and of the package's basis family."""
    from riskweave.operators.selection import SUPPORTING_ROLES, basis_matches

    named = packages.select("package", "canonical", F.col("basis").alias("asked"), F.explode("names").alias("name")).join(found, "name").select("package", "canonical", "asked", "id").distinct()
    whole = named.join(documents, "id").where(basis_matches(F.col("asked"), F.col("basis")))
    main = whole.where("id = canonical").select("package", F.col("language").alias("main_language"))
    helps = whole.where((F.col("id") != F.col("canonical")) & F.col("role").isin(*SUPPORTING_ROLES))
    return helps.join(main, "package").where("language = main_language").select("package", "canonical", F.col("id").alias("supporting"), (F.col("role") == "amendment_context_attachment").alias("correction"))
