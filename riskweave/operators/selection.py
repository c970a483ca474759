"""Choosing a filing's canonical source document: candidate predicates, supersession, ordered outcomes and records.

A source document has: package, doc, state (null without a classifier record), role, language, basis, requested (the
package's basis), full, supporting, searchable, confirmed, same (its company, period and quarter are the requested ones),
amended, reviewed (booleans) and fetched (compared as text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.checks import first_failing

# Bases that stand for each other.
NON_CONSOLIDATED = ("parent", "separate", "non_consolidated")
SUPPORTING_ROLES = ("cover_or_disclosure", "business_overview", "variance_explanation", "amendment_context_attachment")


def basis_matches(requested: Column, found: Column) -> Column:
    return (requested == found) | (requested.isin(*NON_CONSOLIDATED) & found.isin(*NON_CONSOLIDATED))


def named(docs: DataFrame) -> DataFrame:
    """Documents with their ``kind``: candidate, supporting, or why they are ignored."""
    main = (F.col("role") == "financial_statement") & F.col("full") & basis_matches(F.col("requested"), F.col("basis"))
    helps = F.col("supporting") | F.col("role").isin(*SUPPORTING_ROLES)
    is_main = main & F.col("language").isin("vi", "mixed") & (F.col("state") == "classified")
    per = docs.withColumns({"__main": F.coalesce(is_main & ~helps, F.lit(False)), "__helps": F.coalesce(helps, F.lit(False)), "__english": F.coalesce(main & (F.col("language") == "en"), F.lit(False))})
    # Both facts of a package come by windows in one order of its rows, without joins to rows that are read again.
    own = Window.partitionBy("package", "role", "__family")
    twin = (F.col("state") == "classified") & F.col("supporting") & (F.col("language") == "vi") & F.col("role").isNotNull() & F.col("__family").isNotNull()
    out = per.where(F.col("package").isNotNull()).withColumn("__family", F.when(F.col("basis").isin(*NON_CONSOLIDATED), "own").otherwise(F.col("basis")))
    out = out.withColumn("__twin", F.bool_or(F.coalesce(twin, F.lit(False))).over(own)).withColumn("__has_main", F.bool_or(F.coalesce(main & F.col("language").isin("vi", "mixed"), F.lit(False))).over(Window.partitionBy("package")))
    english = (F.col("language") == "en") & (F.col("__has_main") | F.col("__twin"))
    kind = first_failing(
        (F.col("state").isNull(), "missing_classifier_record"), (F.col("state") != "classified", "inconclusive_classifier_record"), (F.col("__helps") & english, "english_supporting_duplicate_ignored"), (F.col("__helps"), "supporting"),
        (F.col("__main"), "candidate"), (F.col("__english"), "english_financial_statement_duplicate_ignored"), default="ignored",
    )
    return out.withColumn("kind", kind).drop(*(c for c in out.columns if c.startswith("__")))


def selected(docs: DataFrame) -> DataFrame:
    """Per package: status, code, the selected document, and how many it supersedes, support it and are ignored.

    One candidate is selected unless it is searchable and not confirmed; a possible reviewed statement that isn't
    classified stops the choice; then one amended statement supersedes originals, one later reviewed statement others, a
    confirmed searchable one the default; all of the same identity.  What can't be ordered goes to a human."""
    d = named(docs)
    c = F.col("kind") == "candidate"
    count = lambda x: F.count_if(x)
    own = F.col("same") & (F.col("language") == "vi")
    doubt = (F.col("state") == "inconclusive") & (F.col("role") == "financial_statement") & (F.col("language") == "vi") & basis_matches(F.col("requested"), F.col("basis")) & F.col("reviewed")
    pick = lambda x: F.min(F.when(c & x, F.col("doc")))
    g = d.groupBy("package").agg(
        count(c).alias("n"), count(c & F.col("amended")).alias("na"), count(c & F.col("reviewed")).alias("nr"), count(c & F.col("searchable")).alias("ns"), count(c & F.col("searchable") & F.col("confirmed")).alias("nk"),
        F.bool_and(F.when(c, own)).alias("same"), F.max(F.when(c & F.col("reviewed"), F.col("fetched"))).alias("fr"), F.max(F.when(c & ~F.col("reviewed"), F.col("fetched"))).alias("fu"), F.bool_or(F.coalesce(doubt, F.lit(False))).alias("doubt"),
        pick(F.lit(True)).alias("d1"), pick(F.col("amended")).alias("da"), pick(F.col("reviewed")).alias("dr"), pick(F.col("searchable") & F.col("confirmed")).alias("dk"), pick(~F.col("searchable")).alias("dd"),
        count(F.col("kind") == "supporting").alias("supporting"), count(~F.col("kind").isin("supporting", "candidate")).alias("ignored"),
    )
    n = lambda name: F.col(name)
    amended, reviewed = (n("na") == 1) & (n("n") > 1) & n("same"), (n("nr") == 1) & (n("n") > 1) & n("same")
    later = n("fr") > n("fu")
    default = n("n") - n("ns")
    code = first_failing(
        ((n("n") == 1) & (n("ns") == 1) & (n("nk") == 0), "searchable_identity_not_confirmed"), (n("doubt") & (n("n") > 0), "inconclusive_reviewed_full_fs_identity"), (n("n") == 1, "canonical_source_selected"), (amended, "amended_full_fs_supersedes_original"),
        (reviewed & later, "reviewed_full_fs_supersedes_unreviewed"), ((n("nk") == 1) & (default <= 1), "searchable_version_selected"), ((n("ns") == 1) & (default == 1), "searchable_identity_not_confirmed_fallback"),
        (reviewed, "ambiguous_reviewed_supersession_order"), (n("n") > 1, "ambiguous_financial_statement_candidates"), default="missing_requested_basis_vietnamese_financial_statement",
    )
    g = g.withColumn("code", code)
    k = F.col("code")
    chosen = F.when(k == "canonical_source_selected", n("d1")).when(k == "amended_full_fs_supersedes_original", n("da")).when(k == "reviewed_full_fs_supersedes_unreviewed", n("dr")).when(k == "searchable_version_selected", n("dk")).when(k == "searchable_identity_not_confirmed_fallback", n("dd"))
    status = F.when(chosen.isNotNull(), "selected").when(k.startswith("ambiguous"), "hitl_needed").otherwise("recoverable_data_error")
    superseded = F.when(k.isin("amended_full_fs_supersedes_original", "reviewed_full_fs_supersedes_unreviewed"), n("n") - 1).otherwise(F.lit(0))
    return g.select("package", status.alias("status"), "code", chosen.alias("doc"), superseded.cast("long").alias("superseded"), "supporting", "ignored")


def confirmation(choices: DataFrame, records: DataFrame) -> DataFrame:
    """What a human confirms: a package's choice, its records split into warnings and errors, candidates only where a choice
    is needed.  records: package, doc, kind."""
    error = F.col("kind").isin("missing_classifier_record", "inconclusive_classifier_record")
    note = F.col("kind").startswith("english")
    r = records.groupBy("package").agg(F.count_if(error).alias("errors"), F.count_if(note).alias("warnings"), F.array_sort(F.collect_list(F.when(F.col("kind") == "candidate", F.col("doc")))).alias("c"))
    asked = F.when(F.col("status") == "hitl_needed", F.array_join(F.transform("c", lambda x: x.cast("string")), ",")).otherwise("")
    return choices.join(r, "package").select("package", "status", "errors", "warnings", asked.alias("asked"))
