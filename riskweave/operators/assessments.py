"""Detector packets and assessments: evidence roles, rule baseline, validation, repairs, grouping, claims and drafts.

Packets and assessments are nested rows; everything is an expression over their arrays or an equi-join on ids, and rules
are ordered, so that the first one that fails names the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import dialects
from riskweave.operators.checks import first_failing

# What an assessment may say, and how much a packet may hold.
SUPPORT_LEVELS = ("supported", "weakly_supported", "not_supported", "insufficient_evidence")
SEVERITIES = ("high", "medium", "low", "unknown")
REF_TYPES = ("table_cell", "table_row", "note", "note_span", "variance_explanation_span", "accounting_policy_note_span", "related_party_note_span", "tool_result", "rule")
REF_ROLES = ("supporting", "contradicting", "refuting", "context", "missing_required_context")
SIGNAL_STATUSES = ("validated", "partially_validated", "rejected", "not_assessable")
STATUS_OF = dict(zip(SUPPORT_LEVELS, SIGNAL_STATUSES))
CAPS = {"table_rows": 12, "notes": 3, "spans": 2, "tool_findings": 5, "rules": 3}
PROHIBITED = ("fraud", "manipulat", "conceal", "intent", "illegal", "legal misstatement", "misconduct")
OUTSIDE = ("outside news", "based on news", "vietstock", "sanction", "auditor issued", "qualified opinion", "later corrected", "annual report confirms", "known for aggressive accounting", "industry conditions", "restatement", "amendment", "replacement filing")
LEAKED = ("hidden injection", "injection scenario", "target support level", "target_support_level", "omitted evidence", "underlying reportmemory", "base report", "synthetic scenario", "injected report", "modified evidence")
SURFACE_STATES = ("absent_in_source", "not_applicable", "unsupported_by_extraction_path", "not_extracted_yet", "ambiguous_failed_closed")


def _let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds any of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def evidence_roles(findings: str = "findings") -> Column:
    """The findings with ``role`` and ``corroborated``: one primary trigger (declared, else the first flagged, else the
    first), flagged ones of another signal and tool corroborate it, the rest is context; declared roles stay."""
    f = F.col(findings)
    first = lambda condition: F.array_position(F.transform(f, lambda x: F.coalesce(condition(x), F.lit(False)).cast("int")), 1)
    declared, flagged = first(lambda x: x["declared"] == "primary_trigger"), first(lambda x: x["flag"])
    at = F.when(declared > 0, declared).when(flagged > 0, flagged).otherwise(1).cast("int")
    primary = F.element_at(f, at)
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    free = lambda x: F.coalesce(x["flag"], F.lit(False)) & (F.coalesce(x["declared"] == "independent_corroboration", F.lit(False)) | (differs(x["signal_id"], primary["signal_id"]) & differs(x["tool_result_id"], primary["tool_result_id"]) & (x["signal_id"].isNotNull() | x["tool_result_id"].isNotNull())))
    independent = lambda x, i: (i + 1 != at) & free(x)
    any_free = F.exists(F.transform(f, independent), lambda b: b)
    role = lambda x, i: F.coalesce(x["declared"], F.when(i + 1 == at, "primary_trigger").when(independent(x, i), "independent_corroboration").otherwise("context"))
    return F.transform(f, lambda x, i: x.withField("role", role(x, i)).withField("corroborated", F.when(i + 1 == at, any_free).otherwise(independent(x, i))))


def rule_baseline(packets: DataFrame) -> DataFrame:
    """Support level, confidence in percent, severity and signal of a packet by rules alone.

    A packet has ``refs`` (visible evidence of the candidate), ``findings`` (flag, refs), ``signals`` and ``priority``."""
    flagged = F.exists("findings", lambda x: x["flag"] & (F.size(x["refs"]) > 0))
    level = first_failing((F.size("refs") == 0, "insufficient_evidence"), (flagged, "supported"), (F.size("findings") > 0, "not_supported"), default="weakly_supported")
    out = packets.withColumn("support_level", level)
    known = F.col("support_level")
    severity = F.when(known.isin("not_supported", "insufficient_evidence"), "unknown").when(F.col("priority").isin("high", "medium", "low"), F.col("priority")).otherwise("medium")
    signal = F.coalesce(F.try_element_at(F.filter("findings", lambda x: x["signal_id"].isNotNull()), F.lit(1))["signal_id"], F.try_element_at("signals", F.lit(1)))
    return out.withColumns({"confidence_pct": F.when(known == "supported", 65).when(known == "weakly_supported", 45).otherwise(50), "severity": severity, "signal_id": signal, "signal_status": status_of(known)})


def status_of(level: Column) -> Column:
    return F.coalesce(*(F.when(level == name, F.lit(status)) for name, status in STATUS_OF.items()))


def packet_violation() -> Column:
    """The first packet cap or key that fails: sizes are columns ``n_`` of the parts of ``CAPS``."""
    return F.coalesce(F.when(F.coalesce(F.col("candidate_id"), F.lit("")) == "", "invalid_detector_packet"), *(F.when(F.col(f"n_{part}") > cap, F.lit(f"{part}_exceeds_cap")) for part, cap in CAPS.items()))


def assessment_violation() -> Column:
    """The first rule that an assessment ``a`` of a packet ``p`` breaks, or null.

    p: packet_id, candidate_id, report_id, risk_category, visible_ids, signal_ids, tool_ids; a: the same ids, support_level,
    severity, confidence, rationale, refs (evidence_ref_type, ref_id, role) and signals (signal_id, status, support_level,
    tool_result_id, refs)."""
    a, p = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"p.{n}"))
    differs = lambda n: ~a(n).eqNullSafe(p(n))
    no = lambda column, allowed: ~F.coalesce(column.isin(*allowed), F.lit(False))
    hidden = lambda ids, x: ~F.coalesce(F.array_contains(ids, x), F.lit(False))
    rationale, refs, signals, whole = a("rationale"), a("refs"), a("signals"), F.lower(F.to_json("a"))  # phrases may be anywhere in it
    ref_code = lambda r: F.when(no(r["evidence_ref_type"], REF_TYPES), "invalid_evidence_ref_type").when(no(r["role"], REF_ROLES), "invalid_evidence_ref_role").when(hidden(p("visible_ids"), r["ref_id"]), "invalid_evidence_ids")
    first = lambda codes: F.try_element_at(F.array_compact(codes), F.lit(1))
    signal_code = lambda s: F.coalesce(
        F.when(no(s["status"], SIGNAL_STATUSES), "invalid_signal_status"), F.when(no(s["support_level"], SUPPORT_LEVELS), "invalid_support_level"), F.when(F.coalesce(F.size(s["refs"]), F.lit(-1)) <= 0, "schema_mismatch"),
        F.when(s["signal_id"].isNotNull() & hidden(p("signal_ids"), s["signal_id"]), "invalid_evidence_ids"), F.when(s["tool_result_id"].isNotNull() & hidden(p("tool_ids"), s["tool_result_id"]), "invalid_evidence_ids"), first(F.transform(s["refs"], ref_code)),
    )
    rules = [
        (a("assessment_id").isNull(), "schema_mismatch"), (differs("packet_id") | differs("candidate_id") | differs("report_id"), "identity_mismatch"), (differs("risk_category"), "risk_category_mismatch"),
        (no(a("support_level"), SUPPORT_LEVELS), "invalid_support_level"), (no(a("severity"), SEVERITIES), "invalid_severity"), (a("confidence").isNull() | (a("confidence") < 0) | (a("confidence") > 1), "invalid_confidence"),
        (F.coalesce(F.size(signals), F.lit(-1)) <= 0, "schema_mismatch"), (refs.isNull(), "schema_mismatch"), (F.trim(F.coalesce(rationale, F.lit(""))) == "", "schema_mismatch"), (dialects.sentence_count(rationale) > 3, "rationale_too_long"),
    ]
    language = ((PROHIBITED, "prohibited_risk_language"), (OUTSIDE, "outside_packet_reasoning"), (LEAKED, "hidden_injection_leakage"))
    said = _let(whole, lambda w: F.coalesce(*(F.when(mentions(w, phrases), F.lit(code)) for phrases, code in language)))
    return F.coalesce(*(F.when(c, F.lit(code)) for c, code in rules), said, first(F.transform(refs, ref_code)), first(F.transform(signals, signal_code)))


def repaired(rows: DataFrame) -> DataFrame:
    """Assessments ``a`` of packets ``p`` after the repairs that leave no choice, with ``actions``: sorted, each once.

    In order: a legacy ``decision`` becomes the support level; ids follow the packet; missing signals follow from the cited
    evidence; a reference whose last part ends one visible id becomes it; a wrong type follows from the id's; an unknown
    optional tool result goes.  p has ``types`` besides: a map from visible ids to their types."""
    a, p = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"p.{n}"))
    legacy = a("support_level").isNull() & F.coalesce(a("decision").isin(*SUPPORT_LEVELS), F.lit(False))
    level = F.when(legacy, a("decision")).otherwise(a("support_level"))
    no_id = F.coalesce(a("assessment_id"), F.lit("")) == ""
    ids = ("packet_id", "candidate_id", "report_id", "risk_category")
    wrong = {n: (F.coalesce(p(n), F.lit("")) != "") & ~a(n).eqNullSafe(p(n)) for n in ids}
    some = F.coalesce(F.size(a("refs")), F.lit(-1)) > 0
    wanted = F.filter(F.coalesce(a("signal_ids"), p("candidate_signal_ids")), lambda s: F.array_contains(p("signal_ids"), s))
    lost = a("signals").isNull() & F.coalesce(level.isin(*SUPPORT_LEVELS), F.lit(False)) & some & (F.size(wanted) > 0)
    kind = rows.schema["a"].dataType["signals"].dataType.simpleString()  # all of it nullable
    made = F.transform(wanted, lambda s: F.struct(s.alias("signal_id"), status_of(level).alias("status"), level.alias("support_level"), F.lit(None).cast("string").alias("tool_result_id"), a("refs").alias("refs"))).cast(kind)
    ends = lambda ref: _let(F.concat(F.lit(":"), F.substring_index(ref, ":", -1)), lambda tail: F.filter(p("visible_ids"), lambda v: v.endswith(tail)))
    unseen = lambda r: ~F.array_contains(p("visible_ids"), r["ref_id"])
    seen_as = lambda r: _let(F.when(unseen(r), ends(r["ref_id"])), lambda e: F.struct(F.coalesce(F.size(e) == 1, F.lit(False)).alias("one"), F.when(F.size(e) == 1, F.element_at(e, 1)).otherwise(r["ref_id"]).alias("id")))
    typed = lambda r, k: _let(F.when(~F.coalesce(r["evidence_ref_type"].isin(*REF_TYPES), F.lit(False)), F.try_element_at(p("types"), k["id"])), lambda t: F.struct(r.withField("evidence_ref_type", F.coalesce(t, r["evidence_ref_type"])).withField("ref_id", k["id"]).alias("ref"), k["one"].alias("one"), t.isNotNull().alias("odd")))
    look = lambda r: _let(seen_as(r), lambda k: typed(r, k))  # noqa: E731 (a reference is looked up once)
    unknown = lambda s: s["tool_result_id"].isNotNull() & ~F.array_contains(p("tool_ids"), s["tool_result_id"])
    signals = F.when(lost, made).otherwise(a("signals").cast(kind))
    # Columns of their own behind a generator, so that what several rules read is worked out once a row.
    rows = rows.withColumn("a", F.explode(F.array("a"))).withColumn("__signals", signals).withColumns({"__refs": F.transform(a("refs"), look), "__signal_refs": F.transform("__signals", lambda s: F.transform(s["refs"], look))})
    signals = F.col("__signals")
    signal = lambda s, i: s.withField("refs", F.transform(F.get("__signal_refs", i), lambda x: x["ref"])).withField("tool_result_id", F.when(unknown(s), F.lit(None)).otherwise(s["tool_result_id"]))
    some_ref = lambda name: F.coalesce(F.exists("__refs", lambda x: x[name]), F.lit(False)) | F.coalesce(F.exists(F.flatten("__signal_refs"), lambda x: x[name]), F.lit(False))
    actions = [
        (legacy, "repaired_legacy_decision_support_level"), (no_id, "repaired_missing_assessment_id"), *((wrong[n] & a(n).isNull(), f"repaired_missing_{n}") for n in ids), *((wrong[n] & a(n).isNotNull(), f"repaired_{n}_identity") for n in ids),
        (lost, "repaired_missing_validated_signals"), (some_ref("one"), "repaired_evidence_ref_id"), (some_ref("odd"), "repaired_evidence_ref_type"), (F.coalesce(F.exists(signals, unknown), F.lit(False)), "removed_invalid_optional_tool_result_id"),
    ]
    fixed = F.col("a").withField("support_level", level).withField("assessment_id", F.when(no_id, F.concat(F.lit("ASSESS_"), p("packet_id"))).otherwise(a("assessment_id")))
    for n in ids:
        fixed = fixed.withField(n, F.when(wrong[n], p(n)).otherwise(a(n)))
    fixed = fixed.withField("refs", F.transform("__refs", lambda x: x["ref"])).withField("signals", F.transform(signals, signal))
    done = rows.withColumns({"actions": F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in actions)))), "__fixed": fixed})
    # A generator, as the optimizer would put the whole repair into every place that reads a field of it.
    return done.drop("a", "__signals", "__refs", "__signal_refs").withColumn("a", F.explode(F.array("__fixed"))).drop("__fixed")


def rank_of(column: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(column == name, F.lit(i)) for i, name in enumerate(order)), F.lit(len(order)))


def grouped_findings(assessments: DataFrame) -> DataFrame:
    """Supported assessments (report_id, assessment_id, candidate_id, pos, risk_category, severity, priority, tool_ids) by
    their first linked tool result, else their category: numbered by first appearance, with primary and categories."""
    key = F.coalesce(F.try_element_at("tool_ids", F.lit(1)), F.col("risk_category"))
    order = F.struct(rank_of(F.col("severity"), SEVERITIES), rank_of(F.col("priority"), SEVERITIES), "assessment_id")
    listed = F.array_sort(F.collect_list(F.struct("pos", "assessment_id", "risk_category", "tool_ids")))
    groups = assessments.withColumn("key", key).groupBy("report_id", "key").agg(F.min("pos").alias("first"), F.min(rank_of(F.col("severity"), SEVERITIES)).alias("rank"), F.min_by("risk_category", order).alias("primary_category"), F.min_by("assessment_id", order).alias("primary_assessment"), listed.alias("l"))
    number = F.row_number().over(Window.partitionBy("report_id").orderBy("first"))
    distinct = lambda field: F.array_distinct(F.transform("l", lambda x: x[field]))
    return groups.select(
        "report_id", F.format_string("F-%03d", number).alias("finding_id"), "key", "primary_category", "primary_assessment", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank") + 1).alias("final_severity"),
        distinct("risk_category").alias("categories"), F.transform("l", lambda x: x["assessment_id"]).alias("assessment_ids"), F.array_distinct(F.flatten(F.transform("l", lambda x: x["tool_ids"]))).alias("tool_refs"),
    )


def capped_severity(severity: Column) -> Column:
    """Of a weak signal: high counts as medium."""
    return F.when(severity == "high", "medium").otherwise(severity)


def overall(findings: DataFrame, weak: DataFrame, reports: DataFrame) -> DataFrame:
    """Per report (report_id, insufficient): status, primary and secondary categories, highest severity.

    findings: report_id, finding_id, primary_category, categories, final_severity; weak: report_id, severity."""
    f = findings.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("finding_id", "primary_category", "categories"))).alias("f"), F.min(rank_of(F.col("final_severity"), SEVERITIES)).alias("rf"))
    w = weak.groupBy("report_id").agg(F.count("*").alias("n_weak"), F.min(rank_of(capped_severity(F.col("severity")), SEVERITIES)).alias("rw"))
    both = reports.join(f, "report_id", "left").join(w, "report_id", "left")
    rank = F.least(F.coalesce("rf", F.lit(3)), F.coalesce("rw", F.lit(3)))
    status = first_failing((F.col("f").isNotNull(), "risk_signals_identified"), (F.col("n_weak") > 0, "weak_or_limited_risk_signals_only"), (F.col("insufficient"), "insufficient_evidence_for_overall_assessment"), default="no_material_irregularity_signal_identified")
    rest = F.array_distinct(F.flatten(F.transform(F.slice("f", F.lit(2), F.size("f")), lambda x: x["categories"])))
    return both.select("report_id", status.alias("status"), F.try_element_at("f", F.lit(1))["primary_category"].alias("primary_category"), F.coalesce(F.array_join(rest, ","), F.lit("")).alias("secondary"), F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1).alias("highest_severity"), (F.col("f").isNotNull() | (F.coalesce("n_weak", F.lit(0)) > 0)).alias("review"))


def claims(findings: DataFrame, lineage: DataFrame) -> DataFrame:
    """What a draft may say of each tool result that has a source: its numbers, periods, categories and severity.

    findings: report_id, finding_id, tool_ref, summary, period, category, severity; lineage: report_id, source_id."""
    rows = findings.join(lineage, "report_id")
    tokens = F.explode_outer(dialects.number_tokens(F.col("summary")))
    flat = rows.select("report_id", "finding_id", "tool_ref", "source_id", "period", "category", "severity", tokens.alias("number"))
    gathered = lambda c: F.array_sort(F.collect_set(c))
    return flat.groupBy("report_id", "finding_id", "tool_ref", "source_id").agg(gathered("number").alias("numbers"), gathered("period").alias("periods"), gathered("category").alias("categories"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.min(rank_of(F.col("severity"), SEVERITIES)) + 1).alias("severity"))


def draft_violations(drafts: DataFrame, claimed: DataFrame) -> DataFrame:
    """Drafts (report_id, finding_id, tool_ref, text, severity) against ``claims``: the first rule that fails, or ``valid``.

    Every claim has one draft and every draft a claim; numbers must be allowed ones and the severity equal."""
    slots = drafts.groupBy("report_id", "finding_id", "tool_ref").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.min("severity").alias("said"))
    both = slots.join(claimed, ["report_id", "finding_id", "tool_ref"], "full_outer")
    extra = F.size(F.array_except(dialects.number_tokens(F.col("text")), "numbers")) > 0
    code = first_failing((F.col("n").isNull(), "missing_slot"), (F.col("source_id").isNull(), "unknown_slot"), (F.col("n") > 1, "duplicate_slot"), (~F.col("said").eqNullSafe(F.col("severity")), "severity_mismatch"), (extra, "number_not_permitted"), default="valid")
    return both.select("report_id", "finding_id", "tool_ref", code.alias("code"))


def markdown(title: Column, findings: str, limitations: str) -> Column:
    """A report as Markdown: heading, a section for each finding (finding_id, title, severity, summary), limitations."""
    part = lambda f: F.concat(F.lit("## "), f["finding_id"], F.lit(" "), f["title"], F.lit("\n\nSeverity: "), f["severity"], F.lit("\n\n"), dialects.markdown(f["summary"]), F.lit("\n"))
    listed = F.array_join(F.transform(F.col(limitations), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(F.col(findings), part), "\n"), F.lit("\n## Limitations\n\n"), listed, F.lit("\n"))
