"""Nested JSON against plain recursion, and assessments that are scanned whole."""

import json
import random

from pyspark.sql import functions as F

from riskweave.operators import assessments, nested


def plain(value, path="$"):
    """(path, name, text) of every value."""
    out = []
    stack = [(value, path, None)]
    while stack:
        v, p, name = stack.pop()
        out.append((p, name, v if isinstance(v, str) else None))
        if isinstance(v, dict):
            stack += [(x, f"{p}.{k}", k) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(x, f"{p}[{i}]", None) for i, x in enumerate(v)]
    return sorted(out, key=str)


def test_every_value_has_its_path(spark):
    rng = random.Random(3)

    def some(depth):
        kind = rng.randint(0, 6 if depth else 3)
        if kind > 4:
            return {rng.choice(["a", "raw_tables", "b c", "bbox", "ü"]) + str(i): some(depth - 1) for i in range(rng.randint(0, 3))}
        return [None, 7, "The Raw OCR", "ok", [some(depth - 1) for _ in range(2)] if depth else 1.5][kind]

    docs = {i: some(5) for i in range(40)} | {90: [[[[[[[[[["deep"]]]]]]]]]], 91: {}, 92: "final report"}
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()] + [(98, None), (99, '{"broken": ')], "id int, j string")
    got = {}
    for r in nested.walked(rows, "id", "j").collect():
        got.setdefault(r["id"], []).append((r["path"], r["name"], r["text"]))
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: plain(d) for i, d in docs.items()}


def test_prohibited_keys_and_phrases(spark):
    doc = {"a": [{"bbox": {"chain_of_thought": "x", "note": "Some RAW PDF here"}}], "Bbox": "hidden  injection", "raw ocr": 1, "final_report": None}
    got = {(r["path"], r["code"]) for r in nested.prohibited(spark.createDataFrame([(1, json.dumps(doc))], "id int, j string"), "id", "j").collect()}
    assert got == {("$.a[0].bbox", "prohibited_key"), ("$.a[0].bbox.chain_of_thought", "prohibited_key"), ("$.a[0].bbox.note", "prohibited_phrase"), ("$.final_report", "prohibited_key")}
    assert nested.prohibited(spark.createDataFrame([], "id int, j string"), "id", "j").count() == 0


def test_renaming_keeps_keys_and_longer_texts(spark):
    doc = {"purchase": "purchase", "x": ["purchase", "my purchase", {"purchase": 1}], 'q"purchase"': 'say "purchase"'}
    frame = spark.createDataFrame([(json.dumps(doc),), (json.dumps(doc, indent=1),)], "j string")
    want = {"purchase": "sale", "x": ["sale", "my purchase", {"purchase": 1}], 'q"purchase"': 'say "purchase"'}
    assert [json.loads(r[0]) for r in frame.select(nested.renamed_values(F.col("j"), {"purchase": "sale"})).collect()] == [want, want]


def test_phrases_are_found_anywhere_in_an_assessment(spark):
    ref = "array<struct<evidence_ref_type:string,ref_id:string,role:string>>"
    kind = f"p struct<packet_id:string,candidate_id:string,report_id:string,risk_category:string,visible_ids:array<string>,signal_ids:array<string>,tool_ids:array<string>>, a struct<assessment_id:string,packet_id:string,candidate_id:string,report_id:string,risk_category:string,support_level:string,severity:string,confidence:double,rationale:string,refs:{ref},signals:array<struct<signal_id:string,status:string,support_level:string,tool_result_id:string,refs:{ref}>>>"
    p = ("P", "C", "R", "k", ["v"], ["S", "vietstock"], ["T"])
    refs = [("note", "v", "context")]
    of = lambda rationale="Fine.", assessment="A", signal="S": (p, (assessment, "P", "C", "R", "k", "supported", "high", 0.5, rationale, refs, [(signal, "validated", "supported", "T", refs)]))
    rows = [of(), of(rationale="It is Fraud."), of(assessment="A_Misconduct"), of(signal="vietstock"), of(assessment="base report 3")]
    got = [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(assessments.assessment_violation()).collect()]
    assert got == [None, "prohibited_risk_language", "prohibited_risk_language", "outside_packet_reasoning", "hidden_injection_leakage"]


def test_the_greatest_severity_of_a_claim(spark):
    f = spark.createDataFrame([("R", "F", "T", "x", "p", "c", s) for s in ("low", "medium", "high")] + [("R", "G", "T", "x", "p", "c", s) for s in ("low", "medium")], "report_id string, finding_id string, tool_ref string, summary string, period string, category string, severity string")
    got = {r["finding_id"]: r["severity"] for r in assessments.claims(f, spark.createDataFrame([("R", "S")], "report_id string, source_id string")).collect()}
    assert got == {"F": "high", "G": "medium"}
