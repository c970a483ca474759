"""The marker automaton against searching marker by marker, and the classifiers on titles of source documents."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.functions import dialects, markers

WORDS = st.lists(st.text(alphabet="ab ü", min_size=1, max_size=4), max_size=8, unique=True)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab ü", max_size=40), WORDS)
def test_one_pass_finds_what_single_searches_find(text, words):
    assert markers.first_places(text, tuple(words)) == [(w, text.find(w)) for w in words if w in text] if words else True


def read(spark, texts, names, *columns, mode="fetched"):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = frame.withColumn("f", markers.found_in(dialects.normalised(F.col("t"), mode) if mode else F.col("t"), names))
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(found.select("i", *columns).collect())]


def test_roles_languages_and_hints(spark):
    titles = ["Báo cáo tài chính hợp nhất", "Thuyết minh điều chỉnh", "Thuyết minh thay thế toàn bộ, giải trình", "Information disclosure: separate financial statements", "Tổng quan tình hình kinh doanh", "BCTC riêng đã soát xét", None, "", "Consolidated financial statements (audited, amended), bổ sung, thay thế"]
    f = F.col("f")
    join = lambda c: F.array_join(c, ",")
    got = read(spark, titles, markers.SOURCE, markers.role(f), markers.language(f), join(markers.clues(f, markers.BASES)), join(markers.clues(f, markers.ASSURANCE)), join(markers.amendment_hints(f)))
    assert got == [
        ("financial_statement", "vi", "consolidated", "", ""),
        ("amendment_context_attachment", "unknown", "", "", "dieu chinh"),
        ("variance_explanation", "unknown", "", "", "thay the"),
        ("cover_or_disclosure", "en", "separate", "", ""),
        ("business_overview", "unknown", "", "", ""),
        ("financial_statement", "vi", "separate", "reviewed", ""),
        ("out_of_scope", "unknown", "", "", ""),
        ("out_of_scope", "unknown", "", "", ""),
        ("financial_statement", "en", "consolidated", "audited", "bo sung,thay the,amended"),
    ]


@pytest.mark.parametrize("text, want", [("Phí bảo hiểm gốc và FVTPL", "insurance"), ("tự doanh chứng khoán", "securities"), ("fvtpl hàng tồn kho", "securities"), ("doanh thu thuần, hàng tồn kho", "unknown"), ("doanh thu thuần, hàng tồn kho, gia von hang ban", "standard_corporate"), ("loan deposit bank credit", "unknown"), ("", "unknown")])
def test_profiles_of_table_text(spark, text, want):
    assert read(spark, [text.lower()], markers.PROFILE, markers.profile(F.col("f")), mode=None) == [want]


def test_confidence(spark):
    rows = [("financial_statement", ["bctc"], None, None, 60), ("cover_or_disclosure", ["bctc"], False, "medium", 0), ("financial_statement", ["bctc"], True, "none", 60), ("financial_statement", [], True, "none", 0), ("financial_statement", [], True, "low", 45), ("variance_explanation", [], True, "medium", 86), ("out_of_scope", [], True, "medium", 60)]
    frame = spark.createDataFrame([(r[0], [(m, 0) for m in r[1]], r[2], r[3], r[4]) for r in rows], "role string, f array<struct<marker:string,at:int>>, completed boolean, evidence string, want int").coalesce(1)
    assert all(a == b for a, b in frame.select(markers.confidence(F.col("role"), F.col("f"), F.col("completed"), F.col("evidence")), "want").collect())
