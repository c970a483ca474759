"""General operators on small fixtures: rules that the shared tables don't reach."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.operators import checks, dataset, evaluate, integrity, ranking
from riskweave.sources import html, jsonl
from riskweave.streaming import stage_log


def test_growth_rounds_half_away_and_guards_zero(spark):
    rows = spark.createDataFrame([(150000, 100000), (-30000, 70000), (1, 0), (None, 5), (200005, 100000), (-5, -10)], "a long, b long")
    got = [r[0] for r in rows.select(checks.growth_bp("a", "b")).collect()]
    assert got == [5000, -14286, None, None, 10001, 5000]


def test_prior_year_is_same_quarter(spark):
    rows = spark.createDataFrame([("x", 2023, 1, 10), ("x", 2024, 1, 30), ("x", 2024, 2, 5), ("y", 2024, 1, 7)], "entity string, y int, q int, v long")
    assert [tuple(r) for r in checks.prior_year(rows, ["entity", "q"], ["v"]).select("entity", "y", "q", "v", "v_prior").collect()] == [("x", 2024, 1, 30, 10)]


def test_first_failing_is_ordered_and_null_safe(spark):
    rows = spark.createDataFrame([(None,), (0,), (5,)], "v int")
    code = checks.first_failing((F.col("v") == 0, "zero"), (F.col("v") < 3, "low"), default="ok")
    assert [r[0] for r in rows.select(code).collect()] == ["ok", "zero", "ok"]


@pytest.mark.parametrize("chain", [3, 40])
def test_identity_groups_follow_chains(spark, chain):
    rows = [(i, f"k{i}") for i in range(chain)] + [(i + 1, f"k{i}") for i in range(chain)] + [(900, "own"), (901, None)]
    got = {r[0]: r[1] for r in dataset.identity_groups(spark.createDataFrame(rows, "doc long, identity string"), "doc", "identity").collect()}
    assert got == {**{i: 0 for i in range(chain + 1)}, 900: 900}


def test_apportion_keeps_the_total(spark):
    for total in (0, 1, 7, 101):
        rows = dataset.apportion(spark.createDataFrame([(total,)], "n long"), "n", [("a", 80), ("b", 10), ("c", 10)]).collect()
        assert sum(r["n"] for r in rows) == total


def test_violations_and_reconcile(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    got = integrity.violations(rows, ["id"], [("missing", F.col("v").isNull()), ("high", F.col("v") > 3)]).collect()
    assert sorted(map(tuple, got)) == [(1, "missing"), (2, "high")]
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("b", 3), ("c", 1)], "k string, n int")
    assert sorted(map(tuple, integrity.reconcile(left, right, ["k"], "n").collect())) == [("a", 1, None), ("b", 2, 3), ("c", None, 1)]
    assert sorted(map(tuple, integrity.key_difference(left, right, ["k"]).collect())) == [("a", "missing"), ("c", "extra")]


def test_class_without_gold_or_prediction_has_no_score(spark):
    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", None)], "gold string, predicted string")
    got = {r["label"]: r for r in evaluate.class_metrics(pairs, ["x", "y", "z"]).collect()}
    assert (got["x"]["precision_bp"], got["x"]["recall_bp"], got["x"]["f1_bp"]) == (10000, 5000, 6667)
    assert got["z"]["precision_bp"] is None and got["z"]["f1_bp"] is None


def test_caps_and_turns(spark):
    rows = spark.createDataFrame([("g", i) for i in range(5)], "g string, v int")
    assert [r["v"] for r in ranking.split_at_cap(rows, ["g"], 2, F.desc("v")).where("kept").collect()] == [4, 3]
    assert [r["v"] for r in ranking.best(rows, ["g"], F.desc("v")).collect()] == [4]


def test_amounts_periods_and_accents(spark):
    rows = spark.createDataFrame([("(1.234)",), ("1,5",), ("1.234,5",), ("-",), ("–",), ("12 000",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.parsed_amount(F.col("t"))).collect()] == [Decimal("-1234.0000"), Decimal("1.5000"), Decimal("1234.5000"), None, None, Decimal("12000.0000"), None]
    rows = spark.createDataFrame([("Q3/2024",), ("2024-Q1",), ("2nd quarter of 2023",), ("none",)], "t string")
    assert [r[0] for r in rows.select(text.period(F.col("t"))).collect()] == ["2024-Q3", "2024-Q1", "2023-Q2", None]
    assert spark.createDataFrame([("Đường ế Ñ",)], "t string").select(text.without_accents(F.col("t"))).first()[0] == "Duong e N"


def test_html_tables_carry_pages(spark):
    page = "<h2>Page 1</h2><table><tr><th>a</th><td>b c</td></tr></table><h2>Page 2</h2><table><tr><td>1</td></tr><tr><td>2</td></tr></table>"
    got = html.table_cells(spark.createDataFrame([(7, page), (8, None)], "page_id long, html string")).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 1, "a"), (7, 0, 0, 1, 1, "b c"), (7, 1, 0, 0, 2, "1"), (7, 1, 1, 0, 2, "2")]


def test_json_lines_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    jsonl.write(spark.createDataFrame([(1, "x", None), (2, "y", 3)], "b int, a string, c int"), path)
    (tmp_path / "bad.json").write_text('{"a": 1}\n\nnot json\n')
    assert sorted(r["a"] for r in jsonl.scan(spark, path, "a string, b int, c int").collect()) == ["x", "y"]
    bad = jsonl.scan(spark, f"file://{tmp_path}/bad.json", "a int").collect()
    assert [r["a"] for r in bad] == [1, None] and bad[1]["_corrupt_record"] == "not json"


def test_streamed_state_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    state = stage_log.run_state(stage_log.read_events(spark, f"file://{tmp_path}/in", events.schema), "3650 days")
    query = state.writeStream.outputMode("complete").format("memory").queryName("state").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    want = {r[0]: (r[1], r[2]) for r in events.groupBy("user_id").agg(F.count("*"), F.max_by("event_type", "event_id")).collect()}
    assert {r["user_id"]: (r["n"], r["latest"]) for r in spark.table("state").collect()} == want


def test_broken_and_long_html_tables(spark):
    pages = ["<table><tr><td>a<![>b<td>c</table>", "<![ x<table><tr><td>1</td>", None, "", "<table>" + "".join(f"<tr><td>r{i}</td><td>{'x' * 500}</td></tr>" for i in range(400)) + "</table>", "<h2>Page 7</h2><table><tr><th>A &amp; B</th></tr></table><table></table><table><tr><td>z</td></tr></table>"]
    rows = html.table_cells(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(3)).collect()
    of = lambda k: sorted((r["table"], r["row"], r["col"], r["page"], r["cell"]) for r in rows if r["page_id"] == k)
    assert of(0) == [] or all(r[0] == 0 for r in of(0))
    assert of(2) == of(3) == [] and len(of(4)) == 800 and of(4)[-1] == (0, 399, 1, 1, "x" * 500)
    assert of(5) == [(0, 0, 0, 7, "A & B"), (2, 0, 0, 7, "z")]
    gathered = html.table_rows(spark.createDataFrame([(1, pages[5])], "page_id long, html string")).collect()
    assert sorted((r["table"], r["pos"], r["cells"]) for r in gathered) == [(0, 0, ["A & B"]), (2, 0, ["z"])]


def test_statement_rows_of_wide_tables(spark):
    from riskweave.operators import extraction

    wide = ["131", "Phai thu ngan han cua khach hang", "5", *["-"] * 1500, "1.234.567"]
    rows = [("D", 0, 0, wide), ("D", 0, 1, ["60", "Luu chuyen tien", "(7,000)"]), ("D", 0, 2, ["01.2", "Danh gia lai FVTPL", "12", "1,000", "2,000", "3,000", "4,000"]), ("D", 1, 0, ["10", "Doanh thu", "9,999,999,999,999,999,999,999"]), ("D", 1, 1, ["x", "10", "Doanh thu thuan", "8"])]
    got = {(r["account"], r["code"]): int(r["value"]) for r in extraction.statement_rows(spark.createDataFrame(rows, "doc string, table int, pos int, cells array<string>")).collect()}
    assert got == {("trade_receivables", "131"): 1234567, ("operating_cash_flow", "60"): -7000, ("fvtpl_unrealized_gain", "01.2"): 1000, ("revenue", "10"): 8}
