"""Extraction deals rows by document and table without a join, and parses table rows without a shuffle."""

from decimal import Decimal

from pyspark.sql import functions as F

from riskweave.functions import dialects
from riskweave.operators import extraction
from riskweave.plans import filings
from riskweave.sources import html


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_statement_rows_join_nothing(spark):
    rows = [("d", 0, 0, ["60", "Luu chuyen tien thuan", "5", "2.000", "1.000"]), ("d", 1, 0, ["131", "Phai thu ngan han cua khach hang", "(7.000)", "-"]), (None, 0, 0, ["131", "Phai thu", "1"])]
    found = extraction.statement_rows(spark.createDataFrame(rows, "doc string, table int, pos int, cells array<string>"))
    assert "Join" not in plan(found)
    assert sorted((r["doc"], r["table"], r["account"], int(r["value"])) for r in found.collect()) == [("d", 0, "operating_cash_flow", 2000), ("d", 1, "trade_receivables", -7000)]


def test_table_rows_shuffle_nothing_and_equal_grouped_cells(spark):
    page = "<h2>Page 3</h2><table><td>x</td><tr><td>a<td>b</td><td><table><tr><td>n</td></tr></table>late</td><td>c</td></tr><tr></tr><h2>Page 2</h2><tr><th>z</th></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>no table</p>")], "page_id long, html string")
    found = html.table_rows(pages)
    assert "Exchange" not in plan(found)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"])
    want = html.table_cells(pages).groupBy("page_id", "table", F.col("row").alias("pos")).agg(F.min("page").alias("page"), cells.alias("cells"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_pages_are_shuffled_packed_and_their_rows_are_not(spark):
    shown = plan(filings.page_statement_rows(spark, "/root/testdata/sf0.001"))
    assert shown.count("Exchange hashpartitioning") == 2 and "BatchEvalPythonUDTF" not in shown


def test_plain_tables_are_read_without_the_parser(monkeypatch):
    page = "<h2 id='x'>Page 3</h2><![ y]]><TABLE class=\"t\">\n<tr><th nowrap>a &amp;  b</th>\n<td> (1) </td></tr><p>x</p><tr><td>a<b>b</b></td></tr></table>"
    monkeypatch.setattr(html._Tables, "feed", lambda self, data: 1 / 0)
    assert list(html.rows_of(page)) == [(0, 0, 3, ["a & b", "(1)"]), (0, 1, 3, ["ab"])]


def test_odd_tables_are_read_as_the_parser_reads_them():
    parts = "<table> </table> <tr> </tr> <td> </td> <th> </th > <td/> <td\x00> <h2> </h2> Page 4 &#52; <!--<td>x</td>--> <!--<tr> <![CDATA[<td>]]> <![if> <script>'<tr><td>' </script> <title><td> <a\tb='<tr>'> <a/b='> </> </ < & &amp &lt; \x1e a>b <ſpan> <tr\x1f> <td>x</td><td>y</td> <tr><td>z</td></tr>".split(" ")
    for step in range(1, 60):
        page = "<table><tr>" + "".join(parts[i * i * step % 61 % len(parts)] + " " * (i % 2) for i in range(90))
        parser, rows = html._Tables(), {}
        parser.feed(page)
        parser.close()
        for table, row, _, shown, cell in parser.out:
            at = rows.setdefault((table, row), [shown, []])
            at[0] = min(at[0], shown)
            at[1].append(cell)
        assert list(html.rows_of(page)) == [(*k, *v) for k, v in rows.items()]


def test_long_pages_are_packed_in_pieces(monkeypatch):
    monkeypatch.setattr(html, "PIECE", 200)
    page = "<table>" + "".join(f"<tr><td>r{i}</td><td>{'x' * (i * 7 % 900)}</td></tr>" for i in range(40)) + "</table>"
    packed = html.packed_rows(page)
    assert len(packed) > 20
    assert [r.split("\x1f") for p in packed for r in p.split("\x1e")] == [["0", str(i), "1", f"r{i}", "x" * (i * 7 % 900)] for i in range(40)]


def test_amounts_of_an_array_are_those_of_its_texts(spark):
    texts = ["1,5", "1.234,5", "(1.234)", "-", "–", "", "12a", None, "-7", " 5 ", " (8) ", "( 8)", "((9))", "(-5)", "(.-5)", "5(", ")5)", "-(5)", "()", ".", "1-2", "--3", "+4", "1e5", "9" * 38, "9" * 39, "0" * 39, "6\n", "7\x1f8", "٣", "." * 5000, "(" * 5000]
    rows = spark.createDataFrame([(texts,), (["x", None],), ([],), (None,)], "t array<string>")
    one = rows.select(F.filter(F.transform("t", dialects.whole_amount), lambda v: v.isNotNull()).alias("v")).collect()
    got = [r["v"] for r in rows.select(dialects.whole_amounts(F.col("t")).alias("v")).collect()]
    assert got == [one[0]["v"], None, None, None] and got[0][:3] == [15, 12345, Decimal(-1234)]
