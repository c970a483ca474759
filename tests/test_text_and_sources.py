"""Text dialects by their traps, splits' arithmetic, and JSON lines with numbers, releases and sidecars."""

import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.functions import dialects as d
from riskweave.operators import dataset, workflow
from riskweave.sources import jsonl


@pytest.mark.parametrize(
    ("mode", "want"),
    [("mapper", "dieu chinh so 1.5 strasse"), ("assembler", "đieu chinh so 1.5 strasse"), ("selection", "ieu chinh so 1 5 stra e"), ("classifier", "đieu chinh, so 1.5 straße "), ("fetched", "dieu chinh, so 1.5 straße "), ("discovery", "ieu chinh so 1 5 stra e")],
)
def test_normalisers_differ(mode, want):
    assert d.normalise("Điều  chỉnh, số 1.5 Straße ", mode) == want
    assert d.normalise(None, mode) is None and d.normalise("", mode) == ""


def test_normalising_looks_at_distinct_characters_in_small_pieces(monkeypatch):
    calls, sizes = [], []

    class Counting:
        normalize, combining = staticmethod(unicodedata.normalize), staticmethod(unicodedata.combining)
        category = staticmethod(lambda c: calls.append(c) or unicodedata.category(c))

    monkeypatch.setattr(d, "unicodedata", Counting)
    assert d.normalise("điều chỉnh " * 1000, "fetched") == "dieu chinh " * 1000 and len(calls) < 20

    class Texts:
        def __init__(self, texts):
            self.texts = texts

        def __len__(self):
            return len(self.texts)

        def slice(self, at, n):
            return Texts(self.texts[at : at + n])

        def to_pylist(self):
            sizes.append(len(self.texts))
            return self.texts

    assert d.in_pieces(Texts([None, "a"] * 500), lambda t: t, pa.string()).to_pylist() == [None, "a"] * 500
    assert max(sizes) <= d.PIECE and d.in_pieces(Texts([]), str, pa.string()).to_pylist() == []


def test_vietnamese_letters(spark):
    assert one(spark, d.is_vietnamese, "Điều", "ascii only", "", None, "naïve – ß", "x" * 50 + "Ữ") == [True, False, False, None, False, True]


def one(spark, column, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


def test_numbers(spark):
    assert one(spark, d.whole_amount, "1,5", "1.234,5", "(1.234)", "-", "–", "", "12a", None, "-7", " 5 ") == [15, 12345, -1234, None, None, None, None, None, -7, 5]
    got = one(spark, d.number_tokens, "From 1.234,5 to 1,5 or 1.234 and 1,234,567; x5 5x -3 2.50", "none")
    assert got == [["1234.5", "1.5", "1234", "1234567", "-3", "3", "2.50"], []]
    assert one(spark, d.roman, "IV", "xl", "viii", "A", "") == [4, 40, 8, None, None]
    assert one(spark, d.note_reference, "V.01", " 5.1 ", "VII", "12b") == ["5.1", "5.1", "7", "12b"]
    assert one(spark, d.sentence_count, "A rose 1.5 percent. B fell! Why?", "...", "one") == [3, 0, 1]
    assert one(spark, lambda t: d.canonical_json(d.without_fence(t)), '```json\n{"b": 1, "a": [2]}\n```', '{"a": 1}', "no json") == ['{"a":[2],"b":1}', '{"a":1}', None]


def test_formatters(spark):
    assert one(spark, lambda t: d.grouped(t.cast("long")), "1234567", "-1000", "5") == ["1,234,567", "(1,000)", "5"]
    assert one(spark, lambda t: d.excerpt(t, 10), "a  b\nc", "0123456789x") == ["a b c", "0123456..."]
    assert one(spark, d.upper_token, "a-b  c!", "") == ["A_B_C", ""]
    assert one(spark, d.html_text, "<p>a &lt; b</p>\n<b>c</b>") == ["a < b c"]


def test_split_counts(spark):
    of = lambda n, *shares: dict(map(tuple, dataset.apportion(spark.createDataFrame([(n,)], "n long"), "n", list(shares)).collect()))
    assert of(10, ("train", 70), ("validation", 15), ("test", 15)) == {"train": 7, "validation": 2, "test": 1}
    assert of(3, ("train", 0), ("test", -1)) == {"train": 3, "test": 0}
    assert sum(of(101, ("train", 2), ("holdout", 1), ("own", 4)).values()) == 101
    assert sum(of(2**62 + 1, ("train", 1), ("test", 1)).values()) == 2**62 + 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="no detector mode"):
        workflow.detected(spark.range(1), "none")


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n{broken\n' + "".join(f'{{"x": {i}}}\n' for i in range(5, 2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = jsonl.scan_numbered(spark, str(tmp_path / "a.jsonl"), "x int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["_line"] for r in rows} == {1, 3, *range(4, 2000)}
    assert all(r["x"] == r["_line"] for r in rows if r["_line"] > 4)
    assert [(r["_line"], r["_corrupt_record"]) for r in rows if r["x"] is None] == [(4, "{broken")]


def test_releases(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (3, "a", "test"), (4, "c", None)], "id int, text string, split string")
    at = str(tmp_path / "r1")
    manifest = {r["split"]: r["n"] for r in jsonl.write_release(rows, "split", at, "text").collect()}
    assert manifest == {"train": 1, "test": 2}
    assert '"values_in_several_splits": 1' in (tmp_path / "r1/leakage_report.json").read_text()
    got = jsonl.read_release(spark, [at], "id int, text string", ["test"]).collect()
    assert {(r["id"], r["text"], r["split"]) for r in got} == {(2, "b", "test"), (3, "a", "test")}
    with pytest.raises(ValueError, match="no split"):
        jsonl.read_release(spark, [at], "id int", ["holdout"])
    (tmp_path / "r1/metrics.json").unlink()
    with pytest.raises(ValueError, match="metrics.json"):
        jsonl.read_release(spark, [at], "id int")
