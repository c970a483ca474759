"""Inheritance, periods and cell ids of assembled reports, and what tools may see of notes and surfaces."""

from pyspark.sql import functions as F

from riskweave.operators import assembly

TABLES = "doc string, source string, tables array<struct<table_id:string,unit:string,page:int,excerpt:string,rows:array<struct<row_id:string,unit:string,page:int,excerpt:string,cells:array<struct<cell_id:string,period:string,value:bigint,unit:string,page:int,excerpt:string>>>>>>"


def test_cells_inherit_and_duplicates_are_rows(spark):
    tables = [
        ("t1", "vnd", 1, None, [("r1", None, 2, "row", [("a", "2025", 1, "usd", None, None), ("b", "2024", 2, None, None, "own")]), ("r2", "eur", None, None, [("a", "2025", 3, None, 9, None)])]),
        ("t2", None, None, "table", [("r3", None, None, None, [("c", None, 4, None, None, None), (None, "2023", 5, None, None, None), (None, "2025", 6, None, None, None)])]),
    ]
    rows = spark.createDataFrame([("D", "S", tables), ("E", "S", None), ("F", "S", [])], TABLES)
    got = {r["cell_id"]: (r["code"], r["n"], r["table_id"], r["row_id"], r["periods"], r["value"], r["unit"], r["page"], r["excerpt"]) for r in assembly.cell_index(rows).collect()}
    assert got == {
        "a": ("duplicate_cell_id", 2, "t1", "r1", ["2025", "2024"], 1, "usd", 2, "row"),
        "b": ("indexed", 1, "t1", "r1", ["2025", "2024"], 2, "vnd", 2, "own"),
        "c": ("indexed", 1, "t2", "r3", ["2023", "2025"], 4, None, None, "table"),
        None: ("missing_cell_id", 2, "t2", "r3", ["2023", "2025"], 5, None, None, "table"),
    }


def test_notes_and_surfaces_show_what_tools_may_see(spark):
    kinds = ", ".join(f"{f}:array<string>" if f in ("linked_row_ids", "periods") else f"{f}:string" for f in (*assembly.NOTE_FIELDS, "raw_coordinates"))
    note = lambda i, source: (i, None, "k", None, "T", source, "x", ["r"], ["2025"], None, "hidden")
    surface = lambda s="notes", t="present", d=None, e="ref": (s, t, d, e)
    rows = spark.createDataFrame([("D", "S", [note("n1", None), note("n2", "O")], [surface(), surface("pages"), surface(t="lost"), surface(d="O"), surface(d="S"), surface(e=" "), surface(e=None)])], f"doc string, source string, notes array<struct<{kinds}>>, surfaces array<struct<surface:string,state:string,source_document_id:string,evidence_ref:string>>")
    notes = assembly.projected_notes(rows)
    assert notes.columns == ["doc", "pos", *assembly.NOTE_FIELDS] and [r["source_document_id"] for r in notes.orderBy("pos").collect()] == ["S", "O"]
    assert sorted((r["pos"], r["source_document_id"]) for r in assembly.projected_surfaces(rows).collect()) == [(0, "S"), (4, "S")]
    assert assembly.projected_surfaces(rows.where(F.lit(False))).count() == 0
