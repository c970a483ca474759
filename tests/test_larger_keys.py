"""Queries beside their SQL on rows that the small shared tables don't have."""

import duckdb

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over ``tables`` (name: SELECT in DuckDB), in order."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    frame = entry.queries()[name](spark, str(folder))
    found = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in frame.columns]
    return sorted((tuple(r) for r in frame.collect()), key=str), sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_markdown_ids_of_keys_of_four_digits(spark, tmp_path):
    suppliers = "SELECT CAST(k AS BIGINT) AS s_suppkey, 'Supplier#' || k AS s_name, CAST(k % 2 AS INTEGER) AS s_nationkey, k - 1000.5 AS s_acctbal FROM (VALUES (7), (998), (1000), (1001), (12345)) t(k)"
    got, want = both(spark, tmp_path, "markdown_reports", supplier=suppliers, nation="SELECT CAST(i AS INTEGER) AS n_nationkey, 'N' || i AS n_name FROM range(2) t(i)")
    assert len(got) == 2 and got == want
