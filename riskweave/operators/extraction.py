"""From raw table rows to statement rows: account codes, labels and classes, value columns, buckets, assembly.

A raw row is an array of cell texts; tables and rows keep their order (``pos``), and the first of what is equal stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import dialects
from riskweave.operators.checks import first_failing

# Groups of standard accounts, and the surfaces that tables alone don't cover.
GROUPS = {
    "revenue_income": ("revenue", "profit_after_tax"),
    "receivables_credit": ("trade_receivables", "margin_lending", "margin_impairment"),
    "cashflow": ("operating_cash_flow",),
    "asset_quality": ("fvtpl_assets", "afs_assets", "htm_assets", "fvtpl_unrealized_gain"),
}
SURFACES = ("notes", "variance_explanations", "related_party_evidence", "accounting_policy_evidence", "extraction_quality")


HEAD = 4  # cells that are looked at one by one, without a function over arrays, which Spark doesn't compile


def head(i: int) -> str:
    return f"__c{i}"


def code_position(n: int = HEAD) -> Column:
    """The place, from 1, of the first of a row's first cells (``head``) that looks like an account code; 0 for none."""
    return F.coalesce(*(F.when(F.col(head(i)).rlike(r"(?i)^\d{1,3}(\.\d+)?[a-z]?$"), F.lit(i)) for i in range(1, n + 1)), F.lit(0))


def label(cells: Column, code: Column) -> Column:
    """The first cell that is neither empty, the code, a numeral, a single letter nor a number; else empty.

    The first cells are ``head``; the others, ``cells`` behind them, are only looked at where none of those is a label."""
    plain = lambda c: (c != "") & ~F.coalesce(c == code, F.lit(False)) & ~F.lower(c).rlike("^([ivx]+|[a-z])$") & ~c.rlike(r"^[-–]$") & ~c.rlike(dialects.WHOLE)
    first = (F.when(plain(F.col(head(i))), F.col(head(i))) for i in range(1, HEAD + 1))
    rest = F.filter(F.transform(F.slice(cells, F.lit(HEAD + 1), F.size(cells)), lambda x: F.trim(x)), plain)
    return F.coalesce(*first, F.try_element_at(rest, F.lit(1)), F.lit(""))


def standard_account(code: Column, text: Column, cash_flow: Column) -> Column:
    """The standard account of a code and a normalised label, by the first rule that holds; null for none."""
    has, c = text.contains, F.coalesce(code, F.lit(""))
    profit = has("loi nhuan sau thue")
    own_profit = profit & ~has("chua phan phoi") & ~has("cong ty me") & ~has("co dong khong kiem soat")
    gain = (has("danh gia lai") & has("fvtpl")) | (has("chenh lech tang") & has("danh gia") & (has("tstc") | has("tai san tai chinh")) & (has("lai lo") | has("thong qua lo") | has("thong qua lai lo")))
    rules = [
        ((c == "131") | has("phai thu ngan han cua khach hang"), "trade_receivables"), ((c == "117") & has("cac khoan phai thu"), "trade_receivables"), ((c == "60") & cash_flow, "operating_cash_flow"),
        ((c == "114") & has("cac khoan cho vay"), "margin_lending"), ((c == "116") & has("du phong suy giam"), "margin_impairment"), ((c == "112") & has("fvtpl"), "fvtpl_assets"), ((c == "115") & has("san sang de ban"), "afs_assets"),
        (c.isin("113", "212.1") & has("nam giu den ngay dao han"), "htm_assets"), ((c == "01.2") & gain, "fvtpl_unrealized_gain"), (has("doanh thu thuan"), "revenue"), (c.isin("1", "01", "10", "20") & has("doanh thu"), "revenue"),
        (own_profit, "profit_after_tax"), ((c == "60") & profit, "profit_after_tax"), ((c == "200") & has("loi nhuan") & has("sau thue"), "profit_after_tax"), ((c == "20") & (has("luu chuyen tien thuan tu hoat dong kinh doanh") | cash_flow), "operating_cash_flow"),
    ]
    return F.coalesce(*(F.when(cond, F.lit(name)) for cond, name in rules))


def account_group(account: Column) -> Column:
    return F.coalesce(*(F.when(account.isin(*names), F.lit(g)) for g, names in GROUPS.items()), F.lit("unknown"))


def numbers_behind(cells: Column, spot: Column) -> Column:
    """The numbers of a row behind its code, which is at ``spot``; null for none."""
    return dialects.whole_amounts(F.slice(cells, spot + 1, F.size(cells)))


def selected_value(numbers: Column, account: Column, to_date: Column) -> Column:
    """A row's value: of the ``numbers_behind`` its code, without a small leading note number, the first; the third of three
    or more for profit, and for revalued gains to date the third of four, else the last."""
    rest = F.slice(numbers, F.lit(2), F.size(numbers))
    large = (F.array_max(rest) >= 1000) | (F.array_min(rest) <= -1000)
    note = (F.size(numbers) >= 2) & (F.abs(F.try_element_at(numbers, F.lit(1))) < 1000) & large
    skipped = F.when(note, 1).otherwise(0)
    n = F.size(numbers) - skipped
    at = lambda i: F.try_element_at(numbers, i + skipped)
    last = F.try_element_at(numbers, F.lit(-1))
    return F.when((account == "fvtpl_unrealized_gain") & to_date & (n >= 2), F.when(n >= 4, at(3)).otherwise(last)).when((account == "profit_after_tax") & (n >= 3), at(3)).otherwise(at(1))


def ambiguous_columns(header: Column) -> Column:
    """Whether a normalised header row has two current columns and neither a prior nor a year-to-date one."""
    count = lambda *m: F.size(F.filter(header, lambda c: dialects._any(c, m)))
    return (count("nam nay", "ky nay") >= 2) & (count("nam truoc") == 0) & (count("luy ke") == 0)


def bucket(account: Column) -> Column:
    """The statement that a standard account belongs to, with its period basis."""
    group = account_group(account)
    return F.when(account == "fvtpl_unrealized_gain", "income_to_date").when(group.isin("asset_quality", "receivables_credit"), "balance").when(account == "revenue", "income_quarter").when(account == "profit_after_tax", "income_to_date").when(account == "operating_cash_flow", "cash_flow")


def statement_rows(rows: DataFrame) -> DataFrame:
    """Raw rows (doc, table, pos, cells; texts already without accents) as statement rows: the first of each account in its
    bucket, preferred revenue labels before others.  Tables' words tell cash flow and year-to-date context."""
    c = F.col
    own = Window.partitionBy("doc", "table")
    words = {"cash_flow": "luu chuyen tien", "to_date": "luy ke"}
    r = rows.where("doc is not null and table is not null").withColumn("__text", F.lower(F.array_join("cells", " ")))
    r = r.withColumns({k: c("__text").contains(w) for k, w in words.items()})
    r = r.withColumns({head(i): F.trim(F.try_element_at("cells", F.lit(i))) for i in range(1, HEAD + 1)}).withColumn("__spot", code_position())
    r = r.withColumns({"code": F.coalesce(*(F.when(c("__spot") == i, c(head(i))) for i in range(1, HEAD + 1))), "numbers": numbers_behind(c("cells"), c("__spot"))})
    r = r.withColumn("label", label(c("cells"), c("code"))).withColumn("__low", F.lower("label"))
    # Whole tables are told of their words when their rows are narrow.
    r = r.select("doc", "table", "pos", "code", "label", "__low", "numbers", *(F.bool_or(k).over(own).alias(k) for k in words))
    r = r.withColumn("account", standard_account(c("code"), c("__low"), c("cash_flow")))
    r = r.withColumn("value", selected_value(c("numbers"), c("account"), c("to_date")))
    # A generator keeps the conditions from being worked out again with all that is before them.
    r = r.select("doc", "table", "pos", "code", "label", "__low", F.inline(F.array(F.struct("account", "value")))).where("account is not null and value is not null").withColumn("bucket", bucket(c("account")))
    preferred = F.when((F.col("account") == "revenue") & dialects._any(F.col("__low"), ("doanh thu thuan", "cong doanh thu hoat dong")), 0).otherwise(1)
    order = [F.when(F.col("bucket") == "income_quarter", preferred).otherwise(0), "table", "pos"]
    first = F.row_number().over(Window.partitionBy("doc", "bucket", "account").orderBy(*order))
    return r.withColumn("__n", first).where("__n = 1").select("doc", "table", "pos", "code", "label", "account", "bucket", "value")


def assembled(rows: DataFrame) -> DataFrame:
    """Statement rows as nested tables of a document, with sections and a cell index: one row per document."""
    cell = F.concat(F.lit("CELL_"), F.upper("account"))
    row = F.struct("pos", F.concat(F.lit("ROW_"), F.upper("account")).alias("row_id"), "account", cell.alias("cell_id"), "value")
    tables = rows.groupBy("doc", "bucket").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    section = F.when(F.col("bucket") == "balance", "balance_sheet").when(F.col("bucket") == "cash_flow", "cash_flow_statement").otherwise("income_statement")
    table = F.struct("bucket", section.alias("section"), "rows")
    docs = tables.groupBy("doc").agg(F.array_sort(F.collect_list(table)).alias("tables"))
    cells = F.flatten(F.transform("tables", lambda t: F.transform(t["rows"], lambda r: F.struct(r["cell_id"].alias("key"), r["value"].alias("value")))))
    return docs.select("doc", "tables", F.array_distinct(F.transform("tables", lambda t: t["section"])).alias("sections"), F.map_from_entries(cells).alias("cell_index"))


def surface_status(docs: DataFrame, told: DataFrame) -> DataFrame:
    """A row for every document and surface: what was told (doc, surface, state; the latest ``pos``), else that tables
    alone don't cover it."""
    default = docs.select("doc", F.explode(F.array(*map(F.lit, SURFACES))).alias("surface"))
    last = told.groupBy("doc", "surface").agg(F.max_by("state", "pos").alias("state"))
    return default.join(last, ["doc", "surface"], "left").select("doc", "surface", F.coalesce("state", F.lit("unsupported_by_extraction_path")).alias("state"))


def corrected(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """Cells (doc, account, value) after corrections (doc, account, original, corrected, resolved): exactly one resolved
    correction whose original is the cell's value applies; others are named in ``code``."""
    c = corrections.groupBy("doc", "account").agg(F.count("*").alias("n"), F.min("original").alias("original"), F.min("corrected").alias("corrected"), F.bool_and("resolved").alias("resolved"))
    both = cells.join(c, ["doc", "account"], "left")
    code = first_failing((F.col("n").isNull(), "as_filed"), (F.col("n") > 1, "duplicate_correction"), (~F.col("resolved"), "unresolved_correction"), (~F.col("original").eqNullSafe(F.col("value")), "original_value_differs"), default="corrected")
    return both.withColumn("code", code).select("doc", "account", F.when(F.col("code") == "corrected", F.col("corrected")).otherwise(F.col("value")).alias("value"), "code")


def note_links(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows (doc, row, note, title) with notes (doc, note_id, number, title) of the same number and title: one only, else
    ``missing`` or ``ambiguous``."""
    n = notes.select("doc", "note_id", dialects.note_reference(F.col("number")).alias("ref"), F.lower("title").alias("t"))
    r = rows.select("doc", "row", dialects.note_reference(F.col("note")).alias("ref"), F.lower("title").alias("t"))
    found = r.join(n, ["doc", "ref", "t"], "left").groupBy("doc", "row").agg(F.count("note_id").alias("n"), F.min("note_id").alias("note_id"))
    return found.select("doc", "row", first_failing((F.col("n") == 0, "missing"), (F.col("n") > 1, "ambiguous"), default="linked").alias("status"), F.when(F.col("n") == 1, F.col("note_id")).alias("note_id"))
