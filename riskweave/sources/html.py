"""HTML pages as rows: paragraphs and list items by expression, tables by Python."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.dialects import html_text, in_pieces


def elements(pages: DataFrame, tags: str = "p|li|h[1-6]", html: str = "html") -> DataFrame:
    """Texts of elements, in order: the page's columns, ``pos`` and ``text``, whose inner tags are spaces."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?s)<(?:{tags})(?: [^>]*)?>(.*?)</(?:{tags})>"), 1)
    out = pages.select(*(c for c in pages.columns if c != html), F.posexplode(found).alias("pos", "text"))
    return out.withColumn("text", html_text(F.col("text")))


PIECE = 1 << 16  # characters parsed at a time
# Read without the parser, as it reads them: cells of plain text with or without a row's tag before them, plain tags, sections without a name.
_ATTRS = r"""(?:[ \t\n\r\f]++[a-z][-a-z0-9]*+(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[-#%.a-z0-9]++))?+)*+[ \t\n\r\f]*+"""
_RUN = re.compile(rf"[^<]*+(<tr{_ATTRS}>)?+((?:[^<]*+<t[dh]{_ATTRS}>[^<]*+</t[dh]>){{1,64}}+)(?:[^<]*+</tr>)?+", re.I | re.A)
_TEXT = re.compile(r">([^<]*+)</")
_TAG = re.compile(rf"([^<]*+)<(?:(?!script|style|textarea|title|xmp|iframe|no|plaintext)([a-z][a-z0-9]*+){_ATTRS}|/([a-z][a-z0-9]*+)|!\[(?![a-z])[^>]*+)>", re.I | re.A)


class _Tables(HTMLParser):
    """Cells of all tables, and the page number that the last heading ``Page N`` gave."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.table, self.row, self.col, self.depth = 1, -1, -1, -1, 0
        self.heading: list[str] | None = None
        self.cell: list[str] | None = None
        self.out: list[tuple] = []

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section without a name
            return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row, self.depth = self.table + 1, -1, self.depth + 1
        elif tag == "tr" and self.depth:
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th") and self.depth:
            self.col, self.cell = self.col + 1, []
        elif tag in ("h1", "h2", "h3"):
            self.heading = []

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif tag in ("td", "th") and self.cell is not None:
            self.out.append((self.table, self.row, self.col, self.page, " ".join("".join(self.cell).split())))
            self.cell = None
        elif tag in ("h1", "h2", "h3") and self.heading is not None:
            words = "".join(self.heading).split()
            if len(words) == 2 and words[0].lower() == "page" and words[1].isdecimal():
                self.page = int(words[1])
            self.heading = None

    def handle_data(self, data):
        for target in (self.cell, self.heading):
            if target is not None:
                target.append(data)


def _runs(html: str | None):
    """Of an HTML text, (table, row, column of the first, page, texts) of cells one after another in a row.

    The parser is fed from tag to tag what isn't read without it, and while it waits for an end as much again as it holds, so
    that the work stays linear.  What is completed is given out at once, so that no page's cells are gathered."""
    parser, at, n = _Tables(), 0, len(html or "")
    run, tag, texts, out = _RUN.match, _TAG.match, _TEXT.findall, parser.out
    free = True  # nothing waits in the parser
    while at < n:
        if free:
            plain = parser.depth and parser.cell is None and parser.heading is None
            if plain and (found := run(html, at, at + PIECE)):
                at, opened, body = found.end(), found[1], found[2]
                if opened:
                    parser.row, parser.col = parser.row + 1, -1
                cells = [" ".join((unescape(c) if "&" in c else c).split()) for c in texts(body)]
                yield parser.table, parser.row, parser.col + 1, parser.page, cells
                parser.col += len(cells)
                continue
            if found := tag(html, at, at + PIECE):
                at, (data, start, stop) = found.end(), found.groups()
                if data and not plain:
                    parser.handle_data(unescape(data))
                if start:
                    parser.handle_starttag(start.lower(), ())
                elif stop:
                    parser.handle_endtag(stop.lower())
        if not free or not found:
            waits = len(parser.rawdata)
            end = html.find("<", at + max(waits, 1), at + waits + PIECE)
            end = end if end > 0 else min(at + waits + PIECE, n)
            parser.feed(html[at:end])
            at, free = end, not parser.rawdata and not parser.cdata_elem
        if out:
            yield from ((table, row, col, page, [cell]) for table, row, col, page, cell in out)
            out.clear()
    parser.close()
    yield from ((table, row, col, page, [cell]) for table, row, col, page, cell in out)


class TableCells:
    """A table function: of an HTML text, a row (table, row, col, page, cell) for each table cell, in order."""

    def eval(self, html: str):
        for table, row, col, page, cells in _runs(html):
            for i, cell in enumerate(cells):
                yield table, row, col + i, page, cell


def table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each table cell: ``key``, table, row, col, page, cell, by a lateral join with ``TableCells``."""
    cells = F.udtf(TableCells, returnType="`table` int, `row` int, col int, page int, cell string")
    found = pages.select(key, html).lateralJoin(cells(F.col(html).outer()))
    return found.select(key, "table", "row", "col", "page", "cell")


def rows_of(html: str | None):
    """(table, pos, page, cells) of each table row with cells, in order.

    Cells come by table and row, so that a row is given out when the next begins, and one row's cells are held."""
    now, page, cells = None, 0, []
    for table, row, _, shown, more in _runs(html):
        if now == (table, row):
            page = min(page, shown)
            cells.extend(more)
            continue
        if now is not None:
            yield (*now, page, cells)
        now, page, cells = (table, row), shown, more
    if now is not None:
        yield (*now, page, cells)


def packed_rows(html: str | None) -> list[str]:
    """The table rows of an HTML text, as texts of about ``PIECE`` characters.

    One mark parts rows, another their table, pos, page and cells; both are white space to Python, so that no cell has them."""
    out, packed, size = [], [], 0
    for table, pos, page, cells in rows_of(html):
        packed.append(f"{table}\x1f{pos}\x1f{page}\x1f" + "\x1f".join(cells))
        size += len(packed[-1])
        if size >= PIECE:
            out.append("\x1e".join(packed))
            packed, size = [], 0
    return [*out, "\x1e".join(packed)] if packed else out


def _packed(pages: pa.Array) -> pa.Array:
    return in_pieces(pages, packed_rows, pa.list_(pa.string()))


def packed(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``packed``: the rows of all tables, a text for many of them, which is less to shuffle than rows."""
    return pages.select(key, F.arrow_udf(_packed, "array<string>")(F.col(html)).alias("packed")).select(key, F.explode("packed").alias("packed"))


def unpacked(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """What ``packed`` gives as rows: ``key``, table, pos (from 0), page and cells, an array in order."""
    each = rows.select(key, F.explode(F.split("packed", "\x1e")).alias("__row"))
    parts = each.select(key, F.explode(F.array(F.split("__row", "\x1f"))).alias("__parts"))
    table, pos, page = (F.get("__parts", F.lit(i)).cast("int").alias(c) for i, c in enumerate(("table", "pos", "page")))
    return parts.select(key, table, pos, page, F.slice("__parts", F.lit(4), F.size("__parts")).alias("cells"))


def table_rows(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The rows of all tables: ``key``, table, pos (from 0), page and cells, an array in order."""
    return unpacked(packed(pages, key, html), key)
