"""Text dialects: seven normalisers, number and note-reference parsing, classifiers by ordered rules, small formatters.

Unicode decomposition has no built-in expression, so that one Arrow function takes a mode; all else is expressions."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that are Python objects at a time; (form of decomposition, case folding, the letter d with stroke, what becomes a space) of each dialect.
PIECE = 64
MODES = {
    "mapper": ("NFD", "fold", "d", r"[^\w\s.]+"),
    "assembler": ("NFD", "fold", None, r"[^\w\s.]+"),
    "selection": ("NFKD", "lower", None, r"[^a-zA-Z0-9]+"),
    "classifier": ("NFKD", "lower", None, None),
    "evidence": ("NFKD", "lower", None, None),
    "fetched": ("NFKD", "lower", "d", None),
    "discovery": ("NFKD", "lower", None, r"[^a-zA-Z0-9]+"),
}


_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))  # ASCII letters and digits, all else a space


def normalise(value: str | None, mode: str) -> str | None:
    """One text in one dialect; null stays null.

    What goes is looked up among the text's distinct characters, so that no loop runs over all of its characters."""
    if value is None:
        return None
    form, case, stroke, gaps = MODES[mode]
    text = value.strip().casefold() if case == "fold" else value
    if not text.isascii():
        text = unicodedata.normalize(form, text)
        for c in set(text):
            if c > "\x7f" and (unicodedata.category(c) == "Mn" or unicodedata.combining(c)):
                text = text.replace(c, "")
        if stroke:
            text = text.replace("đ", stroke).replace("Đ", stroke)
    text = text.lower() if case == "lower" else text
    if gaps == MODES["selection"][3]:
        return b" ".join(text.encode("ascii", "replace").translate(_WORDS).split()).decode("ascii")
    if gaps:
        for c in set(text):
            if re.match(gaps, c):
                text = text.replace(c, " ")
        text = " ".join(text.split())
        return text.strip(" .") if mode == "assembler" else text
    inner = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + inner + (" " if inner and text[-1:].isspace() else "")


def in_pieces(texts: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """``of`` every text; of a batch only its Arrow form is held, and the Python objects of one piece."""
    pieces = [pa.array([of(t) for t in texts.slice(i, PIECE).to_pylist()], kind) for i in range(0, len(texts), PIECE)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


def normalised(text: Column, mode: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, lambda t: normalise(t, mode), pa.string())

    return F.arrow_udf(run, "string")(text)


# A text that ``whole_amount`` reads, without outer spaces.
WHOLE = r"^[()]*+[.,]*+-?(?:[.,]*+\d){1,38}+[.,]*+[()]*+(?:\r\n|[\r\n])?+\z"


def without(text: Column, *marks: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(""))
    return text


def whole_amount(text: Column) -> Column:
    """A written whole amount: parentheses are negative, dots and commas group; a dash, more than 38 digits or anything else
    is null."""
    bare = F.trim(text)
    inner = F.when(bare.contains("(") | bare.contains(")"), F.regexp_replace(bare, r"^[()]+|[()]+$", "")).otherwise(bare)
    digits = without(inner, ".", ",")
    value = F.when(digits.rlike(r"^-?\d{1,38}$"), digits.cast("decimal(38,0)"))
    return F.when(bare.startswith("(") & bare.endswith(")"), -value).otherwise(value)


def whole_amounts(cells: Column) -> Column:
    """The ``whole_amount`` of each of an array's texts that is one, in order; null for none.

    Only the search for them is a function over an array; what it finds becomes numbers as one text, which Spark compiles."""
    text = F.array_join(F.filter(cells, lambda c: F.trim(c).rlike(WHOLE)), "\x1f")
    signed = without(F.regexp_replace(text, r"(?<![^\x1f]) *\(([^\x1f]*)\) *(?![^\x1f])", "-$1"), ".", ",", "(", ")", "--")
    return F.split(F.nullif(signed, F.lit("")), "\x1f").cast("array<decimal(38,0)>")


def number_tokens(text: Column) -> Column:
    """Numbers of a narrative in order, each once: canonical, and for a negative one its positive form after it."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w.,])-?[0-9]+(?:[.,][0-9]+)*(?!\w)(?![.,][0-9])"), 0)
    both = F.flatten(F.transform(found, lambda t: F.when(t.startswith("-"), F.array(canonical_number(t), F.substr(canonical_number(t), F.lit(2)))).otherwise(F.array(canonical_number(t)))))
    return F.array_distinct(both)


def canonical_number(token: Column) -> Column:
    """A written number with a dot before its fraction and no grouping marks.

    With both marks dots group; one comma before one or two digits is decimal, commas before threes group; dots before
    threes group when there are several, or one behind at most three characters."""
    dots, commas = token.contains("."), token.contains(",")
    ungrouped = lambda mark: F.replace(token, F.lit(mark), F.lit(""))
    pointed = F.replace(token, F.lit(","), F.lit("."))
    by_comma = F.when(token.rlike(r"^[^,]*,\d{1,2}$"), pointed).when(token.rlike(r"^[^,]*(,\d{3})+$"), ungrouped(",")).otherwise(pointed)
    by_dot = F.when(token.rlike(r"^[^.]*(\.\d{3}){2,}$") | token.rlike(r"^[^.]{1,3}\.\d{3}$"), ungrouped(".")).otherwise(token)
    return F.when(dots & commas, F.replace(ungrouped("."), F.lit(","), F.lit("."))).when(commas, by_comma).when(dots, by_dot).otherwise(token)


def roman(text: Column) -> Column:
    """The value of a numeral of i, v, x and l; null for anything else."""
    worth = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50)
    values = F.transform(F.split(F.reverse(F.lower(text)), ""), worth)
    step = lambda acc, v: F.struct((acc["total"] + F.when(v < acc["before"], -v).otherwise(v)).alias("total"), v.alias("before"))
    total = F.aggregate(values, F.struct(F.lit(0).alias("total"), F.lit(0).alias("before")), step)["total"]
    return F.when(F.lower(text).rlike("^[ivxl]+$"), total)


def note_reference(text: Column) -> Column:
    """A note number as dotted numbers: ``V.01`` and ``5.1`` are the same note."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9.]+", ""), r"\."), lambda p: p != "")
    one = lambda p: F.when(p.rlike(r"^\d{1,9}$"), p.cast("long").cast("string")).otherwise(F.coalesce(roman(p).cast("string"), p))
    return F.array_join(F.transform(parts, one), ".")


def sentence_count(text: Column) -> Column:
    """Runs between ``.``, ``!`` and ``?``; a dot between digits ends nothing."""
    safe = F.regexp_replace(text, r"(?<=\d)\.(?=\d)", "<DECIMAL>")
    return F.size(F.filter(F.split(safe, r"[.!?]+"), lambda s: F.trim(s) != ""))


def without_fence(text: Column) -> Column:
    """JSON out of a Markdown fence; another text stays as it is."""
    bare = F.trim(text)
    inner = F.trim(F.regexp_replace(bare, r"(?s)^```(?:json)?\n(.*)\n```$", "$1"))
    return F.when(bare.rlike(r"(?s)^```(?:json)?\n.*\n```$"), inner).otherwise(text)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _any(text: Column, markers) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | text.contains(m)
    return found


def is_vietnamese(text: Column) -> Column:
    rest = F.regexp_replace(F.lower(text), r"[\x00-\x7f]+", "")  # a text is searched without its ASCII, all of which is passed over
    return F.when(F.octet_length(text) == F.length(text), False).otherwise(rest.rlike("[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]"))


def grouped(amount: Column, mark: str = ",") -> Column:
    """An amount with its thousands grouped; negative ones in parentheses."""
    shown = F.replace(F.format_number(F.abs(amount), 0), F.lit(","), F.lit(mark))
    return F.when(amount < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def html_text(html: Column) -> Column:
    """Tags as spaces, the five common entities back, white space collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def excerpt(text: Column, size: int = 160) -> Column:
    """At most ``size`` characters of one line, the last three dots where it was cut."""
    line = F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))
    return F.when(F.length(line) > size, F.concat(F.rtrim(F.substring(line, 1, size - 3)), F.lit("..."))).otherwise(line)


def markdown(text: Column) -> Column:
    """A table cell's text: pipes escaped, lines joined."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def seconds_between(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(end) - F.unix_timestamp(start)).cast("long")


def upper_token(text: Column) -> Column:
    """Capitals and digits with single underscores between them."""
    return F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def title(text: Column) -> Column:
    """``snake_case`` as words that begin with capitals."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def quarters_before(year: Column, quarter: Column, n: int) -> Column:
    """The period ``n`` quarters before, as ``YYYY-Qn``."""
    spot = year * 4 + quarter - 1 - n
    return F.concat(F.floor(spot / 4).cast("string"), F.lit("-Q"), (F.pmod(spot, F.lit(4)) + 1).cast("string"))
