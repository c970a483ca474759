"""Scalar functions over text columns: accents, numbers, periods, token estimates; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition doesn't reach.
PLAIN = (("đ", "d"), ("Đ", "D"), ("ß", "ss"))


def without_accents(text: Column) -> Column:
    """Text without the marks of accented Latin letters."""
    for letter, plain in PLAIN:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    accented = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵçñäöü"
    plain = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyycnaou"
    return F.translate(text, accented + accented.upper(), plain + plain.upper())


def parsed_amount(text: Column) -> Column:
    """A written amount as DECIMAL(38, 4): parentheses are negative; of dots and commas the last one, with one or two
    digits after it, is decimal and the others group; a lone dash or anything else is null."""
    bare = F.regexp_replace(F.trim(text), r"[ ()]", "")
    negative = F.trim(text).rlike(r"^\(.*\)$") | bare.startswith("-")
    bare = F.regexp_replace(bare, "^-", "")
    decimal = bare.rlike(r"[.,]\d{1,2}$")
    whole = F.regexp_replace(F.when(decimal, F.regexp_replace(bare, r"[.,]\d{1,2}$", "")).otherwise(bare), "[.,]", "")
    fraction = F.when(decimal, F.regexp_extract(bare, r"[.,](\d{1,2})$", 1)).otherwise("0")
    value = F.concat(whole, F.lit("."), fraction)
    good = whole.rlike(r"^\d{1,34}$")
    return F.when(good, F.when(negative, -value.cast("decimal(38,4)")).otherwise(value.cast("decimal(38,4)")))


def period(text: Column) -> Column:
    """``YYYY-Qn`` from texts such as ``Q3/2024``, ``2024-Q3`` or ``3rd quarter 2024``; null where there is none."""
    forms = ((r"[Qq]([1-4])\s*[/-]\s*(\d{4})", 2, 1), (r"(\d{4})\s*[/-]\s*[Qq]([1-4])", 1, 2), (r"([1-4])(?:st|nd|rd|th) quarter (?:of )?(\d{4})", 2, 1))
    found = [F.concat(F.nullif(F.regexp_extract(text, p, y), F.lit("")), F.lit("-Q"), F.regexp_extract(text, p, q)) for p, y, q in forms]
    return F.coalesce(*found)


def approximate_tokens(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")
