"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds, in this order: ``email``, ``ip`` (parts at most 255), ``card`` (16 to 19 digits, Luhn), ``phone`` (+, 8 to 15
digits) and ``iban`` (two letters, two digits, 11 to 30 more capitals or digits, single spaces between them, mod 97 equal to
1; where the longest run fails, the one before its last space is tried, and so on).  Per kind
the matches are leftmost and don't overlap; those that fail their check are dropped without another try.  Kinds may
overlap.  Every pattern runs in linear time on any text: emails are grown from each ``@``, runs of digits are entered
at their start only.

A span's score starts from its kind's base, rises for a checksum and for a word of its kind within 40 characters, and
falls for a word such as ``example``; spans of ``LIKELY`` or more are those that a filter should act on.  Null texts count as empty and have no span; positions are code points, end
exclusive; rows are treated alone, so repeated rows get equal spans; other columns pass through.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from riskweave.llm import store, vec

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
CONTEXT = 40
LIKELY = 0.5
_BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.5, "phone": 0.5, "iban": 0.5}
_CHECKED = {"card": 0.3, "iban": 0.4}
_NEAR = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mail|reply)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|payment|cc)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|cell)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer|bic)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:example|sample|test|dummy|version|placeholder)\b", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ODD = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled with its digits added, and the others sum to a multiple of 10."""
    return (sum(map(int, digits[-1::-2])) + sum(map(int, digits[-2::-2].translate(_ODD)))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number, its first four characters moved to its end and letters as 10 to 35, leaves 1 by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _base(text: str):
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(map(_part_ok, m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by kind and start."""
    found = list(_base(text))
    for m in _IBAN.finditer(text):
        shown = m[0]
        while 15 <= len(account := shown.replace(" ", "")) and not mod97(account):
            shown = shown.rpartition(" ")[0]
        if len(account) >= 15:
            found.append(("iban", m.start(), m.start() + len(shown)))
    out = []
    for kind, start, end in found:
        near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}"
        score = _BASE_SCORE[kind] + _CHECKED.get(kind, 0.0) + 0.2 * bool(_NEAR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near))
        out.append((kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return out


def detect_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score)."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    inner = docs.toDF(*names)
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for low, high in vec.spans(vec.text_buffer(batch.column(at))[1]):
                part = batch.slice(low, high - low)
                found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in find_pii(t or "")] for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind_of)], [*part.schema.names, "__pii"])

    schema = StructType([*inner.schema.fields, StructField("__pii", ArrayType(span))])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, store.fresh(docs, "pii"))
