"""Markers in texts: one automaton of all marker lists, one pass over a text, and the classifiers that read what was found.

Rules over dozens of markers cost one scan instead of a search for each; markers may overlap and hold each other."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions import dialects

# Markers of a normalised text (lower case, without accents), by what they tell.
TITLES = ("bao cao tai chinh", "financial statement", "cong bo thong tin", "information disclosure", "giai trinh", "explanation")
VIETNAMESE = ("bao cao", "cong ty", "quy", "cong bo thong tin")
ENGLISH = ("financial statements", "separate financial", "consolidated financial")
BASES = {"consolidated": ("hop nhat", "consolidated"), "parent": ("cong ty me", "parent company"), "separate": ("rieng", "separate", "standalone")}
ASSURANCE = {"reviewed": ("soat xet", "reviewed"), "audited": ("kiem toan", "audited")}
AMENDED = ("dieu chinh", "bo sung", "sua doi", "thay the", "adjusted", "amended")
REPLACED = ("thay the toan bo", "full replacement")
ROLES = (
    ("business_overview", ("business overview", "tong quan tinh hinh kinh doanh")),
    ("cover_or_disclosure", ("cong bo thong tin", "information disclosure")),
    ("amendment_context_attachment", ("thuyet minh", "dieu chinh")),
    ("variance_explanation", ("giai trinh", "explanation")),
    ("financial_statement", ("bao cao tai chinh", "financial statement", "bctc")),
)
# Markers of a profile in the text of tables, as written and without accents.
INSURANCE = ("dự phòng nghiệp vụ", "du phong nghiep vu", "phí bảo hiểm", "phi bao hiem", "doanh thu hoạt động bảo hiểm", "doanh thu hoat dong bao hiem", "bồi thường bảo hiểm", "boi thuong bao hiem")
SECURITIES = (
    "fvtpl", "lưu ký chứng khoán", "luu ky chung khoan", "môi giới chứng khoán", "moi gioi chung khoan", "tự doanh chứng khoán", "tu doanh chung khoan", "cho vay giao dịch ký quỹ", "cho vay giao dich ky quy",
    "phải trả hoạt động giao dịch chứng khoán", "phai tra hoat dong giao dich chung khoan",
)
STANDARD = (
    "bảng cân đối kế toán", "bang can doi ke toan", "kết quả hoạt động kinh doanh", "ket qua hoat dong kinh doanh", "lưu chuyển tiền tệ", "luu chuyen tien te", "doanh thu thuần", "doanh thu thuan",
    "giá vốn hàng bán", "gia von hang ban", "lợi nhuận gộp", "loi nhuan gop", "hàng tồn kho", "hang ton kho", "phải thu khách hàng", "phai thu khach hang",
)
STANDARD_AT_LEAST = 3
SOURCE = tuple(dict.fromkeys((*TITLES, *VIETNAMESE, *ENGLISH, *AMENDED, *REPLACED, "cong bo", *(m for _, ms in ROLES for m in ms), *(m for d in (BASES, ASSURANCE) for ms in d.values() for m in ms))))
PROFILE = (*INSURANCE, *SECURITIES, *STANDARD)


@lru_cache(8)
def _automaton(markers: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, m in enumerate(markers):
        machine.add_word(m, i)
    machine.make_automaton()
    return machine


def first_places(text: str, markers: tuple[str, ...]) -> list[tuple[str, int]]:
    """The markers in a text in the order of ``markers``, each with the place of its first occurrence (code points, from 0)."""
    found: dict[int, int] = {}
    for end, i in _automaton(markers).iter(text):
        at = end - len(markers[i]) + 1
        found.setdefault(i, at)
    return [(markers[i], found[i]) for i in sorted(found)]


def found_in(text: Column, markers: tuple[str, ...]) -> Column:
    """Of each text an array of (marker, at) for the markers that it holds, in their order; of a null text an empty one."""
    markers = tuple(dict.fromkeys(m for m in markers if m))
    kind = pa.list_(pa.struct([("marker", pa.string()), ("at", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        return dialects.in_pieces(texts, lambda t: [{"marker": m, "at": at} for m, at in first_places(t or "", markers)] if markers else [], kind)

    return F.arrow_udf(run, "array<struct<marker:string,at:int>>")(F.coalesce(text, F.lit("")))


def has(found: Column, *markers: str) -> Column:
    return F.exists(found, lambda m: m["marker"].isin(*markers))


def role(found: Column) -> Column:
    """A source document's role: the first whose markers are there; an attachment is none if it replaces the whole."""
    out = None
    for name, ms in ROLES:
        here = has(found, *ms) & (~has(found, *REPLACED) if name == "amendment_context_attachment" else F.lit(True))
        out = F.when(here, name) if out is None else out.when(here, name)
    return out.otherwise("out_of_scope")


def language(found: Column) -> Column:
    """``vi``, ``en``, ``mixed`` of both, or ``unknown``; names of reports count where nothing else tells."""
    vi, en = has(found, *VIETNAMESE), has(found, *ENGLISH)
    return F.when(en & vi, "mixed").when(en | has(found, "financial statements"), "en").when(vi | has(found, "bao cao", "cong bo", "bctc"), "vi").otherwise("unknown")


def clues(found: Column, lists: dict[str, tuple[str, ...]]) -> Column:
    """The names of ``lists`` any of whose markers is there, in order."""
    return F.array_compact(F.array(*(F.when(has(found, *ms), F.lit(name)) for name, ms in lists.items())))


def amendment_hints(found: Column) -> Column:
    """The first four markers of an amendment."""
    return F.slice(F.transform(F.filter(found, lambda m: m["marker"].isin(*AMENDED)), lambda m: m["marker"]), 1, 4)


def confidence(role_: Column, found: Column, completed: Column, evidence: Column) -> Column:
    """How sure a classification is, in percent: by whether the evidence was read and what it is worth (none, low, more)."""
    named = (role_ == "financial_statement") & has(found, "bao cao tai chinh", "bctc")
    lost = ~F.coalesce(completed, F.lit(False)) | (evidence == "none")
    return F.when(lost & named, 60).when(lost, 0).when(evidence == "low", 45).when(role_.isin(*(n for n, _ in ROLES)), 86).otherwise(60)


def profile(found: Column) -> Column:
    """A report's profile from its tables' text: one marker of insurance, then of securities, three of a standard report."""
    count = F.size(F.filter(found, lambda m: m["marker"].isin(*STANDARD)))
    return F.when(has(found, *INSURANCE), "insurance").when(has(found, *SECURITIES), "securities").when(count >= STANDARD_AT_LEAST, "standard_corporate").otherwise("unknown")
