"""Substring dedup with fixed-block anchors.

Words are the runs between ASCII white space, unchanged.  A window is ``length`` (13) consecutive words.  Every word
that lies in a window which also starts in a document of a smaller key is removed.

Blocks of ``(length + 1) // 2`` words at their multiples are the index, and every rolling window of that many words
probes it: 13 words hold a whole block of 7 wherever they begin.  Hits are extended both ways to all windows of
``length`` around them; windows are compared by 64-bit hashes (see ``repeats``), and where they go on matching, their
union is the maximal repeat.

Null texts have no words; a text of fewer words than a window keeps all; copies of a text lose all their words but in
the smallest document; rows of equal key don't shorten each other; rows of null key stay whole and shorten none; an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from itertools import compress

from pyspark.sql import DataFrame

from riskweave.llm import repeats, vec

LENGTH = 13


def _join(data, starts, ends, keep):
    words = data.split()
    return b" ".join(words if keep.all() else compress(words, keep))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the kept words, joined by one space, as ``text``; and ``n_units`` words, ``n_removed`` of them."""
    block = (length + 1) // 2
    search = repeats.Search(vec.SPACES, length, block, repeats.fixed_blocks(block), ordered=False)
    return repeats.remove(docs, search, _join, text, key)
