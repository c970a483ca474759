"""Line dedup by winnowing over line hashes.

Lines are the runs between line ends (``\\n``, ``\\r``); blank ones count for nothing.  A run is at least ``length``
(2) lines, or one line of at least ``words`` (50) words between ASCII white space, whose hash is its fingerprint by itself
(0: no line is a run alone).  Every window of ``window = length - gram + 1`` line grams gives its least hash as fingerprint, so that any
two runs share one.  Fingerprints are joined by value; around each shared one the match is extended both ways over
whole windows of ``length`` lines; of every run but the first (least key, then place) the lines are deleted.  Runs of
two lines go together, so that one line of a form letter stays where no neighbour repeats.

Null texts count as empty and come back empty; texts without a repeat come back byte for byte; deleted lines go with
their line end.  An earlier run in the same document counts.  Rows of equal key and equal place are no repeats of each
other; rows of null key stay whole and delete none; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from riskweave.llm import repeats, vec

LENGTH, GRAM, WORDS = 2, 1, 50


def _join(data, starts, ends, keep):
    if keep.all():
        return data
    edges = np.append(starts, len(data))
    head = data[: int(edges[0])]
    return (head + b"".join(data[int(a) : int(b)] for a, b, k in zip(edges[:-1], edges[1:], keep) if k)).rstrip(b"\r\n")


def dedup_lines(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the lines of later repeated runs; and ``n_units`` lines, ``n_removed`` of them."""
    search = repeats.Search(vec.BREAKS, length, gram, repeats.winnowed(gram, length - gram + 1), ordered=True, alone=words)
    return repeats.remove(docs, search, _join, text, key)
