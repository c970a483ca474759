"""Vector codes: a codebook of ``ENTRIES`` entries for each of ``PARTS`` parts of the vectors, all in whole numbers.

Components are scaled by ``SCALE`` and floored.  A part's codebook starts as that part of the first ``ENTRIES`` vectors by
key; in each of ``ROUNDS`` rounds every part goes to its nearest entry (squared Euclidean distance, ties to the lower index),
and every entry in use becomes the floored mean of its parts.  A round is one pass: tasks hold the codebooks and one batch, and
leave a count and sums for each entry (``PARTS * ENTRIES`` cells, however many rows), which Spark adds.

Nearest entries are found by partial distances: the first guess is nearest in the dimension in which the codebook varies most
and is measured whole; every other entry is measured for all vectors of a batch at once, dimension by dimension in descending
variance of the codebook, and vectors drop out by a mask once the sum strictly exceeds their best whole distance.

Rows whose vector is null or holds null or non-finite components are dropped.  Vectors of unequal length are filled with zeros
up to the longest, and this to a multiple of ``PARTS``, so that an empty vector is the origin.  Scaled components beyond
``REACH`` either way count as that.  Rows of null key are coded but start no codebook; of rows of one key the least
vector comes first; repeated rows get a row each; fewer rows than entries make smaller codebooks; no rows at all give an empty
table.  Other columns are not returned, so that their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import store

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
REACH = 1 << 26


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key``, ``label`` and the scaled components of the rows that are kept, as 32-bit little-endian numbers in ``v``."""
    own = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.where(F.col("v").isNotNull() & ~odd)
    schema = own.schema

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            scaled = np.clip(np.floor(flat * float(SCALE)), -REACH, REACH).astype("<i4")
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            blobs = [scaled[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(blobs, pa.binary())], ["key", "label", "v"])

    return own.mapInArrow(run, f"key {schema['key'].dataType.simpleString()}, label {schema['label'].dataType.simpleString()}, v binary")


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers; what is shorter is filled with zeros."""
    return np.frombuffer(b"".join(b.ljust(4 * width, b"\0") for b in blobs), "<i4").reshape(-1, width).astype(np.int64)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the index of its nearest entry in ``book`` and the squared distance."""
    n, entries, width = len(rows), len(book), rows.shape[1]
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    spread = entries * (book.astype(object) ** 2).sum(0) - book.astype(object).sum(0) ** 2
    order = sorted(range(width), key=lambda d: (-spread[d], d))
    dims = [np.ascontiguousarray(rows[:, d]) for d in order]
    cells = book[:, order]
    which = np.abs(dims[0][:, None] - cells[None, :, 0]).argmin(1)
    best = sum((dims[d] - cells[which, d]) ** 2 for d in range(width))
    for k in range(entries):
        left = np.flatnonzero(which != k)
        total = np.zeros(len(left), np.int64)
        for d in range(width):
            total += (dims[d][left] - cells[k, d]) ** 2
            near = total <= best[left]
            left, total = left[near], total[near]
        better = (total < best[left]) | (k < which[left])
        left, total = left[better], total[better]
        which[left], best[left] = k, total
    return which, best


def codes(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances, rows by parts."""
    found = [nearest(part, book) for part, book in zip(np.split(rows, PARTS, axis=1), books)]
    return np.stack([w for w, _ in found], 1), np.stack([e for _, e in found], 1)


def fit(kept: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, parts by entries by components, after ``rounds`` rounds over all rows of ``kept``.

    Where no row has a key, each has the origin as its only entry to start from."""
    spark = kept.sparkSession
    first = kept.where("key is not null").orderBy("key", "v").limit(ENTRIES).select("v").collect()
    first = [bytes(r["v"]) for r in first] or [b""]
    books = matrix(first, width).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    shape = (*books.shape[:2], books.shape[2] + 1)
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(books)

        def run(batches, known=known):
            total = np.zeros(shape, np.int64)
            for batch in batches:
                rows = matrix(batch.column("v").to_pylist(), width)
                which, _ = codes(rows, known.value)
                for p, part in enumerate(np.split(rows, PARTS, axis=1)):
                    np.add.at(total[p], which[:, p], np.hstack([np.ones((len(rows), 1), np.int64), part]))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total.ravel()[used], pa.int64())], ["cell", "total"])

        found = kept.select("v").mapInArrow(run, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(shape, np.int64)
        for cell, value in found:
            total.flat[cell] = value
        counts = total[..., :1]
        books = np.where(counts > 0, total[..., 1:] // np.maximum(counts, 1), books)  # // floors
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """Per kept row (key, label, code, error, label_error), and the codebooks (None without any row).

    ``code`` has two hex digits a part; ``error`` is the sum of squared distances, ``label_error`` that of all rows of the label,
    nulls together.  A label's sum is joined as an ordinary equi-join, which Spark splits where one label holds much."""
    kept = store.written(whole_numbers(vectors, key, vector, label), "vectors")
    longest = kept.agg(F.max(F.octet_length("v"))).first()[0]
    width = -(-(longest or 0) // (4 * PARTS)) * PARTS
    books = np.zeros((PARTS, 1, 0), np.int64) if longest is None else fit(kept, width)
    schema = f"key {kept.schema['key'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    known = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            which, error = codes(matrix(batch.column("v").to_pylist(), width), known.value)
            text = which.astype(np.uint8).tobytes().hex()
            step = 2 * PARTS
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(error.sum(1), pa.int64())], ["key", "label", "code", "error"]
            )

    coded = store.written(kept.mapInArrow(run, schema), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), None if longest is None else books
