"""Toxicity by maximum-scoring segments over token log-odds.

Features of a word (a run of letters, digits and non-ASCII bytes, A-Z lowered) are the word and its first 5 and 7
bytes, hashed into ``2 ** BUCKET_BITS`` buckets.  Training counts, for each bucket, the toxic and the other documents
that have it; of equal and nearly equal texts one counts, a toxic one if there is any.  A bucket's weight is the lower confidence bound of its log-odds under an
informative Dirichlet prior (the overall counts, scaled); buckets whose bound isn't above ``LEAN`` count ``-DRIFT``.  Scoring sums weights over a text in one linear scan and finds all maximal scoring segments.  A segment's score S
becomes an E-value K n exp(-lambda S): lambda solves sum p exp(lambda s) = 1 over the training words, K follows from
the upper tail (quantile ``TAIL``) of the clean training documents' maxima under a Gumbel law.  A document's evidence is the sum of -ln E over
its segments of E below 1 (those below ``SIGNIFICANT`` are its passages); a logistic curve fitted on the training documents maps it to 0..1.

Training rows are at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their keys; they, the buckets and the
model are of fixed size, so that all may be broadcast.  Everything else reads all rows whole, in one pass, unshuffled.

Null and empty texts have no evidence and get the curve's value for none.  Without toxic or other training rows all
scores are 0.  Equal texts get equal scores; repeated rows each get a row; labels, language, source and key are no
inputs.  Extra columns pass through.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from riskweave.llm import store, vec

TRAIN_ROWS = 50_000
BUCKET_BITS = 20
BLOCK_BITS = 12
STEMS = (5, 7)
PRIOR_SCALE = 0.03
SURE = 2.5
DRIFT = 1.0
LEAST_DOCS = 4
LEAN = 0.7
TAIL = 0.99
SIGNIFICANT = 0.01

_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    """Weights of buckets; lambda and ln K of the extreme-value law; the curve's intercept and slope."""

    weights: np.ndarray
    rate: float
    log_k: float
    curve: tuple[float, float]


def _features(column: pa.ChunkedArray):
    """For runs of rows: first row, starts, ends, rows' first words, and the buckets of each word's features."""
    data, offs = vec.text_buffer(column)
    for low, high in vec.spans(offs):
        base = offs[low]
        part = data[base : offs[high]]
        starts, ends, first = vec.split(part, offs[low : high + 1] - base, _OTHER)
        found = [vec.hashes(part, starts, np.minimum(ends, starts + n) if n else ends, vec.LOWER_BYTES) for n in (0, *STEMS)]
        yield low, part, offs[low : high + 1] - base, starts, ends, first, [(x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for x in found]


def _sketched(batches):
    """Two minima over the hashes of each text's 4-word windows: equal and nearly equal texts mostly share them."""
    for batch in batches:
        least = np.zeros((2, batch.num_rows), np.uint64)
        for low, _, _, _, _, first, buckets in _features(batch.column("text")):
            for i, factor in enumerate((0xD6E8FEB86659FD93, 0xA3EC647659359ACD)):
                value = vec.windows(buckets[0].astype(np.uint64), 4, factor)
                for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    own = value[a : b - 3] if b - a >= 4 else buckets[0][a:b].astype(np.uint64)
                    least[i, low + r] = own.min() if len(own) else 0
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in least)], ["text", "toxic", "a", "b"])


def _count(batches):
    """Per block of buckets: documents of either label that have the bucket, and how often it comes, over a partition."""
    size = 1 << BUCKET_BITS
    totals = np.zeros((2, size), np.int32)
    words = np.zeros(size, np.int32)
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for low, _, _, _, _, first, buckets in _features(batch.column("text")):
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pairs = np.unique(np.concatenate([owner * size + b for b in buckets])) if len(owner) else np.zeros(0, np.int64)
            marks = label[low + pairs // size]
            for y in (0, 1):
                totals[y] += np.bincount(pairs[marks == y] % size, minlength=size).astype(np.int32)
            for b in buckets[:1]:
                words += np.bincount(b, minlength=size).astype(np.int32)
    step = 1 << BLOCK_BITS
    used = [i for i in range(size // step) if words[i * step : (i + 1) * step].any() or totals[:, i * step : (i + 1) * step].any()]
    blobs = [np.stack([totals[0], totals[1], words])[:, i * step : (i + 1) * step].tobytes() for i in used]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["block", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int32).astype(np.int64) for b in table.column("counts").to_pylist())
    return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _maximal(gain: list[float], before: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments over positive items: (first, last, score); before: the sum ahead of each item."""
    kept: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, the nearest that starts lower
    for i, (g, left) in enumerate(zip(gain, before)):
        right, first, j = left + g, i, len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= right:
                break
            left, _, first, _, lower = kept[j]
            del kept[j:]
            j = lower
        kept.append((left, right, first, i, j))
    return [(a, b, right - left) for left, right, a, b, _ in kept]


def _evidence(batch: pa.RecordBatch, text: str, weights: np.ndarray, rate: float, log_k: float):
    """Per row: best segment's score, words, evidence, and significant segments as (start, end, evidence)."""
    n_rows = batch.num_rows
    best, words, total, passages = np.zeros(n_rows), np.zeros(n_rows, np.int64), np.zeros(n_rows), [[] for _ in range(n_rows)]
    for low, data, offs, starts, ends, first, buckets in _features(batch.column(text)):
        words[low : low + len(first) - 1] = np.diff(first)
        score = np.max([weights[b] for b in buckets], axis=0) if len(starts) else np.zeros(0)
        good = np.flatnonzero(score > 0)
        if not len(good):
            continue
        sums = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        row = np.searchsorted(first, good, "right") - 1
        edges = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(good))):
            r = int(row[a])
            at = good[a:b]
            found = _maximal((sums[at + 1] - sums[at]).tolist(), (sums[at] - sums[first[r]]).tolist())
            best[low + r] = max(s for _, _, s in found)
            size = math.log(words[low + r]) + log_k
            for i, j, s in found:
                sure = rate * s - size
                total[low + r] += max(0.0, sure)
                if sure > -math.log(SIGNIFICANT):
                    head, tail = (int(points[p] - points[offs[r]]) for p in (starts[at[i]], ends[at[j]]))
                    passages[low + r].append({"start": head, "end": tail, "evidence": sure})
    return best, words, total, passages


def _law(weights: np.ndarray, words: np.ndarray) -> float:
    """The positive root of the mean of exp(rate * score) = 1 over words, by bisection."""
    share = words / max(1, words.sum())
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            low, high = (low, mid) if (share * np.exp(mid * weights)).sum() > 1 else (mid, high)
    return low


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton's method with a small ridge."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 1e-3, design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def learnable(key: Column) -> Column:
    """Whether a row may be learnt from: crc32 of the key as text, modulo 3, isn't 1."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", key: str = "doc_id") -> Model | None:
    """The model of at most ``rows`` labelled, learnable documents; none without both labels."""
    chosen = labels.where(F.col("toxic").isNotNull() & learnable(F.col(key))).select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("key", F.lit(1)), "toxic").limit(rows).groupBy("key").agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    # Of fixed size, see the module's docstring; in the shared folder it is as large as ``rows`` whole texts.
    sample = own.join(F.broadcast(chosen), "key").select("text", "toxic").mapInArrow(_sketched, "text string, toxic int, a long, b long")
    chosen = F.max_by(F.struct("text", "toxic"), F.struct("toxic", F.xxhash64("text"), "text"))
    sample = store.written(sample.groupBy("a", "b").agg(chosen.alias("row")).select("row.text", "row.toxic"), "toxic")
    counts = sample.mapInArrow(_count, "block int, counts binary").groupBy("block").applyInArrow(_add, "block int, counts binary").toArrow()
    size, step = 1 << BUCKET_BITS, 1 << BLOCK_BITS
    table = np.zeros((3, size), np.int64)
    for block, blob in zip(counts.column("block").to_pylist(), counts.column("counts").to_pylist()):
        table[:, block * step : (block + 1) * step] = np.frombuffer(zlib.decompress(blob), np.int64).reshape(3, step)
    clean, toxic, words = table
    marks = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = marks.get(0, 0), marks.get(1, 0)
    if not n0 or not n1:
        return None
    prior = PRIOR_SCALE * (clean + toxic + 1.0)
    a1, a0 = toxic + prior, clean + prior
    odds = np.log(a1 / (n1 * (1 + PRIOR_SCALE))) - np.log(a0 / (n0 * (1 + PRIOR_SCALE)))
    bound = odds - SURE * np.sqrt(1 / a1 + 1 / a0)
    weights = np.where((bound > LEAN) & (toxic >= LEAST_DOCS), bound, -DRIFT).astype(np.float32)
    rate = _law(weights, words)
    cast = docs.sparkSession.sparkContext.broadcast(weights)

    def measure(batches):
        for batch in batches:
            best, n, _, _ = _evidence(batch, "text", cast.value, rate, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(n), batch.column("toxic")], ["best", "n", "toxic"])

    seen = sample.mapInArrow(measure, "best double, n long, toxic int").where("n > 0").toArrow()
    best, n, y = (seen.column(c).to_numpy() for c in ("best", "n", "toxic"))
    rest = y == 0
    log_k = float(np.quantile(rate * best[rest] - np.log(n[rest]), TAIL) + math.log(-math.log(TAIL))) if rest.any() else 0.0

    def weigh(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_evidence(batch, "text", cast.value, rate, log_k)[2]), batch.column("toxic")], ["x", "toxic"])

    seen = sample.mapInArrow(weigh, "x double, toxic int").toArrow()
    x, y = seen.column("x").to_numpy(), seen.column("toxic").to_numpy().astype(float)
    return Model(weights, rate, log_k, _curve(np.log1p(x), y))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``passages``: array of (start, end, evidence), in code points, end exclusive."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    at = names[docs.columns.index(text)]
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("evidence", DoubleType())])
    passage_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
    spark = docs.sparkSession
    cast = spark.sparkContext.broadcast(model and (model.weights, model.rate, model.log_k, model.curve))  # executors need no class

    def run(batches):
        own = cast.value and Model(*cast.value)
        for batch in batches:
            if own is None:
                x, passages = np.full(batch.num_rows, -np.inf), [[] for _ in range(batch.num_rows)]
                value = np.zeros(batch.num_rows)
            else:
                _, _, x, passages = _evidence(batch, at, own.weights, own.rate, own.log_k)
                value = 1 / (1 + np.exp(-np.clip(own.curve[0] + own.curve[1] * np.log1p(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array(passages, passage_type)], [*batch.schema.names, "__score", "__passages"])

    schema = StructType([*inner.schema.fields, StructField("__score", DoubleType()), StructField("__passages", ArrayType(span))])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, store.fresh(docs, "score"), store.fresh(docs, "passages"))
