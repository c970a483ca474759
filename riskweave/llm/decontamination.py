"""Benchmark decontamination by latent semantic retrieval, then word order and answer checks.

Words are runs of letters, digits and non-ASCII bytes, A-Z lowered.  A passage is three consecutive steps of ``STEP``
words.  Weights are ln(words / count), with counts over all documents and all benchmark items (hashed into
``2 ** BUCKET_BITS`` buckets).  The space of passages is fitted by a distributed randomised SVD of the weighted
passage-by-word matrix over the benchmark's words: power iterations A'(A Q), summed by Spark over all passages of a block's items; the driver
orthonormalises a matrix of the benchmark block's words by ``RANK``.  Nothing is fitted on a sample.

Every passage of every document is then searched: its cosine in the latent space to a passage of an item (as long, at every
step and at the end) or to the whole item must reach ``COSINE``, so that what is asked of a copy doesn't grow with the item's
length.  A passage whose words of the benchmark weigh too little for that is passed over at once, and so are rows of fewer
words than ``WEAK`` of the shortest item; nothing else is.  A hit is read with an item's length of words on either side: its longest common subsequence with the item must hold ``STRONG``
of the item's words, or ``WEAK`` of them along with ``ANSWER`` of the item's answer (what follows a last "answer:", else
its last ``ANSWER_WORDS`` words).

The benchmark is a query set: its distinct texts are read in blocks of about ``BLOCK`` or ``BLOCK_BYTES``, each with a space of its
own, so that the rank covers what the block's passages span; ``TOGETHER`` blocks are searched in one pass over the documents,
and what is broadcast is bounded by them.  Documents are never shuffled.

Null and empty texts have no passages; null keys are returned as they are; items without words match nothing; repeated
rows each get their matches, and so do items of equal texts; a key and an item column of one name give ``name`` and ``_name``;
empty tables give an empty table.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import store, vec

STEP, STEPS = 6, 3
BUCKET_BITS, BLOCK_BITS = 20, 12
RANK, OVERSAMPLE, POWERS = 256, 16, 2
COSINE = 0.3
STRONG, WEAK, ANSWER, ANSWER_WORDS = 0.75, 0.6, 0.8, 6
BLOCK, BLOCK_BYTES, TOGETHER = 128, 1 << 16, 8
CELLS = 1 << 21  # cosines at once
FIT_TASKS = 2  # each sends a matrix of the block's words by the rank, so that few do for a block's items

_OTHER = np.ones(256, bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ANSWER = re.compile(r"answer\s*:", re.I)


@dataclass
class Index:
    """A block of items: ids, words, and the buckets of these; the latent rows of words, and the latent columns of the items'
    passages, of which every item's begin at ``edges``; the most that each word adds to any column's product; for tasks, the places
    of all buckets."""

    ids: list
    words: list[np.ndarray]
    places: list[dict[int, int]]
    answers: list[np.ndarray]
    buckets: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    edges: np.ndarray
    most: np.ndarray
    features: np.ndarray | None = None


def _words(column):
    """For runs of rows: the first row, hashes of words, and each row's first word."""
    data, offs = vec.text_buffer(column)
    for low, high in vec.spans(offs, 1 << 20):  # of a bounded number of scores
        base = offs[low]
        part = data[base : offs[high]]
        starts, ends, first = vec.split(part, offs[low : high + 1] - base, _OTHER)
        yield low, vec.hashes(part, starts, ends, vec.LOWER_BYTES), first


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of steps of words in all rows, and the row of each."""
    counts = -(-np.diff(first) // STEP)
    row = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[row] + nth * STEP, row


def _counted(texts: DataFrame) -> np.ndarray:
    """How often words come in all of ``texts``, by bucket."""
    size, step = 1 << BUCKET_BITS, 1 << BLOCK_BITS

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, hashes, _ in _words(batch.column("text")):
                total += np.bincount(_bucket(hashes), minlength=size)
        used = np.flatnonzero(total.reshape(-1, step).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in used], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "block int, counts binary"
    found = texts.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow()
    out = np.zeros(size, np.int64)
    for block, blob in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[block * step : (block + 1) * step] = np.frombuffer(zlib.decompress(blob), np.int64)
    return out


def _summed(rows: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum over partitions of ``make(batches)``, a float64 matrix of ``shape``, added in blocks of rows."""
    step = 512

    def run(batches):
        part = make(batches)
        blocks = range(0, shape[0], step)
        yield pa.RecordBatch.from_arrays([pa.array([b // step for b in blocks], pa.int32()), pa.array([part[b : b + step].tobytes() for b in blocks], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, sums binary"
    found = rows.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow()
    out = np.zeros(shape)
    for block, blob in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[block * step : block * step + step] = np.frombuffer(blob, np.float64).reshape(-1, shape[1])
    return out


def _passages(batches, features: np.ndarray, weights: np.ndarray):
    """For runs of rows, the passages' word features and weights: (feature, weight, passage, count)."""
    for batch in batches:
        for _, hashes, first in _words(batch.column("text")):
            bucket = _bucket(hashes)
            feature = features[bucket]
            starts, row = _blocks(first)
            ends = np.minimum(starts + STEP * STEPS, first[row + 1])
            use = (ends - starts == STEP * STEPS) | (starts == first[row])
            starts, ends = starts[use], ends[use]
            sizes = ends - starts
            at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            passage = np.repeat(np.arange(len(sizes)), sizes)
            weight = weights[bucket[at]]
            norm = np.sqrt(np.bincount(passage, weight.astype(np.float64) ** 2, len(sizes)))
            good = feature[at] >= 0
            yield feature[at][good], (weight / np.maximum(norm[passage], 1e-9))[good], passage[good], len(sizes)


def _features(buckets: np.ndarray) -> np.ndarray:
    """The place of every bucket in ``buckets``, -1 for the others."""
    features = np.full(1 << BUCKET_BITS, -1, np.int32)
    features[buckets] = np.arange(len(buckets))
    return features


def _basis(rows: DataFrame, buckets: np.ndarray, weights: Broadcast) -> np.ndarray:
    """Orthonormal right singular vectors (words by rank) of the passages of ``rows``, by randomised power iterations."""
    spark, n = rows.sparkSession, len(buckets)
    rank = min(RANK + OVERSAMPLE, n)

    def product(matrix: np.ndarray, gram: bool):
        cast = spark.sparkContext.broadcast(matrix.astype(np.float32))

        def make(batches):
            q, own, weight = cast.value, _features(buckets), weights.value
            total = np.zeros((q.shape[1] if gram else n, q.shape[1]))
            for feature, value, passage, count in _passages(batches, own, weight):
                y = np.zeros((count, q.shape[1]), np.float32)
                edges = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(passage) else np.zeros(0, np.int64)
                if len(edges):
                    y[passage[edges]] = np.add.reduceat(q[feature] * value[:, None].astype(np.float32), edges)
                if gram:
                    total += y.T @ y
                else:
                    order = np.argsort(feature, kind="stable")
                    edges = np.flatnonzero(np.append(True, feature[order][1:] != feature[order][:-1])) if len(order) else np.zeros(0, np.int64)
                    if len(edges):
                        total[feature[order][edges]] += np.add.reduceat(y[passage[order]] * value[order][:, None].astype(np.float32), edges)
            return total

        found = _summed(rows, make, (rank if gram else n, rank))
        cast.destroy()  # a copy of it is on the disk of every machine
        return found

    q = np.random.Generator(np.random.PCG64(11)).standard_normal((n, rank))
    for _ in range(POWERS):
        q = np.linalg.qr(product(q, False))[0]
    values, turn = np.linalg.eigh(product(q, True))
    return q @ turn[:, ::-1][:, : min(RANK, rank)]


def _index(spark: SparkSession, items: list, weights: Broadcast) -> Index | None:
    """The search index of a block of items, fitted on all of them."""
    texts = [t or "" for _, t in items]
    words = [h for _, hashes, first in _words(pa.array(texts, pa.string())) for h in np.split(hashes, first[1:-1])]
    use = [i for i, w in enumerate(words[: len(items)]) if len(w)]
    if not use:
        return None
    tails = [texts[i][m[-1].end() :] if (m := list(_ANSWER.finditer(texts[i]))) else None for i in use]
    answers = [next(_words(pa.array([t])))[1] if t and t.strip() else words[i][-ANSWER_WORDS:] for i, t in zip(use, tails)]
    buckets = np.unique(np.concatenate([_bucket(words[i]) for i in use]))
    features = _features(buckets)
    basis = _basis(spark.createDataFrame([(texts[i],) for i in use], "text string").coalesce(FIT_TASKS), buckets, weights)
    store.settle(spark)
    parts = [_parts(words[i]) for i in use]
    columns = [np.unique(features[_bucket(w)]) for part in parts for w in part]
    own = weights.value[buckets]
    latent = np.stack([basis[c].T @ own[c] for c in columns], axis=1)
    latent /= np.maximum(np.linalg.norm(latent, axis=0), 1e-9)
    basis = np.vstack([basis * own[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    edges = np.cumsum([0, *map(len, parts[:-1])])
    return Index([items[i][0] for i in use], [words[i] for i in use], [_places(words[i]) for i in use], answers, buckets, basis, latent.astype(np.float32), edges, (basis @ latent).max(axis=1).astype(np.float32))


def _parts(words: np.ndarray) -> list[np.ndarray]:
    """The passages of an item, at every step and at its end, and the whole of it."""
    last = len(words) - STEP * STEPS
    if last <= 0:
        return [words]
    return [words[a : a + STEP * STEPS] for a in sorted({*range(0, last, STEP), last})] + [words]


def _places(words: np.ndarray) -> dict[int, int]:
    """Of every word, the bits of its places."""
    places: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    return places


def _common(places: dict[int, int], size: int, words: np.ndarray, least: float) -> int:
    """Length of the longest common subsequence with an item of ``size`` words; 0 where it can't reach ``least``."""
    found = [m for w in words.tolist() if (m := places.get(w))]
    if len(found) < least:
        return 0
    full = row = (1 << size) - 1
    for m in found:
        u = row & m
        row = (row + u | row - u) & full
    return size - row.bit_count()


def _read(hashes: np.ndarray, first: np.ndarray):
    """Of a run of rows: words' hashes, rows' first words, the place before of each equal word, and steps with ends and rows."""
    order = np.argsort(hashes, kind="stable")
    again = hashes[order[1:]] == hashes[order[:-1]]
    before = np.full(len(hashes), -1)
    before[order[1:][again]] = order[:-1][again]
    starts, row = _blocks(first)
    return hashes, _bucket(hashes), first, before, starts, np.minimum(starts + STEP * STEPS, first[row + 1]), row


def _search(run, index: Index, weights: np.ndarray):
    """Matches (row, item, cosine, common share, first word, word beyond) of a run of rows that was read."""
    hashes, bucket, first, before, starts, ends, row = run
    if not len(hashes):
        return
    weight, feature = weights[bucket], index.features[bucket]
    whole = (ends - starts > STEP * (STEPS - 1)) | (starts == first[row])
    whole &= (first[row + 1] - first[row]) >= WEAK * min(map(len, index.words))
    passages = np.flatnonzero(whole)
    beyond: dict[tuple[int, int], int] = {}
    size = max(1, CELLS // max(index.latent.shape))
    for low in range(0, len(passages), size):
        some = passages[low : low + size]
        at = starts[some][:, None] + np.arange(STEP * STEPS)
        counts = at < ends[some][:, None]
        at = np.minimum(at, len(hashes) - 1)
        counts &= before[at] < starts[some][:, None]  # a word counts once in a passage
        own, value = np.where(counts, feature[at], -1), np.where(counts, weight[at], 0)  # -1: the row of zeros
        yield from _hits(own, value, some, hashes, first, starts, ends, row, index, beyond)


def _hits(own, value, some, hashes, first, starts, ends, row, index: Index, beyond: dict):
    """Matches of the passages ``some``, of whose words ``own`` are the features and ``value`` the weights."""
    norm = np.sqrt(np.einsum("ij,ij->i", value, value))
    value = np.where(own < 0, 0, value)
    known = np.sqrt(np.einsum("ij,ij->i", value, value))
    use = (norm > 0) & (known >= COSINE * norm * (1 - 1e-6)) & (index.most[own].sum(axis=1) >= (COSINE - 1e-4) * norm)  # neither bound is below a cosine
    own, some, norm = own[use], some[use], norm[use]
    if not len(some):
        return
    place = np.zeros((len(some), index.basis.shape[1]), np.float32)
    for k in range(STEP * STEPS):
        place += index.basis[own[:, k]]
    near = np.flatnonzero(np.sqrt(np.einsum("ij,ij->i", place, place)) >= (COSINE - 1e-4) * norm)  # no cosine is above that share
    latent = place[near] @ index.latent
    least = (COSINE * norm[near]).astype(np.float32)
    some_column = np.flatnonzero(latent.max(axis=1, initial=0) >= least)  # few passages have any
    r, c = np.nonzero(latent[some_column] >= least[some_column][:, None])
    r = some_column[r]
    cosine = latent[r, c] / norm[near[r]]
    pair = near[r] * len(index.edges) + np.searchsorted(index.edges, c, "right") - 1
    order = np.lexsort((-cosine, pair))
    pair, cosine = pair[order], cosine[order]
    best = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
    for i, j, score in zip(*(x.tolist() for x in (pair[best] // len(index.edges), pair[best] % len(index.edges), cosine[best]))):
        r, item, answer = int(row[some[i]]), index.words[j], index.answers[j]
        if beyond.get((r, j), -1) > starts[some[i]]:
            continue
        a, b = max(int(first[r]), int(starts[some[i]]) - len(item)), min(int(first[r + 1]), int(ends[some[i]]) + len(item))
        region = hashes[a:b]
        share = _common(index.places[j], len(item), region, WEAK * len(item)) / len(item)
        if share >= STRONG or (share >= WEAK and _common(_places(answer), len(answer), region, 1) >= ANSWER * len(answer)):
            beyond[r, j] = b
            yield r, j, score, share, a - int(first[r]), b - int(first[r])


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Matches: ``key``, ``item``, cosine, common (share of the item's words in order), first_word, last_word (exclusive).

    Several places of a document can match an item; places whose words overlap give one."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).withColumn("of", digest)
    key_kind = own.schema["key"].dataType.simpleString()
    counts = _counted(own.select("text").union(items.select("text")))
    weights = spark.sparkContext.broadcast(np.log((counts.sum() + 1) / np.maximum(counts, 1)).astype(np.float32))  # for all blocks
    distinct = store.written(items.groupBy("of").agg(F.first("text").alias("text")), "items")
    count, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK), -(-size // BLOCK_BYTES))
    schema = f"key {key_kind}, of string, cosine double, common double, first_word long, last_word long"
    found = spark.createDataFrame([], schema)

    def search(indexes: list[Index]) -> DataFrame:
        cast = spark.sparkContext.broadcast([tuple(getattr(index, f.name) for f in fields(Index)[:-1]) for index in indexes])  # executors need no class

        def run(batches):
            known = [Index(*x) for x in cast.value]
            for index in known:
                index.features = _features(index.buckets)
            for batch in batches:
                out = []
                for low, hashes, first in _words(batch.column("text")):
                    read = _read(hashes, first)
                    out += [(low + r, index.ids[j], *rest) for index in known for r, j, *rest in _search(read, index, weights.value)]
                rows, *rest = zip(*out) if out else [()] * 6
                columns = [batch.column("key").take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "of", "cosine", "common", "first_word", "last_word"])

        kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return own.mapInArrow(run, schema)

    for block in range(0, blocks, TOGETHER):
        indexes = []
        for b in range(block, min(block + TOGETHER, blocks)):
            part = distinct.where(F.pmod(F.xxhash64("of"), F.lit(blocks)) == b).orderBy("of").collect()
            indexes.append(_index(spark, [(r["of"], r["text"]) for r in part], weights))
        if any(indexes):
            found = found.union(search([index for index in indexes if index is not None]))
    # A text's matches are those of every item that has it.
    named = found.join(items.select("of", "item"), "of").select("key", "item", "cosine", "common", "first_word", "last_word")
    return named.toDF(key, item if item.lower() != key.lower() else f"_{item}", "cosine", "common", "first_word", "last_word")
