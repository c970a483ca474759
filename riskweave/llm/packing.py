"""Packing by minimum bin slack.

Texts become token ids (byte-level BPE from a vocabulary file, special tokens' strings as ordinary text) and an end id.
A document longer than a window is cut into whole windows and a rest.  From the counts of the pieces' lengths, at most
``window`` numbers, the plan is made: the longest piece left opens a sequence, and a subset-sum over a bitset of the
other lengths, each as often as it is left, finds the multiset that fills the window closest; it is repeated while its
counts last.  Each step uses up a length, so that the plan has few steps, however many pieces.  Pieces of a length are
ranked (in ranges of a hash, so that a frequent length is ranked by many tasks), and the plan's entry for a rank says
sequence and offset.

Null texts count as empty; an empty text is the end id alone; very long texts are cut; repeated rows are packed each; an
empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import store, vec

WINDOW = 2048
END_ID = 1
CACHE = 1_000_000
LONGEST = 200
TOGETHER = 128


class _Tokens:
    """Token ids of texts; runs from a single space to the next are encoded once while the cache holds them.

    The pattern of byte-level BPE never joins across a single space between other characters; texts with white space
    beside white space, special strings, or a run over ``LONGEST`` are encoded whole.  The cache knows a run by two 64-bit
    hashes, in a sorted array, and its ids in a pool: at most ``CACHE`` runs, some 40 bytes each.  A full cache keeps what
    came again."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(vocabulary)
        self.encoder.encode_special_tokens = True
        self.special = tuple(t.content for t in self.encoder.get_added_tokens_decoder().values())
        self.double = re.compile(r"\s\s")
        names = self.encoder.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    @staticmethod
    def of_worker(vocabulary: str) -> _Tokens:
        """The encoder that tasks of one Python worker share: functions come to it by value, so a module holds it."""
        held = sys.modules.setdefault("riskweave_encoders", ModuleType("riskweave_encoders")).__dict__
        return held.setdefault(vocabulary, None) or held.update({vocabulary: _Tokens(vocabulary)}) or held[vocabulary]

    def _flat(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after another, and where each ends."""
        sizes = self.sizes[which].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def _forget(self) -> None:
        keep = np.flatnonzero(self.hits > 1)
        keep = keep if len(keep) < CACHE // 2 else keep[:0]
        self.pool, ends = self._flat(keep)
        self.one, self.two, self.sizes = self.one[keep], self.two[keep], self.sizes[keep]
        self.starts, self.hits = ends - self.sizes, np.ones(len(keep), np.int32)

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``runs`` and the number of each: many that begin with a space are encoded as one text."""
        sizes = np.zeros(len(runs), np.int64)
        found: list[np.ndarray | None] = [None] * -(-len(runs) // TOGETHER)
        groups = [runs[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]
        for k, e in enumerate(self.encoder.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            edges = np.flatnonzero(self.opens[ids])
            if groups[k][0][:1] != " " or len(edges) != len(groups[k]):  # a run at a row's start
                each = [e.ids for e in self.encoder.encode_batch_fast(groups[k], add_special_tokens=False)]
                ids, edges = np.fromiter(chain.from_iterable(each), np.uint32), np.cumsum([0, *map(len, each)])[:-1]
            found[k] = ids
            sizes[k * TOGETHER : (k + 1) * TOGETHER] = np.diff(np.append(edges, len(ids)))
        return np.concatenate(found), sizes

    def _learn(self, one: np.ndarray, two: np.ndarray, runs: list[str]) -> np.ndarray:
        """Add entries; returns where all entries, old ones and then the new, are from here on."""
        ids, sizes = self._ids(runs)
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids])
        one = np.concatenate([self.one, one])
        order = np.argsort(one, kind="stable")
        self.one, self.two = one[order], np.concatenate([self.two, two])[order]
        self.starts, self.sizes = np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes.astype(np.int32)])[order]
        self.hits = np.concatenate([self.hits, np.zeros(len(sizes), np.int32)])[order]
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        return moved

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The entry of each run, or -1."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        data, offs = vec.text_buffer(column)
        texts = column.to_pylist()
        head = np.zeros(len(data) + 1, bool)
        head[np.flatnonzero(data == 0x20)] = True
        head[offs[:-1]] = True
        starts = np.flatnonzero(head[:-1])
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offs)
        longest = np.zeros(len(texts), np.int64)
        filled = np.flatnonzero(np.diff(first))
        if len(filled):
            longest[filled] = np.maximum.reduceat(ends - starts, first[filled])
        whole = [i for i, t in enumerate(texts) if t and (longest[i] > LONGEST or self.double.search(t) or any(s in t for s in self.special))]
        out = [np.zeros(0, np.uint32)] * len(texts)
        for i, e in zip(whole, self.encoder.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32)
        rows = np.setdiff1d(filled, whole)
        counts = first[rows + 1] - first[rows]
        use = np.repeat(first[rows] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        if not len(use):
            return out
        if len(self.one) > CACHE:
            self._forget()
        one, two = (vec.hashes(data, starts, ends, table)[use] for table in (vec.BYTES, vec.OTHER_BYTES))
        which = self._find(one, two)
        if len(new := np.flatnonzero(which < 0)):
            known = len(self.one)
            _, at, same = np.unique(one[new], return_index=True, return_inverse=True)
            chosen = new[at]
            runs = [data[starts[k] : ends[k]].tobytes().decode() for k in use[chosen]]
            order = np.argsort([r[:1] != " " for r in runs], kind="stable")  # runs at a row's start come last
            moved = self._learn(one[chosen[order]], two[chosen[order]], [runs[k] for k in order])
            place = np.empty(len(order), np.int64)
            place[order] = moved[known:]
            which = np.where(which >= 0, moved[which], -1)
            which[new] = np.where(two[new] == two[chosen][same], place[same], -1)
        if (lost := which < 0).any():  # equal in one hash only: encoded on their own
            for i in np.unique(np.repeat(rows, counts)[lost]):
                out[i] = np.array(self.encoder.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            keep = ~np.isin(np.repeat(rows, counts), np.unique(np.repeat(rows, counts)[lost]))
            rows, which = np.unique(np.repeat(rows, counts)[keep], return_counts=True), which[keep]
            rows, counts = rows
            if not len(rows):
                return out
        self.hits += np.bincount(which, minlength=len(self.hits)).astype(np.int32)
        flat, ends = self._flat(which)
        for i, ids in zip(rows.tolist(), np.split(flat, ends[np.cumsum(counts) - 1][:-1])):
            out[i] = ids
        return out


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of at most ``window`` ids: key, start, length, ids_crc32, doc_tokens, and on wish their ``ids``."""

    def run(batches):
        tokens = _Tokens.of_worker(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            for low, high in vec.spans(vec.text_buffer(texts)[1], 1 << 20):
                rows, starts, sizes, sums, totals, kept = [], [], [], [], [], []
                for i, found in enumerate(tokens.encode(texts.slice(low, high - low)), low):
                    ids = np.append(found, np.uint32(END_ID)).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        rows.append(i)
                        starts.append(at)
                        sizes.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                        if with_ids:
                            kept.append(piece.astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names)
        tokens.clear()  # a task's cache goes with it

    names = ["key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def _fill(left: dict[int, int], gap: int) -> dict[int, int]:
    """The multiset of ``left``'s lengths whose sum is closest below or at ``gap``; longer ones first."""
    reach, mask, steps = 1, (1 << (gap + 1)) - 1, []
    for size in sorted((s for s in left if s <= gap and left[s]), reverse=True):
        many, k = min(left[size], gap // size), 1
        while many and not reach >> gap & 1:
            k = min(k, many)
            steps.append((size, k, reach))
            reach |= reach << size * k & mask
            many -= k
            k *= 2
        if reach >> gap & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + k
            at -= size * k
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first rank, rank beyond, pieces per sequence, first sequence, offset) that place all pieces."""
    left, used, sequence, out = dict(counts), dict.fromkeys(counts, 0), 0, []
    for longest in sorted(counts, reverse=True):
        while left[longest]:
            left[longest] -= 1
            chosen = _fill(left, window - longest)
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(left[s] // k for s, k in chosen.items())
            offset = 0
            for size in sorted(chosen, reverse=True):
                k = chosen[size]
                out.append((size, used[size], used[size] + k * times, k, sequence, offset))
                used[size] += k * times
                left[size] -= k * times
                offset += size * k
            sequence += times
    return out


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (key, start, length, ids_crc32, ...) with ``sequence_id`` and ``offset`` (long)."""
    spark = pieces.sparkSession
    ranges = 4 * store.partitions(spark)
    hashed = pieces.withColumn("__range", F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(ranges)).cast("int"))
    sizes = hashed.groupBy("length", "__range").count()
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}  # at most window rows
    entries = spark.createDataFrame(plan(counts, window), "length long, low long, high long, each long, first long, base long")
    before = Window.partitionBy("length").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = hashed.withColumn("__place", F.row_number().over(Window.partitionBy("length", "__range").orderBy("key", "start", "ids_crc32")))
    ranked = ranked.join(sizes, ["length", "__range"]).withColumn("__rank", F.col("before") + F.col("__place") - 1)
    # The plan has at most some entries for each of ``window`` lengths: of fixed size.
    placed = ranked.join(F.broadcast(entries), "length").where((F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
    nth = F.col("__rank") - F.col("low")
    sequence = F.col("first") + F.floor(nth / F.col("each")).cast("long")
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), (F.col("base") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of ``docs`` with their places; see ``cut`` and ``place``."""
    return place(store.written(cut(docs, vocabulary, window, with_ids, text, key), "pieces"), window).withColumnRenamed("key", key)
