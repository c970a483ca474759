"""Exact repeats of runs of units (words or lines) across documents, found with anchors.

Shared by substring dedup (fixed blocks over words) and line dedup (winnowing over lines).  Documents are dealt into
groups by a hash; the exchange that deals them is one subplan which every phase reads again (Spark reuses it), so texts
are shuffled once.

1. Every group sends the hashes of its anchors, each once, packed by hash range (``_ANCHORS``).  A reducer holds one
   hash range and answers with one bit for each hash: does another place have it, indexed.
2. Every group extends its shared anchors both ways: all windows of ``length`` units that hold one are candidates.
   Of every distinct one its 64-bit hash and the group's first place go to reducers by other hash bits, which know the
   first place of all and answer with a bit for each: is there an earlier one in another group.
3. Every group marks the units that its later windows cover: those beyond the group's first, or of which that bit is set.

Work and shuffle follow the input: a frequent passage is one hash per group in both exchanges, no pairs of documents are
formed, and the answers are bits.  Equal hashes stand for equal windows (64 bits, and the bits that chose the reducer).  Keys are whole
numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import store, vec

_ANCHORS, _WINDOWS = 1, 2
_ALONE = np.uint64(0x5851F42D4C957F2D)
_PACKED = "__part int, __group int, __blob binary"


@dataclass(frozen=True)
class Search:
    """How units, anchors and repeats are defined; ``ordered``: an earlier place in the same document counts, too; units of
    ``alone`` words or more (0: none) are windows by themselves."""

    separators: np.ndarray
    length: int
    gram: int
    pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    ordered: bool
    alone: int = 0


def fixed_blocks(block: int) -> Callable:
    """Index the blocks at multiples of ``block``; probe with every rolling window of that length.

    A run of 2 * block - 1 units holds a whole block of any document that has it."""

    def pick(grams, first):
        at = np.flatnonzero(vec.inside(first, block))
        owner = np.searchsorted(first, at, "right") - 1
        return at, grams[at], (at - first[owner]) % block == 0

    return pick


def winnowed(gram: int, window: int) -> Callable:
    """Index and probe with the rightmost minimum of every ``window`` grams.

    A run of window + gram - 1 units shares at least one of them; a shorter document has its minimum."""

    def pick(grams, first):
        if not len(grams):
            return np.zeros(0, np.int64), grams, np.zeros(0, bool)
        last = np.minimum(first, len(grams) + gram - 1)
        good = vec.inside(first, gram)
        chosen = np.zeros(len(grams), bool)
        m = len(grams) - window + 1
        if m > 0:
            best = np.arange(m)
            for i in range(1, window):
                here = np.arange(i, m + i)
                best = np.where(grams[here] <= grams[best], here, best)
            chosen[best[vec.inside(first, gram + window - 1)[:m]]] = True
        for low, high in zip(last[:-1], last[1:]):  # rows of fewer grams than a window
            if 0 < high - low < gram + window - 1 and high - gram + 1 > low:
                chosen[low + int(np.argmin(grams[low : high - gram + 1]))] = True
        at = np.flatnonzero(chosen & good)
        return at, grams[at], np.ones(len(at), bool)

    return pick


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    part, group, blob = zip(*rows) if rows else ((), (), ())
    return pa.table({"__part": pa.array(part, pa.int32()), "__group": pa.array(group, pa.int32()), "__blob": pa.array(blob, pa.binary())})


class _Group:
    """The units of one group's documents, rows in an order that each phase finds again."""

    def __init__(self, table: pa.Table, search: Search, text: str, key: str, bits: int):
        self.search, self.bits = search, bits
        texts, keys = table.column(text), table.column(key)
        data, offs = vec.text_buffer(texts)
        self.keys = pc.fill_null(keys.cast(pa.int64()), 0).to_numpy()
        self.data, self.offs, self.keyed = data, offs, keys.is_valid().to_numpy()
        parts, alone = [], []
        starts, ends, firsts, at = [], [], [np.zeros(1, np.int64)], 0
        for low, high in vec.spans(offs):
            base = offs[low]
            s, e, f = vec.split(data[base : offs[high]], offs[low : high + 1] - base, search.separators)
            parts.append(vec.hashes(data[base : offs[high]], s, e))
            if search.alone:
                words = vec.split(data[base : offs[high]], offs[low : high + 1] - base, vec.SPACES)[0]
                alone.append(np.searchsorted(words, e) - np.searchsorted(words, s) >= search.alone)
            starts.append(s + base)
            ends.append(e + base)
            firsts.append(f[1:] + at)
            at += len(s)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.units = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.concatenate(firsts)
        self.alone = np.concatenate(alone) if alone else np.zeros(len(self.units), bool)
        self.owner = np.repeat(np.arange(len(self.keys)), np.diff(self.first))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Where anchors are, which of the group's distinct hashes each has, and the parts to send."""
        grams = vec.windows(self.units, self.search.gram)
        at, value, indexed = self.search.pick(grams, self.first)
        use = self.keyed[self.owner[at]]
        at, value, indexed = at[use], value[use], indexed[use]
        distinct, which = np.unique(value, return_inverse=True)
        n = len(distinct)
        is_indexed = np.zeros(n, bool)
        is_indexed[which[indexed]] = True
        place = at if self.search.ordered else self.owner[at]
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(least, which, place)
        np.maximum.at(most, which, place)
        edges = np.searchsorted(distinct, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.int64)
        edges = np.append(edges, n)
        short = (distinct << np.uint64(self.bits) >> np.uint64(32)).astype(np.uint32)
        rows = [
            (p, np.uint32(b - a).tobytes() + short[a:b].tobytes() + _bits(is_indexed[a:b]) + _bits(least[a:b] < most[a:b]))
            for p, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
            if b > a
        ]
        return at, which, rows, edges

    def candidates(self, answers: dict[tuple[int, int], bytes]) -> Candidates:
        """The windows around shared anchors."""
        at, which, _, edges = self.anchors()
        shared = np.zeros(edges[-1], bool)
        for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                shared[a:b] = np.unpackbits(np.frombuffer(answers[_ANCHORS, p], np.uint8), count=b - a)
        hit = np.zeros(len(self.units) + 1, np.int64)
        hit[at[shared[which]]] = 1
        total = np.concatenate([[0], np.cumsum(hit)])
        length, reach = self.search.length, self.search.length - self.search.gram + 1
        good = vec.inside(self.first, length)
        start = np.arange(len(good))
        start = start[good & (total[start + reach] > total[start])]
        value = vec.windows(self.units, length)[start] if len(start) else np.zeros(0, np.uint64)
        other = vec.windows(self.units, length, 0xA3EC647659359ACD)[start] if len(start) else value
        size = np.full(len(start), length)
        if self.search.alone:
            one = np.flatnonzero(self.alone & self.keyed[self.owner])
            own = self.units[one]
            start, size = np.append(start, one), np.append(size, np.ones(len(one), np.int64))
            value, other = np.append(value, vec.mix(own ^ _ALONE)), np.append(other, vec.mix(own ^ ~_ALONE))
        owner = self.owner[start]
        key = self.keys[owner]
        place = start - self.first[owner] if self.search.ordered else np.zeros(len(start), np.int64)
        part = (other >> np.uint64(64 - self.bits)).astype(np.int32) if self.bits else np.zeros(len(start), np.int32)
        order = np.lexsort((place, key, value, part))
        new = np.ones(len(order), bool)
        new[1:] = (value[order[1:]] != value[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
        first = order[new]
        rank = np.lexsort((first, part[first]))  # as they stand in the documents, so that keys stand in runs
        renamed = np.empty(len(first), np.int64)
        renamed[rank] = np.arange(len(first))
        which = np.empty(len(order), np.int64)
        which[order] = renamed[np.cumsum(new) - 1]
        first = first[rank]
        lead = first[which]
        later = (key > key[lead]) | ((key == key[lead]) & (place > place[lead]))
        return Candidates(start, size, value, key, place, which, later, first, np.searchsorted(part[first], np.arange((1 << self.bits) + 1)))


@dataclass(frozen=True)
class Candidates:
    """Windows of one group: starts, lengths, hashes, keys and places; which distinct window each is and whether it is later
    than the group's first; the first of every distinct one, by part, and where parts begin."""

    start: np.ndarray
    size: np.ndarray
    value: np.ndarray
    key: np.ndarray
    place: np.ndarray
    which: np.ndarray
    later: np.ndarray
    first: np.ndarray
    edges: np.ndarray


def _answers(replies: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(k, p): b for k, p, b in zip(*(replies.column(c).to_pylist() for c in ("__kind", "__part", "__blob")))}


def _sorted(table: pa.Table, key: str, tie: str) -> pa.Table:
    return table.sort_by([(key, "ascending"), (tie, "ascending")])


def _reduce_anchors(table: pa.Table) -> pa.Table:
    """One bit for each hash: another place has it, and one of the places is indexed."""
    groups, blobs = table.column("__group").to_pylist(), table.column("__blob").to_pylist()
    sizes = [int(np.frombuffer(b, np.uint32, 1)[0]) for b in blobs]
    value = np.concatenate([np.frombuffer(b, np.uint32, n, 4) for b, n in zip(blobs, sizes)])
    flags = [[np.unpackbits(np.frombuffer(b, np.uint8, -(-n // 8), 4 + 4 * n + i * -(-n // 8)), count=n) for b, n in zip(blobs, sizes)] for i in (0, 1)]
    indexed, more = (np.concatenate(x).astype(bool) for x in flags)
    order = np.argsort(value, kind="stable")
    new = np.ones(len(value), bool)
    new[1:] = value[order[1:]] != value[order[:-1]]
    run = np.cumsum(new) - 1
    many = np.bincount(run) > 1
    some, again = np.zeros(len(many), bool), np.zeros(len(many), bool)
    some[run[indexed[order]]] = True
    again[run[more[order]]] = True
    shared = np.empty(len(value), bool)
    shared[order] = (some & (many | again))[run]
    return _reply(_ANCHORS, table.column("__part")[0].as_py(), groups, sizes, shared)


def _reply(kind: int, part: int, groups: list[int], sizes: list[int], flags: np.ndarray) -> pa.Table:
    edges = np.cumsum([0, *sizes])
    blobs = [_bits(flags[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    n = len(groups)
    return pa.table({"__group": pa.array(groups, pa.int32()), "__kind": pa.array([kind] * n, pa.int32()), "__part": pa.array([part] * n, pa.int32()), "__blob": pa.array(blobs, pa.binary())})


def _pack_windows(value: np.ndarray, keys: np.ndarray, place: np.ndarray | None) -> bytes:
    """Counts, hashes, then runs of equal keys, then places within documents."""
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.diff(np.append(new, len(keys)))
    head = np.array([len(value), len(new)], np.uint32)
    return b"".join([head.tobytes(), value.tobytes(), keys[new].tobytes(), counts.astype(np.uint32).tobytes(), b"" if place is None else place.astype(np.uint32).tobytes()])


def _unpack_windows(blob: bytes, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, runs = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    value = np.frombuffer(blob, np.uint64, n, 8)
    keys = np.frombuffer(blob, np.int64, runs, 8 + 8 * n)
    counts = np.frombuffer(blob, np.uint32, runs, 8 + 8 * n + 8 * runs)
    place = np.frombuffer(blob, np.uint32, n, 8 + 8 * n + 12 * runs) if ordered else np.zeros(n, np.uint32)
    return value, np.repeat(keys, counts), place


def _reduce_windows(ordered: bool) -> Callable[[pa.Table], pa.Table]:
    def reduce(table: pa.Table) -> pa.Table:
        """One bit for each group's window: an earlier place than the group's first has it."""
        groups, blobs = table.column("__group").to_pylist(), table.column("__blob").to_pylist()
        each = [_unpack_windows(b, ordered) for b in blobs]
        value, keys, place = (np.concatenate([x[i] for x in each]) for i in range(3))
        order = np.lexsort((place, keys, value))
        v, k, p = value[order], keys[order], place[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.empty(len(v), bool)
        later[order] = (k > k[lead]) | ((k == k[lead]) & (p > p[lead]))
        return _reply(_WINDOWS, table.column("__part")[0].as_py(), groups, [len(x[0]) for x in each], later)

    return reduce


def remove(docs: DataFrame, search: Search, join: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with later repeats removed: ``text`` as ``join`` makes it of (bytes, starts, ends, kept units), and
    ``n_units`` and ``n_removed`` (long).

    Rows of null ``key`` are returned as they are cut into units, and are no source of repeats.  Null texts count as
    empty.  Rows that share a ``key`` are one place each: none comes before the other.  Extra columns pass through."""
    spark = docs.sparkSession
    deals = 4 * store.partitions(spark)
    bits = max(0, (store.partitions(spark) - 1).bit_length())
    columns = docs.columns
    names = [f"__{i}" for i in range(len(columns))]
    at_text, at_key = names[columns.index(text)], names[columns.index(key)]
    dealt = docs.toDF(*names).withColumn("__tie", F.xxhash64(at_key, at_text)).withColumn("__group", F.pmod("__tie", F.lit(deals)).cast("int"))

    def group_of(table: pa.Table) -> tuple[pa.Table, _Group]:
        table = _sorted(table, at_key, "__tie")
        return table, _Group(table, search, at_text, at_key, bits)

    def send_anchors(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        return _packed([(p, group, blob) for p, blob in group_of(table)[1].anchors()[2]])

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packed([])
        number = table.column("__group")[0].as_py()
        _, group = group_of(table)
        found = group.candidates(_answers(replies))
        rows = []
        for p, (a, b) in enumerate(zip(found.edges[:-1], found.edges[1:])):
            if b > a:
                use = found.first[a:b]
                rows.append((p, number, _pack_windows(found.value[use], found.key[use], found.place[use] if search.ordered else None)))
        return _packed(rows)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        table, group = group_of(table)
        answers = _answers(replies)
        found = group.candidates(answers)
        elsewhere = np.zeros(len(found.first), bool)
        for p, (a, b) in enumerate(zip(found.edges[:-1], found.edges[1:])):
            if b > a:
                elsewhere[a:b] = np.unpackbits(np.frombuffer(answers[_WINDOWS, p], np.uint8), count=b - a)
        later = found.later | elsewhere[found.which]
        start, size = found.start[later], found.size[later]
        cover = np.zeros(len(group.units) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
        keep = np.cumsum(cover[:-1]) == 0
        texts, first, data = [], group.first, group.data.tobytes()
        for i in range(table.num_rows):
            a, b, low = first[i], first[i + 1], group.offs[i]
            texts.append(join(data[low : group.offs[i + 1]], group.starts[a:b] - low, group.ends[a:b] - low, keep[a:b]))
        dropped = np.concatenate([[0], np.cumsum(~keep)])
        made = {at_text: pa.array(texts, pa.binary()).cast(pa.string())}
        made |= {"__units": pa.array(np.diff(first), pa.int64()), "__removed": pa.array(dropped[first[1:]] - dropped[first[:-1]], pa.int64())}
        return pa.table({c: made.get(c, table.column(c) if c in table.column_names else None) for c in [*names, "__units", "__removed"]})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out_type = StructType([StructField(f.name, StringType() if f.name == at_text else f.dataType) for f in dealt.schema.fields[: len(names)]] + [StructField("__units", LongType()), StructField("__removed", LongType())])
    out_schema = to_arrow_schema(out_type)

    first_replies = dealt.groupBy("__group").applyInArrow(send_anchors, _PACKED).groupBy("__part").applyInArrow(_reduce_anchors, reply := "__group int, __kind int, __part int, __blob binary")
    first_replies = store.written(first_replies, "anchors")
    cogroup = lambda replies, f, schema: dealt.groupBy("__group").cogroup(replies.groupBy("__group")).applyInArrow(f, schema)
    sent = cogroup(first_replies, send_windows, _PACKED)
    second_replies = sent.groupBy("__part").applyInArrow(_reduce_windows(search.ordered), reply)
    done = cogroup(first_replies.unionByName(second_replies), finish, out_type)
    return done.toDF(*columns, store.fresh(docs, "n_units"), store.fresh(docs, "n_removed"))
