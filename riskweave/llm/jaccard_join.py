"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles (A-Z lowered, words between ASCII white space; fewer words than a shingle
make one).  Documents of equal sets form a class; classes are linked when the Jaccard similarity of their sets reaches
the threshold, and a document's component is the least key that links reach.

1. All shingles are counted, packed by hash range; what remains is a table of fixed size with the magnitude of the
   count of each hash slot's most frequent shingle.  It orders shingles: by magnitude, then by hash.
2. A class's prefix is the first |x| - t + l shingles in this order, t = ceil(threshold * |x|).  l starts at 1 and grows
   with the prefix's estimated candidates: two classes at or above the threshold share min(l_x, l_y) prefix shingles.
3. Dense groups are thinned first: classes that agree on bands of min-hashes are compared with one leader for each
   band, and what is linked is one component from here on.
4. Classes of different components that share a prefix shingle meet, if another one of near size has it, a frequent
   shingle's classes in tiles of ``TILE`` by ``TILE``.  A set's parity sketch has a bit for each cell of its shingles'
   hashes, set where an odd number of them falls: sets whose sketches differ in more bits than the threshold allows the
   sets to differ in shingles are no link, exactly.  Its width follows the set's size (``BITS`` at least); the wider of
   two is folded.  Tiles compare the first ``BITS``.  A pair that passes leaves the tile of its least shared shingle
   alone, as far as each prefix's ``LEAST`` least hashes tell.  Pairs whose prefixes share enough shingles and whose
   whole sketches pass are candidates.  Pairs within a component need no link.  A candidate is verified on both whole
   texts.

So no pairs within a group of copies are formed, and no link between components is lost: order, bands and sketches
decide cost only.  Texts reach verification through a fixed-size bit filter of the keys, then joins.  A written table is
deleted as soon as what reads it is written.

Null and empty texts have the empty set and are linked with nothing; null keys get a null component; repeated rows get a
row each; a key is one document: where rows of different texts share it, the links of each count for all; keys are
whole numbers; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import store, vec
from riskweave.llm.components import components

SLOT_BITS = 22
RARE = 16
BANDS, ROWS = 4, 2
AGREE = 5
FILTER_BITS = 23
MOST_MATCHES = 8
BITS = 512
MOST_BITS = 1 << 16
TILE = 2048
LEAST = 4
AT_ONCE = 256


@dataclass(frozen=True)
class Rule:
    """``words`` a shingle; linked at ``percent`` of the union."""

    words: int = 5
    percent: int = 80


def _shingles(column, words: int):
    """For runs of rows: the first row, the rows' owners and hashes of shingles, with repeats, and the number of rows."""
    data, offs = vec.text_buffer(column)
    for low, high in vec.spans(offs):
        base = offs[low]
        part = data[base : offs[high]]
        starts, ends, first = vec.split(part, offs[low : high + 1] - base, vec.SPACES)
        units = vec.hashes(part, starts, ends, vec.LOWER_BYTES)
        at = np.flatnonzero(vec.inside(first, words))
        value = vec.windows(units, words)[at] if len(at) else np.zeros(0, np.uint64)
        owner = np.searchsorted(first, at, "right") - 1
        counts = np.diff(first)
        if len(short := np.flatnonzero((counts > 0) & (counts < words))):
            alone = np.concatenate([vec.windows(units[first[r] : first[r + 1]], int(counts[r])) for r in short])
            owner, value = np.concatenate([owner, short]), np.concatenate([value, alone])
        yield low, owner, value, high - low


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def _sketches(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The parity sketch of every set: bit ``hash mod width`` is set where an odd number of hashes falls."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), BITS, MOST_BITS)
    begin = np.concatenate([[0], np.cumsum(width)])
    at = begin[owner] + (hashes & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    edges = (begin // 8).tolist()
    return [packed[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch at a smaller width of ``size`` bytes: bits that fall together are added modulo 2."""
    out = np.frombuffer(sketch, np.uint64)
    while out.nbytes > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _apart(one: bytes, two: bytes) -> int:
    """In how many bits two sketches differ: no more than the sets do in shingles."""
    size = min(len(one), len(two))
    return int(np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum())


def _magnitudes(docs: DataFrame, rule: Rule) -> np.ndarray:
    """For each slot of shingle hashes: 0, or the magnitude of its most frequent shingle's count of documents."""
    bits = min(SLOT_BITS, max(0, (store.partitions(docs.sparkSession) - 1).bit_length()))
    own = SLOT_BITS - bits

    def send(batches):
        for batch in batches:
            for _, owner, value, _ in _shingles(batch.column("text"), rule.words):
                _, value = _distinct(owner, value)
                value = np.sort(value)
                edges = np.append(np.searchsorted(value, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else 0, len(value))
                short = (value << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)
                use = [p for p in range(1 << bits) if edges[p + 1] > edges[p]]
                blobs = []
                for p in use:
                    distinct, counts = np.unique(short[edges[p] : edges[p + 1]], return_counts=True)
                    many = np.flatnonzero(counts > 1)
                    blobs.append(b"".join([np.array([len(distinct), len(many)], np.uint32).tobytes(), distinct.tobytes(), many.astype(np.uint32).tobytes(), counts[many].astype(np.uint32).tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def count(table: pa.Table) -> pa.Table:
        values, weights = [], []
        for b in table.column("blob").to_pylist():
            n, m = (int(x) for x in np.frombuffer(b, np.uint32, 2))
            w = np.ones(n, np.int64)
            w[np.frombuffer(b, np.uint32, m, 8 + 4 * n)] = np.frombuffer(b, np.uint32, m, 8 + 4 * n + 4 * m)
            values.append(np.frombuffer(b, np.uint32, n, 8))
            weights.append(w)
        value, weight = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(value, kind="stable")
        value, weight = value[order], weight[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        total = np.add.reduceat(weight, first)
        often = total >= RARE
        slots = np.zeros(1 << own, np.uint8)
        np.maximum.at(slots, (value[first[often]] >> np.uint32(32 - own)).astype(np.int64), np.ceil(np.log2(total[often])).astype(np.uint8))
        return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "blob": pa.array([zlib.compress(slots.tobytes(), 1)], pa.binary())})

    found = docs.select("text").mapInArrow(send, "part int, blob binary").groupBy("part").applyInArrow(count, "part int, blob binary").toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint8)  # what the driver gets is as large as this table
    for part, blob in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[part << own : (part + 1) << own] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return out


def _signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per row: key, n, digest of the set (a, b), min-hashes, the prefix with its number of matches, and the sketch."""
    table = docs.sparkSession.sparkContext.broadcast(_magnitudes(docs, rule))
    seeds = [np.uint64(s) for s in np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, BANDS * ROWS + 3, dtype=np.uint64)]

    def run(batches):
        slots = table.value
        for batch in batches:
            for low, owner, value, rows in _shingles(batch.column("text"), rule.words):
                level = slots[(value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
                owner, key = _distinct(owner, level << np.uint64(56) | value >> np.uint64(8))
                n = np.bincount(owner, minlength=rows)
                first = np.concatenate([[0], np.cumsum(n)])
                some = np.flatnonzero(n)
                a, b = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                mins = np.zeros((rows, BANDS * ROWS), np.uint64)
                if len(some):
                    a[some] = np.add.reduceat(vec.mix(key ^ seeds[-1]), first[some])
                    b[some] = np.bitwise_xor.reduceat(vec.mix(key ^ seeds[-2]), first[some])
                    for i in range(BANDS * ROWS):
                        mins[some, i] = np.minimum.reduceat(vec.mix(key ^ seeds[i]), first[some])
                sketches = _sketches(owner, vec.mix(key ^ seeds[-3]), n)
                need = (n * rule.percent + 99) // 100
                base = n - need + 1
                cost = np.concatenate([[0], np.cumsum(2.0 ** (key >> np.uint64(56)).astype(np.float64))])
                mean = (cost[np.minimum(first[:-1] + base, first[1:])] - cost[first[:-1]]) / np.maximum(base, 1)
                matches = np.clip(1 + np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 1, np.clip(need, 1, MOST_MATCHES))
                size = np.where(n > 0, n - need + matches, 0)
                prefixes = [key[f : f + s].tobytes() for f, s in zip(first[:-1], size)]
                least = [np.sort(vec.mix(key[f : f + s]))[:LEAST].tobytes().ljust(8 * LEAST, b"\xff") for f, s in zip(first[:-1], size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(low, rows), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(mins.view(np.int64).ravel()), BANDS * ROWS).cast(pa.list_(pa.int64())), pa.array(matches, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary()), pa.array(least, pa.binary())],
                    ["key", "n", "a", "b", "mins", "matches", "prefix", "sketch", "least"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n long, a long, b long, mins array<long>, matches int, prefix binary, sketch binary, least binary")


def _near(percent: int) -> str:
    return f"least(n1, n2) * 100 >= greatest(n1, n2) * {percent}"


def _leader_pairs(classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a class and the leader of a band's group, where most min-hashes agree and the sketches allow a link."""
    bands = F.array(*(F.xxhash64(F.lit(i), *(F.col("mins")[i * ROWS + j] for j in range(ROWS))) for i in range(BANDS)))
    banded = classes.select("key", "n", "mins", F.explode(bands).alias("band"))
    # The class whose bands are the most common is nearest to the middle of its group, and leads it.
    sizes = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    common = banded.select("key", "band").join(sizes, "band").groupBy("key").agg(F.sum("size").alias("weight"))
    banded = banded.join(common, "key")
    lead = F.max_by(F.struct("key", "n", "mins"), F.struct("weight", F.xxhash64("key", "band")))
    leaders = banded.join(sizes.select("band"), "band", "left_semi").groupBy("band").agg(lead.alias("lead"))
    pairs = banded.join(leaders, "band").where("key <> lead.key")
    same = F.size(F.filter(F.zip_with("mins", F.col("lead.mins"), lambda x, y: x == y), lambda x: x))
    pairs = pairs.where(same >= AGREE).select(F.least("key", "lead.key").alias("x"), F.greatest("key", "lead.key").alias("y"), F.col("n").alias("n1"), F.col("lead.n").alias("n2"))
    return _possible(pairs.where(_near(rule.percent)).select("x", "y").distinct(), classes, rule, False)


def _prefix_pairs(classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of classes of different components that share enough prefix shingles."""
    bits = max(0, (store.partitions(classes.sparkSession) - 1).bit_length())
    percent = rule.percent
    meta = np.dtype([("key", "<i8"), ("comp", "<i8"), ("n", "<u4"), ("count", "<u4")])

    def send(batches):
        for batch in batches:
            key, comp, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "comp", "n"))
            texts = batch.column("prefix").to_pylist()
            sizes = np.array([len(p) // 8 for p in texts], np.int64)
            value = np.frombuffer(b"".join(texts), np.uint64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            part = (vec.mix(value) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange((1 << bits) + 1))
            use, blobs = [], []
            for p in range(1 << bits):
                own = order[edges[p] : edges[p + 1]]
                if len(own):
                    who, counts = np.unique(owner[own], return_counts=True)
                    head = np.empty(len(who), meta)
                    head["key"], head["comp"], head["n"], head["count"] = key[who], comp[who], n[who], counts
                    use.append(p)
                    blobs.append(np.uint32(len(who)).tobytes() + head.tobytes() + value[own].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def shared(table: pa.Table) -> pa.Table:
        heads, values = [], []
        for b in table.column("blob").to_pylist():
            n = int(np.frombuffer(b, np.uint32, 1)[0])
            head = np.frombuffer(b, meta, n, 4)
            heads.append(np.repeat(head, head["count"]))
            values.append(np.frombuffer(b, np.uint64, -1, 4 + n * meta.itemsize))
        head, value = np.concatenate(heads), np.concatenate(values)
        order = np.lexsort((head["n"], value))
        head, value = head[order], value[order]
        met = np.zeros(len(value), bool)  # whether another one of near size has it
        near = (value[1:] == value[:-1]) & (head["n"][:-1].astype(np.int64) * 100 >= head["n"][1:].astype(np.int64) * percent)
        met[1:] |= near
        met[:-1] |= near
        head, value = head[met], value[met]
        if len(value):
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            mixed = np.minimum.reduceat(head["comp"], first) != np.maximum.reduceat(head["comp"], first)
            mixed = np.repeat(mixed, np.diff(np.append(first, len(value))))
            head, value = head[mixed], value[mixed]
        return pa.table({"token": value.view(np.int64), "key": head["key"].astype(np.int64), "comp": head["comp"].astype(np.int64), "n": head["n"].astype(np.int64)})

    rows = classes.select("key", "comp", "n", "prefix").mapInArrow(send, "part int, blob binary").groupBy("part")
    rows = store.written(rows.applyInArrow(shared, "token long, key long, comp long, n long"), "prefixes")
    tiled = rows.join(rows.groupBy("token").agg(F.count("*").alias("size")), "token").join(classes.select("key", "least", _small("sketch").alias("small")), "key")
    side = F.ceil(F.col("size") / TILE)
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("key"), side).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (side - 1).cast("int"))))
    tiled = tiled.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("token", "low", "high"), F.lit(4 * store.partitions(classes.sparkSession))).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        token, key, comp, n, own, low, high = (table.column(c).to_numpy() for c in ("token", "key", "comp", "n", "own", "low", "high"))
        small = np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        least = np.frombuffer(b"".join(table.column("least").to_pylist()), np.uint64).reshape(-1, LEAST)
        order = np.lexsort((n, high, low, token))
        token, key, comp, n, own, low, high, small, least = (c[order] for c in (token, key, comp, n, own, low, high, small, least))
        mixed = vec.mix(token.view(np.uint64))
        tile = np.concatenate([[0], np.cumsum(np.any([np.diff(c) != 0 for c in (token, low, high)], axis=0))])
        xs, ys = [], []
        left, step = np.arange(len(tile)), 0
        while len(left):  # by size, each row meets the next ones of its tile as long as they are of near size
            step += 1
            left = left[left + step < len(tile)]
            right = left + step
            left = left[(tile[left] == tile[right]) & (n[left] * 100 >= n[right] * percent)]
            for j in range(0, len(left), 1 << 16):
                p = left[j : j + (1 << 16)]
                q = p + step
                good = (comp[p] != comp[q]) & ((low[p] == high[p]) | (own[p] != own[q]))
                p, q = p[good], q[good]
                near = np.bitwise_count(small[p] ^ small[q]).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * (n[p] + n[q])
                p, q = p[near], q[near]
                earlier = (least[p][:, :, None] == least[q][:, None, :]) & (least[p] < mixed[p][:, None])[:, :, None]
                p, q = (c[~earlier.any((1, 2))] for c in (p, q))
                xs.append(np.minimum(key[p], key[q]))
                ys.append(np.maximum(key[p], key[q]))
        none = np.zeros(0, np.int64)
        x, y = (np.concatenate(c) if c else none for c in (xs, ys))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else none
        return pa.table({"x": pa.array(x[first], pa.int64()), "y": pa.array(y[first], pa.int64())})

    met = tiled.select("part", "token", "key", "comp", "n", "own", "low", "high", "small", "least").groupBy("part").applyInArrow(meet, "x long, y long")
    return _possible(met.distinct(), classes, rule, True)


def _small(sketch: str) -> Column:
    """A sketch folded to ``BITS``, for the tiles."""

    def fold(sketches: pa.Array) -> pa.Array:
        return pa.array([_folded(s, BITS // 8).tobytes() for s in sketches.to_pylist()], pa.binary())

    return F.arrow_udf(fold, "binary")(sketch)


def _possible(pairs: DataFrame, classes: DataFrame, rule: Rule, prefixes: bool) -> DataFrame:
    """Those of ``pairs`` (x, y) whose sketches allow a link and, on wish, whose prefixes share as many shingles as the
    shorter of the two asks for."""
    both, columns = pairs, ["n", "sketch"] + ["matches", "prefix"] * prefixes
    for side in ("x", "y"):
        both = both.join(classes.select(F.col("key").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    percent = rule.percent

    def run(batches):
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            n = batch.column("n_x").to_numpy() + batch.column("n_y").to_numpy()
            apart = [_apart(*both) for both in zip(batch.column("sketch_x").to_pylist(), batch.column("sketch_y").to_pylist())]
            keep = np.array(apart, np.int64) * (100 + percent) <= (100 - percent) * n
            if prefixes:
                need = np.minimum(batch.column("matches_x").to_numpy(), batch.column("matches_y").to_numpy())
                for i in np.flatnonzero(keep):
                    merged = np.sort(np.frombuffer(batch.column("prefix_x")[i].as_py() + batch.column("prefix_y")[i].as_py(), np.uint64))
                    keep[i] = (merged[1:] == merged[:-1]).sum() >= need[i]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["x", "y"])

    return both.mapInArrow(run, "x long, y long").distinct()


def _filtered(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key may be in ``pairs``: all that are, and few others while keys are fewer than bits."""
    slot = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS))
    ids = pairs.select(F.explode(F.array("x", "y")).alias("key")).select(slot.alias("s")).distinct()
    blocks = ids.groupBy(F.shiftright("s", 13).alias("block")).agg(F.collect_list(F.col("s").bitwiseAND(8191).cast("int")).alias("at")).toArrow()
    bits = np.zeros(1 << FILTER_BITS, bool)
    for block, at in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist()):
        bits[(block << 13) + np.array(at)] = True
    cast = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        known = np.unpackbits(cast.value).astype(bool)
        for batch in batches:
            keep = known[batch.column("slot").to_numpy()]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["key", "text"])

    return docs.where("key is not null").withColumn("slot", slot).mapInArrow(run, docs.select("key", "text").schema)


def _verified(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (x, y) whose whole texts reach the threshold, as links (a, b)."""
    texts = _filtered(docs, pairs)
    both = pairs.join(texts.select(F.col("key").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("key").alias("y"), F.col("text").alias("ty")), "y")

    def run(batches):
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            sides = []
            for c in ("tx", "ty"):
                found = [(low, *_distinct(owner, value), rows) for low, owner, value, rows in _shingles(batch.column(c), rule.words)]
                owner, value = np.concatenate([low + o for low, o, _, _ in found]), np.concatenate([v for _, _, v, _ in found])
                sides.append((value, np.searchsorted(owner, np.arange(batch.num_rows + 1))))
            keep = np.zeros(batch.num_rows, bool)
            (v, f), (w, g) = sides
            for i in range(batch.num_rows):
                one, two = v[f[i] : f[i + 1]], w[g[i] : g[i + 1]]
                merged = np.sort(np.concatenate([one, two]))
                common = int((merged[1:] == merged[:-1]).sum())
                keep[i] = common and 100 * common >= rule.percent * (len(merged) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(mask), batch.column("y").filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _same_key(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a key."""
    of_row = members.where("n > 0 and key is not null").join(classes.select("a", "b", "n", F.col("key").alias("class")), ["a", "b", "n"])
    first = Window.partitionBy("key")
    return of_row.select("class", F.min("class").over(first).alias("least")).where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))


def join(docs: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``key`` (long), ``n_shingles`` (long) and ``component_id`` (long)."""
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = store.written(_signatures(own, rule), "signatures")
    members = store.written(signed.select("key", "n", "a", "b"), "members")
    of_class = ("mins", "matches", "prefix", "sketch", "least")
    sets = signed.where("n > 0 and key is not null").groupBy("a", "b", "n").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in of_class))
    classes = store.written(sets, "classes")
    store.drop(signed)
    near = store.written(_leader_pairs(classes, rule), "leaders")
    store.settle(docs.sparkSession)
    links = store.written(_verified(own, near, rule).union(_same_key(members, classes)), "links")
    comps = components(links)
    named = classes.join(comps, classes["key"] == comps["node"], "left").select(*(classes[c] for c in ("key", "n", "matches", "prefix", "sketch", "least")), F.coalesce("component", classes["key"]).alias("comp"))
    far = store.written(_prefix_pairs(named, rule), "pairs")
    store.settle(docs.sparkSession)
    labels = store.written(classes.select("a", "b", "n", "key"), "labels")
    store.drop(classes)
    more = store.written(_verified(own, far, rule), "links")
    comps = components(links.union(more))
    placed = labels.join(comps, F.col("key") == F.col("node"), "left").select("a", "b", "n", F.coalesce("component", "key").alias("component_id"))
    done = members.join(placed.distinct(), ["a", "b", "n"], "left")
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))
