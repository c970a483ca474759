"""Document fingerprints: MinHash signatures, their likeness to an edited text's and the next document's, and near copies.

A document's set is its distinct shingles of ``WORDS`` words (A-Z lowered, words between ASCII white space; fewer words make
one shingle).  A signature has the least value of ``HASHES`` universal permutations x -> a x + b modulo 2^64 (a odd) of the
shingles' 64-bit hashes; the fingerprint keeps the lower 16 bits of each.  Likeness is the share of equal places.

**Neighbours.**  Every row is also compared with the next document in ascending key, and with its own text of which the last
half is replaced by the next one's beginning.  Tables mostly lie in order of their key, in runs that don't overlap: then one pass
compares each row with the one that follows in its task, and only the ends of runs are joined.  What the runs are is found by a
first pass over the keys; in the second, a row that isn't followed as in the first is counted, and then, or where runs overlap,
keys repeat or are null, or there are more than ``RUNS`` runs, successors come from sorted keys and texts by joins.  Both give the same rows.

**Near copies.**  Documents of equal sets form a class.  ``BANDS`` bands of ``ROWS`` hashes of a class are its tokens; classes
that share one are candidates.  Within every batch of classes the least of each token leads; only leaders go to the exchange, by
ranges of tokens, where the least of them leads again: so a token that a third of all documents share is one entry a
batch.  Members are verified against their leaders by exact Jaccard similarity on whole texts (``PERCENT``), and what is linked
is one component.  Where a token's classes are then of several components, those of the smaller ones are compared with all,
in tiles: pairs whose parity sketches allow the similarity (a bound that rejects no link, see ``jaccard_join``) are verified, too.
A component is the least key that links reach.  A pair at the threshold shares no band once in 300,000 times.

Null and empty texts have the empty set, equal fingerprints, and are near copies of nothing; of rows that share a key the
least text stands for it as a next document, and they are in one component; rows of null key come before no other, are edited with
the first document and have a null component; repeated rows get a row each; keys are whole numbers; where there is no key at all,
the next text is empty; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from riskweave.llm import jaccard_join, store, vec
from riskweave.llm.components import components

WORDS, PERCENT = 5, 80
HASHES, BANDS, ROWS = 128, 24, 4
RUNS = 1 << 20
TILE = 2048
SLICE = 1 << 20
FILTER_BITS = 23

_seeds = np.random.Generator(np.random.PCG64(13))
FACTORS = _seeds.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _seeds.integers(1, 1 << 63, HASHES, dtype=np.uint64)
BAND_SEEDS = _seeds.integers(1, 1 << 63, BANDS, dtype=np.uint64)
SET_SEEDS = _seeds.integers(1, 1 << 63, 2, dtype=np.uint64)
RULE = jaccard_join.Rule(words=WORDS, percent=PERCENT)

_SIGNED = "key long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, n long, a long, b long, sketch binary"
_NAMES = [c.split()[0] for c in _SIGNED.split(", ")]


def signatures(column, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """Of every text: the fingerprint (``HASHES`` numbers of 16 bits), the size of its set, two hashes and a sketch of the set."""
    rows = len(column)
    prints = np.full((rows, HASHES), 0xFFFF, np.uint16)
    sizes, one, two = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    sketches = np.full(rows, b"", object)
    for low, owner, value, count in jaccard_join._shingles(column, words):
        owner, value = jaccard_join._distinct(owner, value)
        n = np.bincount(owner, minlength=count)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        first = (np.cumsum(n) - n)[some]
        at, room = low + some, np.empty_like(value)
        sizes[at] = n[some]
        mixed = vec.mix(value ^ SET_SEEDS[0])
        one[at] = np.add.reduceat(mixed, first)
        sketches[low : low + count] = jaccard_join._sketches(owner, mixed, n)
        two[at] = np.add.reduceat(vec.mix(value ^ SET_SEEDS[1]), first)
        for i in range(HASHES):
            np.multiply(value, FACTORS[i], out=room)
            np.add(room, SHIFTS[i], out=room)
            prints[at, i] = np.minimum.reduceat(room, first).astype(np.uint16)
    return prints, sizes, one, two, sketches


def _cut(text: str, after: str) -> str:
    """``text``, its last half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _rows(keys, texts: list[str], following: list[str], own, following_prints: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_SIGNED``; ``own``: what ``signatures`` gives of ``texts``."""
    prints, sizes, one, two, sketches = own
    edited = [_cut(t, f) for t, f in zip(texts, following)]
    other = signatures(pa.array(edited, pa.string()))[0]
    blobs = lambda p: pa.array([r.tobytes() for r in p], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            blobs(prints),
            blobs(other),
            pa.array((prints == other).mean(1), pa.float64()),
            pa.array((prints == following_prints).mean(1), pa.float64()),
            pa.array(sizes),
            pa.array(one.view(np.int64)),
            pa.array(two.view(np.int64)),
            pa.array(sketches.tolist(), pa.binary()),
        ],
        _NAMES,
    )


def _slices(texts: list[str]):
    """Runs of rows of about ``SLICE`` characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def _runs(docs: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """First and last keys of the ascending runs in which ``docs`` lies, in order; None unless all follow each other."""

    def find(batches):
        first = last = None
        found = []
        for batch in batches:
            key = batch.column("key")
            if key.null_count:
                found = [(None, None)]
                break
            k = key.to_numpy()
            if not len(k):
                continue
            breaks = np.flatnonzero(k[1:] <= k[:-1])
            if last is None:
                first = int(k[0])
            elif int(k[0]) <= last:
                found.append((first, last))
                first = int(k[0])
            for i in breaks.tolist():
                found.append((first, int(k[i])))
                first = int(k[i + 1])
            last = int(k[-1])
        else:
            if last is not None:
                found.append((first, last))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["first", "last"])

    runs = store.written(docs.select("key").mapInArrow(find, "first long, last long"), "runs")
    n, none = runs.agg(F.count(F.lit(1)), F.count_if(F.col("first").isNull())).first()
    if none or n > RUNS:
        return None
    known = runs.orderBy("first").toArrow()
    first, last = (known.column(c).to_numpy() for c in ("first", "last"))
    return (first, last) if (last[:-1] < first[1:]).all() else None


def _in_order(docs: DataFrame, first: np.ndarray, last: np.ndarray) -> DataFrame | None:
    """Signed rows where ``docs`` lies in the runs from ``first`` to ``last``; None if the pass met them in another order."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(last)  # at most RUNS

    def run(batches):
        ends, before = known.value, None  # the row before: its key, text and signature
        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                own = signatures(pa.array(texts[a:b], pa.string()))
                k, t = keys[a:b], texts[a:b]
                if before is not None:
                    k, t = [before[0], *k], [before[1], *t]
                    own = tuple(np.concatenate([x, y]) for x, y in zip(before[2], own))
                before = (k[-1], t[-1], tuple(x[-1:] for x in own))
                here = np.array(k, np.int64)
                end = ends[np.minimum(np.searchsorted(ends, here), len(ends) - 1)]
                use = np.flatnonzero(here[:-1] != end[:-1])
                good = (here[use] < here[use + 1]) & (here[use + 1] <= end[use])
                if not good.all():
                    yield _broken(int((~good).sum()))
                if len(use):
                    part = tuple(x[use] for x in own)
                    yield _rows(here[use], [t[i] for i in use], [t[i + 1] for i in use], part, own[0][use + 1])
        if before is not None and before[0] != ends[min(np.searchsorted(ends, before[0]), len(ends) - 1)]:
            yield _broken(1)

    broken = Observation()
    inner = docs.mapInArrow(run, _SIGNED).observe(broken, F.count_if(F.col("key").isNull()).alias("n"))
    edges = spark.createDataFrame(pa.table({"own": last, "after": np.roll(first, -1)}))
    some = F.broadcast(edges.select(F.explode(F.array("own", "after")).alias("key")).distinct())  # at most 2 * RUNS keys
    texts = store.written(docs.join(some, "key"), "ends")
    outer = texts.join(edges, F.col("key") == F.col("own")).join(texts.select(F.col("key").alias("after"), F.col("text").alias("following")), "after")
    signed = store.written(inner.union(outer.select("key", "text", "following").mapInArrow(_joined, _SIGNED)), "signed")
    if broken.get["n"]:
        store.drop(signed)
        return None
    return signed


def _broken(n: int) -> pa.RecordBatch:
    """Rows that say that the pass met an order that it didn't expect."""
    schema = _rows([], [], [], signatures(pa.array([], pa.string())), np.zeros((0, HASHES), np.uint16)).schema
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in schema], schema=schema)


def _joined(batches):
    """Signed rows of (key, text, following)."""
    for batch in batches:
        keys, texts, after = batch.column("key").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], [t or "" for t in batch.column("following").to_pylist()]
        for a, b in _slices(texts):
            yield _rows(keys[a:b], texts[a:b], after[a:b], signatures(pa.array(texts[a:b], pa.string())), signatures(pa.array(after[a:b], pa.string()))[0])


def _by_joins(docs: DataFrame) -> DataFrame:
    """Signed rows by successors from sorted keys and joins of texts, in whatever order ``docs`` lies."""
    spark = docs.sparkSession
    keyed = docs.where("key is not null")
    ordered = store.written(keyed.select("key").distinct().sort("key").withColumn("part", F.spark_partition_id()), "keys")
    firsts = ordered.groupBy("part").agg(F.min("key").alias("first")).orderBy("part").collect()  # one a partition
    least = firsts[0]["first"] if firsts else None
    following = [(r["part"], n["first"]) for r, n in zip(firsts, [*firsts[1:], *firsts[:1]])]
    after = F.broadcast(spark.createDataFrame(following, "part int, first long"))
    lead = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    nexts = ordered.join(after, "part").select("key", F.coalesce(lead, "first").alias("after"))
    heads = keyed.groupBy(F.col("key").alias("after")).agg(F.min(F.coalesce("text", F.lit(""))).alias("following"))
    rows = docs.join(nexts, "key", "left").withColumn("after", F.coalesce("after", F.lit(least).cast("long"))).join(heads, "after", "left")
    return store.written(rows.select("key", "text", "following").mapInArrow(_joined, _SIGNED), "signed")


def sign(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (key, text): the columns of ``_SIGNED``, written; n, a and b tell equal sets."""
    runs = _runs(docs)
    found = _in_order(docs, *runs) if runs is not None and len(runs[0]) else None
    return _by_joins(docs) if found is None else found


_MET = np.dtype([("token", "<u8"), ("key", "<i8"), ("leader", "<i8"), ("near", "?"), ("band", "u1")])


def _tokens(prints: np.ndarray) -> np.ndarray:
    """Hashes of the bands, rows by bands."""
    return vec.mix(np.ascontiguousarray(prints[:, : BANDS * ROWS]).view("<u8") ^ BAND_SEEDS)


def _small(sketches: list[bytes]) -> np.ndarray:
    """Sketches folded to the least width."""
    return np.stack([jaccard_join._folded(x, jaccard_join.BITS // 8) for x in sketches]) if sketches else np.zeros((0, jaccard_join.BITS // 64), np.uint64)


def _may_link(small: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sizes and folded sketches of ``p`` and ``q`` allow the similarity."""
    apart = np.bitwise_count(small[p] ^ small[q]).sum(1, dtype=np.int64)
    near = np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * PERCENT
    return near & (apart * (100 + PERCENT) <= (100 - PERCENT) * (n[p] + n[q]))


def _led(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by token, then key, and the place in it of each one's leader."""
    order = np.lexsort((key, token))
    t = token[order]
    new = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
    return order, np.repeat(new, np.diff(np.append(new, len(t))))


def _met(classes: DataFrame) -> DataFrame:
    """(token, key, leader, near, band): every class that shares a token with another, and who leads it there; ``near``:
    whether the sketches allow a link, where both were at hand."""
    bits = max(0, (store.partitions(classes.sparkSession) - 1).bit_length())

    def part_of(hashes):
        return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            n, small = batch.column("n").to_numpy(), _small(batch.column("sketch").to_pylist())
            prints = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), "<u2").reshape(-1, HASHES)
            token = _tokens(prints).ravel()
            row, band = np.divmod(np.arange(len(token)), BANDS)
            order, lead = _led(token, keys[row])
            alone = lead == np.arange(len(order))
            own, head = order[~alone], order[lead[~alone]]
            met = np.zeros(len(own), _MET)
            met["token"], met["key"], met["leader"], met["band"] = token[own], keys[row[own]], keys[row[head]], band[own]
            for a in range(0, len(own), 1 << 15):
                met["near"][a : a + (1 << 15)] = _may_link(small, n, row[own[a : a + (1 << 15)]], row[head[a : a + (1 << 15)]])
            sent = order[alone]
            every = np.arange((1 << bits) + 1)
            part = part_of(vec.mix(met["key"].astype(np.uint64) ^ met["token"]))  # these go anywhere
            at = np.argsort(part, kind="stable")
            met, e = met[at], np.searchsorted(part[at], every)
            part = part_of(token[sent])
            at = np.argsort(part, kind="stable")
            sent, f = sent[at], np.searchsorted(part[at], every)
            numbers, blobs = [], []
            for p in range(1 << bits):
                m, s = met[e[p] : e[p + 1]], sent[f[p] : f[p + 1]]
                if len(m) or len(s):
                    numbers.append(p)
                    blobs.append(np.uint32(len(m)).tobytes() + m.tobytes() + token[s].tobytes() + keys[row[s]].tobytes() + band[s].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def lead_again(table: pa.Table) -> pa.Table:
        met, token, key, band = [], [], [], []
        for blob in table.column("blob").to_pylist():
            m = int(np.frombuffer(blob, np.uint32, 1)[0])
            met.append(np.frombuffer(blob, _MET, m, 4))
            at = 4 + m * _MET.itemsize
            n = (len(blob) - at) // 17
            token.append(np.frombuffer(blob, "<u8", n, at))
            key.append(np.frombuffer(blob, "<i8", n, at + 8 * n))
            band.append(np.frombuffer(blob, "u1", n, at + 16 * n))
        token, key, band = (np.concatenate(x) for x in (token, key, band))
        order, lead = _led(token, key)
        member = lead != np.arange(len(order))
        own, head = order[member], order[lead[member]]
        more = np.zeros(len(own), _MET)
        more["token"], more["key"], more["leader"], more["near"], more["band"] = token[own], key[own], key[head], True, band[own]
        found = np.concatenate([*met, more])
        return pa.table({"token": found["token"].view(np.int64), "key": found["key"].astype(np.int64), "leader": found["leader"].astype(np.int64), "near": pa.array(found["near"]), "band": pa.array(found["band"].astype(np.int32))})

    sent = classes.select("key", "n", "fingerprint", "sketch").mapInArrow(send, "part int, blob binary").groupBy("part")
    return store.written(sent.applyInArrow(lead_again, "token long, key long, leader long, near boolean, band int"), "met")


def _marked(rows: DataFrame, keys: DataFrame, name: str = "key") -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a ``name`` in ``keys`` (all that do, and few others while keys are fewer than bits), and the rest.

    A bit filter of fixed size: what surely isn't joined isn't shuffled for it."""
    slot = F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))
    blocks = keys.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 13).alias("block")).agg(F.collect_list(F.col("s").bitwiseAND(8191).cast("int")).alias("at")).toArrow()
    bits = np.zeros(1 << FILTER_BITS, bool)
    for block, at in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist()):
        bits[(block << 13) + np.array(at, np.int64)] = True
    known = rows.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def there(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array(known.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1)

    mark = F.coalesce(F.arrow_udf(there, "boolean")(F.coalesce(slot, F.lit(0))), F.lit(False))
    marked = rows.withColumn("may", mark)
    return marked.where("may").drop("may"), marked.where("not may").drop("may")


def _mixed_pairs(met: DataFrame, comps: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y) of classes of different components that share a token and whose sketches allow a link."""
    spark = met.sparkSession
    comp = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"{side}_comp"))
    placed = met.join(comp("key"), "key", "left").join(comp("leader"), "leader", "left")
    placed = placed.withColumn("key_comp", F.coalesce("key_comp", "key")).withColumn("leader_comp", F.coalesce("leader_comp", "leader"))
    placed = store.written(placed, "placed")
    mixed = placed.where("key_comp <> leader_comp").select("token").distinct()
    members = placed.join(mixed, "token", "left_semi")
    rows = members.select("token", "band", "key", F.col("key_comp").alias("comp")).union(members.select("token", "band", "leader", "leader_comp")).distinct()
    rows = store.written(rows, "mixed")
    counts = rows.groupBy("token", "comp").agg(F.count("*").alias("n"))
    most = counts.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), F.sum("n").alias("size"))
    some, _ = _marked(classes.select("key", F.col("n").alias("shingles"), "fingerprint", "sketch"), rows.select("key"))
    side = F.ceil(F.col("size") / TILE).cast("int")
    tiled = rows.join(most, "token").join(some, "key").withColumn("home", F.pmod(F.xxhash64("key"), side).cast("int")).withColumn("minor", F.col("comp") != F.col("most"))
    tiled = tiled.withColumn("tile", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), side - 1)).otherwise(F.array("home"))))
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("token", "tile"), F.lit(4 * store.partitions(spark))).cast("int"))

    def meet(table: pa.Table) -> pa.Table:
        token, key, comp, n, home, tile, band = (table.column(c).to_numpy() for c in ("token", "key", "comp", "shingles", "home", "tile", "band"))
        minor = table.column("minor").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((n, tile, token))
        token, key, comp, n, home, tile, band, minor = (c[order] for c in (token, key, comp, n, home, tile, band, minor))
        prints = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), "<u2").reshape(-1, HASHES)[order]
        small = _small(table.column("sketch").to_pylist())[order]
        group = np.concatenate([[0], np.cumsum((np.diff(token) != 0) | (np.diff(tile) != 0))])
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, step = np.arange(len(group)), 0
        while len(left):  # by size, each meets the next ones of its tile as long as they are of near size
            step += 1
            left = left[left + step < len(group)]
            left = left[(group[left] == group[left + step]) & (n[left] * 100 >= n[left + step] * PERCENT)]
            for i in range(0, len(left), 1 << 14):
                p = left[i : i + (1 << 14)]
                q = p + step
                lower = np.where(key[p] < key[q], p, q)
                good = (comp[p] != comp[q]) & (~(minor[p] & minor[q]) | (home[lower] == tile[p]))
                p, q = p[good], q[good]
                good = _may_link(small, n, p, q)
                p, q = p[good], q[good]
                same = prints[p, : BANDS * ROWS] == prints[q, : BANDS * ROWS]
                good = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[p]  # a pair is its first common band's
                xs.append(np.minimum(key[p[good]], key[q[good]]))
                ys.append(np.maximum(key[p[good]], key[q[good]]))
        return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    found = tiled.select("part", "token", "key", "comp", "shingles", "home", "tile", "band", "minor", "fingerprint", "sketch").groupBy("part").applyInArrow(meet, "x long, y long")
    return store.written(jaccard_join._possible(found.distinct(), classes, RULE, False), "pairs")


def near_copies(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b, n, component) of the classes of ``signed`` whose component is of more than one key, or whose least key isn't alone."""
    sets = signed.where("n > 0 and key is not null").groupBy("a", "b", "n").agg(F.min("key").alias("key"), F.count("*").alias("rows"), F.first("fingerprint").alias("fingerprint"), F.first("sketch").alias("sketch"))
    classes = store.written(sets, "classes")
    met = _met(classes)
    led = met.where("near").select(F.least("key", "leader").alias("x"), F.greatest("key", "leader").alias("y")).where("x <> y").distinct()
    led = store.written(jaccard_join._possible(led, classes, RULE, False), "led")
    links = store.written(jaccard_join._verified(docs, led, RULE).union(jaccard_join._same_key(signed.select("key", "n", "a", "b"), classes)), "links")
    more = _mixed_pairs(met, components(links), classes)
    links = links.union(store.written(jaccard_join._verified(docs, more, RULE), "links"))
    comps = components(links)
    placed = classes.join(comps, F.col("key") == F.col("node"), "left").where("rows > 1 or component is not null")
    return store.written(placed.select("a", "b", "n", F.coalesce("component", "key").alias("component")), "near")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next, component_id."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    signed = sign(own)
    near = near_copies(own, signed)
    # Only rows of sets that are near others need the join; the component of every other is its own key.
    with_hash = signed.withColumn("set", F.xxhash64("a", "b", "n"))
    some, rest = _marked(with_hash, near.select(F.xxhash64("a", "b", "n").alias("set")), "set")
    joined = some.join(near, ["a", "b", "n"], "left").select(*with_hash.columns, F.coalesce("component", "key").alias("component"))
    both = joined.unionByName(rest.withColumn("component", F.col("key")))
    return both.select(
        "key",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("key").isNotNull(), F.col("component")).alias("component_id"),
    )
