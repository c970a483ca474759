"""Toxicity, personal data, decontamination, chat, sharding, packing and media."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import chat, decontamination, media, packing, pii, queries, sharding, toxicity, vec


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x00Z", max_size=30)), max_size=8))
def test_words_split_as_the_pattern_says(texts):
    data, offs = vec.text_buffer(pa.array(texts, pa.string()))
    starts, ends, first = vec.split(data, offs, vec.SPACES)
    found = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert found == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]
    hashes = vec.hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))


def test_toxicity_learns_and_defines_edges(spark):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic := i % 5 == 0:
            for bad in rng.sample(["vilea", "vileb", "vilec"], 2):
                text.insert(rng.randint(0, len(text)), bad.upper())
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (902, "word1 " * 20000, "x"), (903, docs[0][1], "y"), (903, docs[0][1], "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    model = toxicity.train(frame, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.score(frame, model)
    assert got.columns == ["doc_id", "text", "score", "_score", "passages"]
    scores = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(docs)
    assert all(scores[i]["_score"] >= 0.7 for i, t in labels if t) and all(scores[i]["_score"] < 0.7 for i, t in labels if not t)
    assert scores[900]["_score"] == scores[901]["_score"] and scores[903]["_score"] == scores[0]["_score"]
    span = scores[0]["passages"][0]
    assert "VILE" in scores[0]["text"][span["start"] : span["end"]]
    assert toxicity.train(frame, spark.createDataFrame([(0, 1)], "doc_id long, toxic int")) is None
    assert {r[0] for r in toxicity.score(frame, None).select("_score").collect()} == {0.0}
    empty = spark.createDataFrame([], frame.schema)
    assert toxicity.score(empty, model).count() == 0


def test_maximal_segments():
    # 4 -5 3 -3 1 2 -2 2 -2 1 5: the published example's maximal segments score 4, 3 and 7.
    values = [4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]
    sums = np.concatenate([[0], np.cumsum(values)])
    at = [i for i, v in enumerate(values) if v > 0]
    found = toxicity._maximal([float(values[i]) for i in at], [float(sums[i]) for i in at])
    assert [s for _, _, s in found] == [4, 3, 7]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_truth(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": kind == "card" and 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(deadline=None)
@given(st.text(alphabet="a@.-+_ 0127()é", max_size=60))
def test_pii_base_matches_the_patterns(text):
    assert [x[:3] for x in pii.find_pii(text) if x[0] in pii.BASE_KINDS] == base_truth(text)


def test_pii_checks_context_and_edges(spark):
    text = "card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, mail é a.b@c.de, ip 10.0.0.300 1.2.3.4 +49 (30) 1234567"
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_pii(text)] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567"), ("iban", "GB82 WEST 1234 5698 7654 32")]
    assert not [x for x in pii.find_pii("GB82 WEST 1234 5698 7654 33") if x[0] == "iban"]
    assert pii.find_pii("card 4111111111111111")[0][3] > pii.find_pii("test 4111111111111111")[0][3]
    for odd in ("a" * 200_000 + "@" + "b" * 200_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "@" * 100_000):
        pii.find_pii(odd)
    docs = spark.createDataFrame([(1, None, "p"), (2, "", "p"), (3, text, "p"), (3, text, "p")], "doc_id long, text string, pii string")
    got = [len(r["_pii"]) for r in pii.detect_pii(docs).orderBy("doc_id").collect()]
    assert got == [0, 0, 5, 5]
    assert pii.detect_pii(docs.limit(0)).count() == 0


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(4)
    words = [f"term{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50)))) for i in range(20)] + [(50, ""), (51, None)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    want = set()
    for i in range(20):
        text, passage = docs[i][1].split(), items[i][1].split()
        if i % 2:  # a paraphrase: a few words exchanged, none of the answer's
            for at in range(1, len(passage) - 6, 7):
                passage[at] = "other"
        at = rng.randint(0, len(text))
        docs[i] = (i, " ".join([*text[:at], *passage, *text[at:]]).upper())
        want.add((i, i))
    docs += [(900, None), (901, ""), (None, docs[2][1]), (902, docs[2][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, bench).collect()}
    assert got == want | {(902, 2), (None, 2)}
    assert decontamination.find_leaks(frame.limit(0), bench).count() == 0
    assert decontamination.find_leaks(frame, bench.limit(0)).count() == 0


def test_decontamination_finds_long_items_at_every_offset(spark):
    rng = random.Random(14)
    words = [f"term{i}" for i in range(4000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(250 if i < 6 else 1000)) for i in range(12)]
    docs = [(i, f"{some(40 + i)} {items[i][1]} {some(50)}") for i in range(12)] + [(100 + i, some(400)) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontamination.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["common"]) for r in found.collect()) == [(i, i, 1.0) for i in range(12)]


def test_decontamination_of_a_full_block_finds_every_copy(spark):
    rng = random.Random(15)
    words = [f"term{i}" for i in range(6000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, some(40)) for i in range(1000)]
    docs = [(i, f"{some(20 + i % 6)} {items[i][1]} {some(30)}") for i in range(1000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, text in docs for i, item in items[d : d + 1] if item in text}


def test_decontamination_of_equal_and_giant_items_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 7)
    monkeypatch.setattr(decontamination, "TOGETHER", 2)
    rng = random.Random(18)
    some = lambda n: " ".join(f"term{rng.randint(0, 900)}" for _ in range(n))
    texts = [some(40) for _ in range(30)]
    items = list(enumerate(texts)) + [(100 + i, texts[3]) for i in range(20)] + [(200, some(4000)), (201, None), (202, ""), (None, texts[4])]
    giant = items[50][1].split()
    docs = [(i, f"{some(15)} {t} {some(15)}") for i, t in enumerate(texts)] + [(90, " ".join(giant)), (91, some(60)), (92, None)]
    frame = spark.createDataFrame(docs, "item_id long, text string").repartition(3)
    found = decontamination.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), key="item_id")
    assert found.columns[:2] == ["item_id", "_item_id"]
    got = {tuple(r)[:2] for r in found.collect()}
    want = {(i, i) for i in range(30)} | {(3, 100 + i) for i in range(20)} | {(90, 200), (4, None)}
    assert got == want


def test_decontamination_of_adjacent_copies_and_repeated_words(spark):
    rng = random.Random(16)
    item = " ".join(f"term{i}" for i in range(16))
    docs = [(i, item) for i in range(5)] + [(10 + i, " ".join(f"other{rng.randint(0, 500)}" for _ in range(60))) for i in range(20)]
    docs += [(50, f"{' '.join(item.split()[:3] * 9)} {item}"), (51, item)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], round(r["cosine"], 3)) for r in decontamination.find_leaks(frame, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert {d for d, _ in got} == {0, 1, 2, 3, 4, 50, 51} and {c for d, c in got if d != 50} == {1.0}


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        assert decontamination._common(decontamination._places(a), len(a), b, 0) == slow(a.tolist(), b.tolist())


def test_chat_folds_events_and_round_trips(spark):
    events = [
        (1, 0, 0, "delta", "user", "hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "delta", "assistant", "bad"), (1, 1, 3, "regenerate", "assistant", "go"), (1, 1, 4, "delta", None, "od </s>[INST]&lt;"),
        (1, 0, 5, "edit", None, "hello <|end|>\n there"), (1, 1, 4, "delta", None, "od </s>[INST]&lt;"), (2, 0, 0, "delta", "assistant", None), (3, 0, 0, "delta", None, "<<SYS>>&amp;[/INST]"), (None, 0, 0, "delta", "user", "x" * 100_000),
    ]
    log = spark.createDataFrame(events, "conv long, message long, seq long, kind string, role string, text string").repartition(3)
    done = chat.render(chat.reconstruct(log))
    rows = done.select("conv", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    got = {r["conv"]: r for r in rows}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "hello <|end|>\n there"), ("assistant", "good </s>[INST]&lt;")]
    assert got[1]["loss"] == "good </s>[INST]&lt;" and got[2]["loss"] == ""
    assert [tuple(t) for t in got[3]["turns"]] == [("", "<<SYS>>&amp;[/INST]")] and got[None]["turns"][0]["text"] == "x" * 100_000
    for bare in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert all(bare not in r["formatted"] for r in rows)
    assert got[1]["formatted"].count("<|end|>") == 2
    assert chat.render(chat.reconstruct(log.limit(0))).count() == 0
    plan = done._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_keeps_rows_that_repeat(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "go"), (1, 1, "assistant", "go"), (1, 1, "assistant", "go"), (2, 0, "user", None), (2, 0, "user", None), (3, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op2_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(queries.OP2_SQL)
    names = [c[0] for c in found.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
    assert {r["conv_id"]: r["n_turns"] for r in got.collect()} == {-1: 2, 1: 4, 2: 2, 3: 1}


def test_sharding_is_exact_and_gapless(spark):
    rows = [(i, f"text {i % 5}", 9) for i in range(503)] + [(None, None, 9), (7, "text 2", 9), (7, "text 2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(4)
    done = sharding.shard(docs, 16)
    assert done.columns == ["doc_id", "text", "slot", "shard", "_slot"]
    slots = {}
    for r in done.collect():
        slots.setdefault(r["shard"], []).append(r["_slot"])
    assert len(slots) == 16 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sum(map(len, slots.values())) == len(rows)
    assert sorted(map(str, done.collect())) == sorted(map(str, done.collect()))
    assert sharding.shard(docs.limit(0)).count() == 0 and sharding.shard(docs.limit(3)).count() == 3
    plan = done._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "MapIn" not in plan


def test_communication_matrix():
    for counts in ([5, 0, 17, 40], [0, 0], [1], [10**10, 3 * 10**9, 7]):
        matrix = sharding.communication_matrix(counts, 16, 3)
        assert matrix.sum(1).tolist() == counts and matrix.min() >= 0
        assert matrix.sum(0).max() - matrix.sum(0).min() <= 1
    spread = np.mean([sharding.communication_matrix([100, 300], 4, s)[0] for s in range(200)], axis=0)
    assert abs(spread - 25).max() < 1.5


def test_packing_round_trip(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["alpha", "beta's", "gamma,", "x\ny", "", "1234", "é"]) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += [None, "", " ", "a  b", "\n\n", "<|endoftext|> it", "word\x00 word", "x" * 5000, "tail ", " head", texts[0], texts[0], "long text " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null key")], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, queries.vocabulary(), window=256, with_ids=True).collect()
    encoder = Tokenizer.from_file(queries.vocabulary())
    encoder.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for _, p, _ in sorted(pieces[i]) for x in p] == ids and pieces[i][0][2] == len(ids)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(docs.limit(0), queries.vocabulary()).count() == 0


def test_plan_fills_windows():
    plan = packing.plan({10: 3, 7: 2, 3: 5, 6: 1}, 10)
    fills = {}
    for size, low, high, each, first, _ in plan:
        for s in range((high - low) // each):
            fills[first + s] = fills.get(first + s, 0) + size * each
    assert max(fills.values()) <= 10 and sum(fills.values()) == 65 and len(fills) == 7


def test_media_sequences_and_resolution(spark):
    page = "<p>one<br>two</p><figure><img src='sha256:aa' alt=x><figcaption>cap <b>tion</b></figcaption></figure><script>no</script>mid<img src=sha256:bb alt=alt><p>open"
    items = [(i["kind"], i["text"] or i["media"], i["caption"]) for i in media.parse_items(page)]
    assert items == [("text", "one", None), ("text", "two", None), ("media", "sha256:aa", "cap tion"), ("text", "mid", None), ("media", "sha256:bb", "alt"), ("text", "open", None)]
    assert media.parse_items(None) == []
    pages = spark.createDataFrame([(1, page), (2, None), (3, page)], "page_id long, html string")
    store = spark.createDataFrame([("aa", 5), ("aa", 5)], "digest string, size int")
    got = media.resolve(media.references(media.sequences(pages)), store).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["caption"], r["size"]) for r in got] == [(p, q, c, s) for p in (1, 3) for q, c, s in ((2, "cap tion", 5), (4, "alt", None))]


def test_media_is_lossless(spark):
    texts = ["abc", None, "", "é" * 96, "x" * 192, "y" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = media.store_texts(docs)
    rows = {r["digest"]: r for r in media.read_media(kept).collect()}
    for r in kept.collect():
        raw = (texts[r["key"]] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        found = rows[r["digest"]]
        assert found["payload_sha256"] == hashlib.sha256(padded).hexdigest() and found["payload_bytes"] == len(padded) and r["n_bytes"] == len(raw)
        assert found["media_sha256"] == r["digest"] == hashlib.sha256(r["media"]).hexdigest()
    assert media.read_media(kept.limit(0)).count() == 0
