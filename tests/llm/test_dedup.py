"""Substring dedup, line dedup and the Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import jaccard_join, repeats, vec
from riskweave.llm.components import components
from riskweave.llm.line_dedup import dedup_lines
from riskweave.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(12, 40))] for _ in range(4)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for p in passages:
            if rng.random() < 0.3:
                at = rng.randint(0, len(text))
                text[at:at] = p[rng.randint(0, 3) :]
        rows.append((rng.randint(0, 10**6) * 100 + i, rng.choice([" ", "\t", "  "]).join(text)))
    rows += [(7, rows[3][1]), (5, None), (6, ""), (8, " \n "), (9, "x" * 5000), (11, "a " * 300), (11, "a " * 300), (13, "é ü " * 40), (None, rows[4][1])]
    return rows


def substring_truth(rows, length):
    first = {}
    for k, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - length + 1 if k is not None else 0):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, k), k)
    out = []
    for k, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - length + 1 if k is not None else 0):
            if first[tuple(w[i : i + length])] < k:
                keep[i : i + length] = [False] * length
        out.append((k, " ".join(x for x, y in zip(w, keep) if y), len(w), len(w) - sum(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [13, 4])
def test_substrings_match_brute_force(spark, length):
    rows = make(length)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, __group string, n_units int").repartition(5)
    done = dedup_substrings(docs, length)
    assert done.columns == ["doc_id", "text", "__group", "n_units", "_n_units", "n_removed"]
    got = sorted(((r[0], r[1], r[4], r[5]) for r in done.collect()), key=str)
    assert got == substring_truth(rows, length)


@pytest.mark.parametrize("dedup, search", [(dedup_substrings, repeats.Search(vec.SPACES, 13, 7, repeats.fixed_blocks(7), False)), (dedup_lines, repeats.Search(vec.BREAKS, 2, 1, repeats.winnowed(1, 2), True))])
def test_a_passage_of_all_documents_is_sent_once_a_group(dedup, search):
    table = pa.table({"text": ["\n".join(f"own{i}line{j}" for j in range(3)) + "\n" + "\n".join(f"shared{j}" for j in range(30)) for i in range(4000)], "key": range(4000)})
    group = repeats._Group(table, search, "text", "key", 2)
    sent = group.anchors()[2]
    answers = {(repeats._ANCHORS, p): repeats._bits(np.ones(int(np.frombuffer(b, np.uint32, 1)[0]), bool)) for p, b in sent}
    found = group.candidates(answers)
    assert len(found.first) == len(set(found.value.tolist())) and len(found.start) > 4000 * 15
    shared = np.flatnonzero(np.bincount(found.which) == 4000)
    assert len(shared) == 30 - search.length + 1
    assert (found.key[found.first[shared]] == 0).all() and found.later[np.isin(found.which, shared)].sum() == 3999 * len(shared)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(docs).count() == 0
    assert dedup_lines(docs).count() == 0
    assert jaccard_join.join(docs).count() == 0


def line_truth(rows, length):
    places = {}
    for k, t in rows:
        lines = [x for x in re.split(r"[\r\n]+", t or "") if x]
        for i in range(len(lines) - length + 1 if k is not None else 0):
            places.setdefault(tuple(lines[i : i + length]), []).append((k, i))
    first = {g: min(p) for g, p in places.items()}
    out = []
    for k, t in rows:
        lines = [x for x in re.split(r"[\r\n]+", t or "") if x]
        keep = [True] * len(lines)
        for i in range(len(lines) - length + 1 if k is not None else 0):
            if first[tuple(lines[i : i + length])] < (k, i):
                keep[i : i + length] = [False] * length
        out.append((k, tuple(x for x, y in zip(lines, keep) if y), len(lines), len(lines) - sum(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram"), [(2, 1), (3, 1), (4, 2), (1, 1)])
def test_lines_match_brute_force(spark, length, gram):
    rng = random.Random(length)
    pool = [f"line {i}" for i in range(25)]
    rows = [(i * 3 % 101, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", "\r\n"])) for i in range(80)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "long " * 4000), (None, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = dedup_lines(docs, length, gram).collect()
    got = sorted(((r[0], tuple(x for x in re.split(r"[\r\n]+", r[1]) if x), r[2], r[3]) for r in done), key=str)
    assert got == line_truth(rows, length)
    assert all(r["text"] == (dict(rows)[r["doc_id"]] or "") for r in done if r["n_removed"] == 0 and r["doc_id"] is not None)


def jaccard_truth(rows, rule):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, k = [], rule.words
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= rule.percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), None if key is None else least[find(i)]) for i, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(3, 90), jaccard_join.Rule(5, 80)])
def test_jaccard_matches_brute_force(spark, rule, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(rule.words)
    words = [f"t{i}" for i in range(3000)]
    rows = []
    for base in range(3):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(50):  # edits at growing rates: links, chains and misses in one group
            rate = rng.random() * 0.06
            rows.append((len(rows) * 7 % 1009, " ".join(rng.choice(words) if rng.random() < rate else w for w in text)))
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(40)]
    rows += [(3000, rows[0][1]), (3001, rows[0][1].upper()), (3002, "one two"), (3003, "One  TWO"), (3004, None), (3005, ""), (3006, " \t"), (None, rows[1][1]), (3007, "z " * 3000), (3007, "z " * 3000)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, component_id int").repartition(4)
    got = sorted((tuple(r) for r in jaccard_join.join(docs, rule).collect()), key=str)
    assert got == jaccard_truth(rows, rule)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(6, 30)] + [(9, 9), (None, 3), (1, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 30)}}


def test_winnowing_guarantee():
    import numpy as np

    pick = repeats.winnowed(2, 3)
    rng = np.random.default_rng(3)
    units = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    units[25:29] = units[3:7]
    first = np.array([0, 20, 40])
    grams = vec.windows(units, 2)
    at, value, _ = pick(grams, first)
    assert set(value[(at >= 3) & (at <= 5)].tolist()) & set(value[(at >= 25) & (at <= 27)].tolist())
