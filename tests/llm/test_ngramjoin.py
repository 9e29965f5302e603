"""The n-gram join against plain sets and union-find."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, ngramjoin as N

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    words = [re.sub("[A-Z]+", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < size else [tuple(words[k : k + size]) for k in range(len(words) - size + 1)])


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((rows[i][0], len(sets[i]), least.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "n": F.lit("x"), "set_id": F.lit(None)})
    return sorted((tuple(r) for r in N.jaccard_components(df, **options).collect()), key=str)


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "text of no id here"), (None, "Text of no id here"), (4, "one two"), (4, "one two"), (5, "One\x0btwo"), (6, "one"), (7, "two one"),
        (8, "long line " * 9000 + "end"), (9, "a b c d " * 20), (10, "d a b c d a b c"), (None, None), (11, "text of no id there"),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0] + [(1, None)]) == [(1, 0, 1)]
    assert N.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [90, 70])
def test_random_edits(spark, percent):
    """Chains of edited texts on either side of the threshold, at every length from 3 words on."""
    rng = random.Random(percent)
    rows = []
    for family in range(25):
        text = [f"w{family}x{rng.randrange(60)}" for _ in range(rng.choice([3, 9, 12, 13, 14, 21, 30, 60, 200, 700]))]
        for _ in range(rng.choice([2, 5, 12])):
            rows.append((rng.randrange(10**6), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, len(text) // 40])):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [text[at], f"m{rng.randrange(10**6)}"]])
                text = text or ["none"]
    assert run(spark, rows, percent=percent) == brute(rows, percent)


def test_one_hot_group(spark):
    """Hundreds of versions of a text, some of them linked only by way of others; no pair is expanded."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(700):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(60)] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(text)))
    assert run(spark, rows) == brute(rows)


def test_pivots_are_hubs(spark, monkeypatch):
    """Versions that are linked by way of the original alone: pivots find it, so hardly any pair is left to compare."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        text = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 4, 4])):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    left, candidates = [], N._candidates

    def counted(*args):
        found = candidates(*args)
        left.append(found.count())
        return found

    monkeypatch.setattr(N, "_candidates", counted)
    assert run(spark, rows) == brute(rows)
    assert sum(left) < len(rows) // 10


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 10, 40, 900, 5000):
        a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        k = N.most_apart(n, n, 90) // 2
        b = np.concatenate([a[k:], rng.integers(0, 2**63, k, np.uint64)])
        items, of = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n])
        sketch = N.parity(items, of)
        assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= 2 * k
        keys, at = N.block_keys(items, of, 90)
        shared = set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())
        assert shared or N.most_apart(n, n, 90) == 0


@pytest.mark.parametrize("few", [0, graph.FEW])
def test_components(spark, few):
    pairs = [(5, 4), (4, 3), (9, 9), (7, 7), (7, 8), (None, 1), (3, 2), (5, 2), *[(100, 200 + k) for k in range(300)], *[(1000 + k, 1001 + k) for k in range(70)]]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), few=few).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 9: 9, 7: 7, 8: 7, 100: 100, **{200 + k: 100 for k in range(300)}, **{1000 + k: 1000 for k in range(71)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_components_of_random_links(spark):
    """Union-find by hand, one task, and rounds of joins."""
    rng = random.Random(6)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(600)]
    root = list(range(900))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    want = {i: find(i) for p in pairs for i in p}
    df = spark.createDataFrame(pairs, "a long, b long")
    for few in (0, graph.FEW):
        assert {r.node: r.component for r in graph.connected_components(df, few=few).collect()} == want
    named = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "a string, b string")
    assert {r.node: r.component for r in graph.connected_components(named).collect()} == {f"n{k:03}": f"n{v:03}" for k, v in want.items()}
