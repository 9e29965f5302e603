"""Phrase mining against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from tidemark.llm import phrases as P, sieves

DATA = "/root/testdata/sf0.001"


def counts(rows, longest):
    found, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    return found, total


def brute(rows, least, longest=4, top=2000, covered=80):
    found, total = counts(rows, longest)
    candidates = {(lang, p): a for (lang, p), a in found.items() if len(p) > 1 and a >= least}
    most = collections.Counter()
    for (lang, p), a in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                most[lang, p[i : i + n]] = max(most[lang, p[i : i + n]], a)
    ranked = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if most[lang, p] and 100 * most[lang, p] >= covered * a:
            continue
        score, _, left, right = min((2_000_000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k, found[lang, p[:k]], found[lang, p[k:]]) for k in range(1, len(p)))
        ranked[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = []
    for lang, own in ranked.items():
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, phrase int, f int")
    return sorted(tuple(r) for r in P.collocations(df, **options).collect())


def test_given_table(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows, 30)


def test_cases(spark):
    rows = [
        (None, "A b\tc  d, a b c d"), (None, "a b c d"), ("und", None), ("und", ""), ("de", " \t "), ("de", "ß É日本 x.ß É日本 x"), ("fr", "ha " * 30_000), ("fr", "ha ha ha ha"),
        ("en", "one two\nthree one two"), ("en", "ONE TWO three;four"), ("en", "ONE TWO three;four"), ("en", ".,;:!?"),
    ]
    for least in (1, 2):
        assert run(spark, rows, least=least, sample=2, sample_least=1) == brute(rows, least)
    assert run(spark, rows, least=2, top=2) == brute(rows, 2, top=2)
    assert run(spark, [("en", None)]) == []
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("sample_least", [1, 4, 10**9])
def test_failures_of_the_border_are_followed(spark, sample_least):
    """Whatever the sample proposes, too little or nothing, the passes end with every frequent phrase."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    rows = [("ab"[k % 3 == 0], " ".join(rng.choices(words, [1 / (1 + j) for j in range(30)], k=rng.randrange(60)))) for k in range(300)]
    found, total = counts(rows, 4)
    passed = []
    df = spark.createDataFrame(rows, "lang string, text string")
    every, totals = P.frequent(df, 8, sample=4, sample_least=sample_least, passed=passed)
    assert sorted((r.lang, r.phrase, r.f) for r in every.collect()) == sorted((lang, " ".join(p), a) for (lang, p), a in found.items() if a >= 8)
    assert {r.lang: r.n for r in totals.collect()} == dict(total)
    assert passed[-1] == 0 and (sample_least < 10**9 or len(passed) == 4)
    assert run(spark, rows, least=8, sample_least=sample_least) == brute(rows, 8)


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    big = 4 * 10**15
    rows = [("en", 1, "a", big + 3), ("en", 1, "b", big + 4), ("en", 2, "a b", big)]
    got = P.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long"), 30).collect()
    assert [tuple(r) for r in got] == [("en", "a b", big, 2_000_000 * big // (2 * big + 7), big + 3, big + 4)]


def test_sieve(spark):
    rng = np.random.default_rng(1)
    inside = rng.integers(-(2**63), 2**63, 5000)
    bits = sieves.sieve(spark.createDataFrame([(int(x),) for x in inside] + [(None,)], "h long"), 20)
    assert len(bits) == 1 << 17 and sieves.passes(bits, inside.view(np.uint64)).all()
    assert sieves.passes(bits, rng.integers(0, 2**64, 10_000, np.uint64)).mean() < 0.01
    assert not sieves.passes(sieves.sieve(spark.createDataFrame([], "h long")), inside.view(np.uint64)).any()
