"""Phrase collocations by Toivonen's method: a sample proposes, full passes count exactly until closed.

Texts (A-Z folded) are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks and tabs
into words. A phrase is a run of words inside a piece; all its occurrences count, in each language
apart. Phrases of 2 to `longest` words found at least `least` times are candidates.

A random sample of the documents (one in SAMPLE) is mined level by level with a lower
threshold. What it finds frequent is the proposal; its negative border are the phrases outside it
whose first and last part, one word shorter, are both inside (and all words). One full pass counts
proposal and border exactly. A phrase can be frequent only if both parts are; so if no phrase of
the border turns out frequent, every frequent phrase was counted and mining is closed. Otherwise
these failures join the proposal, and a further pass counts the phrases that only now have both
parts inside, until a pass brings no failure. The sample decides how many passes are needed, never
what is found.

The proposal is a sieve of hashes of fixed size, sent to all tasks; a phrase that passes it by
chance is one more count. These passes count by 64-bit hash, of which only few bytes are shuffled
for a phrase; a hash is as frequent as all its phrases together, so none is lost. At the end one
pass more counts the phrases of the frequent hashes by their own words, which is exact. Tasks
count within some megabytes of text, Spark combines before it shuffles, and a phrase in every
document is a row per task. Nothing but the sieves and a number for each pass reaches the driver.

A candidate is scored by its weakest cut; candidates inside a longer one that is nearly as frequent
go; the best of each language stay, by a window that each task applies to its own rows first.

Cases: a null text is empty, a null language is `und`; texts are read whole; repeated rows count
each; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytewords as B
from tidemark.llm.sieves import passes, sieve
from tidemark.operators.lineage import durable

LEAST, LONGEST, TOP = 30, 4, 2000
SAMPLE = 4  # one document in so many
SAMPLE_LEAST = 3  # occurrences in the sample; LEAST / SAMPLE are expected of the rarest candidates
COVERED = 80  # per cent of its occurrences that lie inside one longer phrase
SCALE = 2_000_000
CHUNK = 2 << 20  # bytes of text that are counted before rows are made

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, starts, ends, piece of each word): words of one piece and text stand together."""
    data = _LOWER[data]
    stop = _BREAK[data]
    starts, ends, of = B.spans(~stop & ~_BLANK[data], offsets)
    broken = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stop, out=broken[1:])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    return data, starts, ends, broken[starts] + text


def runs(hashes: np.ndarray, piece: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to `longest` words: (hash of the run that starts at each word, whether it lies within a piece)."""
    out = [(hashes, np.ones(len(hashes), bool))]
    for k in range(2, longest + 1):
        h, whole = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), bool)
        if len(hashes) >= k:
            m = len(hashes) - k + 1
            whole[:m] = piece[k - 1 :] == piece[:m]
            h[:m] = B.mix(out[-1][0][:m] ^ B.mix(hashes[k - 1 :] + np.uint64(k)))
        out.append((h, whole))
    return out


def _phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, words: int) -> pa.Array:
    """The runs of `words` words from each place, with single spaces."""
    if not len(at):
        return pa.array([], pa.string())
    columns = []
    for k in range(words):
        a, n = starts[at + k], ends[at + k] - starts[at + k]
        of = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(of[-1]) - np.repeat(of[:-1] - a, n)
        buffers = [None, pa.py_buffer(of.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[index]))]
        columns.append(pa.LargeStringArray.from_buffers(len(at), *buffers[1:]))
    return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string()) if words > 1 else columns[0].cast(pa.string())


def _language_hash(lang: pa.Array) -> np.ndarray:
    text = lang.cast(pa.large_string())
    _, where, data = text.buffers()
    of = np.frombuffer(where, np.int64, len(text) + 1 + text.offset)[text.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return B.range_hashes(data[of[0] : of[-1]], of[:-1] - of[0], of[1:] - of[0], fold=False)


class _Runs:
    """The runs of words of some texts: hashes by length, and their languages."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, longest: int) -> None:
        self.lower, self.starts, self.ends, piece = pieces(data, offsets)
        self.languages = part.column("lang").dictionary_encode()
        self.language = self.languages.indices.to_numpy()[np.searchsorted(offsets, self.starts, "right") - 1]
        # The language is part of a word's hash, so that of every run and of the sieves.
        own = B.mix(_language_hash(self.languages.dictionary))[self.language] if len(self.starts) else np.zeros(0, np.uint64)
        self.by_length = runs(B.mix(B.range_hashes(self.lower, self.starts, self.ends, fold=False) ^ own), piece, longest)

    def admitted(self, k: int, bits: np.ndarray) -> np.ndarray:
        """Which runs of k words have both parts, one word shorter, in the sieve."""
        inside = passes(bits, self.by_length[k - 2][0])
        both = inside.copy()
        both[:-1] &= inside[1:]
        return both

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        return _phrases(self.lower, self.starts, self.ends, at, k)


def hashed_counts(docs: DataFrame, levels: tuple[int, ...], now: np.ndarray | None, before: np.ndarray | None = None) -> DataFrame:
    """(words, h, f) of (lang, text): runs of the given numbers of words whose parts, one word shorter, are in the sieve `now`.

    Single words all count. With `before`, runs whose parts were in that sieve already are left
    out. Only hashes are shuffled; where two phrases share one, their counts come as one.
    """
    sent = [None if s is None else docs.sparkSession.sparkContext.broadcast(s) for s in (now, before)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in B.chunks(batch, "text", CHUNK):
                found = _Runs(*texts, max(levels))
                for k in levels:
                    h, use = found.by_length[k - 1]
                    if k > 1:
                        use = use & found.admitted(k, sent[0].value)
                        if before is not None:
                            use &= ~found.admitted(k, sent[1].value)
                    some, times = np.unique(h[use], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.view(np.int64)), pa.array(times.astype(np.int64))], names=["words", "h", "f"])

    return docs.select("lang", "text").mapInArrow(count, "words int, h long, f long").groupBy("words", "h").agg(F.sum("f").alias("f"))


def exact_counts(docs: DataFrame, hashes: DataFrame, longest: int) -> DataFrame:
    """(lang, words, phrase, f) of the phrases whose hash is in `hashes`, and of some that its sieve lets through; a row of 0 words is a language's total."""
    sent = docs.sparkSession.sparkContext.broadcast(sieve(hashes.select("h")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["lang", "words", "phrase", "f"])
        for batch in batches:
            for part, *text in B.chunks(batch, "text", CHUNK):
                found = _Runs(part, *text, longest)
                names = found.languages.dictionary.cast(pa.string())
                total = np.bincount(found.language, minlength=len(names)).astype(np.int64)
                yield put(names, np.zeros(len(names), np.int32), pa.array([""] * len(names)), total)
                for k, (h, use) in enumerate(found.by_length, 1):
                    where = np.flatnonzero(use & passes(sent.value, h))
                    _, first, times = np.unique(h[where], return_index=True, return_counts=True)
                    at = where[first]
                    yield put(names.take(pa.array(found.language[at])), np.full(len(at), k, np.int32), found.phrases(at, k), times.astype(np.int64))

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, words int, phrase string, f long")
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def proposed(docs: DataFrame, longest: int, sample: int, least: int) -> DataFrame:
    """(h) of the phrases of up to longest - 1 words that are frequent in a sample, level by level."""
    some = durable(docs.sample(False, 1.0 / sample, seed=7))
    found = None
    for k in range(1, longest):
        level = hashed_counts(some, (k,), None if found is None else sieve(found)).filter(F.col("f") >= least).select("h")
        found = durable(level if found is None else found.unionByName(level))
    return found


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST, passed: list | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, f) of every phrase found at least `least` times, (lang, n) words of each language).

    `docs` has (lang, text). The border's failures of each pass are appended to `passed`.
    """
    inside = proposed(docs, longest, sample, sample_least)
    now, before, every = sieve(inside), None, None
    while True:
        levels = tuple(range(1 if before is None else 2, longest + 1))
        counts = durable(hashed_counts(docs, levels, now, before).filter(F.col("f") >= least))
        every = counts if every is None else every.unionByName(counts)
        missed = durable(counts.filter(F.col("words") < longest).select("h").join(inside.select("h"), "h", "left_anti"))
        failures = missed.count()
        if passed is not None:
            passed.append(failures)
        if not failures:
            break
        inside = durable(inside.unionByName(missed))
        now, before = sieve(inside), now
    counts = durable(exact_counts(docs, every, longest).filter((F.col("f") >= least) | (F.col("words") == 0)))
    return counts.filter("words > 0"), counts.filter("words = 0").select("lang", F.col("f").alias("n"))


def _cut(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(found: DataFrame, least: int, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers."""
    wide = F.col("f").cast("decimal(38,0)")
    words = F.split("phrase", " ")
    long = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("w"))
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _cut(F.col("w"), F.lit(1), F.col("k")).alias("left"), _cut(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda part, name: found.select("lang", F.col("phrase").alias(part), wide.alias(name))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # Floor of a quotient of whole numbers: what `div` gives for decimals of no fraction.
    value = F.expr(f"cast(cast(a as decimal(38,0)) * {SCALE} div (l + r) as bigint)")
    best = F.min(F.struct(value.alias("score"), "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("b")
    judged = cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.*").drop("k")
    # Runs inside a candidate; one of two words has none.
    starts = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: _cut(F.col("w"), i, n)))
    inner = long.filter("words > 2").select("lang", F.col("a").alias("outer"), F.explode(F.array_distinct(F.flatten(starts))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    judged = judged.join(most, ["lang", "phrase"], "left")
    hides = F.coalesce(F.col("outer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * covered, F.lit(False))
    return judged.filter(~hides).drop("outer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, **sampling) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    found, totals = frequent(rows, least, longest, **sampling)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(found, least, covered).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM p
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM p
  UNION ALL SELECT lang, 4, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) FROM p
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
judged AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score, cut
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
),
weakest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (SELECT lang, a, unnest(list_distinct(flatten([[array_to_string(w[i:i + n - 1], ' ') for i in range(1, k - n + 2)] for n in range(2, k)]))) AS phrase FROM c WHERE k > 2),
most AS (SELECT lang, phrase, max(a) AS outer_a FROM inner_runs GROUP BY ALL),
left_over AS (
  SELECT w.* FROM weakest w LEFT JOIN most m ON m.lang = w.lang AND m.phrase = w.phrase WHERE outer_a IS NULL OR 100 * outer_a < 80 * a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
