"""N-gram Jaccard join by parity sketches: which texts share nearly all their word shingles.

A text is the set of its shingles of three words (A-Z folded; a shorter text is one shingle).
Two sets link when their Jaccard similarity reaches `percent`, so when they differ in at most
(|A| + |B|) * (100 - percent) / (100 + percent) elements. A parity sketch XORs into a row of
bits one bit for every element. The XOR of two sketches is the sketch of the symmetric
difference, as what both hold cancels out, so their Hamming distance never exceeds the number
of elements in which the sets differ. Sketches serve twice:

* Join. Sizes are cut into bands; in a band in which linked sets differ in at most k elements,
  the elements are dealt to k + 1 blocks, each sketched by 64 bits of XOR. Of k + 1 blocks one
  at least has no difference, so linked sets agree in a block and meet in an equi-join on
  (band, block, sketch). Some blocks are by chance too thin to tell texts apart; going round the
  blocks, one without a difference must stand before one with one difference at most, so a
  thin block's key takes in either half of the next block. A set near a band's lower edge also
  stands in the band below. No linked pair is missed.
* Filter. A sketch of 1,024 bits, the same for all sizes, rules out most pairs that met and
  differ too much. What is left is verified on the sets themselves.

Equal sets are one node from the start. A bucket has a pivot, and each set is first compared
with one of the pivots it meets, twice over with other pivots; linked ones are joined to
components each time, and only buckets whose members are still in different ones go on. The
first pivot is the member that meets most sets over all its buckets: of the versions of a text the
one that was changed least, near which nearly all others lie that are linked at all. In what
remains, members outside a bucket's largest component meet the members of other components, each
pair tested on its sketches inside the join. Of the pairs that pass, each such member's nearest is
verified first, then its nearest few, then all that are still in different components; few pairs
are verified at once. So
copies are never expanded to pairs, and no link is lost.
Sets are recomputed from the texts for the members of pairs alone, by a sieve of fixed size.

Cases: null and empty texts, and those of white space, have no shingle and link with nothing;
shorter texts than a shingle link with equal ones; repeated rows are rows of one node; a null id
counts only where a component has no other; an empty table gives no row; other columns are
not read. Sets are told apart by 128 bits, nodes named by 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytewords as B
from tidemark.llm.graph import connected_components
from tidemark.llm.sieves import passes, sieve
from tidemark.operators.lineage import durable

SIZE = 3
PERCENT = 90
WORDS = 16  # 64-bit words of the sketch that all pairs are tested on
THIN = 4  # elements of a block below which its key takes in half of the next
PIVOTS = 2
NEAREST = (1, 8, None)  # candidates of a set that are verified at a time; None: all that are left
FEW = 1 << 13  # candidates that are verified at once in any case
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def most_apart(a: int, b: int, percent: int) -> int:
    """In how many elements linked sets of these sizes differ at most."""
    return (a + b) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band, its number of blocks); a linked set is never two bands above."""
    edges = [1]
    while edges[-1] < 1 << 40:
        reach = (edges[-1] - 1) * 100 // percent + 1
        edges.append(max(edges[-1] + 1, edges[-1] * 4 // 3, reach))
    blocks = [most_apart(e - 1, (e - 1) * 100 // percent, percent) + 1 for e in edges[1:]]
    return np.array(edges[:-1], np.int64), np.array(blocks, np.int64)


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, offsets of the texts in them)."""
    window, whole = B.windows(hashes, offsets, size)
    count = np.diff(offsets)
    text = np.repeat(np.arange(len(count)), count)
    short = np.flatnonzero((count > 0) & (count < size))
    alone = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        own = count[short] > k
        alone[own] = B.mix(alone[own] + hashes[offsets[short][own] + k] + np.uint64(1))
    items = np.concatenate([window[whole], B.mix(alone ^ count[short].astype(np.uint64))])
    text = np.concatenate([text[whole], short])
    order = np.lexsort((items, text))
    items, text = items[order], text[order]
    first = np.ones(len(items), bool)
    first[1:] = (items[1:] != items[:-1]) | (text[1:] != text[:-1])
    items, text = items[first], text[first]
    return items, np.searchsorted(text, np.arange(len(count) + 1))


def block_keys(items: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets of the sets in them): the blocks of each set in its band, and in the one below where partners may be."""
    edges, blocks = bands(percent)
    n = np.diff(offsets)
    band = np.searchsorted(edges, n, "right") - 1
    lower = (band > 0) & (-(-n * percent // 100) < edges[np.maximum(band, 0)])
    keys, owner = [], []
    for step, stands in ((0, n > 0), (1, lower)):
        own = np.where(stands, blocks[np.maximum(band - step, 0)], 1)
        own = np.where(own > 1, own, 0)  # in a single block only equal sets agree
        base = np.cumsum(own) - own
        some = np.repeat(own > 0, n)
        x = items[some]
        of = np.repeat(np.arange(len(n)), n)[some]
        block = ((x >> np.uint64(32)) * own[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = 2 * (base[of] + block) + (x & np.uint64(1)).astype(np.int64)
        halves = np.zeros(2 * int(own.sum()), np.uint64)
        np.bitwise_xor.at(halves, slot, B.mix(x ^ _GOLDEN))
        filled = np.bincount(slot, minlength=len(halves))
        text = np.repeat(np.arange(len(n)), own)
        place = np.arange(len(text)) - base[text]
        seed = B.mix(((band[text] - step) << 40).astype(np.uint64) + place.astype(np.uint64) + np.uint64(1))
        whole = B.mix((halves[::2] ^ halves[1::2]) + seed)
        thin = filled[::2] + filled[1::2] < THIN
        after = base[text] + (place + 1) % np.maximum(own[text], 1)
        keys += [whole[~thin], *[B.mix(whole[thin] + B.mix(halves[2 * after[thin] + h] + np.uint64(h + 1))) for h in (0, 1)]]
        owner += [text[~thin], text[thin], text[thin]]
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


def parity(items: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """(sets, words): one bit of each element, XORed."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(n * words, np.uint64)
    word = ((items >> np.uint64(8)) % np.uint64(words)).astype(np.int64)
    np.bitwise_xor.at(out, of * words + word, np.uint64(1) << (items >> np.uint64(1) & np.uint64(63)))
    return out.reshape(n, words)


def _identity(items: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(B.mix(items ^ B.mix(np.array([seed], np.uint64))), out=total[1:])
    return B.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, data, offsets in B.chunks(batch, "text"):
        starts, ends, of = B.words(data, offsets)
        yield part, *shingle_sets(B.range_hashes(data, starts, ends, fold=True), of, size)


def sketched(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, _id, set_id, check, n, sketch, keys) of (row, _id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, items, of in _sets(batch, size):
                keys = _lists(*block_keys(items, of, percent))
                sketch = _lists(parity(items, of).ravel(), WORDS * np.arange(len(part) + 1))
                named = [pa.array(_identity(items, of, k)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *named, pa.array(np.diff(of)), sketch, keys], names=["row", "_id", "set_id", "check", "n", "sketch", "keys"])

    return rows.select("row", "_id", "text").mapInArrow(run, "row long, _id long, set_id long, check long, n long, sketch array<long>, keys array<long>")


def sets_of(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, items) of the rows (row, text) whose mark is in `wanted` (row), and of a few others that its sieve lets through."""
    sent = rows.sparkSession.sparkContext.broadcast(sieve(wanted.select(F.xxhash64("row").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(passes(sent.value, batch.column(1).to_numpy().view(np.uint64))))
            for part, items, of in _sets(some, size):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_identity(items, of, 1)), _lists(items, of)], names=["row", "set_id", "items"])

    found = rows.select("row", F.xxhash64("row").alias("h"), "text").mapInArrow(run, "row long, set_id long, items array<long>")
    return found.join(wanted, "row", "left_semi").select("set_id", "items")


def _near(a_n: Column, b_n: Column, a_sketch: list[Column], b_sketch: list[Column], percent: int) -> tuple[Column, Column]:
    """(whether two sketches allow a link of sets of these sizes, their Hamming distance)."""
    most = (a_n + b_n) * (100 - percent)
    apart = sum((F.bit_count(a_sketch[w].bitwiseXOR(b_sketch[w])) for w in range(WORDS)), F.lit(0))
    return (F.abs(a_n - b_n) * (100 + percent) <= most) & (apart * (100 + percent) <= most), apart


class _Verifier:
    """Verifies pairs on the sets themselves, which are made once for all rounds."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, size: int, percent: int):
        self.nodes, self.rows, self.size, self.percent = nodes, rows, size, percent

    def close(self, pairs: DataFrame) -> DataFrame:
        """The distinct (a, b) whose sketches allow a link."""
        side = lambda k: self.nodes.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
        met = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
        sketch = lambda k: [F.get(f"sketch_{k}", F.lit(w)) for w in range(WORDS)]
        return met.filter(_near(F.col("n_a"), F.col("n_b"), sketch("a"), sketch("b"), self.percent)[0]).select("a", "b")

    def linked(self, pairs: DataFrame) -> DataFrame:
        pairs = durable(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        wanted = self.nodes.join(ends, "set_id", "left_semi").select("row")
        sets = sets_of(self.rows, wanted, self.size)
        side = lambda k: sets.select(F.col("set_id").alias(k), F.col("items").alias(f"items_{k}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        shared = F.size(F.array_intersect("items_a", "items_b")).cast("long")
        whole = F.size("items_a") + F.size("items_b") - shared
        return durable(met.filter(shared * 100 >= whole * self.percent).select("a", "b"))


def set_classes(nodes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(set_id, component) of the distinct sets that are linked to another."""
    check = _Verifier(nodes, rows, size, percent)
    bucket = nodes.select("set_id", F.explode("keys").alias("key"))
    shared = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = F.sum("members").over(Window.partitionBy("set_id"))
    bucket = durable(bucket.join(shared, "key").select("key", "set_id", met.alias("met"))).withColumn("component", F.col("set_id"))
    links = group = None

    def joined(found: DataFrame) -> DataFrame:
        nonlocal links, group
        links = found if links is None else links.unionByName(found)
        group = connected_components(links).withColumnRenamed("node", "set_id")
        return group

    for turn in range(PIVOTS):
        if bucket.isEmpty():
            break
        found = check.linked(check.close(_with_pivots(bucket, turn)))
        if group is None or not found.isEmpty():
            bucket = durable(_still_mixed(bucket, joined(found)))
    if group is None:
        return nodes.select("set_id", F.col("set_id").alias("component")).limit(0)
    left = _candidates(bucket, nodes, percent)
    for most in NEAREST:
        if left.isEmpty():
            break
        of = lambda k: group.select(F.col("set_id").alias(k), F.col("component").alias(f"of_{k}"))
        apart = F.coalesce("of_x", "x") != F.coalesce("of_y", "y")
        left = durable(left.join(of("x"), "x", "left").join(of("y"), "y", "left").filter(apart).select("x", "y", "apart"))
        best = Window.partitionBy("x").orderBy("apart", "y")
        if most is not None and left.count() <= FEW:
            most = None
        picked = left if most is None else durable(left.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= most).drop("_nth"))
        found = check.linked(picked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not found.isEmpty():
            joined(found)
        if most is None:
            break
        left = left.join(picked, ["x", "y"], "left_anti")
    return group


def _still_mixed(bucket: DataFrame, group: DataFrame) -> DataFrame:
    """The buckets with members of several components, under the names that these have now."""
    labelled = bucket.drop("component").join(group, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return labelled.join(mixed, "key")


def _with_pivots(bucket: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set with one pivot of another component."""
    order = F.xxhash64("set_id", F.lit(turn))
    order = order if turn else F.struct(F.col("met"), order)
    pivot = bucket.groupBy("key").agg(F.max_by("set_id", order).alias("pivot"), F.max_by("component", order).alias("own"))
    met = bucket.join(pivot, "key").filter("own <> component").groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("k"))
    # Of the pivots that a member meets, the one met in most buckets is the likeliest to be linked.
    rank = F.shiftleft("k", 32) + F.xxhash64("pivot").bitwiseAND(F.lit(0xFFFFFFFF))
    met = met.groupBy("set_id").agg(F.max_by("pivot", rank).alias("pivot"))
    return met.select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b"))


def _candidates(bucket: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y, apart): sets x outside the largest component of a bucket, the sets y of its other components that their sketches allow a link to, and the sketches' distance."""
    size = bucket.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    main = size.groupBy("key").agg(F.max_by("component", F.shiftleft("c", 32) + F.xxhash64("component").bitwiseAND(F.lit(0xFFFFFFFF))).alias("main"))
    words = [F.get("sketch", F.lit(w)).alias(f"s{w}") for w in range(WORDS)]
    full = durable(bucket.join(main, "key").join(nodes.select("set_id", "n", *words), "set_id"))
    side = lambda rows, k: rows.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("set_id", "component", "n", *[f"s{w}" for w in range(WORDS)])])
    sketch = lambda k: [F.col(f"s{w}_{k}") for w in range(WORDS)]
    near, apart = _near(F.col("n_x"), F.col("n_y"), sketch("x"), sketch("y"), percent)
    met = side(full.filter("component <> main"), "x").join(side(full, "y"), "key").filter((F.col("component_x") != F.col("component_y")) & near)
    return durable(met.select(F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y"), apart.alias("apart")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`; the component is named by its smallest doc_id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    # A row is named by what it holds, so a repeated task gives the same names.
    rows = rows.withColumn("row", F.xxhash64("_id", F.coalesce("text", F.lit(""))))
    seen = durable(sketched(rows, size, percent))
    one = F.min(F.struct("row", "n", "sketch", "keys"))
    nodes = durable(seen.filter("n > 0").groupBy("set_id", "check").agg(one.alias("r")).select("set_id", "r.*"))
    group = set_classes(nodes, rows, size, percent)
    named = seen.filter("n > 0").groupBy("set_id").agg(F.min("_id").alias("least"))
    named = named.join(group, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = named.join(least, "component").select("set_id", "component_id")
    out = seen.select("_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(lookup, "set_id", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS x
  FROM w
),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, len(x)
"""
