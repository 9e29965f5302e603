"""Near-duplicates: BagMinHash signatures, bands, exact check of the multiset overlap, classes.

A text is the multiset of its shingles of five words (A-Z folded; a shorter text is one
shingle). Its signature keeps, for each of `bands * rows` components, the first point of
Poisson processes over (time, weight): every shingle has one process per dyadic stretch of
weight, [0,1), [1,2), [2,4), [4,8) ..., whose points come in order of time, each with a
component and a weight, and count if that weight is below the shingle's own multiplicity.
Two texts share a component with a chance of exactly their weighted Jaccard similarity. A
stretch is followed only up to the time when all components are surely taken, which falls
with the length of the text, so a signature costs a hash per shingle and a constant.

Texts equal in their words are one text from the start. Texts that agree in a band meet in a
bucket. A pair is linked if the overlap of its multisets is at least the threshold, which is
tested on the shingles themselves. Within a bucket not all pairs are formed: first one
member, the one that meets most texts, is compared with the rest and the links are joined to
components; then only pairs of different components are left, the members outside a bucket's
largest component with all others. Of these, pairs that cannot overlap enough, given how
either differs from the first member, are passed over. Every pair of a bucket is so either
compared, ruled out exactly, or known to be in one class. A text at the threshold misses all bands with a chance of
(1 - 0.8 ** 5) ** 32, 4 in a million.

Signatures are stored once; the joins carry ids and, for texts in buckets, shingle hashes.
Hot buckets and hot partners are split as skewed keys. Components run over tables.

Cases: null and empty texts, and those of white space only, have no shingle and are classes
of their own; ties are settled by the smallest id; repeated rows are copies of each other; a
null id is below all others for choosing the row that stays and is ignored for a class id
unless the class has no other; an empty table gives no row; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewords as B
from tidemark.llm.graph import connected_components
from tidemark.operators.lineage import durable

SHINGLE = 5
BANDS, ROWS = 32, 5
SIMILARITY = 0.8
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORDS = 8  # 64-bit words of the bitmaps that bound overlaps
_BLOCK = 1 << 17  # points made at a time
NO_ID = -(1 << 63)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, text of each); a text with fewer words has one shingle of all its words."""
    window, whole = B.windows(hashes, offsets, size)
    count = np.diff(offsets)
    text = np.repeat(np.arange(len(count)), count)
    short = np.flatnonzero((count > 0) & (count < size))
    alone = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        own = count[short] > k
        alone[own] = alone[own] * np.uint64(31) + hashes[offsets[short][own] + k]
    return np.concatenate([window[whole], B.mix(alone + count[short].astype(np.uint64))]), np.concatenate([text[whole], short])


def counted(shingle: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, multiplicity) of distinct shingles of each text, in order of text."""
    order = np.lexsort((shingle, text))
    s, t = shingle[order], text[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(first)
    return s[at], t[at], np.diff(np.append(at, len(s)))


def elements(shingle: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: a shingle's n-th occurrence is an element of its own. (elements, offsets of the texts)."""
    s, t, n = counted(shingle, text)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out = B.mix(np.repeat(s, n) + nth.astype(np.uint64) * _GOLDEN)
    return out, np.searchsorted(np.repeat(t, n), np.arange(texts + 1))


def bag_minhash(shingle: np.ndarray, text: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """(texts, m) identities of the first points; texts without a shingle have zeros."""
    weight = np.bincount(text, count, texts)
    # One process for every dyadic stretch of weight that begins below the multiplicity.
    level = np.zeros(len(count), np.int64)
    above = count > 1
    level[above] = np.ceil(np.log2(count[above])).astype(np.int64)
    process = np.repeat(np.arange(len(count)), level + 1)
    stretch = np.arange(len(process)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    low = np.where(stretch == 0, 0.0, np.exp2(stretch - 1.0))
    span = np.maximum(low, 1.0)
    seed = B.mix(shingle[process] + stretch.astype(np.uint64) * _GOLDEN)
    of, most = text[process], count[process].astype(np.float64)
    out = np.zeros((texts, m), np.uint64)
    open_texts = weight > 0
    reach = np.log(m) + 3.0
    while open_texts.any():
        limit = np.where(open_texts, reach / np.maximum(weight, 1.0), 0.0)
        best = np.full(texts * m, np.inf)
        winner = np.zeros(texts * m, np.uint64)
        for x, slot, point in _points(seed, of, low, span, most, limit, m, np.flatnonzero(open_texts[of])):
            np.minimum.at(best, slot, x)
            won = best[slot] == x
            winner[slot[won]] = point[won]
        full = np.isfinite(best.reshape(texts, m)).all(1) & open_texts
        out[full] = winner.reshape(texts, m)[full]
        open_texts &= ~full
        reach *= 2
    return out


def _points(seed, of, low, span, most, limit, m, active):
    """Points up to each text's limit, as (time, component slot, identity), in blocks."""
    time, made = np.zeros(len(active)), 0
    while len(active):
        following_all, later_all = [], []
        wide = int(min(64, max(1, _BLOCK // len(active))))
        for a in range(0, len(active), _BLOCK):
            at = active[a : a + _BLOCK]
            step = np.arange(made + 1, made + 1 + wide, dtype=np.uint64) * _GOLDEN
            h = B.mix(seed[at][:, None] + step)
            gap = -np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (span[at] * m)[:, None]
            gap[:, 0] += time[a : a + _BLOCK]
            x = np.cumsum(gap, 1)
            inside = x <= limit[of[at]][:, None]
            row, col = np.nonzero(inside)
            point = B.mix(h[row, col] ^ _GOLDEN)
            p = at[row]
            height = low[p] + span[p] * ((point & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
            counts = height < most[p]
            component = ((point >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            yield x[row, col][counts], (of[p] * m + component)[counts], point[counts]
            on = inside[:, -1]
            following_all.append(at[on])
            later_all.append(x[on, -1])
        active, time = np.concatenate(following_all), np.concatenate(later_all)
        made += wide


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(signature), bands)).copy()
    for k in range(rows):
        h = B.mix(h + parts[:, :, k])
    return h


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, of = B.words(data, offsets)
    return B.range_hashes(data, starts, ends, fold=True), of


def _sequence_hash(hashes: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's words in order."""
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets))
    mixed = B.mix(B.mix(hashes + np.uint64(seed)) + place.astype(np.uint64) * _GOLDEN)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    return B.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def signed(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(_id, _mark, text_id, check, n, bands) of (_id, _mark, text): word-sequence hashes, shingle count, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in B.chunks(batch, "text"):
                hashes, of = _word_hashes(data, offsets)
                s, t, n = counted(*shingles(hashes, of))
                total = np.bincount(t, n, len(part)).astype(np.int64)
                bands_of = band_hashes(bag_minhash(s, t, n, len(part), bands * per_band), bands, per_band)
                some = np.where(total > 0, bands, 0)
                lists = _lists(bands_of[total > 0].ravel(), np.append(0, np.cumsum(some)))
                ids = [pa.array(_sequence_hash(hashes, of, k).view(np.int64)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ids, pa.array(total), lists], names=["_id", "_mark", "text_id", "check", "n", "bands"])

    return rows.select("_id", "_mark", "text").mapInArrow(run, "_id long, _mark long, text_id long, check long, n long, bands array<long>")


def multisets(rows: DataFrame) -> DataFrame:
    """(text_id, n, items) of (text_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in B.chunks(batch, "text"):
                items, of = elements(*shingles(*_word_hashes(data, offsets)), len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(of)), _lists(items, of)], names=["text_id", "n", "items"])

    return rows.select("text_id", "text").mapInArrow(run, "text_id long, n long, items array<long>")


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) distinct with both multisets."""
    side = lambda k: sets.select(F.col("text_id").alias(k), F.col("items").alias(f"items_{k}"))
    return pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")


def _enough(similarity: float) -> Column:
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return shared * (1 + similarity) >= similarity * (F.size("items_a") + F.size("items_b")) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose multisets overlap enough."""
    return _common(pairs, sets).filter(_enough(similarity)).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pivots a with members b: whether they are linked, and how b differs from a.

    `gone` and `more` are bitmaps of what b lacks of a and has beyond it, `slack` how many
    items of the latter share a bit with another. For members x, y of one pivot p they bound
    the overlap from above: |p| - bits(gone_x | gone_y) + bits(more_x & more_y) + slack.
    """
    names = [f"{k}{w}" for k in ("gone", "more") for w in range(WORDS)]
    schema = ", ".join(["a long", "b long", "linked boolean", "pivot_n long", "slack long", *[f"{n} long" for n in names]])

    def bitmap(items: np.ndarray) -> np.ndarray:
        words = np.zeros(WORDS, np.uint64)
        np.bitwise_or.at(words, ((items >> np.uint64(6)) & np.uint64(WORDS - 1)).astype(np.int64), np.uint64(1) << (items & np.uint64(63)))
        return words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(np.asarray(c.offsets), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
            linked, numbers, bits = [], [], []
            for i in range(len(batch)):
                own, other = (v[o[i] : o[i + 1]] for o, v in sides)
                lost, won = own[~np.isin(own, other, assume_unique=True)], other[~np.isin(other, own, assume_unique=True)]
                linked.append((len(own) - len(lost)) * (1 + similarity) >= similarity * (len(own) + len(other)) - 1e-9)
                more = bitmap(won)
                numbers.append((len(own), len(won) - int(np.bitwise_count(more).sum())))
                bits.append(np.concatenate([bitmap(lost), more]))
            columns = [*np.array(numbers, np.int64).reshape(-1, 2).T, *np.array(bits, np.uint64).reshape(-1, 2 * WORDS).view(np.int64).T]
            arrays = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *[pa.array(np.ascontiguousarray(c)) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "linked", "pivot_n", "slack", *names])

    return _common(pairs, sets).select("a", "b", "items_a", "items_b").mapInArrow(run, schema)


def _near_in_size(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def components(links: DataFrame) -> DataFrame:
    """(text_id, component) of the linked texts."""
    return connected_components(links).withColumnRenamed("node", "text_id")


def text_classes(texts: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(text_id, component) of all distinct texts that are linked to another.

    `texts` has (text_id, n, bands, _id, _mark), the last two naming a row of `rows` with the text.
    """
    bucket = texts.select("text_id", "n", F.explode("bands").alias("bucket"))
    sizes = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    bucket = durable(bucket.join(sizes, "bucket"))
    if bucket.isEmpty():
        return texts.select("text_id", F.col("text_id").alias("component")).limit(0)
    # The member with the largest buckets is nearest to the middle of a group of copies.
    score = bucket.groupBy("text_id").agg(F.sum("members").alias("score"))
    best = F.max_by(F.col("text_id"), F.struct("score", F.xxhash64("text_id")))
    pivots = bucket.join(score, "text_id").groupBy("bucket").agg(best.alias("pivot"))
    bucket = durable(bucket.drop("members").join(pivots, "bucket"))
    meeting = bucket.select("text_id").distinct().join(texts, "text_id").select("text_id", "_id", "_mark")
    sets = durable(multisets(rows.join(meeting, ["_id", "_mark"])))
    # All members, also those of quite another size: how they differ from the pivot rules out most other pairs.
    first = bucket.filter(F.col("text_id") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("text_id").alias("b"))
    known = durable(compared(first, sets, similarity))
    links = known.filter("linked").select("a", "b")
    group = components(links)
    marked = bucket.join(group, "text_id", "left").withColumn("component", F.coalesce("component", "text_id"))
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    # A pivot has met all its bucket; of the others those in different components are left.
    loose = marked.join(mixed, "bucket").filter(F.col("text_id") != F.col("pivot"))
    facts = known.withColumnsRenamed({"a": "pivot", "b": "text_id"}).drop("linked")
    loose = durable(loose.join(facts, ["pivot", "text_id"], "left"))
    shares = loose.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    main = shares.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    outside = loose.join(main, "bucket").filter("component <> main")
    carried = ["text_id", "n", "component", "slack", *[f"{k}{w}" for k in ("gone", "more") for w in range(WORDS)]]
    left = outside.select("bucket", "main", "pivot_n", *[F.col(c).alias("x_" + c) for c in carried])
    right = loose.select("bucket", *[F.col(c).alias("y_" + c) for c in carried])
    # A pair of two outside members is met from both sides; one of them is enough.
    once = (F.col("y_component") == F.col("main")) | (F.col("x_text_id") < F.col("y_text_id"))
    bits = lambda k, op: sum((F.bit_count(getattr(F.col(f"x_{k}{w}"), op)(F.col(f"y_{k}{w}"))) for w in range(WORDS)), F.lit(0))
    most = F.col("pivot_n") - bits("gone", "bitwiseOR") + bits("more", "bitwiseAND") + F.least("x_slack", "y_slack")
    possible = F.coalesce(most * (1 + similarity) >= similarity * (F.col("x_n") + F.col("y_n")) - 1e-9, F.lit(True))
    near = _near_in_size(F.col("x_n"), F.col("y_n"), similarity)
    rest = left.join(right, "bucket").filter((F.col("x_component") != F.col("y_component")) & once & near & possible)
    more = durable(verified(rest.select(F.least("x_text_id", "y_text_id").alias("a"), F.greatest("x_text_id", "y_text_id").alias("b")), sets, similarity))
    if more.isEmpty():
        return group
    return components(links.unionByName(more))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("text"))


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, per_band: int = ROWS, similarity: float = SIMILARITY) -> DataFrame:
    """(_id, _mark, component, class_id), a row per row of `docs`; component is null for texts without words."""
    rows = _rows(docs, id_col, text_col)
    sketch = durable(signed(rows, bands, per_band))
    named = F.min(F.struct("_id", "_mark", "n", "bands"))
    texts = sketch.filter("n > 0").groupBy("text_id", "check").agg(named.alias("r")).select("text_id", "r.*")
    # A row stands for its text once, however often it is repeated in full.
    repeated = sketch.groupBy("_id", "_mark").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1)
    classes = text_classes(texts, rows if repeated.isEmpty() else rows.dropDuplicates(["_id", "_mark"]), similarity)
    placed = texts.select("text_id", "_id").join(classes, "text_id", "left").withColumn("component", F.coalesce("component", "text_id"))
    # A class with a null id only keeps it; otherwise the smallest id that is none counts.
    true_id = F.min(F.when(F.col("_id") != NO_ID, F.col("_id")))
    real = sketch.filter("n > 0").groupBy("text_id").agg(true_id.alias("least"))
    placed = placed.select("text_id", "component").distinct().join(real, "text_id")
    ids = placed.groupBy("component").agg(F.min("least").alias("class_id"))
    lookup = placed.select("text_id", "component").join(ids, "component")
    out = sketch.select("_id", "_mark", F.when(F.col("n") > 0, F.col("text_id")).alias("text_id")).join(lookup, "text_id", "left")
    own = F.when(F.col("_id") != NO_ID, F.col("_id"))
    return out.select("_id", "_mark", "component", F.when(F.col("component").isNull(), own).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row of `docs`; the class id is the smallest doc_id of the class."""
    return members(docs).select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), "class_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` less all but one of each class: the one of smallest id."""
    found = members(docs, id_col, text_col, **options)
    grouped = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("_id", "_mark")).alias("k"), F.count(F.lit(1)).alias("rows"))
    chosen = grouped.select("k.*", "component", "rows")
    loose = found.filter("component is null").select("_id", "_mark").distinct().select("_id", "_mark", F.lit(None).cast("long").alias("component"), F.lit(1).alias("rows"))
    keys = durable(chosen.unionByName(loose))
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # clear of all helper names
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    text = F.coalesce(F.col(own[text_col]), F.lit(""))
    rows = rows.withColumns({"_id": F.coalesce(F.col(own[id_col]).cast("long"), F.lit(NO_ID)), "_mark": F.xxhash64(text)})
    kept = rows.join(keys, ["_id", "_mark"])
    # Rows repeated in full all match; where that can be, one of them stays.
    doubled = found.groupBy("_id", "_mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    if not doubled.isEmpty():
        single = kept.filter("component is not null").dropDuplicates(["component"])
        kept = single.unionByName(kept.filter("component is null"))
    return kept.select(*[F.col(a).alias(c) for c, a in own.items()])
