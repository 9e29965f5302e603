"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

A text becomes words of lower-case letters and digits (bytes of UTF-8). A model gives the next byte
of a word, or its end, after the ORDER - 1 bytes before it, the border included, so words that
share a stem share its sequences. Each class counts its own sequences, less an absolute discount;
what the discount frees goes to the backoff, which both classes share: the Kneser-Ney estimate
of one order less over all labelled texts together, in which a sequence counts once for every
byte that comes before it, and so on down to single bytes. A rare expression so has nearly the
same probability in both classes. After bytes that a class has seen, a byte that it has not has the
backoff's share; after bytes that neither has seen, both give the same probability.

Every word of a text counts by its likelihood in both classes. A toxic text is taken to be a mixture,
as most of its words are those of any text: a word of it comes from the toxic model with the chance
SHARE, else from the plain one. A text's raw value is the difference of its two log-likelihoods for
each letter of it (some letters of no evidence added, which steadies short texts). The models are
counted on the labels of three folds; a logistic curve fitted on the fourth, which they have not
seen, turns raw values into scores.

Counting, the model and scoring are Spark tables keyed by the exact sequence or word, joined
at any size. The driver collects tables of fixed size only: sequences that begin words and words that
are common, with their exact values, which spare the joins their most frequent keys; a sieve by
hash that keeps sequences out of a join which can not match; and a histogram for the curve.

Cases: null and empty texts have raw value 0, and so the score of no evidence; repeated
rows are scored each; labels that are null, or of rows outside `documents`, are not used;
a row with several labels is toxic if any says so. Without training rows of both classes
every score is the share of toxic labels, or 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytewords as B
from tidemark.operators.lineage import dealt, durable

ORDER = 8
LOW = 3  # up to this order the shared backoff is a table of its own
DISCOUNT, SHARED_DISCOUNT = 3.0, 0.75  # of a class's counts, and of the counts of contexts that back them off
DUST = -1.0  # steps of log ratios up to this size would be left out: none are
SHARE = 0.01  # of a toxic text's words that are of the toxic model
SIEVE_BITS, PAGE_BITS = 26, 15
BEGINNINGS = 1 << 21  # sequences at the beginning of words that every task holds
COMMON, COMMON_BYTES = 1 << 18, 32  # words that every task holds, and the longest of them
PRIOR_LENGTH = 200  # letters of no evidence added to each text, so that a rare word in a short text does not decide
BINS = 40_000  # of the histogram that the curve is fitted on
UNIT = 1000.0  # letters that raw values are stated for
REACH = 200.0  # raw values beyond +-REACH share the last bin

_LETTER = np.full(256, 0x20, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _LETTER[_a:_b] = np.arange(_a, _b)


def letters(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    i = batch.schema.get_field_index(column)
    lower = pc.utf8_lower(pc.fill_null(batch.column(i), ""))
    return batch.set_column(i, column, lower)


def sequences(data: np.ndarray, offsets: np.ndarray, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the order - 1 before it (up to 8 in all), the latest lowest, and the offsets of the texts in them."""
    x = _LETTER[data]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = True
    of = np.zeros(len(offsets), np.int64)
    of[1:] = np.cumsum(B.per_text(keep, offsets))
    x = x[keep].astype(np.uint64)
    code = x.copy()
    place = np.arange(len(x)) - np.repeat(of[:-1], np.diff(of))
    for k in range(1, order):
        before = np.full(len(x), 32, np.uint64)
        before[k:] = x[:-k]
        before[place < k] = 32  # before its first byte a text has spaces
        code |= before << np.uint64(8 * k)
    return code, of


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat bytes of an array without nulls, and the offsets of its values in them."""
    words = words.cast(pa.large_binary())
    _, where, data = words.buffers()
    of = np.frombuffer(where, np.int64, len(words) + 1 + words.offset)[words.offset :] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[of[0] : of[-1]], of - of[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, which of them stands at each place, and the offsets of the texts in places."""
    x = _LETTER[data]
    starts, ends, of = B.spans(x != 32, offsets)
    found = _binary(x[x != 32], np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
    return found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False), of


def steps(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place of its word in `found`) of every letter of each word and of its end."""
    data, of = _bytes(found)
    code, within = sequences(np.insert(data, of[1:], 32), of + np.arange(len(of)), ORDER)
    return code.view(np.int64), np.repeat(np.arange(len(found)), np.diff(within))


def number_hashes(column: pa.Array) -> np.ndarray:
    return B.mix(column.to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(1))


def sieve(table: DataFrame, hashes: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """2 ** SIEVE_BITS bits, set at the hashes of the first column. Only pages of bits reach the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(hashes(b.column(0)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> PAGE_BITS).astype(np.int32)), pa.array((at & ((1 << PAGE_BITS) - 1)).astype(np.int32))], names=["page", "bit"])

    def pack(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PAGE_BITS, np.uint8)
        bits[rows.column("bit").to_numpy()] = 1
        return pa.table({"page": rows.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    pages = table.select(table.columns[0]).mapInArrow(place, "page int, bit int").groupBy("page").applyInArrow(pack, "page int, bits binary").toArrow()
    out = np.zeros((1 << (SIEVE_BITS - PAGE_BITS), 1 << (PAGE_BITS - 3)), np.uint8)
    for page, bits in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist(), strict=True):
        out[page] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - SIEVE_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def counts(labelled: DataFrame) -> DataFrame:
    """(g, plain, toxic): how often each sequence occurs in the words of the texts of either label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in B.chunks(letters(batch, "text"), "text"):
                found, at, of = words(data, offsets)
                toxic = np.repeat(rows.column("toxic").to_numpy(zero_copy_only=False) > 0, np.diff(of))
                n = [np.bincount(at, toxic == side, len(found)).astype(np.int64) for side in (False, True)]
                yield pa.RecordBatch.from_arrays([found, *map(pa.array, n)], names=["word", "plain", "toxic"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, of = steps(batch.column(0))
            g, at = np.unique(code, return_inverse=True)
            n = [np.bincount(at, batch.column(k).to_numpy()[of], len(g)).astype(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(g), *map(pa.array, n)], names=["g", "plain", "toxic"])

    total = [F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic")]
    parts = labelled.select("text", "toxic").mapInArrow(count, "word binary, plain long, toxic long").groupBy("word").agg(*total)
    return parts.mapInArrow(spell, "g long, plain long, toxic long").groupBy("g").agg(*total)


def _last(g: Column, k: int) -> Column:
    """The last k bytes of a sequence."""
    return g.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")) if k < 8 else g


def shared_backoff(grams: DataFrame, discount: float = SHARED_DISCOUNT, order: int = LOW) -> DataFrame:
    """(u, p): the shared probability of the last byte of each `order` bytes that occur, after those before it.

    By Kneser-Ney from single bytes upwards: of an order, a sequence counts once for each byte
    before it. A context has at most 256 sequences, so its window is small.
    """
    levels = {order + 1: grams.select(_last(F.col("g"), order + 1).alias("u")).distinct()}
    for k in range(order, 0, -1):
        levels[k] = levels[k + 1].groupBy(_last(F.col("u"), k).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    p = None
    for k in range(1, order + 1):
        context = Window.partitionBy(F.shiftrightunsigned("u", 8))
        rows = levels[k].withColumns({"total": F.sum("n").over(context), "kinds": F.count(F.lit(1)).over(context)})
        if p is None:
            rows = rows.withColumn("low", F.lit(1 / 256))
        else:
            rows = rows.withColumn("tail", _last(F.col("u"), k - 1)).join(p.select(F.col("u").alias("tail"), F.col("p").alias("low")), "tail")
        kept = F.greatest(F.col("n") - discount, F.lit(0.0)) + F.lit(discount) * F.col("kinds") * F.col("low")
        p = rows.select("u", (kept / F.col("total")).alias("p"))
    return p


def higher_orders(g: np.ndarray, plain: np.ndarray, toxic: np.ndarray, low: np.ndarray, discount: float, shared_discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of sequences that hold all those which share their bytes before the last, up to LOW of them; `low` is their shared p of order LOW.

    The second ratio is that of any byte which neither class has seen after the same ORDER - 1 bytes.
    """
    last = lambda u, k: u & np.uint64((1 << 8 * k) - 1)

    def within(of: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        at = np.unique(of, return_inverse=True)[1]
        return [np.bincount(at, v)[at] for v in values]

    levels, n = {ORDER: g}, {}
    for k in range(ORDER - 1, LOW, -1):
        levels[k], n[k] = np.unique(last(levels[k + 1], k), return_counts=True)
    p = low[np.unique(last(g, LOW + 1), return_index=True)[1]]
    for k in range(LOW + 1, ORDER):
        u = levels[k]
        if k > LOW + 1:
            p = p[np.searchsorted(levels[k - 1], last(u, k - 1))]
        total, kinds = within(u >> np.uint64(8), n[k], np.ones(len(u)))
        p = (np.maximum(n[k] - shared_discount, 0) + shared_discount * kinds * p) / total
    back = p[np.searchsorted(levels[ORDER - 1], last(g, ORDER - 1))]
    own, backed = [], []
    for c in (plain, toxic):
        total, freed = within(g >> np.uint64(8), c, np.minimum(c, discount))
        own.append(np.where(total > 0, (np.maximum(c - discount, 0) + freed * back) / np.maximum(total, 1), back))
        backed.append(np.where(total > 0, freed / np.maximum(total, 1), 1.0))
    return np.log(own[1] / own[0]), np.log(backed[1] / backed[0])


def log_ratios(grams: DataFrame, discount: float = DISCOUNT, shared_discount: float = SHARED_DISCOUNT, summands: bool = False) -> DataFrame:
    """(g, ratio): log of toxic over plain probability of the sequences (g, plain, toxic).

    As `summands`, a row whose last byte is 0, which no text has, holds the ratio of any byte that neither class has seen
    after the bytes before it, and the others hold what is to be added to that.

    Beyond the order LOW, the counts and contexts that a sequence needs have the LOW bytes before its last
    one in common, so sequences are dealt by these once and a task goes through them in order.
    """

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def judged() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            g, plain, toxic, low = (t.column(c).to_numpy() for c in ("g", "plain", "toxic", "low"))
            ratio, unseen = higher_orders(g.view(np.uint64), plain, toxic, low, discount, shared_discount)
            if summands:
                first = np.unique(g.view(np.uint64) >> np.uint64(8), return_index=True)[1]
                g, ratio = np.concatenate([g, g[first] & ~np.int64(255)]), np.concatenate([ratio - unseen, unseen[first]])
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(ratio)], names=["g", "ratio"])

        for batch in batches:
            if not len(batch):
                continue
            middle = batch.column("middle").to_numpy()
            cut = int(np.searchsorted(middle, middle[-1]))  # the last run may go on in the next batch
            if cut or held and held[-1].column("middle")[0].as_py() != middle[0]:
                held += [batch.slice(0, cut)] if cut else []
                yield judged()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield judged()

    low = shared_backoff(grams.select("g"), shared_discount).select(F.col("u").alias("tail"), F.col("p").alias("low"))
    middle = _last(F.shiftrightunsigned("g", 8), LOW)
    rows = grams.withColumn("tail", _last(F.col("g"), LOW)).join(low, "tail").select("g", "plain", "toxic", "low", middle.alias("middle"))
    return dealt(rows, ["middle"]).mapInArrow(ratios, "g long, ratio double")


def known_steps(model: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first sequences of the model in order, which are those with most spaces and so begin words; their ratios; a sieve of all.

    Sequences are at least 0 where no text begins with bytes above 127; the others are left to the join.
    """
    rows = model.filter("g >= 0").orderBy("g").limit(BEGINNINGS).select("g", "ratio").toArrow()
    return rows.column("g").to_numpy(), rows.column("ratio").to_numpy(), sieve(model, number_hashes)


def look_up(found: pa.Array, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By word the sum of what `known` holds and how many summands; the other sequences which the model may have, and the places of their words."""
    first, ratio, bits = known
    code, of = steps(found)
    code, of = np.concatenate([code, code & ~np.int64(255)]), np.concatenate([of, of])
    held = (code >= 0) & (code <= first[-1]) if len(first) else np.zeros(len(code), bool)
    far = np.flatnonzero(~held)
    far = far[passes(bits, number_hashes(pa.array(code[far])))]
    at = np.searchsorted(first, code[held])
    hit = first[at] == code[held]
    whose = of[held][hit]
    return np.bincount(whose, ratio[at[hit]], len(found)).astype(float), np.bincount(whose, minlength=len(found)), code[far], of[far]


def marked_words(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(word, ratio) of the words of all texts of which the model says anything; any other is as likely in both classes."""
    sent = docs.sparkSession.sparkContext.broadcast(known_steps(model))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in B.chunks(letters(batch, "text"), "text"):
                yield pa.RecordBatch.from_arrays([words(data, offsets)[0]], names=["word"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, n, code, of = look_up(batch.column(0), sent.value)
            own = np.flatnonzero(n)
            # A row for what is known here, and one for each sequence to be joined.
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.concatenate([own, of]))), pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(code)]),
                    pa.concat_arrays([pa.array(near[own]), pa.nulls(len(of), pa.float64())]),
                ],
                names=["word", "g", "near"],
            )

    spelled = docs.select("text").mapInArrow(find, "word binary").distinct().mapInArrow(spell, "word binary, g long, near double").join(model, "g", "left")
    return spelled.groupBy("word").agg(F.sum(F.coalesce("near", "ratio")).alias("ratio")).filter("ratio is not null")


def common_words(docs: DataFrame, most: int) -> DataFrame:
    """(text): at most `most` of the words that are common in the texts, by how often they come again within a megabyte of texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in B.chunks(letters(batch, "text"), "text"):
                found, at, _ = words(data, offsets)
                n = np.bincount(at, minlength=len(found))
                use = pa.array((n > 1) & (np.diff(_bytes(found)[1]) <= COMMON_BYTES))
                yield pa.RecordBatch.from_arrays([found.filter(use), pa.array(n).filter(use)], names=["word", "times"])

    counted = docs.select("text").mapInArrow(find, "word binary, times long").groupBy("word").agg(F.sum("times").alias("times"))
    rows = durable(counted.withColumn("level", F.floor(F.log2("times") * 8)))
    least, n = None, 0
    for r in sorted(rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # a level is taken whole or not at all
        n += r.n
        if n > most:
            break
        least = r.level
    return rows.filter(F.lit(False) if least is None else F.col("level") >= least).select(F.col("word").cast("string").alias("text"))


def evidence(ratio: np.ndarray) -> np.ndarray:
    """Log of a word's likelihood in a toxic text over that in a plain one, by the log ratio of the two models."""
    return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + ratio)


def with_raw(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(key, raw) for each row of `docs`, which is (key, text).

    Words that are common or whose every step is known are added up where they are, the steps of others joined.
    """
    marked = marked_words(common_words(docs, COMMON), model).toArrow()
    table = marked.column("word").combine_chunks(), np.append(evidence(marked.column("ratio").to_numpy()), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast((table, known_steps(model)))
    key_type = docs.schema["key"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (held, value), known = sent.value
        for batch in batches:
            for rows, data, offsets in B.chunks(letters(batch, "text"), "text"):
                found, at, of = words(data, offsets)
                n = np.diff(of)
                owner = np.repeat(np.arange(len(n)), n)
                length = np.bincount(owner, np.diff(_bytes(found)[1])[at] + 1, len(n)).astype(np.int64)
                place = pc.fill_null(pc.index_in(found, value_set=held), -1).to_numpy()
                worth = value[place]
                rare = np.flatnonzero(place < 0)
                ratio, _, code, whose = look_up(found.take(pa.array(rare)), known)
                joined = np.bincount(whose, minlength=len(rare))
                worth[rare] = np.where(joined > 0, 0.0, evidence(ratio))
                total = np.bincount(owner, worth[at], len(n)).astype(float)
                # The rare words with steps to be joined: a row for each text that has one, and each step.
                steps_of = np.zeros(len(found), np.int64)
                steps_of[rare] = joined
                use = steps_of[at] > 0
                pair, times = np.unique(owner[use] * (len(found) + 1) + at[use], return_counts=True)
                text, word = np.divmod(pair, len(found) + 1)
                many = steps_of[word]
                order = np.argsort(whose, kind="stable")
                begins = np.zeros(len(found), np.int64)
                begins[rare] = np.cumsum(joined) - joined
                step = np.repeat(begins[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                base = np.zeros(len(found))
                base[rare] = ratio
                spread = lambda x: np.repeat(x, many)

                def once(x: np.ndarray) -> np.ndarray:  # what the first step of a word bears, and 0 for its others
                    out = np.zeros(len(step), x.dtype)
                    out[np.cumsum(many) - many] = x
                    return out

                row = rows.column("row")
                # A row of its own keeps each text; its step is one that no text has (last byte 1) and that spreads.
                own = (row.to_numpy() << 8 | 1).astype(np.int64)
                none = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([row, row.take(pa.array(spread(text)))]), pa.concat_arrays([rows.column("key"), pa.nulls(len(step), rows.column("key").type)]),
                        pa.array(np.concatenate([np.full(none, -1), spread(word)])), pa.array(np.concatenate([np.zeros(none, np.int64), once(times)])),
                        pa.array(np.concatenate([own, code[order][step]])), pa.array(np.concatenate([total, once(base[word])])),
                        pa.array(np.concatenate([length, np.zeros(len(step), np.int64)])),
                    ],
                    names=["row", "key", "word", "n", "g", "near", "length"],
                )

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "key", "text")
    found = numbered.mapInArrow(find, f"row long, key {key_type}, word long, n long, g long, near double, length long").join(model, "g", "left")
    ratio = F.sum(F.col("near") + F.coalesce("ratio", F.lit(0.0)))
    per_word = found.groupBy("row", "word").agg(F.max("key").alias("key"), F.max("length").alias("length"), F.sum("n").alias("n"), ratio.alias("ratio"))
    mixed = F.when(F.col("ratio") > 30, F.col("ratio") + float(np.log(SHARE))).otherwise(F.log1p(SHARE * F.expm1("ratio")))
    worth = F.when(F.col("word") < 0, F.col("ratio")).otherwise(mixed * F.col("n"))
    per_row = per_word.groupBy("row").agg(F.max("key").alias("key"), F.max("length").alias("length"), F.sum(worth).alias("total"))
    return per_row.select("key", (F.col("total") * UNIT / (F.col("length") + PRIOR_LENGTH)).alias("raw"))


def fit_curve(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps with a little ridge on the slope."""
    share = float((toxic * n).sum() / n.sum()) if n.sum() else 0.0
    if share in (0.0, 1.0):
        return 0.0, 40.0 if share else -40.0
    w = np.array([0.0, np.log(share / (1 - share))])
    a = np.column_stack([x, np.ones_like(x)])
    ridge = np.diag([1e-4, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge, a.T @ (n * (toxic - p)) - ridge @ w)
        w += step * min(1.0, 20.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == 0


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, inner) of the labels that may be learnt from; `inner` ones are for the curve, the others for the models."""
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return labels.filter(usable).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).withColumn("inner", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def learn(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(g, ratio) of the steps, from all labelled rows outside the held-out fold and the curve's."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    known = marks(labels).filter("not inner").drop("inner")
    sent = docs.sparkSession.sparkContext.broadcast(sieve(known, number_hashes))

    def may_have(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(sent.value, number_hashes(batch.column(0)))))

    # Hashed on the labels' side at every size: texts that have a label are shuffled once and never sorted.
    labelled = texts.mapInArrow(may_have, "doc_id long, text string").join(known.hint("shuffle_hash"), "doc_id")
    return durable(log_ratios(durable(counts(labelled)), summands=True))


def curve(raw: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Slope and offset fitted on the labelled rows of (doc_id, raw) that the models have not seen; the driver gets a histogram.

    If these are not of both classes, all labelled rows are taken.
    """
    clipped = F.greatest(F.least(F.col("raw"), F.lit(REACH)), F.lit(-REACH))
    bin_of = F.floor((clipped + REACH) * (BINS / (2 * REACH)))
    table = raw.join(marks(labels), "doc_id").groupBy("inner", bin_of.alias("bin"), (F.col("toxic") > 0).alias("toxic"))
    rows = table.agg(F.count(F.lit(1)).alias("n"), F.avg(clipped).alias("x")).toArrow()
    column = lambda c: rows.column(c).to_numpy().astype(float)
    inner, toxic = column("inner") > 0, column("toxic")
    use = inner if len(set(toxic[inner])) == 2 else np.ones(len(inner), bool)
    return fit_curve(column("x")[use], toxic[use], column("n")[use])


def chance(raw: Column, slope: float, offset: float) -> Column:
    z = F.greatest(F.least(raw, F.lit(REACH)), F.lit(-REACH)) * slope + offset
    return 1 / (1 + F.exp(-z))


def _raw(docs: DataFrame, labels: DataFrame, key: Column) -> DataFrame:
    """(doc_id, key, raw) for every row of `docs`."""
    model = learn(docs, labels)
    both = F.struct(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    found = with_raw(docs.select(both.alias("key"), "text"), model)
    return durable(found.select("key.doc_id", "key.key", "raw"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`."""
    raw = _raw(docs, labels, F.lit(0))
    score = chance(F.col("raw"), *curve(raw, labels))
    out = raw.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below the threshold, with their own columns."""
    text_key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    raw = _raw(docs, labels, text_key)
    toxic = raw.filter(chance(F.col("raw"), *curve(raw, labels)) >= threshold)
    name = "_key" + "_" * max(map(len, docs.columns))  # longer than any column, so never one of them
    # Equal texts score alike, so the digest stands for the row.
    gone = toxic.select(F.col("key").alias(name)).distinct().hint("shuffle_hash")
    return docs.withColumn(name, text_key).join(gone, name, "left_anti").select(*[docs[c] for c in docs.columns])
