"""Quality rules by compression: texts that zstandard shrinks too well or hardly at all go.

Two ratios (bytes before over bytes after) are taken: of the whole text, and of each fixed
chunk of it. A text is kept if both lie within the limits of its length band. Repetition
over long distances shows in the whole, a repetitive or a random passage inside a long text
in its worst chunks; the rest after the last whole chunk is a chunk too.

Ratios grow with length, so limits are set for each half octave of it. They are fitted on all
texts labelled good (outside the held-out fold) that pass the base rules: the mean ratio of the
band plus `MOST` or less `LEAST` standard deviations, for chunks one more. Spark averages, the
driver gets a row per band. A band with fewer than `ENOUGH` such texts, or all if there are no
labels, has the wide limits of `BANDS`, in which a rest keeps to the limits of its own length.

Cases: a null or empty text has no word and fails the base rules; texts are taken whole;
rows repeat as they come; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewords as B
from tidemark.operators.lineage import durable


class Band(NamedTuple):
    """Limits of texts of up to `upto` bytes (None: any length): whole ratio and chunk ratios."""

    upto: int | None
    least: float
    most: float
    chunk_least: float
    chunk_most: float


#: Least and most ratio by length. Prose lies well inside (1.4 to 3 over these lengths), base64
#: and noise fall below, a passage written again and again lies above.
BANDS = (
    Band(512, 1.15, 3.0, 1.15, 3.0),
    Band(2048, 1.30, 3.5, 1.30, 3.5),
    Band(8192, 1.45, 4.0, 1.35, 4.0),
    Band(65536, 1.50, 4.5, 1.35, 4.0),
    Band(None, 1.50, 5.5, 1.35, 4.5),
)
#: A text of n bytes is in band floor(STEPS * log2(n)).
STEPS, ENOUGH = 2, 20
MOST, LEAST = 3.5, 6.0
CHUNK = 4096
LEAST_REST = 512  # a shorter rest belongs to the chunk before it
LEVEL = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_min double, chunk_max double, n_bytes long"
)
Limits = dict[int, tuple[float, float, float, float]]


def repeated_words(hashes: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each text that stand in a window of `size` words found at least twice in that text."""
    window, whole = B.windows(hashes, offsets, size)
    at = np.flatnonzero(whole)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = window[at] ^ B.mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + size, bool)
    for k in range(size):
        covered[at[twice] + k] = True
    return B.per_text(covered[: len(hashes)], offsets)


def repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    newline = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], newline + 1])
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, newline, "right") - 1])
    order = np.lexsort((np.arange(len(starts)), starts, text))
    starts, text = starts[order], text[order]
    # A line ends before the next line of its text, or with the text.
    ends = np.where(np.append(text[1:] == text[:-1], False), np.append(starts[1:], 0) - 1, offsets[text + 1])
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~B.SPACE[data], out=filled[1:])
    with_word = filled[ends] > filled[starts]
    starts, ends, text = starts[with_word], ends[with_word], text[with_word]
    distinct = np.zeros(len(offsets) - 1, np.int64)
    key = B.range_hashes(data, starts, ends, fold=False) ^ B.mix(text.astype(np.uint64) + np.uint64(1))
    at = np.unique(key, return_index=True)[1]
    np.add.at(distinct, text[at], 1)
    return np.bincount(text, minlength=len(offsets) - 1) - distinct


def ratios(data: np.ndarray, offsets: np.ndarray, chunk: int, level: int) -> np.ndarray:
    """Rows (whole, least chunk, largest chunk, rest) of each text; 1 for an empty one.

    Chunks are `chunk` bytes long; a rest under LEAST_REST belongs to the chunk before it, a longer
    one is a chunk of its own (no number where there is none). A text of one chunk is that chunk.
    """
    press = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    view = memoryview(np.ascontiguousarray(data)).cast("B") if len(data) else memoryview(b"")
    out = np.ones((len(offsets) - 1, 4))
    out[:, 3] = np.nan
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        out[i, :3] = (b - a) / len(press.compress(view[a:b]))
        n, rest = divmod(b - a, chunk)
        own = n > 0 and rest >= LEAST_REST
        if n > 1 or own:
            cuts = [a + k * chunk for k in range(n)] + [b - rest if own else b]
            parts = [(y - x) / len(press.compress(view[x:y])) for x, y in zip(cuts, cuts[1:], strict=False)]
            out[i, 1:3] = min(parts), max(parts)
        if own:
            out[i, 3] = rest / len(press.compress(view[b - rest : b]))
    return out


def within(length: np.ndarray, ratio: np.ndarray, bands: Sequence[Band], chunk: int = CHUNK) -> np.ndarray:
    """Whether the ratios lie inside the limits of the text's length, and a rest's inside those of its own."""
    edges = np.array([b.upto for b in bands if b.upto is not None])
    limits = np.array([b[1:] for b in bands])
    limit = limits[np.searchsorted(edges, length, "left")]
    whole = (ratio[:, 0] >= limit[:, 0]) & (ratio[:, 0] <= limit[:, 1])
    limit_of_rest = limits[np.searchsorted(edges, length % chunk, "left")]
    rest = np.isnan(ratio[:, 3]) | (ratio[:, 3] >= limit_of_rest[:, 2]) & (ratio[:, 3] <= limit_of_rest[:, 3])
    return whole & (ratio[:, 1] >= limit[:, 2]) & (ratio[:, 2] <= limit[:, 3]) & rest


def fit_limits(scored: DataFrame, labels: DataFrame, most: float = MOST, least: float = LEAST) -> Limits:
    """Limits by band from the rows of `compression_bands` labelled as good outside the held-out fold; all of them are used."""
    usable = (F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter(usable).select("doc_id")
    stats = [f(c).alias(f"{n}_{c}") for c in ("ratio", "chunk_min", "chunk_max") for f, n in ((F.avg, "m"), (F.stddev_pop, "d"))]
    passed = scored.filter("not base_failed").select("doc_id", "ratio", "chunk_min", "chunk_max", band_of("n_bytes").alias("band"))
    rows = passed.join(good, "doc_id").groupBy("band").agg(F.count(F.lit(1)).alias("n"), *stats).filter(F.col("n") >= ENOUGH).collect()
    return {
        r.band: (r.m_ratio - least * r.d_ratio, r.m_ratio + most * r.d_ratio, r.m_chunk_min - (least + 1) * r.d_chunk_min, r.m_chunk_max + (most + 1) * r.d_chunk_max)
        for r in rows
    }


def band_of(n_bytes: str) -> Column:
    return F.floor(STEPS * F.log2(n_bytes)).cast("long")


def with_limits(scored: DataFrame, limits: Limits) -> DataFrame:
    """The rows of `compression_bands` with the verdict of the fitted limits (whole, whole, chunk, chunk), where the text's band has some."""
    if not limits:
        return scored
    names = ("_a", "_b", "_c", "_d")
    table = scored.sparkSession.createDataFrame([(k, *four) for k, four in limits.items()], "_band long, " + ", ".join(f"{n} double" for n in names))
    inside = F.col("ratio").between(F.col("_a"), F.col("_b")) & (F.col("chunk_min") >= F.col("_c")) & (F.col("chunk_max") <= F.col("_d"))
    judged = scored.withColumn("_band", band_of("n_bytes")).join(table, "_band", "left")
    return judged.withColumn("kept", F.when(F.col("_a").isNull(), F.col("kept")).otherwise(~F.col("base_failed") & inside)).select(*scored.columns)


def compression_bands(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Sequence[Band] = BANDS, chunk: int = CHUNK, level: int = LEVEL,
    least_words: int = 50, most_repeated: float = 0.5,
) -> DataFrame:
    """One row per row of `docs`: base counts, ratios and the verdict. A single pass without a shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in B.chunks(batch, "text"):
                starts, ends, of = B.words(data, offsets)
                n_words = np.diff(of)
                again = repeated_words(B.range_hashes(data, starts, ends, fold=False), of)
                failed = (n_words < least_words) | (again > most_repeated * n_words)
                ratio = ratios(data, offsets, chunk, level)
                kept = ~failed & within(np.diff(offsets), ratio, bands, chunk)
                chars = B.per_text(~B.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
                symbols = B.per_text(_SYMBOL[data], offsets)
                columns = [n_words, chars, symbols, repeated_lines(data, offsets), again, failed, kept, ratio[:, 0], np.fmin(ratio[:, 1], ratio[:, 3]), np.fmax(ratio[:, 2], ratio[:, 3]), np.diff(offsets)]
                yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, columns)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(score, SCHEMA)


def quality_bands(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ratios and verdict of every row of `docs`, within limits fitted on the labelled ones. Texts are compressed once and never shuffled."""
    scored = durable(compression_bands(docs))
    return with_limits(scored, fit_limits(scored, labels))
