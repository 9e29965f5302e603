"""Packing tokenised documents into sequences, hierarchically over several context sizes.

Sizes halve from the window (2048) down. A document's whole windows become sequences of
their own; what is left goes to the tier of the smallest size it fits. Tiers are packed
from the longest: a window starts with its tier's longest rest, its gap is filled with the
longest rests of shorter tiers that fit, and what then remains is filled by cutting one
rest. So every sequence is full, and only the very last tokens of a task are written as
shorter full windows (powers of two). Sequences are numbered so that equal numbers of
tokens share a step group: `group` counts `group_tokens` tokens of one size.

Packing needs no shuffle: each task tokenises its own rows as a stream and packs them in
rounds of `round_tokens`, which bounds its memory together with the longest single text.
Ids carry the task's number, so they are unique without coordination. A lost task is run
again on the same rows and gives the same sequences.

Cases: a null or empty text is the end token alone; each row is a document of its own, also
if its id is null or repeated; an empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewords as B

WINDOW = 2048
END = 1
SMALLEST_TIER = 256
ROUND_TOKENS = 4_000_000
GROUP_TOKENS = 8 * WINDOW
CACHED_PIECES = 1_000_000
TOKENIZER = "word_bpe_49k.json"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, group long"
)


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_TAIL = np.zeros(256, bool)  # ASCII punctuation but the apostrophe, which may begin a token
_TAIL[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class WordTokenizer:
    """Ids of whole texts for a byte-level BPE that never joins over white space and folds case.

    Texts are cut at ASCII white space and before closing punctuation, where this tokenizer
    cuts too; each distinct piece is tokenised once and looked up from then on. The table is
    emptied when it holds `cached` pieces.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, _visible_bytes()
        self.cached, self.known = cached, {}

    def _one(self, piece: str) -> bytes:
        if piece.isalpha() and piece == piece.lower() and unicodedata.is_normalized("NFC", piece):
            # One run of letters that normalising leaves alone: the merges apply to it directly.
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        known, out = self.known, []
        if len(known) > self.cached:
            known.clear()
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self._one(p)
            out.append(ids)
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts in them) of texts as bytes with offsets."""
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts, ends, _ = B.words(data, offsets)
        edge[starts] = edge[ends] = True
        if b"<|" not in data.tobytes():  # else a special token may occur, whole and with its case
            tail = _TAIL[data]
            cut = np.maximum.accumulate(np.where(tail, -1, np.arange(len(data), dtype=np.int64)))[ends - 1] + 1 if len(ends) else ends
            inside = (cut > starts) & (cut < ends)
            cut = cut[inside]
            before, lead = data[cut - 1], data[np.maximum(cut - 2, 0)]
            # After an ASCII letter or digit, or one of U+00C0 to U+00FF that is a letter.
            edge[cut[_ALNUM[before] | ((lead == 0xC3) & (before != 0x97) & (before != 0xB7))]] = True
            data = _FOLD[data]
        bounds = np.flatnonzero(edge)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        ids = self._ids_of(coded.dictionary.cast(pa.large_string()).to_pylist())
        flat = np.frombuffer(b"".join(ids), np.uint32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[code]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        at = np.arange(upto[-1]) + np.repeat(begins[code] - upto[:-1], n)
        return flat[at], upto[np.searchsorted(bounds, offsets)]


class Packer:
    """Packs the rests of one round; pieces are (document, start, length)."""

    def __init__(self, window: int, smallest: int) -> None:
        self.tiers = [window]
        while self.tiers[-1] // 2 >= smallest:
            self.tiers.append(self.tiers[-1] // 2)

    def pack(self, rests: list[tuple[int, int, int]], last: bool) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
        """([(size, pieces)], rests left). The rests left hold fewer tokens than a window, and none if `last`."""
        sizes = [n for _, _, n in rests]
        order = sorted(range(len(rests)), key=lambda i: (sizes[i], rests[i]))
        pool = [rests[i] for i in order]
        keys = [p[2] for p in pool]
        total = sum(keys)
        done = []
        while pool:
            longest = keys[-1]
            size = next((t for t in reversed(self.tiers) if t >= longest), self.tiers[0])
            if total < size:
                if not last and total < self.tiers[0]:
                    break
                size = next((t for t in self.tiers if t <= total), None) or 1 << (total.bit_length() - 1)
            pieces, gap = [], size
            while gap:
                # The longest rest that fits whole; else the shortest that does not is cut.
                k = bisect.bisect_right(keys, gap) - 1
                if k >= 0:
                    piece = pool.pop(k)
                    keys.pop(k)
                else:
                    d, start, n = pool.pop(0)
                    keys.pop(0)
                    piece = (d, start, gap)
                    rest = (d, start + gap, n - gap)
                    at = bisect.bisect_left(keys, rest[2])
                    pool.insert(at, rest)
                    keys.insert(at, rest[2])
                pieces.append(piece)
                gap -= piece[2]
            total -= size
            done.append((size, pieces))
        return done, pool


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, smallest: int = SMALLEST_TIER,
    round_tokens: int = ROUND_TOKENS, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece; `tokenizer` is a path that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = WordTokenizer(tokenizer), Packer(window, smallest)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 36
        made = 0
        steps: dict[int, list[int]] = {}  # size -> [tokens in the open group, its number]
        groups = 0
        # Document -> (id, the ids that are not yet packed, how many went before them, all its tokens).
        held: dict[int, tuple[int | None, np.ndarray, int, int]] = {}
        fresh: list[tuple[int, int, int]] = []
        rows: list[tuple] = []
        number = waiting = 0

        def emit(size: int, pieces: list[tuple[int, int, int]]) -> None:
            nonlocal made, groups
            step = steps.get(size)
            if step is None or step[0] + size > group_tokens:
                step = steps[size] = [0, groups]
                groups += 1
            step[0] += size
            offset = 0
            for d, start, n in pieces:
                doc_id, ids, gone, total = held[d]
                crc = zlib.crc32(ids[start - gone : start - gone + n])
                rows.append((doc_id, start, n, crc, total, first + made, offset, size, first + step[1]))
                offset += n
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return batch

        for batch in batches:
            for part, *texts in B.chunks(batch, "text"):
                ids, offsets = encode(*texts)
                for doc_id, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    held[number] = (doc_id, own, 0, len(own))
                    whole = len(own) // window * window
                    for start in range(0, whole, window):
                        emit(window, [(number, start, window)])
                    if len(own) > whole:
                        held[number] = (doc_id, own[whole:].copy(), whole, len(own))
                        fresh.append((number, whole, len(own) - whole))
                        waiting += len(own) - whole
                    else:
                        del held[number]
                    number += 1
                    if waiting >= round_tokens:
                        done, fresh = packer.pack(fresh, last=False)
                        for size, pieces in done:
                            emit(size, pieces)
                        held = {d: held[d] for d, _, _ in fresh}
                        waiting = sum(n for _, _, n in fresh)
                if len(rows) > 50_000:
                    yield flush()
        for size, pieces in packer.pack(fresh, last=True)[0]:
            emit(size, pieces)
        yield flush()

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def packing(docs: DataFrame) -> DataFrame:
    """The pieces of every row of `docs` with the public word tokenizer."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))
