"""Numpy helpers that tasks use on Arrow batches of whole texts.

Texts are UTF-8 bytes. A word is a run of bytes other than the six ASCII blanks, so words
are the same as those of the pattern ``[^\\x20\\x09-\\x0D]+``. Word hashes are 64-bit and
well mixed; equal words have equal hashes on every machine. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are hashed at once. A longer text is cut at blanks, so that memory
#: follows this bound (or the longest single word), whatever the length of a text.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD = ~_BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[0x0A] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, name: str = "base") -> np.ndarray:
    """Powers 0..n-1 of an odd base modulo 2**64, or of its inverse."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        base = _BASE if name == "base" else pow(_BASE, -1, 1 << 64)
        size = max(n, CHUNK + 1)
        known = np.empty(size, dtype=np.uint64)
        known[0], filled = 1, 1
        while filled < size:
            more = min(filled, size - filled)
            step = np.uint64(pow(base, filled, 1 << 64))
            known[filled : filled + more] = known[:more] * step
            filled += more
        if size <= CHUNK + 1:
            _powers[name] = known
    return known[:n]


def byte_ranges(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, bytes, offsets in them.

    A single longer text makes a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _WORD):
    """Starts and ends of all words; texts that touch do not share a word."""
    inside = table[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = inside[firsts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = inside[lasts]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hash_spans(data, starts, ends, fold):
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    letters = (_LOWER[data] if fold else data).astype(np.uint64) + np.uint64(1)
    np.cumsum(letters * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, "inverse")[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False):
    """A hash of each span of bytes."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return _hash_spans(data, starts, ends, fold)


def word_table(
    data: np.ndarray,
    offsets: np.ndarray,
    fold: bool = True,
    table: np.ndarray = _WORD,
    chars: bool = False,
):
    """All words in order: hashes, first bytes, code points (or None), and where each
    text's words begin among them.

    ``fold`` lower-cases A-Z.
    """
    long_text = len(data) > 2 * CHUNK and len(offsets) == 2
    pieces = cuts(data, table) if long_text else [(0, len(data))]
    hashes, firsts, lengths = [], [], []
    for a, b in pieces:
        piece = data[a:b]
        starts, ends = word_bounds(piece, np.array([0, b - a]) if long_text else offsets, table)
        hashes.append(span_hashes(piece, starts, ends, fold))
        firsts.append(starts + a)
        if chars:
            points = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
            lengths.append(points[ends] - points[starts])
    first = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    return (
        np.concatenate(hashes) if hashes else np.empty(0, np.uint64),
        first,
        np.concatenate(lengths) if lengths else None,
        np.searchsorted(first, offsets),
    )


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, letters_only: bool = False):
    """Hashes of all words, and where each text's words begin among them.

    ``letters_only`` ends words at ASCII punctuation too.
    """
    hashes, _, _, starts = word_table(data, offsets, fold, _ALNUM if letters_only else _WORD)
    return hashes, starts


def cuts(data: np.ndarray, table: np.ndarray = _WORD, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Pieces of one long text of about ``limit`` bytes that split no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        while end < n and table[data[end]] and table[data[end - 1]]:
            further = np.flatnonzero(~table[data[end : end + limit]])
            end = end + int(further[0]) if len(further) else min(end + limit, n)
        yield at, end
        at = end


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words, runs over text borders included."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    n = len(words) - k + 1
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)


def whole(starts: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs made by ``sequence_hashes`` lie inside one text."""
    n = max(int(starts[-1]) - k + 1, 0)
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    return np.arange(n) + k <= ends


def shingle_sets(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct ``k``-word shingles in ascending order, and their offsets.

    A text with fewer words has its whole sequence as one shingle; without words, none.
    """
    runs = sequence_hashes(words, k)
    sets, sizes = [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            found = np.unique(runs[a : b - k + 1])
        elif b > a:
            found = sequence_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            found = runs[:0]
        sets.append(found)
        sizes.append(len(found))
    joined = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list column from joined values and their offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def map_texts(
    docs: DataFrame,
    keep: Sequence[str],
    columns: str,
    kernel: Callable[[np.ndarray, np.ndarray], Sequence],
    text: str = "text",
) -> DataFrame:
    """``keep`` plus new ``columns`` that ``kernel`` makes from the bytes of whole texts.

    The kernel gets the joined bytes of some texts and their offsets, and returns one
    array per column, or None to leave the rows out. A leading boolean array, where there
    is one more array than columns, says which rows stay.
    """
    keep = list(keep)
    added = StructType.fromDDL(columns) if columns else StructType()
    schema = StructType([docs.schema[k] for k in keep] + added.fields)
    source = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_mapped_text_"))
    names, wanted = schema.names, len(added.fields)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            kept = batch.select(keep) if keep else None
            for first, end, data, offsets in byte_ranges(texts):
                made = kernel(data, offsets)
                if made is None:
                    continue
                arrays = [c.slice(first, end - first) for c in kept.columns] if keep else []
                stay = made[0] if len(made) > wanted else None
                arrays += [pa.array(x) for x in (made if stay is None else made[1:])]
                if stay is not None:
                    mask = pa.array(stay)
                    arrays = [x.filter(mask) for x in arrays]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)
