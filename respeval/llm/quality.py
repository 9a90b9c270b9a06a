"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the words that lie inside n-grams which a
text holds twice or more; a text is judged by the share of its characters they cover, and
by the share inside lines that repeat an earlier line. Every text is measured whole, in
the task that read it; no data moves.

Null and empty texts have zero words and fail the base rule. Repeated rows are measured
row by row. Columns other than those asked for are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.llm.text import (
    NOT_NEWLINE,
    cuts,
    map_texts,
    mix,
    sequence_hashes,
    span_hashes,
    whole,
    word_bounds,
    word_table,
    CHUNK,
)

#: Largest share of word characters that n-grams of a length found twice or more may cover.
MAX_COVERED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside lines equal to an earlier line.
MAX_LINE_COVERED = 0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _covered(hashes: np.ndarray, starts: np.ndarray, salt: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a run of ``k`` words that their text holds twice or more."""
    n = len(hashes)
    runs = sequence_hashes(hashes, k)
    if not len(runs):
        return np.zeros(n, dtype=bool)
    inside = whole(starts, k)
    runs = runs ^ salt[: len(runs)]
    ordered = np.sort(runs[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n, dtype=bool)
    at = np.minimum(np.searchsorted(twice, runs), len(twice) - 1)
    steps = np.zeros(n + 1, dtype=np.int32)
    found = np.flatnonzero(inside & (twice[at] == runs))
    steps[found] += 1
    steps[found + k] -= 1
    return np.cumsum(steps[:-1]) > 0


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Non-empty lines: hashes, first and end byte, and their texts."""
    long_text = len(data) > 2 * CHUNK and len(offsets) == 2
    hashes, firsts, lasts = [], [], []
    for a, b in cuts(data, NOT_NEWLINE) if long_text else [(0, len(data))]:
        piece = data[a:b]
        s, e = word_bounds(piece, np.array([0, b - a]) if long_text else offsets, NOT_NEWLINE)
        hashes.append(span_hashes(piece, s, e))
        firsts.append(s + a)
        lasts.append(e + a)
    if not firsts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _measure(data: np.ndarray, offsets: np.ndarray, lengths: Sequence[int]) -> list[np.ndarray]:
    texts = np.arange(len(offsets) - 1)
    hashes, first, chars, starts = word_table(data, offsets, fold=False, chars=True)
    chars = np.zeros(0, np.int64) if chars is None else chars
    salt = mix(np.repeat(texts, np.diff(starts)).astype(np.uint64) + np.uint64(1))
    n_words, word_chars = np.diff(starts), _per_text(chars, starts)
    symbols = _per_text(_SYMBOLS[data], offsets)
    repeat_words = _per_text(_covered(hashes, starts, salt, 3), starts)

    line, begin, end = _lines(data, offsets)
    owner = np.searchsorted(offsets, begin, side="right") - 1
    with_word = np.searchsorted(first, begin) < np.searchsorted(first, end)
    line, begin, end, owner = (x[with_word] for x in (line, begin, end, owner))
    _, earliest = np.unique(line ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
    again = np.ones(len(line), dtype=bool)
    again[earliest] = False
    dup_lines = np.bincount(owner[again], minlength=len(texts))
    total = np.concatenate([[0], np.cumsum(chars)])
    inside = total[np.searchsorted(first, end[again])] - total[np.searchsorted(first, begin[again])]
    line_chars = np.bincount(owner[again], weights=inside, minlength=len(texts))

    most = np.maximum(word_chars, 1)
    shares = [
        _per_text(np.where(_covered(hashes, starts, salt, k), chars, 0), starts) / most
        for k in lengths
    ]
    counts = [n_words, word_chars, symbols, dup_lines, repeat_words]
    return [c.astype(np.int64) for c in counts] + [line_chars / most, *shares]


def quality_rules(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    max_covered: Mapping[int, float] = MAX_COVERED,
    max_line_covered: float = MAX_LINE_COVERED,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """``keep`` plus counts, coverage per n-gram length, and the verdict of every text."""
    lengths = sorted(max_covered)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["line_coverage", *[f"coverage_{k}" for k in lengths]]
    columns = [f"{c} long" for c in counts] + [f"{s} double" for s in shares]
    measured = map_texts(
        docs, keep, ", ".join(columns), lambda data, offsets: _measure(data, offsets, lengths)
    )
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    good = F.col("line_coverage") <= max_line_covered
    for k in lengths:
        good = good & (F.col(f"coverage_{k}") <= max_covered[k])
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
