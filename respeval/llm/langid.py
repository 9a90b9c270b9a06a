"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, most frequent first.
A text's own most frequent n-grams are compared with every profile; the distance is the
sum of how far each n-gram is out of place, and the nearest profile names the language.

Profiles are counted on a sample of the labelled texts whose expected size is
``sample_rows``; all of the sample's text counts, summed per task before the shuffle. Texts
are compared whole. Null texts and texts without a letter are ``und`` with score 0, as is
every text when there is nothing to learn from. Ties go to the n-gram with the smaller
code, and to the language whose name sorts first. Rows with null lang are not learned from.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respeval.llm.tables import text_or_empty, uniform
from respeval.llm.text import map_texts

SAMPLE_ROWS = 20_000
PROFILE = 300
LONGEST = 3
UNKNOWN = "und"
_PIECE = 1 << 18
_PENDING = 1 << 21


def _letters(text: str) -> np.ndarray:
    """Code points in lower case, with each run of other characters as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    distinct, at = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in distinct.tolist()], dtype=bool)[at]
    points = np.where(letter, points, 32)
    stay = letter.copy()
    stay[1:] |= letter[:-1]
    points = points[stay]
    return np.concatenate([[32], points, [32]]).astype(np.uint64) if letter.any() else points[:0]


def _grams(points: np.ndarray, longest: int) -> np.ndarray:
    """Codes of all n-grams that hold a letter: 21 bits for each code point."""
    parts, code = [points[points != 32]], points
    for n in range(2, longest + 1):
        if len(points) < n:
            break
        code = (code[:-1] << np.uint64(21)) | points[n - 1 :]
        parts.append(code)
    return np.concatenate(parts)


def gram_counts(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and how often it holds each."""
    codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    points = _letters(text)
    for at in range(0, len(points), _PIECE):
        # Each n-gram belongs to the piece in which it ends.
        head = points[max(at - longest + 1, 0) : at]
        found = np.sort(_grams(np.concatenate([head, points[at : at + _PIECE]]), longest))
        new, n = _runs(found)
        if len(head):
            seen, k = _runs(np.sort(_grams(head, longest)))
            n[np.searchsorted(new, seen)] -= k
        codes, counts = merged([codes, new], [counts, n]) if at else (new, n)
    return codes[counts > 0], counts[counts > 0]


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return ordered, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def merged(codes: Sequence[np.ndarray], counts: Sequence[np.ndarray]):
    """One list of distinct codes with summed counts."""
    codes, counts = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(codes, kind="stable")
    distinct, sizes = _runs(codes[order])
    sums = np.add.reduceat(counts[order], np.cumsum(sizes) - sizes) if len(sizes) else counts
    return distinct, sums


def profile_counts(labelled: DataFrame, lang: str = "lang", longest: int = LONGEST) -> DataFrame:
    """How often each language's texts hold each n-gram; summed per task, then overall."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for name, (codes, counts) in held.items():
                codes, counts = merged(codes, counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = gram_counts(text, longest)
                lists = held.setdefault(name, [[], []])
                lists[0].append(codes)
                lists[1].append(counts)
                size += len(codes)
                if size > _PENDING:
                    size = 0
                    for key, (c, n) in held.items():
                        c, n = merged(c, n)
                        held[key] = [[c], [n]]
                        size += len(c)
                    if size > _PENDING // 2:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    counted = labelled.select(F.col(lang).alias("lang"), text_or_empty().alias("text"))
    counted = counted.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(
    labelled: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    profile: int = PROFILE,
    longest: int = LONGEST,
    key: str = "doc_id",
) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, most frequent first.

    The result, ``profile`` numbers per language, is all that reaches the driver.
    """
    labelled = labelled.where(F.col("lang").isNotNull())
    rows = labelled.count()
    if rows > sample_rows:
        labelled = labelled.where(uniform(F.col(key), 5) < sample_rows / rows)
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        profile_counts(labelled, longest=longest)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= profile)
        .collect()
    )
    profiles: dict[str, list] = {}
    for row in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return {name: np.array(grams, dtype=np.int64) for name, grams in profiles.items()}


def predict(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    keep: Sequence[str | Column] = ("doc_id",),
    profile: int = PROFILE,
    longest: int = LONGEST,
) -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score``: how near the nearest profile is, 0 to 1."""
    names = sorted(profiles)
    lookup = []
    for name in names:
        order = np.argsort(profiles[name])
        lookup.append((profiles[name][order], order))

    def nearest(text: str) -> tuple[str, float]:
        codes, counts = gram_counts(text, longest)
        if not len(codes) or not names:
            return UNKNOWN, 0.0
        codes = codes.view(np.int64)
        if len(codes) > profile:
            floor = np.partition(counts, len(counts) - profile)[len(counts) - profile]
            often = counts >= floor
            codes, counts = codes[often], counts[often]
        own = codes[np.lexsort((codes, -counts))][:profile]
        ranks = np.arange(len(own))
        far = []
        for grams, places in lookup:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            apart = np.where(grams[at] == own, np.abs(places[at] - ranks), profile)
            far.append(int(apart.sum()))
        best = int(np.argmin(far))
        return names[best], min(max(1.0 - far[best] / (profile * len(own)), 0.0), 1.0)

    def kernel(data, offsets):
        found = [
            nearest(data[a:b].tobytes().decode("utf-8", "replace"))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
        ]
        return [pa.array([f[0] for f in found], pa.string()), np.array([f[1] for f in found])]

    return map_texts(docs, keep, "lang_pred string, score double", kernel)
