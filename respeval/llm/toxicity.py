"""Toxicity by FTRL-proximal logistic regression over hashed words.

Features are the distinct words, pairs of neighbours and pairs with one word between, all
hashed into ``DIMENSION`` coordinates. Each coordinate has its own learning rate, and the L1
term keeps most weights at exactly zero, so the model that tasks receive is a short list.

The model is fitted in one task on a sample of the labelled rows whose expected size is
``sample_rows``; every text is scored whole in the task that read it. Several labels of one
document count as toxic when one of them is. Null and empty texts are scored like any text
without features. Without a toxic and a clean row to learn from, every score is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.llm.tables import held_out, uniform
from respeval.llm.text import long_lists, map_texts, mix, whole, word_hashes

BITS = 22
DIMENSION = 1 << BITS
SAMPLE_ROWS = 12_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
THRESHOLD = 0.3


def _coordinates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all features and the text each belongs to, not yet distinct."""
    words, starts = word_hashes(data, offsets, letters_only=True)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    shift = np.uint64(64 - BITS)
    codes, owners = [words >> shift], [owner]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x85157AF5A2D6F1B3)):
        if len(words) > gap:
            inside = whole(starts, gap + 1)
            pair = mix(words[:-gap] * np.uint64(salt) + words[gap:]) >> shift
            codes.append(pair[inside])
            owners.append(owner[:-gap][inside])
    return np.concatenate(codes).astype(np.int64), np.concatenate(owners)


def features(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` plus each text's distinct coordinates."""

    def kernel(data, offsets):
        codes, owners = _coordinates(data, offsets)
        pairs = np.unique((owners << BITS) | codes)
        sizes = np.bincount(pairs >> BITS, minlength=len(offsets) - 1)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return [long_lists((pairs & (DIMENSION - 1)).astype(np.int32), bounds)]

    return map_texts(docs, keep, "coordinates array<int>", kernel)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, with the intercept last."""
    z, n = np.zeros(DIMENSION + 1), np.zeros(DIMENSION + 1)

    def weights(at):
        zs = z[at]
        shrunk = np.sign(zs) * L1 - zs
        return np.where(np.abs(zs) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in zip(rows, labels):
            at = np.append(at, DIMENSION)
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            square = gradient * gradient
            root = np.sqrt(n[at])
            z[at] += gradient - (np.sqrt(n[at] + square) - root) / ALPHA * w
            n[at] += square
    return weights(np.arange(DIMENSION + 1))


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    epochs: int = EPOCHS,
) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight and the weights; the intercept is coordinate DIMENSION."""
    labelled = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = labelled.count()
    docs = docs.select("doc_id", "text")
    if total > sample_rows:
        chosen = uniform(F.col("doc_id"), 4) < sample_rows / total
        labelled, docs = labelled.where(chosen), docs.where(chosen)
    rows = features(docs.join(labelled, "doc_id"), ["doc_id", "toxic"])

    def learn(batches):
        ids, labels, lists = [], [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
            column = batch.column(2)
            bounds = column.offsets.to_numpy()
            values = column.values.to_numpy()
            lists += [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        if lists:
            label = (np.concatenate(labels) > 0).astype(float)
            if 0 < label.sum() < len(label):
                # The order of learning is that of a hash of the row, wherever it was read.
                first = np.array([x[0] if len(x) else 0 for x in lists])
                sizes = np.array([len(x) for x in lists])
                order = np.lexsort((sizes, first, mix(np.concatenate(ids).astype(np.uint64))))
                w = fit([lists[i] for i in order], label[order], epochs)
                at = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(w[at])], names=["coordinate", "weight"]
                )

    model = rows.repartition(1).mapInArrow(learn, "coordinate long, weight double").collect()
    return (
        np.array([r["coordinate"] for r in model], dtype=np.int64),
        np.array([r["weight"] for r in model], dtype=float),
    )


def _scorer(model: tuple[np.ndarray, np.ndarray]):
    order = np.argsort(model[0])
    at, weights = model[0][order], model[1][order]
    intercept = float(weights[at == DIMENSION].sum())

    def kernel(data, offsets):
        texts = len(offsets) - 1
        if not len(at):
            return [np.zeros(texts)]
        codes, owners = _coordinates(data, offsets)
        place = np.minimum(np.searchsorted(at, codes), len(at) - 1)
        heavy = at[place] == codes
        pairs = np.unique(owners[heavy] * len(at) + place[heavy])
        sums = np.bincount(pairs // len(at), weights[pairs % len(at)], minlength=texts)
        return [1.0 / (1.0 + np.exp(-np.clip(sums + intercept, -35, 35)))]

    return kernel


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray],
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` plus ``score``, the probability that a text is toxic."""
    return map_texts(docs, keep, "score double", _scorer(model))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, columns unchanged."""
    scorer = _scorer(train(docs, labels))
    clean = lambda data, offsets: [scorer(data, offsets)[0] < threshold]
    return map_texts(docs, docs.columns, "", clean)
