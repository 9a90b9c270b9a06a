"""ROC and other curves over a score, from a histogram of the score.

The histogram (group, score -> counts per class) is built with partial aggregation; curves
are running totals over it. A score may have any number of distinct values, so the
histogram is sorted into ranges by Spark, whose number and borders follow the data. Totals
are taken within ranges, in parallel, and offset by the totals of the higher ranges. The
sorted histogram is stored first, when a curve is asked for, so that every use has the
same ranges and a lost executor costs nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from respeval import constants as C
from respeval.functions import aggregates as agg
from respeval.operators.metrics import keys_present
from respeval.session import stored

_COUNTS = ("pos", "neg")


def score_histogram(
    df: DataFrame,
    groups: Sequence[str],
    positive: Column,
    score: Column,
    weight: str | None = None,
) -> DataFrame:
    """Rows per group and score, split by class; rows without score or class are left out."""
    return (
        df.where(keys_present(groups) & positive.isNotNull() & score.isNotNull())
        .groupBy(*groups, score.alias("score"))
        .agg(
            agg.tally(positive, weight).alias("pos"),
            agg.tally(~positive, weight).alias("neg"),
        )
    )


def running_totals(
    histogram: DataFrame, groups: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Add ``cum_*`` (this score and higher), ``total_*`` and ``next_*`` (next lower score).

    Runs a job that stores the histogram in ranges; ``ranges`` sets their number, which
    otherwise follows the size of the histogram.
    """
    groups = list(groups)
    order = [*([] if ranges is None else [ranges]), *groups, "score"]
    dealt = histogram.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    located = stored(dealt, "score-ranges")
    # A higher range holds higher scores. A group and score stand in one row, so in one range.
    across = Window.partitionBy(*groups).orderBy(F.desc("_range"))
    above = across.rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    every = Window.partitionBy(*groups)
    top = F.max_by(F.struct(*_COUNTS), F.col("score"))
    per_range = located.groupBy(*groups, "_range").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in _COUNTS], top.alias("_top")
    )
    offsets = per_range.select(
        *groups,
        "_range",
        *[
            F.coalesce(F.sum(f"_sum_{c}").over(above), F.lit(0)).alias(f"_above_{c}")
            for c in _COUNTS
        ],
        *[F.sum(f"_sum_{c}").over(every).alias(f"total_{c}") for c in _COUNTS],
        F.lead("_top").over(across).alias("_below"),
    )
    down = Window.partitionBy(*groups, "_range").orderBy(F.desc("score"))
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return located.join(offsets, [*groups, "_range"]).select(
        *histogram.columns,
        *[(F.col(f"_above_{c}") + F.sum(c).over(so_far)).alias(f"cum_{c}") for c in _COUNTS],
        *[f"total_{c}" for c in _COUNTS],
        *[
            F.coalesce(F.lead(c).over(down), F.col("_below").getField(c)).alias(f"next_{c}")
            for c in _COUNTS
        ],
    )


def quantiles(
    histogram: DataFrame, groups: Sequence[str], at: Mapping[str, float], ranges: int | None = None
) -> DataFrame:
    """``n`` and exact quantiles, interpolated between neighbours, of the ``pos`` rows' scores."""
    totals = running_totals(histogram, groups, ranges)
    # Places of a score among the group's rows in ascending order, counted from 0.
    first = F.col("total_pos") - F.col("cum_pos")
    last = first + F.col("pos") - 1
    place = {name: F.lit(q) * (F.col("total_pos") - 1) for name, q in at.items()}

    def score_at(where: Column) -> Column:
        return F.max(F.when(where.between(first, last), F.col("score")))

    found = totals.groupBy(*groups).agg(
        F.max("total_pos").alias("n"),
        *[score_at(F.floor(p)).alias(f"_low_{name}") for name, p in place.items()],
        *[score_at(F.ceil(p)).alias(f"_high_{name}") for name, p in place.items()],
    )

    def between(name: str, q: float) -> Column:
        exact = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + (high - low) * (exact - F.floor(exact))).cast("double").alias(name)

    return found.select(*groups, "n", *[between(name, q) for name, q in at.items()])


def _large_enough(min_rows: int) -> Column:
    return (F.col("total_pos") > min_rows) & (F.col("total_neg") > min_rows)


def auroc(
    histogram: DataFrame,
    groups: Sequence[str],
    min_rows: int = C.MIN_CLASS_ROWS,
    ranges: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Area under the ROC, ties counting half; small groups are left out.

    ``totals`` are the histogram's ``running_totals``, where they are at hand.
    """
    above = F.col("cum_pos") - F.col("pos") / F.lit(2.0)
    wins = F.sum(F.col("neg") * above)
    totals = running_totals(histogram, groups, ranges) if totals is None else totals
    return (
        totals.groupBy(*groups)
        .agg(
            wins.alias("_wins"),
            F.max("total_pos").alias("total_pos"),
            F.max("total_neg").alias("total_neg"),
        )
        .where(_large_enough(min_rows))
        .select(
            *groups,
            F.try_divide(
                F.col("_wins"), F.col("total_pos").cast("double") * F.col("total_neg")
            ).alias("auroc"),
            F.col("total_neg").alias("n_neg"),
            F.col("total_pos").alias("n_pos"),
        )
    )


def roc_points(
    histogram: DataFrame,
    groups: Sequence[str],
    min_rows: int = C.MIN_CLASS_ROWS,
    ranges: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Corner points of the ROC, starting at the origin (whose threshold is NULL).

    A point is dropped when the next step repeats the step that led to it, since it
    then lies on a straight run of equal steps; the first and last points stay.
    """
    pos, neg = F.col("pos"), F.col("neg")
    first = (F.col("cum_pos") == pos) & (F.col("cum_neg") == neg)
    last = F.col("next_pos").isNull()
    turns = (F.col("next_pos") != pos) | (F.col("next_neg") != neg)
    point = F.struct(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos")).alias("tpr"),
    )
    origin = F.struct(
        F.lit(None).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    totals = running_totals(histogram, groups, ranges) if totals is None else totals
    return (
        totals
        .where(_large_enough(min_rows) & (first | last | turns))
        .select(*groups, F.inline(F.when(first, F.array(origin, point)).otherwise(F.array(point))))
    )


def threshold_scores(
    histogram: DataFrame, groups: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Precision, recall and F1 when everything at or above a score is called positive."""
    hits, called = F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg")
    return running_totals(histogram, groups, ranges).select(
        *groups,
        F.col("score").alias("threshold"),
        F.try_divide(hits, called).alias("precision"),
        F.try_divide(hits, F.col("total_pos")).alias("recall"),
        F.try_divide(2 * hits, called + F.col("total_pos")).alias("f1"),
    )


def risk_coverage(
    histogram: DataFrame, groups: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Accuracy and abstention rate when only scores at or above a threshold are answered."""
    answered = F.col("cum_pos") + F.col("cum_neg")
    total = F.col("total_pos") + F.col("total_neg")
    coverage = F.try_divide(answered.cast("double"), total)
    return running_totals(histogram, groups, ranges).select(
        *groups,
        F.col("score").alias("threshold"),
        coverage.alias("coverage"),
        (1 - coverage).alias("abstention_rate"),
        F.try_divide(F.col("cum_pos").cast("double"), answered).alias("selective_accuracy"),
    )


def selective_area(
    histogram: DataFrame,
    groups: Sequence[str],
    ranges: int | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Area under selective accuracy over coverage, by trapezoids, and under its complement.

    Points are those of ``risk_coverage``. Down to the first one, where nothing is answered
    yet, the first accuracy holds. A trapezoid's lower end is the next score's point, which
    may lie in another range: ``next_*`` carries it over the border.
    """
    totals = running_totals(histogram, groups, ranges) if totals is None else totals
    all_rows = (F.col("total_pos") + F.col("total_neg")).cast("double")
    here, step = F.col("cum_pos") + F.col("cum_neg"), F.col("next_pos") + F.col("next_neg")
    accuracy = F.col("cum_pos") / here.cast("double")
    then = (F.col("cum_pos") + F.col("next_pos")) / (here + step).cast("double")
    first = here == F.col("pos") + F.col("neg")
    strip = F.when(first, here * accuracy).otherwise(F.lit(0.0))
    trapezoid = F.coalesce(step * (accuracy + then) / 2, F.lit(0.0))
    area = F.try_divide(F.sum(strip + trapezoid), F.max(all_rows))
    return totals.groupBy(*groups).agg(
        F.max(all_rows).cast("long").alias("n"),
        area.alias("accuracy_area"),
        (1 - area).alias("risk_area"),
    )


def counterfactual_histogram(
    scored: DataFrame,
    groups: Sequence[str] = ("model", "arm"),
    weight: str | None = None,
) -> DataFrame:
    """Legitimate against counterfactual rows, scored by inverted confidence."""
    kind = F.col("dataset_type")
    return score_histogram(
        scored.where(F.col("confidence_valid") & kind.isin(C.LEGITIMATE, C.COUNTERFACTUAL)),
        groups,
        kind == C.COUNTERFACTUAL,
        F.lit(float(C.CONFIDENCE_MAX)) - F.col("confidence"),
        weight,
    )


def correctness_histogram(
    scored: DataFrame,
    groups: Sequence[str] = ("model", "arm"),
    weight: str | None = None,
) -> DataFrame:
    """Correct against wrong rows, scored by confidence; counterfactual rows have no truth."""
    return score_histogram(
        scored.where(F.col("confidence_valid") & (F.col("dataset_type") != C.COUNTERFACTUAL)),
        groups,
        F.col("is_correct"),
        F.col("confidence"),
        weight,
    )


def _poisson_borders() -> list[int]:
    """Where the distribution function of Poisson(1) crosses, in units of 2**-32."""
    borders, mass, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += mass
        borders.append(round(total * 2**32))
        mass /= k + 1
    return borders


def _drawn_column(seed: int, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


@lru_cache(maxsize=2)
def _weights(seed: int, blocks: int, replicates: int) -> np.ndarray:
    """How often each replicate draws each block: a row per block."""
    texts = (f"{seed}|{b}|{r}" for b in range(blocks) for r in range(1, replicates + 1))
    draws = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts])
    return np.searchsorted(_poisson_borders(), draws, side="right").reshape(blocks, replicates).astype(float)


#: Rows whose vectors a task works on together.
_STEP = 256


def _range_vectors(
    dealt: DataFrame, groups: Sequence[str], seed: int, blocks: int, replicates: int
) -> DataFrame:
    """Per group, range and replicate: weights of both classes, and pairs won inside the range.

    Sorting within partitions lets a task see each group's scores in descending order as a
    stream; it holds one vector of running totals and a few rows' vectors at a time.
    """
    kept = StructType([f for f in dealt.schema.fields if f.name in groups])
    schema = StructType([*kept.fields, *StructType.fromDDL("_range int, replicate int, pos double, neg double, wins double").fields])
    ordered = dealt.sortWithinPartitions(*groups, F.desc("score")).select(
        *groups, "_range", "score", "_block", *_COUNTS
    )
    names = [f.name for f in kept.fields]

    def run(batches):
        weights = _weights(seed, blocks, replicates)
        current, part, kinds = None, None, []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in [*names, "_range"]]
            keys = list(zip(*[batch.column(c).to_pylist() for c in [*names, "_range"]]))
            score, block, pos, neg = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "_block", *_COUNTS)
            )
            borders = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(borders[:-1], borders[1:]):
                if keys[a] != current:
                    if part is not None:
                        yield _range_rows(current, part, kinds, schema.names)
                    current, part = keys[a], _RangeTotals(replicates)
                for at in range(a, b, _STEP):
                    to = min(at + _STEP, b)
                    part.add(score[at:to], weights[block[at:to]], pos[at:to], neg[at:to])
        if part is not None:
            yield _range_rows(current, part, kinds, schema.names)

    return ordered.mapInArrow(run, schema)


class _RangeTotals:
    """Running totals per replicate over scores that come in descending order."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.wins = (np.zeros(replicates) for _ in range(3))
        # Rows of the score that came last, which more rows may follow.
        self.score, self.tied_pos, self.tied_neg = None, np.zeros(replicates), np.zeros(replicates)

    def add(self, score: np.ndarray, weights: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        firsts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        p = np.add.reduceat(weights * pos[:, None], firsts, axis=0)
        n = np.add.reduceat(weights * neg[:, None], firsts, axis=0)
        if self.score is not None and score[0] == self.score:
            p[0] += self.tied_pos
            n[0] += self.tied_neg
        else:
            self.close()
        self.score, self.tied_pos, self.tied_neg = score[-1], p[-1].copy(), n[-1].copy()
        done = np.cumsum(p[:-1], axis=0)
        self.wins += (n[:-1] * (self.pos + done - p[:-1] / 2)).sum(axis=0)
        if len(done):
            self.pos = self.pos + done[-1]
            self.neg = self.neg + n[:-1].sum(axis=0)

    def close(self) -> None:
        self.wins += self.tied_neg * (self.pos + self.tied_pos / 2)
        self.pos = self.pos + self.tied_pos
        self.neg = self.neg + self.tied_neg
        self.tied_pos, self.tied_neg = np.zeros_like(self.pos), np.zeros_like(self.pos)


def _range_rows(
    key: tuple, part: _RangeTotals, kinds: Sequence[pa.DataType], names: Sequence[str]
) -> pa.RecordBatch:
    part.close()
    n = len(part.pos)
    columns = [pa.array([value] * n, kind) for value, kind in zip(key, kinds)]
    numbers = [pa.array(np.arange(1, n + 1, dtype=np.int32)), *map(pa.array, (part.pos, part.neg, part.wins))]
    return pa.RecordBatch.from_arrays(columns + numbers, names=list(names))


def bootstrap_auroc(
    df: DataFrame,
    groups: Sequence[str],
    positive: Column,
    score: Column,
    id_col: str = "item_id",
    replicates: int = 1000,
    blocks: int = 100,
    seed: int = C.SAMPLE_SEED,
    level: float = 0.95,
    min_rows: int = C.MIN_CLASS_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """Percentile interval of the AUROC from a block bootstrap.

    A hash of its id puts each item into one of ``blocks`` blocks, so the rows of an item
    are drawn together. A replicate gives every block a Poisson(1) weight, taken from a hash
    of seed, block and replicate, so draws repeat on every run and engine. The blocks'
    histogram is sorted by score into ranges once. In a range a task carries one vector of
    running totals with an entry per replicate; a range hands on three vectors, which are
    put together across ranges. So rows are never repeated per replicate: the work is one
    vector operation a row, and what is shuffled after it is replicates times ranges.
    Replicates without a row of either class have no area and are not counted.
    """
    groups = list(groups)
    block = _drawn_column(seed, F.col(id_col).cast("string")) % blocks
    by_block = score_histogram(df.withColumn("_block", block), [*groups, "_block"], positive, score)
    histogram = by_block.groupBy(*groups, "score").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    order = [*([] if ranges is None else [ranges]), *groups, "score"]
    dealt = by_block.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    parts = _range_vectors(dealt, groups, seed, blocks, replicates)
    above = Window.partitionBy(*groups, "replicate").orderBy(F.desc("_range"))
    above = above.rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    placed = parts.withColumn("_above", F.coalesce(F.sum("pos").over(above), F.lit(0.0)))
    drawn = placed.groupBy(*groups, "replicate").agg(
        F.sum(F.col("wins") + F.col("neg") * F.col("_above")).alias("_wins"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    area = F.try_divide(F.col("_wins"), F.col("_pos") * F.col("_neg"))
    tail = (1 - level) / 2
    spread = (
        drawn.withColumn("auroc", area)
        .groupBy(*groups)
        .agg(
            F.count("auroc").alias("replicates"),
            F.percentile("auroc", F.array(F.lit(tail), F.lit(1 - tail))).alias("_bounds"),
        )
    )
    return auroc(histogram, groups, min_rows).join(spread, groups).select(
        *groups,
        "auroc",
        F.col("_bounds")[0].alias("auroc_low"),
        F.col("_bounds")[1].alias("auroc_high"),
        "replicates",
    )
