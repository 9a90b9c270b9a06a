"""How well stated confidence agrees with being right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C

GROUP = ("model", "arm")


def answerable(scored: DataFrame) -> DataFrame:
    """Rows with a usable confidence and a right answer to compare with."""
    return scored.where(F.col("confidence_valid") & (F.col("dataset_type") != C.COUNTERFACTUAL))


def _stated() -> Column:
    return F.col("confidence") / F.lit(float(C.CONFIDENCE_MAX))


def _right() -> Column:
    return F.col("is_correct").cast("double")


def calibration_bins(scored: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """Accuracy and mean stated confidence per confidence step."""
    return (
        answerable(scored)
        .groupBy(*groups, F.ceil("confidence").cast("int").alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(_right()).alias("accuracy"),
            F.avg(_stated()).alias("stated"),
        )
    )


def calibration_error(scored: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """Expected calibration error: the gap between the two, averaged over rows."""
    gap = F.abs(F.col("accuracy") - F.col("stated"))
    return (
        calibration_bins(scored, groups)
        .groupBy(*groups)
        .agg(
            F.sum("n").alias("n"),
            F.try_divide(F.sum(F.col("n") * gap), F.sum("n").cast("double")).alias("ece"),
        )
    )


def brier_score(scored: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    miss = _stated() - _right()
    return (
        answerable(scored)
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(miss * miss).alias("brier"))
    )


def uncertainty_error_correlation(scored: DataFrame, groups: Sequence[str] = GROUP) -> DataFrame:
    """Correlation of inverted confidence with being wrong; NULL if either is constant."""
    doubt, wrong = F.lit(float(C.CONFIDENCE_MAX)) - F.col("confidence"), 1 - _right()
    spread = F.stddev_pop(doubt) * F.stddev_pop(wrong)
    return (
        answerable(scored)
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.try_divide(F.covar_pop(doubt, wrong), spread).alias("correlation"),
        )
    )
