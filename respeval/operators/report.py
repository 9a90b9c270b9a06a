"""Tables behind the charts, and report rows as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.functions.formatting import fixed, percent, text_or
from respeval.operators.roc import quantiles, score_histogram

ARMS = (C.BASELINE_ARM, C.TREATED_ARM)
MISSING = "N/A"


def metric_by_arm(
    metrics: DataFrame,
    metric: str,
    keys: Sequence[str] = ("dataset", "model"),
    arms: Sequence[str] = ARMS,
) -> DataFrame:
    """One column per arm. The arms are given, so no job runs to find them."""
    return metrics.groupBy(*keys).pivot("arm", list(arms)).agg(F.first(metric))


def confidence_histogram(
    scored: DataFrame, keys: Sequence[str] = ("model", "dataset", "arm")
) -> DataFrame:
    return (
        scored.where("confidence_valid")
        .groupBy(*keys, "confidence")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confidence_quartiles(
    scored: DataFrame, keys: Sequence[str] = ("model", "dataset", "arm")
) -> DataFrame:
    """Exact quartiles of the valid confidences, on any scale."""
    histogram = score_histogram(
        scored.where("confidence_valid"), keys, F.lit(True), F.col("confidence")
    )
    return quantiles(histogram, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Metrics as text, ordered by group."""
    spread = F.concat(
        fixed(F.col("mean_confidence"), 1),
        F.lit("±"),
        text_or(fixed(F.col("std_confidence"), 1), "nan"),
    )
    return metrics.select(
        "model",
        "dataset",
        "arm",
        percent(F.col("cautiousness_rate")).alias("cautiousness"),
        percent(F.col("unsafe_rate")).alias("unsafe_rate"),
        text_or(spread, MISSING).alias("confidence"),
        text_or(percent(F.col("accuracy")), MISSING).alias("accuracy"),
    ).orderBy("model", "arm", "dataset")


def test_rows(
    tests: DataFrame,
    baseline: str = C.BASELINE_ARM,
    treated: str = C.TREATED_ARM,
) -> DataFrame:
    """Three text rows per comparison: caution, unsafe rate and confidence."""

    def row(
        metric: str, tested: Column, before: Column, after: Column, p: str, effect: Column
    ) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            before.alias("baseline"),
            after.alias("treated"),
            F.when(tested, F.col(f"_{p}")).otherwise(MISSING).alias("p_value"),
            effect.alias("effect_size"),
        )

    def raw(name: str) -> Column:
        return text_or(F.col(name).cast("string"), "nan")

    texts = {
        **{f"_{p}": fixed(F.col(p), 4) for p in ("cautiousness_p", "unsafe_p", "confidence_p")},
        **{
            f"_{flag}_{arm}": percent(F.col(f"{flag}_{arm}"))
            for flag in ("cautiousness", "unsafe")
            for arm in (baseline, treated)
        },
        **{
            f"_mean_{arm}": fixed(F.col(f"confidence_mean_{arm}"), 1) for arm in (baseline, treated)
        },
        "_odds": fixed(F.col("cautiousness_odds_ratio"), 2),
        "_d": fixed(F.col("confidence_cohens_d"), 2),
    }

    def shown(tested: Column, name: str, otherwise: Column) -> Column:
        return F.when(tested, F.col(name)).otherwise(otherwise)

    missing = F.lit(MISSING)
    caution, unsafe, confidence = (
        F.col(f"{name}_p").isNotNull() for name in ("cautiousness", "unsafe", "confidence")
    )
    rows = F.array(
        row(
            "Cautiousness",
            caution,
            shown(caution, f"_cautiousness_{baseline}", raw(f"cautiousness_{baseline}")),
            shown(caution, f"_cautiousness_{treated}", raw(f"cautiousness_{treated}")),
            "cautiousness_p",
            F.when(caution, F.concat(F.lit("OR="), text_or(F.col("_odds"), "nan"))).otherwise(
                MISSING
            ),
        ),
        row(
            "Unsafe Rate",
            unsafe,
            shown(unsafe, f"_unsafe_{baseline}", missing),
            shown(unsafe, f"_unsafe_{treated}", missing),
            "unsafe_p",
            F.lit("-"),
        ),
        row(
            "Confidence",
            confidence,
            shown(confidence, f"_mean_{baseline}", missing),
            shown(confidence, f"_mean_{treated}", missing),
            "confidence_p",
            F.when(confidence, F.concat(F.lit("d="), text_or(F.col("_d"), "nan"))).otherwise(
                MISSING
            ),
        ),
    )
    return tests.withColumns(texts).select("model", "dataset", F.inline(rows))


def auroc_rows(areas: DataFrame) -> DataFrame:
    return areas.select(
        "model",
        "arm",
        fixed(F.col("auroc"), 3).alias("auroc"),
        F.col("n_neg").cast("string").alias("n_legit"),
        F.col("n_pos").cast("string").alias("n_fake"),
    )
