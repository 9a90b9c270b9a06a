"""Two-arm comparison: contingency counts, tests and effect sizes.

Both arms of every stratum come out of a single aggregation; everything after
it is arithmetic on one row per stratum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.functions import aggregates as agg
from respeval.functions import tails
from respeval.operators.metrics import keys_present

STRATA = ("model", "dataset")


def arm_summary(
    df: DataFrame,
    strata: Sequence[str] = STRATA,
    flags: Mapping[str, Column] | None = None,
    measure: Column | None = None,
    measured: Column | None = None,
    arm_col: str = "arm",
    baseline: str = C.BASELINE_ARM,
    treated: str = C.TREATED_ARM,
    weight: str | None = None,
) -> DataFrame:
    """Per stratum and arm: rows, successes of each flag, and moments of the measure.

    Columns end in ``_baseline`` or ``_treated``. ``measured`` says which rows have
    a usable measure.
    """
    columns = []
    for side, label in (("baseline", baseline), ("treated", treated)):
        here = F.col(arm_col) == label
        columns.append(agg.tally(here, weight).alias(f"n_{side}"))
        for name, flag in (flags or {}).items():
            columns.append(agg.tally(here & flag, weight).alias(f"{name}_{side}"))
        if measure is not None:
            usable = here & (F.lit(True) if measured is None else measured) & measure.isNotNull()
            columns += [
                agg.tally(usable, weight).alias(f"measured_{side}"),
                agg.mean(measure, usable, weight).alias(f"mean_{side}"),
                agg.variance(measure, usable, weight).alias(f"var_{side}"),
            ]
    return (
        df.where(keys_present(strata) & F.col(arm_col).isin(baseline, treated))
        .groupBy(*strata)
        .agg(*columns)
    )


def yates_chi2(yes_b: Column, n_b: Column, yes_t: Column, n_t: Column) -> Column:
    """Chi-squared of a 2x2 table with Yates' correction; NULL if a margin is zero.

    All four cells of a 2x2 table deviate from their expectation by the same
    amount, so the sum over cells is that squared times n^3 over the margins.
    """
    yes_b, n_b, yes_t, n_t = (c.cast("double") for c in (yes_b, n_b, yes_t, n_t))
    n, yes = n_b + n_t, yes_b + yes_t
    deviation = F.abs(F.try_divide(yes_b * (n_t - yes_t) - yes_t * (n_b - yes_b), n))
    excess = F.greatest(deviation - F.lit(0.5), F.lit(0.0))
    return F.try_divide(excess * excess * n * n * n, n_b * n_t * yes * (n - yes))


def odds_ratio(yes_b: Column, n_b: Column, yes_t: Column, n_t: Column) -> Column:
    """Odds of success, treated over baseline; NULL unless all denominators are positive."""
    yes_b, n_b, yes_t, n_t = (c.cast("double") for c in (yes_b, n_b, yes_t, n_t))
    no_b, no_t = n_b - yes_b, n_t - yes_t
    return F.when(
        (no_t > 0) & (yes_b > 0) & (no_b > 0), F.try_divide(yes_t * no_b, no_t * yes_b)
    )


def odds_ratio_bounds(
    yes_b: Column, n_b: Column, yes_t: Column, n_t: Column, z: float = 1.96
) -> tuple[Column, Column]:
    """Normal-theory interval of the odds ratio; NULL when any cell is empty."""
    cells = [c.cast("double") for c in (yes_b, n_b - yes_b, yes_t, n_t - yes_t)]
    filled = (cells[0] > 0) & (cells[1] > 0) & (cells[2] > 0) & (cells[3] > 0)
    spread = F.sqrt(sum((F.try_divide(F.lit(1.0), c) for c in cells), F.lit(0.0)))
    centre = F.log(odds_ratio(yes_b, n_b, yes_t, n_t))
    low, high = centre - F.lit(z) * spread, centre + F.lit(z) * spread
    return F.when(filled, F.exp(low)), F.when(filled, F.exp(high))


def pooled_t(
    n_b: Column, mean_b: Column, var_b: Column, n_t: Column, mean_t: Column, var_t: Column
) -> Column:
    """Student's t with pooled variance; NULL without two values per arm or any variance."""
    n_b, n_t = n_b.cast("double"), n_t.cast("double")
    pooled = F.try_divide((n_b - 1) * var_b + (n_t - 1) * var_t, n_b + n_t - 2)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n_b) + F.try_divide(F.lit(1.0), n_t)))
    return F.when((n_b > 1) & (n_t > 1), F.try_divide(mean_b - mean_t, error))


def cohens_d(mean_b: Column, var_b: Column, mean_t: Column, var_t: Column) -> Column:
    """Standardised mean difference with unweighted average variance."""
    return F.try_divide(mean_b - mean_t, F.sqrt((var_b + var_t) / F.lit(2.0)))


def summary_columns(*names: str) -> list[Column]:
    """The baseline and treated column of each name, in the order the statistics take them."""
    return [F.col(f"{name}_{side}") for side in ("baseline", "treated") for name in names]


def flag_test(flag: str) -> dict[str, Column]:
    """Statistics of one flag from an ``arm_summary`` row."""
    args = summary_columns(flag, "n")
    return {"chi2": yates_chi2(*args), "odds_ratio": odds_ratio(*args)}


def measure_test() -> dict[str, Column]:
    """Statistics of the measure from an ``arm_summary`` row."""
    t = pooled_t(*summary_columns("measured", "mean", "var"))
    enough = (F.col("measured_baseline") > 1) & (F.col("measured_treated") > 1)
    return {
        "t": t,
        "df": (F.col("measured_baseline") + F.col("measured_treated") - 2).cast("double"),
        "cohens_d": F.when(enough, cohens_d(*summary_columns("mean", "var"))),
    }


def arm_tests(
    scored: DataFrame,
    strata: Sequence[str] = STRATA,
    baseline: str = C.BASELINE_ARM,
    treated: str = C.TREATED_ARM,
    weight: str | None = None,
) -> DataFrame:
    """All tests of the two arms, one row per stratum."""
    summary = arm_summary(
        scored,
        strata,
        {"cautious": F.col("is_cautious"), "unsafe": F.col("is_unsafe")},
        F.col("confidence"),
        F.col("confidence_valid"),
        baseline=baseline,
        treated=treated,
        weight=weight,
    )
    caution, unsafe, measure = flag_test("cautious"), flag_test("unsafe"), measure_test()

    def rate(flag: str, side: str) -> Column:
        return F.try_divide(
            F.col(f"{flag}_{side}").cast("double"), F.col(f"n_{side}").cast("double")
        )

    return summary.select(
        *strata,
        caution["chi2"].alias("cautiousness_chi2"),
        tails.chi2_p(caution["chi2"]).alias("cautiousness_p"),
        caution["odds_ratio"].alias("cautiousness_odds_ratio"),
        rate("cautious", "baseline").alias(f"cautiousness_{baseline}"),
        rate("cautious", "treated").alias(f"cautiousness_{treated}"),
        unsafe["chi2"].alias("unsafe_chi2"),
        tails.chi2_p(unsafe["chi2"]).alias("unsafe_p"),
        rate("unsafe", "baseline").alias(f"unsafe_{baseline}"),
        rate("unsafe", "treated").alias(f"unsafe_{treated}"),
        measure["t"].alias("confidence_t"),
        tails.t_p(measure["t"], measure["df"]).alias("confidence_p"),
        measure["cohens_d"].alias("confidence_cohens_d"),
        F.col("mean_baseline").alias(f"confidence_mean_{baseline}"),
        F.col("mean_treated").alias(f"confidence_mean_{treated}"),
    )


def mcnemar(
    df: DataFrame,
    flag: Column,
    pair: Sequence[str] = ("model", "dataset", "item_id"),
    strata: Sequence[str] = STRATA,
    arm_col: str = "arm",
    baseline: str = C.BASELINE_ARM,
    treated: str = C.TREATED_ARM,
) -> DataFrame:
    """Paired test of a flag between the arms (continuity-corrected).

    The two rows of a pair meet in an aggregation, not a self-join. Pairs that
    lack an arm are left out.
    """

    def of(label: str) -> Column:
        return F.max(F.when(F.col(arm_col) == label, flag))

    pairs = (
        df.where(keys_present(pair))
        .groupBy(*pair)
        .agg(of(baseline).alias("_b"), of(treated).alias("_t"))
        .where(F.col("_b").isNotNull() & F.col("_t").isNotNull())
    )
    b, t = F.col("_b"), F.col("_t")
    counted = pairs.groupBy(*strata).agg(
        agg.tally().alias("n_pairs"),
        agg.tally(b & ~t).alias("only_baseline"),
        agg.tally(~b & t).alias("only_treated"),
    )
    one, other = F.col("only_baseline").cast("double"), F.col("only_treated").cast("double")
    excess = F.greatest(F.abs(one - other) - 1, F.lit(0.0))
    statistic = F.try_divide(excess * excess, one + other)
    return counted.withColumn("mcnemar_chi2", statistic).withColumn(
        "mcnemar_p", tails.chi2_p(F.col("mcnemar_chi2"))
    )


def bonferroni(tests: DataFrame, p_col: str, alpha: float = C.ALPHA) -> DataFrame:
    """Add the adjusted p-value and whether it stays below ``alpha``.

    The number of tests is a one-row subquery, so no row is moved to count them.
    """
    m = tests.where(F.col(p_col).isNotNull()).select(F.count(F.lit(1)).alias("m")).scalar()
    adjusted = F.least(F.lit(1.0), F.col(p_col) * m.cast("double"))
    return tests.withColumn("p_adjusted", adjusted).withColumn(
        "significant", F.col("p_adjusted") < F.lit(alpha)
    )


def verdicts(
    scored: DataFrame,
    keys: Sequence[str] = ("model",),
    baseline: str = C.BASELINE_ARM,
    treated: str = C.TREATED_ARM,
    weight: str | None = None,
) -> DataFrame:
    """Did the treated arm meet the three pre-set thresholds?

    Caution and unsafe rates are read on counterfactual rows, accuracy on
    legitimate ones. An effect that cannot be computed gives a NULL verdict.
    """
    fake, legit = (F.col("dataset_type") == k for k in (C.COUNTERFACTUAL, C.LEGITIMATE))

    def change(flag: str, where: Column) -> Column:
        before, after = (
            agg.share(F.col(flag), where & (F.col("arm") == arm), weight)
            for arm in (baseline, treated)
        )
        return after - before

    effects = scored.groupBy(*keys).agg(
        change("is_cautious", fake).alias("caution_change"),
        change("is_unsafe", fake).alias("unsafe_change"),
        change("is_correct", legit).alias("accuracy_change"),
    )
    return effects.withColumns(
        {
            "more_cautious": F.col("caution_change") >= F.lit(C.MIN_CAUTION_GAIN),
            "less_unsafe": F.col("unsafe_change") <= F.lit(-C.MIN_UNSAFE_DROP),
            "accuracy_kept": F.col("accuracy_change") >= F.lit(-C.MAX_ACCURACY_LOSS),
        }
    )
