"""Group metrics over scored responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.functions import aggregates as agg

GROUP = ("model", "arm", "dataset")


def keys_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def group_metrics(
    scored: DataFrame,
    keys: Sequence[str] = GROUP,
    treated_arm: str = C.TREATED_ARM,
    counterfactual: str = C.COUNTERFACTUAL,
    weight: str | None = None,
) -> DataFrame:
    """The metric table, in one aggregation with map-side partial sums.

    Accuracy is NULL where only counterfactual rows exist; the evidence rate is
    NULL outside the treated arm. Rows with a NULL key are left out.
    """
    valid, confidence = F.col("confidence_valid"), F.col("confidence")
    answerable = F.col("dataset_type") != counterfactual
    evidence = agg.share(F.col("flagged_suspicious"), weight=weight)
    return (
        scored.where(keys_present(keys))
        .groupBy(*keys)
        .agg(
            agg.tally(weight=weight).alias("n"),
            agg.share(F.col("is_cautious"), weight=weight).alias("cautiousness_rate"),
            agg.share(F.col("is_unsafe"), weight=weight).alias("unsafe_rate"),
            agg.mean(confidence, valid, weight).alias("mean_confidence"),
            F.sqrt(agg.variance(confidence, valid, weight)).alias("std_confidence"),
            agg.share(F.col("is_correct"), answerable, weight).alias("accuracy"),
            agg.share(~F.col("parse_error"), weight=weight).alias("parse_success_rate"),
            (F.when(F.col("arm") == treated_arm, evidence) if "arm" in keys else evidence).alias(
                "evidence_flag_rate"
            ),
        )
    )


def parse_success(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of all responses that parsed."""
    return scored.agg(
        agg.tally(weight=weight).alias("n"),
        agg.share(~F.col("parse_error"), weight=weight).alias("parse_success_rate"),
    )


def distinct_keys(scored: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    return scored.select(*keys).distinct()


def detection_rate(
    scored: DataFrame,
    keys: Sequence[str] = ("model", "arm"),
    counterfactual: str = C.COUNTERFACTUAL,
) -> DataFrame:
    """Share of counterfactual items recognised, by evidence rating or by abstaining."""
    seen = F.col("flagged_suspicious") | F.col("abstained")
    return (
        scored.where(F.col("dataset_type") == counterfactual)
        .groupBy(*keys)
        .agg(agg.tally().alias("n"), agg.share(seen).alias("detection_rate"))
    )


def refusal_rate(scored: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Abstaining in words, next to merely low confidence."""
    low = F.col("confidence_valid") & (F.col("confidence") <= C.LOW_CONFIDENCE)
    return scored.groupBy(*keys).agg(
        agg.tally().alias("n"),
        agg.share(F.col("abstained")).alias("refusal_rate"),
        agg.share(low & ~F.col("abstained")).alias("low_confidence_only_rate"),
    )


def perturbation_delta(
    scored: DataFrame,
    keys: Sequence[str] = ("model", "arm"),
    reference_type: str = C.LEGITIMATE,
    perturbed_types: Sequence[str] = (C.COUNTERFACTUAL, C.FACTCHECK),
) -> DataFrame:
    """How accuracy, confidence and caution move from the reference type to each other type.

    One aggregation yields both sides; the perturbed types then unfold from its row.
    """
    kind, valid = F.col("dataset_type"), F.col("confidence_valid")

    def sides(name: str) -> list[Column]:
        here = kind == name
        return [
            agg.share(F.col("is_correct"), here).alias(f"accuracy_{name}"),
            agg.mean(F.col("confidence"), here & valid).alias(f"confidence_{name}"),
            agg.share(F.col("is_cautious"), here).alias(f"cautious_{name}"),
        ]

    wide = scored.groupBy(*keys).agg(
        *[column for name in (reference_type, *perturbed_types) for column in sides(name)]
    )

    def step(metric: str, before: str, after: str) -> Column:
        return F.col(f"{metric}_{after}") - F.col(f"{metric}_{before}")

    rows = [
        F.struct(
            F.lit(name).alias("dataset_type"),
            step("accuracy", name, reference_type).alias("accuracy_drop"),
            step("confidence", name, reference_type).alias("uncertainty_increase"),
            F.col(f"cautious_{name}").alias("abstention_rate"),
            step("cautious", reference_type, name).alias("abstention_increase"),
        )
        for name in perturbed_types
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))
