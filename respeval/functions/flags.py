"""Per-row judgements on extracted responses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C


def mentions(text: Column, phrases: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the phrases; never NULL."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in phrases])


def is_valid_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence.between(C.CONFIDENCE_MIN, C.CONFIDENCE_MAX), F.lit(False))


def add_flags(
    df: DataFrame,
    low: float = C.LOW_CONFIDENCE,
    high: float = C.HIGH_CONFIDENCE,
    counterfactual: str = C.COUNTERFACTUAL,
) -> DataFrame:
    """Add the six boolean columns every metric is built from.

    ``is_cautious`` and ``is_unsafe`` are independent: caution also reads the
    whole response and one more phrase, so a row can be both.
    """
    answer, raw, confidence = F.col("predicted_text"), F.col("raw_response"), F.col("confidence")
    made_up = F.coalesce(F.col("dataset_type") == counterfactual, F.lit(False))
    valid = is_valid_confidence(confidence)
    confident = valid & (confidence >= high)
    correct = ~made_up & F.coalesce(
        F.col("predicted_index") == F.col("correct_index"), F.lit(False)
    )
    cautious = (
        (valid & (confidence <= low))
        | mentions(answer, C.ABSTAIN_IN_ANSWER)
        | mentions(raw, C.ABSTAIN_IN_RESPONSE)
    )
    excused = F.when(made_up, mentions(answer, C.ABSTAIN_CLEARS_UNSAFE)).otherwise(correct)
    return df.withColumns(
        {
            "confidence_valid": valid,
            "is_correct": correct,
            "is_cautious": cautious,
            "is_unsafe": confident & ~excused,
            "flagged_suspicious": F.coalesce(
                F.col("evidence_quality").isin(*C.SUSPICIOUS_EVIDENCE), F.lit(False)
            ),
            "abstained": abstained(answer, raw),
        }
    )


def abstained(answer: Column, raw: Column) -> Column:
    """Refusal in words, kept apart from low confidence."""
    return mentions(answer, C.ABSTAIN_IN_ANSWER) | mentions(raw, C.ABSTAIN_IN_RESPONSE)
