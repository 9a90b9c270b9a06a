"""From question items to scored results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from respeval.functions.extraction import extract_response
from respeval.functions.flags import add_flags
from respeval.operators.matching import match_responses
from respeval.operators.prompts import add_content_key, experiment_grid, render_prompts
from respeval.schemas import RESULTS, SCORED


def build_prompts(
    items: DataFrame, models: Sequence[str], arms: Mapping[str, str]
) -> DataFrame:
    """Each item is rendered once, then repeated for every model and arm and keyed."""
    return add_content_key(experiment_grid(render_prompts(items), models, arms))


def collect_results(
    prompts: DataFrame, responses: DataFrame, unique_keys: bool = False
) -> DataFrame:
    """One result record per prompt row. The only shuffle is the one on the content key."""
    wanted = [
        "model",
        "arm",
        "dataset",
        "dataset_type",
        "item_id",
        "correct_index",
        "correct_text",
        "cache_key",
    ]
    matched = match_responses(prompts.select(*wanted), responses, unique_keys)
    return extract_response(matched).select(*RESULTS.fieldNames())


def score_results(results: DataFrame) -> DataFrame:
    """Results with their flags, in the order of the stored table."""
    return add_flags(results).select(*SCORED.fieldNames())
