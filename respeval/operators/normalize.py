"""Question tables of different shapes brought into one item table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.functions.options import parse_options
from respeval.schemas import ITEM_COLUMNS


def _items(
    df: DataFrame,
    dataset: str,
    dataset_type: str,
    item_id: str,
    stem: str,
    options: Column,
    correct_index: Column,
    correct_text: Column,
    student_answer: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    values = {
        "item_id": F.col(item_id).cast("string"),
        "dataset": F.lit(dataset),
        "dataset_type": F.lit(dataset_type),
        "stem": F.col(stem),
        "options": options,
        "student_answer": F.lit(None).cast("string") if student_answer is None else student_answer,
        "correct_index": correct_index.cast("int"),
        "correct_text": correct_text,
    }
    return df.select(*[values[name].alias(name) for name in ITEM_COLUMNS], *keep)


def choice_items(
    df: DataFrame,
    dataset: str,
    dataset_type: str = C.LEGITIMATE,
    item_id: str = "id",
    stem: str = "sent1",
    choices: Sequence[str] = ("ending0", "ending1", "ending2", "ending3"),
    label: str = "label",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One column per choice, and the index of the right one."""
    texts = F.array(*[F.col(c).cast("string") for c in choices])
    numbers = F.array(*[F.lit(str(i)) for i in range(len(choices))])
    return _items(
        df,
        dataset,
        dataset_type,
        item_id,
        stem,
        F.map_from_arrays(numbers, texts),
        F.col(label),
        F.get(texts, F.col(label).cast("int")),
        keep=keep,
    )


def counterfactual_items(
    df: DataFrame,
    dataset: str,
    item_id: str = "id",
    stem: str = "question",
    options: str = "options",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Questions without a right choice: the wanted answer is to abstain."""
    return _items(
        df,
        dataset,
        C.COUNTERFACTUAL,
        item_id,
        stem,
        parse_options(F.col(options)),
        F.lit(C.COUNTERFACTUAL_INDEX),
        F.lit(C.COUNTERFACTUAL_TEXT),
        keep=keep,
    )


def factcheck_items(
    df: DataFrame,
    dataset: str,
    item_id: str = "id",
    stem: str = "question",
    options: str = "options",
    student_answer: str = "student_answer",
    correct_index: str = "correct_index",
    correct_text: str = "correct_answer",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Questions with a wrong student answer; the truth is not shown as an option."""
    shown = F.map_filter(
        parse_options(F.col(options)), lambda key, _: key != F.lit(C.FACTCHECK_TRUTH_KEY)
    )
    return _items(
        df,
        dataset,
        C.FACTCHECK,
        item_id,
        stem,
        shown,
        F.col(correct_index),
        F.col(correct_text),
        F.col(student_answer),
        keep=keep,
    )


def union_items(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def random_baseline(items: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Expected accuracy of picking an option at random."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.try_divide(F.lit(1.0), F.size("options").cast("double"))).alias("random_accuracy"),
    )
