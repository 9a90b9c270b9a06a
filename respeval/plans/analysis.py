"""Every report table from one pass over the results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.operators import report
from respeval.operators.compare import arm_tests, verdicts
from respeval.operators.metrics import group_metrics, parse_success
from respeval.operators.roc import auroc, counterfactual_histogram, roc_points, running_totals
from respeval.sources.results import drop_nan, write_csv, write_json

CELL = (
    "model",
    "arm",
    "dataset",
    "dataset_type",
    "confidence",
    "confidence_valid",
    "is_correct",
    "is_cautious",
    "is_unsafe",
    "flagged_suspicious",
    "parse_error",
)


def score_cells(scored: DataFrame) -> DataFrame:
    """Rows per combination of everything the report reads.

    An unusable confidence never enters a number, so it is set to NULL. What is left
    is a few flags and the distinct confidences: on a short scale the cells per group
    stay few however many rows there are, and partial aggregation shrinks the data before
    its only shuffle. On a scale of many values there are as many cells as values.
    """
    confidence = F.when(F.col("confidence_valid"), F.col("confidence")).alias("confidence")
    columns = [confidence if c == "confidence" else F.col(c) for c in CELL]
    return scored.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class Analysis:
    """The report tables over the cells.

    Building one runs no job. The ROC tables are made when first asked for: that stores one
    sorted histogram, which both read.
    """

    cells: DataFrame
    groups: tuple[str, ...] = ("model", "arm")

    @cached_property
    def parse_success(self) -> DataFrame:
        return parse_success(self.cells, weight="rows")

    @cached_property
    def metrics(self) -> DataFrame:
        return group_metrics(self.cells, weight="rows")

    @cached_property
    def tests(self) -> DataFrame:
        return arm_tests(self.cells, weight="rows")

    @cached_property
    def verdicts(self) -> DataFrame:
        return verdicts(self.cells, weight="rows")

    @cached_property
    def _histogram(self) -> DataFrame:
        return counterfactual_histogram(self.cells, self.groups, weight="rows")

    @cached_property
    def _totals(self) -> DataFrame:
        return running_totals(self._histogram, self.groups)

    @cached_property
    def auroc(self) -> DataFrame:
        return auroc(self._histogram, self.groups, totals=self._totals)

    @cached_property
    def roc_points(self) -> DataFrame:
        return roc_points(self._histogram, self.groups, totals=self._totals)

    def metric_rows(self) -> DataFrame:
        return report.metric_rows(self.metrics)

    def test_rows(self) -> DataFrame:
        return report.test_rows(self.tests)

    def auroc_rows(self) -> DataFrame:
        return report.auroc_rows(self.auroc)


def analyse(scored: DataFrame, keep_cells: bool = True) -> Analysis:
    """All report tables of ``scored``.

    ``keep_cells`` holds the cell table in executor memory and disk after first use,
    so that further tables do not scan the results again; a lost block is recomputed.
    """
    cells = score_cells(scored)
    return Analysis(cells.persist() if keep_cells else cells)


def write_report(analysis: Analysis, folder: str) -> None:
    """The report tables as files: metrics as CSV, the rest as JSON lines."""
    write_csv(drop_nan(analysis.metrics), f"{folder}/metrics")
    for name, table in (
        ("parse_success", analysis.parse_success),
        ("verdicts", analysis.verdicts),
        ("statistical_tests", analysis.tests),
        ("auroc", analysis.auroc),
        ("roc_points", analysis.roc_points),
        ("metric_rows", analysis.metric_rows()),
        ("test_rows", analysis.test_rows()),
        ("auroc_rows", analysis.auroc_rows()),
    ):
        write_json(drop_nan(table), f"{folder}/{name}")
