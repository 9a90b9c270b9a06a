"""Columns that are computed in one place of the plan and nowhere else.

The optimizer moves filters below projections and drops columns that one branch of
a plan does not read. Both are good for cheap columns. For an expensive one the first
copies the expression into the filter; and when a table is used several times, the
second gives each use a different shuffle, which can then not be shared. A generator
that yields exactly one row is left as it is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(
    df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` (default: all columns) plus ``columns``, the latter behind a generator."""
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*(df.columns if keep is None else keep), F.inline_outer(F.array(row)))
