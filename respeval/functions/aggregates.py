"""Aggregate expressions over plain rows or over rows that carry a count.

With ``weight=None`` each row counts once. With a weight column the same
numbers come from a pre-aggregated table, one row per distinct combination.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")


def tally(where: Column | None = None, weight: str | None = None) -> Column:
    """Number of rows for which ``where`` holds (all rows if not given)."""
    rows = _weight(weight)
    if where is None:
        return F.count(F.lit(1)) if weight is None else F.sum(rows)
    return F.sum(F.when(where, rows).otherwise(F.lit(0).cast("long")))


def share(flag: Column, where: Column | None = None, weight: str | None = None) -> Column:
    """Share of rows whose flag is true; NULL when there are no rows."""
    hits = tally(flag if where is None else (where & flag), weight)
    return F.try_divide(hits.cast("double"), tally(where, weight).cast("double"))


def mean(value: Column, where: Column, weight: str | None = None) -> Column:
    if weight is None:
        return F.avg(F.when(where, value))
    rows = _weight(weight)
    return F.try_divide(
        F.sum(F.when(where, value * rows)), F.sum(F.when(where, rows)).cast("double")
    )


def variance(value: Column, where: Column, weight: str | None = None) -> Column:
    """Sample variance (n - 1); NULL for fewer than two rows.

    Only the built-in form is used on raw rows. The weighted form works on sums
    of squares, which are exact for a whole-number scale such as confidence.
    """
    if weight is None:
        return F.var_samp(F.when(where, value))
    rows = _weight(weight)
    n = F.sum(F.when(where, rows)).cast("double")
    total = F.sum(F.when(where, value * rows))
    squares = F.sum(F.when(where, value * value * rows))
    return F.when(
        n > 1, F.greatest(F.try_divide(squares - F.try_divide(total * total, n), n - 1), F.lit(0.0))
    )
