"""Numbers as report text.

Java rounds the shortest decimal form half up; the published tables round the
binary value half to even. The difference shows only on ties, and the tables
hold one row per group, so the text is made by a small vectorised helper.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals; NULL stays NULL."""

    def to_text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else f"{v:.{digits}f}")

    return F.pandas_udf(to_text, "string")(value.cast("double"))


def percent(value: Column, digits: int = 1) -> Column:
    """A rate as a percentage; NULL stays NULL."""
    return F.concat(fixed(value * F.lit(100.0), digits), F.lit("%"))


def text_or(value: Column, missing: str) -> Column:
    return F.coalesce(value, F.lit(missing))
