"""Size and preview of every split of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_profile(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def split_preview(
    df: DataFrame, order: Sequence[str], split: str = "split", rows: int = 3
) -> DataFrame:
    """The first rows of each split; the rank limit is applied before the shuffle."""
    window = Window.partitionBy(split).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= rows)


def _variants(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of unlike tables in one frame, each row a VARIANT object."""
    rows = [
        df.select(F.lit(name).alias("split"), F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, rows)


def merged_schemas(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``split``, ``n_rows`` and the one ``schema`` that holds all rows, nested fields included."""
    return _variants(tables).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.schema_of_variant_agg("row").alias("schema")
    )


def field_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per ``split`` and ``field`` of tables with unlike schemas: ``type`` and ``n_values``.

    The type is merged from the values, so it holds for every row; a field without any value
    has the type ``VOID``. Partial sums are merged, no row is shuffled.
    """
    rows = _variants(tables)
    fields = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("row").outer()))
    there = F.when(~F.is_variant_null("value"), 1)
    return fields.groupBy("split", F.col("key").alias("field")).agg(
        F.schema_of_variant_agg("value").alias("type"), F.count(there).alias("n_values")
    )
