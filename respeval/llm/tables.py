"""Input tables, stored intermediate tables and job settings the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.session import stored

__all__ = ["held_out", "read", "stored", "text_or_empty", "uniform"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def uniform(column: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the value and the seed alone."""
    return (F.xxhash64(F.lit(seed), column) / F.lit(float(1 << 64))) + 0.5
