"""Question tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_questions(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    split_col: str = "split",
    fmt: str = "parquet",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Scan a question table; the split filter reaches the scan.

    With the split in the path (``split=test/``) it prunes folders; as a stored
    column it skips row groups.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    table = reader.load(path)
    return table if split is None else table.where(F.col(split_col) == split)
