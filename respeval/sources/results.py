"""Result and report tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from respeval.schemas import RESULTS, SCORED
from respeval.sources.arrays import array_records, parsed_records

BLOCK = ("model", "arm", "dataset")


def dealt_by_block(rows: DataFrame, block: Sequence[str] = BLOCK) -> DataFrame:
    """The rows of a block brought together, a hot block in several tasks."""
    return rows.hint("rebalance", *block)


def write_results(
    results: DataFrame, path: str, block: Sequence[str] = BLOCK, dealt: bool = False
) -> None:
    """Replace exactly the (model, arm, dataset) blocks the frame holds.

    Blocks that are not in the frame stay as they are, so a run can be repeated or
    continued block by block. A hot block is written by several tasks. Texts make up nearly
    all of the table, so the files are packed with zstd. Pass ``dealt`` if the rows come from
    ``dealt_by_block`` already: what was read from the texts since then is not shuffled.
    """
    (
        (results if dealt else dealt_by_block(results, block))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*block)
        .parquet(path)
    )


def read_results(spark: SparkSession, path: str, scored: bool = False) -> DataFrame:
    """Stored results; ``scored`` if they were written with their flags.

    Block filters prune folders, and only the columns a report needs are read.
    """
    schema = SCORED if scored else RESULTS
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def write_results_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines, which can be split, with nulls kept."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)


REQUIRED = ("model", "arm", "dataset", "dataset_type", "item_id", "confidence", "parse_error")


def read_results_json(
    spark: SparkSession,
    path: str,
    array_file: bool = False,
    arm_col: str = "arm",
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """Results from JSON lines, or from files that each hold one array (read in parts too).

    ``arm_col`` is the name the records have for the arm. A ``required`` column that no
    record has raises, since it would read as NULL throughout; to know, the records are
    read once more when the frame is built. Pass no ``required`` columns to skip that. Array
    files are read when the frame is built, and their records stored.
    """
    fields = [StructField(arm_col, f.dataType) if f.name == "arm" else f for f in RESULTS.fields]
    wanted = {arm_col if name == "arm" else name for name in required}
    if array_file:
        texts = array_records(spark, path)
        records = parsed_records(texts, StructType(fields))
        names = texts.select(F.explode(F.json_object_keys("record"))).distinct()
        held = [row[0] for row in names.collect()] if wanted else []
    else:
        records = spark.read.schema(StructType(fields)).json(path)
        held = spark.read.json(path).columns if wanted else []
    absent = sorted(wanted.difference(held))
    if absent:
        raise ValueError(f"no record in {path} has {', '.join(absent)}")
    return records.withColumnRenamed(arm_col, "arm")


def write_csv(table: DataFrame, path: str) -> None:
    """Report table as CSV with a header; missing numbers are empty cells."""
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(table: DataFrame, path: str) -> None:
    """Report table as JSON lines with explicit nulls."""
    table.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, strata: Sequence[str] = ("dataset",)) -> DataFrame:
    columns = ", ".join(f"{name} string" for name in strata)
    return spark.read.schema(f"{columns}, item_ids array<string>").json(path)


def drop_nan(table: DataFrame) -> DataFrame:
    """NaN in double columns becomes NULL, so that sinks write legal JSON and empty cells."""
    doubles = {name for name, kind in table.dtypes if kind == "double"}
    return table.select(
        *[
            F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c)
            for c in table.columns
        ]
    )
