"""Report state kept per block, so that a report follows a result table block by block.

The state is a table of report cells with the folders of the result table. Each block's
cells carry a fingerprint of the files they were made from. A refresh compares fingerprints,
which takes file footers only, and makes cells anew for the blocks whose files have changed
since, reading no other block. It can be repeated or broken off at any time: a block's cells
are replaced together with their fingerprint, and what is still old is found again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from respeval.plans.analysis import CELL, Analysis, score_cells
from respeval.schemas import SCORED
from respeval.session import stored
from respeval.sources.results import BLOCK, read_results

_STATE = StructType(
    [f for name in CELL for f in SCORED.fields if f.name == name]
    + [StructField("rows", LongType()), StructField("source", StringType())]
)


def _block_key() -> Column:
    return F.to_json(F.struct(*BLOCK))


def block_sources(spark: SparkSession, results_path: str) -> DataFrame:
    """``block`` and ``source``, a fingerprint of its files, for every block of a result table."""
    files = spark.read.schema(SCORED).parquet(results_path).select(
        _block_key().alias("block"),
        F.struct("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").alias("file"),
    )
    each = files.distinct().groupBy("block")
    mark = F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(F.xxhash64("file")), F.bit_xor(F.xxhash64(F.lit(1), "file")))
    return each.agg(mark.alias("source"))


def _read_state(spark: SparkSession, cells_path: str) -> DataFrame:
    try:
        return spark.read.schema(_STATE).parquet(cells_path).select(*_STATE.fieldNames())
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STATE)


def blocks_of(spark: SparkSession, results_path: str, blocks: Sequence[str]) -> DataFrame:
    """The scored rows of the named blocks; the scan lists only their folders."""
    return read_results(spark, results_path, scored=True).where(_block_key().isin(list(blocks)))


def refresh_cells(spark: SparkSession, results_path: str, cells_path: str) -> list[str]:
    """Bring the cells up to date with the result table; returns the blocks made anew.

    Only the names of changed blocks come to the driver, as many as folders were rewritten.
    Cells of a block that has gone are replaced by none. One refresh at a time.
    """
    now = stored(block_sources(spark, results_path), "block-sources")
    state = _read_state(spark, cells_path).where(F.col("source").isNotNull())
    known = stored(state.select(_block_key().alias("block"), "source", *BLOCK).distinct(), "block-sources")
    changed = now.join(known, ["block", "source"], "left_anti")
    names = sorted(row["block"] for row in changed.select("block").collect())
    if names:
        fresh = score_cells(blocks_of(spark, results_path, names)).withColumn("block", _block_key())
        _replace(fresh.join(now, "block").select(*_STATE.fieldNames()), cells_path)
    gone = stored(known.join(now, "block", "left_anti"), "gone-blocks")
    if not gone.isEmpty():
        left = {"rows": F.lit(0).cast("long"), **{name: F.col(name) for name in BLOCK}}
        empty = [left.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in _STATE.fields]
        _replace(gone.select(*empty), cells_path)
    return names


def _replace(cells: DataFrame, cells_path: str) -> None:
    (
        cells.hint("rebalance", *BLOCK)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*BLOCK)
        .parquet(cells_path)
    )


def read_cells(spark: SparkSession, cells_path: str) -> DataFrame:
    """The cells of all blocks, merged: what ``score_cells`` makes of the whole result table."""
    return _read_state(spark, cells_path).where("rows > 0").drop("source")


def report_of_cells(spark: SparkSession, cells_path: str) -> Analysis:
    """The report, from the cells as they stand; no result is read."""
    return Analysis(read_cells(spark, cells_path))
