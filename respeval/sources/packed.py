"""Stored responses packed into files of bounded size, with a commit log and a key index.

A table is a folder of three: ``data`` holds Parquet files, ``log`` says which of them make
up a version, ``index`` has a sketch of each file's keys. A commit is one log file, put in
place at the end of a Spark job: whatever was written before a run broke is not in the log
and so is never read. A batch has a name, and one whose name is in the log is not taken
again. Packing replaces small files by files in key order; a reader goes on with the files
of the version it began with, which stay where they are. One writer at a time.

The sketch is a bitmap of 2**26 bits per file, one bit per key by hash, of which only words
with a bit are stored. A key is in a file only if its bit is set, so an append reads the
keys of just those files that may hold one of its own.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.operators.matching import one_per_key
from respeval.schemas import RESPONSES
from respeval.session import stored

TARGET_ROWS = 1_000_000
_LOG = "version long, batch string, file string, rows long, live boolean"
_INDEX = "file string, word long, bits long"
_WORDS = 1 << 20


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Every commit's files: added ones are ``live``, replaced ones are not."""
    return _read(spark, f"{path}/log", _LOG)


def live_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``file`` and ``rows`` of the files that make up a version, the latest by default."""
    log = commit_log(spark, path).where(F.col("file").isNotNull())
    log = log if version is None else log.where(F.col("version") <= version)
    last = log.groupBy("file").agg(F.max_by("live", "version").alias("live"), F.max("rows").alias("rows"))
    return last.where("live").select("file", "rows")


def last_version(spark: SparkSession, path: str) -> int:
    return commit_log(spark, path).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).head()["v"]


def _names(files: DataFrame) -> list[str]:
    """File names, which any scan lists on the driver as well."""
    return sorted(row["file"] for row in files.select("file").collect())


def read_packed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The responses of a version. The files are fixed when the frame is made."""
    return _rows_of(spark, path, _names(live_files(spark, path, version)))


def _rows_of(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], RESPONSES)
    return spark.read.schema(RESPONSES).parquet(*[f"{path}/{name}" for name in names])


def _place(key: Column) -> tuple[Column, Column]:
    """Word and bit of a key in a file's sketch."""
    hashed = F.xxhash64(key)
    bit = F.shiftrightunsigned(hashed, 20).bitwiseAND(F.lit(63)).cast("int")
    return hashed.bitwiseAND(F.lit(_WORDS - 1)).alias("word"), bit.alias("bit")


def _write(rows: DataFrame, path: str, target_rows: int, in_order: int | None = None) -> DataFrame:
    """Write files of ``target_rows`` at most, and their sketches; gives their names and rows."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    dealt = rows.hint("rebalance") if in_order is None else rows.repartitionByRange(in_order, "cache_key")
    dealt.write.option("maxRecordsPerFile", target_rows).parquet(f"{path}/data/{folder}")
    name = F.concat(F.lit(f"data/{folder}/"), F.col("_metadata.file_name"))
    word, bit = _place(F.col("cache_key"))
    written = spark.read.schema(RESPONSES).parquet(f"{path}/data/{folder}").select(name.alias("file"), word, bit)
    one = F.expr("shiftleft(CAST(1 AS BIGINT), bit)")
    sketch = written.groupBy("file", "word").agg(F.bit_or(one).alias("bits"), F.count(F.lit(1)).alias("rows"))
    sketch = stored(sketch, "sketch")
    sketch.select("file", "word", "bits").repartitionByRange("word").sortWithinPartitions("word").write.parquet(
        f"{path}/index/folder={folder}"
    )
    return sketch.groupBy("file").agg(F.sum("rows").alias("rows")).select("file", "rows", F.lit(True).alias("live"))


def _commit(files: DataFrame, path: str, version: int, batch: str) -> None:
    spark = files.sparkSession
    mark = spark.createDataFrame([(None, None, None)], "file string, rows long, live boolean")
    rows = files.unionByName(mark).select(
        F.lit(version).cast("long").alias("version"), F.lit(batch).alias("batch"), "file", "rows", "live"
    )
    rows.coalesce(1).write.mode("append").parquet(f"{path}/log")


def files_that_may_hold(keys: DataFrame, path: str) -> list[str]:
    """Live files whose sketch has the bit of at least one key; no key of a file is read."""
    spark = keys.sparkSession
    live = stored(live_files(spark, path), "live-files")
    folders = live.select(F.split_part("file", F.lit("/"), F.lit(2)).alias("folder")).distinct()
    folders = [row["folder"] for row in folders.collect()]
    if not folders:
        return []
    index = _read(spark, f"{path}/index", f"{_INDEX}, folder string").where(F.col("folder").isin(folders))
    word, bit = _place(F.col("cache_key"))
    asked = keys.where(F.col("cache_key").isNotNull()).select(word, bit).groupBy("word")
    asked = asked.agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), bit)")).alias("asked"))
    met = index.join(asked, "word").where(F.col("bits").bitwiseAND(F.col("asked")) != 0)
    return _names(met.select("file").distinct().join(live, "file", "left_semi"))


def append_packed(new: DataFrame, path: str, batch: str, target_rows: int = TARGET_ROWS) -> bool:
    """Add a batch's successful responses whose keys are new, one row per key.

    Returns False, and changes nothing, if the batch was taken before.
    """
    spark = new.sparkSession
    if not commit_log(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    good = new.where(F.col("error").isNull() & F.col("cache_key").isNotNull())
    fresh = stored(one_per_key(good.select(*RESPONSES.fieldNames())), "batch").select(*RESPONSES.fieldNames())
    near = files_that_may_hold(fresh, path)
    if near:
        fresh = fresh.join(_rows_of(spark, path, near).select("cache_key"), "cache_key", "left_anti")
    _commit(_write(fresh.select(*RESPONSES.fieldNames()), path, target_rows), path, last_version(spark, path) + 1, batch)
    return True


def pack(spark: SparkSession, path: str, target_rows: int = TARGET_ROWS) -> int:
    """Replace files below half the target by files of the target size in key order.

    Returns the number of files replaced. The rows read and written are those of small files.
    """
    small = stored(live_files(spark, path).where(F.col("rows") * 2 < target_rows), "small-files")
    count, rows = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).head()
    if count < 2:
        return 0
    files = -(-rows // target_rows)
    made = _write(_rows_of(spark, path, _names(small)), path, target_rows, in_order=max(1, files))
    _commit(
        made.unionByName(small.withColumn("live", F.lit(False))),
        path, last_version(spark, path) + 1, f"pack-{uuid.uuid4().hex}",
    )
    return count
