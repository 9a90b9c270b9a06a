"""Response files taken into the response table as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from respeval.schemas import RESPONSE_FILE
from respeval.sources.packed import append_packed
from respeval.sources.responses import append_responses, key_from_path, read_responses


# What opening a small file costs, in bytes read meanwhile. Spark presumes 4 MB, so a task gets 32
# files at most, and a batch of response files as many tasks as there are files by 32.
OPEN_COST = 64 * 1024
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING_TASKS_PER_CORE = 8


def _for_small_files(spark: SparkSession) -> SparkSession:
    """A session like this one that lists and reads many small files in tasks of some seconds.

    The file source lists the files of a batch once more by their paths, and the last batch's
    when it is started again. Spark makes that up to 10,000 tasks, whatever there is to do.
    """
    session = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    tasks = _LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    session.conf.set(_LISTING, min(tasks, int(spark.conf.get(_LISTING))))
    cost = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    session.conf.set("spark.sql.files.openCostInBytes", min(OPEN_COST, cost))
    # No batch's listing is asked for again, so the driver need not keep it by path.
    session.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", 0)
    return session


def stream_response_files(spark: SparkSession, folder: str) -> DataFrame:
    """New response files in ``folder``, each read once.

    The source has settings of its own for many small files; the query runs with those of ``spark``.
    """
    files = (
        _for_small_files(spark).readStream.schema(RESPONSE_FILE)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .json(folder)
    )
    plan = files._jdf.logicalPlan()
    files = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    return key_from_path(files).where(F.col("cache_key") != "")


def ingest_responses(
    stream: DataFrame, table: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append each micro-batch; a batch replayed after a failure adds nothing twice."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = read_responses(spark, table, prefix=True)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None  # the first batch creates the table
        append_responses(batch, table, known)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingest_packed(
    stream: DataFrame, table: str, checkpoint: str, name: str = "stream", available_now: bool = True
) -> StreamingQuery:
    """Append each micro-batch to a packed table under ``name`` and its number.

    A batch replayed after a failure is found in the commit log and changes nothing.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        append_packed(batch, table, f"{name}-{batch_id}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
