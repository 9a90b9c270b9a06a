"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits hot join partitions, picks broadcast joins from
# measured sizes and merges small shuffle partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Put the recommended settings on a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in a folder that all executors share.

    That is the folder ``spark.checkpoint.dir`` names or, where it is unset, one inside the
    warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write the frame to the shared folder now and read it from there.

    Later steps then plan with the size it really has, and losing an executor does not
    cost the work that led to it.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
