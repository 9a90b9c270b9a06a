"""The state of every prompt key from the events of its calls.

Events have ``cache_key``, ``attempt_id``, ``at`` (a timestamp) and ``kind``: an attempt is
``started`` and later ``answered`` or ``failed``; one that has neither when its time is up
has failed at that moment. An end that comes after that counts instead. The state is a
function of the events and of the moment ``as_of`` alone, whatever order they came in.

``answered``: some attempt was. ``exhausted``: as many attempts failed as are allowed;
``error`` then says so. ``running``: an attempt is open. ``pending``: the key may be tried
again from ``next_at`` on, which lies the longer after the last failure the more there were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C

STARTED, ANSWERED, FAILED = "started", "answered", "failed"


@dataclass(frozen=True)
class RetryRule:
    """Allowed attempts, seconds until an open one has failed, and the first pause, which doubles."""

    limit: int = 5
    timeout: float = 120.0
    pause: float = 1.0


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def attempt_ledger(events: DataFrame, as_of: Column, rule: RetryRule = RetryRule()) -> DataFrame:
    """One row per key: ``attempts``, ``failures``, ``status``, ``error`` and ``next_at``.

    ``as_of`` and ``next_at`` are microseconds since 1970. Events without key, attempt or time
    are left out, repeated ones count once. Two aggregations share one shuffle by key: the
    events of an attempt shrink in their tasks first, and so do a key's attempts.
    """
    ended = F.col("kind").isin(ANSWERED, FAILED)
    at = micros(F.col("at"))
    usable = events.where("cache_key IS NOT NULL AND attempt_id IS NOT NULL AND at IS NOT NULL")
    each = usable.where(ended | (F.col("kind") == STARTED)).groupBy("cache_key", "attempt_id").agg(
        F.min(F.when(F.col("kind") == STARTED, at)).alias("started"),
        F.min(F.when(ended, F.struct(at.alias("at"), F.col("kind").alias("kind")))).alias("end"),
    )
    expires = F.col("started") + F.lit(round(rule.timeout * 1e6))
    over = F.col("end").isNull() & (expires < as_of)
    failed_at = F.when(F.col("end.kind") == FAILED, F.col("end.at")).when(over, expires)
    counted = each.select("cache_key", F.col("end.kind").alias("kind"), over.alias("over"), failed_at.alias("failed_at"))
    keys = counted.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count("failed_at").alias("failures"),
        F.count_if(F.col("kind").isNull() & ~F.col("over")).alias("open"),
        F.count_if(F.col("kind") == ANSWERED).alias("answers"),
        F.max("failed_at").alias("last"),
    )
    status = (
        F.when(F.col("answers") > 0, "answered")
        .when(F.col("failures") >= rule.limit, "exhausted")
        .when(F.col("open") > 0, "running")
        .otherwise("pending")
    )
    pause = F.lit(round(rule.pause * 1e6)) * F.pow(F.lit(2.0), F.col("failures") - 1).cast("long")
    return keys.withColumn("status", status).select(
        "cache_key",
        "attempts",
        "failures",
        "status",
        F.when(F.col("status") == "exhausted", F.lit(C.NO_RESPONSE_ERROR)).alias("error"),
        F.when(F.col("status") == "pending", F.col("last") + pause).alias("next_at"),
    )


def due_prompts(pending: DataFrame, ledger: DataFrame, as_of: Column) -> DataFrame:
    """Pending prompts that may be asked now: never tried, or their pause is over."""
    waits = ledger.where((F.col("status") != "pending") | (F.col("next_at") > as_of))
    return pending.join(waits.select("cache_key"), "cache_key", "left_anti")
