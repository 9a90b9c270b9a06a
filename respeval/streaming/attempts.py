"""The attempt ledger kept up to date from a stream of call events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from respeval import constants as C
from respeval.operators.attempts import ANSWERED, FAILED, STARTED, RetryRule, micros

LEDGER = "cache_key string, attempts long, failures long, status string, error string, next_at long"
_STATE = "keys array<string>, ids array<string>, started array<long>, ended array<long>, kinds array<string>, as_of long"
#: Keys are dealt to so many groups by hash; a call of the state function costs as much as thousands of keys.
GROUPS = 1024


def key_state(key: str, attempts: dict, as_of: int, rule: RetryRule) -> tuple[dict, int | None]:
    """A ledger row from a key's attempts (started, ended, kind), and when it next changes."""
    limit = round(rule.timeout * 1e6)
    failed, running, answered = [], [], False
    for started, ended, kind in attempts.values():
        if kind is not None:
            answered |= kind == ANSWERED
            failed += [ended] if kind == FAILED else []
        else:
            (failed if started + limit < as_of else running).append(started + limit)
    exhausted = not answered and len(failed) >= rule.limit
    status = "answered" if answered else "exhausted" if exhausted else "running" if running else "pending"
    pause = round(rule.pause * 1e6) * 2 ** (len(failed) - 1) if failed else 0
    row = {
        "cache_key": key,
        "attempts": len(attempts),
        "failures": len(failed),
        "status": status,
        "error": C.NO_RESPONSE_ERROR if exhausted else None,
        "next_at": max(failed) + pause if status == "pending" else None,
    }
    return row, min(running, default=None)


def ledger_changes(
    events: DataFrame, rule: RetryRule = RetryRule(), lateness: str = "1 hour", groups: int = GROUPS
) -> DataFrame:
    """Ledger rows of keys whose events came in or whose open attempts ran out of time.

    ``as_of`` is the watermark: the latest event time less ``lateness``. Events later than that
    are not seen. State and time-outs are kept per group of keys, of which there are ``groups``:
    a group's state holds the attempts of its keys and is written anew when one of them changes,
    so give more for hundreds of millions of keys. A checkpoint belongs to one number of groups.
    """

    limit = round(rule.timeout * 1e6)

    def change(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *columns, before = state.get if state.exists else ([], [], [], [], [], 0)
        held: dict[str, dict] = {}
        for name, attempt, *times in zip(*columns):
            held.setdefault(name, {})[attempt] = tuple(times)
        told = set()
        if not state.hasTimedOut:
            for frame in frames:
                rows = zip(frame["cache_key"], frame["attempt_id"], frame["micros"].tolist(), frame["kind"])
                for name, attempt, at, kind in rows:
                    attempts = held.setdefault(name, {})
                    begun, end, outcome = attempts.get(attempt, (None, None, None))
                    if kind == STARTED:
                        begun = at if begun is None else min(begun, at)
                    elif end is None or (at, kind) < (end, outcome):
                        end, outcome = at, kind
                    attempts[attempt] = (begun, end, outcome)
                    told.add(name)
        as_of = state.getCurrentWatermarkMs()
        changed, next_changes = [], []
        for name, attempts in held.items():
            # Rows of other keys change only by attempts that ran out of time since the last call.
            ends = [begun + limit for begun, _, kind in attempts.values() if kind is None]
            if name in told or any(before * 1000 <= end < as_of * 1000 for end in ends):
                changed.append(key_state(name, attempts, as_of * 1000, rule)[0])
            next_changes += [end for end in ends if end >= as_of * 1000]
        flat = [(name, attempt, *times) for name, attempts in held.items() for attempt, times in attempts.items()]
        state.update((*(list(c) for c in zip(*flat)), as_of))
        if next_changes:
            # A time-out fires once the watermark has passed it.
            state.setTimeoutTimestamp(max(min(next_changes) // 1000, as_of + 1))
        if changed:
            yield pd.DataFrame(changed).astype({"next_at": "Int64", "error": object})

    usable = events.where("cache_key IS NOT NULL AND attempt_id IS NOT NULL AND at IS NOT NULL")
    usable = usable.where(F.col("kind").isin(STARTED, ANSWERED, FAILED))
    group = F.pmod(F.xxhash64("cache_key"), F.lit(groups)).alias("group")
    return (
        usable.select(group, "cache_key", F.col("attempt_id").cast("string"), "at", "kind", micros(F.col("at")).alias("micros"))
        .withWatermark("at", lateness)
        .groupBy("group")
        .applyInPandasWithState(change, LEDGER, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    )


def keep_ledger(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's changes to a folder of its own; a replay writes the same one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = changes.writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of every key."""
    rows = spark.read.schema(f"{LEDGER}, batch long").parquet(table)
    columns = [c for c in rows.columns if c not in ("cache_key", "batch")]
    return rows.groupBy("cache_key").agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("cache_key", "row.*")
