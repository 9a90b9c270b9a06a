"""Retry state from call events: plain replay, batch form, stream form."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from respeval.operators.attempts import RetryRule, attempt_ledger, due_prompts
from respeval.streaming.attempts import keep_ledger, ledger_changes, read_ledger

SCHEMA = "cache_key string, attempt_id string, at timestamp, kind string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
RULE = RetryRule(limit=5, timeout=60, pause=2)


def micros(at):
    return (at - START) // dt.timedelta(microseconds=1) + int(START.timestamp() * 1e6)


def plain(events, as_of, rule=RULE):
    tries = collections.defaultdict(lambda: collections.defaultdict(lambda: [None, None]))
    for key, attempt, at, kind in events:
        if None in (key, attempt, at) or kind not in ("started", "answered", "failed"):
            continue
        one = tries[key][attempt]
        if kind == "started":
            one[0] = at if one[0] is None else min(one[0], at)
        else:
            one[1] = (at, kind) if one[1] is None else min(one[1], (at, kind))
    rows = {}
    for key, attempts in tries.items():
        failed, waiting, answered = [], 0, False
        for started, end in attempts.values():
            late = end is None and micros(started) + rule.timeout * 1e6 < as_of
            answered |= end is not None and end[1] == "answered"
            if late or (end and end[1] == "failed"):
                failed.append(micros(end[0]) if end else micros(started) + int(rule.timeout * 1e6))
            waiting += end is None and not late
        status = "answered" if answered else "exhausted" if len(failed) >= rule.limit else "running" if waiting else "pending"
        next_at = max(failed) + int(rule.pause * 1e6) * 2 ** (len(failed) - 1) if status == "pending" else None
        error = "max_retries_exceeded" if status == "exhausted" else None
        rows[key] = (len(attempts), len(failed), status, error, next_at)
    return rows


def drawn(seed, keys=40, seconds=2000):
    rng, events = random.Random(seed), []
    for key in range(keys):
        at = rng.uniform(0, seconds)
        for attempt in range(rng.randint(1, 7)):
            started = START + dt.timedelta(seconds=at)
            events.append((f"k{key}", f"{key}-{attempt}", started, "started"))
            at += rng.uniform(1, 90)
            kind = rng.choices(["failed", "answered", None], [6, 1, 3])[0]
            if kind:
                events.append((f"k{key}", f"{key}-{attempt}", START + dt.timedelta(seconds=at), kind))
    return sorted(events, key=lambda e: e[2])


def found(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("offset", [-1500, -100, 0, 10_000])
def test_batch(spark, offset):
    events = drawn(1)
    as_of = micros(events[-1][2]) + offset * 1_000_000
    odd = [(None, "a", START, "failed"), ("x", None, START, "failed"), ("x", "a", None, "failed"), ("x", "a", START, "seen"), events[0]]
    df = spark.createDataFrame(events + odd, SCHEMA)
    assert found(attempt_ledger(df.repartition(5), F.lit(as_of), RULE)) == plain(events, as_of)


def test_five_failures_and_fewer(spark):
    events = [
        (key, f"{key}{i}", START + dt.timedelta(seconds=10 * i), kind)
        for key, n in (("four", 4), ("five", 5))
        for i in range(n)
        for kind in ("started", "failed")
    ]
    as_of = micros(START) + 40_000_000
    ledger = attempt_ledger(spark.createDataFrame(events, SCHEMA), F.lit(as_of), RULE)
    rows = found(ledger)
    assert rows["five"] == (5, 5, "exhausted", "max_retries_exceeded", None)
    assert rows["four"] == (4, 4, "pending", None, micros(START) + 30_000_000 + 16_000_000)
    pending = spark.createDataFrame([("four",), ("five",), ("new",)], "cache_key string")
    due = lambda t: sorted(r[0] for r in due_prompts(pending, ledger, F.lit(t)).collect())
    assert due(as_of) == ["new"] and due(as_of + 6_000_000) == ["four", "new"]


def test_stream_agrees_with_batch(spark, tmp_path):
    """Events come in several micro-batches in time order, with a restart in between."""
    events = drawn(2)
    folder, table, state = (str(tmp_path / n) for n in ("events", "ledger", "state"))
    (tmp_path / "events").mkdir()
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(folder)
    step = -(-len(events) // 3)
    for at in range(0, len(events), step):
        spark.createDataFrame(events[at : at + step], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        changes = ledger_changes(stream, RULE, lateness="30 seconds")
        keep_ledger(changes, table, state).awaitTermination()
        seen = events[: at + step]
        as_of = micros(seen[-1][2]) // 1000 * 1000 - 30_000_000
        batch = attempt_ledger(spark.createDataFrame(seen, SCHEMA), F.lit(as_of), RULE)
        assert found(read_ledger(spark, table)) == found(batch) == plain(seen, as_of)
