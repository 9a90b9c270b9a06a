"""Packed response tables: commits, replays, broken runs, packing, and the key index."""

import pytest
from pyspark.sql import functions as F

from respeval.schemas import RESPONSES
from respeval.sources import packed
from respeval.streaming.ingest import ingest_packed, stream_response_files
from respeval.sources.responses import write_response_files


def responses(spark, first, last, model="m"):
    return spark.range(first, last).select(
        F.sha2(F.col("id").cast("string"), 256).alias("cache_key"),
        F.lit(model).alias("model"),
        F.concat(F.lit("text "), "id").alias("raw_response"),
        F.struct(F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens")).alias("usage"),
        F.lit(None).cast("string").alias("error"),
    )


def keys(frame):
    held = sorted(r["cache_key"] for r in frame.select("cache_key").collect())
    assert len(held) == len(set(held))
    return held


def files(spark, path):
    return {r["file"]: r["rows"] for r in packed.live_files(spark, path).collect()}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def test_batches_replays_and_packing(spark, path):
    assert packed.read_packed(spark, path).collect() == []
    for i in range(6):
        assert packed.append_packed(responses(spark, 100 * i, 100 * i + 150), path, f"b{i}", 400)
    assert not packed.append_packed(responses(spark, 9000, 9010), path, "b3", 400)
    whole = keys(responses(spark, 0, 650))
    assert keys(packed.read_packed(spark, path)) == whole
    # A key that came again kept its first response; failed calls and null keys are not stored.
    bad = responses(spark, 700, 720).withColumn("error", F.lit("late"))
    nameless = responses(spark, 800, 801).withColumn("cache_key", F.lit(None).cast("string"))
    again = responses(spark, 0, 10, "other").unionAll(bad).unionAll(nameless)
    assert packed.append_packed(again, path, "again", 400)
    assert packed.read_packed(spark, path).where("model = 'other'").count() == 0
    before, version = files(spark, path), packed.last_version(spark, path)
    old = packed.read_packed(spark, path)
    assert packed.pack(spark, path, 400) == len(before)
    after = files(spark, path)
    assert not before.keys() & after.keys() and max(after.values()) <= 400 and sum(after.values()) == 650
    assert len(after) <= 4 < len(before)
    # A reader that began before goes on, and an earlier version can still be read.
    assert keys(old) == keys(packed.read_packed(spark, path, version)) == keys(packed.read_packed(spark, path)) == whole
    assert packed.read_packed(spark, path).schema == RESPONSES
    assert packed.pack(spark, path, 2) == 0


def test_a_broken_run_changes_nothing(spark, path, monkeypatch):
    packed.append_packed(responses(spark, 0, 50), path, "one", 400)
    with monkeypatch.context() as m:
        m.setattr(packed, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        for work in (
            lambda: packed.append_packed(responses(spark, 50, 90), path, "two", 400),
            lambda: packed.append_packed(responses(spark, 10, 95), path, "two", 400),
        ):
            with pytest.raises(RuntimeError):
                work()
    assert keys(packed.read_packed(spark, path)) == keys(responses(spark, 0, 50))
    assert packed.append_packed(responses(spark, 50, 90), path, "two", 400)
    with monkeypatch.context() as m:
        m.setattr(packed, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            packed.pack(spark, path, 400)
    assert keys(packed.read_packed(spark, path)) == keys(responses(spark, 0, 90))


def test_index_names_only_files_that_may_hold_a_key(spark, path):
    for i in range(5):
        packed.append_packed(responses(spark, 100 * i, 100 * i + 100), path, f"b{i}", 400)
    asked = responses(spark, 120, 125).unionAll(responses(spark, 5000, 5020))
    (name,) = packed.files_that_may_hold(asked, path)
    held = spark.read.parquet(f"{path}/{name}")
    assert held.join(asked, "cache_key", "left_semi").count() == 5
    assert packed.files_that_may_hold(responses(spark, 6000, 6050), path) == []


def test_stream_into_a_packed_table(spark, tmp_path, path):
    folder, state = str(tmp_path / "files"), str(tmp_path / "state")
    for first, last in ((0, 20), (10, 30)):
        write_response_files(responses(spark, first, last), folder)
        ingest_packed(stream_response_files(spark, folder), path, state).awaitTermination()
    assert keys(packed.read_packed(spark, path)) == keys(responses(spark, 0, 30))
