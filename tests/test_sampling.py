import hashlib

import pytest
from pyspark.sql import functions as F

from respeval.operators import sampling


def items(spark, sizes):
    rows = [(ds, f"{ds}{i}", i) for ds, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, item_id string, v int")


def expected(sizes, n, seed=42):
    chosen = {}
    for ds, size in sizes.items():
        ids = [f"{ds}{i}" for i in range(size)]
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}|{ds}|{i}".encode()).hexdigest(), i))
        chosen.update({(ds, item): k for k, item in enumerate(ids[:n])})
    return chosen


SIZES = {"hot": 6000, "b": 50, "c": 1}


@pytest.mark.parametrize("n", [1, 100, 1500])
def test_sample_is_exact_and_independent_of_partitioning(spark, n):
    table = items(spark, SIZES)
    for df in (table, table.repartition(13), table.coalesce(1), table.orderBy(F.desc("v"))):
        rows = sampling.fixed_size_sample(df, n).collect()
        assert {(r.dataset, r.item_id): r.sample_index for r in rows} == expected(SIZES, n)


def test_other_seed_gives_other_rows(spark):
    table = items(spark, {"hot": 500})
    one, two = (
        {r.item_id for r in sampling.fixed_size_sample(table, 50, seed=s).collect()} for s in (1, 2)
    )
    assert len(one) == len(two) == 50 and one != two


def test_sample_is_uniform(spark):
    table = items(spark, {"hot": 2000})
    low = 0
    for seed in range(10):
        low += sampling.fixed_size_sample(table, 100, seed=seed).where("v < 1000").count()
    assert 430 < low < 570


def test_rows_without_stratum_are_left_out(spark):
    df = spark.createDataFrame([(None, "x", 1), ("a", "y", 2)], "dataset string, item_id string, v int")
    assert [r.item_id for r in sampling.fixed_size_sample(df).collect()] == ["y"]


def test_missing_ids_become_positions(spark):
    df = spark.createDataFrame(
        [("a", None, i) for i in range(5)] + [("b", "kept", 9)],
        "dataset string, item_id string, v int",
    )
    sample = sampling.fixed_size_sample(df, 3, id_cols=["item_id", "v"])
    rows = sampling.default_item_id(sample).collect()
    assert sorted((r.dataset, r.item_id) for r in rows) == [
        ("a", "0"), ("a", "1"), ("a", "2"), ("b", "kept"),
    ]


def test_manifest_selects_the_sample_again(spark):
    table = items(spark, SIZES)
    manifest = sampling.sample_manifest(table, 20)
    listed = {r.dataset: r.item_ids for r in manifest.collect()}
    assert {ds: len(ids) for ds, ids in listed.items()} == {"hot": 20, "b": 20, "c": 1}
    assert all(ids == sorted(ids) for ids in listed.values())
    again = sampling.select_by_manifest(table, manifest).collect()
    sample = sampling.fixed_size_sample(table, 20).collect()
    assert {r.item_id for r in again} == {r.item_id for r in sample}


def test_rank_limit_is_pushed_below_the_shuffle(spark):
    sample = sampling.fixed_size_sample(items(spark, SIZES), 100)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "row_number(), 100, Partial" in plan


def test_many_ranges_are_joined_by_shuffle(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    rows = sampling.fixed_size_sample(items(spark, SIZES), 1500).collect()
    assert {(r.dataset, r.item_id): r.sample_index for r in rows} == expected(SIZES, 1500)
