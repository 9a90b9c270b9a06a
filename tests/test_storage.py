import pytest
import csv
import json
from pathlib import Path

from pyspark.sql import functions as F

from respeval.operators.metrics import group_metrics
from respeval.operators.profile import split_preview, split_profile
from respeval.plans.experiment import score_results
from respeval.schemas import RESPONSES, RESULTS
from respeval.session import work_dir
from respeval.sources import responses, results
from respeval.sources.questions import read_questions
from respeval.streaming.ingest import ingest_responses, stream_response_files

KEYS = [f"{i:064x}" for i in range(5)]


def write_files(folder, keys):
    folder.mkdir(exist_ok=True)
    for i, key in enumerate(keys):
        body = {
            "raw_response": None if i == 0 else f"answer\n{key[-1]}",
            "model": "m",
            "usage": {"prompt_tokens": i, "completion_tokens": 2 * i},
        }
        (folder / f"{key}.json").write_text(json.dumps(body, indent=2))


def test_response_files(spark, tmp_path):
    write_files(tmp_path / "cache", KEYS)
    (tmp_path / "cache" / "notes.json").write_text("{}")
    rows = {r.cache_key: r for r in responses.read_response_files(spark, str(tmp_path / "cache")).collect()}
    assert set(rows) == set(KEYS)
    assert rows[KEYS[0]].raw_response is None
    assert rows[KEYS[3]].raw_response == "answer\n3"
    assert tuple(rows[KEYS[3]].usage) == (3, 6)


def table(spark, rows):
    return spark.createDataFrame(rows, RESPONSES)


def test_append_skips_failures_and_known_keys(spark, tmp_path):
    path = str(tmp_path / "responses")
    batch = table(
        spark,
        [
            (KEYS[0], "m", "a", (1, 1), None),
            (KEYS[0], "m", "b", (1, 1), None),
            (KEYS[1], "m", None, None, "max_retries_exceeded"),
        ],
    )
    responses.append_responses(batch, path)
    responses.append_responses(batch, path, responses.read_responses(spark, path))
    later = table(spark, [(KEYS[1], "m", "c", (2, 2), None), (KEYS[0], "m", "z", (1, 1), None)])
    responses.append_responses(later, path, responses.read_responses(spark, path))
    rows = responses.read_responses(spark, path).collect()
    assert sorted((r.cache_key, r.raw_response) for r in rows) == [(KEYS[0], "a"), (KEYS[1], "c")]


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, path, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    write_files(folder, KEYS[:2])
    for keys in (KEYS[:2], KEYS[:2], KEYS):
        write_files(folder, keys[2:])
        ingest_responses(stream_response_files(spark, str(folder)), path, state).awaitTermination(120)
        got = [r.cache_key for r in responses.read_responses(spark, path).collect()]
        assert sorted(got) == sorted(keys)


def record(model="m", arm="baseline", dataset="d", item="1", confidence=5.0, **more):
    row = dict.fromkeys(RESULTS.fieldNames())
    row.update(
        model=model, arm=arm, dataset=dataset, item_id=item, dataset_type="legitimate",
        confidence=confidence, correct_index=1, parse_error=False, usage=(1, 2),
    )
    row.update(more)
    return tuple(row[name] for name in RESULTS.fieldNames())


def test_blocks_are_replaced_and_others_kept(spark, tmp_path):
    path = str(tmp_path / "results")
    both = [record(arm=a, item=str(i)) for a in ("baseline", "uncertainty") for i in range(3)]
    results.write_results(spark.createDataFrame(both, RESULTS), path)
    results.write_results(
        spark.createDataFrame([record(arm="uncertainty", confidence=1.0)], RESULTS), path
    )
    stored = results.read_results(spark, path)
    assert stored.groupBy("arm").count().orderBy("arm").collect() == [
        ("baseline", 3), ("uncertainty", 1),
    ]
    plan = stored.where("arm = 'baseline'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(arm" in plan


def test_reports_on_stored_flags_read_no_text(spark, tmp_path):
    path = str(tmp_path / "scored")
    rows = [record(item=str(i), confidence=float(i), raw_response="text") for i in range(5)]
    results.write_results(score_results(spark.createDataFrame(rows, RESULTS)), path)
    table = group_metrics(results.read_results(spark, path, scored=True))
    assert table.first().n == 5
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "is_cautious" in plan and "raw_response" not in plan and "reasoning" not in plan


def test_results_json(spark, tmp_path):
    lines, array = str(tmp_path / "lines"), tmp_path / "array.json"
    rows = [record(item="1"), record(item="2", raw_response="x\ny", confidence=None)]
    df = spark.createDataFrame(rows, RESULTS)
    results.write_results_json(df, lines)
    text = "".join(p.read_text() for p in Path(lines).glob("part-*"))
    assert '"confidence":null' in text
    array.write_text("[" + ",\n".join(text.strip().split("\n")) + "]")
    expected = sorted(df.collect(), key=lambda r: r.item_id)
    for got in (
        results.read_results_json(spark, lines),
        results.read_results_json(spark, str(array), array_file=True),
    ):
        assert sorted(got.collect(), key=lambda r: r.item_id) == expected


def test_csv_leaves_missing_numbers_empty(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5), ("n", None), ("o", float("nan"))], "model string, x double")
    results.write_csv(results.drop_nan(df).coalesce(1), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    with part.open() as handle:
        assert list(csv.reader(handle)) == [["model", "x"], ["m", "0.5"], ["n", ""], ["o", ""]]


def test_json_writes_null_for_nan(spark, tmp_path):
    df = spark.createDataFrame([("o", float("nan"))], "model string, x double")
    results.write_json(results.drop_nan(df), str(tmp_path / "json"))
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(text) == {"model": "o", "x": None}


def test_split_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "questions")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 4, "test").otherwise("train"))
    df.write.parquet(path)
    test = read_questions(spark, path, split="test")
    assert test.count() == 4
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(split), EqualTo(split,test)]" in plan


def test_split_profile_and_preview(spark):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 4, "test").otherwise("train"))
    assert {r.split: r.n_rows for r in split_profile(df).collect()} == {"test": 4, "train": 6}
    rows = split_preview(df, ["id"]).collect()
    assert sorted((r.split, r.id) for r in rows) == [
        ("test", 0), ("test", 1), ("test", 2), ("train", 4), ("train", 5), ("train", 6),
    ]


def test_work_dir_is_under_the_shared_folder(spark):
    one, two = work_dir(spark, "x"), work_dir(spark, "x")
    assert one != two
    assert one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_results_without_an_arm_raise(spark, tmp_path):
    from respeval.sources import results

    path = str(tmp_path / "records")
    columns = "model string, condition string, dataset string, dataset_type string, item_id string, confidence double, parse_error boolean"
    spark.createDataFrame([("m", "b", "d", "t", "1", 5.0, False)], columns).write.json(path)
    with pytest.raises(ValueError, match="arm"):
        results.read_results_json(spark, path)
    assert results.read_results_json(spark, path, arm_col="condition").first()["arm"] == "b"


def test_export_holds_successes_once(spark, tmp_path):
    from respeval.sources import responses

    rows = [("a" * 64, "m", "x", None, None), ("b" * 64, "m", None, None, "failed")]
    made = spark.createDataFrame(rows, responses.RESPONSES)
    for _ in range(2):
        responses.write_response_files(made, str(tmp_path / "files"))
    found = responses.read_response_files(spark, str(tmp_path / "files")).collect()
    assert [r["cache_key"] for r in found] == ["a" * 64]


def test_key_lookup_prunes_folders(spark, tmp_path):
    from respeval.sources import responses

    path = str(tmp_path / "table")
    rows = [(f"{i:02x}" * 32, "m", "x" * 2000, None, None) for i in range(64)]
    responses.append_responses(spark.createDataFrame(rows, responses.RESPONSES), path)
    keys = spark.createDataFrame([(rows[7][0],)], "cache_key string").where("cache_key > '0'")
    found = responses.responses_for(keys, responses.read_responses(spark, path, prefix=True))
    assert [r["cache_key"] for r in found.collect()] == [rows[7][0]]
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()
