"""Findings of round 3: what made queries slow or heavy on larger tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_attempts import RULE, SCHEMA, START, drawn, found, micros, plain

from catalog.queries import QUERIES, _records
from respeval.operators import matching
from respeval.sources import responses, results
from respeval.streaming.attempts import keep_ledger, ledger_changes, read_ledger


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("groups", [1, 3])
def test_ledger_state_is_kept_per_group_of_keys(spark, tmp_path, groups):
    """Each micro-batch holds some keys; others of their group run out of time meanwhile."""
    folder, table, state = (str(tmp_path / n) for n in ("events", "ledger", "state"))
    (tmp_path / "events").mkdir()
    stream = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(folder)
    seen = []
    for step in range(3):
        shift = dt.timedelta(seconds=2500 * step)
        fresh = [(f"{step}-{key}", attempt, at + shift, kind) for key, attempt, at, kind in drawn(step, keys=15)]
        # An attempt that is open at the end of this step and over in the next.
        fresh.append((f"open-{step}", "a", max(e[2] for e in fresh), "started"))
        spark.createDataFrame(fresh, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        seen += fresh
        query = keep_ledger(ledger_changes(stream, RULE, "30 seconds", groups), table, state)
        query.awaitTermination()
        as_of = micros(max(e[2] for e in seen)) // 1000 * 1000 - 30_000_000
        assert found(read_ledger(spark, table)) == plain(seen, as_of)
        rows = [o["numRowsTotal"] for p in query.recentProgress for o in json.loads(p.json)["stateOperators"]]
        assert max(rows) <= groups


@pytest.mark.parametrize("direct", [True, False])
def test_response_files_need_no_folder_each(spark, tmp_path, monkeypatch, direct):
    """Tasks put files in place; a key's earlier file, in either form, is replaced."""
    folder = tmp_path / "files"
    keys = [f"{i:064x}" for i in range(40)]

    def put(answer, among):
        rows = [(k, "m", None if k == keys[0] else f"{answer}\n{k[-1]} é", (1, 2), None) for k in among]
        rows += [("../../x", "m", "odd", None, None), (None, "m", "no key", None, None), (keys[9], "m", "z", None, "failed")]
        responses.write_response_files(spark.createDataFrame(rows, responses.RESPONSES), str(folder))

    with monkeypatch.context() as patch:
        patch.setattr(responses, "_local_path", lambda *_: None)
        put("old", keys[:20])
    if not direct:
        monkeypatch.setattr(responses, "_local_path", lambda *_: None)
    put("new", keys[10:])
    put("new", keys[30:])
    found = {r["cache_key"]: r for r in responses.read_response_files(spark, str(folder)).collect()}
    assert sorted(found) == keys and found[keys[0]]["raw_response"] is None
    assert [found[k]["raw_response"].split("\n")[0] for k in keys[1:]] == ["old"] * 9 + ["new"] * 30
    assert found[keys[39]]["raw_response"] == f"new\n{keys[39][-1]} é" and tuple(found[keys[39]]["usage"]) == (1, 2)
    assert len(list(folder.rglob("*.json"))) == 41  # the odd key's file is in the folder too
    if direct:
        assert len(list(folder.glob("cache_key=*"))) == 10
        assert json.loads((folder / f"prefix={keys[0][:2]}" / f"{keys[20]}.json").read_text())["model"] == "m"
        assert not [p for p in folder.rglob(".*") if not p.name.endswith(".crc") and ".json" not in p.name]


def test_array_files_are_put_together_once(spark, tmp_path):
    rows = [{"model": "m", "item_id": str(i), "reasoning": '}{"[' * i, "usage": {"prompt_tokens": i}} for i in range(20)]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    found = results.read_results_json(spark, str(tmp_path), array_file=True, required=("model", "item_id"))
    assert not [f for f in found.inputFiles() if f.endswith("array.json")]
    assert sorted((int(r.item_id), r.reasoning) for r in found.collect()) == [(i, '}{"[' * i) for i in range(20)]


def test_pending_prompts_shuffle_packed_keys_and_no_text(spark):
    keys = [None, "", "a" * 32, "a" * 64, "A" * 64, "b" * 64, "\x00" + "a" * 31, "é", "0" * 63, "b" * 64]
    asked = spark.createDataFrame([(k, "m") for k in keys], "cache_key string, model string")
    answers = asked.where(F.col("cache_key").isin("a" * 64, "é") | F.col("cache_key").isNull())
    waiting = [r["cache_key"] for r in matching.pending_prompts(asked, answers, ("model",)).collect()]
    expected = {None, "", "a" * 32, "A" * 64, "b" * 64, "\x00" + "a" * 31, "0" * 63}
    assert set(waiting) == expected and len(waiting) == len(expected)
    plan = QUERIES["pending_prompts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(user_md5" in plan and "first(user#" not in plan


def test_results_are_dealt_before_texts_are_read(spark, tmp_path):
    records = _records(spark, SMALL, dealt=True)
    plan = records._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = next(i for i, line in enumerate(plan) if "RebalancePartitions" in line)
    assert any("from_json" in line for line in plan[:dealt]) and not any("from_json" in line for line in plan[dealt:])
    for name, rows, is_dealt in (("plain", _records(spark, SMALL), False), ("dealt", records, True)):
        results.write_results(rows, str(tmp_path / name), dealt=is_dealt)
    plain, other = (results.read_results(spark, str(tmp_path / name)) for name in ("plain", "dealt"))
    assert plain.count() == records.count() and plain.exceptAll(other).isEmpty() and other.exceptAll(plain).isEmpty()
    assert all(p.name.endswith(".zstd.parquet") for p in (tmp_path / "dealt").rglob("part-*"))
