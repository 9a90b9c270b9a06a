"""Findings of round 4: what made queries slow or heavy on larger tables."""

import json
import random

import pyarrow as pa
import pytest

from respeval.sources import arrays, responses
from respeval.streaming import ingest


def test_a_batch_of_files_is_few_tasks(spark, conf, tmp_path):
    """Neither listing a batch's files nor reading them takes tasks by the number of files."""
    folder, table, state = (tmp_path / name for name in ("files", "table", "state"))
    folder.mkdir()
    keys = [f"{i:064x}" for i in range(300)]
    for key in keys:
        (folder / f"{key}.json").write_text(json.dumps({"raw_response": f"{key}\n", "model": "m"}))
    conf(spark__sql__files__maxPartitionBytes="16m")
    settings = ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(name) for name in settings]
    tracker, most = spark.sparkContext.statusTracker(), 8 * spark.sparkContext.defaultParallelism
    for some in (keys, [*keys, "f" * 64]):
        (folder / f"{some[-1]}.json").write_text(json.dumps({"raw_response": f"{some[-1]}\n", "model": "m"}))
        query = ingest.ingest_responses(ingest.stream_response_files(spark, str(folder)), str(table), str(state))
        query.awaitTermination()
        stages = [s for job in tracker.getJobIdsForGroup(query.runId) for s in tracker.getJobInfo(job).stageIds]
        tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
        assert tasks and max(tasks) <= most < len(keys) // 4
        found = {r["cache_key"]: r["raw_response"] for r in responses.read_responses(spark, str(table)).collect()}
        assert found == {key: f"{key}\n" for key in some}
    assert before == [spark.conf.get(name) for name in settings]


def naive(files):
    """Records of the files' texts, character by character."""
    found = []
    for text in files:
        record, inside, depth, at = "", False, 0, 0
        text += "" if text.endswith("}") else "}"
        while at < len(text):
            now = text[at]
            if now == "\\":
                now, at = text[at : at + 2], at + 1
            inside ^= now == '"'
            depth += {"{": 1, "}": -1}.get(now, 0) * (not inside)
            record, at = record + now, at + 1
            if record[-1] == "}" and not inside and depth == 0:
                found, record = [*found, record], ""
    return found


@pytest.mark.parametrize("seed", range(40))
def test_parts_of_array_files_are_cut_where_records_end(monkeypatch, seed):
    """Any text, cut into parts and batches anywhere, in small chunks."""
    rng = random.Random(seed)
    monkeypatch.setattr(arrays, "CHUNK", rng.choice([1, 7, 60]))
    marks = ['"', "\\", "}", "{", "{", "a", "é", " ", "\\\\", '\\"', "{}", '{"a":"}"}', "\n,"]
    files = ["".join(rng.choices(marks, k=rng.randrange(120))) for _ in range(4)]
    rows = []
    for name, text in enumerate(files):
        part = 0
        for at, piece in enumerate((text if text.endswith("}") else text + "}")[:-1].split("}")):
            part = at * 10 if rng.random() < 0.2 else part
            rows.append((f"f{name}", part, piece + "}"))

    def batches(some):
        while some:
            n = rng.randrange(1, 9)
            head, some = some[:n], some[n:]
            arrays_of = [pa.array(list(x), kind) for x, kind in zip(zip(*head), (pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays_of, ["file", "part", "piece"])

    starts, last = {}, {}
    for batch in arrays._summed(batches(rows)):
        for r in batch.to_pylist():
            state, depth = starts.setdefault(r["file"], {})[r["part"]] = last.get(r["file"], (0, 0))
            last[r["file"]] = ((state + r["odd"]) % 2, depth + r[f"depth_{state}"])
    cut = [r for batch in arrays._cut(starts)(batches(rows)) for r in batch.to_pylist()]
    whole = [r["record"] for r in cut if r["file"] is None]
    for name in starts:
        record = ""
        for r in (r for r in cut if r["file"] == name):
            record += r["record"]
            whole, record = ([*whole, record], "") if r["ends"] else (whole, record)
    assert sorted(whole) == sorted(naive(files))
    with pytest.raises(RuntimeError, match="other places"):
        list(arrays._cut({})(batches(rows)))


def test_texts_of_array_files_are_not_shuffled(spark, conf, tmp_path):
    rng = random.Random(4)
    objects = [{"at": i, "x": f'}}{{"{rng.randbytes(4000).hex()}', "y": {"z": i}} for i in range(200)]
    path = tmp_path / "all.json"
    path.write_text(json.dumps(objects))
    conf(spark__sql__files__maxPartitionBytes="100k", spark__sql__files__openCostInBytes="0")
    context = spark.sparkContext
    context.setJobGroup("array-files", "")
    try:
        found = [json.loads(r.record) for r in arrays.array_records(spark, str(path)).collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(found, key=lambda x: x["at"]) == objects
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = [s for job in tracker.getJobIdsForGroup("array-files") for s in tracker.getJobInfo(job).stageIds]
    known = [store.lastStageAttempt(s) for s in set(stages) if tracker.getStageInfo(s)]
    assert max(s.numTasks() for s in known) > 8
    assert sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in known) < path.stat().st_size / 4
