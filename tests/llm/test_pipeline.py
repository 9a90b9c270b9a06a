"""The pipeline, stage by stage, against plain versions over the whole small table."""

import re

import duckdb
import pytest
from test_brute_force import SMALL, linked, shingles

import corpus_pipeline
from respeval.llm import toxicity
from respeval.llm.oracles import LINE_DEDUP
from respeval.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], SMALL), f"test-{name}"))
    return [frame.collect() for frame in made], made


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_toxicity_stage(spark, stages):
    (docs, left, *_), frames = stages
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = toxicity.score(frames[0], toxicity.train(frames[0], labels)).collect()
    assert ids(left) == sorted(r["doc_id"] for r in scores if r["score"] < 0.3)
    assert {tuple(r) for r in left} <= {tuple(r) for r in docs}


def test_line_stage(stages):
    rows, frames = stages
    given = frames[1].select("doc_id", "text", "source").toArrow()  # noqa: F841
    sql = LINE_DEDUP.format(documents="given") + "SELECT doc_id, kept FROM pages JOIN rebuilt USING (page)"
    expected = dict(duckdb.sql(sql).fetchall())
    assert {r["doc_id"]: r["text"] for r in rows[2]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])


def test_near_duplicate_stage(stages):
    rows, _ = stages
    top = linked({r["doc_id"]: shingles(r["text"], 5) for r in rows[2]})
    assert ids(rows[3]) == sorted(i for i in top if top[i] == i)


def test_decontamination_stage(spark, stages):
    rows, _ = stages

    def runs(text):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", lower)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = [runs(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [
        r["doc_id"]
        for r in rows[3]
        if not any(i and 100 * len(i & runs(r["text"])) >= 80 * len(i) for i in items)
    ]
    assert ids(rows[4]) == sorted(clean) and len(clean) < len(rows[3])


def test_mixing_stage_and_columns(stages):
    rows, frames = stages
    assert all(frame.columns == COLUMNS for frame in frames[:-1])
    assert frames[-1].columns == [*COLUMNS, "rate"]
    assert set(ids(rows[5])) <= set(ids(rows[4])) and all(r["rate"] > 0 for r in rows[5])
    assert len(rows[5]) > 0.9 * len(rows[4])
