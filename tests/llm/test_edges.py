"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from odd_rows import SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline
from respeval.llm import (
    decontam, langid, licenses, linededup, minhash, mixing, pii, quality, substrings, toxicity,
)

DOC_COLUMNS = SCHEMA.names


@pytest.fixture
def items(spark):
    return spark.createDataFrame(
        [(1, "seven wise owls watch from an old oak tree"), (2, None), (3, ""), (4, "the lazy dog"), (1, "seven wise owls watch from an old oak tree"), (None, "jumps over the lazy dog while seven")],
        "item_id long, text string",
    )


def operators(labels, items):
    return {
        "lines": (lambda d: linededup.without_boilerplate(d, least=2, ratio=0.3), True),
        "mixing": (lambda d: mixing.mixed(d, mixing.labelled_domains(labels), mixing.TARGETS), True),
        "minhash": (minhash.near_duplicates, True),
        "toxicity": (lambda d: toxicity.score(d, toxicity.train(d, labels)), True),
        "langid": (lambda d: langid.predict(d, langid.train(d)), True),
        "pii": (lambda d: pii.with_all_spans(d, {"quick": "email", "fox": "remove"}), True),
        "substrings": (substrings.without_repeats, True),
        "licenses": (licenses.document_licenses, False),
        "decontam": (lambda d: decontam.find_items(d, items), False),
        "quality": (quality.quality_rules, True),
    }


NAMES = list(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, odd_docs, labels, items):
    run, per_row = operators(labels, items)[name]
    result = run(odd_docs).collect()
    if per_row:
        assert len(result) == odd_docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, no_docs, labels, items):
    run, _ = operators(labels, items)[name]
    assert run(no_docs).collect() == []


def test_no_labels_and_no_items(odd_docs, labels, items):
    none, nothing = labels.where("false"), items.where("false")
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.train(odd_docs, none)).collect()} == {0.0}
    assert {r["rate"] for r in mixing.mixed(odd_docs, mixing.labelled_domains(none), mixing.TARGETS).collect()} == {1.0}
    assert {r["lang_pred"] for r in langid.predict(odd_docs, {}).collect()} == {"und"}
    assert decontam.find_items(odd_docs, nothing).collect() == []
    assert decontam.without_items(odd_docs, nothing).count() == odd_docs.count()


def test_stages_keep_columns(odd_docs, labels, items):
    assert toxicity.without_toxic(odd_docs, labels).columns == DOC_COLUMNS
    assert linededup.without_boilerplate(odd_docs).columns == DOC_COLUMNS
    assert decontam.without_items(odd_docs, items).columns == DOC_COLUMNS
    one = minhash.one_of_each(odd_docs)
    assert one.columns == DOC_COLUMNS
    ids = sorted(r["doc_id"] for r in one.where("doc_id IS NOT NULL").collect())
    # 0 stands for its copies and repeated rows, 6 for its near copy; texts without a word stay.
    assert ids == [0, 2, 3, 4, 5, 6, 8, 9]
    assert one.where("doc_id IS NULL").count() == 2


def test_decontamination_finds_and_drops(odd_docs, items):
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_items(odd_docs, items).collect()}
    assert found == {(0, 1), (1, 1), (9, 1), (None, 1)}
    left = decontam.without_items(odd_docs, items)
    assert left.where(F.col("text").contains("wise owls")).count() == 0
    assert left.count() == odd_docs.count() - 6


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd_docs).collect()}
    by_id = {r[0]: r for r in rows if r[0] is not None}
    assert by_id[1][2:] == (0, False) and by_id[0][2:] == (0, True)
    assert by_id[7][2:] == (6, False)
    assert by_id[2] == (2, 0, 2, True) and by_id[4] == (4, 0, 4, True)
    assert by_id[5] == (5, 1, 5, True)
    assert {r[2:] for r in rows if r[0] is None} == {(None, False)}


def test_rows_of_mixing_have_rates(odd_docs, labels):
    rates = mixing.document_rates(odd_docs, mixing.labelled_domains(labels), mixing.TARGETS).collect()
    assert len(rates) == odd_docs.count() and all(r["rate"] >= 0 for r in rates)
    assert all(abs(sum(r["posteriors"].values()) - 1) < 1e-9 for r in rates)


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing",
    ]
