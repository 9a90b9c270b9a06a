"""Report state that follows the result table block by block."""

import pytest
from pyspark.sql import functions as F

from catalog import views as V
from catalog.queries import rounded
from respeval.plans.analysis import analyse
from respeval.plans.experiment import score_results
from respeval.plans.incremental import blocks_of, read_cells, refresh_cells, report_of_cells
from respeval.schemas import RESULTS
from respeval.sources.results import read_results, write_results

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def paths(spark, tmp_path):
    records = V.eval_results(spark, SMALL)
    for field in RESULTS.fields:
        if field.name not in records.columns:
            records = records.withColumn(field.name, F.lit(None).cast(field.dataType))
    results, cells = str(tmp_path / "results"), str(tmp_path / "cells")
    write_results(score_results(records), results)
    return results, cells


def rows(frame):
    return sorted(map(str, rounded(frame).collect()))


TABLES = ("parse_success", "metrics", "tests", "auroc", "roc_points", "verdicts")


def same_report(spark, results, cells):
    merged, whole = report_of_cells(spark, cells), analyse(read_results(spark, results, scored=True), False)
    for name in TABLES:
        assert rows(getattr(merged, name)) == rows(getattr(whole, name)), name


def test_only_rewritten_blocks_are_read_and_written(spark, paths, tmp_path):
    results, cells = paths
    every = refresh_cells(spark, results, cells)
    assert len(every) > 4 and refresh_cells(spark, results, cells) == []
    same_report(spark, results, cells)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*.parquet")}

    one = read_results(spark, results, scored=True).where("model = 'm0' AND arm = 'uncertainty' AND dataset LIKE 'leg%_en'")
    changed = spark.createDataFrame(one.withColumn("confidence", F.lit(1.0)).limit(20).collect(), one.schema)
    write_results(changed, results)
    (name,) = refresh_cells(spark, results, cells)
    assert '"model":"m0","arm":"uncertainty"' in name
    # The scan opens the block's files alone, and no other block's cells were touched.
    block = blocks_of(spark, results, [name])
    block.collect()
    scan = block._jdf.queryExecution().executedPlan().collectLeaves().head()
    written = list((tmp_path / "results" / "model=m0" / "arm=uncertainty").glob("dataset=leg*_en/*.parquet"))
    assert scan.metrics().apply("numFiles").value() == len(written) == 1
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "cells").rglob("*.parquet")}
    touched = {p.parent for p in before.keys() ^ after.keys()}
    assert len(touched) == 1 and all(before[p] == after[p] for p in before.keys() & after.keys())
    same_report(spark, results, cells)


def test_blocks_that_go_and_come(spark, paths, tmp_path):
    results, cells = paths
    refresh_cells(spark, results, cells)
    gone = sorted((tmp_path / "results").rglob("dataset=*"))[0]
    kept = spark.read.parquet(str(gone)).drop("model").count()
    assert kept
    gone.rename(tmp_path / "aside")
    assert refresh_cells(spark, results, cells) == []
    same_report(spark, results, cells)
    assert refresh_cells(spark, results, cells) == []
    (tmp_path / "aside").rename(gone)
    assert len(refresh_cells(spark, results, cells)) == 1
    same_report(spark, results, cells)


def test_no_results_yet(spark, tmp_path):
    assert read_cells(spark, str(tmp_path / "none")).collect() == []


def test_report_is_built_without_jobs(spark, paths):
    results, _ = paths
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run")
    try:
        analysis = analyse(read_results(spark, results, scored=True), keep_cells=False)
        for name in ("parse_success", "metrics", "tests", "verdicts"):
            getattr(analysis, name)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
