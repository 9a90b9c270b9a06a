import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from respeval.operators import roc


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, positive boolean, s double")


def histogram(spark, rows, sign=1):
    return roc.score_histogram(
        frame(spark, rows), ["g"], F.col("positive"), F.col("s") * F.lit(float(sign))
    )


def random_rows(seed, n=400, levels=12, groups=("a", "b", "c")):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        positive = draw.random() < 0.4
        rows.append((draw.choice(groups), positive, float(draw.randrange(levels) + positive)))
    return rows


def pairwise(rows):
    areas = {}
    for g in {r[0] for r in rows}:
        pos = [s for k, p, s in rows if k == g and p]
        neg = [s for k, p, s in rows if k == g and not p]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        areas[g] = (wins / (len(pos) * len(neg)), len(neg), len(pos))
    return areas


def thinned(rows, g):
    """ROC points from running counts; a point goes if both second differences are zero."""
    scores = sorted({s for k, _, s in rows if k == g}, reverse=True)
    fps = [sum(k == g and not p and v >= s for k, p, v in rows) for s in scores]
    tps = [sum(k == g and p and v >= s for k, p, v in rows) for s in scores]
    keep = [
        i
        for i in range(len(scores))
        if i in (0, len(scores) - 1)
        or fps[i + 1] - 2 * fps[i] + fps[i - 1]
        or tps[i + 1] - 2 * tps[i] + tps[i - 1]
    ]
    return [(0.0, 0.0)] + [(fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep]


@pytest.mark.parametrize("ranges", [None, 2, 7])
@pytest.mark.parametrize("seed, levels", [(1, 12), (2, 300), (3, 2)])
def test_against_pairs_and_running_counts(spark, seed, levels, ranges):
    rows = random_rows(seed, levels=levels)
    counts = histogram(spark, rows)
    got = {r.g: (r.auroc, r.n_neg, r.n_pos) for r in roc.auroc(counts, ["g"], ranges=ranges).collect()}
    expected = pairwise(rows)
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in expected.items()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({k: v[0] for k, v in expected.items()})
    points = roc.roc_points(counts, ["g"], ranges=ranges).collect()
    for g in expected:
        mine = sorted((r.fpr, r.tpr) for r in points if r.g == g)
        flat = sorted(thinned(rows, g))
        assert [x for p in mine for x in p] == pytest.approx([x for p in flat for x in p])


def test_reversed_scores_mirror_the_area(spark):
    rows = random_rows(5)
    up = {r.g: r.auroc for r in roc.auroc(histogram(spark, rows), ["g"]).collect()}
    down = {r.g: r.auroc for r in roc.auroc(histogram(spark, rows, -1), ["g"]).collect()}
    assert {g: up[g] + down[g] for g in up} == pytest.approx({g: 1.0 for g in up})


def test_small_classes_are_left_out(spark):
    rows = [("a", i < 5, float(i)) for i in range(20)] + [("b", i < 6, float(i)) for i in range(12)]
    counts = histogram(spark, rows)
    assert [r.g for r in roc.auroc(counts, ["g"]).collect()] == ["b"]
    assert {r.g for r in roc.roc_points(counts, ["g"]).collect()} == {"b"}


def test_ties_and_perfect_separation(spark):
    rows = [("tied", i % 2 == 0, 3.0) for i in range(20)]
    rows += [("split", i < 10, float(i < 10)) for i in range(20)]
    counts = histogram(spark, rows)
    areas = {r.g: r.auroc for r in roc.auroc(counts, ["g"]).collect()}
    assert areas == {"tied": 0.5, "split": 1.0}
    points = roc.roc_points(counts, ["g"]).collect()
    assert sorted((r.fpr, r.tpr) for r in points if r.g == "tied") == [(0, 0), (1, 1)]
    assert sorted((r.fpr, r.tpr) for r in points if r.g == "split") == [(0, 0), (0, 1), (1, 1)]


def test_ranges_joined_by_shuffle(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
    )
    rows = random_rows(8, levels=200, groups=("hot", "hot", "b"))
    got = {r.g: r.auroc for r in roc.auroc(histogram(spark, rows), ["g"], ranges=5).collect()}
    assert got == pytest.approx({g: a for g, (a, _, _) in pairwise(rows).items()})


def test_ranges_follow_the_data(spark, conf):
    conf(spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="6")
    rows = random_rows(6, levels=500)
    totals = roc.running_totals(histogram(spark, rows), ["g"])
    assert totals.count() == len({(g, s) for g, _, s in rows})
    got = {r.g: r.auroc for r in roc.auroc(histogram(spark, rows), ["g"]).collect()}
    assert got == pytest.approx({g: a for g, (a, _, _) in pairwise(rows).items()})


@pytest.mark.parametrize("ranges", [None, 1, 4])
def test_quantiles_of_fractions(spark, ranges):
    rows = [("a", True, i / 7) for i in range(50)] + [("b", True, 2.5)] * 3 + [("c", True, 1.25)]
    at = {"low": 0.1, "middle": 0.5, "high": 0.9}
    found = roc.quantiles(histogram(spark, rows), ["g"], at, ranges).collect()
    for r in found:
        values = [s for g, _, s in rows if g == r.g]
        assert r.n == len(values)
        for name, q in at.items():
            assert r[name] == pytest.approx(np.quantile(values, q))
    assert len(found) == 3


def test_threshold_scores(spark):
    rows = [("a", True, 3.0), ("a", False, 3.0), ("a", True, 2.0), ("a", False, 1.0)]
    got = {
        r.threshold: (r.precision, r.recall, r.f1)
        for r in roc.threshold_scores(histogram(spark, rows), ["g"]).collect()
    }
    assert got[3.0] == pytest.approx((1 / 2, 1 / 2, 1 / 2))
    assert got[2.0] == pytest.approx((2 / 3, 1.0, 4 / 5))
    assert got[1.0] == pytest.approx((1 / 2, 1.0, 2 / 3))


def test_risk_coverage(spark):
    rows = [("a", True, 9.0), ("a", True, 8.0), ("a", False, 8.0), ("a", False, 2.0)]
    got = {
        r.threshold: (r.coverage, r.abstention_rate, r.selective_accuracy)
        for r in roc.risk_coverage(histogram(spark, rows), ["g"]).collect()
    }
    assert got[9.0] == pytest.approx((1 / 4, 3 / 4, 1.0))
    assert got[8.0] == pytest.approx((3 / 4, 1 / 4, 2 / 3))
    assert got[2.0] == pytest.approx((1.0, 0.0, 1 / 2))


def test_bootstrap_is_repeatable_and_covers(spark):
    rows = [(g, p, s, str(i)) for i, (g, p, s) in enumerate(random_rows(7, n=3000))]
    df = spark.createDataFrame(rows, "g string, positive boolean, s double, item_id string")
    drawn = lambda d: roc.bootstrap_auroc(
        d, ["g"], F.col("positive"), F.col("s"), replicates=200
    )
    first = drawn(df).orderBy("g").collect()
    assert first == drawn(df.repartition(5)).orderBy("g").collect()
    sides = pairwise([r[:3] for r in rows])
    for r in first:
        area, neg, pos = sides[r.g]
        # The standard error of an area from its class sizes, in Hanley and McNeil's form.
        q1, q2 = area / (2 - area), 2 * area**2 / (1 + area)
        spread = (pos - 1) * (q1 - area**2) + (neg - 1) * (q2 - area**2) + area * (1 - area)
        error = math.sqrt(spread / (pos * neg))
        assert r.auroc == pytest.approx(area)
        assert r.auroc_low < r.auroc < r.auroc_high
        assert r.auroc_high - r.auroc_low == pytest.approx(2 * 1.96 * error, rel=0.35)
        assert r.replicates == 200


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_bootstrap_vectors_against_repeated_rows(spark, ranges):
    """Every replicate's area from rows repeated by their block's weight; ties and several ranges."""
    rows = [(g, p, s, str(i)) for i, (g, p, s) in enumerate(random_rows(11, n=700))]
    df = spark.createDataFrame(rows, "g string, positive boolean, s double, item_id string")
    replicates, blocks = 25, 10
    made = roc.bootstrap_auroc(
        df, ["g"], F.col("positive"), F.col("s"), replicates=replicates, blocks=blocks, level=0.5, ranges=ranges
    )
    made = {r["g"]: r for r in made.collect()}
    weights = roc._weights(42, blocks, replicates)
    block = [int(hashlib.md5(f"42|{r[3]}".encode()).hexdigest()[:8], 16) % blocks for r in rows]
    for g in made:
        areas = []
        for r in range(replicates):
            again = [row[:3] for row, b in zip(rows, block) if row[0] == g for _ in range(int(weights[b, r]))]
            area, neg, pos = pairwise(again).get(g, (None, 0, 0))
            areas += [area] if neg and pos else []
        low, high = np.percentile(areas, [25, 75])
        assert made[g]["replicates"] == len(areas)
        assert made[g]["auroc_low"] == pytest.approx(low) and made[g]["auroc_high"] == pytest.approx(high)


def test_bootstrap_makes_no_row_per_replicate(spark):
    df = spark.range(2000).select(
        F.lit("a").alias("g"), (F.col("id") % 3 == 0).alias("positive"), F.sqrt("id").alias("s"), "id"
    )
    by_block = roc.score_histogram(df.withColumn("_block", F.col("id") % 10), ["g", "_block"], F.col("positive"), F.col("s"))
    dealt = by_block.repartitionByRange(4, "g", "score").withColumn("_range", F.spark_partition_id())
    parts = roc._range_vectors(dealt, ["g"], 42, 10, 50)
    assert parts.count() == 4 * 50


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_selective_area(spark, ranges):
    rows = random_rows(5, n=400)
    made = {r["g"]: r for r in roc.selective_area(histogram(spark, rows), ["g"], ranges).collect()}
    for g in {r[0] for r in rows}:
        mine = [(p, s) for h, p, s in rows if h == g]
        area, before = 0.0, None
        for score in sorted({s for _, s in mine}, reverse=True):
            answered = [p for p, s in mine if s >= score]
            point = len(answered) / len(mine), sum(answered) / len(answered)
            area += point[0] * point[1] if before is None else (point[0] - before[0]) * (point[1] + before[1]) / 2
            before = point
        assert made[g]["accuracy_area"] == pytest.approx(area)
        assert made[g]["risk_area"] == pytest.approx(1 - area) and made[g]["n"] == len(mine)
