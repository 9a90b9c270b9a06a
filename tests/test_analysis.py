import random

import pytest
from pyspark.sql import functions as F

from respeval.functions.formatting import fixed
from respeval.operators import calibration, compare, metrics, report, roc
from respeval.plans.analysis import analyse

SCHEMA = (
    "model string, arm string, dataset string, dataset_type string, item_id string, "
    "confidence double, confidence_valid boolean, is_correct boolean, is_cautious boolean, "
    "is_unsafe boolean, flagged_suspicious boolean, parse_error boolean"
)


def scored(spark, n=1200, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        kind = draw.choice(["legitimate", "counterfactual", "factcheck"])
        confidence = float(draw.choice([-1, *range(1, 11)]))
        rows.append(
            (
                draw.choice(["m1", "m2"]), draw.choice(["baseline", "uncertainty"]), "d_" + kind,
                kind, str(i), confidence, confidence >= 1,
                kind != "counterfactual" and draw.random() < 0.6, draw.random() < 0.3,
                draw.random() < 0.2, draw.random() < 0.1, confidence < 0,
            )
        )
    return spark.createDataFrame(rows, SCHEMA), rows


def near(left, right, keys):
    left, right = left.orderBy(*keys).collect(), right.orderBy(*keys).collect()
    assert len(left) == len(right) > 0
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9) if isinstance(x, float) else x == y


def test_cells_give_the_same_report_as_rows(spark):
    df, _ = scored(spark)
    out = analyse(df)
    near(out.metrics, metrics.group_metrics(df), ["model", "arm", "dataset"])
    near(out.tests, compare.arm_tests(df), ["model", "dataset"])
    hist = roc.counterfactual_histogram(df)
    near(out.auroc, roc.auroc(hist, ["model", "arm"]), ["model", "arm"])
    near(out.roc_points, roc.roc_points(hist, ["model", "arm"]), ["model", "arm", "fpr", "tpr"])
    near(out.verdicts, compare.verdicts(df), ["model"])
    near(out.parse_success, metrics.parse_success(df), ["n"])
    assert out.cells.count() < df.count()
    out.cells.unpersist()


def test_missing_groups_and_null_keys(spark):
    df, _ = scored(spark, 50)
    row = df.limit(1).withColumn("model", F.lit(None).cast("string"))
    near(
        metrics.group_metrics(df.unionByName(row)),
        metrics.group_metrics(df),
        ["model", "arm", "dataset"],
    )


def test_group_metrics_by_hand(spark):
    df, rows = scored(spark)
    for r in metrics.group_metrics(df).collect():
        mine = [x for x in rows if (x[0], x[1], x[2]) == (r.model, r.arm, r.dataset)]
        valid = [x[5] for x in mine if x[6]]
        mean = sum(valid) / len(valid)
        assert r.n == len(mine)
        assert r.mean_confidence == pytest.approx(mean)
        assert r.std_confidence == pytest.approx(
            (sum((v - mean) ** 2 for v in valid) / (len(valid) - 1)) ** 0.5
        )
        assert r.unsafe_rate == pytest.approx(sum(x[9] for x in mine) / len(mine))
        assert (r.accuracy is None) == (r.dataset == "d_counterfactual")
        assert (r.evidence_flag_rate is None) == (r.arm == "baseline")


def test_calibration_by_hand(spark):
    df, rows = scored(spark)
    mine = [x for x in rows if x[0] == "m1" and x[1] == "baseline" and x[6] and x[3] != "counterfactual"]
    where = (F.col("model") == "m1") & (F.col("arm") == "baseline")
    brier = sum((x[5] / 10 - x[7]) ** 2 for x in mine) / len(mine)
    ece = 0.0
    for c in range(1, 11):
        cell = [x for x in mine if x[5] == c]
        if cell:
            ece += abs(sum(x[7] for x in cell) / len(cell) - c / 10) * len(cell) / len(mine)
    assert calibration.brier_score(df).where(where).first().brier == pytest.approx(brier)
    assert calibration.calibration_error(df).where(where).first().ece == pytest.approx(ece)


def test_correlation_of_a_constant_is_null(spark):
    df, _ = scored(spark)
    row = calibration.uncertainty_error_correlation(df.where("confidence = 5")).first()
    assert row.correlation is None


def test_fixed_rounds_the_binary_value(spark):
    values = [0.25, 0.35, 2.675, 0.05, 12.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(fixed(F.col("x"), 1)).collect()]
    assert got == ["0.2", "0.3", "2.7", "0.1", "12.0", None, None]
    assert df.select(fixed(F.col("x"), 2)).collect()[2][0] == "2.67"


def test_report_rows(spark):
    tests = spark.createDataFrame(
        [
            ("m", "d", 0.03, 0.91, 0.0, 326.93, 0.97, 0.09, 0.00005, 9.5, 3.5, 0.0, 2.31),
            ("m", "e", 0.0, 0.0, None, None, 0.1, 0.2, 0.05, None, None, None, None),
        ],
        "model string, dataset string, cautiousness_baseline double, cautiousness_uncertainty "
        "double, cautiousness_p double, cautiousness_odds_ratio double, unsafe_baseline double, "
        "unsafe_uncertainty double, unsafe_p double, confidence_mean_baseline double, "
        "confidence_mean_uncertainty double, confidence_p double, confidence_cohens_d double",
    )
    got = {tuple(r)[1:] for r in report.test_rows(tests).collect()}
    assert got == {
        ("d", "Cautiousness", "3.0%", "91.0%", "0.0000", "OR=326.93"),
        ("d", "Unsafe Rate", "97.0%", "9.0%", "0.0001", "-"),
        ("d", "Confidence", "9.5", "3.5", "0.0000", "d=2.31"),
        ("e", "Cautiousness", "0.0", "0.0", "N/A", "N/A"),
        ("e", "Unsafe Rate", "10.0%", "20.0%", "0.0500", "-"),
        ("e", "Confidence", "N/A", "N/A", "N/A", "N/A"),
    }
    areas = spark.createDataFrame(
        [("m", "baseline", 0.6665, 99, 94)], "model string, arm string, auroc double, n_neg long, n_pos long"
    )
    assert tuple(report.auroc_rows(areas).first()) == ("m", "baseline", "0.666", "99", "94")


def test_metric_rows_and_pivot(spark):
    df, _ = scored(spark)
    table = metrics.group_metrics(df)
    rows = report.metric_rows(table).collect()
    assert [(r.model, r.arm, r.dataset) for r in rows] == sorted(
        (r.model, r.arm, r.dataset) for r in rows
    )
    assert {r.accuracy for r in rows if r.dataset == "d_counterfactual"} == {"N/A"}
    assert all("±" in r.confidence and r.unsafe_rate.endswith("%") for r in rows)
    wide = report.metric_by_arm(table, "accuracy")
    assert wide.columns == ["dataset", "model", "baseline", "uncertainty"]
    assert wide.count() == 6


def test_quartiles_are_exact(spark):
    df, rows = scored(spark)
    for r in report.confidence_quartiles(df).collect():
        values = sorted(
            x[5] for x in rows if (x[0], x[2], x[1]) == (r.model, r.dataset, r.arm) and x[6]
        )
        for cut, got in ((0.25, r.q1), (0.5, r.median), (0.75, r.q3)):
            at = cut * (len(values) - 1)
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert got == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))


def test_perturbation_delta(spark):
    df, rows = scored(spark)

    def rate(kind, i):
        mine = [x[i] for x in rows if x[0] == "m1" and x[1] == "baseline" and x[3] == kind]
        return sum(mine) / len(mine)

    row = (
        metrics.perturbation_delta(df)
        .where("model = 'm1' and arm = 'baseline' and dataset_type = 'factcheck'")
        .first()
    )
    assert row.accuracy_drop == pytest.approx(rate("legitimate", 7) - rate("factcheck", 7))
    assert row.abstention_increase == pytest.approx(rate("factcheck", 8) - rate("legitimate", 8))
