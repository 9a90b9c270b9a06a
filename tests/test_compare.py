import math

import pytest
from pyspark.sql import functions as F

from respeval.functions import tails
from respeval.operators import compare

# successes of 100 in the first and second arm -> chi-squared, p, odds ratio
KNOWN = [
    (0, 1, 0.0, 1.0, None),
    (8, 7, 0.0, 1.0, None),
    (3, 91, 151.92694, 0.0, 326.93),
    (97, 9, 151.92694, 0.0, None),
    (11, 12, 0.0, 1.0, None),
    (0, 12, 10.72695, 0.0010559, None),
    (6, 19, 6.58286, 0.0103, None),
    (22, 88, 85.35354, 0.0, 26.00),
    (71, 2, 99.75191, 0.0, None),
    (3, 9, 2.21631, 0.1365589, 3.20),
    (15, 18, 0.14516, 0.7032001, None),
]


@pytest.mark.parametrize("before, after, chi2, p, odds", KNOWN)
def test_published_counts(spark, before, after, chi2, p, odds):
    df = spark.createDataFrame([(before, 100, after, 100)], "a long, n long, b long, m long")
    args = [F.col(c) for c in ("a", "n", "b", "m")]
    statistic = compare.yates_chi2(*args)
    row = df.select(statistic, tails.chi2_p(statistic), compare.odds_ratio(*args)).first()
    assert row[0] == pytest.approx(chi2, abs=1e-5)
    assert row[1] == pytest.approx(p, abs=5e-5)
    if odds is not None:
        assert round(row[2], 2) == odds
    if before == 0:
        assert row[2] is None


def test_empty_margins_give_null(spark):
    df = spark.createDataFrame(
        [(0, 10, 0, 10), (10, 10, 10, 10), (0, 0, 3, 9)], "a long, n long, b long, m long"
    )
    args = [F.col(c) for c in ("a", "n", "b", "m")]
    assert all(r[0] is None for r in df.select(compare.yates_chi2(*args)).collect())


def arms(spark, baseline, treated, repeat=1):
    rows = [("m", "d", "baseline", float(v)) for v in baseline]
    rows += [("m", "d", "uncertainty", float(v)) for v in treated]
    df = spark.createDataFrame(rows, "model string, dataset string, arm string, v double")
    return compare.arm_summary(df, measure=F.col("v"))


def test_t_and_d(spark):
    test = compare.measure_test()
    row = arms(spark, [1, 2, 3, 4], [3, 5, 7]).select(
        test["t"], test["df"], test["cohens_d"], tails.t_p(test["t"], test["df"])
    ).first()
    var_b, var_t = 5 / 3, 4.0
    pooled = (3 * var_b + 2 * var_t) / 5
    assert row[0] == pytest.approx(-2.5 / math.sqrt(pooled * (1 / 4 + 1 / 3)))
    assert row[1] == 5
    assert row[2] == pytest.approx(-2.5 / math.sqrt((var_b + var_t) / 2))
    assert 0.09 < row[3] < 0.12


@pytest.mark.parametrize("baseline, treated", [([1], [2, 3]), ([2, 2], [2, 2]), ([], [1, 2])])
def test_t_is_null_without_spread(spark, baseline, treated):
    test = compare.measure_test()
    row = arms(spark, baseline, treated).select(test["t"], test["cohens_d"]).first()
    assert row[0] is None
    assert row[1] is None


def test_t_tail_closed_forms(spark):
    cases = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 12.0, -3.0) for df in (1.0, 2.0, 1e7)]
    df = spark.createDataFrame(cases, "t double, df double")
    for t, degrees, p in df.select("t", "df", tails.t_p(F.col("t"), F.col("df"))).collect():
        a = abs(t)
        exact = {
            1.0: 1 - 2 * math.atan(a) / math.pi,
            2.0: 1 - a / math.sqrt(2 + a * a),
            1e7: math.erfc(a / math.sqrt(2)),
        }[degrees]
        assert p == pytest.approx(exact, abs=1e-8 if degrees < 10 else 2e-7)


def test_t_tail_for_very_many_rows(spark):
    """One method for every number of rows; for very many the normal tail is reached."""
    cases = [(t, df) for t in (0.5, 1.9, 4.0) for df in (1e6, 1e6 + 1, 1e11)]
    df = spark.createDataFrame(cases, "t double, df double")
    p = {(r[0], r[1]): r[2] for r in df.select("t", "df", tails.t_p(F.col("t"), F.col("df"))).collect()}
    for t in (0.5, 1.9, 4.0):
        assert p[t, 1e6] == pytest.approx(p[t, 1e6 + 1], rel=1e-7)
        assert p[t, 1e11] == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("power", range(13))
def test_t_tail_against_its_expansion(spark, power):
    """From one to 1e12 degrees of freedom, against closed forms and the series in 1/df."""
    degrees = 10.0**power
    df = spark.createDataFrame([(t, degrees) for t in (0.0, 0.3, 1.0, 2.5, 6.0)], "t double, df double")
    for t, p in df.select("t", tails.t_p(F.col("t"), F.col("df"))).collect():
        if power == 0:
            expected = 1 - 2 / math.pi * math.atan(t)
        elif power < 6:
            # An even number of degrees has a finite sum.
            theta, total, term = math.atan(t / math.sqrt(degrees)), 1.0, 1.0
            for k in range(1, int(degrees) // 2):
                term *= (2 * k - 1) / (2 * k) * math.cos(theta) ** 2
                total += term
            expected = 1 - math.sin(theta) * total
        else:
            normal = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
            first = (t**3 + t) / 4
            expected = math.erfc(t / math.sqrt(2)) + 2 * normal * first / degrees
        assert p == pytest.approx(expected, rel=1e-7, abs=1e-12)


def test_small_tails_keep_their_digits(spark):
    df = spark.createDataFrame([(400.0, 30.0)], "x double, t double")
    row = df.select(tails.chi2_p(F.col("x")), tails.t_p(F.col("t"), F.lit(3.0))).first()
    assert row[0] == pytest.approx(math.erfc(math.sqrt(200)), rel=1e-12)
    # For three degrees of freedom the tail has a closed form.
    x = 30 / math.sqrt(3)
    exact = 1 - 2 / math.pi * (x / (1 + x * x) + math.atan(x))
    assert row[1] == pytest.approx(exact, rel=1e-8)


def test_null_statistic_gives_null_p(spark):
    df = spark.createDataFrame([(None, None)], "x double, t double")
    row = df.select(tails.chi2_p(F.col("x")), tails.t_p(F.col("t"), F.lit(3.0))).first()
    assert row[0] is None and row[1] is None


def test_mcnemar_counts_pairs_only(spark):
    rows = [
        ("m", "d", "1", "baseline", True), ("m", "d", "1", "uncertainty", False),
        ("m", "d", "2", "baseline", True), ("m", "d", "2", "uncertainty", True),
        ("m", "d", "3", "baseline", False), ("m", "d", "3", "uncertainty", True),
        ("m", "d", "4", "baseline", True), ("m", "d", "4", "uncertainty", False),
        ("m", "d", "5", "baseline", True), ("m", "d", "6", "uncertainty", True),
    ]
    df = spark.createDataFrame(
        rows, "model string, dataset string, item_id string, arm string, f boolean"
    )
    row = compare.mcnemar(df, F.col("f")).first()
    assert (row.n_pairs, row.only_baseline, row.only_treated, row.mcnemar_chi2) == (4, 2, 1, 0.0)


def test_bonferroni(spark):
    df = spark.createDataFrame([(0.001,), (0.02,), (0.6,), (None,)], "p double")
    rows = compare.bonferroni(df, "p").orderBy("p").collect()
    assert [r.p_adjusted for r in rows[1:]] == pytest.approx([0.003, 0.06, 1.0])
    assert [r.significant for r in rows[1:]] == [True, False, False]


def test_odds_ratio_interval(spark):
    df = spark.createDataFrame([(3, 100, 9, 100), (0, 100, 9, 100)], "a long, n long, b long, m long")
    low, high = compare.odds_ratio_bounds(*[F.col(c) for c in ("a", "n", "b", "m")])
    rows = df.select(low, high).collect()
    ratio = 9 * 97 / (91 * 3)
    spread = 1.96 * math.sqrt(1 / 3 + 1 / 97 + 1 / 9 + 1 / 91)
    assert list(rows[0]) == pytest.approx(
        [ratio * math.exp(-spread), ratio * math.exp(spread)]
    )
    assert list(rows[1]) == [None, None]
