"""Values that can be derived by hand or are published."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.core import special
from veritally.core.errors import AnalysisError
from veritally.operators import balance, bunching, control, digits, dispersion, inject, percent, power, ranking, reconcile
from veritally.sources import registry


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) if v is not None else (None,) for v in values], f"{name} double")


def test_second_digit_law():
    want = [0.11968, 0.11389, 0.10882, 0.10433, 0.10031, 0.09668, 0.09337, 0.09035, 0.08757]
    assert np.allclose(digits.expected("second")[: len(want)], want, atol=5e-6)


def test_leading_digits(spark):
    rows = numbers(spark, [0.000123, 123, 9.99, 0, -5, float("nan"), None, 1000, 3, 40])
    out = rows.select(digits.leading_digits(F.col("x"), "first").alias("a"), digits.leading_digits(F.col("x"), "first_two").alias("b"), digits.leading_digits(F.col("x"), "second").alias("c")).collect()
    assert [r.a for r in out] == [1, 1, 9, None, None, None, None, 1, 3, 4]
    assert [r.b for r in out[:3]] == [12, 12, 99]
    assert [r.c for r in out] == [2, 2, 9, None, None, None, None, None, None, None]


@pytest.mark.parametrize(("value", "v"), [(1.5, 1 - math.log10(2)), (9.5, 1 - math.log10(10 / 9))])
def test_kuiper(spark, value, v):
    out = digits.benford_test(numbers(spark, [value] * 20), "x").first()
    assert out["kuiper_v"] == pytest.approx(v)


def test_kuiper_series(spark):
    n = 1e12
    out = spark.range(1).select(digits.kuiper_pvalue(F.lit(1.0 / (math.sqrt(n) + 0.155 + 0.24 / math.sqrt(n))), F.lit(n)).alias("p")).first()
    assert out["p"] == pytest.approx(0.8220766, abs=1e-6)


def test_terminal_digits(spark):
    out = numbers(spark, [123, 4560, 7]).select(digits.terminal_digits(F.col("x"), 2).alias("d")).collect()
    assert [r.d for r in out] == [23, 60, 7]
    test = digits.terminal_digit_test(numbers(spark, [10] * 10 + [21] * 10), "x").first()
    assert (test["chi2"], test["df"], test["max_abs_dev"]) == (pytest.approx(80.0), 9, pytest.approx(0.4))
    with pytest.raises(Exception, match="integers"):
        numbers(spark, [1.5]).select(digits.terminal_digits(F.col("x"))).collect()


def test_percentage(spark):
    rows = spark.createDataFrame([(50.0, 200.0), (1.0, 0.0), (3.0, 4.0), (7.0, -10.0), (2.0, float("nan"))], "n double, d double")
    out = [r[0] for r in rows.select(percent.percentage(F.col("n"), F.col("d"))).collect()]
    assert out[0] == 25 and out[2] == 75 and all(math.isnan(out[i]) for i in (1, 3, 4))


def test_integer_excess_finds_planted(spark):
    g = np.random.default_rng(1)
    den = g.integers(500, 3000, 1500)
    num = g.binomial(den, g.uniform(0.3, 0.7, 1500))
    planted = num.copy()
    planted[:150] = np.rint(den[:150] * np.rint(100 * num[:150] / den[:150]) / 100)
    for values, low, high in ((num, -4, 4), (planted, 6, 1e9)):
        rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(values, den))], "i long, num double, den double")
        exact = percent.integer_excess_exact(rows, "num", "den").first()
        drawn = percent.integer_excess(rows, "num", "den", n_mc=100).first()
        assert low < exact["z"] < high and low < drawn["z"] < high
        assert drawn["expected_mean"] == pytest.approx(exact["expected_mean"], rel=0.1)


def test_bin_around(spark):
    out = bunching.bin_around(numbers(spark, [0.3, 1.2, 1.7]), "x", 1.0, 0.5).orderBy("bin").collect()
    assert [r.centre for r in out] == [0.25, 0.75, 1.25, 1.75] and [r["count"] for r in out] == [1, 0, 1, 1]


def test_linear_density():
    counts = np.array([100 + 2 * j for j in range(40)], float)
    counts[19] += 50
    counts[20] -= 50
    found = bunching.fit(-20, counts, bunching.Window.of(1.0, 1.0, 1.0, poly_degree=1))
    assert found["excess_mass"] == pytest.approx(50) and found["missing_mass"] == pytest.approx(50) and found["normalized_excess"] == pytest.approx(50 / 139)
    assert np.allclose(found["coefficients"], [139, 2])


def test_variance_floor(spark):
    out = dispersion.variance_floor_test(numbers(spark, range(1, 6)), "x", 10.0).first()
    assert (out["s2"], out["statistic"], out["df"]) == (pytest.approx(2.5), pytest.approx(1.0), 4)


@pytest.mark.parametrize(("values", "eta"), [((1, 2, 3, 4), 0.6), ((1, -1, 1, -1), 3.0)])
def test_von_neumann(spark, values, eta):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t int, x double")
    assert dispersion.smoothness_ratio(rows, "x", ["t"]).first()["eta"] == pytest.approx(eta)


@pytest.mark.parametrize(("p", "n", "z"), [(0.5, 3, 0.0), (0.975, 4, 3.919928)])
def test_stouffer(spark, p, n, z):
    out = balance.combine_pvalues(numbers(spark, [p] * n), "x").first()
    assert out["statistic"] == pytest.approx(z, abs=1e-6)


@pytest.mark.parametrize(("sigma", "x", "objective"), [((1, 1), 9.0, 2.0), ((1, 2), 9.6, 0.8)])
def test_reconcile(sigma, x, objective):
    found = reconcile.solve(np.array([10.0, 8.0]), np.array([[1.0, -1.0]]), np.diag(np.square(sigma).astype(float)), np.zeros(1))
    assert np.allclose(found["x"], x) and found["objective"] == pytest.approx(objective) and found["dof"] == 1


def test_gross_error(spark):
    edges = [("e_in", "ENV", "N1", 10.0, 0.5), ("e12", "N1", "N2", 6.0, 0.3), ("e13", "N1", "N3", 9.0, 0.3), ("e24", "N2", "N4", 6.0, 0.3), ("e34", "N3", "N4", 4.0, 0.3), ("e_out", "N4", "ENV", 10.0, 0.5)]
    table = spark.createDataFrame([("s", *e) for e in edges], "system_id string, edge string, source string, target string, value double, sigma double")
    out = reconcile.serial_elimination(table, table).collect()
    assert [r["edge"] for r in out][0] == "e13"


def test_rank_metrics(spark):
    rows = spark.createDataFrame([(i, 0.9 - 0.1 * i, int(i in (0, 2, 5))) for i in range(10)], "id int, s double, y int")
    out = {r["k"]: r for r in ranking.at_k(rows, "y", "s", "id", [1, 3, 5, 10]).collect()}
    assert [out[k]["precision"] for k in ("1", "3", "5", "10")] == pytest.approx([1, 2 / 3, 0.4, 0.3])
    assert [out[k]["recall"] for k in ("1", "3", "10")] == pytest.approx([1 / 3, 2 / 3, 1])
    assert ranking.roc_auc(rows, "y", "s", "id").first()["roc_auc"] == pytest.approx(17 / 21)


def test_control_verdicts(spark):
    rows = spark.createDataFrame([("a", "external", p / 100) for p in range(100)] + [("b", "synthetic", 0.01)] * 100, "control string, kind string, pvalue double")
    out = {r["control"]: r["verdict"] for r in control.control_report(rows).collect()}
    assert out == {"a": "calibrated", "b": "anticonservative"}
    assert control.summary(control.control_report(rows)).first()["worst_verdict"] == "anticonservative"


def test_effect_of_padding_has_a_direction(spark):
    rows = spark.createDataFrame([(t, 50.0 + t % 3) for t in range(40)], "t int, x double")
    out = inject.measure_effect(inject.inject_padding(rows, "x", "t", 10, 19, 0.3)).first()
    assert out["directionality"] == pytest.approx(1.0) and out["n_touched"] == 10 and out["moves_quantity"]


def test_special_functions(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for df in (1, 2, 7, 30, 89):
        for x in (0.1, 1.0, 5.0, 40.0):
            assert special.chi2_cdf(x, df) == pytest.approx(jvm.ChiSquaredDistribution(float(df)).cumulativeProbability(x), abs=1e-10)
    for d1, d2, x in ((2, 10, 3.0), (5, 7, 0.4), (1, 200, 12.0)):
        assert special.f_sf(x, d1, d2) == pytest.approx(1 - jvm.FDistribution(float(d1), float(d2)).cumulativeProbability(x), abs=1e-9)
    assert special.norm_ppf(0.975) == pytest.approx(1.959963984540054)


def test_refusals(spark):
    with pytest.raises(AnalysisError):
        digits.benford_test(numbers(spark, [1]), "x", position="third")
    with pytest.raises(AnalysisError):
        dispersion.variance_floor_test(numbers(spark, [1]), "x", -1.0)
    with pytest.raises(AnalysisError):
        bunching.Window.of(1.0, 0.5, 0.5)
    with pytest.raises(AnalysisError):
        power.power_curve(spark.range(10).selectExpr("id", "double(id) x"), "x", "id", lambda x: 1.0, lambda x, e, g: x + 1, "m", [1.0], [5])


def test_rate_limiter():
    slept, clock = [], [0.0]
    limiter = registry.RateLimiter(2.0, clock=lambda: clock[0], sleep=slept.append)
    assert limiter.wait() == 0 and limiter.wait() == pytest.approx(0.5) and slept == [pytest.approx(0.5)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, x double, t int, y int")
    assert digits.benford_test(empty, "x", ["k"]).collect() == []
    assert dispersion.smoothness_ratio(empty, "x", ["t"], ["k"]).collect() == []
    assert ranking.roc_auc(empty, "y", "x", "t", ["k"]).collect() == []
