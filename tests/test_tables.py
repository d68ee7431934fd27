"""Table functions and callables in SQL against the DataFrame operators."""

import math

import numpy as np
import pytest

from veritally.core.errors import AnalysisError
from veritally.functions import tables
from veritally.ml import detectors, harness
from veritally.operators import digits, dispersion


@pytest.fixture(scope="module")
def series(spark):
    tables.register_tables(spark)
    rng = np.random.default_rng(2)
    rows = [(k, t, float(v)) for k in ("a", "b") for t, v in enumerate(rng.normal(3, 2, 40))] + [("a", 99, None), ("a", 98, float("nan")), ("c", 1, 5.0), ("c", 2, 5.0), ("c", 3, 5.0), ("d", 1, None), (None, 1, 2.0), (None, 2, 3.0), (None, 3, 2.5)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(3)
    df.createOrReplaceTempView("vt_test")
    return df


def test_rolling_floor_in_sql(spark, series):
    got = spark.sql("SELECT * FROM vt_rolling_floor(TABLE(vt_test) PARTITION BY (k) ORDER BY (t), 4.0D, 5)").collect()
    want = dispersion.rolling_variance_floor(series, "x", ["t"], 4.0, 5, ["k"]).select("k", "start", "end", "s2", "statistic", "pvalue", "flag").collect()
    key = lambda r: (r.k or "", r.start)
    assert len(got) == len(want) == 2 * 36
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a)[:3] == tuple(b)[:3] and tuple(a)[3:6] == pytest.approx(tuple(b)[3:6]) and a.flag == b.flag
    for bad in ("-1.0D, 5", "4.0D, 1"):
        with pytest.raises(Exception, match="floor must be positive"):
            spark.sql(f"SELECT * FROM vt_rolling_floor(TABLE(vt_test) PARTITION BY (k) ORDER BY (t), {bad})").collect()
    with pytest.raises(Exception, match="order of t"):
        spark.sql("SELECT * FROM vt_rolling_floor(TABLE(vt_test) PARTITION BY (k) ORDER BY (t DESC), 4.0D, 5)").collect()
    with pytest.raises(Exception, match="columns k and x"):
        spark.sql("SELECT * FROM vt_rolling_floor(TABLE(SELECT t, x FROM vt_test) PARTITION BY (t) ORDER BY (t), 4.0D, 5)").collect()


def test_smoothness_in_sql(spark, series):
    got = {r.k: r for r in spark.sql("SELECT * FROM vt_smoothness(TABLE(vt_test) PARTITION BY k ORDER BY t)").collect()}
    want = {r.k: r for r in dispersion.smoothness_ratio(series, "x", ["t"], ["k"]).collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["d"].n == 0 and got["d"].eta is None and got["c"].eta is None and want["c"].eta is None
    for k in ("a", "b", None):
        assert got[k].n == want[k].m and got[k].eta == pytest.approx(want[k].eta)


def test_leading_digits_in_sql(spark):
    tables.register_tables(spark)
    rng = np.random.default_rng(5)
    values = [*np.exp(rng.normal(3, 3, 500)).tolist(), 1.0, 10.0, 1000.0, 0.001, 9.9999999, 999.9999999999999, -5.0, 0.0, math.inf]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("none", -1.0)], "k string, x double")
    df.createOrReplaceTempView("vt_digits")
    got = {r.k: r for r in spark.sql("SELECT * FROM vt_leading_digits(TABLE(vt_digits) PARTITION BY k)").collect()}
    want = digits.benford_test(df, "x", ["k"]).where("k = 'g'").first()
    assert set(got) == {"g"} and got["g"].n == want.n and got["g"].chi2 == pytest.approx(want.chi2) and got["g"].mad == pytest.approx(want.mad) and got["g"].pvalue == pytest.approx(want.chi2_pvalue)


def test_callables_as_detectors(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(200) < 0.3).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b), i % 5) for i, (a, b) in enumerate(zip(rng.normal(size=200) + 2 * y, y, strict=True))], "unit_id long, x double, y int, grp int")
    call = detectors.FunctionDetector(lambda x: 3 * x - 1, columns=["x"])
    same = detectors.FunctionDetector("3 * x - 1")
    assert [r.score for r in call.score(df).orderBy("unit_id").collect()] == pytest.approx([r.score for r in same.score(df).orderBy("unit_id").collect()])
    spec = harness.EvalSpec("group", n_splits=2, ks=(0.1,))
    a, b = (sorted(map(tuple, harness.evaluate(d, df, spec).select("metric", "k", "value").where("fold is null").collect())) for d in (call, same))
    assert a == b
    with pytest.raises(AnalysisError):
        detectors.FunctionDetector(lambda x: x)
    with pytest.raises(Exception, match="finite"):
        detectors.FunctionDetector(lambda x: x * math.nan, columns=["x"]).score(df).collect()


def test_unit_aggregates_in_frames_and_sql(spark):
    df = spark.createDataFrame([(u, float(v), float(w)) for u, n in ((1, 5), (2, 8)) for v, w in zip(range(n), range(n, 0, -1), strict=True)], "unit_id int, x double, w double")
    spread = detectors.UnitDetector(lambda x: x.max() - x.min(), ["x"], "vt_spread")
    weighted = detectors.UnitDetector(lambda x, w: np.average(x, weights=w), ["x", "w"], "vt_weighted", higher_is_suspicious=False)
    detectors.register_sql(spark, [spread, weighted])
    df.createOrReplaceTempView("vt_units")
    rows = {r.unit_id: r for r in spark.sql("SELECT unit_id, vt_spread(x) AS s, vt_weighted(x, w) AS w FROM vt_units GROUP BY unit_id").collect()}
    assert (rows[1].s, rows[2].s) == (4.0, 7.0)
    for d, c in ((spread, "s"), (weighted, "w")):
        assert {r.unit_id: r.score for r in d.score(df).collect()} == pytest.approx({u: r[c] for u, r in rows.items()})
    assert rows[1].w == pytest.approx(-np.average(range(5), weights=range(5, 0, -1)))
    with pytest.raises(Exception, match="can't score unit"):
        detectors.UnitDetector(lambda x: 1.0, ["x"], min_len=6).score(df).collect()
