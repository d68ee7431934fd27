"""The Monte-Carlo null of whole per cents against draws unit by unit, and against the exact null."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.core.columns import jsonable
from veritally.core.errors import CatalogueError
from veritally.ml import detectors, harness
from veritally.operators import bunching, percent
from veritally.sources import catalogue


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, n in (("a", 400), ("b", 150), (None, 120)):
        den = rng.choice([100, 120, 137, 200, 250], n)
        rows += [(k, int(rng.binomial(d, p)), int(d), float(rng.choice([1.0, 2.5]))) for d, p in zip(den, rng.uniform(0.2, 0.8, n), strict=True)]
    rows += [("b", 100, 200, 1.0)] * 60 + [("small", 3, 10, 1.0), ("a", 0, 100, 1.0), ("a", 100, 100, 1.0)]
    return spark.createDataFrame(rows, "k string, num long, den long, w double"), rows


@pytest.mark.parametrize("weight", [None, "w"])
def test_null_equals_draws_by_unit(units, weight):
    df, rows = units
    n_mc = 600
    found = {r.k: r for r in percent.integer_excess(df, "num", "den", ["k"], n_mc=n_mc, seed=5, weight=weight).collect()}
    exact = {r.k: r for r in percent.integer_excess_exact(df, "num", "den", ["k"], weight=weight).collect()}
    rng = np.random.default_rng(8)
    for k in ("a", "b", None):
        own = [(n, d, w if weight else 1.0) for g, n, d, w in rows if g == k]
        hits, cells = np.zeros(n_mc), np.zeros((n_mc, 101))
        for n, d, w in own:
            pct = 100.0 * rng.binomial(d, n / d, n_mc) / d
            near = np.abs(pct - np.rint(pct)) <= 0.05
            hits += w * near
            cells[near, np.rint(pct[near]).astype(int)] += w
        r, sd = found[k], hits.std(ddof=1)
        assert abs(r.expected_mean - hits.mean()) < 5 * sd * (2 / n_mc) ** 0.5 and 0.85 < r.expected_sd / sd < 1.18
        assert abs(r.expected_mean - exact[k].expected_mean) < 5 * sd / n_mc**0.5 and r.observed == pytest.approx(exact[k].observed) and r.n == len(own)
        seen = np.zeros(101)
        for n, d, w in own:
            if abs(100 * n / d - round(100 * n / d)) <= 0.05:
                seen[round(100 * n / d)] += w
        assert np.abs(np.array(r.per_integer) - (seen - cells.mean(axis=0))).max() < 6 * cells.std(axis=0).max() * (2 / n_mc) ** 0.5
        assert sum(r.per_integer) == pytest.approx(r.observed - r.expected_mean)
        assert abs(r.mc_pvalue - (1 + (hits >= r.observed).sum()) / (n_mc + 1)) < 0.1
    assert found["b"].pvalue < 0.01 and found["small"].n == 0 and found["small"].mc_pvalue is None and found["small"].n_excluded_small == 1


def test_draws_dont_depend_on_partitions(units):
    df, _ = units
    a, b = (percent.integer_excess(d, "num", "den", ["k"], n_mc=20, seed=1).orderBy("k").collect() for d in (df.coalesce(1), df.repartition(6)))
    assert [(r.k, r.observed, r.n) for r in a] == [(r.k, r.observed, r.n) for r in b] and [r.expected_mean for r in a if r.n] == pytest.approx([r.expected_mean for r in b if r.n])
    one = percent.integer_excess(df, "num", "den", n_mc=1).first()
    assert one.expected_sd == 0 and len(one.per_integer) == 101


def test_lattice_sums_to_the_chance_of_a_hit():
    from veritally.core import special

    for n, p in ((100, 0.3), (137, 0.5), (250, 0.01), (120, 0.0), (120, 1.0)):
        places, chances = percent._lattice(n, p, 0.05)
        assert chances.sum() == pytest.approx(special.binomial_lattice(n, p, 0.05)) and (places <= 100).all()


def test_rows_as_json(spark):
    df = spark.createDataFrame([(1, math.nan, [1.0, math.inf, None], "x"), (2, 1.5, None, None)], "a int, b double, c array<double>, d string")
    assert sorted(r.json for r in jsonable(df).collect()) == ['{"a":1,"b":null,"c":[1.0,null,null],"d":"x"}', '{"a":2,"b":1.5,"c":null,"d":null}']


def test_entries_as_notches(spark):
    row = lambda **x: {"id": "e", "threshold": 5.0, "kind": "notch", "side": "below"} | x
    assert catalogue.to_notch(row()) == bunching.Notch(5.0, "below", "e") and catalogue.to_notch(row(kind="kink")) == bunching.Kink(5.0, "e")
    assert catalogue.to_notch(row(kind=None, side=None)) == bunching.Notch(5.0, "above", "e")
    listed = spark.createDataFrame([("e", "x", 5.0, "notch", "above", "i", "v", ["c"], s, "") for s in ("verified", "unverified")], catalogue.SCHEMA)
    assert catalogue.validate_notches(listed).count() == 0 and catalogue.to_notch(listed.first()).label == "e"
    for bad in (row(threshold=None), row(kind="step")):
        with pytest.raises(CatalogueError):
            catalogue.to_notch(bad)


def test_transfer_reports_how_it_did_at_home(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(200) < 0.4).astype(int)
    source = spark.createDataFrame([(i, float(v), int(t) if i % 4 else None, i % 5) for i, (v, t) in enumerate(zip(rng.normal(size=200) + 2 * y, y, strict=True))], "unit_id long, x double, y int, grp int")
    target = source.select("unit_id", "x")
    detector = detectors.LogisticDetector(["x"])
    spec = harness.EvalSpec("group", n_splits=2, ks=(0.1,), metrics=("roc_auc",))
    found = harness.transfer(detector, source, target, source_spec=spec)
    assert detector.model is None and found.detector.model is not None  # the one handed in isn't fitted
    assert found.n_source_fit == 150 and found.source_report.where("fold is null").first().value > 0.8
    assert found.scores.orderBy("rank").first().unit_id == target.orderBy(F.col("x").desc()).first().unit_id
    assert harness.transfer(detectors.FunctionDetector("x"), source, target, fit_on="all").n_source_fit == 200 and harness.transfer(detectors.FunctionDetector("x"), source, target).source_report is None
    for options in ({"fit_on": "some"}, {"source": source.where("y is null")}, {"target": target.limit(0)}):
        with pytest.raises(ValueError):
            harness.transfer(detector, options.get("source", source), options.get("target", target), fit_on=options.get("fit_on", "auto"))
