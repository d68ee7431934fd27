"""Draws of metrics by cells against resampling of rows, and what a summary says of draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.core.errors import AnalysisError
from veritally.operators import bootstrap, bunching, ranking


def rows(n, seed, distinct=None, share=0.3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < share).astype(int)
    s = rng.normal(size=n) + y
    if distinct:
        s = np.round(s * distinct) / distinct
    return y, s


def metric(name, y, s, k, rng):
    """On rows, ties in random order."""
    order = np.lexsort((rng.random(len(s)), -s))
    y, s = y[order], s[order]
    p, n = y.sum(), len(y) - y.sum()
    if name == "roc_auc":
        above = np.array([(y[s > v]).sum() + (y[s == v]).sum() / 2 for v in s])
        return ((1 - y) * above).sum() / (p * n) if p and n else None
    if name == "average_precision":
        return sum(y[s == v].sum() * y[s >= v].sum() / (s >= v).sum() for v in set(s.tolist())) / p if p else None
    cut = k if isinstance(k, int) else max(1, int(np.ceil(k * len(y))))
    hits = y[:cut].sum()
    if name == "ndcg":
        return (y[:cut] / np.log2(np.arange(2, cut + 2))).sum() / (1 / np.log2(np.arange(2, min(cut, p) + 2))).sum() if p else None
    return hits / cut if name == "precision" else hits / p if p else None


def resampled(name, y, s, k, n_boot, stratified, rng):
    out = []
    for _ in range(n_boot):
        if stratified:
            pos, neg = np.flatnonzero(y), np.flatnonzero(1 - y)
            at = np.concatenate([rng.choice(pos, len(pos)), rng.choice(neg, len(neg))])
        else:
            at = rng.integers(0, len(y), len(y))
        out.append(metric(name, y[at], s[at], k, rng))
    return np.array([v for v in out if v is not None])


@pytest.fixture(scope="module")
def scored(spark):
    out = {}
    for key, args in {"fine": (400, 1), "ties": (400, 2, 2)}.items():
        out[key] = rows(*args)
    table = spark.createDataFrame([(key, int(y), float(s), i) for key, (ys, ss) in out.items() for i, (y, s) in enumerate(zip(ys, ss, strict=True))], "k string, y int, s double, id int")
    return out, table.cache()


@pytest.mark.parametrize(("name", "k", "stratified"), [("roc_auc", None, True), ("roc_auc", None, False), ("average_precision", None, True), ("precision", 40, False), ("recall", 0.1, True), ("ndcg", 30, False)])
def test_draws_have_the_distribution_of_resampled_rows(spark, scored, name, k, stratified, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKETS", 7)
    data, table = scored
    draws = bootstrap.metric_draws(table, "y", "s", "id", name, k, ["k"], 400, 3, stratified).collect()
    rng = np.random.default_rng(9)
    for key, (y, s) in data.items():
        got = np.array([r.draw for r in draws if r.k == key])
        want = resampled(name, y, s, k, 400, stratified, rng)
        assert len(got) == 400
        error = want.std() * (2 / 400) ** 0.5
        assert abs(got.mean() - want.mean()) < 4.5 * error and 0.8 < got.std() / want.std() < 1.25


def test_draws_dont_depend_on_partitions_and_hold_their_sizes(spark, scored):
    _, table = scored
    a, b = (sorted(map(tuple, bootstrap.metric_draws(t, "y", "s", "id", "roc_auc", by=["k"], n_boot=5).collect())) for t in (table.coalesce(1), table.repartition(5)))
    assert a == b and len({x[2] for x in a}) == 10


def test_failed_draws_and_null_keys(spark):
    few = spark.createDataFrame([(None, 1, 0.5, 1), (None, 0, 0.4, 2), (None, 0, 0.1, 3), ("only", 0, 0.3, 4), ("only", 0, 0.2, 5)], "k string, y int, s double, id int")
    draws = bootstrap.metric_draws(few, "y", "s", "id", by=["k"], n_boot=300)
    found = {r.k: r for r in bootstrap.summary(draws, ranking.roc_auc(few, "y", "s", "id", ["k"]), "roc_auc", ["k"]).collect()}
    assert found["only"].n_failed == 300 and found["only"].ci_low is None and found["only"].point is None
    assert 60 < found[None].n_failed < 140 and found[None].n_boot == 300  # (2/3)^3 without a positive, (1/3)^3 without a negative
    kept = bootstrap.metric_draws(few.where("k is null"), "y", "s", "id", n_boot=50, stratified=True)
    assert kept.where("draw is null").count() == 0
    for options in ({"metric": "f1"}, {"metric": "ndcg"}, {"k": 5}, {"n_boot": 1}, {"metric": "recall", "k": 1.5}):
        with pytest.raises(AnalysisError):
            bootstrap.metric_draws(few, "y", "s", "id", **options)


def test_summary_by_hand(spark):
    draws = spark.createDataFrame([("a", i, float(i)) for i in range(1, 102)] + [("a", 102, None), ("b", 1, 5.0)], "k string, replicate int, draw double")
    estimate = spark.createDataFrame([("a", 50.0), ("b", 4.0)], "k string, v double")
    found = bootstrap.summary(draws, estimate, "v", ["k"], 0.1)
    r = {r.k: r for r in found.collect()}
    assert (r["a"].ci_low, r["a"].ci_high, r["a"].bias, r["a"].n_boot, r["a"].n_failed) == pytest.approx((6.0, 96.0, 1.0, 102, 1))
    assert r["a"].se == pytest.approx(np.std(np.arange(1, 102), ddof=1)) and r["b"].se is None and r["b"].bias == 1.0
    inside = {x.k: x.c for x in found.select("k", bootstrap.covers(6.0).alias("c")).collect()}
    assert inside == {"a": True, "b": None} and not found.where("k = 'a'").select(bootstrap.covers(5.9)).first()[0]
    record = bootstrap.to_test_result(found, "boot", ["k"]).where("k = 'a'").first()
    assert record.method == "boot" and record.statistic == 50.0 and record.pvalue is None and record.n == 102 and record.details.ci_high == pytest.approx(96.0)


def test_bunching_draws_take_any_statistic(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 100, 4000), rng.uniform(48, 50, 300)])
    df = spark.createDataFrame([(float(v), "g") for v in x], "x double, k string")
    window = bunching.Window.of(2.0, 4.0, 4.0, poly_degree=3)
    draws = bunching.bunching_draws(df, "x", 50.0, window, ["k"], 60, 1, "pairs", lambda found: found["excess_mass"] / 2)
    half = [r.draw for r in draws.orderBy("replicate").collect()]
    whole = [r.draw for r in bunching.bunching_draws(df, "x", 50.0, window, ["k"], 60, 1, "pairs", "excess_mass").orderBy("replicate").collect()]
    assert len(half) == 61 and [2 * h for h in half] == pytest.approx(whole) and abs(whole[0] - 300) < 60
    row = bunching.bootstrap_bunching(df, "x", 50.0, window, ["k"], 60, 0.1, 1, "pairs", "excess_mass").first()
    assert row.estimate == pytest.approx(whole[0]) and (row.low, row.high) == pytest.approx(tuple(np.quantile(whole[1:], [0.05, 0.95]))) and row.n_failed == 0
    kept = draws.where("replicate > 0")
    found = bootstrap.summary(kept, draws.where("replicate = 0").select("k", F.col("draw").alias("v")), "v", ["k"], 0.1, "pairs").first()
    assert found.bias == pytest.approx(np.mean(half[1:]) - half[0])
