"""Folds of groups against the greedy rule, one group after the other."""

import random

import pytest
from pyspark.sql import functions as F

from veritally.core.errors import AnalysisError
from veritally.ml import detectors, harness


def greedy(sizes, n_splits):
    load, out = [0] * n_splits, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fold = load.index(min(load))
        load[fold] += n
        out[name] = fold
    return out


def test_dealing_equals_the_greedy_rule():
    rng = random.Random(3)
    for _ in range(3000):
        k = rng.randint(2, 6)
        loads = [rng.randint(0, rng.choice((0, 5, 60))) for _ in range(k)]
        size, count = rng.randint(1, 12), rng.randint(1, 70)
        want, step = list(loads), []
        for _ in range(count):
            f = want.index(min(want))
            want[f] += size
            step.append(f)
        got = list(loads)
        runs = harness._dealt(got, size, count)
        assert got == want
        assert [turn[i % len(turn)] for first, turn, ranks in runs for i in range(ranks)] == step
        assert [r[0] for r in runs] == [sum(x[2] for x in runs[:i]) for i in range(len(runs))]
    loads = [10**9, 0, 10**6]  # far apart: whole rounds at once
    assert len(harness._dealt(loads, 1, 10**10)) < 20 and max(loads) - min(loads) <= 1


@pytest.mark.parametrize("kind", ["string", "long"])
def test_folds_equal_the_greedy_rule(spark, kind):
    rng = random.Random(5)
    sizes = {}
    for g in range(300):
        name = (f"{rng.choice(('same long prefix ', 'é', '', 'Z'))}{g}" if kind == "string" else rng.randrange(-(10**6), 10**6))
        sizes[name] = rng.choice((1, 1, 1, 2, 3, 3, 9, 40))
    rows = [(g, i) for g, n in sizes.items() for i in range(n)] + [(None, 1)] * 5
    df = spark.createDataFrame(rows, f"grp {kind}, i int").repartition(4)
    found = {r.grp: r.fold for r in harness.group_folds(df, 4).collect()}
    order = {n: n.encode() if kind == "string" else n for n in sizes}
    want = greedy({order[n]: c for n, c in sizes.items()}, 4)
    assert found == {n: want[order[n]] for n in sizes}


def test_few_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "grp string, i int")
    assert {r.grp: r.fold for r in harness.group_folds(df, 2).collect()} == {"a": 0, "b": 1}
    with pytest.raises(AnalysisError):
        harness.group_folds(df, 3)
    assert harness.group_folds(df.withColumn("grp", F.lit("")).union(df), 2).count() == 3


def test_folds_can_be_filtered(spark):
    """One group of five rows and seven of two: those of two are dealt in two runs, and a filter on the fold goes below the join with them."""
    sizes = {"a": 5, **{f"b{i}": 2 for i in range(7)}}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "grp string, i int")
    assert [len(r[1]) for r in harness._dealt([5, 0, 0], 2, 7)] == [2, 3]
    found = harness.group_folds(df, 3)
    assert {r.grp: r.fold for r in found.where("fold is not null").collect()} == greedy(sizes, 3)
    assert {r.grp for r in found.where("fold = 1").collect()} == {g for g, f in greedy(sizes, 3).items() if f == 1}


def test_the_plan_of_folds_is_not_repeated(spark):
    rng = random.Random(8)
    rows = [(i, f"g{rng.randrange(9)}" if i % 11 else None, rng.random(), rng.randrange(2) if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "unit_id long, grp string, x double, y int")
    spec = harness.EvalSpec("group", n_splits=3, ks=(0.1,))

    class Fitted(detectors.FunctionDetector):
        fits = True

    found = [harness.evaluate(kind("x"), df, spec) for kind in (detectors.FunctionDetector, Fitted)]
    for one in found:
        assert one._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 100  # 2,700 with the folds and the input in every metric
    key = lambda r: (str(r.fold), r.metric, r.k)
    a, b = (sorted(one.collect(), key=key) for one in found)
    assert list(map(key, a)) == list(map(key, b)) and len(a) == 4 * 5
    assert [r.value for r in a] == pytest.approx([r.value for r in b])
    fold = {r.grp: r.fold for r in harness.group_folds(df, 3).collect()}
    for f in range(3):
        tested = [(x, y) for _, g, x, y in rows if y is not None and fold.get(g) == f]
        pairs = [(p > q) for p, y in tested if y for q, z in tested if not z]
        assert next(r.value for r in a if r.fold == f and r.metric == "roc_auc") == pytest.approx(sum(pairs) / len(pairs))
    for m in harness.METRICS:
        each = [r.value for r in a if r.fold is not None and r.metric == m]
        assert next(r.value for r in a if r.fold is None and r.metric == m) == pytest.approx(sum(each) / 3)
