"""Samples from a whole population, and ladders against a driver's loop."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.core import special
from veritally.core.errors import AtlasError, LadderError
from veritally.operators import power


def test_samples_share_no_row_while_there_is_room(spark):
    df = spark.range(1000).selectExpr("id", "double(id) AS x")
    rows = power.samples(df, "x", "id", [10, 400], 50, 3).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.n, r.sample].append(r.x)
    assert {(n, s) for n, s in by} == {(n, s) for n in (10, 400) for s in range(50)} and all(len(v) == n == len(set(v)) for (n, _), v in by.items())
    assert len({x for (n, _), v in by.items() if n == 10 for x in v}) == 500  # fifty samples of ten out of a thousand
    for s in range(0, 50, 2):  # two samples of 400 from an order
        assert not set(by[400, s]) & set(by[400, s + 1])
    assert len({frozenset(v) for v in by.values()}) == 100
    often = Counter(x for (n, _), v in by.items() if n == 400 for x in v)
    assert len(often) == 1000 and 8 <= min(often.values()) and max(often.values()) <= 25  # all rows come up alike: twenty times
    assert abs(np.mean([np.mean(v) for (n, _), v in by.items() if n == 10]) - 499.5) < 5 * 288 / 500**0.5


def test_samples_dont_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "IF(id % 50 = 0, NULL, double(id)) AS x")
    one, other = (sorted(map(tuple, power.samples(d, "x", "id", [40], 20, 1).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == other and len(one) == 800
    with pytest.raises(AtlasError):
        power.samples(df, "x", "id", [491], 1)
    with pytest.raises(AtlasError):
        power.samples(df.where("id < 0"), "x", "id", [1], 1)


def test_large_population_is_used_whole(spark):
    """More rows than any limit that a driver's copy would need; only the ranked ones are shuffled."""
    df = spark.range(0, 600_000, numPartitions=8).selectExpr("id", "double(id) AS x")
    rows = power.samples(df, "x", "id", [100], 20, 5)
    x = np.array([r.x for r in rows.collect()])
    assert len(x) == len(set(x)) == 2000 and x.max() > 590_000 and abs(np.mean(x) - 300_000) < 5 * 173_000 / 2000**0.5


def test_power_by_hand(spark):
    df = spark.range(4000).selectExpr("id", "double(id % 2) * 2 - 1 AS x")  # mean 0, standard deviation 1

    def test(x):
        if len(x) == 20:
            raise ZeroDivisionError  # never rejects
        return 2 * special.norm_sf(abs(float(np.mean(x))) * len(x) ** 0.5)

    rows = {(r.n, r.effect_size): r for r in power.power_curve(df, "x", "id", test, lambda x, e, g: x + e, "m", [0.3], [20, 100], 200).collect()}
    assert set(rows) == {(20, 0.0), (20, 0.3), (100, 0.0), (100, 0.3)}
    assert rows[20, 0.3].power == rows[20, 0.0].false_positive_rate == 0
    assert abs(rows[100, 0.3].power - 0.85) < 0.08 and rows[100, 0.3].false_positive_rate == rows[100, 0.0].power < 0.12
    assert rows[100, 0.3].n_replicates == 200 and rows[100, 0.3].method == "m"


def _panel(spark):
    rng = np.random.default_rng(2)
    den = rng.integers(5, 60, 90)
    return [(i, float(rng.binomial(d, 0.3)), float(d), f"g{i % 9}", None if i % 3 else "a") for i, d in enumerate(den.tolist())]


def test_ladder_equals_a_loop(spark):
    rows = _panel(spark)
    limit = float(np.mean([100 * r[1] / r[2] for r in rows])) + 1.0  # what an effect of 0.02 adds in the mean
    df = spark.createDataFrame(rows, "id long, k double, n double, a string, b string")

    def test(num, den, pct):
        return F.when(F.avg(pct) > limit, 0.01).when(F.max(num) > 1e9, 0.0)  # null elsewhere

    def moved(num, den, effect, draw):
        return num + effect * den * draw

    found = {(r.level, r.semantics, r.effect_size): r for r in power.aggregation_ladder(df, "k", "n", "id", [("unit", None), ("a", "a"), ("b", "b")], test, moved, [0.02, 0.1], n_replicates=12, seed=4).collect()}
    draws = {(r.id, r.replicate): r.u for r in df.select("id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("replicate")).withColumn("u", power.seeding.uniform(4, F.col("replicate"), F.col("id"))).collect()}
    for level, column in (("unit", 0), ("a", 3), ("b", 4)):
        for effect in (0.0, 0.02, 0.1):
            rejected = Counter()
            for replicate in range(1, 13):
                groups = defaultdict(list)
                for r in rows:
                    groups[r[column]].append((r[1] + effect * r[2] * draws[r[0], replicate], r[2]))
                ratios = {"sum_then_ratio": [100 * sum(k for k, _ in g) / sum(n for _, n in g) for g in groups.values()], "mean_of_ratios": [np.mean([100 * k / n for k, n in g]) for g in groups.values()]}
                for s, pct in ratios.items():
                    rejected[s] += np.mean(pct) > limit
            for s in power.SEMANTICS:
                r = found[level, s, effect]
                assert r.power == pytest.approx(rejected[s] / 12) and r.n_units == len(groups) and r.mean_group_size == pytest.approx(90 / len(groups))
                assert r.false_positive_rate == found[level, s, 0.0].power
    assert len(found) == 18 and len({r.power for r in found.values()}) > 2


def test_ladder_refuses(spark):
    df = spark.createDataFrame(_panel(spark), "id long, k double, n double, a string, b string")
    test, still = (lambda num, den, pct: F.avg(pct)), (lambda num, den, effect, draw: num)
    for bad in (df.withColumn("n", F.col("n") - F.col("n")), df.withColumn("k", F.lit(float("nan"))), df.where("id < 0")):
        with pytest.raises(LadderError):
            power.aggregation_ladder(bad, "k", "n", "id", [("unit", None)], test, still, [1.0])
    with pytest.raises(LadderError):
        power.aggregation_ladder(df, "k", "n", "id", [("a", "a")], test, still, [1.0])
    with pytest.raises(LadderError):  # moves units at effect 0
        power.aggregation_ladder(df, "k", "n", "id", [("unit", None)], test, lambda num, den, effect, draw: num + 1, [1.0])
