"""Every detector on every trap in one plan, and error rates at which a digit test fires."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.core.errors import RedTeamError
from veritally.operators import digits, dispersion, redteam
from veritally.plans import catalogue

from .conftest import SF


def _mean_test(frame):
    z = frame["x"].mean() / frame["x"].std() * len(frame) ** 0.5
    return math.erfc(abs(z) / 2**0.5)


def _floor(table, by):
    return dispersion.variance_floor_test(table, "x", 4.0, by).select(*by, "pvalue")


def test_grid_of_pandas_and_table_detectors(spark):
    rng = np.random.default_rng(1)
    sample = lambda values: spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")
    a, b = rng.normal(0, 1, 300), rng.normal(1, 2, 200)
    samples = {"level_shift": sample(a), "heterogeneous_mixture": sample(b), "small_units": sample([])}

    class Result:
        pvalue = 0.04

    def broken(frame):
        raise ZeroDivisionError(f"{len(frame)} rows")

    detectors = {"mean": _mean_test, "floor": _floor, "record": lambda frame: Result(), "broken": broken, "none": lambda frame: None}
    found = {(r.detector, r.trap): r for r in redteam.red_team(detectors, samples, by_table=["floor"]).collect()}
    assert set(found) == {(d, t) for d in detectors for t in samples}
    assert found["mean", "level_shift"].pvalue == pytest.approx(math.erfc(abs(a.mean()) / a.std(ddof=1) * 300**0.5 / 2**0.5))
    assert found["mean", "heterogeneous_mixture"].fired and found["mean", "heterogeneous_mixture"].n == 200
    want = {r.trap: r.pvalue for r in _floor(samples["level_shift"].withColumn("trap", F.lit("level_shift")), ["trap"]).collect()}
    assert found["floor", "level_shift"].pvalue == pytest.approx(want["level_shift"]) and found["floor", "level_shift"].fired and found["floor", "level_shift"].error is None
    assert found["record", "level_shift"].fired and "300 rows" in found["broken", "level_shift"].error and "ZeroDivisionError" in found["broken", "level_shift"].error
    assert found["none", "level_shift"].error and not found["none", "level_shift"].fired
    for d in detectors:  # an empty sample is a row, too
        assert found[d, "small_units"].n == 0 and not found[d, "small_units"].fired and found[d, "small_units"].error
    with pytest.raises(RedTeamError):
        redteam.red_team({"a": _mean_test}, samples, by_table=["b"])
    with pytest.raises(RedTeamError):
        redteam.red_team({"a": _mean_test}, samples, alpha=1.0)


def test_positions_and_signs(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([123456, -95, 7, 0, 3569])], "id long, v long")
    read = lambda **k: [r.misread for r in redteam.ocr_noise(df, "v", "id", 1.0, redteam.GLYPHS, **k).orderBy("id").collect()]
    assert read() == [128488, -88, 7, 0, 8888]
    assert read(positions=[0]) == [123458, -98, 7, 0, 3568]
    assert read(positions=[1, 2]) == [123486, -85, 7, 0, 3889]
    other = [r.misread for r in redteam.ocr_noise(df, "v", "id", 1.0, None, positions=[0]).orderBy("id").collect()]
    assert all(o // 10 == v // 10 and o % 10 != v % 10 for o, v in zip([abs(x) for x in other], [123456, 95, 7, 0, 3569], strict=True))
    for bad in ({"positions": []}, {"positions": [-1]}):
        with pytest.raises(RedTeamError):
            redteam.ocr_noise(df, "v", "id", 0.1, **bad)


@pytest.mark.parametrize("confusion", [None, redteam.GLYPHS])
@pytest.mark.parametrize("positions", [None, [0], [0, 2, 5]])
def test_numbers_are_drawn_once_for_all_rates(spark, confusion, positions):
    """Each cell of the grid is what ``ocr_noise`` gives at its rate, from one draw for each digit of a row's replicate."""
    values = [0, 7, -95, 3569, 10**15 + 3, None, *range(400, 460)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    rates, seen = [0.0, 0.2, 0.5, 1.0], []

    def keep(table, by):
        seen.append(table)
        return table.groupBy(*by).agg(F.lit(0.5).alias("pvalue"))

    redteam.ocr_firings(df, "v", "id", keep, rates, 2, confusion=confusion, seed=6, positions=positions)
    got = Counter(map(tuple, seen[0].select("rate", "replicate", "misread").collect()))
    want = Counter()
    for rate in rates:
        for r in (1, 2):
            named = df.select(F.concat_ws(":", F.lit(r), "id").alias("name"), "v")
            want += Counter((rate, r, x.misread) for x in redteam.ocr_noise(named, "v", "name", rate, confusion, seed=6, positions=positions).collect())
    assert got == want
    plan = seen[0]._jdf.queryExecution().optimizedPlan()
    above = [plan]
    while "Generate explode" not in above[-1].nodeName() + " " + above[-1].simpleString(99):
        above.append(above[-1].children().head())
    assert not any("md5" in p.simpleString(10**5) for p in above)  # the rates are dealt last
    assert "md5" in plan.toString()


def test_threshold_of_the_detector_itself(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(rng.integers(1000, 100_000, 3000))], "id long, v long")

    def terminal(table, by):
        return digits.terminal_digit_test(table, "misread", by)

    rates = [0.0, 0.01, 0.2, 0.6]
    found = redteam.ocr_firings(df, "v", "id", terminal, rates, 6, confusion=redteam.GLYPHS, seed=2).collect()
    assert Counter(r.rate for r in found) == dict.fromkeys(rates, 6)
    share = {x: np.mean([r.fired for r in found if r.rate == x]) for x in rates}
    assert share[0.0] in (0.0, 1.0) and share[0.6] == 1.0  # without errors all replicates are the same table
    want = min(x for x in rates if share[x] > 0.5)
    assert redteam.ocr_firing_threshold(df, "v", "id", terminal, rates, n_replicates=6, confusion=redteam.GLYPHS, seed=2).first().threshold == want
    never = lambda table, by: table.groupBy(*by).agg(F.lit(None).cast("double").alias("pvalue"))
    assert redteam.ocr_firing_threshold(df, "v", "id", never, rates, n_replicates=2).first().threshold is None
    for bad in ({"rates": []}, {"rates": [1.5]}, {"rates": [0.1], "n_replicates": 0}):
        with pytest.raises(RedTeamError):
            redteam.ocr_firings(df, "v", "id", terminal, **bad)
    with pytest.raises(RedTeamError):
        redteam.ocr_firing_threshold(df, "v", "id", terminal, rates, fire_share=1.0)


def test_the_threshold_draws_below_its_rates(spark):
    """One number for the last digit, before rows are copied to the rates."""
    lines = catalogue.queries()["redteam_ocr_threshold"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    drawn = [i for i, line in enumerate(lines) if "md5" in line]
    rates = [i for i, line in enumerate(lines) if "Generate explode([0.0" in line]
    assert len(drawn) == len(rates) == 1 and rates[0] < drawn[0] and lines[drawn[0]].count("md5") == 1
