"""Atlases, ladders, controls, traps and notch catalogues: what is published or refused, with results known by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from veritally.core.errors import AtlasError, CatalogueError, RedTeamError
from veritally.operators import control, power, redteam
from veritally.sources import atlas, catalogue

ROW = "method string, n long, effect_size double, power double, power_se double, n_replicates long, alpha double, false_positive_rate double"


def _atlas(spark, powers, n=100, method="m", alpha=0.05, fpr=0.05):
    return spark.createDataFrame([(method, n, e, p, 0.01, 200, alpha, fpr) for e, p in powers], ROW)


@pytest.fixture(scope="module")
def measured(spark):
    strong = _atlas(spark, [(0.0, 0.05), (0.1, 0.5), (0.2, 0.85), (0.3, 0.99)])
    return strong.union(_atlas(spark, [(0.0, 0.05), (0.1, 0.2), (0.2, 0.4), (0.3, 0.6)], n=50))


@pytest.fixture(scope="module")
def ladder(spark):
    rows = []
    for semantics, powers in (("sum_then_ratio", (0.99, 0.9, 0.3)), ("mean_of_ratios", (0.99, 0.95, 0.85))):
        for i, (level, n, p) in enumerate(zip(("unit", "precinct", "region"), (800, 80, 8), powers, strict=True)):
            rows.append((level, i, semantics, 0.2, n, 800.0 / n, p, 0.01, 0.05, 200, 0.05))
    return spark.createDataFrame(rows, power.LADDER.replace("semantics string", "level_ordinal int, semantics string"))


def test_published_atlas_is_looked_up(spark, measured, tmp_path):
    path = f"{tmp_path}/m"
    atlas.publish_atlas(measured, path, "m", "unit", seed=7)
    rows, spec = atlas.load_atlas(spark, path)
    assert rows.count() == 8 and spec["seed"] == 7 and spec["aggregation"] == "unit"
    found = atlas.PowerLookup(spark, [path, path])
    assert len(found) == 1 and found.methods() == ["m"] and found.rungs("m") == ["unit"]
    assert found.minimum_detectable_effect("m", 100) == 0.2
    assert found.detectable("m", 100, 0.2) and not found.detectable("m", 100, 0.1) and not found.detectable("m", 50, 0.3)
    for n in (50, 70):  # not reached; not measured, and nothing is interpolated
        with pytest.raises(AtlasError):
            found.minimum_detectable_effect("m", n)
    with pytest.raises(AtlasError):
        found.select("other")


def test_folder_of_atlases(spark, measured, ladder, tmp_path):
    folder = f"{tmp_path}/all"
    atlas.publish_atlas(measured, f"{folder}/one.parquet", "m", "unit", seed=7)
    atlas.publish_atlas(measured, f"{folder}/copy.parquet", "m", "unit", seed=7)
    atlas.publish_atlas(ladder, f"{folder}/ladder.parquet", "m", "precinct", semantics="sum_then_ratio", seed=8)
    atlas.publish_atlas(measured, f"{folder}/within/deeper.parquet", "m", "unit", seed=9)  # not looked into
    listed = {r.atlas: r for r in atlas.atlas_table(spark, folder).collect()}
    assert set(listed) == {"one.parquet", "copy.parquet", "ladder.parquet"} and not any(r.problem for r in listed.values())
    one = listed["one.parquet"]
    assert (one.method, one.aggregation, one.seed, one.n_rows, one.sample_sizes, one.effect_sizes) == ("m", "unit", 7, 8, [50, 100], [0.0, 0.1, 0.2, 0.3])
    assert one.fingerprint == listed["copy.parquet"].fingerprint != listed["ladder.parquet"].fingerprint
    found = atlas.PowerLookup(spark, folder=folder)
    assert len(found) == 2 and found.rungs() == ["precinct", "unit"] and found.select("m", "unit").count() == 8 and found.minimum_detectable_effect("m", 100, "unit") == 0.2
    with pytest.raises(AtlasError, match="2 atlases match.*seed 7.*seed 8"):
        found.select("m")
    assert "m (unit)" in found.describe()
    measured.withColumn("_spec", F.when(F.col("n") == 50, '{"method": "m", "library_version": "1"}').otherwise('{"method": "m", "library_version": "2"}')).write.parquet(f"{folder}/mixed.parquet")
    atlas.save_atlas(measured, f"{folder}/bare.parquet")
    atlas.save_atlas(measured, f"{folder}/other.parquet", {"method": "x", "library_version": "1", "aggregation": "unit"})
    problems = {r.atlas: r.problem for r in atlas.atlas_table(spark, folder).collect() if r.problem}
    assert problems == {"mixed.parquet": "its rows disagree on the settings", "bare.parquet": "it has no settings or version", "other.parquet": "its rows are of another method"}
    with pytest.raises(AtlasError, match="mixed.parquet: its rows disagree"):
        atlas.PowerLookup(spark, folder=folder)
    with pytest.raises(AtlasError, match="without settings"):
        measured.write.parquet(f"{tmp_path}/plain/a.parquet")
        atlas.read_atlases(spark, f"{tmp_path}/plain")


def test_atlas_refusals(spark, measured, tmp_path):
    path = f"{tmp_path}/no"
    mixed = measured.union(_atlas(spark, [(0.0, 0.1)], alpha=0.1))
    for frame in (measured.where("n = 1"), mixed, measured.drop("power_se"), measured.union(_atlas(spark, [(0.0, 0.1)], method="other"))):
        with pytest.raises(AtlasError):
            atlas.publish_atlas(frame, path, "m", "unit")
    atlas.save_atlas(measured, path)
    with pytest.raises(AtlasError):  # saved, but not published
        atlas.PowerLookup(spark, path)


def test_effect_of_a_loose_test_is_not_given(spark):
    row = power.minimum_detectable_effect(_atlas(spark, [(0.0, 0.5), (0.1, 0.9)], fpr=0.5)).first()
    assert row["minimum_detectable_effect"] is None and row["status"] != "ok"
    assert not power.detectable(_atlas(spark, [(0.0, 0.5), (0.1, 0.9)], fpr=0.5), 0.1).first()["detectable"]


def test_rungs_of_a_ladder(spark, ladder, tmp_path):
    level = lambda **k: power.coarsest_level_with_power(ladder, 0.2, **k).first()["level"]
    assert level() == "precinct" and level(semantics="mean_of_ratios") == "region" and level(target_power=1.0) is None
    rung = atlas.from_ladder(ladder, "precinct", "sum_then_ratio", "m").collect()
    assert [(r["method"], r["n"], r["power"]) for r in rung] == [("m", 80, 0.9)]
    path = f"{tmp_path}/ladder"
    atlas.publish_atlas(ladder, path, "m", "precinct", semantics="sum_then_ratio")
    assert atlas.PowerLookup(spark, path).minimum_detectable_effect("m", 80) == 0.2
    for rung, semantics in (("precinct", None), ("county", "sum_then_ratio")):
        with pytest.raises(AtlasError):
            atlas.publish_atlas(ladder, path, "m", rung, semantics=semantics)


def test_control_reports(spark):
    flags = [("a", "external", i < 20) for i in range(100)] + [("b", "synthetic", False)] * 1000 + [("c", "within_dataset", i < 5) for i in range(100)]
    reports = control.from_rejections(spark.createDataFrame(flags, "control string, kind string, rejected boolean"), 0.05)
    verdicts = {r["control"]: r["verdict"] for r in reports.collect()}
    assert verdicts == {"a": "anticonservative", "b": "conservative", "c": "calibrated"}
    assert [r["control"] for r in control.anticonservative(reports).collect()] == ["a"]
    worst = control.summary(reports).first()
    assert worst["worst_verdict"] == "anticonservative" and worst["has_external_control"]
    inner = reports.where("control <> 'a'")
    assert control.summary(inner).first()["worst_verdict"] == "conservative" and not control.summary(inner).first()["has_external_control"]
    assert "Warning" in control.format_table(inner.collect()) and "Warning" not in control.format_table(reports.collect())
    assert control.format_table([]).startswith("No controls")
    with pytest.raises(Exception, match="unknown control kind"):
        control.from_rejections(spark.createDataFrame([("a", "other", True)], "control string, kind string, rejected boolean"), 0.05).collect()


def test_small_units(spark):
    rows = redteam.small_units(spark, 4000, [10, 20], 0.5, seed=3).collect()
    assert len({r["unit_id"] for r in rows}) == 4000 and {r["den"] for r in rows} == {10, 20}
    assert all(0 <= r["num"] <= r["den"] for r in rows)
    assert sum(r["num"] for r in rows) / sum(r["den"] for r in rows) == pytest.approx(0.5, abs=0.01)
    assert rows == redteam.small_units(spark, 4000, [10, 20], 0.5, seed=3).collect()
    with pytest.raises(RedTeamError):
        redteam.small_units(spark, 0, [10])


def test_heterogeneous_mixture(spark):
    mixed = redteam.heterogeneous_mixture(spark, [(3000, 0.0, 1.0), (2000, 10.0, 2.0)], seed=1)
    found = {r["grp"]: r for r in mixed.groupBy("grp").agg({"*": "count", "value": "avg"}).collect()}
    assert mixed.select("unit_id").distinct().count() == 5000
    assert (found[0]["count(1)"], found[1]["count(1)"]) == (3000, 2000)
    assert found[0]["avg(value)"] == pytest.approx(0, abs=0.1) and found[1]["avg(value)"] == pytest.approx(10, abs=0.25)
    with pytest.raises(RedTeamError):
        redteam.heterogeneous_mixture(spark, [])


def test_notch_catalogue(spark, tmp_path):
    good = {"id": "a", "variable": "x", "threshold": 100.0, "kind": "notch", "side": "above", "incentive": "i", "evidence": "e", "confounds": ["c"]}
    bad = good | {"id": "b", "variable": " ", "threshold": None, "kind": "step", "side": "left", "confounds": []}
    path = tmp_path / "notches.json"
    path.write_text(json.dumps([good, bad]))
    found = catalogue.validate_notches(catalogue.load_notches(spark, str(path))).collect()
    assert {r["id"] for r in found} == {"b"} and [r["problem"] for r in found if r["severity"] == "warning"] == ["no confounds are listed"]
    assert {r["problem"] for r in found if r["severity"] == "error"} == {"variable is missing", "threshold is not a number", "kind is unknown", "side is unknown"}
    path.write_text(json.dumps([good, good]))
    with pytest.raises(CatalogueError):
        catalogue.load_notches(spark, str(path))


def test_thresholds_in_range(spark):
    values = spark.createDataFrame([(float(x),) for x in range(1, 11)] + [(math.nan,), (math.inf,), (None,)], "x double")
    asked = [0.5, 1.0, 5.5, 10.0, 11.0]
    assert [r["in_range"] for r in catalogue.in_range(values, "x", asked).orderBy("threshold").collect()] == [False, True, True, True, False]
    assert not any(r["in_range"] for r in catalogue.in_range(values.where("x > 99 and x < 100"), "x", asked).collect())
