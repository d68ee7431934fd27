"""Rules that the catalogue doesn't reach: splits, refusals, null keys, the registry's write-back, fetch rules."""

import math

import pytest
from pyspark.sql import functions as F

from veritally.core.errors import AnalysisError, CatalogueError, RedTeamError
from veritally.ml import detectors, harness
from veritally.operators import balance, bunching, digits, dispersion, percent, redteam
from veritally.sources import registry


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(i, float(i % 7), i % 2, i % 5, 2000 + i % 4) for i in range(200)]
    return spark.createDataFrame(rows, "unit_id long, x double, y int, grp int, time int")


def test_anchor_rows_are_the_test(panel):
    placed = harness.folds(panel, harness.EvalSpec("anchor", anchor="unit_id < 60"))
    assert placed.where("fold = 0").count() == 60 and placed.where("fold = 0 and unit_id >= 60").count() == 0
    assert harness.training(placed, 0, False).count() == 140
    for condition in ("unit_id < 0", "unit_id >= 0"):
        with pytest.raises(AnalysisError):
            harness.folds(panel, harness.EvalSpec("anchor", anchor=condition))


def test_temporal_split(panel):
    placed = harness.folds(panel, harness.EvalSpec("temporal", train_end=2002))
    assert {r.time for r in placed.where("fold = 0").collect()} == {2003} and harness.training(placed, 0, False).count() == 150
    undated = panel.withColumn("time", F.when(F.col("unit_id") != 3, F.col("time")))
    for df, end in ((undated, 2002), (panel, 2003), (panel, 1999)):
        with pytest.raises(AnalysisError):
            harness.folds(df, harness.EvalSpec("temporal", train_end=end))


def test_no_split_grades_what_was_fitted(panel):
    spec = harness.EvalSpec("none", metrics=("roc_auc", "recall"), ks=(0.1,))
    placed = harness.folds(panel.withColumn("y", F.when(F.col("unit_id") >= 10, F.col("y"))), spec)
    assert harness.training(placed, 0, False, True).count() == 190 == placed.where("fold = 0").count()
    found = harness.evaluate(detectors.FunctionDetector("x"), panel, spec).collect()
    assert {r.metric for r in found} == {"roc_auc", "recall"}
    with pytest.raises(AnalysisError):
        harness.EvalSpec(metrics=("accuracy",))


def test_null_keys_stay(spark):
    rows = [(k, t, 1.37 * t + (t * 7919 % 13) + 0.01 * (t % 5), 400 + t, 150 + t % 40) for k in ("a", None) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, x double, den int, num int")
    keys = lambda out: sorted((r.k for r in out.collect()), key=str)
    both = [None, "a"]
    assert keys(digits.terminal_pair_test(df, "den", ["k"])) == both
    assert keys(dispersion.too_smooth_test(df, "x", ["t"], ["k"], n_perm=9)) == both
    assert keys(bunching.bunching_linear(df, "x", 40.0, bunching.Window.of(4.0, 8.0, 8.0), ["k"])) == both
    assert keys(percent.integer_excess_exact(df, "num", "den", ["k"])) == both
    drawn = percent.integer_excess(df, "num", "den", ["k"], n_mc=5)
    assert keys(drawn) == both and drawn.where("mc_pvalue is null").count() == 0
    table = spark.createDataFrame([(k, v, g, 50.0 + g + v % 3, 10.0, 20) for k in ("a", None) for v in range(8) for g in range(3)], "k string, v int, g int, mean double, sd double, n int")
    assert keys(balance.carlisle_test(table, "mean", "sd", "n", "v", ["k"])) == both


def test_level_shift(spark):
    series = spark.createDataFrame([(t, 10.0) for t in range(10)], "t int, x double")
    assert [r.shifted for r in redteam.level_shift(series, "x", "t", 5, 0.1, "multiplicative").orderBy("t").collect()] == pytest.approx([10.0] * 5 + [1.0] * 5)
    for at, size, kind in ((0, 1.0, "additive"), (10, 1.0, "additive"), (5, -1.0, "multiplicative"), (5, 1.0, "other")):
        with pytest.raises(RedTeamError):
            redteam.level_shift(series, "x", "t", at, size, kind)


def test_red_team_records(spark):
    def broken(_):
        raise ValueError("no")

    sample = spark.range(1)
    found = {r.detector: r for r in redteam.red_team({"nan": lambda _: math.nan, "fires": lambda _: 0.01, "calm": lambda _: 0.5, "broken": broken}, {"level_shift": sample}).collect()}
    assert found["nan"].pvalue is None and not found["nan"].fired and "nan" in found["nan"].error
    assert found["fires"].fired and found["fires"].error is None and not found["calm"].fired
    assert found["broken"].error == "ValueError: no"
    results = redteam.red_team({"a": lambda _: 0.01, "b": lambda _: 0.9}, {"level_shift": sample, "ocr_noise": sample})
    assert [r.detector for r in redteam.casualties(results).collect()] == ["a", "a"] and redteam.survivors(results, "b").count() == 2 and redteam.survivors(results, "a").count() == 0
    for arguments in (({}, {"level_shift": sample}), ({"a": lambda _: 0.1}, {})):
        with pytest.raises(RedTeamError):
            redteam.red_team(*arguments)


def test_ocr_threshold_and_gate(spark):
    rates = spark.createDataFrame([(r, f) for r, fires in ((0.02, 1), (0.05, 3), (0.1, 4)) for f in [True] * fires + [False] * (4 - fires)], "rate double, fired boolean")
    assert redteam.firing_threshold(rates).first()["threshold"] == 0.05
    gates = spark.createDataFrame([(0.05, 0.1), (0.1, 0.1), (0.2, 0.1), (None, 0.1)], "t double, m double").select(redteam.ocr_gate(F.col("t"), F.col("m")).alias("g"))
    assert [r.g for r in gates.collect()] == [False, False, True, False]


def _entry(**fields):
    base = {n.split()[0]: None for n in registry.SOURCE.split(", ")}
    return tuple((base | {"id": "s", "name": "n", "provider": "p", "url": "u", "access": "open", "status": "partial"} | fields).values())


def test_registry_round_trip(spark, tmp_path):
    path = f"{tmp_path}/sources"
    registry.save_sources(spark.createDataFrame([_entry(), _entry(id="t")], registry.SOURCE), path)
    registry.save_sources(registry.update_source(registry.load_sources(spark, path), "t", notes="seen"), path)
    assert {r.id: r.notes for r in registry.load_sources(spark, path).collect()} == {"s": None, "t": "seen"}
    with pytest.raises(CatalogueError):
        registry.save_sources(registry.update_source(registry.load_sources(spark, path), "s", status="odd"), path)
    with pytest.raises(CatalogueError):
        registry.update_source(registry.load_sources(spark, path), "s", colour="red")
    assert registry.load_sources(spark, path).count() == 2 and len(list(tmp_path.iterdir())) == 1
    assert {r.id: r.attempt for r in registry.plan_acquisition(registry.load_sources(spark, path), ["s"]).collect()} == {"s": True, "t": False}


def test_fetch_log_and_transitions(spark, tmp_path):
    digest = "ab" * 32
    sources = spark.createDataFrame(
        [_entry(id="ok", blocked_reason="HTTP 403"), _entry(id="nosha"), _entry(id="gone", notes="old"), _entry(id="wall", access="paywalled"), _entry(id="kept", status="verified", local_path="/f", sha256=digest), _entry(id="idle")], registry.SOURCE
    )
    log = f"{tmp_path}/log"
    records = [("ok", 200, None, digest), ("nosha", 200, None, None), ("gone", 404, None, None), ("wall", 418, None, None), ("kept", 500, "boom", None)]
    for source, code, error, sha in records:
        registry.log_fetch(spark, log, {"source_id": source, "url": "u", "finished_at": "2026-01-02", "http_status": code, "error": error, "sha256": sha, "bytes": 3, "local_path": "/new", "skipped_cached": False})
    registry.log_fetch(spark, log, {"source_id": "idle", "finished_at": "2026-01-03", "http_status": 200, "sha256": digest, "skipped_cached": True})
    fetches = spark.read.schema(registry.FETCH).json(log)
    files = spark.createDataFrame([("/f", digest.upper())], "path string, sha256 string")
    found = {r.id: r for r in registry.transitions(sources, fetches, files).collect()}
    assert {k: r.new_status for k, r in found.items()} == {"ok": "verified", "nosha": "partial", "gone": "unverified", "wall": "blocked", "kept": "verified", "idle": "partial"}
    assert found["ok"].blocked_reason is None and (found["ok"].sha256, found["ok"].local_path) == (digest, "/new") and found["ok"].notes is None
    assert found["gone"].notes == "old\n2026-01-02 u: HTTP 404" and found["kept"].notes == "2026-01-02 u: boom" and found["kept"].local_path == "/f"
    assert found["wall"].blocked_reason == "HTTP 418 (paywalled source)" and found["idle"].fetched_at is None
    assert {r.id: r.new_status for r in registry.transitions(sources, fetches).collect()}["kept"] == "partial"


def test_placement_and_sizes(spark):
    cases = [(10, 206, "bytes 10-19/20", "append"), (10, 206, "bytes 0-19/20", "restart"), (10, 206, "bytes 5-19/20", "refuse"), (10, 206, None, "refuse"), (0, 206, "bytes 0-1/*", "restart"), (10, 200, None, "write"), (10, 304, None, "refuse"), (10, 206, "10-19", "refuse")]
    rows = spark.createDataFrame([c[:3] for c in cases], "part_bytes long, http_status int, content_range string")
    assert [r.plan for r in registry.placement(rows).collect()] == [c[3] for c in cases]
    sizes = spark.createDataFrame([(0, None, 5), (20, "bytes 10-19/20", 10), (7, None, 8)], "received long, content_range string, content_length long")
    assert [r.size_error is None for r in registry.size_errors(sizes).collect()] == [False, True, False]


def test_digests_config_and_limiters(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    row = registry.file_digests(spark, f"{tmp_path}/a.bin").first()
    assert (row.length, row.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
    (tmp_path / "one.toml").write_text('[http]\ncontact = "me@example.org"\nwait = 1\n')
    (tmp_path / "two.toml").write_text('[http]\ncontact = "me@site.org"\n')
    config = registry.load_config(spark, f"{tmp_path}/one.toml", f"{tmp_path}/two.toml")
    assert config == {"http": {"contact": "me@site.org", "wait": 1}} and registry.require_contact(config) == "me@site.org"
    with pytest.raises(AnalysisError):
        registry.require_contact({"http": {"contact": "me@example.org"}})
    registry.reset_limiters()
    assert registry.limiter_for("http://A.org/x") is registry.limiter_for("http://a.org/y") and registry.limiter_for("http://b.org") is not registry.limiter_for("http://a.org")


def test_permutation_of_more_groups(spark):
    import hashlib

    rows = [(i, i % 3, float(i * 37 % 101)) for i in range(90)] + [(7, 1, 3.0), (7, 1, 3.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double")
    got = bunching.permutation_test(df, "x", "g", "id", 30, 4).first()
    sizes = [sum(r[1] == g for r in rows) for g in range(3)]
    mean = lambda v: sum(v) / len(v)
    means = [mean([r[2] for r in rows if r[1] == g]) for g in range(3)]
    reached = 0
    for rep in range(1, 31):
        u = lambda r: int(hashlib.md5(f"4:{rep}:{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        order = [r[2] for r in sorted(rows, key=lambda r: (u(r), r[0], r[2]))]
        parts = [order[: sizes[0]], order[sizes[0] : sizes[0] + sizes[1]], order[sizes[0] + sizes[1] :]]
        reached += max(map(mean, parts)) - min(map(mean, parts)) >= max(means) - min(means) - 1e-12
    assert got.pvalue == pytest.approx((1 + reached) / 31) and got.n == 92
