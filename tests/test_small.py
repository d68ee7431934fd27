"""Small functions that no query shows: claims, counts of streams, the registry's command line."""

import json

import pytest
from pyspark.sql import functions as F

from veritally.core.errors import EffectError
from veritally.operators import digits, inject
from veritally.sources import registry
from veritally.streaming.digits import chi2_of_counts, windowed_digit_counts


def test_quantity_claims(spark):
    rows = [("up", 10.0, 12.0), ("up", 20.0, 20.0), ("both", 10.0, 11.0), ("both", 10.0, 9.0)]
    effects = inject.measure_effect(spark.createDataFrame(rows, "k string, before double, after double"), by=["k"])
    found = {r.k: r.claim for r in inject.quantity_claims(effects, "padding").collect()}
    assert found == {"up": "about 50.0% of units were moved, by about 20.0% each (net 6.7% of the total)", "both": None}
    for mechanism in inject.SHAPE_MECHANISMS:
        with pytest.raises(EffectError):
            inject.quantity_claims(effects, mechanism)


def test_counts_of_a_table_give_the_test_of_its_rows(spark):
    df = spark.range(1, 400).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1000).alias("ts"), F.pow(F.lit(1.07), F.col("id")).alias("x"), (F.col("id") % 2).alias("k"))
    counts = windowed_digit_counts(df, "ts", "x", ["k"])
    assert counts.agg(F.sum("n")).first()[0] == 399
    got = {r.k: (r.n, r.chi2) for r in chi2_of_counts(counts, ["k"]).collect()}
    want = {r.k: (r.n, r.chi2) for r in digits.benford_test(df, "x", ["k"]).collect()}
    assert got == {k: (n, pytest.approx(c)) for k, (n, c) in want.items()}


def test_registry_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "sources")
    row = {"id": "a", "name": "A", "provider": "P", "status": "unverified", "notes": "n", "access": "open", "url": "http://x.org/a"}
    (tmp_path / "sources").mkdir()
    (tmp_path / "sources" / "a.json").write_text(json.dumps(row) + "\n")
    assert registry.main(["status", path]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"status": "unverified", "count": 1}
    assert registry.main(["validate", path]) == 0
    capsys.readouterr()
    (tmp_path / "sources" / "a.json").write_text(json.dumps(row | {"status": "blocked"}) + "\n")
    assert registry.main(["validate", path]) == 1 and "block" in capsys.readouterr().out
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "f.bin").write_bytes(b"abc")
    assert registry.main(["sha256", str(tmp_path / "data")]) == 0
    assert "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" in capsys.readouterr().out
