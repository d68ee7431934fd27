"""Streams against the batch operators on the same rows, with late data."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritally.operators import dispersion
from veritally.streaming import series

SCHEMA = "k string, ts timestamp, id long, x double"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Files in the order of arrival: rows up to six hours late, two rows of one time, a missing value, and a last row far ahead."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), 1_700_000_000 + 600 * (i // 2), i, rng.gauss(5, 2) if i % 37 else None) for i in range(400)]
    folder = tmp_path_factory.mktemp("events")
    late = sorted(rows, key=lambda r: r[1] + (rng.randrange(6 * 3600) if r[2] % 5 == 0 else 0))
    parts = [late[i : i + 80] for i in range(0, 400, 80)] + [[("z", 1_700_000_000 + 10**6, 999, 1.0)]]
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, "k string, s long, id long, x double").select("k", F.timestamp_seconds("s").alias("ts"), "id", "x")
        df.coalesce(1).write.parquet(f"{folder}/{i}.tmp")
    return spark, folder, rows


def run(events, make, mode, tmp_path):
    spark, folder, _ = events
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))
    out = []
    query = make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, i: out.extend(df.collect())).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return out


def test_rolling_floor_equals_batch(events, tmp_path):
    spark, _, rows = events
    got = run(events, lambda s: series.rolling_floor(s, "k", "ts", "x", "id", 4.0, 5, "8 hours"), "append", tmp_path)
    table = spark.createDataFrame(rows, "k string, s long, id long, x double")
    want = dispersion.rolling_variance_floor(table, "x", ["s", "id"], 4.0, 5, ["k"]).collect()
    assert len(got) == len(want) > 300
    key = lambda r: (r.k, r.start)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (a.k, a.start, a.end, a.flag) == (b.k, b.start, b.end, b.flag) and (a.s2, a.pvalue) == pytest.approx((b.s2, b.pvalue))


class _Store:
    """A key's state, with the number of rows of each block that was written."""

    def __init__(self):
        self.content, self.value, self.timers, self.sizes = {}, None, [], []

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        return self.content[key]

    def updateValue(self, key, value):
        assert key not in self.content
        self.content[key] = value
        self.sizes.append(len(value[0]) // 24)

    def removeKey(self, key):
        del self.content[key]


def test_a_key_holds_a_part_of_its_rows(monkeypatch):
    """Rows come unordered in several batches, with equal times; they wait in blocks, and windows come in parts."""
    for name, n in (("_RUN", 50), ("_BLOCK", 8), ("_RUNS", 5), ("_VALUES", 20)):
        monkeypatch.setattr(series, name, n)
    rng = random.Random(6)
    rows = [(rng.randrange(0, 3000) * 500, i, rng.gauss(0, 3)) for i in range(2000)]
    store, floor = _Store(), series._RollingFloor(4.0, 5, 0.05)
    floor.init(store)
    held, parts, seen = [], [], 0
    for batch, watermark in enumerate([0, 0, 100, 333, 333, 900, 1_400, 10_000]):  # in milliseconds
        late = [r for r in rows[batch * 250 :][:250] if r[0] >= watermark * 1000]  # the query drops what comes too late
        held += late
        frames = [pd.DataFrame(late[i : i + 20], columns=["at", "tie", "x"]) for i in range(0, len(late), 20)]
        parts += list(floor._step(("a",), iter(frames), watermark))
        passed = sum(r[0] < watermark * 1000 for r in held)
        assert sum(len(f) for f in parts) == max(0, passed - 4) and passed >= seen
        assert sum(len(v[0]) // 24 for v in store.content.values()) >= len(held) - passed
        seen = passed
        runs = np.frombuffer(store.value[2], "int64").reshape(-1, 5)
        assert len(runs) <= 5 and (passed == len(held)) == (len(runs) == 0)
        if len(runs):
            assert store.timers[-1] == max(min(r[0] for r in held if r[0] >= watermark * 1000) // 1000 + 1, watermark + 1)
    assert not store.content and max(store.sizes) == 8 and max(len(f) for f in parts) <= 4  # values of windows at once, by the window
    got, x = pd.concat(parts, ignore_index=True), [r[2] for r in sorted(held)]
    assert got["start"].tolist() == list(range(len(x) - 4)) and (got["end"] - got["start"]).unique().tolist() == [4]
    assert got["s2"].tolist() == pytest.approx([np.var(x[i : i + 5], ddof=1) for i in range(len(x) - 4)])


def test_smoothness_equals_batch(events, tmp_path):
    spark, _, rows = events
    got = run(events, lambda s: series.smoothness(s, "k", "ts", "x", "id", "8 hours"), "update", tmp_path)
    last = {}
    for r in got:  # rows come in the order of batches
        assert r.m >= last.get(r.k, r).m
        last[r.k] = r
    table = spark.createDataFrame(rows, "k string, s long, id long, x double")
    want = {r.k: r for r in dispersion.smoothness_ratio(table, "x", ["s", "id"], ["k"]).collect()}
    assert set(last) == {"a", "b"}  # the row ahead still waits
    assert all(last[k].m == want[k].m and last[k].eta == pytest.approx(want[k].eta) for k in want)


def test_refusals(spark):
    for bad in ({"floor_variance": 0.0, "window": 5}, {"floor_variance": 1.0, "window": 1}):
        with pytest.raises(ValueError):
            series.rolling_floor(spark.range(1), "id", "id", "id", "id", **bad)
