"""Order-dependent tests of a stream: an extension. Each key's rows wait until the watermark has passed them, and then go by in event-time order.

So late rows within the watermark's delay take their true place, and what comes out is what the batch operators give for the rows before
the watermark. A key keeps a window, or a few sums, and the rows that still wait; nothing is kept of rows that went by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..core import special
from ..core.columns import double, finite
from ..core.errors import require

_WAITING = "at array<long>, tie array<long>, x array<double>"


def _waiting(stream: DataFrame, key: str, ts: str, value: str, tie: str, watermark: str):
    """(k, ts, at in microseconds, tie, x) of the values that aren't missing, by key."""
    time = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).alias("k"), time.alias("ts"), F.unix_micros(time).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))).alias("tie"), double(value).alias("x"))
    return rows.where(finite(F.col("x")) & F.col("ts").isNotNull()).withWatermark("ts", watermark).groupBy("k")


def _due(state: GroupState, frames, held: tuple) -> tuple[list[tuple[int, int, float]], tuple[list, list, list]]:
    """What the watermark has passed, in order, and what waits on, of the rows that waited and those that are new."""
    rows = list(zip(*held, strict=True))
    for frame in frames:
        rows += list(zip(frame["at"].tolist(), frame["tie"].tolist(), frame["x"].tolist(), strict=True))
    rows.sort()
    passed = state.getCurrentWatermarkMs() * 1000
    due = [r for r in rows if r[0] < passed]
    left = rows[len(due) :]
    return due, tuple(list(c) for c in zip(*left, strict=True)) if left else ([], [], [])


def _keep(state: GroupState, values: tuple, waiting: tuple[list, list, list]) -> None:
    state.update((*values, *waiting))
    if waiting[0]:
        state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))


#: Rows that are sorted at once, and rows of a block in the state.
_RUN, _BLOCK = 1 << 20, 1 << 14
#: Runs of a key that are merged into one when there are more.
_RUNS = 64
#: Values of windows that are worked out at once.
_VALUES = 1 << 20
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = {"spark.sql.streaming.stateStore.providerClass": _ROCKS, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Rows (at, tie, x as its bits) in columns of an array of longs, in order."""
    return rows[:, np.lexsort((rows[2].view(float), rows[1], rows[0]))]


class _Waiting:
    """The rows of a key that wait, in the state: sorted runs in blocks, and a list of the runs (number, next block, row in it, blocks, time of the next row)."""

    def __init__(self, blocks, runs: list[list[int]]):
        self.blocks, self.runs = blocks, runs

    def _block(self, run: int, block: int) -> np.ndarray:
        return np.frombuffer(self.blocks.getValue((run, block))[0], "int64").reshape(3, -1)

    def add(self, parts) -> None:
        """A run of parts that are in order, one after the other."""
        run, blocks, held, first = max((r[0] for r in self.runs), default=-1) + 1, 0, np.empty((3, 0), "int64"), None
        for part in parts:
            held = np.concatenate([held, part], axis=1)
            first = int(held[0, 0]) if first is None and held.shape[1] else first
            while held.shape[1] >= _BLOCK:
                self.blocks.updateValue((run, blocks), (held[:, :_BLOCK].tobytes(),))
                held, blocks = held[:, _BLOCK:], blocks + 1
        if held.shape[1]:
            self.blocks.updateValue((run, blocks), (held.tobytes(),))
            blocks += 1
        if blocks:
            self.runs.append([run, 0, 0, blocks, first])

    def take(self, until: int | None = None):
        """Rows before a time (all without one), in order, a part at a time; they leave the state. Holds a block of each run."""
        runs, loaded = list(self.runs), {}
        while heads := [r for r in runs if r[1] < r[3] and (until is None or r[4] < until)]:
            for r in heads:
                if r[0] not in loaded:
                    loaded[r[0]] = self._block(r[0], r[1])[:, r[2] :]
            rows = np.concatenate([loaded[r[0]] for r in heads], axis=1)
            sizes = [loaded[r[0]].shape[1] for r in heads]
            whose, ends = np.repeat(np.arange(len(heads)), sizes), np.cumsum(sizes) - 1
            order = np.lexsort((rows[2].view(float), rows[1], rows[0]))
            # What a run has beyond its block comes after the last row of it.
            last = np.isin(order, [e for e, r in zip(ends, heads, strict=True) if r[1] + 1 < r[3]])
            order = order[: int(np.argmax(last)) + 1 if last.any() else len(order)]
            if until is not None:
                order = order[: int(np.searchsorted(rows[0, order], until))]
            for r, taken in zip(heads, np.bincount(whose[order], minlength=len(heads)).tolist(), strict=True):
                left = loaded[r[0]][:, taken:]
                r[2] += taken
                if not left.shape[1]:
                    self.blocks.removeKey((r[0], r[1]))
                    r[1], r[2] = r[1] + 1, 0
                    if r[1] == r[3]:
                        del loaded[r[0]]
                        continue
                    left = self._block(r[0], r[1])
                loaded[r[0]], r[4] = left, int(left[0, 0])
            yield rows[:, order]
        self.runs = [r for r in self.runs if r[1] < r[3]]

    def merge(self) -> None:
        """One run of many; the new one's number is above theirs, so no block is overwritten."""
        old = _Waiting(self.blocks, self.runs)
        self.add(old.take())
        self.runs = self.runs[-1:]


class _RollingFloor(StatefulProcessor):
    """Waiting rows lie in the state store, which keeps them on disk; a task holds a part of them at a time."""

    def __init__(self, floor_variance: float, window: int, alpha: float):
        self.floor_variance, self.window, self.alpha = floor_variance, window, alpha

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "n long, recent binary, runs binary")
        self.blocks = handle.getMapState("blocks", "run long, block long", "content binary")

    def handleInputRows(self, key, rows, timerValues):
        return self._step(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._step(key, (), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _step(self, key, frames, watermark: int):
        n, recent, runs = self.kept.get() if self.kept.exists() else (0, b"", b"")
        waiting, recent = _Waiting(self.blocks, np.frombuffer(runs, "int64").reshape(-1, 5).tolist()), np.frombuffer(recent)
        new, size = [], 0
        for frame in frames:
            new.append(np.stack([frame["at"].to_numpy("int64"), frame["tie"].to_numpy("int64"), frame["x"].to_numpy(float).view("int64")]))
            size += len(frame)
            if size >= _RUN:
                waiting.add([_sorted(np.concatenate(new, axis=1))])
                new, size = [], 0
        if size:
            waiting.add([_sorted(np.concatenate(new, axis=1))])
        for part in waiting.take(watermark * 1000):
            x = np.concatenate([recent, part[2].view(float)])
            for i in range(0, len(x) - self.window + 1, many := max(1, _VALUES // self.window)):
                yield self._windows(key[0], n - len(recent) + i, x[i : i + many + self.window - 1])
            n, recent = n + part.shape[1], x[len(x) - min(len(x), self.window - 1) :]
        if len(waiting.runs) > _RUNS:
            waiting.merge()
        if waiting.runs:
            self.handle.registerTimer(max(min(r[4] for r in waiting.runs) // 1000 + 1, watermark + 1))
        self.kept.update((n, recent.tobytes(), np.array(waiting.runs, "int64").tobytes()))

    def _windows(self, key, start: int, x: np.ndarray) -> pd.DataFrame:
        values = np.lib.stride_tricks.sliding_window_view(x, self.window)
        s2 = ((values - values.mean(axis=1, keepdims=True)) ** 2).sum(axis=1) / (self.window - 1)
        statistic = (self.window - 1) * s2 / self.floor_variance
        p = np.array([special.chi2_cdf(v, self.window - 1) for v in statistic.tolist()])
        first = np.arange(start, start + len(s2))
        return pd.DataFrame({"k": [key] * len(s2), "start": first, "end": first + self.window - 1, "s2": s2, "statistic": statistic, "pvalue": p, "flag": p < self.alpha})


def rolling_floor(stream: DataFrame, key: str, ts: str, value: str, tie: str, floor_variance: float, window: int, watermark: str = "1 day", alpha: float = 0.05) -> DataFrame:
    """(k, start, end, s2, statistic, pvalue, flag) of every window of consecutive values, as ``dispersion.rolling_variance_floor`` gives it; append mode.

    ``tie`` orders rows of one time. Rows that wait are kept by RocksDB, which the session is set to: it is the only state store that
    keeps them on disk, so neither a batch nor the rows that wait need fit into memory.
    """
    require(floor_variance > 0 and window >= 2 and 0 < alpha < 1, "the floor must be positive, the window hold two values, and alpha lie in (0, 1)")
    for k, v in _STORE.items():
        stream.sparkSession.conf.set(k, v)
    result = f"k {dict(stream.dtypes)[key]}, start long, end long, s2 double, statistic double, pvalue double, flag boolean"
    rows = _waiting(stream, key, ts, value, tie, watermark)
    return rows.transformWithStateInPandas(_RollingFloor(floor_variance, window, alpha), result, "append", "EventTime")


def smoothness(stream: DataFrame, key: str, ts: str, value: str, tie: str, watermark: str = "1 day") -> DataFrame:
    """(k, m, eta): von Neumann's ratio of each key's values so far, as ``dispersion.smoothness_ratio`` gives it; update mode, a row whenever a key moves on."""

    def step(k, frames, state: GroupState):
        n, mean, m2, steps, before, scale, *held = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 1.0, [], [], [])
        due, waiting = _due(state, frames, tuple(held))
        for _, _, x in due:
            steps += (x - before) ** 2 if n else 0.0
            before, scale, n = x, max(scale, abs(x)), n + 1
            gap = x - mean
            mean += gap / n
            m2 += gap * (x - mean)
        s2 = m2 / (n - 1) if n > 1 else 0.0
        eta = steps / (n - 1) / s2 if n >= 3 and s2 > (16 * 2.220446049250313e-16 * scale) ** 2 else None
        _keep(state, (n, mean, m2, steps, before, scale), waiting)
        yield pd.DataFrame({"k": [k[0]], "m": [n], "eta": pd.array([eta], "Float64")} if due else {"k": [], "m": [], "eta": []})

    kept = f"n long, mean double, m2 double, steps double, before double, scale double, {_WAITING}"
    return _waiting(stream, key, ts, value, tie, watermark).applyInPandasWithState(step, f"k {dict(stream.dtypes)[key]}, m long, eta double", kept, "update", GroupStateTimeout.EventTimeTimeout)
