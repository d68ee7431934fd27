"""Table-valued tests for SQL, a partition of a table at a time: ``SELECT * FROM vt_rolling_floor(TABLE(t) PARTITION BY (k) ORDER BY (t), 50.0, 7)``.

The table has the columns k (any key, also in PARTITION BY), x (a number), and for tests of a series t (in ORDER BY). Rows go by one after the
other, and a function keeps a window, a few sums or one count for each digit, so a partition of any length fits a task. The operators do
the same on DataFrames, with all partitions in native aggregates; these are for those who write SQL.

Missing values of x (null, NaN, infinite) are dropped first, which closes their gaps.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..core import special
from ..core.errors import require
from ..operators.digits import expected, support


def _number(x) -> float | None:
    return None if x is None or not math.isfinite(float(x)) else float(x)


def _result(table: AnalyzeArgument, *columns) -> AnalyzeResult:
    require(table.isTable and {"k", "x"} <= {f.name for f in table.dataType.fields}, "give TABLE(...) with the columns k and x")
    out = StructType().add("k", table.dataType["k"].dataType)
    for name, kind in columns:
        out = out.add(name, kind)
    return AnalyzeResult(schema=out)


def _need_order(table: AnalyzeArgument) -> None:
    require("t" in {f.name for f in table.dataType.fields}, "a series needs the column t, and ORDER BY t")


@udtf
class RollingFloor:
    """(k, start, end, s2, statistic, pvalue, flag) of every window of consecutive values against a floor of the variance."""

    def __init__(self):
        self.held, self.n, self.last = None, 0, None

    @staticmethod
    def analyze(table: AnalyzeArgument, floor: AnalyzeArgument, window: AnalyzeArgument) -> AnalyzeResult:
        _need_order(table)
        require(floor.value is not None and float(floor.value) > 0 and window.value is not None and int(window.value) >= 2, "the floor must be positive and the window hold two values")
        return _result(table, ("start", LongType()), ("end", LongType()), ("s2", DoubleType()), ("statistic", DoubleType()), ("pvalue", DoubleType()), ("flag", BooleanType()))

    def eval(self, row, floor, window):
        x = _number(row["x"])
        require(self.last is None or row["t"] >= self.last, "the partition isn't in the order of t")
        self.last = row["t"]
        if x is None:
            return
        self.held = self.held if self.held is not None else deque(maxlen=int(window))
        self.held.append(x)
        self.n += 1
        if len(self.held) < int(window):
            return
        mean = math.fsum(self.held) / len(self.held)
        s2 = math.fsum((v - mean) ** 2 for v in self.held) / (len(self.held) - 1)
        statistic = (len(self.held) - 1) * s2 / float(floor)
        p = special.chi2_cdf(statistic, len(self.held) - 1)
        yield row["k"], self.n - int(window), self.n - 1, s2, statistic, p, p < 0.05


@udtf
class Smoothness:
    """(k, n, s2, eta): von Neumann's ratio of a series; null below three values or for a constant."""

    def __init__(self):
        self.n, self.mean, self.m2, self.steps, self.before, self.scale, self.k, self.seen = 0, 0.0, 0.0, 0.0, None, 1.0, None, False

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _need_order(table)
        return _result(table, ("n", LongType()), ("s2", DoubleType()), ("eta", DoubleType()))

    def eval(self, row):
        x, self.k, self.seen = _number(row["x"]), row["k"], True
        if x is None:
            return
        if self.before is not None:
            self.steps += (x - self.before) ** 2
        self.before, self.scale, self.n = x, max(self.scale, abs(x)), self.n + 1
        gap = x - self.mean
        self.mean += gap / self.n
        self.m2 += gap * (x - self.mean)

    def terminate(self):
        if self.seen:
            s2 = self.m2 / (self.n - 1) if self.n > 1 else None
            varies = self.n >= 3 and s2 > (16 * 2.220446049250313e-16 * self.scale) ** 2
            yield self.k, self.n, s2, self.steps / (self.n - 1) / s2 if varies else None


@udtf
class LeadingDigits:
    """(k, n, chi2, mad, pvalue): first digits of positive numbers against Benford's law."""

    def __init__(self):
        self.counts, self.k, self.seen = [0] * 9, None, False

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, ("n", LongType()), ("chi2", DoubleType()), ("mad", DoubleType()), ("pvalue", DoubleType()))

    def eval(self, row):
        x, self.k, self.seen = _number(row["x"]), row["k"], True
        if x is not None and x > 0:
            e = math.floor(math.log10(x))
            m = x / 10.0**e
            m = m / 10 if m >= 10 else m * 10 if m < 1 else m
            m = round(m, 12)
            both = math.floor(round((m / 10 if m >= 10 else m) * 10, 9))
            self.counts[min(99, max(10, both)) // 10 - 1] += 1

    def terminate(self):
        n = sum(self.counts)
        if n:
            shares = [float(p) for p in expected("first")]
            require(len(shares) == len(self.counts) == len(list(support("first"))), "nine digits")
            chi2 = sum((c - n * p) ** 2 / (n * p) for c, p in zip(self.counts, shares, strict=True))
            yield self.k, n, chi2, sum(abs(c / n - p) for c, p in zip(self.counts, shares, strict=True)) / 9, special.chi2_sf(chi2, 8)


TABLE_FUNCTIONS = {"vt_rolling_floor": RollingFloor, "vt_smoothness": Smoothness, "vt_leading_digits": LeadingDigits}


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to SQL by name."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
