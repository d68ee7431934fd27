"""Integer percentages: an excess of shares that lie on whole per cents.

The null is binomial: each unit's numerator is redrawn with its own share. In ``exact`` mode the
mean and variance of the number of hits are sums of lattice probabilities. In Monte-Carlo mode units of one key with the same denominator,
share and weight are drawn together: how many of them fall on each whole per cent in a replicate is a multinomial draw with the
chances of the lattice, by a generator keyed by seed, key, denominator, share and weight. So a replicate costs distinct (denominator, share)
pairs, not units, and what leaves a worker is a number for each replicate and whole per cent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import special
from ..core.columns import double, finite, kish, numeric, on_keys
from ..core.errors import require


def percentage(num: Column, den: Column) -> Column:
    """100 num / den; NaN where either is missing or the denominator isn't positive."""
    num, den = num.cast("double"), den.cast("double")
    return F.when(finite(num) & finite(den) & (den > 0), 100.0 * num / F.when(den != 0, den)).otherwise(F.lit(float("nan")))


def near_integer(pct: Column, tolerance: float) -> Column:
    """Within ``tolerance`` of the nearest integer, ties to even."""
    return F.abs(pct - F.rint(pct)) <= tolerance


def percentage_histogram(df: DataFrame, pct: str, by: Sequence[str] = (), bin_width: float = 0.1, lo: float = 0.0, hi: float = 100.0, weight: str | None = None) -> DataFrame:
    """Counts in bins centred on multiples of the width, every integer among them; zero bins kept.

    Bins are closed on the left, the last on both sides.
    """
    require(bin_width > 0 and abs(1 / bin_width - round(1 / bin_width)) < 1e-9, f"bin_width must divide 1; got {bin_width}")
    require(hi > lo, "need lo < hi")
    for edge in (lo, hi):
        require(abs(edge / bin_width - round(edge / bin_width)) < 1e-9, f"{edge} is not a multiple of {bin_width}")
    n_bins = round((hi - lo) / bin_width) + 1
    x = double(pct)
    w = double(weight) if weight else F.lit(1.0)
    bin_ = F.floor((x - lo) / bin_width + 0.5).cast("long")
    top = F.lit(hi + bin_width / 2)
    cell = F.when(x == top, F.lit(n_bins - 1)).otherwise(bin_)
    rows = df.where(finite(x)).select(*by, cell.alias("bin"), w.alias("w")).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))
    counts = rows.groupBy(*by, "bin").agg(F.sum("w").alias("c"))
    keyed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    full = keyed.select(*by, "m", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return full.select(*by, F.col("bin").cast("long").alias("bin"), (F.lit(lo) + bin_width * F.col("bin")).alias("centre"), F.coalesce(F.try_element_at("m", F.col("bin").cast("long")), F.lit(0.0)).alias("count"))


def _units(df: DataFrame, num: str, den: str, by: Sequence[str], min_denominator: float, weight: str | None) -> DataFrame:
    numeric(df, num, den)
    n, d = double(num), double(den)
    ok = finite(n) & finite(d)
    use = ok & (d >= min_denominator)
    bad = use & ((n < 0) | (n > d) | (F.abs(d - F.rint(d)) > 1e-9))
    refuse = F.raise_error(F.lit("shares must lie in 0..100 and denominators be integers")).cast("double")
    return df.select(
        *by, F.when(bad, refuse).when(use, 100.0 * n / F.when(d != 0, d)).alias("pct"), F.when(use, F.rint(d)).cast("long").alias("den"),
        (~ok).cast("long").alias("dropped"), (ok & ~use).cast("long").alias("small"), (double(weight) if weight else F.lit(1.0)).alias("w"),
    )


def _neighbours(tolerance: float, bins: int) -> list[float]:
    width, out = 2 * tolerance, []
    for j in range(1, bins + 1):
        if j * width + tolerance > 0.5 + 1e-12:
            break
        out += [j * width, -j * width]
    return out


def _observed(units: DataFrame, by: Sequence[str], tolerance: float, neighbour_bins: int) -> DataFrame:
    used, pct = F.col("pct").isNotNull(), F.col("pct")
    rest = pct - F.rint(pct)
    offsets = _neighbours(tolerance, neighbour_bins)
    around = [F.sum(F.when(F.abs(rest - o) <= tolerance, F.col("w")).otherwise(0.0)) for o in offsets]
    mean = sum(around[1:], around[0]) / len(around) if around else F.lit(float("nan"))
    return units.groupBy(*by).agg(
        F.count(F.when(used, 1)).alias("n"), F.sum(F.when(used & near_integer(pct, tolerance), F.col("w")).otherwise(0.0)).alias("observed"),
        F.sum("small").alias("n_excluded_small"), F.sum("dropped").alias("n_dropped"), mean.alias("neighbour_mean"),
        kish(F.sum(F.when(used, F.col("w"))), F.sum(F.when(used, F.col("w") * F.col("w")))).alias("effective_n"),
    )


def _finish(found: DataFrame) -> DataFrame:
    excess = F.col("observed") - F.col("expected_mean")
    sd = F.col("expected_sd")
    z = F.when(sd > 0, excess / sd).when(excess > 0, F.lit(float("inf"))).otherwise(0.0)
    out = found.withColumns({"excess": excess, "z": z, "neighbour_excess": F.col("observed") - F.col("neighbour_mean")})
    p = F.when(sd > 0, special.norm_sf_column(F.col("z"))).when(F.col("excess") > 0, 0.0).otherwise(1.0)
    return out.withColumn("pvalue", p)


def _check(tolerance: float, min_denominator: float) -> None:
    require(0 < tolerance < 0.5, f"tolerance must lie in (0, 0.5); got {tolerance}")
    require(min_denominator >= 1, f"min_denominator must be at least 1; got {min_denominator}")


def integer_excess_exact(df: DataFrame, num: str, den: str, by: Sequence[str] = (), tolerance: float = 0.05, min_denominator: int = 100, neighbour_bins: int = 5, weight: str | None = None) -> DataFrame:
    """Excess over the exact binomial mean, in units of the exact standard deviation.

    A chance is computed once for each distinct (denominator, share) of a batch.
    """
    _check(tolerance, min_denominator)

    @F.pandas_udf("double")
    def chance(d: pd.Series, pct: pd.Series) -> pd.Series:
        known: dict[tuple[int, float], float] = {}
        out = []
        for n, p in zip(d, pct, strict=True):
            if p != p or n != n:
                out.append(None)
                continue
            if (n, p) not in known:
                known[n, p] = special.binomial_lattice(int(n), p / 100.0, tolerance)
            out.append(known[n, p])
        return pd.Series(out, dtype="float64")

    units = _units(df, num, den, by, min_denominator, weight)
    w, p = F.col("w"), F.col("p")
    null = units.where("pct is not null").select(*by, "w", chance("den", "pct").alias("p")).groupBy(*by).agg(F.sum(w * p).alias("expected_mean"), F.sqrt(F.sum(w * w * p * (1 - p))).alias("expected_sd"))
    seen = _observed(units, by, tolerance, neighbour_bins).where("n > 0")
    return _finish(on_keys(seen, null, by))


def _lattice(n: int, p: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The whole per cents near which 100 k / n can lie for k ~ Binomial(n, p), and the chance of each."""
    k = np.arange(n + 1)
    whole = np.rint(100.0 * k / n)
    k = k[np.abs(100.0 * k / n - whole) <= tolerance]
    whole = whole[k].astype(int)
    if p <= 0 or p >= 1:
        chance = (k == (0 if p <= 0 else n)).astype(float)
    else:
        chance = np.exp([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in k.tolist()])
    total = np.bincount(whole, chance, 101)
    return np.flatnonzero(total), total[total > 0]


def integer_excess(df: DataFrame, num: str, den: str, by: Sequence[str] = (), tolerance: float = 0.05, min_denominator: int = 100, neighbour_bins: int = 5, n_mc: int = 200, seed: int = 0, weight: str | None = None) -> DataFrame:
    """Monte-Carlo mode: z, one-sided p, Monte-Carlo p, and the excess at each of 0..100 per cent.

    Draws don't depend on partitions. Keys without a usable unit get a row with n = 0 and no statistics.
    """
    _check(tolerance, min_denominator)
    require(n_mc >= 1, f"n_mc must be at least 1; got {n_mc}")
    units, keys = _units(df, num, den, by, min_denominator, weight), list(by)
    alike = units.where("pct is not null").groupBy(*keys, "den", "pct", "w").agg(F.count("*").alias("m"))
    alike = alike.select(*keys, F.xxhash64(F.lit(seed), *keys, "den", "pct", "w").alias("h"), "den", "pct", "w", "m")

    def draw(batches):
        """For each key: hits by replicate, then the means over replicates and what was observed at each whole per cent."""
        for frame in batches:
            parts: dict[tuple, np.ndarray] = {}
            for row in frame.itertuples(index=False):
                key, (h, n, pct, w, m) = tuple(row[: len(keys)]), row[len(keys) :]
                total = parts.setdefault(key, np.zeros(n_mc + 202))
                places, chances = _lattice(int(n), pct / 100.0, tolerance)
                rest = max(0.0, 1.0 - chances.sum())
                drawn = np.random.Generator(np.random.Philox(key=int(h) & (2**64 - 1))).multinomial(int(m), np.append(chances, rest) / (chances.sum() + rest), n_mc)[:, :-1]
                total[:n_mc] += w * drawn.sum(axis=1)
                total[n_mc + places] += w * drawn.mean(axis=0)
                if abs(pct - np.rint(pct)) <= tolerance:
                    total[n_mc + 101 + int(np.rint(pct))] += w * m
            yield pd.DataFrame([(*key, t.tolist()) for key, t in parts.items()], columns=[*keys, "sums"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    drawn = alike.mapInPandas(draw, (kinds + ", " if kinds else "") + "sums array<double>")
    each = drawn.select(*keys, F.posexplode("sums").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    whole = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("sums"))  # as many as replicates and per cents
    null = F.slice("sums", 1, n_mc)
    cell = lambda i: F.element_at("sums", n_mc + 102 + i) - F.element_at("sums", n_mc + 1 + i)
    mean = F.aggregate(null, F.lit(0.0), lambda a, x: a + x) / n_mc
    stats = whole.select(*keys, null.alias("null"), mean.alias("expected_mean"), F.array(*(cell(i) for i in range(101))).alias("per_integer"))
    squares = F.aggregate("null", F.lit(0.0), lambda a, x: a + (x - F.col("expected_mean")) * (x - F.col("expected_mean")))
    stats = stats.withColumn("expected_sd", F.sqrt(squares / max(n_mc - 1, 1)))
    counts = _observed(units, keys, tolerance, neighbour_bins)
    joined = on_keys(counts, stats, keys, "left")
    reached = F.size(F.filter("null", lambda x: x >= F.col("observed") - 1e-9 * F.greatest(F.lit(1.0), F.col("observed"))))
    return _finish(joined.withColumn("mc_pvalue", (1 + reached) / (n_mc + 1.0))).drop("null")
