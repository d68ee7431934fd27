"""Bunching at notches and kinks.

The large part, a histogram aligned to the threshold, is an aggregate by key and bin; the polynomial
is fitted to a key's bins only. Dummies for every excluded bin saturate, so the fit is least squares
on the bins outside the window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import seeding
from ..core.columns import double, finite, numeric, on_keys
from ..core.errors import require

#: Fixed value.
GRID_TOLERANCE = 1e-9
MOST_BINS = 10_000_000


@dataclass(frozen=True)
class Notch:
    """A threshold that rewards one side."""

    threshold: float
    side: str = "above"
    label: str = ""

    def __post_init__(self):
        require(np.isfinite(self.threshold), f"threshold must be finite; got {self.threshold}")
        require(self.side in ("above", "below"), f"side must be above or below; got {self.side!r}")

    @property
    def dominated_side(self) -> str:
        return "below" if self.side == "above" else "above"


@dataclass(frozen=True)
class Kink:
    """A threshold where a slope changes."""

    threshold: float
    label: str = ""

    def __post_init__(self):
        require(np.isfinite(self.threshold), f"threshold must be finite; got {self.threshold}")


def grid_index(x: Column, threshold: Column | float, width: float) -> Column:
    """Bin of a value, 0 starting at the threshold; a value on an edge belongs above it."""
    q = (x - threshold) / width
    return F.floor(q + GRID_TOLERANCE * F.greatest(F.lit(1.0), F.abs(q))).cast("long")


def bin_counts(df: DataFrame, value: str, threshold: float | Column, bin_width: float, by: Sequence[str] = (), lo: float | None = None, hi: float | None = None, weight: str | None = None) -> DataFrame:
    """Keys, bin and count of the occupied bins; values outside lo..hi have bin null."""
    require(bin_width > 0, f"bin_width must be positive; got {bin_width}")
    numeric(df, value)
    x = double(value)
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    index = grid_index(x, t, bin_width)
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (index >= grid_index(F.lit(float(lo)), t, bin_width))
    if hi is not None:
        q = (F.lit(float(hi)) - t) / bin_width
        inside = inside & (index < F.ceil(q - GRID_TOLERANCE * F.greatest(F.lit(1.0), F.abs(q))))
    w = double(weight) if weight else F.lit(1.0)
    return df.where(finite(x)).select(*by, F.when(inside, index).alias("bin"), w.alias("w")).groupBy(*by, "bin").agg(F.sum("w").alias("count"))


def bin_around(df: DataFrame, value: str, threshold: float, bin_width: float, by: Sequence[str] = (), lo: float | None = None, hi: float | None = None, weight: str | None = None) -> DataFrame:
    """A row for each key and bin of its grid, empty bins kept."""
    counts = bin_counts(df, value, threshold, bin_width, by, lo, hi, weight).where("bin is not null")
    first = F.lit(_low(lo, threshold, bin_width)) if lo is not None else F.min("bin")
    last = F.lit(_high(hi, threshold, bin_width) - 1) if hi is not None else F.max("bin")
    keyed = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"), first.alias("first"), last.alias("last"))
    checked = F.when(F.col("last") - F.col("first") < MOST_BINS, F.col("last")).otherwise(F.raise_error(F.lit("too many bins")).cast("long"))
    full = keyed.select(*by, "m", F.explode(F.sequence(F.col("first"), checked)).alias("bin"))
    return full.select(*by, "bin", (threshold + bin_width * (F.col("bin") + 0.5)).alias("centre"), F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0.0)).alias("count"))


def _low(value: float, threshold: float, width: float) -> int:
    q = (value - threshold) / width
    return int(np.floor(q + GRID_TOLERANCE * max(1.0, abs(q))))


def _high(value: float, threshold: float, width: float) -> int:
    q = (value - threshold) / width
    return int(np.ceil(q - GRID_TOLERANCE * max(1.0, abs(q))))


@dataclass(frozen=True)
class Window:
    """The excluded bins and the polynomial of a fit."""

    bin_width: float
    below: int
    above: int
    degree: int = 7
    side: str = "below"
    integration: bool = False
    max_iter: int = 50
    tol: float = 1e-6

    @classmethod
    def of(cls, bin_width: float, exclude_below: float, exclude_above: float, poly_degree: int = 7, bunching_side: str = "below", integration_constraint: bool = False, max_iter: int = 50, tol: float = 1e-6) -> Window:
        require(exclude_below >= 0 and exclude_above >= 0, "excluded widths must not be negative")
        require(bunching_side in ("below", "above"), f"unknown side {bunching_side!r}")
        require(poly_degree >= 0 and max_iter >= 1 and tol > 0, "bad degree, max_iter or tol")
        below, above = (int(np.floor(e / bin_width + GRID_TOLERANCE)) for e in (exclude_below, exclude_above))
        require(below + above > 0, "the excluded window has no whole bin")
        return cls(bin_width, below, above, poly_degree, bunching_side, integration_constraint, max_iter, tol)


def fit(first: int, counts: np.ndarray, window: Window) -> dict | None:
    """Excess and missing mass of dense counts that start at bin ``first``; None if it can't be fitted."""
    grid = first + np.arange(len(counts))
    z = grid + 0.5
    out = (grid >= -window.below) & (grid < window.above)
    if -window.below < grid[0] or window.above > grid[-1] + 1 or (~out).sum() < window.degree + 1:
        return None
    low, high = out & (grid < 0), out & (grid >= 0)
    source = grid >= window.above if window.side == "below" else grid < -window.below
    scale = np.abs(z).max() or 1.0
    powers = np.vander(z / scale, window.degree + 1, increasing=True)

    def once(values: np.ndarray):
        beta, *_ = np.linalg.lstsq(powers[~out], values[~out], rcond=None)
        expected = powers @ beta
        gap = counts - expected
        a, b = (low, high) if window.side == "below" else (high, low)
        return beta, expected, float(gap[a].sum()), float(-gap[b].sum())

    beta, expected, excess, missing = once(counts)
    n_iter, converged = 0, True
    if window.integration:
        if not source.any():
            return None
        shift, previous, converged = 1.0, excess, False
        for n_iter in range(1, window.max_iter + 1):
            beta, expected, excess, missing = once(np.where(source, counts * shift, counts))
            base = expected[source].sum()
            new = 1 + excess / base if base > 0 else -1.0
            if not np.isfinite(new) or new <= 0:
                break
            if n_iter > 1 and abs(excess - previous) <= window.tol * max(1.0, abs(excess)):
                converged = True
                break
            previous, shift = excess, new
    height = expected[out].mean()
    if not np.isfinite(height) or height <= 0:
        return None
    return {
        "excess_mass": excess, "missing_mass": missing, "normalized_excess": excess / height, "imbalance": abs(excess - missing), "n_iter": n_iter, "converged": converged,
        "coefficients": (beta / scale ** np.arange(window.degree + 1)).tolist(), "counterfactual": expected.tolist(), "residuals": (counts - expected).tolist(),
    }


FIT_SCHEMA = "n double, n_bins long, excess_mass double, missing_mass double, normalized_excess double, imbalance double, n_iter int, converged boolean, coefficients array<double>"
_FIT_NAMES = [part.split()[0] for part in FIT_SCHEMA.split(", ")]


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in by)


def _dense(frame: pd.DataFrame) -> tuple[int, np.ndarray]:
    first = int(frame["bin"].min())
    out = np.zeros(int(frame["bin"].max()) - first + 1)
    out[frame["bin"].to_numpy() - first] = frame["count"].to_numpy()
    return first, out


def bunching(counts: DataFrame, window: Window, by: Sequence[str] = ()) -> DataFrame:
    """Fit each key's bins (bin, count; null bins are ignored); null results where a fit is impossible."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        first, dense = _dense(frame)
        found = fit(first, dense, window) or {}
        row = {**{k: frame[k].iloc[0] for k in by}, "n": float(dense.sum()), "n_bins": len(dense), **{k: found.get(k) for k in _FIT_NAMES[2:]}}
        return pd.DataFrame([row], columns=[*by, *_FIT_NAMES])

    rows = counts.where("bin is not null")
    return rows.groupBy(*by).applyInPandas(solve, _kinds(counts, by) + FIT_SCHEMA)


def bunching_estimator(df: DataFrame, value: str, threshold: float, window: Window, by: Sequence[str] = (), lo: float | None = None, hi: float | None = None, weight: str | None = None) -> DataFrame:
    return bunching(bin_counts(df, value, threshold, window.bin_width, by, lo, hi, weight), window, by)


def estimate_notch(df: DataFrame, value: str, notch: Notch, bin_width: float, exclude_below: float, exclude_above: float, by: Sequence[str] = (), **fit_options) -> DataFrame:
    """Mass piles up on the rewarded side; the dominated region lies on the other."""
    window = Window.of(bin_width, exclude_below, exclude_above, bunching_side=notch.side, **fit_options)
    return bunching_estimator(df, value, notch.threshold, window, by).withColumn("dominated_side", F.lit(notch.dominated_side))


def estimate_kink(df: DataFrame, value: str, kink: Kink, bin_width: float, exclude_halfwidth: float, by: Sequence[str] = (), **fit_options) -> DataFrame:
    window = Window.of(bin_width, exclude_halfwidth, exclude_halfwidth, **fit_options)
    return bunching_estimator(df, value, kink.threshold, window, by)


def bunching_linear(df: DataFrame, value: str, threshold: float, window: Window, by: Sequence[str] = ()) -> DataFrame:
    """The fit of degree one in native aggregates: excess, missing and normalised excess."""
    bins = bin_around(df, value, threshold, window.bin_width, by)
    z, out = F.col("bin") + 0.5, (F.col("bin") >= -window.below) & (F.col("bin") < window.above)
    y = F.when(~out, F.col("count"))
    line = bins.groupBy(*by).agg(F.regr_slope(y, z).alias("b"), F.regr_intercept(y, z).alias("a"), F.sum("count").alias("n"))
    joined = on_keys(bins, line, by)
    expected = F.col("a") + F.col("b") * z
    low, high = out & (F.col("bin") < 0), out & (F.col("bin") >= 0)
    a, b = (low, high) if window.side == "below" else (high, low)
    gap = lambda test: F.sum(F.when(test, F.col("count") - expected).otherwise(0.0))
    return joined.groupBy(*by).agg(F.max("n").alias("n"), gap(a).alias("excess_mass"), (-gap(b)).alias("missing_mass"), (gap(a) / F.avg(F.when(out, expected))).alias("normalized_excess"))


def scan_thresholds(df: DataFrame, value: str, thresholds: Sequence[float], window: Window) -> DataFrame:
    """A row for each candidate threshold, by normalised excess downwards.

    Every row meets every candidate inside a map stage (the candidates are parameters); one
    aggregate by candidate and bin serves all fits.
    """
    require(len(set(thresholds)) == len(thresholds), "candidates repeat")
    require(all(np.isfinite(t) for t in thresholds), "candidates must be finite")
    numeric(df, value)
    rows = df.where(finite(double(value))).select(double(value).alias("x"), F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    counts = bin_counts(rows, "x", F.col("threshold"), window.bin_width, ["threshold"])
    return bunching(counts, window, ["threshold"]).orderBy(F.col("normalized_excess").desc_nulls_last(), "threshold")


def placebo_test(df: DataFrame, value: str, threshold: float, placebos: Sequence[float], window: Window, add_one: bool = False) -> DataFrame:
    """Share of placebo thresholds with at least the real one's normalised excess."""
    require(threshold not in placebos and len(placebos) > 0, "need placebo thresholds apart from the real one")
    found = scan_thresholds(df, value, [threshold, *placebos], window)
    real = F.max(F.when(F.col("threshold") == threshold, F.col("normalized_excess")))
    out = found.agg(real.alias("observed"), F.collect_list(F.when(F.col("threshold") != threshold, F.col("normalized_excess"))).alias("placebo"))
    reached, n = F.size(F.filter("placebo", lambda v: v >= F.col("observed"))), F.size("placebo")
    return out.select("observed", n.alias("n_placebo"), ((1 + reached) / (1 + n) if add_one else reached / n).alias("pvalue"))


def _statistic(name: str | Callable[[dict], float]) -> Callable[[dict], float]:
    if callable(name):
        return name
    require(name in ("excess_mass", "missing_mass", "normalized_excess"), f"unknown statistic {name!r}")
    return lambda found: found[name]


def bunching_draws(df: DataFrame, value: str, threshold: float, window: Window, by: Sequence[str] = (), n_boot: int = 499, seed: int = 0, method: str = "residual", statistic: str | Callable[[dict], float] = "normalized_excess") -> DataFrame:
    """(keys, replicate, draw) of a statistic of refitted bins: replicate 0 is the estimate itself, a null a fit that failed.

    Residuals are resampled, or rows through the multinomial of their bins. ``statistic`` is a name, or a function of what ``fit`` returns.
    """
    require(method in ("residual", "pairs"), f"unknown method {method!r}")
    require(n_boot >= 2, f"n_boot must be at least 2; got {n_boot}")
    of = _statistic(statistic)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        first, dense = _dense(frame)
        found = fit(first, dense, window)
        draws = [float(of(found)) if found else None]
        generator = np.random.Generator(np.random.Philox(key=[seed, int(pd.util.hash_array(np.array([str({k: frame[k].iloc[0] for k in by})], object))[0])]))
        n, pool = int(dense.sum()), np.array(found["residuals"] if found else [])
        for _ in range(n_boot if found else 0):
            sample = generator.multinomial(n, dense / dense.sum()).astype(float) if method == "pairs" else np.array(found["counterfactual"]) + generator.choice(pool, len(pool))
            again = fit(first, sample, window)
            draws.append(float(of(again)) if again else None)
        out = pd.DataFrame({"replicate": range(len(draws)), "draw": pd.array(draws, "Float64")})
        for i, k in enumerate(by):
            out.insert(i, k, frame[k].iloc[0])
        return out

    counts = bin_counts(df, value, threshold, window.bin_width, by).where("bin is not null")
    return counts.groupBy(*by).applyInPandas(solve, _kinds(df, by) + "replicate int, draw double")


def bootstrap_bunching(df: DataFrame, value: str, threshold: float, window: Window, by: Sequence[str] = (), n_boot: int = 499, alpha: float = 0.05, seed: int = 0, method: str = "residual", statistic: str | Callable[[dict], float] = "normalized_excess") -> DataFrame:
    """Percentile interval of each key over its draws; where the bins can't be fitted, nulls, and all draws failed."""
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}")
    draws = bunching_draws(df, value, threshold, window, by, n_boot, seed, method, statistic)
    x = F.when((F.col("replicate") > 0) & ~F.isnan("draw"), F.col("draw"))
    two = lambda c: F.when(F.count(x) >= 2, c)
    return draws.groupBy(*by).agg(
        F.max(F.when(F.col("replicate") == 0, F.col("draw"))).alias("estimate"), two(F.stddev_samp(x)).alias("se"), two(F.percentile(x, F.lit(alpha / 2))).alias("low"),
        two(F.percentile(x, F.lit(1 - alpha / 2))).alias("high"), (F.lit(n_boot) - F.count(x)).alias("n_failed"),
    )


def _bands(ends: Sequence[int]) -> tuple[list[float], list[int]]:
    """Edges of the bands of uniform numbers that hold the boundaries after ``ends[:-1]`` rows, and how many boundaries lie before each sure zone.

    Seven standard errors of an order statistic on either side; bands that overlap are one.
    """
    n, bands = ends[-1], []
    for e in ends[:-1]:
        p = e / n
        half = 7 * np.sqrt(p * (1 - p) / n) + 8 / n
        if bands and bands[-1][1] >= p - half:
            bands[-1][1:] = [p + half, bands[-1][2] + 1]
        else:
            bands.append([p - half, p + half, 1])
    return [edge for low, high, _ in bands for edge in (low, high)], np.cumsum([0, *(b[2] for b in bands)]).tolist()


def permutation_test(df: DataFrame, value: str, group: str, row_id: str, n_perm: int = 999, seed: int = 0) -> DataFrame:
    """Difference of two groups' means (sorted labels), two-sided; the range of more groups' means, one-sided.

    A replicate orders the rows by hash numbers and gives the first label to as many rows as have it, then the
    next. A row whose number is far from every boundary has its label without being ranked: such rows are
    added up before the shuffle, and only those near a boundary (some sqrt(n) in a replicate) are sorted.
    Add-one p-value; ties count within 1e-12.
    """
    numeric(df, value)
    require(n_perm >= 1, f"n_perm must be at least 1; got {n_perm}")
    x = double(value)
    rows = df.where(finite(x) & F.col(group).isNotNull()).select(F.col(row_id).alias("id"), F.col(group).alias("g"), x.alias("x"))
    seen = rows.groupBy("g").agg(F.avg("x").alias("m"), F.count("*").alias("n")).orderBy("g").collect()
    require(len(seen) >= 2, "need two groups at least")
    ends = np.cumsum([r["n"] for r in seen]).tolist()
    means = [r["m"] for r in seen]
    two = len(seen) == 2
    statistic = means[1] - means[0] if two else max(means) - min(means)
    edges, before = _bands(ends)
    numbers = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))
    copies = rows.select("id", "x", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("replicate"))
    copies = copies.withColumn("u", seeding.uniform(seed, F.col("replicate"), F.col("id")))
    copies = copies.withColumn("zone", F.size(F.filter(numbers(edges, "double"), lambda e: e <= F.col("u"))))
    near = F.col("zone") % 2 == 1
    parts = copies.groupBy("replicate", "zone", *(F.when(near, F.col(c)).alias(c) for c in ("u", "id", "x"))).agg(F.count("*").alias("c"), F.sum(F.col("x")).alias("s"))
    each = F.when(near, F.sequence(F.lit(1), F.col("c").cast("int"))).otherwise(F.array(F.lit(1)))  # repeated rows are ranked apart
    parts = parts.select("replicate", "zone", "u", "id", F.when(near, 1).otherwise(F.col("c")).alias("c"), F.when(near, F.col("x")).otherwise(F.col("s")).alias("s"), F.explode(each).alias("nth_copy"))
    along = W.partitionBy("replicate").orderBy("zone", "u", "id", "s", "nth_copy").rowsBetween(W.unboundedPreceding, 0)
    placed = parts.withColumn("nth", F.sum("c").over(along))
    ranked = F.size(F.filter(numbers(ends, "long"), lambda e: e < F.col("nth")))
    sure = F.element_at(numbers(before, "int"), (F.col("zone") / 2).cast("int") + 1)
    upper, lower = F.element_at(numbers(ends, "long"), sure + 1), F.element_at(numbers([0, *ends], "long"), sure + 1)
    inside = (F.col("nth") <= upper) & (F.col("nth") - F.col("c") >= lower)
    label = F.when(near, ranked).when(inside, sure).otherwise(F.raise_error(F.lit("a boundary lies outside its band: take another seed")).cast("int"))
    null = placed.select("replicate", label.alias("g"), "c", "s").groupBy("replicate", "g").agg((F.sum("s") / F.sum("c")).alias("m")).groupBy("replicate")
    null = null.agg((F.max_by("m", "g") - F.min_by("m", "g")).alias("difference"), (F.max("m") - F.min("m")).alias("range"))
    size = F.abs("difference") if two else F.col("range")
    reached = F.count(F.when(size >= abs(statistic) - 1e-12, 1))
    return null.agg(F.lit(statistic).alias("statistic"), F.lit(ends[-1]).cast("long").alias("n"), F.lit(len(seen)).cast("long").alias("groups"), ((1 + reached) / (1.0 + n_perm)).alias("pvalue"))
