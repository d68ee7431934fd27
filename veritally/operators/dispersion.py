"""Under-dispersion: variances below a floor, and series smoother than chance.

Order-sensitive operators need ``order``: columns that give each series its one true order.
Missing values are dropped first, which closes their gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import seeding, special
from ..core.columns import double, finite, numeric, on_keys
from ..core.errors import require


def _floor(value: float, ddof: int) -> None:
    require(value > 0 and value < float("inf"), f"floor_variance must be positive; got {value}")
    require(ddof >= 1, f"ddof must be at least 1; got {ddof}")


def variance(x: Column, ddof: int = 1) -> Column:
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof))


def _values(df: DataFrame, value: str, by: Sequence[str], *more: str) -> DataFrame:
    numeric(df, value)
    x = double(value)
    return df.select(*by, *more, F.when(finite(x), x).alias("x"))


def dispersion_index(df: DataFrame, value: str, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Variance over mean; null where the mean is zero or too few values are left."""
    mean = F.avg("x")
    return _values(df, value, by).groupBy(*by).agg(F.count("x").alias("n"), (variance(F.col("x"), ddof) / F.when(mean != 0, mean)).alias("index"))


def variance_floor_test(df: DataFrame, value: str, floor_variance: float, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Chi-square of the variance against a floor, lower tail."""
    _floor(floor_variance, ddof)
    n = F.count("x")
    out = _values(df, value, by).groupBy(*by).agg(n.alias("n"), (F.count("*") - n).alias("n_dropped"), variance(F.col("x"), ddof).alias("s2"), F.avg("x").alias("mean"))
    out = out.where(F.col("n") > ddof).withColumns({"df": F.col("n") - ddof, "statistic": (F.col("n") - ddof) * F.col("s2") / floor_variance})
    return out.withColumn("pvalue", special.chi2_cdf_column(F.col("statistic"), F.col("df")))


def residual_underdispersion(df: DataFrame, series: str, fitted: str, floor_variance: float, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """The floor test on residuals; a row with either value missing is dropped."""
    numeric(df, series, fitted)
    y, f = double(series), double(fitted)
    residual = df.select(*by, F.when(finite(y) & finite(f), y - f).alias("residual"))
    return variance_floor_test(residual, "residual", floor_variance, by, ddof).withColumnRenamed("mean", "mean_residual")


def implied_variance_floor(df: DataFrame, proxy: str, elasticity: float, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    return _values(df, proxy, by).groupBy(*by).agg(F.count("x").alias("n"), (elasticity**2 * variance(F.col("x"), ddof)).alias("floor_variance"))


def ordered(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Keys, t (0, 1, ...) and x of the values that aren't missing."""
    rows = _values(df, value, by, *[c for c in order if c not in by]).where("x is not null")
    return rows.select(*by, (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).alias("t"), "x")


def detrended(series: DataFrame, by: Sequence[str] = (), detrend: str = "none") -> DataFrame:
    """Levels, first differences, or residuals of a straight line."""
    require(detrend in ("none", "diff", "linear"), f"unknown detrend {detrend!r}")
    keyed = W.partitionBy(*by)
    if detrend == "diff":
        steps = series.select(*by, "t", (F.col("x") - F.lag("x").over(keyed.orderBy("t"))).alias("x"), F.max(F.abs("x")).over(keyed).alias("scale"))
        return steps.where("x is not null")
    if detrend == "linear":
        slope = F.coalesce(F.covar_pop("t", "x").over(keyed) / F.nullif(F.var_pop("t").over(keyed), F.lit(0.0)), F.lit(0.0))
        x = F.col("x") - F.avg("x").over(keyed) - slope * (F.col("t") - F.avg("t").over(keyed))
        return series.select(*by, "t", x.alias("x"), F.max(F.abs("x")).over(keyed).alias("scale"))
    return series.select(*by, "t", "x", F.max(F.abs("x")).over(keyed).alias("scale"))


def _ratio(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """von Neumann's ratio of (t, x, scale) with d the step to x; null for constant series."""
    s2 = F.var_samp("x")
    tolerance = F.pow(16 * 2.220446049250313e-16 * F.greatest(F.lit(1.0), F.max("scale")), F.lit(2))
    mssd = F.sum(F.col("d") * F.col("d")) / (F.count("*") - 1)
    return pairs.groupBy(*by).agg(F.count("*").alias("m"), s2.alias("s2"), F.when((F.count("*") >= 3) & (s2 > tolerance), mssd / F.when(s2 != 0, s2)).alias("eta"))


def smoothness_ratio(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), detrend: str = "none") -> DataFrame:
    """Mean squared successive difference over the variance; null below 3 values or for a constant."""
    series = detrended(ordered(df, value, order, by), by, detrend)
    steps = series.withColumn("d", F.col("x") - F.lag("x").over(W.partitionBy(*by).orderBy("t")))
    return _ratio(steps, by)


def too_smooth_test(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), detrend: str = "diff", n_perm: int = 999, seed: int = 0) -> DataFrame:
    """Permutation test of smoothness, lower tail, add-one p-value.

    A permutation orders a series by hash numbers of (seed, replicate, keys, t); its variance is
    that of the series. Replicates are rows, so long series stay distributed by replicate.
    """
    require(n_perm >= 2, f"n_perm must be at least 2; got {n_perm}")
    series = detrended(ordered(df, value, order, by), by, detrend)
    steps = series.withColumn("d", F.col("x") - F.lag("x").over(W.partitionBy(*by).orderBy("t")))
    seen = _ratio(steps, by).where("eta is not null")
    copies = series.select(*by, "t", "x", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("replicate"))
    shuffled = copies.withColumn("u", seeding.uniform(seed, F.col("replicate"), *(F.col(c) for c in by), F.col("t")))
    walk = shuffled.withColumn("d", F.col("x") - F.lag("x").over(W.partitionBy(*by, "replicate").orderBy("u", "t")))
    null = walk.groupBy(*by, "replicate").agg(F.sum(F.col("d") * F.col("d")).alias("ss"))
    joined = on_keys(null, seen, by)
    eta = F.col("ss") / ((F.col("m") - 1) * F.col("s2"))
    out = joined.groupBy(*by, "m", "s2", "eta").agg(
        ((1 + F.count(F.when(eta <= F.col("eta"), 1))) / (n_perm + 1.0)).alias("pvalue"), F.avg(eta).alias("null_mean"), F.stddev_samp(eta).alias("null_sd"), F.expr(f"percentile(ss / ((m - 1) * s2), 0.05)").alias("null_q05")
    )
    return out.withColumn("implied_lag1", 1 - F.col("eta") / 2).drop("s2")


def rolling_variance_floor(df: DataFrame, value: str, order: Sequence[str], floor_variance: float, window: int, by: Sequence[str] = (), ddof: int = 1, alpha: float = 0.05) -> DataFrame:
    """The floor test on every window of consecutive values."""
    _floor(floor_variance, ddof)
    require(window > ddof, f"window must exceed ddof; got {window}")
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}")
    frame = W.partitionBy(*by).orderBy("t").rowsBetween(1 - window, 0)
    s2 = F.var_pop("x").over(frame) * window / (window - ddof)
    rows = ordered(df, value, order, by).select(*by, (F.col("t") - window + 1).alias("start"), F.col("t").alias("end"), F.lit(window).alias("n"), s2.alias("s2")).where("start >= 0")
    rows = rows.withColumn("statistic", (window - ddof) * F.col("s2") / floor_variance)
    rows = rows.withColumn("pvalue", special.chi2_cdf_column(F.col("statistic"), F.lit(float(window - ddof))))
    return rows.withColumn("flag", F.col("pvalue") < alpha)
