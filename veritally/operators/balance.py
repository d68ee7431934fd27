"""Baseline tables that are too balanced: analysis of variance from summaries, and combined p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import special
from ..core.columns import double, finite, on_keys
from ..core.errors import require
from ..core.order import running, uniform_bucket


def anova_table(df: DataFrame, mean: str, sd: str, n: str, variable: Sequence[str]) -> DataFrame:
    """F and its p-value for each variable, from group means, standard deviations and sizes.

    A variable with a missing value in any group is left out.
    """
    m, s, k = double(mean), double(sd), double(n)
    bad = ~(finite(m) & finite(s) & finite(k)) | (s < 0) | (k < 2)
    sums = df.groupBy(*variable).agg(
        F.count("*").alias("groups"), F.sum(k).alias("n"), (F.sum(k * m) / F.sum(k)).alias("grand"), F.sum(k * m * m).alias("k2"), F.sum((k - 1) * s * s).alias("within"), F.max(bad.cast("int")).alias("bad")
    )
    sums = sums.where("bad = 0 and groups >= 2")
    between = F.greatest(F.col("k2") - F.col("n") * F.col("grand") * F.col("grand"), F.lit(0.0))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = (between / d1) / F.when(F.col("within") > 0, F.col("within") / d2)
    out = sums.select(*variable, d1.cast("double").alias("df1"), d2.alias("df2"), between.alias("between"), "within", f.alias("f"))
    p = F.when(F.col("within") > 0, special.f_sf_column(F.col("f"), F.col("df1"), F.col("df2"))).when(F.col("between") > 0, 0.0).otherwise(1.0)
    return out.withColumn("pvalue", p)


def combine_pvalues(df: DataFrame, pvalue: str, by: Sequence[str] = (), method: str = "stouffer", clip: float = 1e-12) -> DataFrame:
    """Evidence that p-values are too large: balance better than chance. A missing p-value is refused."""
    require(method in ("stouffer", "fisher"), f"unknown method {method!r}")
    p = double(pvalue)
    good = finite(p) & (p >= 0) & (p <= 1)
    q = F.when(good, F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))).otherwise(F.raise_error(F.lit("p-values must lie in 0..1")).cast("double"))
    rows = df.select(*by, q.alias("q"))
    if method == "fisher":
        out = rows.groupBy(*by).agg(F.count("*").alias("n"), (-2 * F.sum(F.log1p(-F.col("q")))).alias("statistic"))
        return out.withColumn("pvalue", special.chi2_sf_column(F.col("statistic"), 2 * F.col("n")))
    out = rows.select(*by, special.norm_ppf_column(F.col("q")).alias("z")).groupBy(*by).agg(F.count("*").alias("n"), (F.sum("z") / F.sqrt(F.count("*"))).alias("statistic"))
    return out.withColumn("pvalue", special.norm_sf_column(F.col("statistic")))


def ks_too_balanced(df: DataFrame, pvalue: str, by: Sequence[str] = ()) -> DataFrame:
    """One-sided Kolmogorov-Smirnov statistic for p-values above uniform, with its exact p-value."""
    rows = df.select(*by, double(pvalue).alias("p"))
    placed = running(rows, by, uniform_bucket(F.col("p")), [F.col("p")], {"nth": F.lit(1).cast("long")}, totals={"nth": "n"})
    placed = placed.select(*by, (F.col("p") - (F.col("nth") - 1) / F.col("n")).alias("gap"))
    out = placed.groupBy(*by).agg(F.count("*").alias("n"), F.greatest(F.max("gap"), F.lit(0.0)).alias("ks"))
    return out.withColumn("ks_pvalue", special.ks_sf_column(F.col("ks"), F.col("n")))


def carlisle_test(df: DataFrame, mean: str, sd: str, n: str, variable: str, table: Sequence[str] = (), method: str = "stouffer", clip: float = 1e-12) -> DataFrame:
    """A row for each table: combined p-value, KS, and the share of p-values above 0.9."""
    single = anova_table(df, mean, sd, n, [*table, variable])
    total = df.groupBy(*table).agg(F.countDistinct(variable).alias("n_variables"))
    share = single.groupBy(*table).agg(F.avg((F.col("pvalue") > 0.9).cast("double")).alias("share_pvalue_above_0p9"))
    joined = combine_pvalues(single, "pvalue", table, method, clip)
    for other in (ks_too_balanced(single, "pvalue", table).drop("n"), share, total):
        joined = on_keys(joined, other, table)
    return joined.withColumn("n_dropped", F.col("n_variables") - F.col("n"))
