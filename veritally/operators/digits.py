"""Leading and terminal digits: frequencies and tests, for each key at once.

Values that are missing, not positive (leading digits) or lack the digit are dropped and counted.
All statistics of a key come from one dense array of counts; keys are rows, so a table with a
million keys needs one shuffle of its distinct (key, digit) pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import special
from ..core.columns import array_sum, dense_counts, double, finite, literals, numeric, observed, on_keys
from ..core.errors import require

#: The published conformity bands of the mean absolute deviation, and their names.
MAD_BANDS = {"first": (0.006, 0.012, 0.015), "second": (0.008, 0.010, 0.012), "first_two": (0.0012, 0.0018, 0.0022)}
MAD_LABELS = ("close conformity", "acceptable conformity", "marginally acceptable conformity", "nonconformity")
SUPPORT = {"first": range(1, 10), "second": range(10), "first_two": range(10, 100)}
EXACT_INTEGER = 2.0**53


def support(position: str) -> range:
    require(position in SUPPORT, f"position must be one of {sorted(SUPPORT)}; got {position!r}")
    return SUPPORT[position]


def expected(position: str) -> list[float]:
    """Share of each digit under the logarithmic law."""
    pairs = {d: math.log10(1 + 1 / d) for d in (range(1, 10) if position == "first" else range(10, 100))}
    if support(position) is SUPPORT["second"]:
        return [sum(p for d, p in pairs.items() if d % 10 == digit) for digit in SUPPORT["second"]]
    return list(pairs.values())


def _significand(x: Column) -> tuple[Column, Column]:
    """x = m * 10^e with 1 <= m < 10; the logarithm may be off by one either way."""
    e = F.floor(F.log10(x)).cast("double")
    m = x / F.pow(F.lit(10.0), e)
    e, m = F.when(m >= 10, e + 1).otherwise(e), F.when(m >= 10, m / 10).otherwise(m)
    e, m = F.when(m < 1, e - 1).otherwise(e), F.round(F.when(m < 1, m * 10).otherwise(m), 12)
    return F.when(m >= 10, m / 10).otherwise(m), F.when(m >= 10, e + 1).otherwise(e)


def leading_digits(x: Column, position: str = "first", two_significant: bool = True) -> Column:
    """Digit of each value, null where it has none.

    For ``second``, values like 3 or 40, which are one digit and zeros, have no second digit unless
    ``two_significant`` is off.
    """
    support(position)
    x = x.cast("double")
    m, e = _significand(x)
    both = F.greatest(F.least(F.floor(F.round(m * 10, 9)).cast("long"), F.lit(99)), F.lit(10)).cast("long")
    first = F.floor(both / 10).cast("long")
    digit = {"first": first, "first_two": both, "second": both % 10}[position]
    usable = finite(x) & (x > 0)
    if position == "second" and two_significant:
        usable = usable & (F.abs(x - first * F.pow(F.lit(10.0), e)) > 1e-12 * x)
    return F.when(usable, digit)


def digit_counts(df: DataFrame, value: str, by: Sequence[str] = (), position: str = "first", weight: str | None = None, two_significant: bool = True) -> DataFrame:
    numeric(df, value)
    rows = observed(df, by, double(value), weight)
    return dense_counts(rows, by, leading_digits(F.col("x"), position, two_significant), support(position))


def digit_table(df: DataFrame, value: str, by: Sequence[str] = (), position: str = "first", weight: str | None = None, two_significant: bool = True) -> DataFrame:
    """A row for each key and digit: observed and expected counts and shares."""
    counts = digit_counts(df, value, by, position, weight, two_significant).withColumn("total", array_sum(F.col("observed")))
    cells = counts.select(*by, "n", "effective_n", "n_dropped", "total", F.posexplode(F.arrays_zip(F.col("observed"), literals(expected(position)).alias("share"))).alias("at", "cell"))
    count, share = F.col("cell.observed"), F.col("cell.share")
    return cells.select(
        *by, (F.col("at") + support(position)[0]).cast("long").alias("digit"), count.alias("observed"), (share * F.col("total")).alias("expected"),
        (count / F.col("total")).alias("observed_prop"), share.alias("expected_prop"), "n", "effective_n", "n_dropped",
    )


def kuiper_pvalue(v: Column, n: Column) -> Column:
    """Asymptotic series of the Kuiper statistic with its small-sample correction."""
    root = F.sqrt(n)
    lam = (root + 0.155 + 0.24 / root) * v
    a = lambda j: 2.0 * j * j * lam * lam
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(a(j) <= 700, (4 * a(j) - 2) * F.exp(-a(j))).otherwise(0.0))
    return F.when(lam < 0.4, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def conformity(mad: Column, position: str) -> Column:
    bands = MAD_BANDS[position]
    out = F.when(mad < bands[0], MAD_LABELS[0]).when(mad < bands[1], MAD_LABELS[1]).when(mad < bands[2], MAD_LABELS[2])
    return out.otherwise(MAD_LABELS[3])


def goodness_of_fit(observed_prop: Column, shares: Sequence[float], n: Column) -> Column:
    parts = F.zip_with(observed_prop, literals(shares), lambda o, e: (o - e) * (o - e) / e)
    return n * array_sum(parts)


def benford_test(df: DataFrame, value: str, by: Sequence[str] = (), position: str = "first", weight: str | None = None, two_significant: bool = True) -> DataFrame:
    """A row for each key: chi-square, mean absolute deviation with its band, and Kuiper's V.

    With weights the p-values use the effective number of observations and are approximate.
    """
    shares = expected(position)
    counts = digit_counts(df, value, by, position, weight, two_significant)
    total = array_sum(F.col("observed"))
    prop = counts.select("*", F.transform("observed", lambda c: c / total).alias("prop"))
    steps = F.zip_with("prop", literals(shares), lambda o, e: o - e)
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("high"), F.lit(0.0).alias("low")),
        lambda s, d: F.struct((s["at"] + d).alias("at"), F.greatest(s["high"], s["at"] + d).alias("high"), F.least(s["low"], s["at"] + d).alias("low")),
    )
    out = prop.select(
        *by, "n", "effective_n", "n_dropped",
        goodness_of_fit(F.col("prop"), shares, F.col("effective_n")).alias("chi2"), F.lit(len(shares) - 1).alias("df"),
        (array_sum(F.transform(steps, F.abs)) / len(shares)).alias("mad"), walk.alias("walk"), F.lit(weight is not None).alias("weighted"),
    )
    out = out.withColumns({"d_plus": F.col("walk.high"), "d_minus": -F.col("walk.low"), "kuiper_v": F.col("walk.high") - F.col("walk.low")}).drop("walk")
    return out.withColumns(
        {"conformity": conformity(F.col("mad"), position), "kuiper_pvalue": kuiper_pvalue(F.col("kuiper_v"), F.col("effective_n")), "chi2_pvalue": special.chi2_sf_column(F.col("chi2"), F.col("df"))}
    )


def terminal_digits(x: Column, k: int = 1) -> Column:
    """Last k digits of integers; null if missing, an error if not an integer or too large to be exact."""
    require(isinstance(k, int) and not isinstance(k, bool) and 1 <= k <= 9, f"k must be an integer from 1 to 9; got {k!r}")
    x = x.cast("double")
    exact = (F.abs(x - F.rint(x)) <= 1e-9) & (F.abs(x) < EXACT_INTEGER)
    refuse = F.raise_error(F.lit("terminal digits need integers below 2^53")).cast("long")
    return F.when(finite(x), F.when(exact, F.pmod(F.abs(F.rint(x)).cast("long"), F.lit(10**k).cast("long"))).otherwise(refuse))


def terminal_digit_test(df: DataFrame, value: str, by: Sequence[str] = (), k: int = 1, weight: str | None = None) -> DataFrame:
    """Chi-square of the last k digits against uniformity, and the cell that departs most."""
    numeric(df, value)
    cells = 10**k
    counts = dense_counts(observed(df, by, double(value), weight), by, terminal_digits(F.col("x"), k), range(cells))
    total = array_sum(F.col("observed"))
    out = counts.select(*by, "n", "effective_n", "n_dropped", F.transform("observed", lambda c: c / total).alias("prop"))
    gaps = F.transform("prop", lambda p: p - 1.0 / cells)
    chi2 = F.col("effective_n") * array_sum(F.transform(gaps, lambda g: g * g * cells))
    out = out.select(
        *by, "n", "effective_n", "n_dropped", chi2.alias("chi2"), F.lit(cells - 1).alias("df"),
        F.array_max(F.transform(gaps, F.abs)).alias("max_abs_dev"), F.array_max(gaps).alias("max_excess"), (F.array_position(gaps, F.array_max(gaps)) - 1).alias("max_excess_cell"),
    )
    return out.withColumn("pvalue", special.chi2_sf_column(F.col("chi2"), F.col("df")))


def terminal_pair_test(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The last two digits: chi-square over 100 cells, and the shares of repeated and adjacent pairs."""
    out = terminal_digit_test(df, value, by, 2, weight).drop("max_abs_dev", "max_excess", "max_excess_cell").withColumnRenamed("n", "n_")
    pairs = observed(df, by, double(value), weight).select(*by, "w", terminal_digits(F.col("x"), 2).alias("pair"))
    tens, ones = F.floor(F.col("pair") / 10), F.col("pair") % 10
    share = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0.0)) / F.sum("w")
    shares = pairs.where("pair is not null").groupBy(*by).agg(share(tens == ones).alias("repeated"), share(F.abs(tens - ones) == 1).alias("adjacent"))
    joined = on_keys(out, shares, by)
    z = lambda p, null: (F.col(p) - null) / F.sqrt(F.lit(null * (1 - null)) / F.col("effective_n"))
    joined = joined.withColumns({"repeated_z": z("repeated", 0.10), "adjacent_z": z("adjacent", 0.18)}).withColumnRenamed("n_", "n")
    two_sided = lambda name: 2 * special.norm_sf_column(F.abs(F.col(name)))
    return joined.withColumns({"repeated_pvalue": two_sided("repeated_z"), "adjacent_pvalue": two_sided("adjacent_z")})
