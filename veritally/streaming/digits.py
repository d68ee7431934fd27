"""Digit counts of a stream: an extension, as the statistics are sums of mergeable counts.

Windows by event time, with a watermark for late rows; each batch of finished counts can be given to
the same tests as a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.columns import double
from ..operators.digits import expected, leading_digits, support


def windowed_digit_counts(stream: DataFrame, ts: str, value: str, by: Sequence[str] = (), window: str = "1 day", watermark: str = "1 day", position: str = "first") -> DataFrame:
    """(window_start, keys, digit, n) of a stream or a table."""
    rows = stream.select(F.col(ts).cast("timestamp").alias("ts"), *by, leading_digits(double(value), position).alias("digit")).where("digit is not null")
    counts = rows.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), *by, "digit").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "digit", "n")


def chi2_of_counts(counts: DataFrame, by: Sequence[str], position: str = "first") -> DataFrame:
    """Chi-square of finished counts (keys, digit, n); several rows of a digit, as from several windows, are added up first."""
    shares = F.create_map(*(x for d, p in zip(support(position), expected(position), strict=True) for x in (F.lit(int(d)).cast("long"), F.lit(p))))
    share = shares[F.col("digit").cast("long")]
    whole = counts.groupBy(*by, "digit").agg(F.sum("n").alias("n"))
    out = whole.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / share).alias("q"))
    return out.select(*by, "n", (F.col("q") / F.col("n") - F.col("n")).alias("chi2"))
