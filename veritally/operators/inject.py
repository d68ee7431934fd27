"""Distortions with a known size, and what they displace.

Which rows are touched depends on the seed and the row's id alone. Missing values are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import seeding
from ..core.columns import double, finite
from ..core.errors import EffectError, require
from ..core.order import running, uniform_bucket

QUANTITY_MECHANISMS, SHAPE_MECHANISMS = ("padding", "bunching"), ("rounding", "smoothing")
QUANTITY_DIRECTIONALITY = 0.5


def _strict(name: str) -> Column:
    x = double(name)
    return F.when(finite(x), x).otherwise(F.raise_error(F.lit(f"column {name} has missing values")).cast("double"))


def _share(name: str, value: float) -> None:
    require(0 <= value <= 1, f"{name} must lie in 0..1; got {value}")


def _compared(df: DataFrame) -> DataFrame:
    return df.withColumn("moved", F.col("after") != F.col("before"))


def inject_rounding(df: DataFrame, value: str, den: str, row_id: str, fraction: float, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Round the percentages of a share of the units to whole ones: before, after, moved."""
    _share("fraction", fraction)
    u = seeding.uniform(seed, F.col(row_id))
    rows = df.select(*by, row_id, _strict(value).alias("before"), _strict(den).alias("den"), u.alias("u"))
    rows = running(rows, by, uniform_bucket(F.col("u")), [F.col("u"), F.col(row_id)], {"nth": F.lit(1).cast("long")}, totals={"nth": "n"})
    rounded = F.rint(100.0 * F.col("before") / F.when(F.col("den") != 0, F.col("den"))) * F.col("den") / 100.0
    after = F.when(F.col("nth") <= F.rint(fraction * F.col("n")), F.coalesce(rounded, F.col("before"))).otherwise(F.col("before"))
    return _compared(rows.select(*by, row_id, "before", after.alias("after")))


def inject_bunching(df: DataFrame, value: str, row_id: str, threshold: float, mass: float, window: float, side: str = "above", by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Move a share of the units just short of the threshold to a uniform place just past it."""
    _share("mass", mass)
    require(window > 0 and side in ("above", "below"), "need a positive window and a side above or below")
    x = F.col("before")
    pool = (x >= threshold - window) & (x < threshold) if side == "above" else (x >= threshold) & (x < threshold + window)
    rows = df.select(*by, row_id, _strict(value).alias("before")).select("*", pool.alias("pool"), seeding.uniform(seed, F.col(row_id)).alias("u"), seeding.uniform(seed, "to", F.col(row_id)).alias("v"))
    rows = running(rows, [*by, "pool"], uniform_bucket(F.col("u")), [F.col("u"), F.col(row_id)], {"nth": F.lit(1).cast("long")}, totals={"nth": "n"})
    place = threshold + window * F.col("v") if side == "above" else threshold - window * (1 - F.col("v"))
    after = F.when(F.col("pool") & (F.col("nth") <= F.rint(mass * F.col("n"))), place).otherwise(x)
    return _compared(rows.select(*by, row_id, "before", after.alias("after")))


def inject_padding(df: DataFrame, value: str, order: str, first, last, magnitude: float, by: Sequence[str] = (), mode: str = "multiplicative", taper: int = 0) -> DataFrame:
    """Raise a block of consecutive periods, with ramps of ``taper`` periods at both ends."""
    require(mode in ("multiplicative", "additive"), f"unknown mode {mode!r}")
    rows = df.select(*by, order, _strict(value).alias("before"), F.col(order).between(first, last).alias("inside"))
    up = F.row_number().over(W.partitionBy(*by, "inside").orderBy(order))
    down = F.row_number().over(W.partitionBy(*by, "inside").orderBy(F.col(order).desc()))
    ramp = F.least(F.least(up, down) / F.lit(float(taper)), F.lit(1.0)) if taper else F.lit(1.0)
    rows = rows.withColumn("ramp", F.when(F.col("inside"), ramp).otherwise(0.0))
    after = F.col("before") * (1 + magnitude * F.col("ramp")) if mode == "multiplicative" else F.col("before") + magnitude * F.col("ramp")
    return _compared(rows.select(*by, order, "before", after.alias("after")))


def inject_smoothing(df: DataFrame, value: str, order: str, retain: float, by: Sequence[str] = ()) -> DataFrame:
    """Keep a share of the variance around the local trend (three points, two at the ends)."""
    _share("retain", retain)
    rows = df.select(*by, order, _strict(value).alias("before"))
    trend = F.avg("before").over(W.partitionBy(*by).orderBy(order).rowsBetween(-1, 1))
    return _compared(rows.select(*by, order, "before", (F.col("before") + (retain**0.5 - 1) * (F.col("before") - trend)).alias("after")))


def measure_effect(df: DataFrame, before: str = "before", after: str = "after", by: Sequence[str] = ()) -> DataFrame:
    """Share touched, mean relative displacement, and gross and net displacement of the total."""
    b, a = _strict(before), _strict(after)
    rows = df.select(*by, b.alias("b"), a.alias("a")).withColumn("d", F.col("a") - F.col("b"))
    moved, total = F.col("a") != F.col("b"), F.sum(F.abs("b"))
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("the total before is zero")).cast("double"))
    relative = F.coalesce(F.avg(F.when(moved & (F.col("b") != 0), F.abs("d") / F.abs(F.when(F.col("b") != 0, F.col("b"))))), F.lit(0.0))
    touched = F.sum(moved.cast("long"))
    gross, net = F.sum(F.abs("d")), F.sum("d")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), touched.alias("n_touched"), F.sum((moved & (F.col("b") == 0)).cast("long")).alias("n_undefined"), (touched / F.count("*")).alias("share_touched"), relative.alias("mean_relative_displacement"),
        (gross / checked).alias("gross_displacement"), (net / checked).alias("net_displacement"), F.coalesce(net / F.when(gross > 0, gross), F.lit(0.0)).alias("directionality"),
    )
    return out.withColumn("displacement", F.col("share_touched") * F.col("mean_relative_displacement")).withColumn("moves_quantity", F.abs("directionality") >= QUANTITY_DIRECTIONALITY)


def quantity_claims(effects: DataFrame, mechanism: str | None = None) -> DataFrame:
    """A sentence for each effect that moves quantity, null where none may be claimed."""
    if mechanism in SHAPE_MECHANISMS:
        raise EffectError(f"{mechanism} changes a shape; its size isn't a share of output")
    pct = lambda name: F.round(100 * F.col(name), 1).cast("string")
    text = F.concat(F.lit("about "), pct("share_touched"), F.lit("% of units were moved, by about "), pct("mean_relative_displacement"), F.lit("% each (net "), pct("net_displacement"), F.lit("% of the total)"))
    return effects.withColumn("claim", F.when(F.col("moves_quantity"), text))
