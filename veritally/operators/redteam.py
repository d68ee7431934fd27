"""Honest data that fool naive detectors, and a harness that tries every detector on every trap."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import seeding
from ..core.columns import double
from ..core.errors import RedTeamError, require

TRAPS = {
    "small_units": "shares of small units fall on whole per cents by arithmetic",
    "heterogeneous_mixture": "a mixture of honest groups looks over- or under-dispersed",
    "level_shift": "a change of definition moves a series",
    "reweighting": "a new base year changes an index without any change of output",
    "ocr_noise": "misread digits change digit frequencies",
}
#: Digits that are read as another because their shapes are alike.
GLYPHS = {3: 8, 5: 8, 6: 8, 9: 8}


def trap(name: str) -> str:
    require(name in TRAPS, f"unknown trap {name!r}", RedTeamError)
    return TRAPS[name]


def small_units(spark: SparkSession, n: int, sizes: Sequence[int], p: float = 0.5, seed: int = 0) -> DataFrame:
    """Honest binomial shares: unit_id, num, den; denominators go through ``sizes`` at random.

    A numerator is a count of uniform numbers below p, one for each member of the unit.
    """
    require(n > 0 and bool(sizes) and 0 <= p <= 1, "need units, sizes and a share", RedTeamError)
    pick = F.floor(seeding.uniform(seed, "size", F.col("id")) * len(sizes)).cast("int")
    rows = spark.range(n).select(F.col("id").alias("unit_id"), F.array(*(F.lit(int(s)) for s in sizes))[pick].alias("den"))
    hits = F.filter(F.sequence(F.lit(1), F.col("den")), lambda i: seeding.uniform(seed, F.col("unit_id"), i) < p)
    return rows.select("unit_id", F.size(hits).alias("num"), "den")


def heterogeneous_mixture(spark: SparkSession, groups: Sequence[tuple[int, float, float]], seed: int = 0) -> DataFrame:
    """(unit_id, grp, value): normal groups given as (size, mean, standard deviation)."""
    require(bool(groups), "need at least one group", RedTeamError)
    parts, start = [], 0
    for g, (n, mean, sd) in enumerate(groups):
        parts.append(spark.range(start, start + n).select(F.col("id").alias("unit_id"), F.lit(g).alias("grp"), (mean + sd * seeding.normal(seed, F.col("id"))).alias("value")))
        start += n
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def level_shift(df: DataFrame, value: str, order: str, at, size: float, kind: str = "additive") -> DataFrame:
    """A series that from ``at`` on is raised by a constant, or multiplied by a factor; the break lies inside the series."""
    require(kind in ("additive", "multiplicative"), f"unknown kind {kind!r}", RedTeamError)
    require(kind == "additive" or size > 0, "a factor must be positive", RedTeamError)
    sides = df.agg(F.count(F.when(F.col(order) < at, 1)).alias("before"), F.count(F.when(F.col(order) >= at, 1)).alias("after")).first()
    require(sides["before"] > 0 and sides["after"] > 0, f"the shift must fall inside the series; got {at}", RedTeamError)
    x = double(value)
    moved = x + size if kind == "additive" else x * size
    return df.withColumn("shifted", F.when(F.col(order) >= at, moved).otherwise(x))


def reweighting(df: DataFrame, period: str, good: str, quantity: str, price: str, base_period) -> DataFrame:
    """Laspeyres volume index of each period at the prices of a base period, which is 100."""
    base = df.where(F.col(period) == base_period).groupBy(good).agg(F.avg(double(price)).alias("base_price"), F.sum(double(quantity)).alias("base_quantity"))
    total = base.agg(F.sum(F.col("base_price") * F.col("base_quantity")).alias("base_value"))
    volume = df.groupBy(period, good).agg(F.sum(double(quantity)).alias("q")).join(base, good).groupBy(period).agg(F.sum(F.col("q") * F.col("base_price")).alias("value"))
    return volume.join(F.broadcast(total), F.lit(True)).select(period, (100.0 * F.col("value") / F.col("base_value")).alias("volume_index"))  # one row


def _whole(value: Column) -> Column:
    return F.rint(value.cast("double")).cast("long")


def _slip(whole: Column, row_id: Column, place: Column, confusion: dict[int, int] | None, seed: int) -> tuple[Column, Column]:
    """Of the digit at a place, counted from the right: the rate above which it is misread, and by how much the size of the number then changes.

    Both are null where there is no such digit, or none that can be taken for another.
    """
    size = F.abs(whole)
    at = F.length(size.cast("string")) - 1 - place
    unit = F.pow(F.lit(10.0), place).cast("long")
    d = (F.call_function("div", size, unit) % 10).cast("int")
    there = at >= 0
    if confusion is None:
        other = F.pmod(d + 1 + F.floor(9 * seeding.uniform(seed, "to", row_id, at)).cast("int"), F.lit(10))
    else:
        there = there & d.isin(*confusion)
        other = F.coalesce(*(F.when(d == x, F.lit(y)) for x, y in confusion.items()), d)
    return F.when(there, seeding.uniform(seed, row_id, at)), F.when(there, (other - d) * unit)


def _places(whole: Column) -> Column:
    return F.sequence(F.lit(0), F.length(F.abs(whole).cast("string")) - 1)


def _changed(whole: Column, change: Column) -> Column:
    return F.when(whole < 0, -1).otherwise(1) * (F.abs(whole) + change)


def _counted(slip: tuple[Column, Column], rate: Column | float) -> Column:
    return F.when(slip[0] < rate, slip[1]).otherwise(F.lit(0).cast("long"))


def misread(value: Column, row_id: Column, rate: Column | float, confusion: dict[int, int] | None = None, seed: int = 0, positions: Sequence[int] | None = None) -> Column:
    """Digits of an integer, each misread with chance ``rate``: any other digit, or by a map of alike shapes.

    ``positions`` are the digits that can be misread, counted from the right (0 is the last); by default all. A number keeps its sign.
    """
    whole = _whole(value)
    if positions is None:
        return _changed(whole, F.aggregate(_places(whole), F.lit(0).cast("long"), lambda a, p: a + _counted(_slip(whole, row_id, p, confusion, seed), rate)))
    return _changed(whole, sum((_counted(_slip(whole, row_id, F.lit(int(p)), confusion, seed), rate) for p in sorted(set(positions))), F.lit(0).cast("long")))


def ocr_noise(df: DataFrame, value: str, row_id: str, rate: float, confusion: dict[int, int] | None = None, seed: int = 0, positions: Sequence[int] | None = None) -> DataFrame:
    require(0 <= rate <= 1, f"rate must lie in 0..1; got {rate}", RedTeamError)
    require(positions is None or (len(positions) > 0 and all(p >= 0 for p in positions)), f"positions must be places from the right; got {positions!r}", RedTeamError)
    return df.withColumn("misread", misread(F.col(value), F.col(row_id), rate, confusion, seed, positions))


#: A detector on a table of many samples: (table, keys of a sample) to (keys, pvalue), a row for each sample.
TableDetector = Callable[[DataFrame, Sequence[str]], DataFrame]
RESULT = "detector string, trap string, n long, fired boolean, pvalue double, error string"


def red_team(detectors: dict[str, Callable | TableDetector], samples: dict[str, DataFrame], alpha: float = 0.05, by_table: Sequence[str] = ()) -> DataFrame:
    """Every detector on every trap, in one plan: (detector, trap, n, fired, pvalue, error). No pair can be left out.

    Samples are tables of the same columns. A detector gives a p-value for a sample that it gets as a pandas table; those named in ``by_table``
    get all samples as one Spark table with the key ``trap``, and give (trap, pvalue). The pairs of the first kind are groups of one
    job, a pair to a task, so their samples must fit one; of the second kind samples can be of any size.

    A detector that fails, gives no p-value, or one that isn't a finite number, didn't fire: its p-value is null and the error recorded.
    """
    require(bool(detectors) and bool(samples), "need at least one detector and one trap", RedTeamError)
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}", RedTeamError)
    require(set(by_table) <= set(detectors), f"no detectors {sorted(set(by_table) - set(detectors))}", RedTeamError)
    for name in samples:
        trap(name)
    rows = reduce(DataFrame.unionByName, (df.withColumn("trap", F.lit(name)) for name, df in samples.items()))
    spark = rows.sparkSession
    every = spark.createDataFrame([(d, t) for d in detectors for t in samples], "detector string, trap string")
    sizes = rows.groupBy("trap").agg(F.count("*").alias("n"))
    parts = []
    small = {name: f for name, f in detectors.items() if name not in by_table}
    if small:
        cells = rows.select("*", F.explode(F.array(*(F.lit(n) for n in small))).alias("detector"))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            name, error, p = frame["detector"].iloc[0], None, None
            try:
                found = small[name](frame.drop(columns=["detector", "trap"]))
                p = float(getattr(found, "pvalue", found))
                if not math.isfinite(p):
                    p, error = None, f"the p-value is {p}"
            except Exception as failure:  # noqa: BLE001  what a detector raises is part of the result
                error = f"{type(failure).__name__}: {str(failure)[:200]}"
            return pd.DataFrame({"detector": [name], "trap": [frame["trap"].iloc[0]], "pvalue": pd.array([p], "Float64"), "error": [error]})

        parts.append(cells.groupBy("detector", "trap").applyInPandas(run, "detector string, trap string, pvalue double, error string"))
    for name in by_table:
        parts.append(detectors[name](rows, ["trap"]).select(F.lit(name).alias("detector"), "trap", F.col("pvalue").cast("double").alias("pvalue"), F.lit(None).cast("string").alias("error")))
    found = every.join(sizes, "trap", "left").join(reduce(DataFrame.unionAll, parts), ["detector", "trap"], "left")
    usable = F.col("pvalue").isNotNull() & ~F.isnan("pvalue")
    error = F.when(~usable, F.coalesce("error", F.lit("no usable p-value")))
    return found.select("detector", "trap", F.coalesce("n", F.lit(0)).alias("n"), (usable & (F.coalesce("pvalue", F.lit(1.0)) <= alpha)).alias("fired"), F.when(usable, F.col("pvalue")).alias("pvalue"), error.alias("error"))


def ocr_firings(df: DataFrame, value: str, row_id: str, detector: TableDetector, rates: Sequence[float], n_replicates: int = 20, alpha: float = 0.05, confusion: dict[int, int] | None = None, seed: int = 0, positions: Sequence[int] | None = (0,)) -> DataFrame:
    """(rate, replicate, pvalue, fired) of a detector on a table whose digits are misread at every rate, in every replicate.

    The grid is a key of one job: each row is copied to all its cells within a task, and the detector, which gets (rate, replicate, misread) with the first two as
    keys, adds them up before the shuffle. Random numbers are drawn once for a row's replicate: its digits are the same ``misread`` at every rate, only
    with more of them wrong. A null or NaN p-value didn't fire.
    """
    require(bool(rates) and all(0 <= r <= 1 for r in rates), "need error rates in 0..1", RedTeamError)
    require(n_replicates >= 1 and 0 < alpha < 1, "need a replicate, and alpha in (0, 1)", RedTeamError)
    rows = df.select(_whole(F.col(value)).alias("_whole"), F.col(row_id).alias("_id"), F.explode(F.sequence(F.lit(1), F.lit(n_replicates))).alias("replicate"))
    whole, name = F.col("_whole"), F.concat_ws(":", "replicate", F.col("_id"))
    slips = lambda place: _slip(whole, name, place, confusion, seed)
    if positions is None:
        drawn = {"_slips": F.transform(_places(whole), lambda p: F.struct(*(c.alias(n) for n, c in zip(("below", "change"), slips(p), strict=True))))}
        change = F.aggregate("_slips", F.lit(0).cast("long"), lambda a, x: a + _counted((x["below"], x["change"]), F.col("rate")))
    else:
        places = sorted({int(p) for p in positions})
        drawn = {f"_{n}{p}": c for p in places for n, c in zip(("below", "change"), slips(F.lit(p)), strict=True)}
        change = sum((_counted((F.col(f"_below{p}"), F.col(f"_change{p}")), F.col("rate")) for p in places), F.lit(0).cast("long"))
    grid = rows.select("replicate", "_whole", *(c.alias(n) for n, c in drawn.items())).select("*", F.explode(F.array(*(F.lit(float(r)) for r in sorted(set(rates))))).alias("rate"))
    cells = grid.select("rate", "replicate", _changed(whole, change).alias("misread"))
    p = F.col("pvalue").cast("double")
    return detector(cells, ["rate", "replicate"]).select("rate", "replicate", p.alias("pvalue"), F.coalesce((p <= alpha) & ~F.isnan(p), F.lit(False)).alias("fired"))


def ocr_firing_threshold(df: DataFrame, value: str, row_id: str, detector: TableDetector, rates: Sequence[float], fire_share: float = 0.5, **options) -> DataFrame:
    """(threshold): the smallest rate at which the detector fires in more than a share of replicates; null if at none, which doesn't mean that it is safe."""
    require(0 < fire_share < 1, f"fire_share must lie in (0, 1); got {fire_share}", RedTeamError)
    return firing_threshold(ocr_firings(df, value, row_id, detector, rates, **options), fire_share)


def casualties(results: DataFrame) -> DataFrame:
    return results.where("fired").orderBy("pvalue", "detector", "trap")


def survivors(results: DataFrame, detector: str) -> DataFrame:
    return results.where((F.col("detector") == detector) & ~F.col("fired"))


def firing_threshold(rates: DataFrame, fire_share: float = 0.5) -> DataFrame:
    """Smallest error rate at which more than a share of replicates fired, from (rate, fired)."""
    shares = rates.groupBy("rate").agg(F.avg(F.col("fired").cast("double")).alias("share"))
    return shares.agg(F.min(F.when(F.col("share") > fire_share, F.col("rate"))).alias("threshold"))


def ocr_gate(threshold: Column, measured: Column) -> Column:
    """Whether a digit test may run on data with this measured error rate: it lies below the rate at which the test fires.

    Without a threshold (the test fired at no rate) it may not: what was never made to fire isn't known to be safe.
    """
    return F.coalesce(measured < threshold, F.lit(False))
