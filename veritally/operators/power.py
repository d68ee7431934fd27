"""Statistical power: rejection rates by sample size and effect, and aggregation ladders.

Samples are drawn from the whole population where it lies, without replacement and without passing it through one place: rows
are ordered by a hash, and every ``n`` rows in that order are a sample. Orders are made anew only when a population is used up.
A ladder distorts and rolls up all units, once for each replicate, as rows of one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import seeding
from ..core.columns import double, finite
from ..core.errors import AtlasError, LadderError, require
from ..core.order import running, uniform_bucket

#: The published grid of sizes, and how far above alpha a test may reject.
SAMPLE_SIZES = (50, 100, 300, 1000, 3000, 10_000, 30_000, 95_000)
ATLAS = "method string, n long, effect_size double, power double, power_se double, n_replicates long, alpha double, false_positive_rate double"
SEMANTICS = ("sum_then_ratio", "mean_of_ratios")
#: A power figure isn't used where the test rejects more than this times alpha without an effect.
FPR_TOLERANCE = 2.0


def samples(df: DataFrame, value: str, row_id: str, sizes: Sequence[int], n_samples: int, seed: int = 0) -> DataFrame:
    """(n, sample, nth, x): ``n_samples`` samples of each size, each without replacement, from all finite values of the column.

    An order is by a hash of (seed, n, number of the order, row_id), so samples don't depend on partitions. One order gives as many
    samples as have room in the population, and these share no row. Only rows that can belong to a sample are ranked: those
    with a hash below the share that is needed, and eight standard errors more. Repeated ids lie side by side in an order.
    """
    x = double(value)
    rows = df.where(finite(x)).select(F.col(row_id).alias("id"), x.alias("x"))
    total = rows.count()
    require(bool(sizes) and total >= max(sizes) and min(sizes) >= 1, f"the population has {total} values; samples can't be larger, as they are drawn without replacement", AtlasError)
    parts = []
    for n in sizes:
        per = min(n_samples, total // n)
        orders = -(-n_samples // per)
        share = (per * n + 8 * math.sqrt(per * n) + 64) / total
        u = seeding.uniform(seed, F.lit(n), F.col("ordering"), F.col("id"))
        drawn = rows.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("ordering")).withColumn("u", u)
        if share < 1:
            drawn = drawn.where(F.col("u") < share)
        ranked = running(drawn, ["ordering"], uniform_bucket(F.col("u") / min(share, 1.0)), [F.col("u"), F.col("id"), F.col("x")], {"nth": F.lit(1).cast("long")})
        sample = F.col("ordering") * per + F.floor((F.col("nth") - 1) / n)
        kept = ranked.where(F.col("nth") <= per * n).select(F.lit(n).cast("long").alias("n"), sample.cast("long").alias("sample"), "nth", "x")
        parts.append(kept.where(F.col("sample") < n_samples))
    return reduce(DataFrame.unionAll, parts)


def _generator(*key) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=int(pd.util.hash_array(np.array([repr(key)], object))[0])))


def _rejects(test: Callable, alpha: float, *sample) -> bool:
    """A test that raises or gives no number doesn't reject."""
    try:
        p = float(test(*sample))
    except (ValueError, ZeroDivisionError, FloatingPointError):
        return False
    return math.isfinite(p) and p <= alpha


def power_curve(df: DataFrame, value: str, row_id: str, test: Callable, injector: Callable, method: str, effect_sizes: Sequence[float], sample_sizes: Sequence[int] = SAMPLE_SIZES, n_replicates: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Rejection rate of ``test`` for each size and effect; effect 0 is always there and gives the false-positive rate.

    ``test(values)`` gives a p-value, ``injector(values, effect, generator)`` distorts a copy. Every effect is tried on the same
    samples. A task holds one sample.
    """
    sizes, effects = sorted({int(n) for n in sample_sizes}), sorted({float(e) for e in effect_sizes} | {0.0})
    drawn = samples(df, value, row_id, sizes, n_replicates, seed)
    probe = np.array([r["x"] for r in df.where(finite(double(value))).select(double(value).alias("x")).limit(1000).collect()])
    require(np.allclose(injector(probe.copy(), 0.0, _generator("probe")), probe), "the injector changes values at effect 0", AtlasError)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, number = int(frame["n"].iloc[0]), int(frame["sample"].iloc[0])
        require(len(frame) == n, "a sample is incomplete: take another seed", AtlasError)
        values = frame.sort_values("nth")["x"].to_numpy()
        found = [_rejects(test, alpha, injector(values.copy(), e, _generator(seed, method, n, e, number)) if e else values.copy()) for e in effects]
        return pd.DataFrame({"n": n, "effect_size": effects, "rejected": found})

    done = drawn.groupBy("n", "sample").applyInPandas(run, "n long, effect_size double, rejected boolean")
    power = done.groupBy("n", "effect_size").agg(F.avg(F.col("rejected").cast("double")).alias("power"))
    false = F.max(F.when(F.col("effect_size") == 0, F.col("power"))).over(W.partitionBy("n"))
    se = F.sqrt(F.col("power") * (1 - F.col("power")) / n_replicates)
    return power.select(
        F.lit(method).alias("method"), "n", "effect_size", "power", se.alias("power_se"), F.lit(n_replicates).cast("long").alias("n_replicates"), F.lit(alpha).alias("alpha"), false.alias("false_positive_rate")
    )


def minimum_detectable_effect(atlas: DataFrame, target_power: float = 0.8, check_calibration: bool = True) -> DataFrame:
    """Per method and n the smallest measured effect with the target power, or why there is none; never interpolated."""
    reach = (F.col("effect_size") > 0) & (F.col("power") >= target_power)
    out = atlas.groupBy("method", "n").agg(F.min(F.when(reach, F.col("effect_size"))).alias("smallest"), F.max("false_positive_rate").alias("fpr"), F.max("alpha").alias("alpha"))
    loose = (F.col("fpr") > FPR_TOLERANCE * F.col("alpha")) if check_calibration else F.lit(False)
    status = F.when(loose, "rejects too often without an effect").when(F.col("smallest").isNull(), "not reached by any measured effect").otherwise("ok")
    return out.select("method", "n", F.when(~loose, F.col("smallest")).alias("minimum_detectable_effect"), status.alias("status"))


def detectable(atlas: DataFrame, effect: float, target_power: float = 0.8) -> DataFrame:
    found = minimum_detectable_effect(atlas, target_power)
    return found.select("method", "n", F.coalesce(F.lit(effect) >= F.col("minimum_detectable_effect"), F.lit(False)).alias("detectable"))


def roll_up(df: DataFrame, num: str, den: str, levels: Sequence[str]) -> DataFrame:
    """All levels of a hierarchy at once, coarsest column first: sums, and both percentages of each group.

    Denominators must be positive and nothing missing.
    """
    n, d = double(num), double(den)
    good = finite(n) & finite(d) & (d > 0)
    refuse = F.raise_error(F.lit("numerators must be finite and denominators positive")).cast("double")
    rows = df.select(*levels, F.when(good, n).otherwise(refuse).alias("num"), F.when(good, d).otherwise(refuse).alias("den"))
    out = rows.rollup(*levels).agg(F.grouping_id().alias("gid"), F.count("*").alias("units"), F.sum("num").alias("num"), F.sum("den").alias("den"), F.avg(100.0 * F.col("num") / F.col("den")).alias("mean_of_ratios"))
    depth = len(levels) - F.bit_count("gid")
    return out.select(depth.cast("int").alias("depth"), *levels, "units", "num", "den", (100.0 * F.col("num") / F.col("den")).alias("sum_then_ratio"), "mean_of_ratios")


LADDER = "level string, semantics string, effect_size double, n_units long, mean_group_size double, power double, power_se double, false_positive_rate double, n_replicates long, alpha double"


def aggregation_ladder(df: DataFrame, num: str, den: str, row_id: str, levels: Sequence[tuple[str, str | None]], test: Callable[[Column, Column, Column], Column], injector: Callable[[Column, Column, Column, Column], Column], effect_sizes: Sequence[float], semantics: Sequence[str] = SEMANTICS, n_replicates: int = 100, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Power after aggregating units by each level: distort units, roll up, test.

    ``levels`` are (name, key column), the first being the units themselves (None). Both callables make columns:
    ``injector(num, den, effect, draw)`` the distorted numerator of a unit, draw being a uniform number of (seed, replicate, row_id), and
    ``test(num, den, pct)`` a p-value as an aggregate over the groups of a level; a null or NaN doesn't reject. So every
    unit is distorted and rolled up where it lies, and a replicate of a level costs its groups, added up before the shuffle.
    """
    require(bool(levels) and levels[0][1] is None, "the first level must be the units themselves", LadderError)
    require(all(s in SEMANTICS for s in semantics), f"semantics must be among {SEMANTICS}", LadderError)
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}", LadderError)
    require(n_replicates >= 1, "need a replicate", LadderError)
    n, d, effect, draw = F.col("num"), F.col("den"), F.col("effect_size"), seeding.uniform(seed, F.col("replicate"), F.col("unit"))
    units = df.select(double(num).alias("num"), double(den).alias("den"), F.col(row_id).alias("unit"), *(F.col(k).alias(f"key{i}") for i, (_, k) in enumerate(levels) if k))
    still = injector(n, d, F.lit(0.0), seeding.uniform(seed, F.lit(0), F.col("unit")))
    good = finite(n) & finite(d) & (d > 0)
    facts = units.agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.count_if(good & (F.abs(still - n) > 1e-9 * (1 + F.abs(n)))).alias("changed")).first()
    require(facts["n"] > 0 and not facts["bad"], "there must be units, with finite numerators and positive denominators", LadderError)
    require(not facts["changed"], "the injector changes units at effect 0", LadderError)
    effects = sorted({float(e) for e in effect_sizes} | {0.0})
    cells = units.select("*", F.explode(F.array(*(F.lit(e) for e in effects))).alias("effect_size"))
    numbers = F.when(effect == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.lit(n_replicates)))  # undistorted units are the same in every replicate
    cells = cells.select("*", F.explode(numbers).alias("replicate"))
    cells = cells.select("den", "effect_size", "replicate", F.when(effect == 0, n).otherwise(injector(n, d, effect, draw)).alias("num"), *(c for c in units.columns if c.startswith("key")))
    parts = []
    for i, (name, key) in enumerate(levels):
        if key is None:
            rows = cells.select("effect_size", "replicate", "num", "den", *((100.0 * n / d).alias(s) for s in SEMANTICS))
        else:
            rows = cells.groupBy("effect_size", "replicate", f"key{i}").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.avg(100.0 * n / d).alias("mean_of_ratios")).withColumn("sum_then_ratio", 100.0 * n / d)
        wide = rows.groupBy("effect_size", "replicate").agg(F.count("*").alias("n_units"), *(test(n, d, F.col(s)).alias(s) for s in semantics))
        long = wide.select("effect_size", "n_units", F.explode(F.array(*(F.struct(F.lit(s).alias("semantics"), F.col(s).cast("double").alias("p")) for s in semantics))).alias("t"))
        rejected = F.coalesce((F.col("t.p") <= alpha) & ~F.isnan("t.p"), F.lit(False)).cast("double")
        power = long.groupBy(F.col("t.semantics").alias("semantics"), "effect_size").agg(F.max("n_units").alias("n_units"), F.avg(rejected).alias("power"))
        parts.append(power.select(F.lit(name).alias("level"), F.lit(i).alias("level_ordinal"), "*"))
    false = F.max(F.when(effect == 0, F.col("power"))).over(W.partitionBy("level", "semantics"))
    return reduce(DataFrame.unionAll, parts).select(
        "level", "level_ordinal", "semantics", "effect_size", "n_units", (F.lit(float(facts["n"])) / F.col("n_units")).alias("mean_group_size"), "power",
        F.sqrt(F.col("power") * (1 - F.col("power")) / n_replicates).alias("power_se"), false.alias("false_positive_rate"), F.lit(n_replicates).cast("long").alias("n_replicates"), F.lit(alpha).alias("alpha"),
    )


def coarsest_level_with_power(ladder: DataFrame, effect_size: float, target_power: float = 0.8, semantics: str = "sum_then_ratio") -> DataFrame:
    """The last level, in measuring order, that still has the target power; null if none has."""
    rows = ladder.where((F.col("semantics") == semantics) & (F.col("effect_size") == effect_size) & (F.col("power") >= target_power))
    return rows.agg(F.max_by("level", "level_ordinal").alias("level"))
