"""Rank metrics of scored, labelled rows, for each key at once.

Rows are ranked by descending score; equal scores keep the order of ``row_id``. Labels and scores
must not be missing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import seeding
from ..core.columns import double, finite
from ..core.errors import require
from ..core.order import running, value_bucket


#: Where the Poisson distribution of mean one reaches 1, 2, ... counts.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(11)]


def resolve_k(k: int | float, n: Column) -> Column:
    """A count, or a fraction of n rounded up, one at least."""
    require(not isinstance(k, bool) and (isinstance(k, int) or 0 < k < 1), f"k must be a count or a fraction below 1; got {k!r}")
    require(k > 0, f"k must be positive; got {k!r}")
    return F.lit(k).cast("long") if isinstance(k, int) else F.greatest(F.lit(1), F.ceil(F.lit(k) * n)).cast("long")


def scored(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = ()) -> DataFrame:
    y, s = double(label), double(score)
    refuse = F.raise_error(F.lit("labels and scores must be finite")).cast("double")
    return df.select(*by, F.col(row_id).alias("row_id"), F.when(finite(y), y).otherwise(refuse).alias("y"), F.when(finite(s), s).otherwise(refuse).alias("s"))


def ranked(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Keys, row_id, y, s, rank (1 for the highest score) and n."""
    rows = scored(df, label, score, row_id, by)
    one = F.lit(1).cast("long")
    return running(rows, by, value_bucket(rows, "s"), [F.col("s").desc(), F.col("row_id")], {"rank": one}, True, {"rank": "n"})


def _by_score(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str]) -> DataFrame:
    """Distinct scores with their rows and positives, and running totals from the highest down."""
    cells = scored(df, label, score, row_id, by).groupBy(*by, "s").agg(F.count("*").alias("m"), F.sum((F.col("y") > 0).cast("long")).alias("pos"))
    return running(cells, by, value_bucket(cells, "s"), [F.col("s").desc()], {"selected": F.col("m"), "hits": F.col("pos")}, True)


def roc_auc(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null with one class only."""
    cells = _by_score(df, label, score, row_id, by)
    negative = F.col("m") - F.col("pos")
    above = F.col("hits") - F.col("pos")
    wins = F.sum(negative * (above + F.col("pos") / 2.0))
    pairs = F.sum("pos") * F.sum(negative)
    return cells.groupBy(*by).agg((wins / F.when(pairs > 0, pairs)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision at each distinct score, weighted by the recall gained there."""
    cells = _by_score(df, label, score, row_id, by)
    return cells.groupBy(*by).agg((F.sum(F.col("pos") * F.col("hits") / F.col("selected")) / F.when(F.sum("pos") > 0, F.sum("pos"))).alias("average_precision"))


def at_k(df: DataFrame, label: str, score: str, row_id: str, ks: Sequence[int | float], by: Sequence[str] = (), gains: str = "binary") -> DataFrame:
    """A row for each key and k: precision (of k), recall and normalised discounted gain.

    A count larger than the number of rows is refused; without positives recall and gain are null.
    """
    require(gains in ("binary", "exponential"), f"unknown gains {gains!r}")
    rows = ranked(df, label, score, row_id, by)
    rows = rows.withColumn("g", F.pow(F.lit(2.0), F.col("y")) - 1 if gains == "exponential" else F.col("y"))
    rows = running(rows, by, value_bucket(rows, "g"), [F.col("g").desc(), F.col("row_id")], {"best": F.lit(1).cast("long")}, True)
    parts = []
    for k in ks:
        cut = resolve_k(k, F.col("n"))
        checked = F.when(cut <= F.col("n"), cut).otherwise(F.raise_error(F.lit(f"k = {k} exceeds the number of rows")).cast("long"))
        parts.append(F.struct(F.lit(k if isinstance(k, int) else f"{100 * k:g}%").cast("string").alias("k"), checked.alias("cut")))
    long = rows.select("*", F.explode(F.array(*parts)).alias("_")).select("*", "_.k", "_.cut")
    top, ideal, hit = F.col("rank") <= F.col("cut"), F.col("best") <= F.col("cut"), (F.col("y") > 0).cast("long")
    gain = lambda inside, place: F.sum(F.when(inside, F.col("g") / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    hits, best = F.sum(F.when(top, hit).otherwise(0)), gain(ideal, "best")
    return long.groupBy(*by, "k").agg(
        F.max("cut").alias("cut"), (hits / F.max("cut")).alias("precision"), (hits / F.when(F.sum(hit) > 0, F.sum(hit))).alias("recall"), (gain(top, "rank") / F.when(best > 0, best)).alias("ndcg")
    )


def calibration_curve(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = (), max_points: int = 100) -> DataFrame:
    """Precision, recall and selected rows at distinct scores, thinned evenly, ascending by threshold."""
    cells = _by_score(df, label, score, row_id, by)
    one, positives = F.lit(1).cast("long"), F.col("pos")
    points = running(cells, by, value_bucket(cells, "s"), [F.col("s").desc()], {"nth": one, "_pos": positives}, True, {"nth": "distinct_scores", "_pos": "all_pos"}).withColumn("at", F.col("nth") - 1)
    last = F.col("distinct_scores") - 1
    steps = F.transform(F.sequence(F.lit(0), F.lit(max_points - 1)), lambda i: F.rint(i * last / F.lit(float(max_points - 1))).cast("long"))
    kept = points.where((F.col("distinct_scores") <= max_points) | F.array_contains(steps, F.col("at").cast("long")))
    return kept.select(*by, F.col("s").alias("threshold"), (F.col("hits") / F.col("selected")).alias("precision"), (F.col("hits") / F.when(F.col("all_pos") > 0, F.col("all_pos"))).alias("recall"), F.col("selected").alias("n_selected"))


def poisson_auc_draws(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = (), n_boot: int = 499, seed: int = 0) -> DataFrame:
    """(keys, replicate, draw): the area under the curve by Poisson resampling within each class; null where a class is empty.

    A row's count in a replicate depends on (seed, replicate, row_id) alone, so nothing is joined or indexed, and SQL can
    check every draw. ``bootstrap.metric_draws`` costs cells instead of rows.
    """
    rows = scored(df, label, score, row_id, by).select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("replicate"))
    u = seeding.uniform(seed, F.col("replicate"), F.col("row_id"))
    count = sum((F.when(u >= t, 1).otherwise(0) for t in POISSON_STEPS), F.lit(0))
    cells = rows.withColumn("c", count).where("c > 0").groupBy(*by, "replicate", "s").agg(F.sum("c").alias("m"), F.sum(F.when(F.col("y") > 0, F.col("c")).otherwise(0)).alias("pos"))
    down = W.partitionBy(*by, "replicate").orderBy(F.col("s").desc())
    cells = cells.select("*", (F.sum("pos").over(down) - F.col("pos")).alias("above"), (F.col("m") - F.col("pos")).alias("neg"))
    pairs = F.sum("pos") * F.sum("neg")
    return cells.groupBy(*by, "replicate").agg((F.sum(F.col("neg") * (F.col("above") + F.col("pos") / 2.0)) / F.when(pairs > 0, pairs)).alias("draw"))


def bootstrap_auc(df: DataFrame, label: str, score: str, row_id: str, by: Sequence[str] = (), n_boot: int = 499, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the area under the curve over Poisson draws; replicates in which a class is empty are counted as failed."""
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}")
    draws = poisson_auc_draws(df, label, score, row_id, by, n_boot, seed)
    return draws.groupBy(*by).agg(
        F.expr(f"percentile(draw, {alpha / 2})").alias("low"), F.expr(f"percentile(draw, {1 - alpha / 2})").alias("high"), F.stddev_samp("draw").alias("se"),
        (F.lit(n_boot) - F.count("draw")).alias("n_failed"),
    )
