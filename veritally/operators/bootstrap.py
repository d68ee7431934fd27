"""Bootstrap draws as a table, what is said of them, and resampling of rank metrics by cells.

A draws table has keys, ``replicate`` and ``draw`` (null where the statistic doesn't exist in a replicate). It is kept, joined to
the estimate of its keys and summed up; nothing is gathered in the driver.

``metric_draws`` resamples (label, score) pairs with replacement without touching rows: the counts of distinct (score, label) cells are
a multinomial draw, and that is made in two exact steps. First the rows of a replicate are shared out among ``BUCKETS`` buckets
of scores, then within each bucket among its cells. The first step depends on (seed, keys, replicate) alone, so every bucket can repeat it and
knows how many rows and positives stand above it. So a replicate costs cells, not rows, each bucket of each key is a task's work of bounded
size, and only a few sums for each (key, replicate, bucket) are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.columns import on_keys
from ..core.errors import require
from ..core.order import value_bucket
from .ranking import scored

METRICS = ("roc_auc", "average_precision", "precision", "recall", "ndcg")
#: Buckets at least and at most, and distinct scores of one in the mean where their number allows it.
BUCKETS, MOST_BUCKETS, BUCKET_SCORES = 8, 4096, 50_000
_SCHEMA = "replicate int, a double, b double, positives long, negatives long"


def summary(draws: DataFrame, estimate: DataFrame, point: str, by: Sequence[str] = (), alpha: float = 0.05, method: str = "pairs") -> DataFrame:
    """For each key: point, se, percentile interval, bias (mean of the draws less the point), n_boot, n_failed and method.

    ``estimate`` has the keys and the column ``point``. With fewer than two draws there is no interval (nulls).
    """
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}")
    x = F.when(~F.isnan("draw"), F.col("draw"))
    two = lambda c: F.when(F.count(x) >= 2, c)
    found = draws.groupBy(*by).agg(
        two(F.stddev_samp(x)).alias("se"), two(F.percentile(x, F.lit(alpha / 2))).alias("ci_low"), two(F.percentile(x, F.lit(1 - alpha / 2))).alias("ci_high"), F.avg(x).alias("mean"),
        F.count("*").alias("n_boot"), (F.count("*") - F.count(x)).alias("n_failed"),
    )
    out = on_keys(estimate.select(*by, F.col(point).cast("double").alias("point")), found, by)
    return out.select(*by, "point", "se", "ci_low", "ci_high", (F.col("mean") - F.col("point")).alias("bias"), "n_boot", "n_failed", F.lit(method).alias("method"), F.lit(alpha).alias("alpha"))


def covers(value: Column | float) -> Column:
    """Whether the interval of a summary holds the value."""
    v = value if isinstance(value, Column) else F.lit(float(value))
    return (F.col("ci_low") <= v) & (v <= F.col("ci_high"))


def to_test_result(summaries: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """As records of tests: the point is the statistic, there is no p-value, and the rest are details."""
    details = F.struct("se", "ci_low", "ci_high", F.col("method").alias("bootstrap_method"), "n_boot")
    return summaries.select(*by, F.lit(name).alias("method"), F.col("point").alias("statistic"), F.lit(None).cast("double").alias("pvalue"), F.col("n_boot").alias("n"), details.alias("details"))


def _generator(*key) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=int(pd.util.hash_array(np.array([repr(key)], object))[0])))


def _shared(generator: np.random.Generator, positives: np.ndarray, negatives: np.ndarray, stratified: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positives and negatives of a replicate in each bucket."""
    p, n = positives.sum(), negatives.sum()
    if stratified:
        return generator.multinomial(p, positives / max(p, 1)), generator.multinomial(n, negatives / max(n, 1))
    both = np.concatenate([positives, negatives])
    drawn = generator.multinomial(p + n, both / both.sum())
    return drawn[: len(positives)], drawn[len(positives) :]


def _top(generator, k: int, selected: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Positives of each cell among the first k rows; of a cell cut by k a random part, as equal scores have no order."""
    size = pos + neg
    inside = np.clip(k - (selected - size), 0, size)
    out = np.where(inside == size, pos, 0)
    for i in np.flatnonzero((inside > 0) & (inside < size)):
        out[i] = generator.hypergeometric(int(pos[i]), int(neg[i]), int(inside[i]))
    return out


def _discounts(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of 1 / log2(place + 1) over ``size`` places from ``first`` (counted from 1) on."""
    return np.array([float((1 / np.log2(np.arange(f, f + n) + 1.0)).sum()) for f, n in zip(first.tolist(), size.tolist(), strict=True)])


class _Bucket:
    """Cogrouped applyInPandas function: cells (s, pos, neg) of one bucket, and the totals of all buckets, to sums for each replicate."""

    def __init__(self, metric: str, k, by: Sequence[str], n_boot: int, seed: int, stratified: bool):
        self.metric, self.k, self.by, self.n_boot, self.seed, self.stratified = metric, k, list(by), n_boot, seed, stratified

    def __call__(self, frame: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("s", ascending=False)
        keys = [str(frame[c].iloc[0]) for c in self.by]
        at = int(frame["bucket"].iloc[0])
        numbers, all_pos, all_neg = (np.asarray(totals[c].iloc[0], np.int64) for c in ("buckets", "all_pos", "all_neg"))
        order = np.argsort(-numbers)  # the highest scores first
        numbers, all_pos, all_neg = numbers[order], all_pos[order], all_neg[order]
        own = int(np.flatnonzero(numbers == at)[0])
        pos, neg = frame["pos"].to_numpy(np.int64), frame["neg"].to_numpy(np.int64)
        rows = []
        for r in range(1, self.n_boot + 1):
            p, n = _shared(_generator(self.seed, keys, r), all_pos, all_neg, self.stratified)
            inner = _generator(self.seed, keys, r, at)
            drawn_pos = inner.multinomial(p[own], pos / max(pos.sum(), 1)) if p[own] else np.zeros_like(pos)
            drawn_neg = inner.multinomial(n[own], neg / max(neg.sum(), 1)) if n[own] else np.zeros_like(neg)
            hits = p[:own].sum() + np.cumsum(drawn_pos)
            selected = p[:own].sum() + n[:own].sum() + np.cumsum(drawn_pos + drawn_neg)
            rows.append((r, *self._sums(inner, hits, selected, drawn_pos, drawn_neg, int(p.sum()), int(n.sum())), int(p.sum()), int(n.sum())))
        out = pd.DataFrame(rows, columns=["replicate", "a", "b", "positives", "negatives"])
        for i, c in enumerate(self.by):
            out.insert(i, c, frame[c].iloc[0])
        return out

    def _sums(self, generator, hits, selected, pos, neg, positives: int, negatives: int) -> tuple[float, float]:
        if self.metric == "roc_auc":
            return float((neg * (hits - pos + pos / 2)).sum()), 0.0
        if self.metric == "average_precision":
            return float((pos * hits / np.maximum(selected, 1)).sum()), 0.0
        total = positives + negatives
        k = self.k if isinstance(self.k, int) else max(1, int(np.ceil(self.k * total)))
        if self.metric in ("precision", "recall"):
            return float(_top(generator, k, selected, pos, neg).sum()), float(k)
        size = pos + neg
        live = (size > 0) & (selected - size < k)
        first, inside = (selected - size + 1)[live], np.minimum(size, k - (selected - size))[live]
        return float((pos[live] / size[live] * _discounts(first, inside)).sum()), float(min(k, positives))


def metric_draws(df: DataFrame, label: str, score: str, row_id: str, metric: str = "roc_auc", k: int | float | None = None, by: Sequence[str] = (), n_boot: int = 499, seed: int = 0, stratified: bool = False) -> DataFrame:
    """(keys, replicate, draw) of a metric over resampled pairs; rows of equal scores count in the mean over their orders, but for
    precision and recall, where a cut through them takes a random part.

    ``k`` (a count, or a fraction of the rows) is for precision, recall and ndcg. Labels above zero are positive. Stratified: each
    class keeps its number of rows. Where a replicate has no positive, or for the area no negative, its draw is null.
    """
    require(metric in METRICS, f"unknown metric {metric!r}")
    require((k is None) == (metric in METRICS[:2]), "precision, recall and ndcg need a k, and only they")
    require(k is None or (not isinstance(k, bool) and (isinstance(k, int) and k > 0 or isinstance(k, float) and 0 < k < 1)), f"k must be a count or a fraction below 1; got {k!r}")
    require(n_boot >= 2, f"n_boot must be at least 2; got {n_boot}")
    cells = scored(df, label, score, row_id, by).groupBy(*by, "s").agg(F.count_if(F.col("y") > 0).alias("pos"), F.count_if(~(F.col("y") > 0)).alias("neg"))
    buckets = min(MOST_BUCKETS, max(BUCKETS, cells.count() // BUCKET_SCORES))
    cells = cells.withColumn("bucket", value_bucket(cells, "s", buckets))
    per = cells.groupBy(*by, "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    each = per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "p", "n"))).alias("t"))  # at most MOST_BUCKETS entries
    mine = [F.col(c).alias(f"_key{i}") for i, c in enumerate(by)]  # other names than the cells', which come from the same rows
    totals = each.select(*mine, F.explode("t.bucket").alias("_bucket"), F.col("t.bucket").alias("buckets"), F.col("t.p").alias("all_pos"), F.col("t.n").alias("all_neg"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.schema if f.name in by)
    make = _Bucket(metric, k, by, n_boot, seed, stratified)

    def one(cell: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
        return make(cell, total)

    parts = cells.groupBy(*by, "bucket").cogroup(totals.groupBy(*(f"_key{i}" for i in range(len(by))), "_bucket")).applyInPandas(one, kinds + _SCHEMA)
    sums = parts.groupBy(*by, "replicate").agg(F.sum("a").alias("a"), F.max("b").alias("b"), F.max("positives").alias("p"), F.max("negatives").alias("n"))
    positive = F.when(F.col("p") > 0, F.col("p"))
    if metric == "roc_auc":
        draw = F.col("a") / (positive * F.when(F.col("n") > 0, F.col("n")))
    elif metric == "precision":
        draw = F.when(F.col("b") <= F.col("p") + F.col("n"), F.col("a") / F.col("b"))
    elif metric == "ndcg":
        best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("b").cast("int"))), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1.0))
        draw = F.when(F.col("b") > 0, F.col("a") / best)
    else:
        draw = F.col("a") / positive
    return sums.select(*by, "replicate", draw.alias("draw"))
