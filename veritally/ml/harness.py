"""Evaluate and transfer detectors.

A dataset is a table with unit_id (unique), y (0, 1 or null), feature columns, and optionally grp and
time. Folds are a column, so a detector without fitting is graded for all folds in one job.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.columns import on_keys
from ..core.errors import require
from ..core.graph import checkpointed
from ..core.order import running, value_bucket
from ..operators import ranking


METRICS = ("roc_auc", "average_precision", "precision", "recall", "ndcg")


@dataclass(frozen=True)
class EvalSpec:
    split: str = "group"  # temporal, group, anchor, or none: fitted and graded on the same labelled rows
    train_end: object = None
    n_splits: int = 5
    anchor: str = ""
    ks: tuple = (0.01, 0.05, 0.10)
    metrics: tuple = METRICS

    def __post_init__(self):
        require(self.split in ("temporal", "group", "anchor", "none"), f"unknown split {self.split!r}")
        require(bool(self.metrics) and set(self.metrics) <= set(METRICS), f"metrics must be some of {METRICS}; got {self.metrics}")
        require(self.split != "temporal" or self.train_end is not None, "a temporal split needs train_end")
        require(self.split != "anchor" or bool(self.anchor), "an anchor split needs a condition")
        require(self.n_splits >= 2, "n_splits must be at least 2")


def validate(df: DataFrame) -> None:
    facts = df.agg(F.count("*").alias("n"), F.countDistinct("unit_id").alias("ids"), F.count(F.when(F.col("y").isNotNull() & ~F.col("y").isin(0, 1), 1)).alias("bad")).first()
    require(facts["n"] == facts["ids"], "unit_id repeats or is null")
    require(facts["bad"] == 0, "y must be 0, 1 or null")


def _dealt(loads: list[int], size: int, count: int) -> list[tuple[int, list[int], int]]:
    """Where ``count`` groups of one size go, each to the fold that is lightest so far (the first of equals): (first rank, folds in turn, ranks).

    While the lightest folds are far below the rest they are filled in turn, whole rounds at once. ``loads`` is brought up to date.
    """
    out, rank = [], 0
    while rank < count:
        order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
        low = loads[order[0]]
        turn = [f for f in order if loads[f] < low + size]  # all get one before any of them gets another
        beyond = [loads[f] for f in order[len(turn) :]]
        top = loads[turn[-1]]
        # Whole rounds that end before a fold beyond becomes lighter than one in turn.
        rounds = max(1, (min(beyond) - top - 1) // size) if beyond else (count - rank) // len(turn) + 1
        ranks = min(count - rank, rounds * len(turn))
        out.append((rank, turn, ranks))
        for i, f in enumerate(turn):
            loads[f] += size * (ranks // len(turn) + (i < ranks % len(turn)))
        rank += ranks
    return out


def group_folds(df: DataFrame, n_splits: int) -> DataFrame:
    """(grp, fold): groups by size downwards, then by name, each to the fold that is lightest so far.

    Groups aren't collected: the driver deals out sizes, of which there are fewer than the root of twice the rows, and a group takes
    its fold by its rank among those of its size.
    """
    sizes = df.groupBy("grp").agg(F.count("*").alias("n")).where("grp is not null")
    classes = sizes.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.col("n").desc()).collect()
    total = sum(r["c"] for r in classes)
    require(total >= n_splits, f"{total} groups can't make {n_splits} folds")
    loads, runs = [0] * n_splits, []
    for r in classes:
        runs += [(r["n"], first, turn, ranks) for first, turn, ranks in _dealt(loads, r["n"], r["c"])]
    plan = df.sparkSession.createDataFrame(runs, "size long, first long, turn array<int>, ranks long")
    # A number in the order of the names: the first bytes of text, or the value itself.
    name = F.rpad(F.hex(F.encode(F.col("grp"), "UTF-8")), 12, "0") if dict(df.dtypes)["grp"] == "string" else None
    place = F.conv(F.substring(name, 1, 12), 16, 10).cast("double") if name is not None else F.col("grp").cast("double")
    rows = sizes.withColumn("_place", place)
    ranked = running(rows, ["n"], value_bucket(rows, "_place"), [F.col("grp")], {"nth": F.lit(1).cast("long")})
    met = ranked.join(plan, (F.col("n") == F.col("size")) & (F.col("nth") > F.col("first")) & (F.col("nth") <= F.col("first") + F.col("ranks")))
    # Of any rank, as a filter on the fold is worked out before the join's ranges.
    nth = F.pmod(F.col("nth") - 1 - F.col("first"), F.size("turn"))
    return met.select("grp", F.get("turn", nth.cast("int")).alias("fold"))


def folds(df: DataFrame, spec: EvalSpec) -> DataFrame:
    """The dataset with ``fold`` (where a row is tested; null if never).

    A temporal split tests what is later than ``train_end`` and refuses rows without a time. An anchor split tests the
    anchor rows and trains on all others. Both refuse an empty side. Without a split the labelled rows are tested.
    """
    if spec.split in ("temporal", "anchor"):
        if spec.split == "temporal":
            undated = df.where("time is null").limit(1).count()
            require(not undated, "rows without a time can't be split by time")
            tested = F.col("time") > F.lit(spec.train_end)
        else:
            tested = F.coalesce(F.expr(spec.anchor), F.lit(False))
        sides = df.agg(F.count(F.when(tested, 1)).alias("test"), F.count(F.when(~tested, 1)).alias("train")).first()
        require(sides["train"] > 0, f"the {spec.split} split leaves nothing to train on")
        require(sides["test"] > 0, f"the {spec.split} split leaves nothing to test on")
        return df.withColumn("fold", F.when(tested, 0))
    if spec.split == "none":
        return df.withColumn("fold", F.when(F.col("y").isNotNull(), 0))
    return df.join(group_folds(df, spec.n_splits), "grp", "left")


def training(df: DataFrame, fold: int, wants_unlabeled: bool, same: bool = False) -> DataFrame:
    """Rows to fit on: those not tested in this fold (``same``: those tested), and all unlabelled ones for detectors that want them."""
    tested = F.coalesce(F.col("fold") == fold, F.lit(False))
    other = tested if same else ~tested
    return df.where(other | F.col("y").isNull()) if wants_unlabeled else df.where(other)


def evaluate(detector, df: DataFrame, spec: EvalSpec) -> DataFrame:
    """A row for each fold, metric and k, and their unweighted means (fold null).

    Folds whose labelled test rows have one class only are left out. A detector that says ``fits = False`` scores the rows of all
    folds at once. What several plans read is checkpointed, as every use would otherwise repeat the plan of the folds.
    """
    validate(df)
    placed = folds(df, spec)

    def tested(fitted, test: DataFrame) -> DataFrame:
        return fitted.score(test).join(test.select("unit_id", "y", "fold"), "unit_id")

    if getattr(detector, "fits", True):
        placed, parts = checkpointed(placed), []
        for fold in [0] if spec.split != "group" else range(spec.n_splits):
            fitted = copy.copy(detector).fit(training(placed, fold, detector.wants_unlabeled, spec.split == "none"))
            parts.append(tested(fitted, placed.where((F.col("fold") == fold) & F.col("y").isNotNull())))
        scored = reduce(DataFrame.unionByName, parts)
    else:
        scored = tested(detector, placed.where("fold is not null and y is not null"))
    scored = checkpointed(scored)
    mixed = [r["fold"] for r in scored.groupBy("fold").agg(F.min("y").alias("low"), F.max("y").alias("high")).where("low < high").collect()]
    require(bool(mixed), "no fold has labelled test rows of both classes")
    scored = scored.where(F.col("fold").isin(mixed))
    arguments = ("y", "score", "unit_id")
    whole = ranking.roc_auc(scored, *arguments, by=["fold"]).select("fold", F.lit("roc_auc").alias("metric"), F.lit("all").alias("k"), F.col("roc_auc").alias("value"))
    precision = ranking.average_precision(scored, *arguments, by=["fold"]).select("fold", F.lit("average_precision").alias("metric"), F.lit("all").alias("k"), F.col("average_precision").alias("value"))
    at = ranking.at_k(scored, *arguments, list(spec.ks), by=["fold"])
    at = at.select("fold", "k", F.expr("stack(3, 'precision', `precision`, 'recall', recall, 'ndcg', ndcg) as (metric, value)")).select("fold", "metric", "k", "value")
    single = whole.union(precision).union(at).where(F.col("metric").isin(*spec.metrics))
    means = single.select(F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))).alias("fold"), "metric", "k", "value")  # a fold's own mean is its value
    return means.groupBy("fold", "metric", "k").agg(F.avg("value").alias("value"))


@dataclass
class Transfer:
    """Ranked scores of the target, calibration on the source, flagged shares of controls, and how the detector did at home, if asked."""

    scores: DataFrame
    calibration: DataFrame
    controls: DataFrame | None
    source_report: DataFrame | None = None
    n_source_fit: int = 0
    detector: object = None


def flagged_shares(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("control",)) -> DataFrame:
    """Share of each control's scores at or above every threshold.

    Thresholds and scores are put in one order and counted as they pass, bucket by bucket, so no score meets every
    threshold and no control is one task's work.
    """
    total = scores.groupBy(*by).agg(F.count("*").alias("n"))
    cuts = total.select(*by).join(F.broadcast(thresholds.select("threshold").distinct()), F.lit(True)).select(*by, F.col("threshold").alias("v"), F.lit(0).alias("is_score"))
    points = scores.select(*by, F.col("score").alias("v"), F.lit(1).alias("is_score")).union(cuts)
    counted = running(points, by, value_bucket(points, "v"), [F.col("v").desc(), F.col("is_score").desc()], {"above": F.col("is_score").cast("long")}, True)
    passed = counted.where("is_score = 0")
    return on_keys(passed, total, by).select(*by, F.col("v").alias("threshold"), (F.col("above") / F.col("n")).alias("flagged_share"))


def transfer(detector, source: DataFrame, target: DataFrame, controls: DataFrame | None = None, max_points: int = 100, source_spec: EvalSpec | None = None, fit_on: str = "auto") -> Transfer:
    """Fit on the source, rank the target, calibrate on the source, and score controls with the same detector.

    With ``source_spec`` the detector is first evaluated on folds of the source, so that the ranking goes with an out-of-sample record.
    ``fit_on``: "labeled" or "all" rows of the source, or "auto": what the detector wants, as in an evaluation. The calibration is
    in-sample; its thresholds are at most ``max_points`` rows.
    """
    require(fit_on in ("auto", "labeled", "all"), f"fit_on must be auto, labeled or all; got {fit_on!r}")
    validate(source)
    labelled = source.where("y is not null")
    require(not labelled.isEmpty(), "the source has no labelled rows")
    require(not target.isEmpty(), "the target is empty")
    report = evaluate(detector, source, source_spec) if source_spec is not None else None
    everything = fit_on == "all" or (fit_on == "auto" and detector.wants_unlabeled)
    rows = source if everything else labelled
    fitted = copy.copy(detector).fit(rows)  # fitting replaces parts of a detector, it doesn't change them
    found = fitted.score(target)
    scores = running(found, [], value_bucket(found, "score"), [F.col("score").desc(), F.col("unit_id")], {"rank": F.lit(1).cast("long")}, True)
    known = fitted.score(labelled).join(labelled.select("unit_id", "y"), "unit_id")
    calibration = ranking.calibration_curve(known, "y", "score", "unit_id", max_points=max_points)
    shares = None
    if controls is not None:
        scored = fitted.score(controls).join(controls.select("unit_id", "control"), "unit_id")
        shares = flagged_shares(scored, calibration)
    return Transfer(scores, calibration, shares, report, rows.count(), fitted)
