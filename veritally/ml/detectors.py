"""Detectors: a suspicion score for every unit of a table of values.

Each is a function of a table in long form (unit_id, value, ...) that gives (unit_id, score), higher
being more suspicious. Units are keys of one grouped job. A unit that is too short is refused, as a
score of nothing can't be ranked.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.columns import double, finite
from ..core.errors import AnalysisError, require
from ..operators import bunching, digits, dispersion, percent

Detector = Callable[..., DataFrame]
_REGISTRY: dict[str, Detector] = {}


def register(name: str) -> Callable[[Detector], Detector]:
    def keep(detector: Detector) -> Detector:
        require(name not in _REGISTRY, f"detector {name!r} is there already")
        _REGISTRY[name] = detector
        return detector

    return keep


def make(name: str) -> Detector:
    require(name in _REGISTRY, f"unknown detector {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def names() -> list[str]:
    return sorted(_REGISTRY)


def _scored(units: DataFrame, scores: DataFrame, unit: str, score: Column, min_len: int, value: str) -> DataFrame:
    """Join to all units; a unit without a score, or with too few values, is refused when evaluated."""
    sizes = units.groupBy(unit).agg(F.count(F.when(finite(double(value)), 1)).alias("_n"))
    found = sizes.join(scores.select(unit, score.cast("double").alias("score")), unit, "left")
    fine = (F.col("_n") >= min_len) & finite(F.col("score"))
    refuse = F.raise_error(F.concat(F.lit("can't score unit "), F.col(unit).cast("string"))).cast("double")
    return found.select(unit, F.when(fine, F.col("score")).otherwise(refuse).alias("score"))


@register("benford_first_two")
def benford_first_two(df: DataFrame, unit: str, value: str, min_len: int = 30) -> DataFrame:
    return _scored(df, digits.benford_test(df, value, [unit], "first_two"), unit, F.col("chi2"), min_len, value)


@register("terminal_digit")
def terminal_digit(df: DataFrame, unit: str, value: str, min_len: int = 30) -> DataFrame:
    whole = df.withColumn("_v", F.rint(double(value)))
    return _scored(df, digits.terminal_digit_test(whole, "_v", [unit]), unit, F.col("chi2"), min_len, value)


@register("integer_excess")
def integer_excess(df: DataFrame, unit: str, value: str, den: str, min_len: int = 50) -> DataFrame:
    """z against the exact null; the value is a numerator."""
    return _scored(df, percent.integer_excess_exact(df, value, den, [unit]), unit, F.col("z"), min_len, value)


@register("notch_bunching")
def notch_bunching(df: DataFrame, unit: str, value: str, threshold: float, window: bunching.Window, min_len: int = 200) -> DataFrame:
    return _scored(df, bunching.bunching_estimator(df, value, threshold, window, [unit]), unit, F.col("normalized_excess"), min_len, value)


@register("underdispersion")
def underdispersion(df: DataFrame, unit: str, value: str, min_len: int = 5) -> DataFrame:
    return _scored(df, dispersion.dispersion_index(df, value, [unit]), unit, -F.col("index"), min_len, value)


@register("too_smooth")
def too_smooth(df: DataFrame, unit: str, value: str, order: str, n_perm: int = 199, min_len: int = 8) -> DataFrame:
    return _scored(df, dispersion.too_smooth_test(df, value, [order], [unit], n_perm=n_perm), unit, -F.col("pvalue"), min_len, value)


class FunctionDetector:
    """Any function of a row's features as a detector without fitting: a column, SQL, or a callable.

    A callable gets the named columns as pandas Series, whole Arrow batches at a time, and gives the scores of their rows.
    """

    wants_unlabeled = fits = False

    def __init__(self, expression: Column | str | Callable[..., pd.Series], name: str = "function", higher_is_suspicious: bool = True, columns: list[str] | None = None):
        if callable(expression):
            require(bool(columns), "a callable needs the names of its columns")

            def apply(*parts: pd.Series) -> pd.Series:
                return pd.Series(expression(*parts), dtype="float64")

            self.expression = F.pandas_udf(apply, "double", F.PandasUDFType.SCALAR)(*(F.col(c) for c in columns))
        else:
            self.expression = F.expr(expression) if isinstance(expression, str) else expression
        self.name, self.sign = name, 1 if higher_is_suspicious else -1

    def fit(self, df: DataFrame) -> FunctionDetector:
        return self

    def score(self, df: DataFrame) -> DataFrame:
        score = (self.sign * self.expression).cast("double")
        refuse = F.raise_error(F.lit("a detector's score isn't a finite number")).cast("double")
        return df.select("unit_id", score.alias("score")).select("unit_id", F.when(finite(F.col("score")), F.col("score")).otherwise(refuse).alias("score"))


class UnitDetector:
    """Any function of all values of a unit as a detector without fitting, on a table in long form (unit_id, ...).

    The callable gets the named columns of one unit as pandas Series and gives its score; it is an aggregate of one job, so a
    unit's rows must fit a task. Units whose values can be counted or summed are better served by the registered detectors.
    """

    wants_unlabeled = fits = False

    def __init__(self, function: Callable[..., float], columns: list[str], name: str = "unit", higher_is_suspicious: bool = True, min_len: int = 1):
        require(bool(columns), "name the columns that the function gets")
        self.function, self.columns, self.name, self.min_len = function, columns, name, min_len
        self.sign = 1 if higher_is_suspicious else -1

    def fit(self, df: DataFrame) -> UnitDetector:
        return self

    def aggregate(self):
        """The function as a grouped aggregate, for ``agg`` and for SQL."""
        function, sign = self.function, self.sign

        def apply(*parts: pd.Series) -> float:
            return sign * float(function(*parts))

        return F.pandas_udf(apply, "double", F.PandasUDFType.GROUPED_AGG)

    def score(self, df: DataFrame) -> DataFrame:
        found = df.groupBy("unit_id").agg(self.aggregate()(*(F.col(c) for c in self.columns)).alias("score"))
        return _scored(df, found, "unit_id", F.col("score"), self.min_len, self.columns[0])


def register_sql(spark: SparkSession, detectors: list[UnitDetector]) -> None:
    """Make unit detectors aggregates of SQL under their names: ``SELECT unit_id, name(x) FROM t GROUP BY unit_id``."""
    for d in detectors:
        spark.udf.register(d.name, d.aggregate())


class ClassifierDetector:
    """Any supervised classifier of ``pyspark.ml`` on the labelled rows; without one a logistic regression with a unit L2 penalty."""

    wants_unlabeled = False

    def __init__(self, features: list[str], base=None, name: str = "classifier"):
        self.features, self.base, self.name, self.model = features, base, name, None

    def fit(self, df: DataFrame) -> ClassifierDetector:
        from .pu import PUElkanNoto, assembled

        rows, n = PUElkanNoto()._rows(assembled(df.where("y is not null"), self.features, "unit_id", "y"))
        self.model = PUElkanNoto().setBase(self.base)._fitted(rows, sum(n.values()))
        return self

    def score(self, df: DataFrame) -> DataFrame:
        from .pu import _scored as scored
        from .pu import assembled

        if self.model is None:
            raise AnalysisError("fit first")
        return scored(self.model, assembled(df, self.features, "unit_id"), "features", False).select(F.col("row_id").alias("unit_id"), F.col("g").alias("score"))


class LogisticDetector(ClassifierDetector):
    """A logistic regression on the labelled rows."""

    def __init__(self, features: list[str], name: str = "logistic"):
        super().__init__(features, None, name)


class PUDetector:
    """Known positives against everything else."""

    wants_unlabeled = True

    def __init__(self, features: list[str], kind: str = "elkan_noto", name: str | None = None, **options):
        require(kind in ("elkan_noto", "bagging"), f"unknown kind {kind!r}")
        self.features, self.kind, self.options, self.learner = features, kind, options, None
        self.name = name or kind

    def fit(self, df: DataFrame) -> PUDetector:
        from .pu import Bagging, ElkanNoto

        learner = (ElkanNoto if self.kind == "elkan_noto" else Bagging)(self.features, **self.options)
        self.learner = learner.fit(df.withColumn("_s", F.when(F.col("y") == 1, 1).otherwise(0)), "_s", "unit_id")
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if self.learner is None:
            raise AnalysisError("fit first")
        return self.learner.score(df, "unit_id").select(F.col("row_id").alias("unit_id"), "score")
