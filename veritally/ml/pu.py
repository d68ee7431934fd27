"""Learning from positive and unlabelled rows, as estimators and models of ``pyspark.ml``.

``labelCol`` is 1 for labelled positives and 0 for the rest; features are a vector column and must be finite. Any classifier of ``pyspark.ml``
can be the base; without one it is a logistic regression. Which rows are held out or drawn depends on the seed and the row's id
alone, and their number is exact: the k rows with the smallest hash, whose last one is found by counts in narrowing ranges of
hashes. Estimators can be stages of a Pipeline, and estimators and models are saved and loaded with their bases.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import seeding
from ..core.columns import double, finite
from ..core.errors import AnalysisError, require
from ..core.order import smallest

#: Models whose raw prediction is a signed distance or a log-odds; others are scored by probability.
_MARGINS = ("LogisticRegressionModel", "LinearSVCModel", "GBTClassificationModel", "FMClassificationModel")


class _Writer(MLWriter):
    """Parameters and plain facts as metadata; nested estimators, models and tables in folders beside it."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        x = self.instance
        parts, facts = x._parts(), x._facts()
        names = {k: len(v) if isinstance(v, list) else 0 for k, v in parts.items() if v is not None}
        DefaultParamsWriter.saveMetadata(x, path, self.sparkSession, extraMetadata={"facts": facts, "parts": names})
        for name, part in parts.items():
            for i, one in enumerate(part if isinstance(part, list) else [] if part is None else [part]):
                if isinstance(one, DataFrame):
                    one.write.mode("overwrite").parquet(f"{path}/{name}-{i}")
                else:
                    one.write().overwrite().save(f"{path}/{name}-{i}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        for name, n in metadata["parts"].items():
            if name == "oob":
                found = self.sparkSession.read.parquet(f"{path}/{name}-0")
            else:
                found = [DefaultParamsReader.loadParamsInstance(f"{path}/{name}-{i}", self.sparkSession) for i in range(max(n, 1))]
                found = found if n else found[0]
            setattr(out, f"_{name}" if name == "base" else name, found)
        for name, value in metadata["facts"].items():
            setattr(out, name, value)
        return out


class _Shared(HasFeaturesCol, HasLabelCol, HasSeed, MLReadable, MLWritable):
    """Columns and persistence that all of them share."""

    idCol = Param(Params._dummy(), "idCol", "column with the id of a row", typeConverter=TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "column for the score", typeConverter=TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "column for the chance of being positive", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column for the prediction", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol="s", idCol="row_id", scoreCol="score", probabilityCol="pu_probability", predictionCol="pu_prediction", seed=0)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _parts(self) -> dict:
        return {}

    def _facts(self) -> dict:
        return {}

    def _of(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _rows(self, dataset: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        """(row_id, s, features), and the rows of each class; refused without both, or with missing values."""
        rows = dataset.select(F.col(self._of("idCol")).alias("row_id"), F.col(self._of("labelCol")).cast("int").alias("s"), F.col(self._of("featuresCol")).alias("features"))
        whole = F.coalesce(F.forall(vector_to_array("features"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        bad = ~F.coalesce(F.col("s").isin(0, 1), F.lit(False)) | ~whole
        facts = rows.agg(F.count_if(bad).alias("bad"), F.count_if(F.col("s") == 1).alias("p"), F.count_if(F.col("s") == 0).alias("u")).first()
        require(facts["bad"] == 0, "labels must be 0 or 1 and features finite")
        require(facts["p"] > 0 and facts["u"] > 0, "need labelled positives and unlabelled rows")
        return rows, {1: facts["p"], 0: facts["u"]}


class _Based(_Shared):
    """An estimator around another one."""

    def __init__(self):
        super().__init__()
        self._base: Estimator | None = None

    def setBase(self, base: Estimator | None):
        """The classifier that is fitted; None is a logistic regression with an L2 penalty of one on the sum of losses."""
        self._base = base
        return self

    def getBase(self) -> Estimator | None:
        return self._base

    def copy(self, extra=None):
        out = super().copy(extra)
        out._base = self._base.copy() if self._base is not None else None
        return out

    def _parts(self) -> dict:
        return {"base": self._base}

    def _fitted(self, rows: DataFrame, n: float, weight: str | None = None) -> Model:
        base = (self._base or LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-8)).copy()
        settings = {base.getParam("featuresCol"): "features", base.getParam("labelCol"): "s"}
        if weight:
            require(base.hasParam("weightCol"), f"{type(base).__name__} takes no weights")
            settings[base.getParam("weightCol")] = weight
        return base.fit(rows, settings)


def _scored(model: Model, rows: DataFrame, features: str, margin: bool) -> DataFrame:
    """``rows`` with g: the chance of being positive, or the margin of models that have one."""
    model = model.copy({model.getParam("featuresCol"): features})
    column = "rawPrediction" if margin and type(model).__name__ in _MARGINS else "probability"
    require(model.hasParam(f"{column}Col"), f"{type(model).__name__} gives no probability")
    out = model.transform(rows)
    return out.select(*rows.columns, vector_to_array(F.col(model.getOrDefault(model.getParam(f"{column}Col"))))[1].alias("g"))


class PUElkanNoto(Estimator, _Based):
    """Scale a classifier of the label by the chance c that a positive is labelled, from held-out positives."""

    holdOutRatio = Param(Params._dummy(), "holdOutRatio", "share of the labelled positives that is held out", typeConverter=TypeConverters.toFloat)
    holdOutUnlabeled = Param(Params._dummy(), "holdOutUnlabeled", "hold out the same share of the unlabelled", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="s", idCol="row_id", seed=0, holdOutRatio=0.2, holdOutUnlabeled=True):
        super().__init__()
        self._setDefault(holdOutRatio=0.2, holdOutUnlabeled=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PUElkanNotoModel:
        ratio, seed = self._of("holdOutRatio"), self._of("seed")
        require(0 < ratio < 1, f"holdOutRatio must lie in (0, 1); got {ratio}")
        rows, n = self._rows(dataset)
        require(n[1] >= 2, "need two labelled positives at least")
        u = seeding.uniform(seed, F.col("row_id"))
        held = F.lit(False)
        for s, m in ((1, n[1]), (0, n[0] if self._of("holdOutUnlabeled") else 0)):
            k = min(max(math.ceil(ratio * m), 1 if s else 0), m - 1)
            if k > 0:
                held |= (F.col("s") == s) & smallest(rows.where(F.col("s") == s), u, F.col("row_id"), k)
        placed = rows.withColumn("held", held)
        left = n[1] + n[0] - placed.where("held").count()
        model = self._fitted(placed.where("not held").select("s", "features"), left)
        facts = _scored(model, placed, "features", False).agg(F.avg(F.when(F.col("held") & (F.col("s") == 1), F.col("g"))).alias("c"), F.avg("g").alias("all")).first()
        require(facts["c"] is not None and facts["c"] > 0, "the held-out positives score zero")
        out = PUElkanNotoModel()._take(model, facts["c"], facts["all"] / facts["c"])
        return self._copyValues(out)


class PUElkanNotoModel(Model, _Shared):
    """c, the prior (clipped, and as it came out), and the classifier."""

    def __init__(self):
        super().__init__()
        self.classifier, self.c, self.prior, self.prior_unclipped = None, float("nan"), float("nan"), float("nan")

    def _take(self, classifier: Model, c: float, prior: float) -> PUElkanNotoModel:
        self.classifier, self.c, self.prior_unclipped, self.prior = classifier, float(c), float(prior), float(min(1.0, max(0.0, prior)))
        return self

    def _parts(self) -> dict:
        return {"classifier": self.classifier}

    def _facts(self) -> dict:
        return {"c": self.c, "prior": self.prior, "prior_unclipped": self.prior_unclipped}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds g / c, the same clipped to [0, 1], and whether that reaches one half."""
        out = _scored(self.classifier, dataset, self._of("featuresCol"), False)
        score, probability = self._of("scoreCol"), self._of("probabilityCol")
        out = out.withColumn(score, F.col("g") / self.c).drop("g").withColumn(probability, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score))))
        return out.withColumn(self._of("predictionCol"), (F.col(probability) >= 0.5).cast("double"))


class PUBagging(Estimator, _Based):
    """Rounds of all positives against k unlabelled draws; rows that weren't drawn give out-of-bag scores."""

    numEstimators = Param(Params._dummy(), "numEstimators", "rounds", typeConverter=TypeConverters.toInt)
    k = Param(Params._dummy(), "k", "unlabelled draws of a round; 0: as many as there are labelled positives", typeConverter=TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw with replacement", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="s", idCol="row_id", seed=0, numEstimators=50, k=0, bootstrap=True):
        super().__init__()
        self._setDefault(numEstimators=50, k=0, bootstrap=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PUBaggingModel:
        rounds, bootstrap, seed = self._of("numEstimators"), self._of("bootstrap"), self._of("seed")
        require(rounds >= 1, f"numEstimators must be positive; got {rounds}")
        rows, n = self._rows(dataset)
        k = self._of("k") or n[1]
        require(k >= 1 and (k < n[0] if bootstrap else k <= n[0]), f"k = {k} leaves none of the {n[0]} unlabelled rows out of a round")
        other, models, bags = rows.where("s = 0"), [], []
        for t in range(rounds):
            weights = draws(other, n[0], k, bootstrap, seed, t)
            bag = rows.join(weights, "row_id", "left").withColumn("w", F.when(F.col("s") == 1, 1.0).otherwise(F.col("w")))
            models.append(self._fitted(bag.where("w > 0").select("s", "features", "w"), n[1] + k, "w"))
            bags.append(_scored(models[-1], bag.where("s = 0 and w is null").select("row_id", "features"), "features", True).select("row_id", "g"))
        out = bags[0]
        for bag in bags[1:]:
            out = out.unionAll(bag)
        oob = rows.select("row_id", "s").join(out.groupBy("row_id").agg(F.avg("g").alias("oob_score"), F.count("*").alias("oob_count")), "row_id", "left")
        return self._copyValues(PUBaggingModel()._take(models, oob))


def draws(rows: DataFrame, n: int, k: int, bootstrap: bool, seed: int, t: int) -> DataFrame:
    """(row_id, w): exactly k draws from n rows, with or without replacement.

    With replacement: Poisson counts of a rate a little above k / n, of which k draws stay, chosen by a hash of their own. Given their number,
    Poisson counts are independent draws, and so is any part of them that is chosen without looking at the rows.
    """
    u = seeding.uniform(seed, t, F.col("row_id"))
    if not bootstrap:
        return rows.where(smallest(rows, u, F.col("row_id"), k)).select("row_id", F.lit(1.0).alias("w"))
    rate = (k + 8 * math.sqrt(k) + 20) / n
    steps, total, term = [], 0.0, math.exp(-rate)
    for i in range(int(rate + 12 * math.sqrt(rate) + 24)):
        total += term
        steps.append(total)
        term *= rate / (i + 1)
    count = sum((F.when(u >= x, 1).otherwise(0) for x in steps), F.lit(0))
    some = rows.select("row_id", count.alias("m")).where("m > 0").select("row_id", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("nth"))
    kept = some.where(smallest(some, seeding.uniform(seed, t, "kept", F.col("row_id"), F.col("nth")), F.struct("row_id", "nth"), k))
    return kept.groupBy("row_id").agg(F.count("*").cast("double").alias("w"))


class PUBaggingModel(Model, _Shared):
    """The classifiers of all rounds, and a table of out-of-bag scores (row_id, s, oob_score, oob_count)."""

    useOob = Param(Params._dummy(), "useOob", "take out-of-bag scores of known rows", typeConverter=TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(useOob=False)
        self.classifiers: list[Model] = []
        self.oob: DataFrame | None = None

    def _take(self, classifiers: list[Model], oob: DataFrame) -> PUBaggingModel:
        self.classifiers, self.oob = classifiers, oob
        return self

    def _parts(self) -> dict:
        return {"classifiers": self.classifiers, "oob": self.oob}

    def setUseOob(self, value: bool) -> PUBaggingModel:
        return self._set(useOob=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds the mean score of all rounds (margins, where the classifier has them), the mean chance, and whether that reaches one half."""
        out, features, n = dataset, self._of("featuresCol"), len(self.classifiers)
        for t, model in enumerate(self.classifiers):
            for kind, margin in (("m", True), ("p", False)):
                out = _scored(model, out, features, margin).withColumnRenamed("g", f"_{kind}{t}")
        mean = lambda kind: sum((F.col(f"_{kind}{t}") for t in range(n)), F.lit(0.0)) / n
        score = self._of("scoreCol")
        out = out.select(*dataset.columns, mean("m").alias(score), mean("p").alias(self._of("probabilityCol")))
        if self._of("useOob") and self.oob is not None:
            known = self.oob.where("oob_score is not null").select(F.col("row_id").alias("_row"), "oob_score")
            out = out.join(known, F.col(self._of("idCol")) == F.col("_row"), "left").withColumn(score, F.coalesce("oob_score", score)).drop("_row", "oob_score")
        return out.withColumn(self._of("predictionCol"), (F.col(self._of("probabilityCol")) >= 0.5).cast("double"))


def assembled(df: DataFrame, features: Sequence[str], row_id: str, s: str | None = None) -> DataFrame:
    """(row_id, s, features) from columns of numbers; missing values are refused when it is fitted."""
    label = [F.col(s).cast("int").alias("s")] if s else []
    number = lambda f: F.when(finite(double(f)), double(f)).otherwise(F.lit(float("nan")))
    rows = df.select(F.col(row_id).alias("row_id"), *label, *(number(f).alias(f"f{i}") for i, f in enumerate(features)))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features", handleInvalid="keep").transform(rows).select("row_id", *(["s"] if s else []), "features")


@dataclass
class ElkanNoto:
    """``PUElkanNoto`` on columns of numbers."""

    features: Sequence[str]
    hold_out_ratio: float = 0.2
    seed: int = 0
    hold_out_unlabeled: bool = True
    base: Estimator | None = None
    model: PUElkanNotoModel | None = field(default=None, init=False)

    @property
    def c(self) -> float:
        return self.model.c if self.model else float("nan")

    @property
    def prior(self) -> float:
        return self.model.prior if self.model else float("nan")

    def fit(self, df: DataFrame, s: str, row_id: str) -> ElkanNoto:
        made = PUElkanNoto(seed=self.seed, holdOutRatio=float(self.hold_out_ratio), holdOutUnlabeled=self.hold_out_unlabeled).setBase(self.base)
        self.model = made.fit(assembled(df, self.features, row_id, s))
        return self

    def score(self, df: DataFrame, row_id: str) -> DataFrame:
        """(row_id, score, probability, predicted)."""
        if self.model is None:
            raise AnalysisError("fit first")
        out = self.model.transform(assembled(df, self.features, row_id))
        return out.select("row_id", "score", F.col("pu_probability").alias("probability"), (F.col("pu_prediction") == 1).alias("predicted"))


@dataclass
class Bagging:
    """``PUBagging`` on columns of numbers."""

    features: Sequence[str]
    n_estimators: int = 50
    k: int | None = None
    seed: int = 0
    bootstrap: bool = True
    base: Estimator | None = None
    model: PUBaggingModel | None = field(default=None, init=False)

    @property
    def oob(self) -> DataFrame | None:
        return self.model.oob if self.model else None

    def fit(self, df: DataFrame, s: str, row_id: str) -> Bagging:
        made = PUBagging(seed=self.seed, numEstimators=self.n_estimators, k=self.k or 0, bootstrap=self.bootstrap).setBase(self.base)
        self.model = made.fit(assembled(df, self.features, row_id, s))
        return self

    def score(self, df: DataFrame, row_id: str, use_oob: bool = False) -> DataFrame:
        """(row_id, score, predicted): the mean of all rounds, or out-of-bag where there is any."""
        if self.model is None:
            raise AnalysisError("fit first")
        out = self.model.copy().setUseOob(use_oob).transform(assembled(df, self.features, row_id))
        return out.select("row_id", "score", (F.col("pu_prediction") == 1).alias("predicted"))


def class_prior(df: DataFrame, score: str, s: str, by: Sequence[str] = (), clip: bool = True) -> DataFrame:
    """Mean score of the unlabelled over that of the labelled."""
    x = double(score)
    mean = lambda v: F.avg(F.when(F.col(s) == v, x))
    raw = mean(0) / F.when(mean(1) > 0, mean(1))
    return df.groupBy(*by).agg((F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)) if clip else raw).alias("class_prior"))
