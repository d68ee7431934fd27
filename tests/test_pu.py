"""Learners from positive and unlabelled rows as stages of pipelines."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veritally.core import seeding
from veritally.core.errors import AnalysisError
from veritally.core.order import smallest
from veritally.ml import detectors, harness, pu


@pytest.fixture(scope="module")
def rows(spark):
    """Positives around (2, 2), of which four in ten are labelled, and negatives around (-1, -1)."""
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.4).astype(int)
    x = rng.normal(size=(600, 2)) + np.where(y[:, None] == 1, 2.0, -1.0)
    s = y * (rng.random(600) < 0.4)
    return spark.createDataFrame([(i, float(a), float(b), int(t), int(v)) for i, ((a, b), t, v) in enumerate(zip(x, s, y, strict=True))], "row_id long, a double, b double, s int, y int").cache()


@pytest.fixture(scope="module")
def vectors(rows):
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)


def test_smallest_is_exact(spark):
    df = spark.range(5000)
    u = seeding.uniform(3, F.col("id"))
    order = [r.id for r in df.orderBy(u, "id").collect()]
    for k in (1, 17, 2500, 4999, 5000, 6000):
        assert {r.id for r in df.where(smallest(df, u, F.col("id"), k)).collect()} == set(order[:k])
    import veritally.core.order as o

    old, o._FEW = o._FEW, 3
    try:
        assert {r.id for r in df.where(smallest(df, u, F.col("id"), 1234)).collect()} == set(order[:1234])
    finally:
        o._FEW = old
    hot = df.select(F.lit(7).cast("long").alias("id")).union(df.where("id < 10"))
    assert hot.where(smallest(hot, u, F.col("id"), 3)).count() >= 3


@pytest.mark.parametrize("bootstrap", [True, False])
def test_draws_are_exact_and_even(rows, bootstrap):
    other = rows.where("s = 0").select("row_id")
    n, seen = other.count(), {}
    for t in range(12):
        got = {r.row_id: r.w for r in pu.draws(other, n, 60, bootstrap, 5, t).collect()}
        assert sum(got.values()) == 60 and (bootstrap or set(got.values()) == {1.0})
        for i, w in got.items():
            seen[i] = seen.get(i, 0) + w
    assert max(seen.values()) <= 9 and len(seen) > 0.6 * n  # 720 draws over some 500 rows


def test_elkan_noto_recovers_the_labelling_chance(rows, vectors, tmp_path, spark):
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), pu.PUElkanNoto(seed=2)])
    model = pipe.fit(rows)
    last = model.stages[-1]
    assert 0.25 < last.c < 0.55 and 0.3 < last.prior < 0.55 and last.prior_unclipped == pytest.approx(last.prior)
    scored = model.transform(rows)
    right = scored.where("(pu_prediction = 1) = (y = 1)").count()
    assert right > 0.9 * 600 and set(rows.columns) < set(scored.columns)
    pipe.write().overwrite().save(f"{tmp_path}/pipe")
    model.write().overwrite().save(f"{tmp_path}/model")
    again, refit = PipelineModel.load(f"{tmp_path}/model"), Pipeline.load(f"{tmp_path}/pipe").fit(rows)
    want = [r.score for r in scored.orderBy("row_id").collect()]
    for m in (again, refit):
        assert [r.score for r in m.transform(rows).orderBy("row_id").collect()] == pytest.approx(want) and m.stages[-1].c == pytest.approx(last.c)
    held = smallest(rows.where("s = 1"), seeding.uniform(2, F.col("row_id")), F.col("row_id"), 3)
    assert rows.where("s = 1").where(held).count() == 3


def test_bagging_with_any_base(vectors, tmp_path, spark):
    tree = DecisionTreeClassifier(maxDepth=3)
    made = pu.PUBagging(seed=1, numEstimators=4, k=80).setBase(tree)
    model = made.fit(vectors)
    assert tree.getLabelCol() == "label" and len(model.classifiers) == 4  # the base itself isn't changed
    assert all(type(c).__name__ == "DecisionTreeClassificationModel" for c in model.classifiers)
    oob = model.oob.cache()
    assert oob.count() == 600 and oob.where("s = 1 and oob_score is not null").count() == 0 and oob.agg(F.max("oob_count")).first()[0] <= 4
    scored = model.transform(vectors)
    assert scored.where("(pu_prediction = 1) = (y = 1)").count() > 0.85 * 600
    model.write().overwrite().save(f"{tmp_path}/bag")
    made.write().overwrite().save(f"{tmp_path}/est")
    again = pu.PUBaggingModel.load(f"{tmp_path}/bag")
    a, b = ([r.score for r in m.setUseOob(True).transform(vectors).orderBy("row_id").collect()] for m in (model, again))
    assert a == pytest.approx(b) and a != pytest.approx([r.score for r in scored.orderBy("row_id").collect()])
    loaded = pu.PUBagging.load(f"{tmp_path}/est")
    assert type(loaded.getBase()).__name__ == "DecisionTreeClassifier" and loaded.getBase().getMaxDepth() == 3 and loaded.getOrDefault("k") == 80
    assert [r.score for r in loaded.fit(vectors).transform(vectors).orderBy("row_id").collect()] == pytest.approx([r.score for r in scored.orderBy("row_id").collect()])


def test_margins_of_models_that_have_them(vectors):
    model = pu.PUBagging(numEstimators=2, k=50, bootstrap=False).fit(vectors)
    r = model.transform(vectors).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.min("pu_probability").alias("p"), F.max("pu_probability").alias("q")).first()
    assert r.low < 0 and r.high > 1 and 0 <= r.p <= r.q <= 1


def test_refusals(spark, vectors):
    for bad in (vectors.where("s = 1"), vectors.where("s = 0"), vectors.withColumn("s", F.lit(2))):
        with pytest.raises(AnalysisError):
            pu.PUElkanNoto().fit(bad)
    with pytest.raises(AnalysisError):
        pu.PUElkanNoto(holdOutRatio=1.0).fit(vectors)
    for options in ({"k": 10_000}, {"k": 10_000, "bootstrap": False}, {"numEstimators": 0}):
        with pytest.raises(AnalysisError):
            pu.PUBagging(**options).fit(vectors)
    missing = spark.createDataFrame([(1, 1, 1.0), (2, 0, None), (3, 0, 2.0)], "row_id long, s int, a double")
    with pytest.raises(AnalysisError):
        pu.ElkanNoto(["a"]).fit(missing, "s", "row_id")
    with pytest.raises(AnalysisError):
        pu.Bagging(["a"]).score(missing, "row_id")


@pytest.mark.parametrize("kind", ["elkan_noto", "bagging"])
def test_detectors_that_learn(rows, kind):
    """Both learn the classes; a PU detector also sees rows without a label."""
    table = rows.select(F.col("row_id").alias("unit_id"), "a", "b", F.when(F.col("row_id") % 3 > 0, F.col("y")).alias("y"), (F.col("row_id") % 10).alias("grp"))
    options = {} if kind == "elkan_noto" else {"n_estimators": 3}
    for detector in (detectors.PUDetector(["a", "b"], kind, **options), detectors.LogisticDetector(["a", "b"])):
        found = harness.evaluate(detector, table, harness.EvalSpec("group", n_splits=2, ks=(0.1,), metrics=("roc_auc",))).where("fold is null").first()
        assert found.value > 0.95
    with pytest.raises(AnalysisError):
        detectors.LogisticDetector(["a"]).score(table)
    with pytest.raises(AnalysisError):
        detectors.PUDetector(["a"], "svm")
    assert LogisticRegression().getLabelCol() == "label"
