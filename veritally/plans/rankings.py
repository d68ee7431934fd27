"""Rank-metric and learning queries: labels against text length."""

from pyspark.sql import functions as F

from ..core import seeding
from ..ml import detectors, harness, pu
from ..operators import bootstrap, ranking
from .registry import load, query, r6, shown


def _scored(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    return docs.join(load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


_ROWS = "x AS (SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS s, quality AS y, source, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_CELLS = f"""{_ROWS}, c AS (SELECT s, count(*) AS m, sum(y) AS pos FROM x GROUP BY s),
t AS (SELECT s, m, pos, sum(m) OVER (ORDER BY s DESC) AS selected, sum(pos) OVER (ORDER BY s DESC) AS hits FROM c)"""


@query(f"WITH {_CELLS} SELECT {r6('sum((m - pos) * (hits - pos + pos / 2.0)) / (sum(pos) * sum(m - pos))')} AS roc_auc FROM t")
def rank_auc(spark, sf_dir):
    return shown(ranking.roc_auc(_scored(spark, sf_dir), "quality", "n_chars", "doc_id"))


@query(f"WITH {_CELLS} SELECT {r6('sum(pos * hits / selected) / sum(pos)')} AS average_precision FROM t")
def rank_ap(spark, sf_dir):
    return shown(ranking.average_precision(_scored(spark, sf_dir), "quality", "n_chars", "doc_id"))


@query(f"""WITH {_ROWS}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS a, row_number() OVER (ORDER BY y DESC, doc_id) AS b, count(*) OVER () AS n FROM x),
k AS (SELECT '10' AS k, 10 AS cut UNION ALL SELECT '5%', (SELECT CAST(greatest(1, ceil(0.05 * max(n))) AS BIGINT) FROM r))
SELECT k, CAST(cut AS BIGINT) AS cut, {r6("sum(CASE WHEN a <= cut THEN y ELSE 0 END) / cut")} AS "precision", {r6("sum(CASE WHEN a <= cut THEN y ELSE 0 END) / sum(y)")} AS recall,
       {r6("sum(CASE WHEN a <= cut THEN y / log2(a + 1.0) ELSE 0 END) / sum(CASE WHEN b <= cut THEN y / log2(b + 1.0) ELSE 0 END)")} AS ndcg
FROM r CROSS JOIN k GROUP BY k, cut""")
def metrics_at_k(spark, sf_dir):
    return shown(ranking.at_k(_scored(spark, sf_dir), "quality", "n_chars", "doc_id", [10, 0.05]))


@query(f"""WITH {_CELLS}, p AS (SELECT *, row_number() OVER (ORDER BY s DESC) - 1 AS place, count(*) OVER () AS k, sum(pos) OVER () AS all_pos FROM t)
SELECT {r6("s")} AS threshold, {r6("hits / selected")} AS "precision", {r6("hits / all_pos")} AS recall, CAST(selected AS BIGINT) AS n_selected FROM p
WHERE k <= 100 OR place IN (SELECT CAST(round_even(i * (k - 1) / 99.0, 0) AS BIGINT) FROM range(0, 100) z(i))""")
def calibration_curve(spark, sf_dir):
    return shown(ranking.calibration_curve(_scored(spark, sf_dir), "quality", "n_chars", "doc_id"))


def _draws(key: str, n_boot: int) -> str:
    """Every row's Poisson count in every replicate, and the area of each replicate of each key."""
    count = " + ".join(f"CASE WHEN u >= {t!r} THEN 1 ELSE 0 END" for t in ranking.POISSON_STEPS)
    return f"""{_ROWS}, u AS (SELECT {key} AS k, s, y, r, {seeding.uniform_sql("'0'", "r", "doc_id")} AS u FROM x CROSS JOIN range(1, {n_boot + 1}) t(r)),
c AS (SELECT k, r, s, sum({count}) AS m, sum(CASE WHEN y > 0 THEN {count} ELSE 0 END) AS pos FROM u GROUP BY k, r, s),
h AS (SELECT *, sum(pos) OVER (PARTITION BY k, r ORDER BY s DESC) - pos AS above FROM c),
d AS (SELECT k, r, sum((m - pos) * (above + pos / 2.0)) / nullif(sum(pos) * sum(m - pos), 0) AS draw FROM h GROUP BY k, r)"""


@query(f"WITH {_draws('0', 499)} SELECT {r6('quantile_cont(draw, 0.025)')} AS low, {r6('quantile_cont(draw, 0.975)')} AS high, {r6('stddev_samp(draw)')} AS se, CAST(499 - count(draw) AS BIGINT) AS n_failed FROM d")
def metric_bootstrap(spark, sf_dir):
    return shown(ranking.bootstrap_auc(_scored(spark, sf_dir), "quality", "n_chars", "doc_id"))


@query(f"""WITH {_draws("lang", 99)}, z AS (SELECT lang AS k, s, count(*) AS m, sum(y) AS pos FROM x GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER (PARTITION BY k ORDER BY s DESC) - pos AS above FROM z),
p AS (SELECT k, sum((m - pos) * (above + pos / 2.0)) / nullif(sum(pos) * sum(m - pos), 0) AS point FROM w GROUP BY k),
q AS (SELECT p.k, max(point) AS point, stddev_samp(draw) AS se, quantile_cont(draw, 0.05) AS low, quantile_cont(draw, 0.95) AS high, avg(draw) - max(point) AS bias, count(draw) AS n FROM p JOIN d ON p.k IS NOT DISTINCT FROM d.k GROUP BY p.k)
SELECT k AS lang, {r6("point")} AS point, {r6("se")} AS se, {r6("low")} AS ci_low, {r6("high")} AS ci_high, {r6("bias")} AS bias, CAST(99 AS BIGINT) AS n_boot, CAST(99 - n AS BIGINT) AS n_failed, low <= 0.6 AND 0.6 <= high AS covers FROM q""")
def bootstrap_result(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    draws = ranking.poisson_auc_draws(rows, "quality", "n_chars", "doc_id", ["lang"], 99)
    found = bootstrap.summary(draws, ranking.roc_auc(rows, "quality", "n_chars", "doc_id", ["lang"]), "roc_auc", ["lang"], 0.1, "poisson")
    return shown(found.withColumn("covers", bootstrap.covers(0.6)), "lang", "point", "se", "ci_low", "ci_high", "bias", "n_boot", "n_failed", "covers")


@query()
def metric_bootstrap_ap(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    draws = bootstrap.metric_draws(rows, "quality", "n_chars", "doc_id", "average_precision", stratified=True)
    return shown(bootstrap.summary(draws, ranking.average_precision(rows, "quality", "n_chars", "doc_id"), "average_precision", method="stratified_pairs"))


@query()
def metric_bootstrap_ndcg(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    draws = bootstrap.metric_draws(rows, "quality", "n_chars", "doc_id", "ndcg", 0.05, ["lang"], 199)
    point = ranking.at_k(rows, "quality", "n_chars", "doc_id", [0.05], ["lang"])
    return shown(bootstrap.summary(draws, point, "ndcg", ["lang"]))


@query(f"""WITH {_ROWS} SELECT lang, {r6("least(1, greatest(0, avg(s) FILTER (y = 0) / avg(s) FILTER (y = 1)))")} AS class_prior FROM x GROUP BY lang""")
def class_prior(spark, sf_dir):
    return shown(pu.class_prior(_scored(spark, sf_dir), "n_chars", "quality", ["lang"]))


def _features(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("x0"), (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 1000 / 1000.0).alias("x1"), "source")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("unit_id"), "x0", "x1", F.col("quality").cast("int").alias("y"), F.col("source").alias("grp"))


@query()
def pu_elkan_noto(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("s", F.when(F.col("y") == 1, 1).otherwise(0))
    return shown(pu.ElkanNoto(["x0", "x1"], seed=3).fit(rows, "s", "unit_id").score(rows, "unit_id"))


@query()
def pu_bagging(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("s", F.when(F.col("y") == 1, 1).otherwise(0))
    return shown(pu.Bagging(["x0", "x1"], n_estimators=3, seed=3).fit(rows, "s", "unit_id").score(rows, "unit_id", use_oob=True))


#: The greedy rule, one group after the other.
_FOLDS = """s AS (SELECT source AS grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS BIGINT) AS fold, CAST([0, 0, 0, 0] AS BIGINT[]) AS loads
  UNION ALL SELECT s.i, s.grp, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT), CAST([loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN n ELSE 0 END FOR j IN [1, 2, 3, 4]] AS BIGINT[]) FROM g JOIN s ON s.i = g.i + 1)"""


@query(f"WITH RECURSIVE {_FOLDS} SELECT grp, fold FROM g WHERE i > 0")
def group_folds(spark, sf_dir):
    return shown(harness.group_folds(_features(spark, sf_dir), 4))


@query(f"""WITH RECURSIVE {_FOLDS}, {_ROWS}, t AS (SELECT doc_id, x.s, y, fold FROM x JOIN g ON x.source = g.grp WHERE g.i > 0),
c AS (SELECT fold, s, count(*) AS m, sum(y) AS pos FROM t GROUP BY fold, s), h AS (SELECT *, sum(m) OVER w AS selected, sum(pos) OVER w AS hits FROM c WINDOW w AS (PARTITION BY fold ORDER BY s DESC)),
r AS (SELECT fold, y, row_number() OVER (PARTITION BY fold ORDER BY s DESC, doc_id) AS a, row_number() OVER (PARTITION BY fold ORDER BY y DESC, doc_id) AS b, greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY fold))) AS cut FROM t),
k AS (SELECT fold, max(cut) AS cut, coalesce(sum(y) FILTER (a <= cut), 0) AS hit, sum(y) AS pos, sum(y / log2(a + 1.0)) FILTER (a <= cut) AS gain, sum(y / log2(b + 1.0)) FILTER (b <= cut) AS best FROM r GROUP BY fold),
m AS (SELECT fold, 'roc_auc' AS metric, 'all' AS k, sum((m - pos) * (hits - pos + pos / 2.0)) / (sum(pos) * sum(m - pos)) AS value FROM h GROUP BY fold
  UNION ALL SELECT fold, 'average_precision', 'all', sum(pos * hits / selected) / sum(pos) FROM h GROUP BY fold
  UNION ALL SELECT fold, 'precision', '10%', hit / cut FROM k UNION ALL SELECT fold, 'recall', '10%', hit / pos FROM k UNION ALL SELECT fold, 'ndcg', '10%', gain / best FROM k)
SELECT fold, metric, k, {r6("value")} AS value FROM m UNION ALL SELECT NULL, metric, k, {r6("avg(value)")} FROM m GROUP BY metric, k""")
def group_fold_eval(spark, sf_dir):
    return shown(harness.evaluate(detectors.FunctionDetector("x0"), _features(spark, sf_dir), harness.EvalSpec("group", n_splits=4, ks=(0.1,))))


@query(f"""WITH {_ROWS}, t AS (SELECT * FROM x WHERE doc_id % 2 = 0), c AS (SELECT s, count(*) AS m, sum(y) AS pos FROM t GROUP BY s),
h AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS hits FROM c)
SELECT {r6("sum((m - pos) * (hits - pos + pos / 2.0)) / (sum(pos) * sum(m - pos))")} AS value FROM h""")
def anchor_eval(spark, sf_dir):
    found = harness.evaluate(detectors.FunctionDetector("x0"), _features(spark, sf_dir), harness.EvalSpec("anchor", anchor="unit_id % 2 = 0", ks=(0.1,)))
    return shown(found.where("fold is null and metric = 'roc_auc'"), "value")


_AUC = r6("sum((m - pos) * (hits - pos + pos / 2.0)) / (sum(pos) * sum(m - pos))")


@query(f"""WITH {_ROWS}, t AS (SELECT * FROM x WHERE doc_id > 100), c AS (SELECT s, count(*) AS m, sum(y) AS pos FROM t GROUP BY s),
h AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS hits FROM c) SELECT {_AUC} AS value FROM h""")
def temporal_eval(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumn("time", F.col("unit_id"))
    found = harness.evaluate(detectors.FunctionDetector("x0"), rows, harness.EvalSpec("temporal", train_end=100, metrics=("roc_auc",)))
    return shown(found.where("fold is null"), "value")


@query(f"""WITH {_ROWS}, c AS (SELECT s, count(*) AS m, sum(y) AS pos FROM x GROUP BY s),
h AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS hits FROM c) SELECT {_AUC} AS value FROM h""")
def unsplit_eval(spark, sf_dir):
    found = harness.evaluate(detectors.FunctionDetector("x0"), _features(spark, sf_dir), harness.EvalSpec("none", metrics=("roc_auc",)))
    return shown(found.where("fold is null"), "value")


@query(f"SELECT doc_id AS unit_id, {r6('ln(1 + n_chars)')} AS score, row_number() OVER (ORDER BY ln(1 + n_chars) DESC, doc_id) AS rank FROM documents")
def transfer_rank(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return shown(harness.transfer(detectors.FunctionDetector("x0"), rows, rows).scores)


@query(f"""WITH t AS (SELECT CAST(v AS DOUBLE) AS threshold FROM range(0, 5000, 500) z(v)), n AS (SELECT lang AS control, count(*) AS n FROM documents GROUP BY 1)
SELECT lang AS control, {r6("threshold")} AS threshold, {r6("count(*) FILTER (n_chars >= threshold) / max(n)")} AS flagged_share FROM documents JOIN n ON lang = control CROSS JOIN t GROUP BY lang, threshold""")
def control_flagged_share(spark, sf_dir):
    scores = load(spark, sf_dir, "documents").select(F.col("lang").alias("control"), F.col("n_chars").cast("double").alias("score"))
    thresholds = spark.range(0, 5000, 500).select(F.col("id").cast("double").alias("threshold"))
    return shown(harness.flagged_shares(scores, thresholds))
