"""Dispersion and balance queries."""

import uuid

from pyspark.sql import functions as F

from ..core import seeding
from ..functions import tables
from ..operators import balance, dispersion
from ..streaming import series
from .registry import load, query, r6, shown


def _daily(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))


_DAILY = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n_events, sum(value) AS total FROM events GROUP BY 1, 2)"


@query(f"WITH {_DAILY} SELECT event_type, count(*) AS n, {r6('var_samp(n_events) / avg(n_events)')} AS index FROM d GROUP BY 1")
def dispersion_index(spark, sf_dir):
    return shown(dispersion.dispersion_index(_daily(spark, sf_dir), "n_events", ["event_type"]))


@query(f"""WITH {_DAILY} SELECT event_type, count(*) AS n, {r6("var_samp(n_events)")} AS s2, {r6("(count(*) - 1) * var_samp(n_events) / 50.0")} AS statistic FROM d GROUP BY 1""")
def variance_floor(spark, sf_dir):
    return shown(dispersion.variance_floor_test(_daily(spark, sf_dir), "n_events", 50.0, ["event_type"]), "event_type", "n", "s2", "statistic")


@query(f"""WITH {_DAILY}, f AS (SELECT event_type, n_events - total / 50.0 AS e FROM d)
SELECT event_type, count(*) AS n, {r6("avg(e)")} AS mean_residual, {r6("(count(*) - 1) * var_samp(e) / 10.0")} AS statistic FROM f GROUP BY 1""")
def residual_floor(spark, sf_dir):
    rows = _daily(spark, sf_dir).withColumn("fitted", F.col("total") / 50.0)
    return shown(dispersion.residual_underdispersion(rows, "n_events", "fitted", 10.0, ["event_type"]), "event_type", "n", "mean_residual", "statistic")


@query(f"WITH {_DAILY} SELECT event_type, count(*) AS n, {r6('0.25 * var_samp(total)')} AS floor_variance FROM d GROUP BY 1")
def implied_floor(spark, sf_dir):
    return shown(dispersion.implied_variance_floor(_daily(spark, sf_dir), "total", 0.5, ["event_type"]))


def _walk(detrend: str) -> str:
    base = "s AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS t, CAST(n_events AS DOUBLE) AS x FROM d)"
    if detrend == "none":
        return base + ", a AS (SELECT * FROM s)"
    if detrend == "diff":
        return base + ", a AS (SELECT k, t, x - p AS x FROM (SELECT k, t, x, lag(x) OVER (PARTITION BY k ORDER BY t) AS p FROM s) WHERE p IS NOT NULL)"
    return base + ", l AS (SELECT k, regr_slope(x, t) AS b, avg(x) AS mx, avg(t) AS mt FROM s GROUP BY k), a AS (SELECT s.k, t, x - mx - b * (t - mt) AS x FROM s JOIN l USING (k))"


def _eta(detrend: str) -> str:
    return f"""{_DAILY}, {_walk(detrend)}, w AS (SELECT k, x, x - lag(x) OVER (PARTITION BY k ORDER BY t) AS d FROM a),
e AS (SELECT k, count(*) AS m, var_samp(x) AS s2, sum(d * d) / (count(*) - 1) / var_samp(x) AS eta FROM w GROUP BY k)"""


@query(f"WITH {_eta('none')} SELECT k AS event_type, m, {r6('eta')} AS eta FROM e")
def smoothness_ratio(spark, sf_dir):
    return shown(dispersion.smoothness_ratio(_daily(spark, sf_dir), "n_events", ["day"], ["event_type"]), "event_type", "m", "eta")


def _too_smooth(detrend: str):
    def run(spark, sf_dir):
        found = dispersion.too_smooth_test(_daily(spark, sf_dir), "n_events", ["day"], ["event_type"], detrend, 99, 5)
        return shown(found, "event_type", "m", "eta", "pvalue", "null_mean", "null_sd", "implied_lag1")

    run.__name__ = f"too_smooth_{detrend}"
    u = seeding.uniform_sql("'5'", "r", "k", "t")
    query(f"""WITH {_eta(detrend)}, c AS (SELECT k, t, x, r, {u} AS u FROM a CROSS JOIN range(1, 100) z(r)),
n AS (SELECT k, r, x - lag(x) OVER (PARTITION BY k, r ORDER BY u, t) AS d FROM c),
q AS (SELECT e.k, r, sum(d * d) / ((max(m) - 1) * max(s2)) AS v FROM n JOIN e USING (k) GROUP BY e.k, r)
SELECT e.k AS event_type, max(m) AS m, {r6("max(eta)")} AS eta, {r6("(1 + count(*) FILTER (v <= eta)) / 100.0")} AS pvalue, {r6("avg(v)")} AS null_mean, {r6("stddev_samp(v)")} AS null_sd,
       {r6("1 - max(eta) / 2")} AS implied_lag1 FROM q JOIN e USING (k) GROUP BY e.k""")(run)


for _detrend in ("none", "diff", "linear"):
    _too_smooth(_detrend)


_ROLLING = f"""WITH {_DAILY}, {_walk("none")}, w AS (SELECT k, t - 6 AS start, t AS stop, var_samp(x) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s2 FROM s),
p AS (SELECT *, 6 * s2 / 50.0 AS x FROM w WHERE start >= 0)
SELECT k AS event_type, start, stop AS "end", {r6("s2")} AS s2, {r6("x")} AS statistic, {r6("1 - exp(-x / 2) * (1 + x / 2 + (x / 2) * (x / 2) / 2)")} AS pvalue FROM p"""


@query(_ROLLING)
def rolling_floor(spark, sf_dir):
    found = dispersion.rolling_variance_floor(_daily(spark, sf_dir), "n_events", ["day"], 50.0, 7, ["event_type"])
    return shown(found, "event_type", "start", "end", "s2", "statistic", "pvalue")


_VARIABLES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _baseline(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", F.expr("stack(4, " + ", ".join(f"'{v}', {v}" for v in _VARIABLES) + ") as (variable, x)"))
    return lines.groupBy("l_linestatus", "variable", "l_returnflag").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n"))


_BASE = "b AS (" + " UNION ALL ".join(f"SELECT l_linestatus, '{v}' AS variable, l_returnflag, avg({v}) AS mean, stddev_samp({v}) AS sd, count(*) AS n FROM lineitem GROUP BY 1, 2, 3" for v in _VARIABLES) + ")"


@query(f"""WITH {_BASE}, s AS (SELECT l_linestatus, variable, count(*) AS g, sum(n) AS n, sum(n * mean) / sum(n) AS grand, sum(n * mean * mean) AS k2, sum((n - 1) * sd * sd) AS within FROM b GROUP BY 1, 2)
SELECT l_linestatus, variable, {r6("(k2 - n * grand * grand) / (g - 1) / (within / (n - g))")} AS f FROM s WHERE g >= 2""")
def anova_balance(spark, sf_dir):
    return shown(balance.anova_table(_baseline(spark, sf_dir), "mean", "sd", "n", ["l_linestatus", "variable"]), "l_linestatus", "variable", "f")


def _pvalues(spark, sf_dir):
    """Shares in 0..1 that stand for p-values: discounts by supplier."""
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 10).alias("p"))


@query(f"""WITH p AS (SELECT least(greatest(avg(l_discount) * 10, 1e-12), 1 - 1e-12) AS q FROM lineitem GROUP BY l_suppkey) SELECT count(*) AS n, {r6("-2 * sum(ln(1 - q))")} AS statistic FROM p""")
def combine_fisher(spark, sf_dir):
    return shown(balance.combine_pvalues(_pvalues(spark, sf_dir), "p", method="fisher"), "n", "statistic")


@query()
def combine_stouffer(spark, sf_dir):
    return shown(balance.combine_pvalues(_pvalues(spark, sf_dir), "p"))


@query(f"""WITH p AS (SELECT avg(l_discount) * 10 AS p FROM lineitem GROUP BY l_suppkey), r AS (SELECT p - (row_number() OVER (ORDER BY p) - 1.0) / count(*) OVER () AS gap FROM p)
SELECT count(*) AS n, {r6("greatest(max(gap), 0)")} AS ks FROM r""")
def ks_balance(spark, sf_dir):
    return shown(balance.ks_too_balanced(_pvalues(spark, sf_dir), "p"), "n", "ks")


@query()
def carlisle_table(spark, sf_dir):
    return shown(balance.carlisle_test(_baseline(spark, sf_dir), "mean", "sd", "n", "variable"))


def _series_view(spark, sf_dir) -> None:
    tables.register_tables(spark)
    _daily(spark, sf_dir).select(F.col("event_type").alias("k"), F.col("day").alias("t"), F.col("n_events").cast("double").alias("x")).createOrReplaceTempView("vt_series")


@query(_ROLLING)
def sql_rolling_floor(spark, sf_dir):
    """The same by a table function in SQL."""
    _series_view(spark, sf_dir)
    found = spark.sql("SELECT k AS event_type, start, end, s2, statistic, pvalue FROM vt_rolling_floor(TABLE(vt_series) PARTITION BY (k) ORDER BY (t), 50.0D, 7)")
    return shown(found)


@query(f"WITH {_eta('none')} SELECT k AS event_type, m AS n, {r6('s2')} AS s2, {r6('eta')} AS eta FROM e")
def sql_smoothness(spark, sf_dir):
    _series_view(spark, sf_dir)
    return shown(spark.sql("SELECT k AS event_type, n, s2, eta FROM vt_smoothness(TABLE(vt_series) PARTITION BY k ORDER BY t)"))


@query("""WITH v AS (SELECT event_type AS k, ts, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS passed FROM v),
w AS (SELECT k, ts, t - 6 AS start, t AS stop, var_samp(x) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS s2 FROM v),
p AS (SELECT *, 6 * s2 / 500.0 AS x FROM w CROSS JOIN c WHERE start >= 0 AND ts < passed)
""" + f"""SELECT k AS event_type, start, stop AS "end", {r6("s2")} AS s2, {r6("x")} AS statistic, {r6("1 - exp(-x / 2) * (1 + x / 2 + (x / 2) * (x / 2) / 2)")} AS pvalue FROM p""")
def stream_rolling_floor(spark, sf_dir):
    """The events as a stream: windows that the watermark has passed at its end."""
    source = f"{sf_dir}/events.parque[t]"  # a pattern: a stream takes a single file only so
    stream = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(source)
    found = series.rolling_floor(stream, "event_type", "ts", "value", "event_id", 500.0, 7, "1 day")
    place = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/veritally-stream-{uuid.uuid4().hex}"
    found.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.schema(found.schema).parquet(f"{place}/rows"), "k", "start", "end", "s2", "statistic", "pvalue").withColumnRenamed("k", "event_type")
