"""The six detectors, with users, suppliers and priorities as units."""

from pyspark.sql import functions as F

from ..core import seeding
from ..ml import detectors
from ..operators.bunching import Window
from .digits import _table
from .registry import load, query, r6, shown


@query(f"""WITH {_table("lineitem", "l_suppkey", "l_extendedprice", "first_two")}
SELECT k AS unit_id, {r6("max(eff) * sum((o / total - share) * (o / total - share) / share)")} AS score FROM d GROUP BY k""")
def detector_benford_first_two(spark, sf_dir):
    return shown(detectors.make("benford_first_two")(load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "unit_id"), "unit_id", "l_extendedprice"))


@query(f"""WITH v AS (SELECT l_suppkey AS k, CAST(abs(round_even(l_extendedprice, 0)) AS BIGINT) % 10 AS cell FROM lineitem), t AS (SELECT k, count(*) AS n FROM v GROUP BY k), c AS (SELECT k, cell, count(*) AS o FROM v GROUP BY 1, 2)
SELECT t.k AS unit_id, {r6("max(n) * sum((coalesce(o, 0) / n - 0.1) * (coalesce(o, 0) / n - 0.1) * 10)")} AS score FROM t CROSS JOIN range(0, 10) s(d) LEFT JOIN c ON c.k = t.k AND c.cell = d GROUP BY t.k""")
def detector_terminal_digit(spark, sf_dir):
    return shown(detectors.make("terminal_digit")(load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "unit_id"), "unit_id", "l_extendedprice"))


@query(f"""WITH l AS (SELECT l_returnflag AS k, l_suppkey AS s, CAST(sum(l_linenumber) AS DOUBLE) AS num, count(*) * 7 + 100 AS den FROM lineitem GROUP BY 1, 2),
x AS (SELECT * FROM l WHERE k IN (SELECT k FROM l GROUP BY k HAVING count(*) >= 50)),
d AS (SELECT k, s, den, num / den AS p, unnest(range(0, den + 1)) AS j FROM x),
h AS (SELECT k, s, CASE WHEN p <= 0 THEN (CASE WHEN j = 0 THEN 1.0 ELSE 0 END) WHEN p >= 1 THEN (CASE WHEN j = den THEN 1.0 ELSE 0 END)
        ELSE exp(lgamma(den + 1) - lgamma(j + 1) - lgamma(den - j + 1) + j * ln(p) + (den - j) * ln(1 - p)) END AS c FROM d WHERE abs(100.0 * j / den - round_even(100.0 * j / den, 0)) <= 0.05),
c AS (SELECT k, s, sum(c) AS c FROM h GROUP BY 1, 2),
z AS (SELECT x.k, count(*) FILTER (abs(100.0 * num / den - round_even(100.0 * num / den, 0)) <= 0.05) AS o, sum(coalesce(c, 0)) AS m, sqrt(sum(coalesce(c, 0) * (1 - coalesce(c, 0)))) AS sd FROM x LEFT JOIN c USING (k, s) GROUP BY 1)
SELECT k AS unit_id, {r6("(o - m) / sd")} AS score FROM z""")
def detector_integer_excess(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_linenumber").cast("double").alias("num"), (F.count("*") * 7 + 100).cast("double").alias("den"))
    big = lines.groupBy("l_returnflag").agg(F.count("*").alias("c")).where("c >= 50").select("l_returnflag")
    return shown(detectors.make("integer_excess")(lines.join(big, "l_returnflag").withColumnRenamed("l_returnflag", "unit_id"), "unit_id", "num", "den"))


@query()
def detector_notch_bunching(spark, sf_dir):
    return shown(detectors.make("notch_bunching")(load(spark, sf_dir, "events").withColumnRenamed("event_type", "unit_id"), "unit_id", "value", 50.0, Window.of(5.0, 10.0, 10.0, poly_degree=3), min_len=20))


def _weekly(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unit_id"), F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("x"))


@query(f"WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS x FROM events GROUP BY 1, 2) SELECT event_type AS unit_id, {r6('-var_samp(x) / avg(x)')} AS score FROM d GROUP BY 1")
def detector_underdispersion(spark, sf_dir):
    return shown(detectors.make("underdispersion")(_weekly(spark, sf_dir), "unit_id", "x"))


@query(f"""WITH d AS (SELECT event_type AS k, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2),
o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY day) - 1 AS t, x FROM d), a AS (SELECT k, t, x - p AS x FROM (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY t) AS p FROM o) WHERE p IS NOT NULL),
w AS (SELECT k, x, x - lag(x) OVER (PARTITION BY k ORDER BY t) AS d FROM a), e AS (SELECT k, count(*) AS m, var_samp(x) AS s2, sum(d * d) / (count(*) - 1) / var_samp(x) AS eta FROM w GROUP BY k),
u AS (SELECT k, t, x, r, {seeding.uniform_sql("'0'", "r", "k", "t")} AS u FROM a CROSS JOIN range(1, 200) z(r)), n AS (SELECT k, r, x - lag(x) OVER (PARTITION BY k, r ORDER BY u, t) AS d FROM u),
q AS (SELECT e.k, r, sum(d * d) / ((max(m) - 1) * max(s2)) AS v, max(eta) AS eta FROM n JOIN e USING (k) GROUP BY e.k, r)
SELECT k AS unit_id, {r6("-(1 + count(*) FILTER (v <= eta)) / 200.0")} AS score FROM q GROUP BY k""")
def detector_too_smooth(spark, sf_dir):
    return shown(detectors.make("too_smooth")(_weekly(spark, sf_dir), "unit_id", "x", "day"))
