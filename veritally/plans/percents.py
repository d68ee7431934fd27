"""Percentage queries: returned lines of each supplier."""

from pyspark.sql import functions as F

from ..operators import percent
from .registry import load, query, r6, shown


def _units(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("num"), F.count("*").alias("den"))
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), "num", "den")


_UNITS = """u AS (SELECT l_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) FILTER (l_returnflag = 'R') AS num, count(*) AS den
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query(f"""WITH {_UNITS}, p AS (SELECT floor(100.0 * num / den / 0.5 + 0.5) AS bin FROM u)
SELECT CAST(b AS BIGINT) AS bin, {r6("0.5 * b")} AS centre, {r6("count(p.bin)")} AS count FROM range(0, 201) t(b) LEFT JOIN p ON p.bin = b GROUP BY b""")
def pct_histogram(spark, sf_dir):
    units = _units(spark, sf_dir).select(percent.percentage(F.col("num"), F.col("den")).alias("pct"))
    return shown(percent.percentage_histogram(units, "pct", bin_width=0.5))


@query(f"""
WITH {_UNITS}, p AS (SELECT 100.0 * num / den AS pct FROM u WHERE den >= 10), q AS (SELECT pct - round_even(pct, 0) AS rest FROM p)
SELECT count(*) AS n, {r6("count(*) FILTER (abs(rest) <= 0.05)")} AS observed,
       {r6("(" + " + ".join(f"count(*) FILTER (abs(rest - {o!r}) <= 0.05)" for o in percent._neighbours(0.05, 5)) + ") / " + str(float(len(percent._neighbours(0.05, 5)))))} AS neighbour_mean FROM q""")
def integer_neighbour_excess(spark, sf_dir):
    found = percent.integer_excess_exact(_units(spark, sf_dir), "num", "den", min_denominator=10)
    return shown(found, "n", "observed", "neighbour_mean")


@query(f"""
WITH {_UNITS}, x AS (SELECT * FROM u WHERE den >= 100),
k AS (SELECT l_suppkey, s_nationkey, den, num * 1.0 / den AS p, unnest(range(0, den + 1)) AS j FROM x),
h AS (SELECT l_suppkey, s_nationkey, CASE WHEN p <= 0 THEN (CASE WHEN j = 0 THEN 1.0 ELSE 0 END) WHEN p >= 1 THEN (CASE WHEN j = den THEN 1.0 ELSE 0 END)
        ELSE exp(lgamma(den + 1) - lgamma(j + 1) - lgamma(den - j + 1) + j * ln(p) + (den - j) * ln(1 - p)) END AS c FROM k
      WHERE abs(100.0 * j / den - round_even(100.0 * j / den, 0)) <= 0.05),
c AS (SELECT l_suppkey, sum(c) AS c FROM h GROUP BY 1),
s AS (SELECT x.s_nationkey, count(*) AS n, count(*) FILTER (abs(100.0 * num / den - round_even(100.0 * num / den, 0)) <= 0.05) AS o, sum(coalesce(c, 0)) AS m,
        sqrt(sum(coalesce(c, 0) * (1 - coalesce(c, 0)))) AS sd FROM x LEFT JOIN c USING (l_suppkey) GROUP BY 1)
SELECT s_nationkey, n, {r6("o")} AS observed, {r6("m")} AS expected_mean, {r6("sd")} AS expected_sd, {r6("o - m")} AS excess, {r6("(o - m) / sd")} AS z FROM s""")
def integer_excess_exact(spark, sf_dir):
    found = percent.integer_excess_exact(_units(spark, sf_dir), "num", "den", ["s_nationkey"])
    return shown(found, "s_nationkey", "n", "observed", "expected_mean", "expected_sd", "excess", "z")


@query()
def integer_excess_by_group(spark, sf_dir):
    found = percent.integer_excess(_units(spark, sf_dir), "num", "den", ["s_nationkey"], seed=7)
    return shown(found, "s_nationkey", "n", "observed", "expected_mean", "expected_sd", "z", "pvalue", "mc_pvalue", "per_integer", "n_excluded_small")
