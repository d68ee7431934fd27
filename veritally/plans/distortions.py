"""Injection, effect, ladder, power, control and red-team queries."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..core import seeding, special
from ..operators import control, digits, inject, power, redteam
from ..sources import atlas
from .registry import load, query, r6, shown

_U = seeding.uniform_sql("'1'", "o_orderkey")


def _priced(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.lit(1000.0).alias("den"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_U}, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
a AS (SELECT o_orderpriority, o_orderkey, o_totalprice AS b, CASE WHEN nth <= round_even(0.25 * n, 0) THEN round_even(100.0 * o_totalprice / 1000.0, 0) * 1000.0 / 100.0 ELSE o_totalprice END AS a FROM r)
SELECT o_orderpriority, o_orderkey, {r6("b")} AS before, {r6("a")} AS after, a <> b AS moved FROM a""")
def inject_rounding(spark, sf_dir):
    return shown(inject.inject_rounding(_priced(spark, sf_dir), "o_totalprice", "den", "o_orderkey", 0.25, ["o_orderpriority"], 1))


_TO = seeding.uniform_sql("'1'", "'to'", "o_orderkey")


@query(f"""WITH p AS (SELECT *, o_totalprice >= 240000 AND o_totalprice < 250000 AS pool FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {_U}, o_orderkey) AS nth, count(*) OVER (PARTITION BY pool) AS n FROM p),
a AS (SELECT o_orderkey, o_totalprice AS b, CASE WHEN pool AND nth <= round_even(0.5 * n, 0) THEN 250000 + 10000 * {_TO} ELSE o_totalprice END AS a FROM r)
SELECT o_orderkey, {r6("b")} AS before, {r6("a")} AS after, a <> b AS moved FROM a""")
def inject_bunching(spark, sf_dir):
    return shown(inject.inject_bunching(_priced(spark, sf_dir), "o_totalprice", "o_orderkey", 250_000.0, 0.5, 10_000.0, seed=1))


def _series(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type", F.dayofyear("ts").cast("long").alias("day")).agg(F.sum("value").alias("total"))


_SERIES = "s AS (SELECT event_type, CAST(dayofyear(ts) AS BIGINT) AS day, sum(value) AS x FROM events GROUP BY 1, 2)"


@query(f"""WITH {_SERIES}, i AS (SELECT *, day BETWEEN 10 AND 20 AS inside FROM s),
r AS (SELECT *, least(row_number() OVER (PARTITION BY event_type, inside ORDER BY day), row_number() OVER (PARTITION BY event_type, inside ORDER BY day DESC)) AS edge FROM i),
a AS (SELECT event_type, day, x, CASE WHEN inside THEN x * (1 + 0.3 * least(edge / 3.0, 1.0)) ELSE x END AS a FROM r)
SELECT event_type, day, {r6("x")} AS before, {r6("a")} AS after, a <> x AS moved FROM a""")
def inject_padding(spark, sf_dir):
    return shown(inject.inject_padding(_series(spark, sf_dir), "total", "day", 10, 20, 0.3, ["event_type"], taper=3))


@query(f"""WITH {_SERIES}, a AS (SELECT *, x + (sqrt(0.2) - 1) * (x - avg(x) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS a FROM s)
SELECT event_type, day, {r6("x")} AS before, {r6("a")} AS after FROM a""")
def inject_smoothing(spark, sf_dir):
    return shown(inject.inject_smoothing(_series(spark, sf_dir), "total", "day", 0.2, ["event_type"]), "event_type", "day", "before", "after")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {_U}, o_orderkey) AS nth, count(*) OVER () AS n FROM orders),
a AS (SELECT o_totalprice AS b, CASE WHEN nth <= round_even(0.5 * n, 0) THEN round_even(100.0 * o_totalprice / 1000.0, 0) * 1000.0 / 100.0 ELSE o_totalprice END AS a FROM r)
SELECT count(*) AS n, count(*) FILTER (a <> b) AS n_touched, {r6("count(*) FILTER (a <> b) / count(*)")} AS share_touched, {r6("avg(abs(a - b) / b) FILTER (a <> b)")} AS mean_relative_displacement,
       {r6("sum(abs(a - b)) / sum(b)")} AS gross_displacement, {r6("sum(a - b) / sum(b)")} AS net_displacement, {r6("sum(a - b) / sum(abs(a - b))")} AS directionality FROM a""")
def effect_measure(spark, sf_dir):
    moved = inject.inject_rounding(_priced(spark, sf_dir), "o_totalprice", "den", "o_orderkey", 0.5, seed=1)
    return shown(inject.measure_effect(moved), "n", "n_touched", "share_touched", "mean_relative_displacement", "gross_displacement", "net_displacement", "directionality")


def _suppliers(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("num"), F.count("*").cast("double").alias("den"))
    nations = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"), F.col("n_regionkey").cast("long").alias("region"))
    return lines.join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))


@query(f"""WITH u AS (SELECT CAST(n_regionkey AS BIGINT) AS region, n_name AS nation, l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS num, CAST(count(*) AS DOUBLE) AS den
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT CAST((CASE WHEN grouping(region) = 0 THEN 1 ELSE 0 END) + (CASE WHEN grouping(nation) = 0 THEN 1 ELSE 0 END) + (CASE WHEN grouping(l_suppkey) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS depth,
       region, nation, l_suppkey, count(*) AS units, {r6("100.0 * sum(num) / sum(den)")} AS sum_then_ratio, {r6("avg(100.0 * num / den)")} AS mean_of_ratios FROM u GROUP BY ROLLUP (region, nation, l_suppkey)""")
def ladder_rollup(spark, sf_dir):
    found = power.roll_up(_suppliers(spark, sf_dir), "num", "den", ["region", "nation", "l_suppkey"])
    return shown(found, "depth", "region", "nation", "l_suppkey", "units", "sum_then_ratio", "mean_of_ratios")


def _t_test(x) -> float:
    return 2 * special.norm_sf(abs(float(np.mean(x))) / float(np.std(x, ddof=1)) * len(x) ** 0.5)


def _shift(x, effect, generator):
    return x + effect


_SIZES, _EFFECTS, _REPLICATES = (50, 100, 300, 1000), (0.0, 0.1, 0.3), 200
_CURVE = f"""WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s, count(*) AS total FROM orders),
x AS (SELECT o_orderkey, (o_totalprice - a) / s AS x FROM orders CROSS JOIN m),
g AS (SELECT n, least({_REPLICATES}, total // n) AS per FROM m CROSS JOIN (SELECT unnest({list(_SIZES)!r}) AS n) v),
k AS (SELECT n, per, unnest(range(CAST(ceil({_REPLICATES} / per) AS BIGINT))) AS ordering FROM g),
u AS (SELECT n, per, ordering, x, o_orderkey, {seeding.uniform_sql("'0'", "n", "ordering", "o_orderkey")} AS u FROM x CROSS JOIN k),
r AS (SELECT n, per, ordering, x, row_number() OVER (PARTITION BY n, ordering ORDER BY u, o_orderkey) AS nth FROM u),
c AS (SELECT n, ordering * per + (nth - 1) // n AS sample, avg(x) AS mean, stddev_samp(x) AS sd FROM r WHERE nth <= per * n GROUP BY ALL),
t AS (SELECT n, e, avg(CASE WHEN abs(mean + e) / sd * sqrt(n) >= 1.959963984540054 THEN 1.0 ELSE 0 END) AS power FROM c CROSS JOIN (SELECT unnest({list(_EFFECTS)!r}) AS e) v WHERE sample < {_REPLICATES} GROUP BY n, e)
SELECT 'mean_shift' AS method, CAST(n AS BIGINT) AS n, {r6("e")} AS effect_size, {r6("power")} AS power, {r6(f"sqrt(power * (1 - power) / {_REPLICATES})")} AS power_se, CAST({_REPLICATES} AS BIGINT) AS n_replicates,
  {r6("0.05")} AS alpha, {r6("max(power) FILTER (e = 0) OVER (PARTITION BY n)")} AS false_positive_rate FROM t"""


def _curve(spark, sf_dir):
    """Standardised prices of all orders, tested for a mean of zero."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    mean, sd = orders.agg(F.avg("o_totalprice"), F.stddev_pop("o_totalprice")).first()
    scaled = orders.select("o_orderkey", ((F.col("o_totalprice") - mean) / sd).alias("x"))
    return power.power_curve(scaled, "x", "o_orderkey", _t_test, _shift, "mean_shift", _EFFECTS, _SIZES, _REPLICATES)


@query(_CURVE)
def power_curve(spark, sf_dir):
    return shown(_curve(spark, sf_dir))


@query(_CURVE)
def atlas_roundtrip(spark, sf_dir):
    place = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/veritally-atlas-{uuid.uuid4().hex}"
    atlas.publish_atlas(_curve(spark, sf_dir), place, "mean_shift", "unit", seed=0)
    return shown(atlas.PowerLookup(spark, place).select("mean_shift", "unit"))


_ATLAS = "(VALUES ('m', 50, 0.0, 0.05, 0.05), ('m', 50, 0.1, 0.3, 0.05), ('m', 50, 0.3, 0.85, 0.05), ('m', 300, 0.0, 0.2, 0.2), ('m', 300, 0.1, 0.95, 0.2), ('m', 900, 0.0, 0.05, 0.05), ('m', 900, 0.1, 0.5, 0.05))"


@query(f"""WITH a AS (SELECT * FROM {_ATLAS} t(method, n, effect_size, power, fpr))
SELECT method, CAST(n AS BIGINT) AS n, {r6("CASE WHEN max(fpr) <= 0.1 THEN min(effect_size) FILTER (effect_size > 0 AND power >= 0.8) END")} AS minimum_detectable_effect,
  CASE WHEN max(fpr) > 0.1 THEN 'rejects too often without an effect' WHEN min(effect_size) FILTER (effect_size > 0 AND power >= 0.8) IS NULL THEN 'not reached by any measured effect' ELSE 'ok' END AS status
FROM a GROUP BY method, n""")
def atlas_mde(spark, sf_dir):
    rows = spark.sql(f"SELECT method, n, CAST(effect_size AS DOUBLE) AS effect_size, CAST(power AS DOUBLE) AS power, CAST(fpr AS DOUBLE) AS false_positive_rate, 0.05D AS alpha FROM {_ATLAS} t(method, n, effect_size, power, fpr)")
    return shown(power.minimum_detectable_effect(rows))


_LADDER = f"""WITH u AS (SELECT n_name AS nation, CAST(n_regionkey AS BIGINT) AS region, l_suppkey AS unit, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS num, CAST(count(*) AS DOUBLE) AS den
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
e AS (SELECT 0.0 AS e, 0 AS r UNION ALL SELECT e, r FROM (SELECT unnest([0.5, 1.0]) AS e), (SELECT unnest(range(1, 101)) AS r)),
c AS (SELECT u.*, e, r, num + CASE WHEN e = 0 THEN 0 ELSE e * den * 0.05 * {seeding.uniform_sql("'0'", "r", "unit")} END AS moved FROM u CROSS JOIN e),
p AS (SELECT 'supplier' AS level, 0 AS o, 'both' AS kind, e, r, 100.0 * moved / den AS pct FROM c
  UNION ALL SELECT 'nation', 1, 'sum_then_ratio', e, r, 100.0 * sum(moved) / sum(den) FROM c GROUP BY nation, e, r UNION ALL SELECT 'nation', 1, 'mean_of_ratios', e, r, avg(100.0 * moved / den) FROM c GROUP BY nation, e, r
  UNION ALL SELECT 'region', 2, 'sum_then_ratio', e, r, 100.0 * sum(moved) / sum(den) FROM c GROUP BY region, e, r UNION ALL SELECT 'region', 2, 'mean_of_ratios', e, r, avg(100.0 * moved / den) FROM c GROUP BY region, e, r),
t AS (SELECT level, o, kind, e, r, count(*) AS units, coalesce(abs(avg(pct) - 24.5) / nullif(stddev_samp(pct), 0) * sqrt(count(*)) >= 1.959963984540054, false) AS rejected FROM p GROUP BY ALL),
s AS (SELECT level, o, unnest(CASE WHEN kind = 'both' THEN ['sum_then_ratio', 'mean_of_ratios'] ELSE [kind] END) AS semantics, e, units, rejected FROM t),
w AS (SELECT level, o, semantics, e, max(units) AS units, avg(CASE WHEN rejected THEN 1.0 ELSE 0 END) AS power FROM s GROUP BY ALL)
SELECT level, CAST(o AS BIGINT) AS level_ordinal, semantics, {r6("e")} AS effect_size, units AS n_units, {r6("(SELECT count(*) FROM u) / units")} AS mean_group_size, {r6("power")} AS power,
  {r6("sqrt(power * (1 - power) / 100)")} AS power_se, {r6("max(power) FILTER (e = 0) OVER (PARTITION BY level, semantics)")} AS false_positive_rate, CAST(100 AS BIGINT) AS n_replicates, {r6("0.05")} AS alpha FROM w"""


@query(_LADDER)
def ladder_power(spark, sf_dir):
    def moved(num, den, effect, draw):
        return num + effect * den * 0.05 * draw

    def test(num, den, pct):
        z = F.abs(F.avg(pct) - 24.5) / F.when(F.stddev_samp(pct) > 0, F.stddev_samp(pct)) * F.sqrt(F.count(pct))
        return 2 * special.norm_sf_column(z)

    return shown(power.aggregation_ladder(_suppliers(spark, sf_dir), "num", "den", "l_suppkey", [("supplier", None), ("nation", "nation"), ("region", "region")], test, moved, [0.5, 1.0]))


_P = seeding.uniform_sql("'9'", "event_id")


@query(f"""WITH r AS (SELECT event_type AS control, CASE WHEN event_type = 'click' THEN 'external' ELSE 'synthetic' END AS kind, {_P} <= 0.05 AS rejected FROM events),
s AS (SELECT control, kind, count(*) AS n, avg(CASE WHEN rejected THEN 1.0 ELSE 0 END) AS rate, 2 * sqrt(0.05 * 0.95 / count(*)) AS slack FROM r GROUP BY 1, 2)
SELECT control, kind, n, {r6("rate")} AS rejection_rate, {r6("rate - 0.05")} AS excess, CASE WHEN rate > 0.05 + slack THEN 'anticonservative' WHEN rate < 0.05 - slack THEN 'conservative' ELSE 'calibrated' END AS verdict FROM s""")
def control_report(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(F.col("event_type").alias("control"), F.when(F.col("event_type") == "click", "external").otherwise("synthetic").alias("kind"), seeding.uniform(9, F.col("event_id")).alias("pvalue"))
    return shown(control.control_report(events), "control", "kind", "n", "rejection_rate", "excess", "verdict")


@query(f"""WITH {_SERIES} SELECT event_type, day, {r6("x")} AS total, {r6("CASE WHEN day >= 15 THEN x + 100 ELSE x END")} AS shifted FROM s""")
def redteam_level_shift(spark, sf_dir):
    return shown(redteam.level_shift(_series(spark, sf_dir), "total", "day", 15, 100.0))


@query(f"""WITH {_SERIES} SELECT event_type, day, {r6("x")} AS total, {r6("CASE WHEN day >= 15 THEN x * 0.1 ELSE x END")} AS shifted FROM s""")
def redteam_rebasing(spark, sf_dir):
    return shown(redteam.level_shift(_series(spark, sf_dir), "total", "day", 15, 0.1, "multiplicative"))


@query(f"""WITH l AS (SELECT year(l_shipdate) AS y, p_brand AS g, l_quantity AS q, p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT g, avg(p) AS p, sum(q) AS q FROM l WHERE y = 1995 GROUP BY g), v AS (SELECT y, g, sum(q) AS q FROM l GROUP BY y, g)
SELECT CAST(y AS BIGINT) AS y, {r6("100.0 * sum(v.q * b.p) / (SELECT sum(p * q) FROM b)")} AS volume_index FROM v JOIN b USING (g) GROUP BY y""")
def redteam_reweighting(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return shown(redteam.reweighting(lines, "y", "p_brand", "l_quantity", "p_retailprice", 1995))


_DIGIT = seeding.uniform_sql("'0'", "o_orderkey", "i")


@query(f"""WITH o AS (SELECT o_orderkey, CAST(CAST(round_even(o_totalprice, 0) AS BIGINT) AS VARCHAR) AS s FROM orders)
SELECT o_orderkey, CAST(s AS BIGINT) AS price, CAST(array_to_string([CASE WHEN {_DIGIT} < 0.05 AND s[i + 1] IN ('3', '5', '6', '9') THEN '8' ELSE s[i + 1] END FOR i IN range(length(s))], '') AS BIGINT) AS misread FROM o""")
def redteam_ocr(spark, sf_dir):
    return shown(redteam.ocr_noise(load(spark, sf_dir, "orders").select("o_orderkey", F.rint("o_totalprice").cast("long").alias("price")), "price", "o_orderkey", 0.05, redteam.GLYPHS))


_RATES, _REPLICATES_OCR = (0.0, 0.02, 0.05, 0.1, 0.3), 10
_LAST = seeding.uniform_sql("'0'", "concat_ws(':', r, o_orderkey)", "length(CAST(price AS VARCHAR)) - 1")
#: Chi-square of ten cells against the 95 % point with nine degrees of freedom.
_FIRED = f"""WITH o AS (SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS price FROM orders),
g AS (SELECT o_orderkey, price % 10 AS d, rate, r, {_LAST} AS u FROM o CROSS JOIN (SELECT unnest({list(_RATES)!r}) AS rate) a CROSS JOIN range(1, {_REPLICATES_OCR + 1}) t(r)),
m AS (SELECT rate, r, CASE WHEN u < rate AND d IN (3, 5, 6, 9) THEN 8 ELSE d END AS d FROM g),
c AS (SELECT rate, r, d, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT rate, r, sum(n) AS n, sum(n * n) AS q FROM c GROUP BY rate, r),
f AS (SELECT rate, r, 10.0 * q / n - n > 16.918977604620448 AS fired FROM x)"""


def _terminal(table, by):
    return digits.terminal_digit_test(table, "misread", by)


@query(f"{_FIRED} SELECT {r6('rate')} AS rate, CAST(r AS BIGINT) AS replicate, fired FROM f")
def redteam_ocr_firings(spark, sf_dir):
    """Last digits of prices, misread by alike shapes."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.rint("o_totalprice").cast("long").alias("price"))
    found = redteam.ocr_firings(orders, "price", "o_orderkey", _terminal, _RATES, _REPLICATES_OCR, confusion=redteam.GLYPHS)
    return shown(found, "rate", "replicate", "fired")


@query(f"{_FIRED}, s AS (SELECT rate, avg(CASE WHEN fired THEN 1.0 ELSE 0 END) AS share FROM f GROUP BY rate) SELECT {r6('min(rate) FILTER (share > 0.5)')} AS threshold FROM s")
def redteam_ocr_threshold(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.rint("o_totalprice").cast("long").alias("price"))
    return shown(redteam.ocr_firing_threshold(orders, "price", "o_orderkey", _terminal, _RATES, n_replicates=_REPLICATES_OCR, confusion=redteam.GLYPHS))
