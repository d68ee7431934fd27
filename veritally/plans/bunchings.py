"""Bunching queries."""

from pyspark.sql import functions as F

from ..core import seeding
from ..operators import bunching
from ..sources import catalogue
from .registry import load, query, r6, shown

_WINDOW = bunching.Window.of(10_000.0, 20_000.0, 20_000.0, poly_degree=1)


def _bins(x: str, threshold: str, width: float) -> str:
    q = f"(({x} - {threshold}) / {width})"
    return f"CAST(floor({q} + 1e-9 * greatest(1.0, abs({q}))) AS BIGINT)"


def _dense(key: str, x: str, source: str, threshold: str, width: float) -> str:
    return f"""c AS (SELECT {key} AS k, {_bins(x, threshold, width)} AS bin, count(*) AS o FROM {source} GROUP BY 1, 2),
g AS (SELECT k, unnest(range(min(bin), max(bin) + 1)) AS bin FROM c GROUP BY k),
b AS (SELECT g.k, g.bin, coalesce(o, 0) AS o, g.bin + 0.5 AS z FROM g LEFT JOIN c ON c.k = g.k AND c.bin = g.bin)"""


def _fit(below: int, above: int, side: str = "below") -> str:
    low, high = f"bin >= {-below} AND bin < 0", f"bin >= 0 AND bin < {above}"
    out = f"bin >= {-below} AND bin < {above}"
    a, b = (low, high) if side == "below" else (high, low)
    return f"""l AS (SELECT k, regr_slope(o, z) FILTER (NOT ({out})) AS s, regr_intercept(o, z) FILTER (NOT ({out})) AS i, sum(o) AS n FROM b GROUP BY k),
f AS (SELECT b.k, max(n) AS n, sum(o - i - s * z) FILTER ({a}) AS e, -sum(o - i - s * z) FILTER ({b}) AS m, avg(i + s * z) FILTER ({out}) AS h FROM b JOIN l USING (k) GROUP BY b.k)"""


@query(f"""WITH {_dense("o_orderpriority", "o_totalprice", "orders", "250000.0", 10000.0)}
SELECT k AS o_orderpriority, bin, {r6("250000 + 10000 * (bin + 0.5)")} AS centre, {r6("o")} AS count FROM b""")
def bin_around_counts(spark, sf_dir):
    return shown(bunching.bin_around(load(spark, sf_dir, "orders"), "o_totalprice", 250_000.0, 10_000.0, ["o_orderpriority"]))


@query(f"""WITH {_dense("o_orderpriority", "o_totalprice", "orders", "250000.0", 10000.0)}, {_fit(2, 2)}
SELECT k AS o_orderpriority, {r6("n")} AS n, {r6("e")} AS excess_mass, {r6("m")} AS missing_mass, {r6("e / h")} AS normalized_excess FROM f""")
def bunching_deg1(spark, sf_dir):
    return shown(bunching.bunching_linear(load(spark, sf_dir, "orders"), "o_totalprice", 250_000.0, _WINDOW, ["o_orderpriority"]))


@query()
def bunching_deg7(spark, sf_dir):
    window = bunching.Window.of(2.0, 4.0, 4.0, integration_constraint=True)
    return shown(bunching.bunching_estimator(load(spark, sf_dir, "events"), "value", 50.0, window, ["event_type"]))


@query(f"""WITH {_dense("o_orderpriority", "o_totalprice", "orders", "250000.0", 10000.0)}, {_fit(3, 1, "above")}
SELECT k AS o_orderpriority, {r6("n")} AS n, {r6("e / h")} AS normalized_excess, 'below' AS dominated_side FROM f""")
def notch_estimate(spark, sf_dir):
    found = bunching.estimate_notch(load(spark, sf_dir, "orders"), "o_totalprice", bunching.Notch(250_000.0), 10_000.0, 30_000.0, 10_000.0, ["o_orderpriority"], poly_degree=1)
    return shown(found, "o_orderpriority", "n", "normalized_excess", "dominated_side")


@query(f"""WITH {_dense("event_type", "value", "events", "50.0", 5.0)}, {_fit(2, 2)}
SELECT k AS event_type, {r6("n")} AS n, {r6("e / h")} AS normalized_excess FROM f""")
def kink_estimate(spark, sf_dir):
    found = bunching.estimate_kink(load(spark, sf_dir, "events"), "value", bunching.Kink(50.0), 5.0, 10.0, ["event_type"], poly_degree=1)
    return shown(found, "event_type", "n", "normalized_excess")


_CANDIDATES = (100_000.0, 150_000.0, 200_000.0, 250_000.0, 300_000.0)
_SCAN = f"""t AS (SELECT unnest({list(_CANDIDATES)!r}) AS threshold), x AS (SELECT o_totalprice, threshold FROM orders CROSS JOIN t),
{_dense("threshold", "o_totalprice", "x", "threshold", 10000.0)}, {_fit(2, 2)}"""


@query(f"""WITH {_SCAN} SELECT {r6("k")} AS threshold, {r6("n")} AS n, {r6("e")} AS excess_mass, {r6("e / h")} AS normalized_excess FROM f""")
def notch_scan(spark, sf_dir):
    found = bunching.scan_thresholds(load(spark, sf_dir, "orders"), "o_totalprice", _CANDIDATES, _WINDOW)
    return shown(found, "threshold", "n", "excess_mass", "normalized_excess")


@query(f"""WITH {_SCAN}, r AS (SELECT e / h AS v FROM f WHERE k = 250000) SELECT {r6("(SELECT v FROM r)")} AS observed, count(*) AS n_placebo,
{r6("count(*) FILTER (e / h >= (SELECT v FROM r)) / count(*)")} AS pvalue FROM f WHERE k <> 250000""")
def placebo_share(spark, sf_dir):
    others = [t for t in _CANDIDATES if t != 250_000.0]
    return shown(bunching.placebo_test(load(spark, sf_dir, "orders"), "o_totalprice", 250_000.0, others, _WINDOW))


@query(f"""WITH t AS (SELECT * FROM (VALUES ('price', 250000.0, 'o_totalprice'), ('far', 900000000.0, 'o_totalprice')) v(id, threshold, variable)),
x AS (SELECT o_totalprice, threshold, id FROM orders CROSS JOIN t WHERE threshold < 1000000), {_dense("id", "o_totalprice", "x", "threshold", 10000.0)}, {_fit(2, 2)}
SELECT k AS id, {r6("n")} AS n, {r6("e / h")} AS normalized_excess FROM f""")
def catalogue_scan(spark, sf_dir):
    entry = lambda i, v, t: (i, v, t, "notch", "above", "bonus", "rule", ["size"], "unverified", "")
    listed = spark.createDataFrame([entry("price", "o_totalprice", 250_000.0), entry("far", "o_totalprice", 9e8), entry("gone", "no_column", 1.0)], catalogue.SCHEMA)
    return shown(catalogue.scan_all(load(spark, sf_dir, "orders"), listed, _WINDOW), "id", "n", "normalized_excess")


_SHUFFLE = seeding.uniform_sql("'11'", "r", "event_id")


@query(f"""WITH x AS (SELECT event_id, event_type AS g, value AS x FROM events WHERE event_type IN ('click', 'purchase')), z AS (SELECT x.*, r FROM x CROSS JOIN range(1, 200) t(r)),
b AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY {_SHUFFLE}, event_id) AS p FROM z),
k AS (SELECT count(*) FILTER (g = 'click') AS n1, count(*) AS n, avg(x) FILTER (g = 'purchase') - avg(x) FILTER (g = 'click') AS v FROM x),
s AS (SELECT r, avg(x) FILTER (p > n1) - avg(x) FILTER (p <= n1) AS v FROM b CROSS JOIN k GROUP BY r)
SELECT {r6("max(k.v)")} AS statistic, max(n) AS n, {r6("(1 + count(*) FILTER (abs(s.v) >= abs(k.v) - 1e-12)) / 200.0")} AS pvalue FROM s CROSS JOIN k""")
def permutation_diff(spark, sf_dir):
    events = load(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    return shown(bunching.permutation_test(events, "value", "event_type", "event_id", 199, 11), "statistic", "n", "pvalue")


@query()
def bunching_bootstrap(spark, sf_dir):
    return shown(bunching.bootstrap_bunching(load(spark, sf_dir, "events"), "value", 50.0, bunching.Window.of(2.0, 4.0, 4.0, poly_degree=5), ["event_type"]))
