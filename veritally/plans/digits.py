"""Digit queries."""

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import digits
from .registry import load, query, r6, shown


def _digit(x: str, position: str) -> str:
    m = f"({x} / power(10.0, floor(log10({x}))))"
    m = f"(CASE WHEN {m} >= 10 THEN {m} / 10 WHEN {m} < 1 THEN {m} * 10 ELSE {m} END)"
    both = f"CAST(least(99, greatest(10, floor(round(round({m}, 12) * 10, 9)))) AS BIGINT)"
    return {"first_two": both, "first": f"({both} // 10)", "second": f"({both} % 10)"}[position]


def _expected(position: str) -> str:
    if position == "second":
        return "SELECT CAST(b % 10 AS BIGINT) AS digit, sum(log10(1 + 1.0 / b)) AS share FROM range(10, 100) t(b) GROUP BY 1"
    low, high = (1, 10) if position == "first" else (10, 100)
    return f"SELECT CAST(d AS BIGINT) AS digit, log10(1 + 1.0 / d) AS share FROM range({low}, {high}) t(d)"


def _table(source: str, key: str, x: str, position: str, weight: str = "1.0") -> str:
    usable = f"{x} > 0" + (f" AND abs({x} - {_digit(x, 'first')} * power(10.0, floor(log10({x})))) > 1e-12 * {x}" if position == "second" else "")
    return f"""
e AS ({_expected(position)}),
v AS (SELECT {key} AS k, {_digit(x, position)} AS digit, {weight} AS w FROM {source} WHERE {usable}),
c AS (SELECT k, digit, sum(w) AS o FROM v GROUP BY k, digit),
t AS (SELECT k, count(*) AS n, sum(w) AS total, sum(w) * sum(w) / sum(w * w) AS eff FROM v GROUP BY k),
d AS (SELECT t.k, e.digit, t.n, t.total, t.eff, coalesce(c.o, 0) AS o, e.share FROM t CROSS JOIN e LEFT JOIN c ON c.k = t.k AND c.digit = e.digit)"""


def _counts(position: str):
    def run(spark, sf_dir):
        table = digits.digit_table(load(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], position)
        return shown(table.select("o_orderpriority", "digit", "observed", "expected", "observed_prop", "expected_prop", "n"))

    run.__name__ = f"digit_{position}_counts"
    sql = f"""WITH {_table("orders", "o_orderpriority", "o_totalprice", position)}
SELECT k AS o_orderpriority, digit, {r6("o")} AS observed, {r6("share * total")} AS expected, {r6("o / total")} AS observed_prop, {r6("share")} AS expected_prop, n FROM d"""
    query(sql)(run)


for _position in digits.SUPPORT:
    _counts(_position)

_LINES = _table("lineitem", "l_returnflag", "l_extendedprice", "first")


@query(f"""WITH {_LINES},
s AS (SELECT k, max(n) AS n, max(total) * sum((o / total - share) * (o / total - share) / share) AS x FROM d GROUP BY k)
SELECT k AS l_returnflag, n, {r6("x")} AS chi2, CAST(8 AS BIGINT) AS df,
       {r6("exp(-x / 2) * (1 + x / 2 + (x / 2) * (x / 2) / 2 + (x / 2) * (x / 2) * (x / 2) / 6)")} AS chi2_pvalue FROM s""")
def benford_chi2(spark, sf_dir):
    found = digits.benford_test(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return shown(found, "l_returnflag", "n", "chi2", "df", "chi2_pvalue")


@query(f"""WITH {_LINES}, s AS (SELECT k, avg(abs(o / total - share)) AS mad FROM d GROUP BY k)
SELECT k AS l_returnflag, {r6("mad")} AS mad, CASE WHEN mad < 0.006 THEN 'close conformity' WHEN mad < 0.012 THEN 'acceptable conformity'
       WHEN mad < 0.015 THEN 'marginally acceptable conformity' ELSE 'nonconformity' END AS conformity FROM s""")
def benford_mad_band(spark, sf_dir):
    return shown(digits.benford_test(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), "l_returnflag", "mad", "conformity")


@query(f"""WITH {_LINES},
w AS (SELECT k, n, sum(o / total - share) OVER (PARTITION BY k ORDER BY digit) AS step FROM d),
s AS (SELECT k, max(n) AS n, greatest(max(step), 0) AS up, greatest(max(-step), 0) AS down FROM w GROUP BY k),
l AS (SELECT *, up + down AS v, (sqrt(n) + 0.155 + 0.24 / sqrt(n)) * (up + down) AS lam FROM s),
p AS (SELECT k, sum(CASE WHEN 2.0 * j * j * lam * lam <= 700 THEN (8.0 * j * j * lam * lam - 2) * exp(-2.0 * j * j * lam * lam) ELSE 0 END) AS total
      FROM l CROSS JOIN range(1, 101) t(j) GROUP BY k)
SELECT l.k AS l_returnflag, {r6("v")} AS kuiper_v, {r6("up")} AS d_plus, {r6("down")} AS d_minus,
       {r6("CASE WHEN lam < 0.4 THEN 1 ELSE least(1, greatest(0, total)) END")} AS kuiper_pvalue FROM l JOIN p USING (k)""")
def benford_kuiper(spark, sf_dir):
    return shown(digits.benford_test(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), "l_returnflag", "kuiper_v", "d_plus", "d_minus", "kuiper_pvalue")


@query(f"""WITH {_table("lineitem", "l_returnflag", "l_extendedprice", "first", "l_quantity")}
SELECT k AS l_returnflag, max(n) AS n, {r6("max(eff)")} AS effective_n, {r6("max(eff) * sum((o / total - share) * (o / total - share) / share)")} AS chi2 FROM d GROUP BY k""")
def benford_weighted_kish(spark, sf_dir):
    found = digits.benford_test(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], weight="l_quantity")
    return shown(found, "l_returnflag", "n", "effective_n", "chi2")


@query(f"""WITH {_table("orders", "o_orderpriority", "o_totalprice", "first_two")}
SELECT k AS o_orderpriority, max(n) AS n, {r6("max(eff) * sum((o / total - share) * (o / total - share) / share)")} AS chi2,
       CAST(89 AS BIGINT) AS df, {r6("avg(abs(o / total - share))")} AS mad FROM d GROUP BY k""")
def benford_first_two(spark, sf_dir):
    found = digits.benford_test(load(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], "first_two")
    return shown(found, "o_orderpriority", "n", "chi2", "df", "mad")


def _terminal(k: int):
    cells = 10**k

    def run(spark, sf_dir):
        cents = load(spark, sf_dir, "lineitem").select("l_linestatus", F.rint(F.col("l_extendedprice") * 100).alias("cents"))
        found = digits.terminal_digit_test(cents, "cents", ["l_linestatus"], k)
        return shown(found, "l_linestatus", "n", "chi2", "df", "max_abs_dev", "max_excess", "max_excess_cell")

    run.__name__ = f"terminal_digit_chi2_k{k}"
    query(f"""
WITH v AS (SELECT l_linestatus AS k, CAST(abs(round_even(l_extendedprice * 100, 0)) AS BIGINT) % {cells} AS cell FROM lineitem),
t AS (SELECT k, count(*) AS n FROM v GROUP BY k), c AS (SELECT k, cell, count(*) AS o FROM v GROUP BY k, cell),
d AS (SELECT t.k, CAST(s.cell AS BIGINT) AS cell, n, coalesce(o, 0) / n - {1 / cells!r} AS gap FROM t CROSS JOIN range(0, {cells}) s(cell) LEFT JOIN c ON c.k = t.k AND c.cell = s.cell)
SELECT k AS l_linestatus, max(n) AS n, {r6(f"max(n) * sum(gap * gap * {cells})")} AS chi2, CAST({cells - 1} AS BIGINT) AS df, {r6("max(abs(gap))")} AS max_abs_dev,
       {r6("max(gap)")} AS max_excess, arg_max(cell, (gap, -cell)) AS max_excess_cell FROM d GROUP BY k""")(run)


_terminal(1)
_terminal(2)


@query(f"""
WITH v AS (SELECT l_linestatus AS k, CAST(abs(round_even(l_extendedprice * 100, 0)) AS BIGINT) % 100 AS p FROM lineitem),
s AS (SELECT k, count(*) AS n, avg(CASE WHEN p // 10 = p % 10 THEN 1.0 ELSE 0 END) AS r, avg(CASE WHEN abs(p // 10 - p % 10) = 1 THEN 1.0 ELSE 0 END) AS a FROM v GROUP BY k)
SELECT k AS l_linestatus, n, {r6("r")} AS repeated, {r6("a")} AS adjacent, {r6("(r - 0.10) / sqrt(0.10 * 0.90 / n)")} AS repeated_z,
       {r6("(a - 0.18) / sqrt(0.18 * 0.82 / n)")} AS adjacent_z FROM s""")
def terminal_pair(spark, sf_dir):
    cents = load(spark, sf_dir, "lineitem").select("l_linestatus", F.rint(F.col("l_extendedprice") * 100).alias("cents"))
    return shown(digits.terminal_pair_test(cents, "cents", ["l_linestatus"]), "l_linestatus", "n", "repeated", "adjacent", "repeated_z", "adjacent_z")


@query(f"""WITH {_LINES} SELECT k AS l_returnflag, max(n) AS n, {r6("max(n) * sum((o / total - share) * (o / total - share) / share)")} AS chi2, {r6("avg(abs(o / total - share))")} AS mad FROM d GROUP BY k""")
def sql_leading_digits(spark, sf_dir):
    """By a table function in SQL."""
    tables.register_tables(spark)
    load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("x")).createOrReplaceTempView("vt_values")
    return shown(spark.sql("SELECT k AS l_returnflag, n, chi2, mad FROM vt_leading_digits(TABLE(vt_values) PARTITION BY k)"))
