"""Reconciliation queries: revenue from supplier nations to customer nations, one system for each region of the customer."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import reconcile
from .registry import load, query, r6, shown

#: Every nation of a region also exchanges with the environment, so each node has a balance.
_SQL = """o AS (SELECT CAST(cn.n_regionkey AS BIGINT) AS system_id, sn.n_name AS source, cn.n_name AS target, sum(l_extendedprice * (1 - l_discount)) / 1000.0 AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  WHERE cn.n_regionkey = sn.n_regionkey AND cn.n_nationkey <> sn.n_nationkey GROUP BY 1, 2, 3),
n AS (SELECT system_id, node, sum(v) AS net FROM (SELECT system_id, target AS node, value AS v FROM o UNION ALL SELECT system_id, source, -value FROM o) GROUP BY 1, 2),
e AS (SELECT system_id, source || '->' || target AS edge, source, target, value FROM o
  UNION ALL SELECT system_id, node || '->ENV', node, 'ENV', net FROM n WHERE net >= 0 UNION ALL SELECT system_id, 'ENV->' || node, 'ENV', node, -net FROM n WHERE net < 0)"""


def _network(spark, sf_dir):
    t = lambda name: load(spark, sf_dir, name)
    cn = t("nation").select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("target"), F.col("n_regionkey").cast("long").alias("system_id"))
    sn = t("nation").select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("source"), F.col("n_regionkey").alias("sr"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    customers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    suppliers = t("supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(customers, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.groupBy("s_nationkey", "c_nationkey").agg(F.sum("r").alias("r")).join(cn, F.col("c_nationkey") == F.col("ck")).join(sn, F.col("s_nationkey") == F.col("sk"))
    o = pairs.where("system_id = sr and ck <> sk").groupBy("system_id", "source", "target").agg((F.sum("r") / 1000.0).alias("value"))
    net = o.select("system_id", F.col("target").alias("node"), F.col("value").alias("v")).union(o.select("system_id", "source", -F.col("value"))).groupBy("system_id", "node").agg(F.sum("v").alias("net"))
    out = net.select("system_id", F.when(F.col("net") >= 0, F.col("node")).otherwise("ENV").alias("source"), F.when(F.col("net") >= 0, "ENV").otherwise(F.col("node")).alias("target"), F.abs("net").alias("value"))
    edges = o.union(out)
    return edges.select("system_id", F.concat_ws("->", "source", "target").alias("edge"), "source", "target", "value")


@query(f"""WITH {_SQL} SELECT system_id, node, edge, CAST(sign AS BIGINT) AS sign FROM (SELECT system_id, target AS node, edge, 1 AS sign FROM e UNION ALL SELECT system_id, source, edge, -1 FROM e) WHERE node <> 'ENV'""")
def incidence_long(spark, sf_dir):
    return shown(reconcile.incidence(reconcile.named_edges(_network(spark, sf_dir).drop("value"))))


def _flows(network, shift: float = 0.0):
    """Standard deviations of one per cent, and one value moved."""
    first = F.col("edge") == F.min("edge").over(W.partitionBy("system_id"))
    return network.select("system_id", "edge", (F.col("value") * F.when(first, 1 + shift).otherwise(1.0)).alias("value"), (F.col("value") * 0.01).alias("sigma"))


@query(f"""WITH {_SQL}, f AS (SELECT *, value * (CASE WHEN edge = min(edge) OVER (PARTITION BY system_id) THEN 1.2 ELSE 1 END) AS v, value * 0.01 AS s FROM e),
i AS (SELECT system_id, target AS node, v, s, 1 AS g FROM f UNION ALL SELECT system_id, source, v, s, -1 FROM f),
z AS (SELECT system_id, node, sum(g * v) AS residual, sqrt(sum(s * s)) AS sd, count(*) AS n_edges FROM i WHERE node <> 'ENV' GROUP BY 1, 2)
SELECT system_id, node, {r6("residual")} AS residual, {r6("sd")} AS sd, n_edges, {r6("residual / sd")} AS z, abs(residual / sd) > 1.959963984540054 AS flag FROM z""")
def nodal_imbalance(spark, sf_dir):
    network = _network(spark, sf_dir)
    return shown(reconcile.nodal_test(network.select("system_id", "edge", "source", "target"), _flows(network, 0.2)))


@query()
def reconcile_flows(spark, sf_dir):
    network = _network(spark, sf_dir)
    return shown(reconcile.reconcile(network, _flows(network, 0.2)))


@query()
def reconcile_global(spark, sf_dir):
    network = _network(spark, sf_dir)
    return shown(reconcile.global_test(reconcile.reconcile(network, _flows(network, 0.2))))


@query()
def serial_elimination(spark, sf_dir):
    network = _network(spark, sf_dir)
    return shown(reconcile.serial_elimination(network, _flows(network, 0.2)))


#: One balance for each nation of customers: revenue by market segment flows in, what is booked flows out, and a twentieth is lost.
_BALANCE = """m AS (SELECT c_nationkey AS system_id, c_mktsegment AS edge, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT CAST(system_id AS BIGINT) AS system_id, edge, value * CASE WHEN edge = 'BUILDING' THEN 1.1 ELSE 1 END AS value, 0.02 * value AS sigma, 1 AS sign FROM m
  UNION ALL SELECT CAST(system_id AS BIGINT), 'booked', 0.95 * sum(value), 0.03 * sum(value), -1 FROM m GROUP BY system_id),
k AS (SELECT system_id, 0.05 * sum(value) FILTER (sign = 1) AS b FROM e GROUP BY system_id),
s AS (SELECT x.system_id, x.edge, y.edge AS other, x.sign * y.sign AS g, x.sigma * y.sigma * CASE WHEN x.edge = y.edge THEN 1.0 WHEN x.sign = 1 AND y.sign = 1 THEN 0.4 ELSE 0 END AS c FROM e x JOIN e y ON x.system_id = y.system_id),
v AS (SELECT system_id, sum(g * c) AS v FROM s GROUP BY system_id),
r AS (SELECT e.system_id, sum(sign * value) - max(b) AS r FROM e JOIN k USING (system_id) GROUP BY e.system_id)"""


def _balance(spark, sf_dir):
    """(edges, flows, covariances, constants): segments of one nation vary together."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    m = orders.groupBy(F.col("c_nationkey").cast("long").alias("system_id"), F.col("c_mktsegment").alias("edge")).agg(F.sum("o_totalprice").alias("value"))
    booked = m.groupBy("system_id").agg(F.sum("value").alias("t")).select("system_id", F.lit("booked").alias("edge"), (0.95 * F.col("t")).alias("value"), (0.03 * F.col("t")).alias("sigma"))
    inflow = m.select("system_id", "edge", (F.col("value") * F.when(F.col("edge") == "BUILDING", 1.1).otherwise(1.0)).alias("value"), (0.02 * F.col("value")).alias("sigma"))
    flows = inflow.union(booked)
    out = F.col("edge") == "booked"
    edges = flows.select("system_id", "edge", F.when(out, "N").otherwise("ENV").alias("source"), F.when(out, "ENV").otherwise("N").alias("target"))
    other = inflow.select(F.col("system_id").alias("s"), F.col("edge").alias("other"), F.col("sigma").alias("sigma_2"))
    pairs = inflow.join(other, (F.col("system_id") == F.col("s")) & (F.col("edge") < F.col("other")))
    constants = inflow.groupBy("system_id").agg((0.05 * F.sum("value")).alias("value")).select("system_id", F.lit("N").alias("node"), "value")
    return edges, flows, pairs.select("system_id", "edge", "other", (0.4 * F.col("sigma") * F.col("sigma_2")).alias("value")), constants


@query(f"""WITH {_BALANCE}, t AS (SELECT s.system_id, s.edge, sum(c * CASE WHEN s.other = 'booked' THEN -1 ELSE 1 END) AS gain FROM s GROUP BY 1, 2)
SELECT e.system_id, e.edge, {r6("value")} AS value, {r6("value - gain * r / v")} AS reconciled, {r6("-gain * r / v")} AS adjustment, {r6("-gain * r / v / sqrt(gain * gain / v)")} AS z, {r6("r * r / v")} AS objective, CAST(1 AS BIGINT) AS dof
FROM e JOIN t USING (system_id, edge) JOIN v USING (system_id) JOIN r USING (system_id)""")
def reconcile_correlated(spark, sf_dir):
    edges, flows, covariances, constants = _balance(spark, sf_dir)
    found = reconcile.reconcile(edges, flows, covariances=covariances, constants=constants)
    return shown(found, "system_id", "edge", "value", "reconciled", "adjustment", "z", "objective", "dof")


@query(f"""WITH {_BALANCE} SELECT system_id, 'N' AS node, {r6("b")} AS constant, {r6("r")} AS residual, {r6("sqrt(v)")} AS sd, {r6("r / sqrt(v)")} AS z, {r6("0")} AS violation FROM v JOIN r USING (system_id) JOIN k USING (system_id)""")
def reconcile_constraints(spark, sf_dir):
    edges, flows, covariances, constants = _balance(spark, sf_dir)
    return shown(reconcile.constraints(edges, flows, covariances=covariances, constants=constants))


@query(f"""WITH {_BALANCE} SELECT system_id, 'N' AS node, {r6("r")} AS residual, {r6("sqrt(v)")} AS sd, n_edges, {r6("r / sqrt(v)")} AS z, abs(r / sqrt(v)) > 1.959963984540054 AS flag
FROM v JOIN r USING (system_id) JOIN (SELECT system_id, count(*) AS n_edges FROM e GROUP BY 1) USING (system_id)""")
def nodal_correlated(spark, sf_dir):
    edges, flows, covariances, constants = _balance(spark, sf_dir)
    return shown(reconcile.nodal_test(edges, flows, covariances=covariances, constants=constants))


#: Flows whose edge has a name that hashes low have no measurement; nodes that they join are merged by walking along them.
_CONTRACTED = f"""WITH RECURSIVE {_SQL}, x AS (SELECT *, substr(md5(edge), 1, 1) IN ('0', '1') AS gone FROM e),
b AS (SELECT system_id, source AS u, target AS v FROM x WHERE gone UNION SELECT system_id, target, source FROM x WHERE gone),
w AS (SELECT system_id, u AS node, u AS seen FROM b UNION SELECT w.system_id, w.node, b.v FROM w JOIN b ON b.system_id = w.system_id AND b.u = w.seen),
g AS (SELECT system_id, node, CASE WHEN bool_or(seen = 'ENV') THEN 'ENV' ELSE min(seen) END AS root FROM w GROUP BY 1, 2),
y AS (SELECT x.system_id, edge, value, coalesce(s.root, source) AS source, coalesce(t.root, target) AS target FROM x
  LEFT JOIN g s ON s.system_id = x.system_id AND s.node = source LEFT JOIN g t ON t.system_id = x.system_id AND t.node = target WHERE NOT gone),
i AS (SELECT system_id, target AS node, value AS v, 1 AS g, 0.01 * value AS s FROM y WHERE source <> target UNION ALL SELECT system_id, source, value, -1, 0.01 * value FROM y WHERE source <> target),
k AS (SELECT x.system_id, coalesce(root, n.node) AS node, sum(10.0) AS b FROM (SELECT DISTINCT system_id, node FROM n) n JOIN (SELECT DISTINCT system_id FROM x) x USING (system_id) LEFT JOIN g ON g.system_id = n.system_id AND g.node = n.node GROUP BY 1, 2)
SELECT i.system_id, i.node, {r6("sum(g * v) - max(b)")} AS residual, {r6("sqrt(sum(s * s))")} AS sd, count(*) AS n_edges, {r6("(sum(g * v) - max(b)) / sqrt(sum(s * s))")} AS z, abs((sum(g * v) - max(b)) / sqrt(sum(s * s))) > 1.959963984540054 AS flag
FROM i JOIN k ON k.system_id = i.system_id AND k.node = i.node WHERE i.node <> 'ENV' GROUP BY 1, 2"""


@query(_CONTRACTED)
def nodal_contracted(spark, sf_dir):
    network = _network(spark, sf_dir)
    gone = F.substring(F.md5("edge"), 1, 1).isin("0", "1")
    nodes = network.select("system_id", F.col("source").alias("node")).union(network.select("system_id", "target")).where("node <> 'ENV'").distinct()
    edges, constants = reconcile.contract(network.select("system_id", "edge", "source", "target"), network.where(gone).select("system_id", "edge"), constants=nodes.withColumn("value", F.lit(10.0)))
    return shown(reconcile.nodal_test(edges, network.select("system_id", "edge", "value", (F.col("value") * 0.01).alias("sigma")), constants=constants))
