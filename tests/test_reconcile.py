"""Correlated flows, constants and unmeasured edges against dense algebra."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.core.graph import components
from veritally.operators import reconcile

EDGES = [("e1", "ENV", "A"), ("e2", "A", "B"), ("e3", "A", "C"), ("e4", "B", "D"), ("e5", "C", "D"), ("e6", "D", "ENV"), ("e7", "B", "C")]
NODES = ["A", "B", "C", "D"]


def matrix(edges, nodes):
    return np.array([[(t == n) - (s == n) for _, s, t in edges] for n in nodes], float)


def random_covariance(rng, n):
    root = rng.normal(size=(n, n))
    return root @ root.T + n * np.eye(n)


@pytest.fixture(scope="module")
def system(spark):
    """Two systems of one network with covariances and constants of their own."""
    rng = np.random.default_rng(3)
    out = {}
    for name in ("x", "y"):
        out[name] = (rng.normal(50, 10, len(EDGES)), random_covariance(rng, len(EDGES)), rng.normal(0, 3, len(NODES)))
    each = lambda make: [(name, *row) for name, parts in out.items() for row in make(*parts)]
    edges = spark.createDataFrame([(name, *e) for name in out for e in EDGES], "system_id string, edge string, source string, target string")
    flows = spark.createDataFrame(each(lambda y, s, b: [(e[0], float(v), float(s[i, i] ** 0.5)) for i, (e, v) in enumerate(zip(EDGES, y, strict=True))]), "system_id string, edge string, value double, sigma double")
    pairs = [(i, j) for i, j in itertools.combinations(range(len(EDGES)), 2)]
    covariances = spark.createDataFrame(each(lambda y, s, b: [(EDGES[j][0], EDGES[i][0], float(s[i, j])) for i, j in pairs]), "system_id string, edge string, other string, value double")
    constants = spark.createDataFrame(each(lambda y, s, b: [(n, float(v)) for n, v in zip(NODES, b, strict=True)]), "system_id string, node string, value double")
    return out, edges, flows, covariances, constants


def test_correlated_flows_with_constants(system):
    parts, edges, flows, covariances, constants = system
    found = {(r.system_id, r.edge): r for r in reconcile.reconcile(edges, flows, covariances=covariances, constants=constants).collect()}
    nodal = {(r.system_id, r.node): r for r in reconcile.nodal_test(edges, flows, covariances=covariances, constants=constants).collect()}
    rows = {(r.system_id, r.node): r for r in reconcile.constraints(edges, flows, covariances=covariances, constants=constants).collect()}
    a = matrix(EDGES, NODES)
    for name, (y, s, b) in parts.items():
        v = a @ s @ a.T
        move = -s @ a.T @ np.linalg.solve(v, a @ y - b)
        spread = np.diag(s @ a.T @ np.linalg.solve(v, a @ s))
        for i, e in enumerate(EDGES):
            r = found[name, e[0]]
            assert r.reconciled == pytest.approx(y[i] + move[i]) and r.z == pytest.approx(move[i] / spread[i] ** 0.5)
            assert r.objective == pytest.approx((a @ y - b) @ np.linalg.solve(v, a @ y - b)) and r.dof == 4
        for i, n in enumerate(NODES):
            r, k = nodal[name, n], rows[name, n]
            assert r.residual == pytest.approx((a @ y - b)[i]) == k.residual and r.sd == pytest.approx(v[i, i] ** 0.5) == k.sd
            assert k.constant == pytest.approx(b[i]) and k.violation < 1e-8 and k.z == pytest.approx(r.z)


def test_diagonal_is_the_default(system):
    _, edges, flows, covariances, _ = system
    plain = sorted(map(tuple, reconcile.reconcile(edges, flows).collect()))
    assert sorted(map(tuple, reconcile.reconcile(edges, flows, covariances=covariances.limit(0)).collect())) == plain
    own = flows.select("system_id", "edge", F.col("edge").alias("other"), (F.col("sigma") * F.col("sigma")).alias("value"))
    again = reconcile.reconcile(edges, flows.withColumn("sigma", F.lit(1.0)), covariances=own)  # given variances go before sigma
    assert [r[:2] for r in sorted(map(tuple, again.collect()))] == [r[:2] for r in plain]
    assert [r[3] for r in sorted(map(tuple, again.collect()))] == pytest.approx([r[3] for r in plain])
    a, b = (sorted(map(tuple, t.collect())) for t in (reconcile.nodal_test(edges, flows), reconcile.nodal_test(edges, flows, covariances=own)))
    assert [r[:2] for r in a] == [r[:2] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b])


def test_refusals(spark, system):
    _, edges, flows, covariances, constants = system
    one = lambda *rows: spark.createDataFrame(rows, "system_id string, edge string, other string, value double")
    fixed = lambda *rows: spark.createDataFrame(rows, "system_id string, node string, value double")
    cases = [
        ({"covariances": one(("x", "e1", "e2", 1e9))}, "positive definite"), ({"covariances": one(("x", "e1", "zz", 1.0))}, "isn't there"),
        ({"covariances": one(("x", "e1", "e2", 1.0), ("x", "e2", "e1", 2.0))}, "differ"), ({"covariances": one(("x", "e1", "e1", -1.0))}, "positive"),
        ({"constants": fixed(("x", "Q", 1.0))}, "belong to a node"), ({"constants": fixed(("x", "A", 1.0), ("x", "A", 1.0))}, "repeats"),
    ]
    for options, message in cases:
        with pytest.raises(Exception, match=message):
            reconcile.reconcile(edges, flows, **options).collect()
    with pytest.raises(Exception, match="differ"):
        reconcile.nodal_test(edges, flows, covariances=one(("x", "e1", "e2", 1.0), ("x", "e2", "e1", 2.0))).collect()
    closed = spark.createDataFrame([("c", "p", "A", "B"), ("c", "q", "B", "A")], "system_id string, edge string, source string, target string")
    values = spark.createDataFrame([("c", "p", 1.0, 1.0), ("c", "q", 1.0, 1.0)], "system_id string, edge string, value double, sigma double")
    with pytest.raises(Exception, match="contradict"):  # a closed loop can't lose anything
        reconcile.reconcile(closed, values, constants=fixed(("c", "A", 5.0))).collect()


@pytest.mark.parametrize("gone", [["e2"], ["e2", "e4"], ["e1"], ["e7", "e5"], ["e2", "e3", "e4", "e5", "e7"], []])
def test_contraction_equals_projection(spark, system, gone):
    """The least-squares problem on the contracted network is that of the projected matrix."""
    parts, edges, flows, _, constants = system
    left = [e for e in EDGES if e[0] not in gone]
    unmeasured = spark.createDataFrame([(s, g) for s in ("x", "y") for g in gone], "system_id string, edge string")
    network, fixed = reconcile.contract(edges, unmeasured, constants=constants)
    used = flows.join(network.select("system_id", "edge"), ["system_id", "edge"], "left_semi")
    found = {(r.system_id, r.edge): r for r in reconcile.reconcile(network, used, constants=fixed).collect()}
    for name, (y, s, b) in parts.items():
        a, rest = reconcile.project_unmeasured(matrix(EDGES, NODES), b, [i for i, e in enumerate(EDGES) if e[0] in gone])
        keep = [i for i, e in enumerate(EDGES) if e[0] not in gone]
        want = reconcile.solve(y[keep], a, np.diag(np.diag(s)[keep]), rest)
        for i, e in enumerate(left):
            if (name, e[0]) in found:
                r = found[name, e[0]]
                assert r.reconciled == pytest.approx(want["x"][i]) and r.objective == pytest.approx(want["objective"]) and r.dof == want["dof"]
            else:
                assert np.isnan(want["z"][i]) and want["move"][i] == pytest.approx(0, abs=1e-9)  # cancels: not redundant


def test_merged_balance_without_flows(spark):
    edges = spark.createDataFrame([("s", "a", "N", "M"), ("s", "b", "ENV", "K"), ("s", "c", "K", "ENV")], "system_id string, edge string, source string, target string")
    gone = spark.createDataFrame([("s", "a")], "system_id string, edge string")
    fixed = lambda n, m: spark.createDataFrame([("s", "N", n), ("s", "M", m), ("s", "K", 1.0)], "system_id string, node string, value double")
    network, constants = reconcile.contract(edges, gone, constants=fixed(2.0, -2.0))
    assert {r.edge for r in network.collect()} == {"b", "c"} and [(r.node, r.value) for r in constants.collect()] == [("K", 1.0)]
    with pytest.raises(Exception, match="constant other than zero"):
        reconcile.contract(edges, gone, constants=fixed(2.0, 0.0))[1].collect()
    with pytest.raises(reconcile.AnalysisError, match="constant other than zero"):
        reconcile.project_unmeasured(np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), np.array([1.0, 0.0, 0.0]), [0])
    with pytest.raises(reconcile.AnalysisError):
        reconcile.project_unmeasured(np.eye(2), np.zeros(2), [2])


def test_elimination_of_correlated_flows(system):
    """The first removal is the flow with the largest test under the whole covariance."""
    parts, edges, flows, covariances, constants = system
    moved = flows.withColumn("value", F.when(F.col("edge") == "e2", F.col("value") + 400).otherwise(F.col("value")))
    first = {r.system_id: r for r in reconcile.serial_elimination(edges, moved, covariances=covariances, constants=constants).where("order_removed = 1").collect()}
    tests = reconcile.reconcile(edges, moved, covariances=covariances, constants=constants).collect()
    for name in parts:
        worst = max((r for r in tests if r.system_id == name), key=lambda r: abs(r.z))
        assert first[name].edge == worst.edge and first[name].z == pytest.approx(worst.z)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)] + [(rng.randrange(1000, 1040), rng.randrange(1000, 1040)) for _ in range(25)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == root
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
