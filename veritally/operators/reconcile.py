"""Flow reconciliation: balances of a network, least-squares adjustment, and gross errors.

Edges (system, edge, source, target) and flows (system, edge, value, sigma) are tables; each system is
one small dense problem, solved in one group. Two more tables are optional:

* covariances (system, edge, other, value): entries of the covariance of the flows, in any order and either triangle. An entry of an
  edge with itself replaces its sigma squared; entries that aren't there are zero. The matrix of a system must be positive definite.
* constants (system, node, value): what the balance of a node must come to; zero where there is none.

The nodal test and the contraction of unmeasured edges need no solution and are relational, whatever the size of a network.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import special
from ..core.errors import AnalysisError, require
from ..core.graph import components

ENVIRONMENT = "ENV"
RCOND = 1e-12


def named_edges(edges: DataFrame, system: str = "system_id") -> DataFrame:
    """Edges with distinct names: repeats get #2, #3, ... ; an edge from a node to itself is refused."""
    loop = F.raise_error(F.lit("an edge leads from a node to itself")).cast("string")
    name = F.coalesce("edge", F.concat_ws("->", "source", "target")) if "edge" in edges.columns else F.concat_ws("->", "source", "target")
    rows = edges.select(system, name.alias("edge"), F.when(F.col("source") == F.col("target"), loop).otherwise(F.col("source")).alias("source"), "target")
    nth = F.row_number().over(W.partitionBy(system, "edge").orderBy("source", "target"))
    return rows.withColumn("_nth", nth).select(system, F.when(F.col("_nth") > 1, F.concat("edge", F.lit("#"), "_nth")).otherwise(F.col("edge")).alias("edge"), "source", "target")


def incidence(edges: DataFrame, system: str = "system_id", environment: str = ENVIRONMENT) -> DataFrame:
    """(system, node, edge, sign): +1 into a node, -1 out of it; the environment has no balance."""
    into = edges.select(system, F.col("target").alias("node"), "edge", F.lit(1).alias("sign"))
    out = edges.select(system, F.col("source").alias("node"), "edge", F.lit(-1).alias("sign"))
    return into.union(out).where(F.col("node") != environment)


def covariance_entries(flows: DataFrame, covariances: DataFrame | None = None, system: str = "system_id") -> DataFrame:
    """(system, edge, other, value) of all non-zero entries, both triangles; entries given twice must agree."""
    own = flows.select(system, "edge", F.col("edge").alias("other"), (F.col("sigma").cast("double") * F.col("sigma")).alias("value"), F.lit(0).alias("given"))
    if covariances is None:
        return own.drop("given")
    listed = covariances.select(system, "edge", "other", F.col("value").cast("double").alias("value"), F.lit(1).alias("given"))
    turned = listed.where("edge <> other").select(system, F.col("other").alias("edge"), F.col("edge").alias("other"), "value", "given")
    entries = own.union(listed).union(turned).groupBy(system, "edge", "other").agg(F.max(F.struct("given", "value")).alias("top"), F.min(F.when(F.col("given") == 1, F.col("value"))).alias("low"))
    same = (F.col("top.given") == 0) | (F.abs(F.col("top.value") - F.col("low")) <= 1e-8 * F.abs("low") + 1e-12)
    value = F.when(same, F.col("top.value")).otherwise(F.raise_error(F.lit("entries of a covariance differ")).cast("double"))
    return entries.select(system, "edge", "other", value.alias("value"))


def nodal_test(edges: DataFrame, flows: DataFrame, alpha: float = 0.05, correction: str = "none", n_tests: int = 1, system: str = "system_id", environment: str = ENVIRONMENT, covariances: DataFrame | None = None, constants: DataFrame | None = None) -> DataFrame:
    """Imbalance of every node in standard deviations. Correlated flows of a node count with their covariances."""
    critical, _ = special.critical_z(alpha, n_tests, correction)
    signs = incidence(edges, system, environment)
    rows = signs.join(flows, [system, "edge"])
    out = rows.groupBy(system, "node").agg(F.sum(F.col("sign") * F.col("value")).alias("residual"), F.sum(F.col("sigma") * F.col("sigma")).alias("variance"), F.count("*").alias("n_edges"))
    if covariances is not None:
        entries = covariance_entries(flows, covariances, system)
        right = signs.select(F.col(system).alias("_s"), F.col("node").alias("_n"), F.col("edge").alias("_e"), F.col("sign").alias("_sign"))
        one = signs.join(entries, [system, "edge"])
        two = one.join(right, (F.col(system) == F.col("_s")) & (F.col("node") == F.col("_n")) & (F.col("other") == F.col("_e")))
        out = out.drop("variance").join(two.groupBy(system, "node").agg(F.sum(F.col("sign") * F.col("_sign") * F.col("value")).alias("variance")), [system, "node"])
    if constants is not None:
        out = out.join(constants.select(system, "node", F.col("value").alias("_b")), [system, "node"], "left").withColumn("residual", F.col("residual") - F.coalesce("_b", F.lit(0.0))).drop("_b")
    out = out.select(system, "node", "residual", F.sqrt("variance").alias("sd"), "n_edges")
    out = out.withColumn("z", F.col("residual") / F.when(F.col("sd") > 0, F.col("sd")))
    return out.withColumn("flag", F.coalesce(F.abs("z") > critical, F.lit(False)))


def contract(edges: DataFrame, unmeasured: DataFrame, system: str = "system_id", environment: str = ENVIRONMENT, constants: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The network that the measured edges balance in, and its constants, when the edges of ``unmeasured`` (system, edge) have no value.

    An unmeasured edge makes its two nodes one balance: their sum is the only constraint in which it cancels. So nodes joined by such edges are
    contracted, through connected components over all systems at once; what is joined to the environment has no balance. A merged node has the smallest
    name among its members, and the sum of their constants. A measured edge within a merged node cancels as well: it is left out
    and can't be checked. A merged node without a measured edge left must have constants of zero.
    """
    node = lambda c: F.struct(F.col(system).alias("system"), (F.col(c) != environment).alias("inner"), F.col(c).alias("name"))  # noqa: E731  the environment comes first
    gone = edges.join(unmeasured.select(system, "edge").distinct(), [system, "edge"], "left_semi")
    merged = components(gone.select(node("source").alias("u"), node("target").alias("v")))
    names = merged.select(F.col("node.system").alias("_system"), F.col("node.name").alias("_node"), F.col("root.name").alias("_root"))
    kept = edges.join(unmeasured.select(system, "edge").distinct(), [system, "edge"], "left_anti")
    for end in ("source", "target"):
        kept = kept.join(names, (F.col(system) == F.col("_system")) & (F.col(end) == F.col("_node")), "left").withColumn(end, F.coalesce("_root", end)).drop("_system", "_node", "_root")
    network = kept.where(F.col("source") != F.col("target")).select(system, "edge", "source", "target")
    if constants is None:
        return network, edges.sparkSession.createDataFrame([], f"`{system}` {dict(edges.dtypes)[system]}, node string, value double")
    sums = constants.join(names, (F.col(system) == F.col("_system")) & (F.col("node") == F.col("_node")), "left").select(system, F.coalesce("_root", "node").alias("node"), F.col("value").cast("double").alias("value"))
    sums = sums.where(F.col("node") != environment).groupBy(system, "node").agg(F.sum("value").alias("value"), F.max(F.abs("value")).alias("scale"))
    alive = incidence(network, system, environment).select(system, "node").distinct().withColumn("_alive", F.lit(True))
    void = F.col("_alive").isNull() & (F.abs("value") > 1e-6 * F.greatest(F.lit(1.0), F.col("scale")))
    value = F.when(void, F.raise_error(F.lit("a balance without a measured flow has a constant other than zero")).cast("double")).otherwise(F.col("value"))
    checked = sums.join(alive, [system, "node"], "left").select(system, "node", value.alias("value"), "_alive")
    return network, checked.where((F.col("value") != 0) | F.col("_alive")).select(system, "node", "value")


def solve(y: np.ndarray, a: np.ndarray, s: np.ndarray, b: np.ndarray) -> dict:
    """Adjusted values, standardised adjustments (NaN if not redundant), objective and degrees of freedom."""
    v = a @ s @ a.T
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    keep = values > RCOND * max(values.max(initial=0), 0)
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    residual = a @ y - b
    gap = residual - vectors[:, keep] @ (vectors[:, keep].T @ residual)
    require(bool(np.abs(gap).max(initial=0) <= 1e-6 * max(1.0, np.abs(residual).max(initial=0))), "the constraints contradict each other")
    gain = s @ a.T @ inverse
    move = -gain @ residual
    spread = gain @ a @ s
    var = np.clip(np.diag((spread + spread.T) / 2), 0, None)
    testable = var > RCOND * np.diag(s)
    z = np.where(testable, move / np.sqrt(np.where(testable, var, 1)), np.nan)
    return {"x": y + move, "move": move, "z": z, "objective": float(residual @ inverse @ residual), "dof": int(keep.sum())}


def project_unmeasured(a: np.ndarray, b: np.ndarray, unmeasured: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Constraints among the measured columns: combinations in which the unmeasured cancel. For general matrices; networks are contracted."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    require(len(set(unmeasured)) == len(unmeasured) and all(0 <= j < a.shape[1] for j in unmeasured), "unmeasured columns must be there, and once only")
    measured = np.delete(a, unmeasured, axis=1)
    if not unmeasured:
        return measured, b
    u, values, _ = np.linalg.svd(a[:, unmeasured])
    rank = int((values > 1e-10 * values.max(initial=0)).sum()) if len(values) else 0
    null = u[:, rank:]
    reduced, fixed = null.T @ measured, null.T @ b
    scale = 1e-10 * max(1.0, np.abs(measured).max(initial=0))
    keep = np.abs(reduced).max(axis=1, initial=0) > scale
    require(bool(np.abs(fixed[~keep]).max(initial=0) <= 1e-6 * max(1.0, np.abs(b).max(initial=0))), "a balance without a measured flow has a constant other than zero")
    return np.where(np.abs(reduced[keep]) > scale, reduced[keep], 0.0), fixed[keep]


def covariance(names: list[str], sigma: np.ndarray, entries: pd.DataFrame | None = None) -> np.ndarray:
    """The covariance of the named flows, from standard deviations and listed entries; it must be symmetric and positive definite."""
    out, given = np.diag(np.asarray(sigma, float) ** 2), np.zeros((len(names),) * 2, bool)
    if entries is not None and len(entries):
        place = {n: i for i, n in enumerate(names)}
        for a, b, value in zip(entries["edge"], entries["other"], entries["value"], strict=True):
            require(a in place and b in place, f"a covariance names a flow that isn't there: {a!r}, {b!r}")
            i, j = place[a], place[b]
            require(bool(np.isfinite(value)), "covariances must be finite")
            require(not given[i, j] or bool(abs(out[i, j] - value) <= 1e-8 * abs(value) + 1e-12), f"entries of a covariance differ: {a!r}, {b!r}")
            out[i, j] = out[j, i] = value
            given[i, j] = given[j, i] = True
    require(bool(np.isfinite(np.diag(out)).all() and (np.diag(out) > 0).all()), "values must be finite and sigmas positive")
    try:
        np.linalg.cholesky(out)
    except np.linalg.LinAlgError:
        raise AnalysisError("the covariance isn't positive definite") from None
    return out


def _problem(parts: dict[str, pd.DataFrame], environment: str):
    """(names, values, nodes, incidence matrix, covariance, constants) of one system."""
    flows, edges = parts["flow"].sort_values("edge"), parts["edge"]
    names = flows["edge"].tolist()
    require(len(set(names)) == len(names), "a flow repeats")
    ends = {e: (s, t) for e, s, t in zip(edges["edge"], edges["source"], edges["other"], strict=True)}
    require(set(names) == set(ends), f"flows and edges differ: {sorted(set(names) ^ set(ends))[:5]}")
    require(bool(np.isfinite(flows["value"].to_numpy(float)).all()), "values must be finite and sigmas positive")
    nodes = sorted({n for pair in ends.values() for n in pair} - {environment})
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(names)))
    for j, e in enumerate(names):
        for node, sign in ((ends[e][1], 1.0), (ends[e][0], -1.0)):
            if node != environment:
                a[at[node], j] += sign
    b = np.zeros(len(nodes))
    fixed = parts["constant"]
    require(fixed["source"].is_unique, "a constant repeats")
    for node, value in zip(fixed["source"], fixed["value"], strict=True):
        require(node in at and bool(np.isfinite(value)), f"a constant must be finite and belong to a node; got {node!r}, {value}")
        b[at[node]] = value
    return names, flows["value"].to_numpy(float), nodes, a, covariance(names, flows["sigma"].to_numpy(float), parts["covariance"]), b


def _systems(edges: DataFrame, flows: DataFrame, system: str, function, schema: str, covariances: DataFrame | None, constants: DataFrame | None) -> DataFrame:
    """``function`` on each system: rows of all four tables meet by the system, each with its kind."""
    kind, none = dict(flows.dtypes)[system], F.lit(None)

    def rows(df: DataFrame, name: str, edge=none, source=none, other=none, value=none, sigma=none) -> DataFrame:
        texts = [F.lit(name).alias("kind"), edge.cast("string").alias("edge"), source.cast("string").alias("source"), other.cast("string").alias("other")]
        return df.select(F.col(system).alias("_system"), *texts, value.cast("double").alias("value"), sigma.cast("double").alias("sigma"))

    c = F.col
    parts = [rows(flows, "flow", c("edge"), value=c("value"), sigma=c("sigma")), rows(edges, "edge", c("edge"), c("source"), c("target"))]
    if covariances is not None:
        parts.append(rows(covariances, "covariance", c("edge"), other=c("other"), value=c("value")))
    if constants is not None:
        parts.append(rows(constants, "constant", source=c("node"), value=c("value")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = function({k: frame[frame["kind"] == k] for k in ("flow", "edge", "covariance", "constant")})
        out.insert(0, system, frame["_system"].iloc[0])
        return out

    return both.groupBy("_system").applyInPandas(one, f"`{system}` {kind}, {schema}")


MEASUREMENTS = "edge string, value double, reconciled double, adjustment double, z double, redundant boolean, critical double, flag boolean, objective double, dof int"


def reconcile(edges: DataFrame, flows: DataFrame, alpha: float = 0.05, correction: str = "sidak", system: str = "system_id", environment: str = ENVIRONMENT, covariances: DataFrame | None = None, constants: DataFrame | None = None) -> DataFrame:
    """A row for each flow of each system: adjusted value and the test of its adjustment.

    Missing, unknown or repeated edges are refused, as are constants that no flows can meet. The family of tests of a system
    is its testable flows.
    """

    def one(parts: dict[str, pd.DataFrame]) -> pd.DataFrame:
        names, y, _, a, s, b = _problem(parts, environment)
        found = solve(y, a, s, b)
        z = found["z"]
        critical, _ = special.critical_z(alpha, max(1, int(np.isfinite(z).sum())), correction)
        return pd.DataFrame({
            "edge": names, "value": y, "reconciled": found["x"], "adjustment": found["move"], "z": z, "redundant": np.isfinite(z), "critical": critical,
            "flag": np.nan_to_num(np.abs(z)) > critical, "objective": found["objective"], "dof": found["dof"],
        })

    return _systems(edges, flows, system, one, MEASUREMENTS, covariances, constants)


CONSTRAINTS = "node string, constant double, residual double, sd double, z double, violation double"


def constraints(edges: DataFrame, flows: DataFrame, system: str = "system_id", environment: str = ENVIRONMENT, covariances: DataFrame | None = None, constants: DataFrame | None = None) -> DataFrame:
    """A row for each balance of each system: its residual before, in standard deviations, and what is left of it after reconciling."""

    def one(parts: dict[str, pd.DataFrame]) -> pd.DataFrame:
        _, y, nodes, a, s, b = _problem(parts, environment)
        found, sd = solve(y, a, s, b), np.sqrt(np.diag(a @ s @ a.T))
        residual = a @ y - b
        return pd.DataFrame({"node": nodes, "constant": b, "residual": residual, "sd": sd, "z": residual / np.where(sd > 0, sd, np.nan), "violation": np.abs(a @ found["x"] - b)})

    return _systems(edges, flows, system, one, CONSTRAINTS, covariances, constants)


def global_test(measurements: DataFrame, alpha: float = 0.05, system: str = "system_id") -> DataFrame:
    """Objective of each system against chi-square with its degrees of freedom."""
    out = measurements.groupBy(system).agg(F.max("objective").alias("objective"), F.max("dof").alias("dof"), F.count("*").alias("n"))
    p = F.when(F.col("dof") > 0, special.chi2_sf_column(F.col("objective"), F.greatest(F.col("dof"), F.lit(1)))).otherwise(1.0)
    return out.withColumn("pvalue", p).withColumn("reject", F.col("pvalue") < alpha)


SUSPECTS = "order_removed int, edge string, z double, critical double, objective_before double, objective_after double, pvalue_before double, pvalue_after double, dof_before int, dof_after int"


def serial_elimination(edges: DataFrame, flows: DataFrame, alpha: float = 0.05, max_removals: int | None = None, correction: str = "sidak", elimination: str = "project", system: str = "system_id", environment: str = ENVIRONMENT, covariances: DataFrame | None = None, constants: DataFrame | None = None) -> DataFrame:
    """Flows removed one after the other, the worst first, until the global test passes."""
    require(elimination in ("project", "column"), f"unknown elimination {elimination!r}")

    def one(parts: dict[str, pd.DataFrame]) -> pd.DataFrame:
        names, y, _, a, s, fixed = _problem(parts, environment)
        removed: list[int] = []
        rows: list[list] = []
        while True:
            left = [j for j in range(len(names)) if j not in removed]
            if elimination == "project" and removed:
                current, b = project_unmeasured(a, fixed, removed)
            else:
                current, b = a[:, left], fixed
                if elimination == "column" and not np.abs(current).max(axis=1, initial=0).all():
                    raise AnalysisError("removing this flow leaves a node without any")
            if not len(current):
                break
            found = solve(y[left], current, s[np.ix_(left, left)], b)
            p = special.chi2_sf(found["objective"], found["dof"]) if found["dof"] else 1.0
            if rows:
                rows[-1][5], rows[-1][7], rows[-1][9] = found["objective"], p, found["dof"]
            z = np.nan_to_num(np.abs(found["z"]), nan=-np.inf)
            critical, _ = special.critical_z(alpha, max(1, int(np.isfinite(found["z"]).sum())), correction)
            worst = int(z.argmax())
            if p >= alpha or len(removed) >= (len(names) - 1 if max_removals is None else max_removals) or z[worst] <= critical:
                break
            rows.append([len(rows) + 1, names[left[worst]], float(found["z"][worst]), critical, found["objective"], None, p, None, found["dof"], 0])
            removed.append(left[worst])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SUSPECTS.split(", ")])

    return _systems(edges, flows, system, one, SUSPECTS, covariances, constants)
