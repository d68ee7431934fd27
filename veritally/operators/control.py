"""Controls: does a test reject at its nominal rate where nothing is wrong?"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.columns import double, finite
from ..core.errors import ControlError, require

KINDS = ("external", "within_dataset", "synthetic")
#: Verdicts, the worst first.
VERDICTS = ("anticonservative", "conservative", "calibrated")


def monte_carlo_se(alpha: Column | float, n: Column) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return F.sqrt(a * (1 - a) / n)


def classify(rate: Column, alpha: float, n: Column, tolerance_se: float = 2.0) -> Column:
    slack = tolerance_se * monte_carlo_se(alpha, n)
    return F.when(rate > alpha + slack, VERDICTS[0]).when(rate < alpha - slack, VERDICTS[1]).otherwise(VERDICTS[2])


def _reports(rejected: DataFrame, alpha: float, tolerance_se: float) -> DataFrame:
    require(0 < alpha < 1, f"alpha must lie in (0, 1); got {alpha}", ControlError)
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown control kind "), F.col("kind"))).cast("string"))
    out = rejected.groupBy("control", kind.alias("kind")).agg(F.count("*").alias("n"), F.avg(F.col("rejected").cast("double")).alias("rejection_rate"))
    return out.select("*", F.lit(alpha).alias("nominal_alpha"), (F.col("rejection_rate") - alpha).alias("excess"), classify(F.col("rejection_rate"), alpha, F.col("n"), tolerance_se).alias("verdict"))


def control_report(pvalues: DataFrame, pvalue: str = "pvalue", alpha: float = 0.05, tolerance_se: float = 2.0) -> DataFrame:
    """A row for each control of (control, kind, p-value); rejected means p <= alpha. Missing p-values are refused."""
    p = double(pvalue)
    checked = F.when(finite(p) & (p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("p-values must lie in 0..1")).cast("double"))
    return _reports(pvalues.select("control", "kind", (checked <= alpha).alias("rejected")), alpha, tolerance_se)


def from_rejections(flags: DataFrame, nominal_rate: float, tolerance_se: float = 2.0) -> DataFrame:
    """The same from (control, kind, rejected)."""
    return _reports(flags.select("control", "kind", F.col("rejected").cast("boolean").alias("rejected")), nominal_rate, tolerance_se)


def summary(reports: DataFrame) -> DataFrame:
    """The worst single verdict, never an average, and whether any control is external."""
    severity = F.array_position(F.array(*(F.lit(v) for v in VERDICTS)), F.col("verdict"))
    return reports.agg(F.min_by("verdict", severity).alias("worst_verdict"), F.bool_or(F.col("kind") == "external").alias("has_external_control"))


def anticonservative(reports: DataFrame) -> DataFrame:
    return reports.where(F.col("verdict") == VERDICTS[0]).orderBy(F.col("excess").desc(), "control")


def format_table(reports: Sequence) -> str:
    """Collected reports as text."""
    if not reports:
        return "No controls were run: no detection may be reported."
    lines = [f"{'control':<24} {'kind':<15} {'n':>8} {'rate':>8} {'nominal':>8} verdict"]
    lines += [f"{r['control']:<24} {r['kind']:<15} {r['n']:>8} {r['rejection_rate']:>8.4f} {r['nominal_alpha']:>8.4f} {r['verdict']}" for r in reports]
    if not any(r["kind"] == "external" for r in reports):
        lines.append("Warning: none of the controls is external.")
    return "\n".join(lines)


def tolerance(alpha: float, n: int) -> float:
    require(n > 0, "n must be positive", ControlError)
    return math.sqrt(alpha * (1 - alpha) / n)
