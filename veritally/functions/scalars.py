"""Scalar functions by name, as columns and for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from ..core import special
from ..core.columns import finite, kish
from ..core.seeding import normal, uniform
from ..operators.bunching import grid_index
from ..operators.control import classify, monte_carlo_se
from ..operators.digits import conformity, kuiper_pvalue, leading_digits, terminal_digits
from ..operators.percent import near_integer, percentage
from ..operators.ranking import resolve_k
from ..operators.redteam import misread, ocr_gate

COLUMN_FUNCTIONS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        classify, conformity, finite, grid_index, kish, kuiper_pvalue, leading_digits, misread, monte_carlo_se, near_integer, normal, ocr_gate, percentage, resolve_k, terminal_digits, uniform,
        special.chi2_cdf_column, special.chi2_sf_column, special.f_sf_column, special.ks_sf_column, special.norm_ppf_column, special.norm_sf_column,
    )
}

#: SQL names with their parameters and bodies; they are inlined by the optimizer.
SQL_FUNCTIONS = {
    "vt_percentage": ("num DOUBLE, den DOUBLE", "CASE WHEN den > 0 AND NOT isnan(num) AND NOT isnan(den) THEN 100 * num / den ELSE double('NaN') END"),
    "vt_near_integer": ("pct DOUBLE, tolerance DOUBLE", "abs(pct - rint(pct)) <= tolerance"),
    "vt_grid_index": ("x DOUBLE, threshold DOUBLE, width DOUBLE", "floor((x - threshold) / width + 1e-9 * greatest(1, abs((x - threshold) / width)))"),
    "vt_uniform": ("seed STRING, id STRING", "CAST(conv(substring(md5(concat_ws(':', seed, id)), 1, 13), 16, 10) AS BIGINT) / 4503599627370496D"),
}


def register(spark: SparkSession) -> None:
    """Make the SQL functions temporary functions of the session."""
    for name, (parameters, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
