"""Uniform numbers that depend on a seed and on keys alone, not on partitions.

The first 13 hexadecimal digits of an MD5 over the parts, as a fraction of 2^52: SQL engines
give the same value, so resampling can be checked against them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | int | str) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *(c.cast("string") for c in columns))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform_sql(*parts: str) -> str:
    """The same in DuckDB; parts are SQL expressions."""
    joined = "concat_ws(':', " + ", ".join(parts) + ")"
    return f"(CAST(CAST('0x' || substr(md5({joined}), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)})"


def normal(*parts: Column | int | str) -> Column:
    """Standard normal by Box and Muller."""
    u = F.greatest(uniform(*parts, "a"), F.lit(1e-15))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(*parts, "b"))
