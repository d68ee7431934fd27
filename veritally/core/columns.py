"""Column helpers: missing values, weights, dense counts in arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import require

INFINITY = float("inf")


def double(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("double")


def finite(x: Column) -> Column:
    """True for numbers; null, NaN and infinities are missing values."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY), F.lit(False))


def numeric(df: DataFrame, *names: str) -> None:
    """Refuse columns that aren't there or aren't numbers."""
    kinds = dict(df.dtypes)
    for name in names:
        require(name in kinds, f"no column {name!r}")
        require(kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal"), f"column {name!r} is {kinds[name]}, not numeric")


def observed(df: DataFrame, by: Sequence[str], x: Column, weight: str | None = None) -> DataFrame:
    """Keys, x and w (1 without weights); a weight that is negative or not finite is refused."""
    if weight is None:
        w = F.lit(1.0)
    else:
        raw = double(weight)
        w = F.when(finite(raw) & (raw >= 0), raw).otherwise(F.raise_error(F.lit(f"weight column {weight} must be finite and not negative")).cast("double"))
    return df.select(*by, x.alias("x"), w.alias("w"))


def kish(sum_w: Column, sum_w2: Column) -> Column:
    """Effective number of observations; 0 where all weights are."""
    return F.when(sum_w2 > 0, sum_w * sum_w / sum_w2).otherwise(F.lit(0.0))


def dense_counts(df: DataFrame, by: Sequence[str], cell: Column, support: Sequence[int], value: Column | None = None) -> DataFrame:
    """One row for each key: ``observed`` (an array over ``support``, zero cells kept), n, effective_n, n_dropped.

    ``df`` has the keys, a weight w, and what ``cell`` reads; a null cell is a dropped row. Two
    aggregates: by key and cell, then by key, where at most one row for each cell is left.
    """
    cells = df.select(*by, cell.alias("cell"), "w").groupBy(*by, "cell")
    counts = cells.agg(F.count("*").alias("rows"), F.sum("w").alias("sum_w"), F.sum(F.col("w") * F.col("w")).alias("sum_w2"))
    used = F.col("cell").isNotNull()
    keyed = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(used, F.struct(F.col("cell").cast("long"), "sum_w")))).alias("by_cell"),
        F.coalesce(F.sum(F.when(used, F.col("rows"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~used, F.col("rows"))), F.lit(0)).alias("n_dropped"),
        kish(F.sum(F.when(used, F.col("sum_w"))), F.sum(F.when(used, F.col("sum_w2")))).alias("effective_n"),
    )
    places = F.array(*(F.lit(int(s)).cast("long") for s in support))
    full = F.transform(places, lambda s: F.coalesce(F.try_element_at("by_cell", s), F.lit(0.0)))
    return keyed.select(*by, full.alias("observed"), "n", "effective_n", "n_dropped").where("n > 0")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def literals(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def tidy(x: Column, places: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, places) + F.lit(0.0)


def on_keys(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables with a row for each key (without keys: a row each); null keys meet."""
    if not by:
        return left.join(right, F.lit(True), how)
    renamed = right.select(*(F.col(k).alias(f"_right_{k}") for k in by), *(c for c in right.columns if c not in by))
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, match, how).drop(*(f"_right_{k}" for k in by))


def jsonable(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text with its missing fields; NaN and infinities, which JSON has no numbers for, are null."""
    kinds = dict(df.dtypes)

    def plain(x: Column, kind: str) -> Column:
        if kind in ("double", "float"):
            return F.when(finite(x), x)
        if kind in ("array<double>", "array<float>"):
            return F.transform(x, lambda v: F.when(finite(v), v))
        return x

    return df.select(F.to_json(F.struct(*(plain(F.col(f"`{c}`"), kinds[c]).alias(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias(name))
