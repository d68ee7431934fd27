"""Ranks and running totals without putting a key's rows in one task.

Rows fall into buckets along the order; a bucket's rows are ordered in one task, and what lies
before a bucket is a sum over the (few) buckets of its key. Buckets are cut by value, so the
outcome doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 256


def value_bucket(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a finite number by approximate quantiles of the column; equal values share one."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, 20 * buckets).alias("q")).first()["q"]
    cuts = np.unique(np.array(found or [], float))

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(float), "right").astype("int32"))

    return place(F.col(value).cast("double"))


def uniform_bucket(u: Column, buckets: int = BUCKETS) -> Column:
    return F.least(F.floor(u * buckets), F.lit(buckets - 1)).cast("int")


def running(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], sums: dict[str, Column], descending: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running sums in the order (buckets first), and optionally totals of some of them.

    ``order`` must agree with the buckets: ascending, or descending with ``descending``.
    """
    rows = df.withColumn("_bucket", bucket)
    per = rows.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    along = F.col("_bucket").desc() if descending else F.col("_bucket")
    before = W.partitionBy(*by).orderBy(along).rowsBetween(W.unboundedPreceding, -1)
    extra = [F.sum(f"_{n}").over(W.partitionBy(*by)).alias(t) for n, t in (totals or {}).items()]
    bases = per.select(*by, "_bucket", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums), *extra)
    # Keys may be null: compare with <=> under other names.
    renamed = bases.select(*(F.col(k).alias(f"_key_{k}") for k in by), F.col("_bucket").alias("_key_bucket"), *(c for c in bases.columns if c not in (*by, "_bucket")))
    match = F.col("_bucket") == F.col("_key_bucket")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *(F.sum(c).over(inside).alias(f"_run_{n}") for n, c in sums.items()))
    joined = local.join(renamed, match)
    return joined.select(*df.columns, *((F.col(f"_run_{n}") + F.col(f"_base_{n}")).alias(n) for n in sums), *(totals or {}).values())


#: Ranges of one narrowing step, and distinct values that are looked at one by one.
_RANGES, _FEW = 4096, 10_000


def smallest(df: DataFrame, u: Column, tie: Column, k: int) -> Column:
    """Whether a row is among the k with the smallest (u, tie), u uniform in [0, 1); exactly k if no pair repeats.

    The k-th is found by counting rows in ranges of u, then in parts of the range that holds it, until few are left: two or three
    aggregates of a fixed number of groups, whatever the number of rows.
    """
    low, width, before = 0.0, 1.0, 0
    rows = df.select(u.alias("u"), tie.alias("t"))
    while True:
        inside = rows.where((F.col("u") >= low) & (F.col("u") < low + width))
        part = F.least(F.floor((F.col("u") - low) / (width / _RANGES)), F.lit(_RANGES - 1)).cast("int")
        counts = sorted((r["p"], r["n"]) for r in inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
        for p, n in counts:
            if before + n >= k:
                break
            before += n
        else:
            return F.lit(True)  # no more than k rows
        low, width = low + p * (width / _RANGES), width / _RANGES
        if n <= _FEW or width < 2.0**-50:
            break
    found = rows.where((F.col("u") >= low) & (F.col("u") < low + width)).groupBy("u", "t").agg(F.count("*").alias("n")).orderBy("u", "t").limit(_FEW).collect()
    for r in found:
        before += r["n"]
        if before >= k:
            break
    if r["t"] is None:
        return u <= r["u"]
    last = F.lit(r["t"]) if not hasattr(r["t"], "asDict") else F.struct(*(F.lit(v).alias(c) for c, v in r["t"].asDict().items()))
    return (u < r["u"]) | ((u == r["u"]) & (tie <= last))
