"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round replaces a node's neighbours by links to the smallest of them; no group is ever
gathered in one place, as a node only needs a minimum, and rounds grow with the logarithm of the
longest chain. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """Add to (u, v) the smallest of each u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the smallest node that it is linked to.

    Loops and repeated edges don't matter; an empty table gives an empty table.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or not seen["n"]:
            break
        mark = (seen["n"], seen["h"])
        both = now.select("u", "v").union(now.select("v", "u"))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_minimum(large)
        now = staged(small.select("u", F.col("m").alias("v")).union(small.select("v", "m")).where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
