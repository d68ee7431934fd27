"""Connected components of an edge table, by smallest labels and pointer jumping.

Each round gives a node the smallest label among its own and its neighbours', then the label of that label, so that
chains halve. Labels are aggregated by node; no component is gathered. Every round is checkpointed into the shared folder, as
its plan would grow otherwise and executors can be lost.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> None:
    """Only a local session without a checkpoint folder gets a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(place or tempfile.mkdtemp(prefix="veritally-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; what is built on it reads that and doesn't carry its plan."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): the smallest node that is linked to it. Nodes can be of any type that has an order."""
    _shared_folder(edges.sparkSession)
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        low = labels.join(near, labels["node"] == near["u"]).select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        above = labels.select(F.col("node").alias("at"), F.col("root").alias("jump"))
        now = low.join(above, low["root"] == above["at"]).select("node", "old", F.least("root", "jump").alias("root")).checkpoint()
        if now.where("old <> root").isEmpty():
            return now.select("node", "root")
        labels = now.drop("old")
