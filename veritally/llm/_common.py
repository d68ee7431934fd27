"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint directory is present a temporary folder is made and set, and
    only on a local master: executors of a cluster wouldn't see it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="veritally-")
        spark.sparkContext.setCheckpointDir(place)
        place = spark.sparkContext.getCheckpointDir() or place
    return place.rstrip("/")


#: Shuffle files of a finished write are removed at once instead of at the driver's next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch where tasks also hold large tables of their own.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def staged(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; ``settings`` hold while it is written.

    Cuts the lineage, survives the loss of executors, and stops a costly plan from running twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veritally-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true", **(settings or {})}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns; other columns of the input can't clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
