"""Shards by weighted rendezvous hashing of stable record keys.

Every shard draws a number for every key: a hash of (seed, shard, key). With equal weights the largest hash takes the
record; with weights w the smallest -ln(u) / w does, u being the hash as a fraction, so that a shard gets a share in
proportion to its weight. A key's numbers for the old shards don't change when a shard is added, so a record moves only if
the new shard's number wins: 1 of 41 records from 40 to 41 shards, and all of them into the new shard. Taking a shard away, or
giving it less weight, moves only records that were in it. A weight of zero takes nothing.

Records of one key share a shard; within a shard every row has a slot, gapless from 0. Slots are given in two steps: a rank
within (file of the placed rows, shard), and the rows of this shard in earlier files. So neither a shard nor a key that holds a
third of all rows is gathered in one task. Slots depend on how the rows lie in files; shards don't.

A null key is a key of its own. Null texts have no bytes. Repeated rows get the same shard and a slot each. An empty table
gives an empty table. Columns of the input named like those added are ignored by ``shard_table`` and refused by ``assign``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import documents, staged
from .text import MIX, MIX_2, _spread

SHARDS = 40
SEED = 42
#: Bytes of a record besides its text.
OVERHEAD = 16
#: Rows of a file of ``write_shards``.
FILE_ROWS = 100_000
_NULL_KEY = np.uint64(0x9AE16A3B2F90404F)


def draws(keys: np.ndarray, shards: Sequence[int], seed: int = SEED) -> np.ndarray:
    """A 64-bit number for each key and shard."""
    salt = _spread((np.asarray(shards, np.uint64) + np.uint64(1)) * MIX ^ _spread(np.array([seed], np.int64).view(np.uint64) * MIX_2 + MIX))
    with np.errstate(over="ignore"):
        return _spread(_spread(keys[:, None] * MIX_2 + salt) ^ salt)


def choose(keys: np.ndarray, weights: Sequence[float], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and whether the last shard took it from the others (then the first is what it was before)."""
    weights = np.asarray(weights, float)
    number = draws(keys, range(len(weights)), seed)
    if (weights == weights[0]).all():
        cost = ~number  # whole numbers: no rounding
        none = np.full(len(keys), np.iinfo(np.uint64).max)
    else:
        with np.errstate(divide="ignore"):
            cost = -np.log(((number >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / weights
        none = np.full(len(keys), np.inf)
    if len(weights) == 1:
        return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
    old = cost[:, :-1].argmin(axis=1).astype(np.int32)
    best = np.minimum(none, np.take_along_axis(cost, old[:, None].astype(np.int64), 1)[:, 0])
    return old, cost[:, -1] < best


class _Placed:
    """mapInArrow function: the first column is the 64-bit key; adds shard, and the shard with one more."""

    def __init__(self, weights: list[float], grown: float, seed: int):
        self.weights, self.grown, self.seed = weights, grown, seed

    def __call__(self, batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                column = part.column(0)
                keys = column.fill_null(0).to_numpy().view(np.uint64).copy()
                keys[column.is_null().to_numpy(zero_copy_only=False)] = _NULL_KEY
                shard, moved = choose(keys, [*self.weights, self.grown], self.seed)
                grown = np.where(moved, len(self.weights), shard).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(shard), pa.array(grown)], [*part.schema.names[1:], "shard", "grown_shard"])


def _weights(shards: int, weights: Sequence[float] | None) -> list[float]:
    found = [1.0] * shards if weights is None else [float(w) for w in weights]
    if shards < 1 or len(found) != shards or not all(0 <= w < float("inf") for w in found) or not any(found):
        raise ValueError("there must be a weight for each shard, none negative and one above zero")
    return found


def assign(df: DataFrame, key: str, shards: int = SHARDS, weights: Sequence[float] | None = None, grown_weight: float = 1.0, seed: int = SEED) -> DataFrame:
    """All columns of ``df`` with ``shard``, and ``grown_shard``: the shard if one more with this weight is added.

    The key is a whole number, or anything else by its XXH64.
    """
    taken = {"shard", "grown_shard", "_key"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"the table has columns of its own named {sorted(taken)}")
    number = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    stable = F.col(f"`{key}`").cast("long") if number else F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(f"`{key}`"))
    rows = df.select(stable.alias("_key"), *(F.col(f"`{c}`") for c in df.columns))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())])
    return rows.mapInArrow(_Placed(_weights(shards, weights), float(grown_weight), seed), schema)


def slotted(placed: DataFrame) -> DataFrame:
    """Add ``slot``: the row's place within its shard. ``placed`` is written first, so that the order of its rows is fixed."""
    kept = staged(placed, "placed")
    rows = kept.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    nth = F.row_number().over(W.partitionBy("_file", "shard").orderBy("_row")) - 1
    counts = rows.groupBy("_file", "shard").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_file", "shard", earlier.alias("_base"))
    return rows.withColumn("_nth", nth).join(bases, ["_file", "shard"]).select(*placed.columns, (F.col("_base") + F.col("_nth")).cast("long").alias("slot"))


def shard_table(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, seed: int = SEED) -> DataFrame:
    """Where every document goes: doc_id, size, text_crc32, law ('key'), shard, slot, and the shard if there were one more."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    found = slotted(assign(rows, "doc_id", shards, weights, 1.0, seed))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, weights: Sequence[float] | None = None, seed: int = SEED, file_rows: int = FILE_ROWS) -> None:
    """Write all rows into a folder for each shard, in the order of their slots, in files of ``file_rows`` rows at most.

    A large shard is dealt to as many tasks as it has files.
    """
    rows = slotted(assign(df, key, shards, weights, 1.0, seed).drop("grown_shard"))
    dealt = rows.withColumn("_part", F.floor(F.col("slot") / file_rows)).repartition("shard", "_part").sortWithinPartitions("shard", "slot")
    dealt.drop("_part").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
