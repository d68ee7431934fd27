"""Packing by best-fit decreasing.

Every document becomes tokens and a closing id. Overlong documents are cut into full windows
first; what remains and all shorter documents are placed in order of decreasing length, each in
the open window whose remaining capacity is the tightest that still holds it. A segment tree
indexed by remaining capacity finds that window.

Pieces of one length are interchangeable, so the placement needs only the number of pieces of
each length: at most ``window`` numbers come to the driver, whatever the size of the corpus. There
whole classes of equally filled windows are placed at once (what placing one piece after the other
gives as well), and the outcome is a short list of runs: the pieces of length L with ranks
lo..hi go to windows first, first + 1, ... . Executors look up their pieces in these runs.

A null text counts as empty: its only token is the closing id. Repeated rows and null doc_ids are
documents like any other, an empty table packs to no rows, and other columns are ignored. The
rank of a piece follows the order in which the input's partitions hold the documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import SMALL_BATCHES, documents, staged
from .bpe import byte_ranges, word_codec

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Which remaining capacities have an open window, and the smallest that is large enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first window, pieces a window, offset) of best-fit decreasing."""
    tree, open_, runs, made = CapacityTree(window), {}, [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, each = window, window // length
                first, there = made, -(-left // each)
                made += there
            else:
                first, there = open_[capacity].pop()
                tree.add(capacity, -there)
                each = capacity // length
            used = min(there, -(-left // each))
            placed = min(left, used * each)
            runs.append((length, rank, placed, first, each, window - capacity))
            whole, rest = divmod(placed, each)
            leave(capacity - each * length, first, whole)
            leave(capacity - rest * length, first + whole, 1 if rest else 0)
            leave(capacity, first + used, there - used)
            rank, left = rank + placed, left - placed
    return runs


class _Cut:
    """mapInArrow function: documents to pieces, numbered within partition and length."""

    def __init__(self, path: str, window: int, closing: int):
        self.path, self.window, self.closing = path, window, closing

    def __call__(self, batches):
        codec, part = word_codec(self.path), TaskContext.get().partitionId()
        places = np.zeros(self.window + 1, np.int64)
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(1)):
                ids, at = codec.encode_texts(batch.column(1).slice(lo, hi - lo), self.closing)
                tokens = np.diff(at)
                each = -(-tokens // self.window)
                doc = np.repeat(np.arange(len(tokens)), each)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * self.window
                length = np.minimum(tokens[doc] - start, self.window)
                first = at[doc] + start
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * f : 4 * t]) for f, t in zip(first.tolist(), (first + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                place = np.empty(len(doc), np.int64)
                place[order] = places[sorted_] + np.arange(len(doc)) - np.searchsorted(sorted_, sorted_)
                places += np.bincount(length, minlength=len(places))
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"])


class _Place:
    """mapInArrow function: from a piece's length and rank to its window and offset."""

    def __init__(self, runs: list[tuple[int, int, int, int, int, int]]):
        ordered = np.array(sorted(runs), np.int64).reshape(-1, 6)
        self.key = (ordered[:, 0] << 48) | ordered[:, 1]
        self.runs = ordered

    def __call__(self, batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            run = self.runs[np.searchsorted(self.key, (length << 48) | rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence, offset = run[:, 3] + nth // run[:, 4], run[:, 5] + nth % run[:, 4] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pieces(docs: DataFrame, path: str, window: int = 2048, closing: int = 1) -> DataFrame:
    """Documents cut into pieces of at most ``window`` tokens."""
    return documents(docs, "doc_id", "text").mapInArrow(_Cut(path, window, closing), PIECES)


def pack(docs: DataFrame, path: str, window: int = 2048, closing: int = 1) -> DataFrame:
    """Place every piece of every document: its sequence and its offset there.

    The pieces (without their ids) are written once to the shared folder, as their ranks must not
    change between counting and placing.
    """
    cut = staged(pieces(docs, path, window, closing), "pieces", SMALL_BATCHES)
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranked = cut.join(bases, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(_Place(plan(histogram, window)), PACKED)
