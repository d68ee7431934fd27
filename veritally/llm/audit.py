"""How five filters interact: what each order of them keeps, removes and removes in vain, by part of the corpus.

A document that fails the filters of a set F survives just those subsets of filters that have nothing in common with F.
Its survival word holds that truth table: bit T of 32 is set if it survives the subset T. The survivors of all 32 subsets
at once are then the positional popcount of the words of a part: how many of them have each bit. Words are added by
carry-save: a full adder turns three rows of words into a row of sums and a row of carries of twice the weight, so that
only a few rows for each weight are left to be counted bit by bit. Every order and step follows from these counts:
what a filter removes is the difference of the survivors before and after it, what it alone fails is the difference of
"all but it" and "all".

Filters (white space: 0x20 and 0x09-0x0D; whole texts, null: empty): A fewer than 100 words; B fewer than 80 different
words in a hundred; C more than 10 capitals A-Z in a hundred code points; D holds one of #$%&*|; E equal to the text of
a document with a smaller doc_id, wherever it is. Texts are compared by a 128-bit hash (XXH3).

Counting words, hashing and counting survivors run in Arrow batches; the copies and labels are found by joins on
(text hash, doc_id) and doc_id, so that a large group of copies is dealt to many tasks. A task passes on 96 counts for
each part that it has met, and at most ``PARTS`` parts at once.

A null lang is the part ''. A null doc_id has no label, is no copy and makes none. Repeated rows count each; repeats of
the smallest doc_id are no copies. A doc_id with several rows of labels is good, or toxic, if one of them says so. Null
labels say nothing. An empty table has no part and gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, staged
from .bpe import byte_ranges
from .text import flat

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
#: The survival word of each set of failed filters.
WORDS = np.array([sum(1 << t for t in range(SUBSETS) if not t & failed) for failed in range(SUBSETS)], np.uint32)
LANES = 64
PARTS = 4096
CLASSES = 3

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def _marks(batches):
    """mapInArrow function: (doc_id, part, text) to (doc_id, part, hash, failed): the filters but E that a text fails, as bits."""
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            raw, at = flat(part.column(2))
            count = lambda marked, at=at: np.diff(np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])[at])
            capitals, points, symbols = count((raw >= 65) & (raw <= 90)), count((raw & 0xC0) != 0x80), count(_SYMBOL[raw])
            total, distinct, digests = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), []
            for i, t in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                found = (t or b"").split()
                total[i], distinct[i] = len(found), len(set(found))
                digests.append(xxhash.xxh3_128_digest(t or b""))
            failed = (total < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * total) * 2 + (100 * capitals > MOST_CAPITALS * points) * 4 + (symbols > 0) * 8
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(failed.astype(np.int32))], ["doc_id", "part", "hash", "failed"])


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic) for every row: the failed filters as bits, A lowest."""
    rows = documents(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    marked = staged(rows.mapInArrow(_marks, "doc_id long, part string, hash binary, failed int"), "marks")
    first = marked.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    says = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = documents(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    placed = marked.join(first, ["hash", "doc_id"], "left").select("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"))
    said = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    return placed.join(known, "doc_id", "left").select("doc_id", "part", "failed", said("good").alias("good"), said("toxic").alias("toxic"))


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of these 32-bit words have each bit, by carry-save addition."""
    rows = np.concatenate([words, np.zeros(-len(words) % LANES, np.uint32)]).reshape(-1, LANES)
    total, weight = np.zeros(SUBSETS, np.int64), 1
    while len(rows):
        carries = []
        while len(rows) > 2:
            n = len(rows) // 3 * 3
            a, b, c = rows[:n:3], rows[1:n:3], rows[2:n:3]
            either = a ^ b
            carries.append(a & b | c & either)
            rows = np.concatenate([either ^ c, rows[n:]])
        bits = np.unpackbits(np.ascontiguousarray(rows, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries) if carries else rows[:0], 2 * weight
    return total


def _survivors(batches):
    """mapInArrow function: (part, failed, good, toxic) to (part, counts): survivors of every subset, of all rows, good ones and toxic ones."""
    held: dict[str, np.ndarray] = {}

    def out():
        parts, counts = list(held), [x.ravel() for x in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(counts, pa.list_(pa.int64()))], ["part", "counts"])

    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code, word = names.indices.to_numpy(), WORDS[batch.column(1).to_numpy()]
        good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
        for name, lo, hi in zip(names.dictionary.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[lo:hi]
            if name not in held and len(held) == PARTS:
                yield out()
            found = held.setdefault(name, np.zeros((CLASSES, SUBSETS), np.int64))
            for i, rows in enumerate((own, own[good[own]], own[toxic[own]])):
                found[i] += positional_counts(word[rows])
    if held:
        yield out()


def survivors(failed: DataFrame) -> DataFrame:
    """(part, counts): for each part the survivors of the 32 subsets of filters, of all documents, of good and of toxic ones (3 x 32)."""
    rows = failed.select("part", "failed", "good", "toxic").mapInArrow(_survivors, "part string, counts array<long>")
    sums = rows.groupBy("part").agg(*(F.sum(F.element_at("counts", i + 1)).alias(f"n{i}") for i in range(CLASSES * SUBSETS)))
    return sums.select("part", F.array(*(f"n{i}" for i in range(CLASSES * SUBSETS))).alias("counts"))


_NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders(batches):
    """mapInArrow function: (part, counts) to a row for each order and step."""
    steps = [("".join(p), k + 1, 1 << FILTERS.index(p[k]), sum(1 << FILTERS.index(x) for x in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))]
    order, step = [s[0] for s in steps], np.array([s[1] for s in steps], np.int32)
    bit, before = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    after, everything = before | bit, SUBSETS - 1
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, good, toxic = np.array(counts, np.int64).reshape(CLASSES, SUBSETS)
            removed = n[before] - n[after]
            summed = np.bincount(bit, removed, SUBSETS)[bit]  # sums of whole numbers, exact below 2^53
            numbers = (n[after], removed, n[0] - n[bit] - removed, n[everything ^ bit] - n[everything], good[before] - good[after], toxic[before] - toxic[after], summed.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), pa.array(order), pa.array(step), *map(pa.array, numbers)], ["part", "filter_order", "step", *_NUMBERS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step: what is kept, removed, failed in vain, failed alone and lost.

    redundant: failing this filter but removed earlier; unique_fails: failing this filter alone; shapley: what this filter
    removes, summed over all orders.
    """
    return survivors(failures(docs, labels)).mapInArrow(_orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _NUMBERS))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS failed FROM w),
m AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM k a, k b, k c, k d, k e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
  SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i) q),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (failed & bit > 0 AND failed & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
    coalesce(sum(g) FILTER (failed & bit > 0 AND failed & before = 0), 0) AS good_lost,
    coalesce(sum(x) FILTER (failed & bit > 0 AND failed & before = 0), 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
