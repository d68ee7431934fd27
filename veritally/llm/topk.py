"""Exact top-k inner products by the three-phase uniform threshold.

A score is the sum of partial scores over ``SEGMENTS`` groups of components, so each segment is a list of partial
scores of all candidates.

1. One group of candidates in ``PROBED`` gives its k best of each list for each query. The k-th best complete score
   among these is a score that k candidates reach, so the largest over all blocks is a safe cutoff T, whichever groups
   are asked.
2. The cutoff goes to all lists, each with the same threshold T / SEGMENTS: a candidate that reaches T has a partial score of at least that
   much in some list. A list passes on its entries above the threshold, and only these. It is read by falling length of the candidates' segment, and
   no further than length times the query's length can reach the threshold; a block of candidates that can't reach it in any list
   isn't even sent to the queries. Candidates are laid into blocks by length, so that short ones share blocks.
3. An entry's possible score is what lists passed on of it, and the threshold for each list that didn't. Where that reaches T, the
   complete score is worked out. Each block passes on its k best, which are ranked for each query.

Queries and candidates are packed into blocks of a fixed number of rows, blocks into groups of a fixed number of blocks,
and a group of queries meets a group of candidates in a cell of a grid. A cell is merged by its number: a task
holds the queries of one cell, whatever the number of queries and candidates. No table is broadcast or collected.

Scores are integers and exact: products run in double precision while their sums stay below 2^53, else in 64-bit
integers. Scores that could pass 2^63 have no place in the result and are refused with an error.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
a vec_id. Vectors of another length than the query's are no candidates. Of repeated query rows one
is a query; all repeated rows are candidates, but not of their own vec_id. Ties go to the smaller
vec_id. An empty table gives an empty table, and other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, staged

SCALE = 256
SEGMENTS = 4
QUERY_ROWS = 512
BLOCK_ROWS = 2048
#: Blocks of a group.
QUERY_BLOCKS = 8
CANDIDATE_BLOCKS = 32
#: Every so many groups of candidates give a cutoff.
PROBED = 8


def valid(vectors: DataFrame) -> DataFrame:
    rows = documents(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * SCALE
    fits = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x)).cast("double")).otherwise(F.raise_error(F.lit("a component is beyond 64-bit integers")).cast("double"))
    whole = F.transform("embedding", fits)
    return rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("vector"), F.size("embedding").alias("width"))


def _bounds(width: int) -> np.ndarray:
    """Where the segments of a vector begin, and the end."""
    return np.linspace(0, width, min(SEGMENTS, width) + 1).astype(int)


def _lengths(vectors: np.ndarray, cuts=None) -> np.ndarray:
    """Length of each segment of each row, rounded up."""
    cuts = _bounds(vectors.shape[1]) if cuts is None else cuts
    return np.stack([np.sqrt((vectors[:, a:b].astype(float) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9 for a, b in zip(cuts[:-1], cuts[1:], strict=True)], axis=1)


def _least(cut: np.ndarray, lists: int) -> np.ndarray:
    """The threshold of each list. Scores are whole numbers, so that rounding can't lose an entry."""
    return cut / lists - 1 - np.abs(np.where(np.isfinite(cut), cut, 0)) * 1e-9


def _needed(cut: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each query and list the length that a candidate's segment must have to reach the threshold."""
    least = _least(cut, lengths.shape[1])[:, None]
    return np.where(least > 0, least / lengths, 0.0)


class _Pack:
    """mapInArrow function: rows (vec_id, vector, width, extra) to blocks of one width.

    ``longest`` has the greatest length of each segment; ``need`` the least length that a candidate's segment must have for one of the rows, as a
    query with the cutoff ``extra``, to reach its threshold there."""

    def __init__(self, rows: int):
        self.rows = rows

    def __call__(self, batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(width: int):
            nonlocal number
            ids, vectors, extra = zip(*held.pop(width), strict=True)
            number += 1
            rows = np.stack(vectors)
            lengths = _lengths(rows)
            need = _needed(np.array(extra), lengths).min(axis=0)
            columns = [part, number, width, np.array(ids, np.int64).tobytes(), rows.tobytes(), np.array(extra, np.float64).tobytes(), lengths.max(axis=0).tolist(), need.tolist()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], ["part", "number", "width", "ids", "vectors", "extra", "longest", "need"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(2).to_numpy())
            for i, w, end, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends.tolist(), batch.column(3).to_pylist(), strict=True):
                held.setdefault(w, []).append((i, flat[end - w : end], -np.inf if x is None else x))
                if len(held[w]) == self.rows:
                    yield block(w)
        for width in list(held):
            yield block(width)


def packed(rows: DataFrame, size: int) -> DataFrame:
    return rows.mapInArrow(_Pack(size), "part int, number int, width int, ids binary, vectors binary, extra binary, longest array<double>, need array<double>")


def _numbered(blocks: DataFrame, group: int, least: int = 1) -> tuple[DataFrame, int]:
    """Blocks with the number of their group of ``group`` blocks at most (fewer, to make ``least`` groups), and how many groups there are."""
    counts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    bases, n = [], 0
    for part, size in counts:
        bases.append((part, n))
        n += size
    group = max(1, min(group, n // least))
    base = F.broadcast(blocks.sparkSession.createDataFrame(bases, "part int, base long"))
    return blocks.join(base, "part").withColumn("grp", F.floor((F.col("base") + F.col("number") - 1) / group).cast("int")).drop("base"), -(-n // group)


class _Cells:
    """Shared by both passes: the vectors of every pair of blocks."""

    def __init__(self, k: int):
        self.k = k

    def cells(self, batches):
        """(query ids, candidate ids, cutoffs, [(queries, candidates) of each segment])."""
        for batch in batches:
            for row in range(batch.num_rows):
                width, q_ids, q, cut, c_ids, c = (batch.column(i)[row].as_py() for i in range(6))
                q_ids, c_ids, cut = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64), np.frombuffer(cut)
                q, c = np.frombuffer(q).reshape(-1, width), np.frombuffer(c).reshape(-1, width)
                largest = float(np.abs(q).max()) * float(np.abs(c).max()) * width
                if largest >= 2.0**63:
                    raise ValueError("scores could pass 64-bit integers")
                if largest >= 2.0**53:
                    q, c = q.astype(np.int64), c.astype(np.int64)
                bounds = _bounds(width)
                yield q_ids, c_ids, cut, [(q[:, a:b], c[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class _Cutoffs(_Cells):
    """mapInArrow function, phase one: a score that k candidates of the block reach."""

    def __call__(self, batches):
        k = self.k
        for q_ids, c_ids, _, segments in self.cells(batches):
            lists = [q @ c.T for q, c in segments]
            total = sum(lists)
            best = [np.argpartition(s, -min(k + 1, len(c_ids)), axis=1)[:, -min(k + 1, len(c_ids)) :] for s in lists]
            chosen = np.sort(np.concatenate(best, axis=1), axis=1)
            fresh = np.ones(chosen.shape, bool)
            fresh[:, 1:] = chosen[:, 1:] != chosen[:, :-1]
            score = np.take_along_axis(total, chosen, 1).astype(float)
            score[~fresh | (c_ids[chosen] == q_ids[:, None])] = -np.inf
            if score.shape[1] < k:
                continue
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            known = kth > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[known]), pa.array(kth[known])], ["query_id", "cutoff"])


def uniform_entries(segments: list[tuple[np.ndarray, np.ndarray]], cut: np.ndarray) -> tuple[np.ndarray, int]:
    """Which pairs (query, candidate) can reach the queries' cutoffs, by the entries that lists pass on; and how many partial scores were worked out."""
    n, lists = len(segments[0][1]), len(segments)
    least = _least(cut, lists)
    needs = _needed(cut, np.concatenate([_lengths(q, [0, q.shape[1]]) for q, _ in segments], axis=1)).min(axis=0, initial=np.inf)
    possible, passed, touched = np.repeat(least[:, None] * lists, n, axis=1), np.zeros((len(cut), n), bool), 0
    for (q, c), need in zip(segments, needs.tolist(), strict=True):
        length = _lengths(c, [0, c.shape[1]])[:, 0]
        order = np.argsort(-length, kind="stable")
        reach = order[: np.searchsorted(-length[order], -need, "right")]
        if not len(reach):
            continue
        partial = (q @ c[reach].T).astype(float)
        touched += partial.size
        sent = partial >= least[:, None]
        with np.errstate(invalid="ignore"):
            possible[:, reach] += np.where(sent, partial - least[:, None], 0.0)
        passed[:, reach] |= sent
    return passed & ((possible >= (lists * least - lists)[:, None]) | ~np.isfinite(cut)[:, None]), touched


class _Entries(_Cells):
    """mapInArrow function, phases two and three: entries that can suffice, resolved; k of each block at most."""

    def __call__(self, batches):
        for q_ids, c_ids, cut, segments in self.cells(batches):
            enough, _ = uniform_entries(segments, cut)
            enough &= c_ids[None, :] != q_ids[:, None]
            row, column = np.nonzero(enough)
            if len(row) * 4 > enough.size:  # most remain: cheaper all together
                score = sum(q @ c.T for q, c in segments)[row, column]
            else:
                score = np.zeros(len(row), segments[0][0].dtype)
                for lo in range(0, len(row), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    for q, c in segments:
                        score[part] += np.einsum("ij,ij->i", q[row[part]], c[column[part]])
            stays = score >= cut[row]
            row, column, score = row[stays], column[stays], score[stays].astype(np.int64)
            order = np.lexsort((c_ids[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            top = nth < self.k
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row[top]]), pa.array(c_ids[column[top]]), pa.array(score[top])], ["query_id", "vec_id", "score"])


def _sent(queries: DataFrame, candidates: DataFrame, n_query: int) -> DataFrame:
    """(part, number, i): which groups i of queries a block of candidates is sent to: those whose threshold some list of it can reach.

    Decided on the lengths of blocks alone, before a vector is copied.
    """
    lists = range(1, SEGMENTS + 1)
    asked = queries.groupBy("width", F.col("grp").alias("i")).agg(*(F.min(F.try_element_at("need", F.lit(s))).alias(f"need{s}") for s in lists))
    blocks = candidates.select("width", "part", "number", "longest", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("i"))
    reaches = [F.coalesce(F.try_element_at("longest", F.lit(s)) >= F.col(f"need{s}"), F.lit(False)) for s in lists]
    return blocks.join(asked, ["width", "i"]).where(reduce(or_, reaches)).select("part", "number", "i")


def _grid(queries: DataFrame, candidates: DataFrame, n_query: int, groups: range) -> DataFrame:
    """Blocks of queries beside blocks of candidates of their width, of these groups of candidates, where these can matter.

    Cells are merged, so that a task goes from cell to cell and holds the queries of one.
    """
    numbers = F.sequence(F.lit(groups[0]), F.lit(groups[-1]), F.lit(groups[1] - groups[0] if len(groups) > 1 else 1))
    q = queries.select("width", F.col("grp").alias("i"), F.explode(numbers).alias("j"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"), F.col("extra").alias("cut"))
    step = groups[1] - groups[0] if len(groups) > 1 else 1
    c = candidates.where((F.col("grp") <= groups[-1]) & (F.col("grp") % step == groups[0] % step))
    c = c.join(_sent(queries, c, n_query), ["part", "number"]).select("width", "i", F.col("grp").alias("j"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c"))
    return c.hint("merge").join(q.hint("merge"), ["width", "i", "j"]).select("width", "q_ids", "q", "cut", "c_ids", "c")


def top_k(vectors: DataFrame, query_ids: str = "vec_id % 50 = 0", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query row.

    ``query_ids`` is the SQL condition that makes a row a query.
    """
    spark = vectors.sparkSession
    rows = valid(vectors)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blank = F.lit(None).cast("double").alias("extra")
    length = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    laid = rows.withColumn("length", length).repartitionByRange(parts, F.col("length").desc(), F.col("vec_id"))
    candidates, groups = _numbered(staged(packed(laid.select("vec_id", "vector", "width", blank), BLOCK_ROWS), "vector-blocks"), CANDIDATE_BLOCKS, parts)
    asked = rows.where(query_ids).groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", "vector", F.size("vector").alias("width"))
    asked = staged(asked, "query-vectors")
    ranks = "query_id long, rank int, vec_id long, score long"
    if not groups or asked.isEmpty():
        return spark.createDataFrame([], ranks)
    plain, n_query = _numbered(staged(packed(asked.select("vec_id", "vector", "width", blank), QUERY_ROWS), "query-blocks"), QUERY_BLOCKS)
    probed = range(0, groups, PROBED)
    cutoffs = _grid(plain, candidates, n_query, probed).mapInArrow(_Cutoffs(k), "query_id long, cutoff double").groupBy("query_id").agg(F.max("cutoff").alias("cutoff"))
    bounded = asked.join(cutoffs, asked["vec_id"] == cutoffs["query_id"], "left").select("vec_id", "vector", "width", F.col("cutoff").alias("extra"))
    known, n_query = _numbered(staged(packed(bounded, QUERY_ROWS), "bounded-queries"), QUERY_BLOCKS)
    entries = _grid(known, candidates, n_query, range(groups)).mapInArrow(_Entries(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
