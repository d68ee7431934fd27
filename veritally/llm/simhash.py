"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint of ``bits`` bits is cut into segments, and a table holds the fingerprints under each (segment,
value). Two fingerprints at most ``distance`` bits apart differ by at most distance // segments bits in some
segment. So each fingerprint enumerates the Hamming ball of that radius within each of its segments, fetches
what the tables hold under these values, and the complete distances decide.

``groups`` does so for 64 bits over three-word shingles, distance 2, two segments (balls of 33 values). It loses
no link. A value of a segment that more than ``HOT`` fingerprints share (a large group of near copies) would be
searched in quadratic time; fingerprints in such buckets are addressed by their whole value instead, with the
ball over all bits on both sides. At most 65 different fingerprints can share such an address, and each is
linked to the smallest of them, so the work stays in proportion, without a cap. (A pair is missed by the tables
only if both are in hot buckets: otherwise one finds the other in the bucket that isn't.)

``without_copies`` keeps one document of each group of similar ones: sets of five-word shingles with a Jaccard
similarity of ``SIMILAR`` at least. It does so by the same index over wider fingerprints: 256 bits in ``WIDE_SEGMENTS``
segments of 32, in tables by (segment, value) with a list of the holders of each value. Every value in use enumerates the ball of
one bit once, however many hold it; two values of a segment share an address if they differ in two bits at most, and an address
has 33 values at most. Fingerprints up to ``REACH`` bits apart always meet so. That is all but some pairs of
similarity 0.95, about 97 % of those of 0.9, and 64 % at 0.8, where fingerprints differ in 15 % of their bits. Balls that reach
all of those would take thousands of rows from each document. So that no link is left to chance there, documents
also meet by ``BANDS`` keys of ``ROWS`` minima each: a pair of similarity 0.8 shares one with probability 0.996. Then

1. In each bucket all are compared with one of them. In one of minima it is the one that shares most keys with others, as it
   is the most likely origin of the rest. In one of the tables complete distances are worked out in the bucket: whoever is
   within ``REACH`` of one that no earlier one has led is led by it, a leader is linked to one close member that another leads,
   and only these pairs, one for each member at most, leave it.
2. In buckets of minima that hold several groups still, all members of different groups are compared, in cells of two blocks of bounded
   size, so that a large bucket is dealt to many tasks. No turn is limited and nothing is left open. A cell joins groups as it
   finds links, so it passes on fewer links than it has members, and no pair that isn't similar.
3. In buckets of the tables that hold several groups even then, all pairs of different groups up to ``REACH`` bits apart
   are looked up, in such cells, by fingerprints alone; all are also compared with the member that has the smallest hash.

Compared means: by complete distance (at most ``REACH``, or the fingerprints and the minima give an estimate of the similarity
that comes to ``NEAR``), and what passes by the whole shingle sets, which decide.

Equal fingerprints (in ``without_copies``: equal shingle sets) are one node. The components of the links are
the groups.

Null and empty texts, and texts without a word, have fingerprint zero and are linked like others; their sets are
empty and equal. Repeated rows get equal rows. A null doc_id is carried; it never names a group unless the group
has no other id (then component_id is null), and ``without_copies`` keeps such rows, as none can be named as the
one to stay. An empty table gives an empty table, and other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, staged
from .bpe import byte_ranges
from .graph import components
from .text import MIX, _spread, flat, gram_hashes, word_hashes, words

SEED = 42
SHINGLE = 3
DISTANCE = 2
BITS = 64
SEGMENTS = 2
#: Fingerprints in a bucket above which it is addressed by whole values.
HOT = 64

WIDE_SHINGLE = 5
WIDE_WORDS = 4
WIDE_BITS = 64 * WIDE_WORDS
SIMILAR = 0.8
#: Segments of wide fingerprints, and the distance up to which two share an address: else each segment would differ in three bits.
WIDE_SEGMENTS, WIDE_RADIUS = 8, 1
REACH = WIDE_SEGMENTS * (2 * WIDE_RADIUS + 1) - 1
#: Keys of each document, and minima in a key.
BANDS, ROWS = 14, 5
#: Estimated similarity that candidates must reach: all but one in some hundred pairs of similarity 0.8 do. For sets
#: below ``FEW`` shingles estimates are rough.
NEAR, ROUGH, FEW = 0.72, 0.5, 32
#: Members of a block, and bytes of their shingle sets.
BLOCK, BLOCK_BYTES = 8192, 32 << 20
#: Size of the bitmap that tells addresses of large buckets (8 MB, whatever their number).
FILTER_BITS = 1 << 26
#: A fingerprint with more comparisons than this is dealt to several tasks.
DEALT = 500


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of every ``n`` consecutive words in lower case (A-Z), joined by a space; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        starts, ends = starts[: 1 - n], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows of 64-bit words have each bit."""
    total = np.zeros(64 * (hashes.shape[1] if hashes.ndim > 1 else 1), np.int64)
    for lo in range(0, len(hashes), 1 << 13):
        raw = np.ascontiguousarray(hashes[lo : lo + (1 << 13)], "<u8").view(np.uint8).reshape(len(hashes[lo : lo + (1 << 13)]), -1)
        total += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return total


def fingerprint(text: bytes) -> int:
    """64 majority bits over the XXH64 values of the shingles; 0 without a word."""
    hashes = shingle_hashes(text, SHINGLE)
    return int(np.packbits(2 * _ones(hashes) > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            values = [fingerprint(t) if t else 0 for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed 64-bit integer."""
    return documents(docs, "doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def ball_masks(width: int, radius: int) -> list[int]:
    """What to XOR a value of ``width`` bits with: all values within the radius, itself first; as signed 64-bit integers."""
    masks, last = [0], [0]
    for _ in range(radius):
        last = [m | 1 << b for m in last for b in range(m.bit_length(), width)]
        masks += last
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def segment_keys(fp: F.Column, masks: list[int], segments: int = SEGMENTS) -> F.Column:
    """An array of (segment, value XOR mask) as one integer each, for all segments and masks."""
    width = BITS // segments
    low = F.lit((1 << width) - 1).cast("long")
    value = [F.shiftrightunsigned(fp, s * width).bitwiseAND(low) for s in range(segments)]
    return F.array(*(value[s].bitwiseXOR(F.lit(m).cast("long")) * segments + s for s in range(segments) for m in masks))


def links(values: DataFrame) -> DataFrame:
    """(u, v) between different fingerprints ``fp`` at most two bits apart, enough to connect all."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.select("fp").repartition(parts)  # dozens of rows from each: few large tasks would need much memory
    table = dealt.select(F.col("fp").alias("held"), F.explode(segment_keys(F.col("fp"), [0])).alias("key"))
    hot = staged(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"), "hot-buckets")
    probes = dealt.select("fp", F.explode(segment_keys(F.col("fp"), ball_masks(BITS // SEGMENTS, DISTANCE // SEGMENTS))).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("held"))) <= DISTANCE
    found = probes.join(table.join(hot, "key", "left_anti"), "key").where(near & (F.col("fp") != F.col("held"))).select("fp", "held")
    crowded = staged(table.join(hot, "key", "left_semi").select(F.col("held").alias("fp")).distinct(), "crowded")
    met = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in ball_masks(BITS, DISTANCE // 2)))).alias("address"))
    least = met.groupBy("address").agg(F.min("fp").alias("held"), F.max("fp").alias("last")).where("held <> last").drop("last")
    found = found.unionByName(met.join(least, "address").where(near & (F.col("fp") != F.col("held"))).select("fp", "held"))
    return found.select(F.greatest("fp", "held").alias("u"), F.least("fp", "held").alias("v")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id of its group."""
    marked = staged(fingerprints(docs), "fingerprints")
    values = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "values")
    roots = components(links(values.select("fp")))
    rooted = staged(values.join(roots, values["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    owner = staged(rooted.join(named, "root").select("fp", "component_id"), "owners")
    return marked.join(owner, "fp").select("doc_id", "fp", "component_id")


def group_table(docs: DataFrame) -> DataFrame:
    """Group of every document, with the fingerprint in hexadecimal."""
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(docs).select("doc_id", text.alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted hashes of the different five-word shingles of each text; a text of fewer words is one shingle."""
    raw, at = flat(texts)
    capital = (raw >= ord("A")) & (raw <= ord("Z"))
    raw = raw + np.uint8(32) * capital
    start, end, _ = words(raw, at)
    word = word_hashes(raw, start, end)
    grams, cuts, out = gram_hashes(word, WIDE_SHINGLE), np.searchsorted(start, at).tolist(), []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(np.unique(grams[lo : hi - WIDE_SHINGLE + 1]) if hi - lo >= WIDE_SHINGLE else gram_hashes(word[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def sketch(values: np.ndarray) -> bytes:
    """256 majority bits over a set of shingle hashes; where half of the set has a bit, the smallest hash decides."""
    if not len(values):
        return bytes(WIDE_BITS // 8)
    wide = _spread(values[:, None] + np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * MIX)
    ones = 2 * _ones(wide)
    least = np.unpackbits(wide[0].astype("<u8").view(np.uint8), bitorder="little")
    return np.packbits((ones > len(values)) | ((ones == len(values)) & (least == 1)), bitorder="little").tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats; empty sets are equal."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0 if len(b) else 1.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


_MINIMA = np.random.Generator(np.random.Philox(key=SEED)).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least product of the hashes of each set with each odd number; the largest number for empty sets."""
    out = np.full((len(sets), len(_MINIMA)), np.iinfo(np.uint64).max)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for j, odd in enumerate(_MINIMA):
            out[full, j] = np.minimum.reduceat(joined * odd, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of each set: hashes of ``ROWS`` minima and the number of the band."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX, (len(least), 1))
        for r in range(ROWS):
            key = _spread((key ^ least[:, r::ROWS]) * MIX)
    return key.view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the fingerprints, for rows of marks."""
    n = WIDE_BITS // 8
    return np.bitwise_count(np.ascontiguousarray(a[:, :n]).view("<u8") ^ np.ascontiguousarray(b[:, :n]).view("<u8")).sum(axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by fingerprints (their angle) and by the lowest bytes of the minima, for rows of marks."""
    n = WIDE_BITS // 8
    cosine = np.cos(np.pi * distance(a, b) / WIDE_BITS)
    same = ((a[:, n:] == b[:, n:]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
    return 0.55 * same + 0.45 * cosine / (2 - cosine)


def is_near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether pairs of marks can be similar: sizes allow it, and fingerprints are within ``REACH`` or the estimate comes near."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return (low >= SIMILAR * high) & ((distance(a, b) <= REACH) | (estimate(a, b) >= np.where(low < FEW, ROUGH, NEAR)))


def _node(values: np.ndarray) -> int:
    x = xxhash.xxh64_intdigest(values.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


MARKS = "node long, size int, mark binary, keys array<long>"


def _marks(batches):
    """mapInArrow function: (doc_id, text) to (doc_id, node, size, mark, keys); a mark is a fingerprint and a byte of each of the minima."""
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            sets = shingle_sets(part.column(1))
            least = minima(sets)
            tail = (least >> np.uint64(40)).astype(np.uint8)
            marks = [sketch(s) + t.tobytes() for s, t in zip(sets, tail, strict=True)]
            columns = [part.column(0), pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary()), pa.array(list(band_keys(least)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "mark", "keys"])


def _held(marked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the lowest bits of each value are in the bitmap."""
    place = values & np.uint64(FILTER_BITS - 1)
    return (marked[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Sets:
    """mapInArrow function: (hash of doc_id, text) to (node, shingles) of documents whose id may be wanted.

    The bitmap is asked before a text is read, and the only work in Python of its stage is here: one worker a task.
    """

    def __init__(self, marked: np.ndarray):
        self.marked = marked

    def __call__(self, batches):
        for batch in batches:
            texts = batch.column(1).filter(pa.array(_held(self.marked, batch.column(0).to_numpy().view(np.uint64))))
            for lo, hi in byte_ranges(texts):
                sets = shingle_sets(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])


def _rows(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _near(batches):
    """mapInArrow function: (u, v, (size, mark) of u, (size, mark) of v) to (u, v) of those that can be similar."""
    for batch in batches:
        if batch.num_rows:
            (size_u, u), (size_v, v) = ((x.field(0).to_numpy(), _rows(x.field(1))) for x in (batch.column(2), batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array(is_near(u, v, size_u, size_v)))


class _Cell:
    """The members of one cell (address, ci, cj): those of block ci against those of cj, or among themselves if it is the same."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).combine_chunks()
        self.address, ci, cj = (rows.column(c)[0].as_py() for c in ("address", "ci", "cj"))
        self.size, block = (column(c).to_numpy() for c in ("size", "block"))
        self.root, self.group = np.unique(column("root").to_numpy(), return_inverse=True)
        self.first = self.group.copy()
        self.mark, self.hashes = _rows(column("mark")), column("hashes")
        self.keys = column("keys").flatten().to_numpy().reshape(-1, BANDS)
        self.one, self.left, self.right = ci == cj, np.flatnonzero(block == ci), np.flatnonzero(block == cj)

    def set(self, i: int) -> np.ndarray:
        return np.frombuffer(self.hashes[i].as_buffer(), np.uint64)

    def links(self) -> list[tuple[int, int]]:
        """Pairs of groups (roots) with similar members, enough to join all groups that such pairs join."""
        bits = np.ascontiguousarray(self.mark[:, : WIDE_BITS // 8]).view("<u8")
        found, step = [], max(1, (1 << 20) // max(len(self.right), 1))
        for lo in range(0, len(self.left), step):
            own = self.left[lo : lo + step]
            apart = sum(np.bitwise_count(bits[own][:, None, w] ^ bits[self.right][None, :, w]).astype(np.int16) for w in range(WIDE_WORDS))
            for i, near in zip(own.tolist(), apart <= WIDE_BITS // 3, strict=True):
                found += self._of(i, self.right[near])
        return found

    def _of(self, i: int, others: np.ndarray) -> list[tuple[int, int]]:
        others = others[(self.group[others] != self.group[i]) & ((others > i) | (not self.one))]
        if len(others):
            first = np.argmax(self.keys[others] == self.keys[i], axis=1)  # a pair is a matter of the first key it shares
            others = others[self.keys[i][first] == self.address]
        if not len(others):
            return []
        mine = np.broadcast_to(self.mark[i], (len(others), self.mark.shape[1]))
        likely = estimate(mine, self.mark[others])
        others = others[np.argsort(-likely, kind="stable")]
        others = others[is_near(mine, self.mark[others], np.broadcast_to(self.size[i], len(others)), self.size[others])]
        out, own = [], self.set(i)
        for j in others.tolist():
            if self.group[j] != self.group[i] and similarity(own, self.set(j)) >= SIMILAR:
                out.append((int(self.root[self.first[i]]), int(self.root[self.first[j]])))
                self.group[self.group == self.group[j]] = self.group[i]
        return out


def _by_cell(batches):
    """The rows of each cell, which lie together, as a table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.stack([batch.column(c).to_numpy() for c in ("address", "ci", "cj")])
        cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(cell[:, lo])
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _cells(batches):
    """mapInArrow function: members of buckets of minima, each cell in one piece, to the roots (u, v) of groups to join."""
    for rows in _by_cell(batches):
        found = np.array(_Cell(rows).links(), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])


def _members(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """block, node, root, mark and size (None if there is none) of a cell's members, which come one by one or in lists."""
    block = rows.column("block").combine_chunks().to_numpy()
    if "holders" in rows.column_names:
        lists = rows.column("holders").combine_chunks()
        node, root, size, mark = lists.flatten().flatten()
        return np.repeat(block, lists.value_lengths().to_numpy()), node.to_numpy(), root.to_numpy(), _rows(mark), size.to_numpy()
    node, root, mark = (rows.column(c).combine_chunks() for c in ("node", "root", "bits"))
    return block, node.to_numpy(), root.to_numpy(), _rows(mark), None


def _within(rows: pa.Table, block: np.ndarray, mark: np.ndarray):
    """For runs of members of block ci: their places, those of block cj, and which pairs are up to ``REACH`` bits apart."""
    ci, cj = (rows.column(c)[0].as_py() for c in ("ci", "cj"))
    bits = np.ascontiguousarray(mark[:, : WIDE_BITS // 8]).view("<u8")
    left, right = np.flatnonzero(block == ci), np.flatnonzero(block == cj)
    step = max(1, (1 << 20) // max(len(right), 1))
    for lo in range(0, len(left), step):
        own = left[lo : lo + step]
        yield own, right, sum(np.bitwise_count(bits[own][:, None, w] ^ bits[right][None, :, w]).astype(np.int16) for w in range(WIDE_WORDS)) <= REACH


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _led(batches):
    """mapInArrow function: members of buckets of the tables, each cell in one piece, to (u, v) up to ``REACH`` bits apart: each member with one that leads it, leaders with a member led by another."""
    for rows in _by_cell(batches):
        block, node, _, mark, _ = _members(rows)
        order = np.argsort(node, kind="stable")  # the same leaders in all buckets, so that pairs repeat
        block, node, mark = block[order], node[order], mark[order]
        free, u, v = np.ones(len(node), bool), [], []
        for own, right, near in _within(rows, block, mark):
            near &= node[own][:, None] != node[right][None, :]
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                if free[own[k]]:
                    met = right[near[k]]
                    met = np.concatenate([met[free[met]], met[~free[met]][:1]])
                    free[met] = False
                    u.append(np.full(len(met), node[own[k]]))
                    v.append(node[met])
        if u:
            yield _pairs(np.concatenate(u), np.concatenate(v))


def _reached(batches):
    """mapInArrow function: members of buckets of the tables, each cell in one piece, to (u, v) of different groups: all that are up to ``REACH`` bits apart.

    Where sizes are given, also those that can be similar to the smallest member.
    """
    for rows in _by_cell(batches):
        block, node, root, mark, size = _members(rows)
        if (root == root[0]).all():
            continue
        for own, right, near in _within(rows, block, mark):
            i, j = np.nonzero(near & (root[own][:, None] != root[right][None, :]))
            if len(i):
                yield _pairs(node[own[i]], node[right[j]])
        if size is not None:
            least = np.argmin(node)
            other = np.flatnonzero(root != root[least])
            other = other[is_near(mark[other], np.broadcast_to(mark[least], (len(other), mark.shape[1])), size[other], np.broadcast_to(size[least], len(other)))]
            if len(other):
                yield _pairs(node[other], np.full(len(other), node[least]))


def _similar(batches):
    """mapInArrow function: (u, v, shingles of u, shingles of v) to (u, v) of those that are similar."""
    for batch in batches:
        keep = [
            similarity(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= SIMILAR
            for a, b in zip(batch.column(2), batch.column(3), strict=True)
        ]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _dealt(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """(u, v, of_u, of_v): what ``held`` has of both; a v with many pairs is copied to several tasks."""
    hot = staged(pairs.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > DEALT).select("v", F.ceil(F.col("n") / DEALT).cast("int").alias("salts")), "hot")
    salted = pairs.join(hot, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    drawn = held.select(F.col("node").alias("v"), F.col(column).alias("of_v")).join(hot, "v", "left")
    drawn = drawn.select("v", "of_v", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(held.select(F.col("node").alias("u"), F.col(column).alias("of_u")), "u").join(drawn, ["v", "salt"]).select("u", "v", "of_u", "of_v")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes): the whole shingle sets of the wanted nodes, from the texts."""
    wanted = staged(wanted.distinct().join(nodes.select("node", "first_id"), "node"), "wanted")
    marked = _bitmap(wanted.select(F.xxhash64("first_id").alias("address")))  # else all texts would become sets
    found = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_Sets(marked), "node long, hashes binary")
    return staged(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    sets = _sets(docs, nodes, pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")))
    return _dealt(pairs, sets, "hashes").mapInArrow(_similar, "u long, v long")


def _bitmap(addresses: DataFrame) -> np.ndarray:
    """The lowest bits of all addresses as a bitmap of ``FILTER_BITS`` bits, whatever their number."""
    place = F.col("address").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) + 1
    parts = addresses.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out, width = np.zeros(FILTER_BITS // 8, np.uint8), 1 << 12  # parts of 2^15 bits, counted from 1
    for r in parts.toLocalIterator():
        at = (r["n"] - 1) * width
        out[at : at + width] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def segment_values(nodes: DataFrame) -> DataFrame:
    """(node, value): the values of the segments of its fingerprint, each with the number of the segment as one integer."""
    width = WIDE_BITS // WIDE_SEGMENTS
    values = F.array(*(F.conv(F.hex(F.substring("mark", s * width // 8 + 1, width // 8)), 16, 10).cast("long") for s in range(WIDE_SEGMENTS)))
    return nodes.select("node", F.posexplode(values).alias("segment", "value")).select("node", (F.col("value") * WIDE_SEGMENTS + F.col("segment")).alias("value"))


def balls(values: DataFrame) -> DataFrame:
    """Each row of values with all addresses in the ball of its value."""
    masks = F.array(*(F.lit(m * WIDE_SEGMENTS).cast("long") for m in ball_masks(WIDE_BITS // WIDE_SEGMENTS, WIDE_RADIUS)))
    return values.select("*", F.explode(masks).alias("mask")).withColumn("address", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")


def table_rows(nodes: DataFrame) -> DataFrame:
    """(node, address): for each segment of the fingerprint all values in its ball."""
    return balls(segment_values(nodes)).select("node", "address")


def _tables(nodes: DataFrame) -> DataFrame:
    """(address, value, blocks) of addresses where fingerprints meet: those of several values, or of one that several nodes hold.

    Values are expanded, not nodes: an address has no more rows than the ball has values, whatever the size of a group.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = staged(segment_values(nodes).groupBy("value").agg(F.count("*").alias("n")), "values")
    met = balls(values.repartition(parts))  # dozens of rows from each
    buckets = met.groupBy("address").agg(F.count("*").alias("k"), F.sum("n").alias("held"), F.max(F.when(F.col("value") == F.col("address"), F.col("n"))).alias("own"))
    buckets = staged(buckets.where("k > 1 or own > 1").select("address", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "buckets")
    return staged(met.select("address", "value").join(buckets, "address"), "shared")


def _in_tables(tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cells of the tables, with the (node, root, size, mark) of those that hold a value in lists of bounded length."""
    held = segment_values(nodes).join(tables.select("value").distinct(), "value", "left_semi")
    many = staged(held.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "many")
    part = F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)))
    held = held.join(many, "value", "left").select("value", "node", part.alias("part")).join(nodes, "node")
    lists = staged(held.groupBy("value", "part").agg(F.collect_list(F.struct("node", "root", "size", "mark")).alias("holders")), "lists")
    return _cut(tables.join(lists, "value").withColumn("block", F.pmod(F.xxhash64("value", "part"), F.col("blocks")).cast("int")), "holders")


def _shared(met: DataFrame) -> DataFrame:
    """(address, node, n) of addresses that n nodes share, n > 1."""
    buckets = staged(met.groupBy("address").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    return staged(met.join(buckets, "address"), "shared")


def _tried(shared: DataFrame) -> DataFrame:
    """(u, v): all of a bucket with the member of it that meets most others."""
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    centre = shared.join(weight, "node").groupBy("address").agg(F.max(F.struct("w", "node")).alias("c")).select("address", F.col("c.node").alias("v"))
    return shared.join(centre, "address").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(address, node, root) of buckets that hold several groups; in one of two members both have been compared."""
    placed = shared.where("n > 2").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("address", "n", "node", F.coalesce("root", "node").alias("root"))
    placed = staged(placed, "placed")
    mixed = placed.groupBy("address").agg(F.min("root").alias("least"), F.max("root").alias("last")).where("least <> last").select("address")
    return placed.join(mixed, "address").select("address", "node", "root")


def _in_cells(members: DataFrame, blocks: F.Column, *columns: str) -> DataFrame:
    """The members of each cell (address, ci, cj) of two blocks together."""
    cut = members.groupBy("address").agg(F.greatest(F.lit(1), F.ceil(blocks).cast("int")).alias("blocks"))
    return _cut(members.join(cut, "address").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "root", *columns)


def _cut(members: DataFrame, *columns: str) -> DataFrame:
    """Members that know their block and the number of blocks of their address, copied to the cells of that block."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = whole.select("address", F.least("block", "other").alias("ci"), F.greatest("block", "other").alias("cj"), "block", *columns)
    return cells.repartition(parts, "address", "ci", "cj").sortWithinPartitions("address", "ci", "cj")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after joining the groups whose roots are linked; those that were alone have no row in ``roots``."""
    joined = components(links).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = joined.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return moved.unionByName(alone)


def similar_roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have a similar one, by group; what is missed are links of pairs that share neither address nor key."""
    tables = _tables(nodes.select("node", "mark"))
    alone = nodes.select("node", F.col("node").alias("root"), "size", "mark")
    led = _in_tables(tables, alone).mapInArrow(_led, "u long, v long")
    shared = _shared(nodes.select("node", F.explode("keys").alias("address")))
    tried = staged(_tried(shared), "tried")
    marked = nodes.select("node", F.struct("size", "mark").alias("seen"))
    near = _dealt(tried, marked, "seen").mapInArrow(_near, "u long, v long")
    near = staged(led.unionByName(near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near")
    roots = staged(components(staged(_verified(docs, nodes, near), "similar")), "roots")
    members = staged(_mixed(shared, roots).join(nodes.select("node", "size", "mark", "keys"), "node"), "members")
    if not members.isEmpty():
        whole = members.join(_sets(docs, nodes, members.select("node")), "node")
        blocks = F.greatest(F.count("*") / BLOCK, F.sum(F.col("size").cast("long")) * 8 / BLOCK_BYTES)
        cells = _in_cells(whole, blocks, "size", "mark", "keys", "hashes")
        roots = staged(_joined(roots, staged(cells.mapInArrow(_cells, "u long, v long"), "more")), "roots")
    placed = nodes.select("node", "size", "mark").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "mark")
    near = staged(_in_tables(tables, placed).mapInArrow(_reached, "u long, v long").distinct(), "near")
    if not near.isEmpty():
        found = staged(_verified(docs, nodes, near), "similar")
        for end in ("u", "v"):
            found = found.join(roots.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        roots = _joined(roots, found)
    return roots


def without_copies(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group of similar ones, all columns kept; of several rows of one doc_id one stays, always the same."""
    named = documents(docs, "doc_id", "text").where("doc_id is not null")
    marked = staged(named.mapInArrow(_marks, f"doc_id long, {MARKS}"), "marks")
    nodes = staged(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("mark").alias("mark"), F.first("keys").alias("keys")), "nodes")
    roots = similar_roots(named, nodes)
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").select("first_id", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first_id").alias("doc_id")).select("doc_id")
    kept = docs.join(stays, "doc_id", "left_semi").select(*docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = kept.groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.xxhash64(row))).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))
