"""Training-order materialisation of token ids.

The tokens of all documents, each with a closing id, run on within an input partition and are cut
into sequences of ``window`` ids; only a partition's last sequence is padded. A keyed Feistel
permutation of 0..n-1 gives every sequence its global slot: a cipher on the next even number of
bits, walked along its cycle until the value is below n. So the training order is random, needs no
sort by random keys, can be computed for any sequence alone, and is inverted by the same key.

Sequences go to range partitions by slot, one for each shard. A record has a fixed stride
(``window`` ids of two bytes, or four for large vocabularies), so slot s is at byte
(s mod shard_rows) * stride of shard s // shard_rows, and reading can start anywhere.
``write_shards`` writes the files: under a temporary name first, so a shard that exists is whole;
a repeated run writes only those that are missing or whose bytes differ. ``store`` writes all shards
in waves of consecutive ones, so that only a wave's part of the shuffle is on disk beside the
sequences and the shards, and returns the records as the files hold them. ``read_from`` opens the
shard of any slot, seeks to it and goes on from there.

Null and empty texts add their closing id alone. Repeated rows and null doc_ids are no special
cases, an empty table has no sequences, and other columns are ignored. The sequences are written
once to the shared folder before their number is known and slots are given.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SMALL_BATCHES, documents, shared_dir, staged
from .bpe import byte_ranges, word_codec

ROUNDS = 6
SHARD_ROWS = 4096
WAVES = 2
SEQUENCES = "part int, number long, n_tokens int, ids_crc32 long, ids binary"
RECORDS = "slot long, shard int, offset long, n_tokens int, ids_crc32 long, ids binary"
INDEX = "slot long, shard int, offset long, n_tokens int, ids_crc32 long, path string"


class Permutation:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1342543DE82EF95) & (2**64 - 1)) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = (right ^ self._mix(left, key), left) if back else (right, left ^ self._mix(right, key))
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), keys, back)
        while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


class _Sequences:
    """mapInArrow function: the running tokens of a partition, cut at every ``window`` ids."""

    def __init__(self, path: str, window: int, closing: int, width: int):
        self.path, self.window, self.closing, self.width = path, window, closing, width

    def __call__(self, batches):
        codec, part, number, rest = word_codec(self.path), TaskContext.get().partitionId(), 0, b""
        if max(len(codec.table.bytes_of), self.closing + 1) > 1 << 8 * self.width:
            raise ValueError(f"ids of this vocabulary don't fit {self.width} bytes")
        kind, stride = f"<u{self.width}", self.window * self.width

        def rows(ids: bytes):
            nonlocal number
            cut = [ids[at : at + stride] for at in range(0, len(ids), stride)]
            first, number = number, number + len(cut)
            sizes = [len(c) // self.width for c in cut]
            padding = int(self.closing).to_bytes(self.width, "little")
            cut = [c + padding * (self.window - n) for c, n in zip(cut, sizes, strict=True)]
            numbers = pa.array(np.arange(first, number))
            columns = [pa.array([part] * len(cut), pa.int32()), numbers, pa.array(sizes, pa.int32()), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(cut, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "n_tokens", "ids_crc32", "ids"])

        for batch in batches:
            for lo, hi in byte_ranges(batch.column(0)):
                ids, _ = codec.encode_texts(batch.column(0).slice(lo, hi - lo), self.closing)
                rest += ids.astype(kind).tobytes()
                whole = len(rest) // stride * stride
                if whole:
                    yield rows(rest[:whole])
                    rest = rest[whole:]
        if rest:
            yield rows(rest)


class _Slots:
    """mapInArrow function: sequences to records, those of the given shards."""

    def __init__(self, bases: dict[int, int], order: Permutation, stride: int, shard_rows: int, shards: range):
        self.bases, self.order, self.stride, self.shard_rows, self.shards = bases, order, stride, shard_rows, shards

    def __call__(self, batches):
        for batch in batches:
            base = np.array([self.bases[p] for p in batch.column(0).to_pylist()], np.int64)
            slot = self.order.slots(base + batch.column(1).to_numpy())
            shard, row = np.divmod(slot, self.shard_rows)
            columns = [pa.array(slot), pa.array(shard.astype(np.int32)), pa.array(row * self.stride), *batch.columns[2:]]
            found = pa.RecordBatch.from_arrays(columns, ["slot", "shard", "offset", "n_tokens", "ids_crc32", "ids"])
            yield found.filter(pa.array((shard >= self.shards.start) & (shard < self.shards.stop)))


def _sequences(docs: DataFrame, path: str, window: int, closing: int, width: int) -> tuple[DataFrame, dict[int, int], int]:
    """The sequences, the number of the first one of each partition, and how many there are."""
    cut = staged(documents(docs, "text").mapInArrow(_Sequences(path, window, closing, width), SEQUENCES), "sequences", SMALL_BATCHES)
    counts = sorted((r["part"], r["n"]) for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect())
    bases, n = {}, 0
    for part, size in counts:
        bases[part], n = n, n + size
    return cut, bases, n


def _in_order(cut: DataFrame, slots: _Slots) -> DataFrame:
    shards = slots.shards
    return cut.mapInArrow(slots, RECORDS).repartitionById(max(1, len(shards)), F.col("shard") - shards.start).sortWithinPartitions("slot")


def records(docs: DataFrame, path: str, key: int = 1, window: int = 2048, closing: int = 1, width: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All sequences as records in slot order: a partition of the result for each shard."""
    cut, bases, n = _sequences(docs, path, window, closing, width)
    return _in_order(cut, _Slots(bases, Permutation(n, key), window * width, shard_rows, range(-(-n // shard_rows))))


def _same(system, path: str, data: bytes) -> bool:
    """Whether the file has just these bytes, by size and CRC."""
    from pyarrow.fs import FileType

    info = system.get_file_info(path)
    if info.type != FileType.File or info.size != len(data):
        return False
    crc = 0
    with system.open_input_stream(path) as file:
        while part := file.read(1 << 20):
            crc = zlib.crc32(part, crc)
    return crc == zlib.crc32(data)


class _Write:
    """mapInArrow function: records in slot order to a file for each shard; rows are its manifest row, or its records with its path."""

    def __init__(self, folder: str, manifest: bool):
        self.folder, self.manifest = folder, manifest

    def __call__(self, batches):
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(self.folder)
        system.create_dir(root, recursive=True)
        at, held, kept = None, [], []

        def close():
            data = b"".join(held)
            final = f"{root}/shard-{at:08d}.bin"
            written = not _same(system, final, data)
            if written:
                attempt = TaskContext.get().taskAttemptId()
                with system.open_output_stream(f"{final}.{attempt}.tmp") as file:
                    file.write(data)
                system.move(f"{final}.{attempt}.tmp", final)
            if not self.manifest:
                found = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                return pa.RecordBatch.from_arrays([*found.columns, pa.array([final] * len(held))], [*found.schema.names, "path"])
            columns = [pa.array([at], pa.int32()), pa.array([final]), pa.array([len(held)], pa.int64()), pa.array([zlib.crc32(data)], pa.int64()), pa.array([written])]
            return pa.RecordBatch.from_arrays(columns, ["shard", "path", "n_sequences", "crc32", "written"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != at and held:
                    yield close()
                    held, kept = [], []
                at = int(shards[lo])
                part = batch.slice(lo, hi - lo)
                held += part.column("ids").to_pylist()
                kept.append(part.select([c for c in part.schema.names if c != "ids"]))
        if held:
            yield close()


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Manifest (shard, path, n_sequences, crc32, written) of the files; evaluating it writes them.

    ``folder`` is a URI that pyarrow opens on every executor. Files of shards that ``rows`` doesn't have are left alone.
    """
    return rows.select("shard", "ids").mapInArrow(_Write(folder, True), "shard int, path string, n_sequences long, crc32 long, written boolean")


class _Read:
    """mapInArrow function: records with the path of their shard, to those with the bytes that stand there."""

    def __init__(self, folder: str, stride: int):
        self.folder, self.stride = folder, stride

    def __call__(self, batches):
        from pyarrow.fs import FileSystem

        system, _ = FileSystem.from_uri(self.folder)
        path, file = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part, ids = batch.slice(lo, 1024), []
                for where, offset, crc in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "ids_crc32")), strict=True):
                    if where != path:
                        if file:
                            file.close()
                        path, file = where, system.open_input_file(where)
                    file.seek(offset)
                    ids.append(file.read(self.stride))
                    if zlib.crc32(ids[-1]) != crc:
                        raise ValueError(f"{where} at {offset}: the bytes aren't those that were written")
                columns = [*part.columns[:5], pa.array(ids, pa.binary()), part.column("path")]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:5], "ids", "path"])
        if file:
            file.close()


def store(docs: DataFrame, path: str, folder: str = "", key: int = 1, window: int = 2048, closing: int = 1, width: int = 2, shard_rows: int = SHARD_ROWS, waves: int = WAVES) -> DataFrame:
    """Write all sequences as shards; the records, each with the file it stands in and the bytes read from there.

    ``folder`` is a URI that pyarrow opens on every executor; without one a new folder in the shared folder. The shards go
    to a folder in it that is named by a fingerprint of the key, the layout and all sequences in their order. So a
    rerun finds what it has written, and shards of another key, corpus or partitioning never mix with these.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/veritally-{spark.sparkContext.applicationId}/shards-{uuid.uuid4().hex}"
    cut, bases, n = _sequences(docs, path, window, closing, width)
    total = cut.agg(F.sum(F.xxhash64("part", "number", "n_tokens", "ids_crc32").cast("decimal(38,0)"))).first()[0]
    facts = (str(total), n, key, window, closing, width, shard_rows, path.rsplit("/", 1)[-1])
    folder = f"{folder.rstrip('/')}/{hashlib.sha256(repr(facts).encode()).hexdigest()[:16]}"
    shards, order = -(-n // shard_rows), Permutation(n, key)
    each = max(1, -(-shards // waves))
    index = spark.createDataFrame([], INDEX)
    for first in range(0, shards, each):
        rows = _in_order(cut, _Slots(bases, order, window * width, shard_rows, range(first, min(shards, first + each))))
        index = index.unionByName(staged(rows.mapInArrow(_Write(folder, False), INDEX), "shard-index", SMALL_BATCHES))
    return index.mapInArrow(_Read(folder, window * width), RECORDS + ", path string")


def read_from(folder: str, slot: int, n: int, window: int = 2048, width: int = 2, shard_rows: int = SHARD_ROWS) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from ``slot`` on to the last of the ``n`` slots; to resume, start at the slot after the last one read."""
    from pyarrow.fs import FileSystem

    system, root = FileSystem.from_uri(folder)
    stride = window * width
    while slot < n:
        shard, row = divmod(slot, shard_rows)
        with system.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(row * stride)
            for slot in range(slot, min(n, (shard + 1) * shard_rows)):
                ids = file.read(stride)
                if len(ids) < stride:
                    raise EOFError(f"shard {shard} ends before slot {slot}")
                yield slot, np.frombuffer(ids, f"<u{width}")
        slot += 1
