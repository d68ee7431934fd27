"""Substring deduplication by seed and extend.

A repeat is a passage of at least ``window`` words that also stands in a document with a smaller
doc_id; a word goes if such a passage covers it. Documents are judged on the input, not on what is
left of others.

* Seeds: of the ``SEED_WORDS``-word hashes in each window the smallest, leftmost first, is the
  window's anchor (winnowing). Equal windows have equal anchors, so a window can only repeat where
  its anchor does. Consecutive windows with one anchor form a run.
* Join: anchors that stand in two documents or more are found by their smallest and largest
  doc_id, which needs a row for each key and task only. Runs at other anchors need no more work.
* Extend: every run is compared, window by window to the left and right of the anchor, with the
  runs of the first document that has the anchor. Windows that match are repeats. A window that
  doesn't, if it repeats at all, repeats one that didn't match either, so what is left over is
  compared among itself, by its smallest doc_id.
* The union of matching windows are the maximal repeats; their words are removed.

No pairs of documents are listed: a passage that a million documents share costs a million rows.
Windows are compared by anchor and window hash, 128 bits together.

Null and empty texts have no words. A null doc_id is neither smaller nor larger than any: the row
stays whole and removes nothing. Rows that share a doc_id count as one document and should hold the
same text; each gets its row. An empty table gives an empty table, and other columns are ignored
(``without_repeats`` carries them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, staged
from .bpe import byte_ranges
from .text import MIX_2, flat, gram_hashes, word_hashes, words

WINDOW = 13
SEED_WORDS = 4
RUN_BITS = 16  # a run has at most WINDOW - SEED_WORDS + 1 windows


class _Runs:
    """The runs of a batch of texts: anchor hash, first window, number of windows, text, number there."""

    def __init__(self, texts: pa.Array, window: int, hashes: bool = False):
        raw, at = flat(texts)
        start, end, text = words(raw, at)
        n, reach = len(start), window - SEED_WORDS + 1
        word = word_hashes(raw, start, end)
        whole = text[: n - window + 1] == text[window - 1 :] if n >= window else np.zeros(0, bool)
        first = np.flatnonzero(whole)
        seeds = gram_hashes(word, SEED_WORDS)
        if len(first):
            anchor = np.lib.stride_tricks.sliding_window_view(seeds, reach).argmin(axis=1)[: len(whole)] + np.arange(len(whole))
            anchor = anchor[first]
            new = np.ones(len(first), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[first[1:]] != text[first[:-1]])
            head = np.flatnonzero(new)
        else:
            anchor, head = first, first
        self.key = seeds[anchor[head]].view(np.int64) if len(head) else np.zeros(0, np.int64)
        self.window_at = first[head]
        self.size = np.diff(np.append(head, len(first)))
        self.text = text[self.window_at]
        self.base = np.searchsorted(self.text, np.arange(len(at)))
        self.nth = np.arange(len(head)) - self.base[self.text]
        self.word_text, self.raw, self.start, self.end = text, raw, start, end
        self.windows = gram_hashes(word, window, MIX_2).view(np.int64) if hashes else None

    def known(self, owner: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nth run of each owner, and which of them exist."""
        run = self.base[owner] + nth
        return run, run < self.base[owner + 1]


class _Anchors:
    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches):
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                runs = _Runs(part.column(1), self.window)
                ids = part.column(0).take(pa.array(runs.text))
                yield pa.RecordBatch.from_arrays([pa.array(runs.key), ids, pa.array(runs.nth.astype(np.int32))], ["anchor", "doc_id", "nth"])


class _Contexts:
    """mapInArrow function: the window hashes of the runs named for each document."""

    def __init__(self, window: int):
        self.window = window

    def __call__(self, batches):
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                runs = _Runs(part.column(1), self.window, True)
                named = part.column(2)
                owner = np.repeat(np.arange(len(named)), named.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                code = named.flatten().to_numpy(zero_copy_only=False)
                run, there = runs.known(owner, code >> 1)
                run, owner, code = run[there], owner[there], code[there]
                size = runs.size[run]
                ends = np.cumsum(size)
                spot = np.repeat(runs.window_at[run] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(runs.windows[spot]))
                columns = [pa.array(runs.key[run]), part.column(0).take(pa.array(owner)), pa.array((code >> 1).astype(np.int32)), pa.array(code & 1 == 1), lists]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "nth", "is_first", "windows"])


class _Remove:
    """mapInArrow function: words that repeated windows cover, as a digest or cut out of the text.

    The last column names the windows; for the digest doc_id and text come before it.
    """

    def __init__(self, window: int, digest: bool, text_at: int):
        self.window, self.digest, self.text_at = window, digest, text_at

    def covered(self, runs: _Runs, named: pa.Array) -> np.ndarray:
        owner = np.repeat(np.arange(len(named)), named.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        code = named.flatten().to_numpy(zero_copy_only=False)
        run, there = runs.known(owner, code >> RUN_BITS)
        run, mask = run[there], code[there] & ((1 << RUN_BITS) - 1)
        change = np.zeros(len(runs.start) + 1, np.int64)
        for bit in range(self.window - SEED_WORDS + 1):
            hit = run[mask >> bit & 1 == 1]
            np.add.at(change, runs.window_at[hit] + bit, 1)
            np.add.at(change, runs.window_at[hit] + bit + self.window, -1)
        return np.cumsum(change[:-1]) > 0

    def __call__(self, batches):
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(self.text_at)):
                part = batch.slice(lo, hi - lo)
                runs = _Runs(part.column(self.text_at), self.window)
                gone = self.covered(runs, part.column(part.num_columns - 1))
                cuts = np.searchsorted(runs.word_text, np.arange(len(part) + 1))
                yield self.digests(part, runs, gone, cuts) if self.digest else self.texts(part, runs, gone, cuts)

    def digests(self, part, runs, gone, cuts):
        data, hashes = runs.raw.tobytes(), []
        spans = list(zip(runs.start.tolist(), runs.end.tolist(), strict=True))
        keep = (~gone).tolist()
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            line = b" ".join([data[a:b] for (a, b), k in zip(spans[i:j], keep[i:j], strict=True) if k])
            hashes.append(hashlib.sha256(line).hexdigest())
        total = np.concatenate([[0], np.cumsum(gone)])
        columns = [part.column(0), pa.array(np.diff(cuts)), pa.array(total[cuts[1:]] - total[cuts[:-1]]), pa.array(hashes, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    def texts(self, part, runs, gone, cuts):
        """Untouched texts stay as they are; else removed words go with the white space before them."""
        out = part.column(self.text_at).to_pylist()
        data = runs.raw.tobytes()
        for d in np.unique(runs.word_text[gone]).tolist():
            i, j = int(cuts[d]), int(cuts[d + 1])
            kept = np.flatnonzero(~gone[i:j]) + i
            before = np.where(kept > i, runs.end[kept - 1], runs.start[kept])
            pieces = [data[a:b] for a, b in zip(before.tolist(), runs.end[kept].tolist(), strict=True)]
            out[d] = b"".join(pieces).strip().decode("utf-8", "replace")
        columns = list(part.columns[:-1])
        columns[self.text_at] = pa.array(out, part.column(self.text_at).type)
        return pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, windows): for each document with repeats, runs and their windows that repeat.

    An entry holds the number of the run, and in the lower bits one for each of its windows.
    """
    texts = documents(docs, "doc_id", "text").where("doc_id is not null")
    anchors = texts.mapInArrow(_Anchors(window), "anchor long, doc_id long, nth int")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    shared = staged(shared.where("first_id < last_id").drop("last_id"), "shared-anchors")
    code = F.col("nth") * 2 + (F.col("doc_id") == F.col("first_id")).cast("int")
    named = anchors.join(shared, "anchor").select("doc_id", code.alias("code"))
    named = staged(named.groupBy("doc_id").agg(F.collect_list("code").alias("codes")), "named-runs")

    schema = "anchor long, doc_id long, nth int, is_first boolean, windows array<long>"
    contexts = staged(texts.join(named, "doc_id").select("doc_id", "text", "codes").mapInArrow(_Contexts(window), schema), "contexts")
    first = contexts.where("is_first").groupBy("anchor").agg(F.array_distinct(F.flatten(F.collect_list("windows"))).alias("known"))
    first = staged(first, "first-contexts")

    bits = F.aggregate(
        F.transform("windows", lambda w, i: F.when(F.array_contains("known", w), F.expr("1L") * F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    full = F.pow(F.lit(2), F.size("windows")).cast("long") - 1
    met = contexts.where("not is_first").join(first, "anchor").select("anchor", "doc_id", "nth", "windows", bits.alias("mask"))
    met = staged(met.select("doc_id", "nth", "mask", *(F.when(F.col("mask") != full, F.col(c)).alias(c) for c in ("anchor", "windows"))), "extended")

    rest = met.where("windows is not null").select("anchor", "doc_id", "nth", "mask", F.posexplode("windows").alias("bit", "w"))
    rest = rest.where(F.expr("mask & shiftleft(1L, bit) = 0")).select("anchor", "w", "doc_id", "nth", "bit")
    again = rest.groupBy("anchor", "w").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    again = staged(again.where("first_id < last_id").drop("last_id"), "left-over")
    late = rest.join(again, ["anchor", "w"]).where("doc_id > first_id").select("doc_id", "nth", F.expr("shiftleft(1L, bit)").alias("mask"))
    found = met.where("mask > 0").select("doc_id", "nth", "mask").union(late)
    entry = F.shiftleft(F.col("nth").cast("long"), RUN_BITS) + F.col("mask")
    return staged(found.select("doc_id", entry.alias("entry")).groupBy("doc_id").agg(F.collect_list("entry").alias("windows")), "repeats")


def removal_table(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: words, removed words, and the SHA-256 of the kept words joined by one space."""
    texts = documents(docs, "doc_id", "text")
    marked = texts.join(repeated_windows(docs, window), "doc_id", "left").select("doc_id", "text", "windows")
    return marked.mapInArrow(_Remove(window, True, 1), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns, with the repeats cut out of ``text``."""
    found = repeated_windows(docs, window)
    mark = "windows"
    while mark in docs.columns:
        mark += "_"
    marked = docs.join(found.withColumnRenamed("windows", mark), "doc_id", "left").select(*(F.col(f"`{c}`") for c in docs.columns), mark)
    return marked.mapInArrow(_Remove(window, False, docs.columns.index("text")), docs.schema)
