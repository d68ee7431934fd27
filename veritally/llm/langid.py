"""Language identification by nearest centroid.

A text is a vector of hashed n-grams of letters (three bytes inside or at the edge of a word), with
logarithmic counts, inverse document frequencies, and length one. Each language has several
centroids, found by spherical k-means on a sample of its texts; the language of the centroid with
the largest cosine is predicted. A text whose cosine is below its language's distance limit is
rejected: the limit is a quarter of what all but one in a thousand training texts of the language reach.

Document frequencies are counted over all training rows. Centroids are fitted on a bounded sample:
about ``PER_LANGUAGE`` different rows of each language, by a hash of doc_id and text, and the ``MOST_LANGUAGES`` most frequent languages. Training uses rows with a text, a
language and a doc_id whose CRC-32 isn't 2 modulo 4; every row is predicted.

A text that is null or has no letter is ``und`` with score 0, and rejected. So is every text if
there is nothing to learn from. Equal cosines go to the language that sorts first. Rows with a null
doc_id are predicted and aren't held out; repeated rows, empty tables and other columns are no
special cases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents
from .bpe import byte_ranges
from .text import flat, letters

UNKNOWN = "und"
BUCKETS = 1 << 14
PER_LANGUAGE = 800
CENTROIDS = 4
MOST_LANGUAGES = 500
HELD_OUT = 2
_ANY_LETTER = regex.compile(r"\p{L}")


def grams(texts: pa.Array):
    """For each text the buckets of its n-grams with their counts."""
    raw, at = flat(texts)
    ink = letters(raw)
    joined = np.full(len(raw) + len(at) + 1, 32, np.uint8)
    place = np.arange(len(raw)) + 1 + np.repeat(np.arange(len(at) - 1), np.diff(at))
    joined[place] = ink
    middle = place[ink != 32]
    a, b, c = (joined[middle + d].astype(np.uint32) for d in (-1, 0, 1))
    bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(18)
    starts = at[:-1] + 1 + np.arange(len(at) - 1)
    cuts = np.append(np.searchsorted(middle, starts), len(middle)).tolist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        count = np.bincount(bucket[lo:hi], minlength=BUCKETS)
        used = np.flatnonzero(count)
        yield used, count[used]


def unit(count: np.ndarray, weight: np.ndarray) -> np.ndarray:
    value = (1.0 + np.log(count)) * weight
    return value / (np.sqrt(value @ value) or 1.0)


def _frequencies(batches):
    """mapInArrow function: in how many texts of the partition each bucket occurs."""
    total, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(0)):
            for used, _ in grams(batch.column(0).slice(lo, hi - lo)):
                total[used] += 1
                n += 1
    total[BUCKETS] = n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def _vectors(batches):
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(0)):
            part = batch.slice(lo, hi - lo)
            found = list(grams(part.column(0)))
            columns = [part.column(1), pa.array([u.astype("<i4").tobytes() for u, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "buckets", "counts"])


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; at most k centroids of length one."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        label = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[label == j].sum(axis=0) if (label == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    def __init__(self, languages: list[str], owner: np.ndarray, centroids: np.ndarray, weight: np.ndarray, limit: np.ndarray):
        self.languages, self.owner, self.weight, self.limit = languages, owner, weight, limit
        self.columns = np.ascontiguousarray(centroids.T)  # a row for each bucket

    def predict(self, used: np.ndarray, count: np.ndarray) -> tuple[str, float, bool]:
        if not len(self.owner) or not len(used):
            return UNKNOWN, 0.0, True
        cosine = unit(count, self.weight[used]).astype(np.float32) @ self.columns[used]
        best = int(cosine.argmax())
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.languages[self.owner[best]], score, score < self.limit[self.owner[best]]


def held_out() -> F.Column:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    rows = documents(docs, "doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    languages = sorted(sizes)
    found: dict[str, list] = {}
    if languages:
        totals = rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        count = {r["bucket"]: r["n"] for r in totals.collect()}
        n = count.pop(BUCKETS, 0)
        weight = np.log((1 + n) / (1 + np.array([count.get(i, 0) for i in range(BUCKETS)], float))) + 1
        share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))))
        u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = rows.where(u < share[F.col("lang")]).select("text", "lang").mapInArrow(_vectors, "lang string, buckets binary, counts binary")
        for r in sample.distinct().toLocalIterator():
            found.setdefault(r["lang"], []).append((bytes(r["buckets"]), bytes(r["counts"])))
    owner, centroids, limit = [], [np.zeros((0, BUCKETS), np.float32)], np.zeros(len(languages))
    for i, lang in enumerate(languages):
        distinct = sorted({v for v in found.get(lang, []) if v[0]})
        if not distinct:
            continue
        vectors = np.zeros((len(distinct), BUCKETS), np.float32)
        for row, (buckets, counts) in zip(vectors, distinct, strict=True):
            used = np.frombuffer(buckets, "<i4")
            row[used] = unit(np.frombuffer(counts, "<i4"), weight[used])
        centres = cluster(vectors, k)
        limit[i] = np.quantile((vectors @ centres.T).max(axis=1), 0.001) / 4
        owner += [i] * len(centres)
        centroids.append(centres.astype(np.float32))
    return Model(languages, np.array(owner, np.int64), np.concatenate(centroids), weight if languages else np.zeros(BUCKETS), limit)


class _Predict:
    """mapInArrow function: the columns of the input, then language, score and rejected."""

    def __init__(self, model: Model, text_at: int):
        self.model, self.text_at = model, text_at

    def __call__(self, batches):
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(self.text_at)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(self.text_at)
                out = [
                    self.model.predict(used, count) if t and _ANY_LETTER.search(t) else (UNKNOWN, 0.0, True)
                    for t, (used, count) in zip(texts.to_pylist(), grams(texts), strict=True)
                ]
                lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
                columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [f"c{i}" for i in range(part.num_columns + 3)])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` as c0, c1, ... and then language, score, rejected."""
    kinds = [*(f.dataType.simpleString() for f in docs.schema), "string", "double", "boolean"]
    return docs.mapInArrow(_Predict(model, docs.columns.index("text")), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))


def language_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    out = predicted(documents(docs, "doc_id", "text"), fit(docs)).select(F.col("c0").alias("doc_id"), F.col("c2").alias("lang_pred"), F.col("c3").alias("score"), F.col("c4").alias("rejected"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def with_language(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, all columns kept."""
    n = len(docs.columns)
    return predicted(docs, fit(docs)).where(f"not c{n + 2}").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
