"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has ordered grades 0 (clean) to ``GRADES``. P(grade >= k) is a logistic function of one
linear score minus the k-th threshold: the thresholds are ordered and share the weights. The
output is the expected severity, the sum of these probabilities; a document is rejected when
P(grade >= 1) reaches one half.

Features are whole words, of any length, and word beginnings of 3 to 10 bytes (abuse is inflected), each by its
density in the text on a log scale. Labels only say toxic or not, so toxic rows are graded by how much of the vocabulary that
marks toxic rows they hold: thirds of that mass are grades 1 to 3.

The model is fitted on a bounded sample of labelled documents (``PER_CLASS`` toxic doc_ids and three times as
many clean ones, by a hash of doc_id; of several rows of a doc_id one text counts, always the same) and on the ``FEATURES`` features most associated with the
label in that sample; an L1 penalty leaves few weights. Scoring covers every row and whole texts.

Null and empty texts, and texts without a letter, have severity 0. Labels with a null doc_id or a
null label are not used; of repeated labels the most toxic holds. Without toxic or without clean
labels nothing can be learned and every severity is 0. Null doc_ids and repeated rows are scored
like others; empty tables give empty tables, and other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, staged
from .bpe import byte_ranges, give_back
from .text import flat, letters, prefix_hashes, word_hashes, words

GRADES = 3
PER_CLASS = 3000
FEATURES = 4000
PREFIXES = range(3, 11)
SMOOTHING = 50.0
PENALTY = 2e-4
#: Sets whole words apart from beginnings of the same bytes.
WHOLE = np.uint64(0xC2B2AE3D27D4EB4F)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) for every word and beginning, and the number of words of each text."""
    raw, at = flat(texts)
    raw = letters(raw)
    start, end, text = words(raw, at)
    owner, feature = [text], [word_hashes(raw, start, end) ^ WHOLE]
    for _, which, value in prefix_hashes(raw, start, end, PREFIXES):
        owner.append(text[which])
        feature.append(value)
    return np.concatenate(owner), np.concatenate(feature), np.bincount(text, minlength=len(at) - 1)


def density(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.log1p(100.0 * count / (n_words + SMOOTHING))


def _census(batches):
    """mapInArrow function: rows of either label that hold each feature, a row per batch and feature."""
    for batch in batches:
        for lo, hi in byte_ranges(batch.column(0)):
            part = batch.slice(lo, hi - lo)
            owner, feature, _ = features(part.column(0))
            toxic = part.column(1).to_numpy(zero_copy_only=False) > 0
            order = np.lexsort((owner, feature))
            owner, feature = owner[order], feature[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])
            owner, feature = owner[new], feature[new]
            head = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, np.int64)
            total = np.diff(np.append(head, len(feature)))
            bad = np.add.reduceat(toxic[owner].astype(np.int64), head) if len(head) else head
            yield pa.RecordBatch.from_arrays([pa.array(feature[head].view(np.int64)), pa.array(total), pa.array(bad)], ["feature", "n", "n_toxic"])


class _Lookup:
    """Places of features in a small sorted vocabulary."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(vocabulary >> np.uint64(46)).astype(np.int64)] = True

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: text, place, value."""
        owner, feature, n_words = features(texts)
        hit = np.flatnonzero(self.sieve[(feature >> np.uint64(46)).astype(np.int64)])
        owner, feature = owner[hit], feature[hit]
        place = np.searchsorted(self.vocabulary, feature)
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == feature if len(self.vocabulary) else np.zeros(len(place), bool)
        key, count = np.unique(owner[known] * len(self.vocabulary) + place[known], return_counts=True)
        owner, place = np.divmod(key, max(1, len(self.vocabulary)))
        return owner, place, density(count, n_words[owner])


class _Rows:
    """mapInArrow function: sparse feature rows of the sample, places and amounts as bytes: few objects for the driver."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary

    def __call__(self, batches):
        lookup = _Lookup(self.vocabulary)
        for part in (batch.slice(lo, hi - lo) for batch in batches for lo, hi in byte_ranges(batch.column(0))):
            owner, place, value = lookup.counts(part.column(0))
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
            place, cuts = place.astype("<i4"), list(zip(ends[:-1], ends[1:], strict=True))
            columns = [part.column(1), pa.array([place[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "places", "amounts"])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Sparse:
    """Rows of a sparse matrix with the two products that fitting needs."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int, width: int):
        self.rows, self.columns, self.values, self.n, self.width = rows, columns, values, n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.width)


def cumulative_link(x: Sparse, grade: np.ndarray, n_grades: int, penalty: float = PENALTY, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood (accelerated proximal steps)."""

    def thresholds(free: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(free[0], np.exp(np.clip(free[1:], -20, 20))))

    def loss(w: np.ndarray, free: np.ndarray):
        cut = np.concatenate([[-np.inf], thresholds(free), [np.inf]])
        score = x.dot(w)
        low, high = _logistic(score - cut[grade]), _logistic(score - cut[grade + 1])
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        g_score = -(d_low - d_high) / p / x.n
        g_cut = np.zeros(n_grades + 2)
        np.add.at(g_cut, grade, d_low / p / x.n)
        np.add.at(g_cut, grade + 1, -d_high / p / x.n)
        inner = g_cut[1:-1]
        tail = np.cumsum(inner[::-1])[::-1]
        g_free = np.append(tail[0], tail[1:] * np.exp(np.clip(free[1:], -20, 20)))
        return -np.log(p).mean(), x.back(g_score), g_free

    w, free = np.zeros(x.width), np.append(1.0, np.zeros(n_grades - 1))
    at_w, at_free, step, pace = w, free, 1.0, 1.0
    for _ in range(rounds):
        value, g_w, g_free = loss(at_w, at_free)
        while True:
            moved = at_w - step * g_w
            new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            new_free = at_free - step * g_free
            d_w, d_free = new_w - at_w, new_free - at_free
            bound = value + g_w @ d_w + g_free @ d_free + (d_w @ d_w + d_free @ d_free) / (2 * step)
            if loss(new_w, new_free)[0] <= bound + 1e-12 or step < 1e-9:
                break
            step /= 2
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        at_w, at_free = new_w + (pace - 1) / new_pace * (new_w - w), new_free + (pace - 1) / new_pace * (new_free - free)
        change = max(np.abs(new_w - w).max(initial=0), np.abs(new_free - free).max())
        w, free, pace, step = new_w, new_free, new_pace, step * 1.3
        if change < 1e-4:
            break
    return w, thresholds(free)


class Model:
    """The features with a weight, their weights, and the thresholds; empty if nothing was learned."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        used = np.flatnonzero(weights)
        self.vocabulary, self.weights, self.thresholds = vocabulary[used], weights[used], thresholds

    def chances(self, lookup: _Lookup, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in the columns."""
        if not len(self.thresholds):
            return np.zeros((len(texts), 1))
        owner, place, value = lookup.counts(texts)
        score = np.bincount(owner, value * self.weights[place], len(texts)) if len(owner) else np.zeros(len(texts))
        out = _logistic(score[:, None] - self.thresholds)
        out[np.bincount(owner, minlength=len(texts)) == 0] = 0.0  # without any known feature
        return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_features: int = FEATURES) -> Model:
    """Learn from a bounded sample of the labelled documents."""
    known = documents(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(3 * per_class))
    met = documents(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    sample = staged(one.select("t.text", "toxic"), "toxicity-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if len(size) < 2:
        return nothing
    rate, base = F.col("n_toxic") / F.lit(size[1]), (F.col("n") - F.col("n_toxic")) / F.lit(size[0])
    census = sample.mapInArrow(_census, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    ranked = census.where("n >= 3").select("feature", (rate - base).alias("gain"), ((rate - base) / F.sqrt(rate + base + 1e-3)).alias("strength"))
    rows = ranked.orderBy(F.abs("strength").desc(), "feature").limit(n_features).collect()
    if not rows:
        return nothing
    gain = {np.uint64(r["feature"] & (2**64 - 1)): r["gain"] for r in rows}
    vocabulary = np.sort(np.array(list(gain), np.uint64))
    gains = np.maximum(np.array([gain[v] for v in vocabulary]), 0)
    found = sample.mapInArrow(_Rows(vocabulary), "toxic int, places binary, amounts binary").collect()
    places, amounts = (np.frombuffer(b"".join(r[c] for r in found), kind) for c, kind in (("places", "<i4"), ("amounts", "<f8")))
    x = Sparse(np.repeat(np.arange(len(found)), [len(r["places"]) // 4 for r in found]), places.astype(np.int64), amounts, len(found), len(vocabulary))
    toxic = np.array([r["toxic"] for r in found]) > 0
    del found
    mass = x.dot(gains)
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(mass[toxic], np.arange(1, GRADES) / GRADES), mass, "right"), 0)
    model = Model(vocabulary, *cumulative_link(x, grade, GRADES))
    del x, places, amounts
    give_back()
    return model


class _Score:
    """mapInArrow function: the columns of the input and then the score of its text."""

    def __init__(self, model: Model, text_at: int):
        self.model, self.text_at = model, text_at

    def __call__(self, batches):
        lookup = _Lookup(self.model.vocabulary)
        for batch in batches:
            for lo, hi in byte_ranges(batch.column(self.text_at)):
                part = batch.slice(lo, hi - lo)
                chance = self.model.chances(lookup, part.column(self.text_at))
                columns = [pa.array(chance.sum(axis=1)), pa.array((chance >= 0.5).sum(axis=1).astype(np.int32)), pa.array(chance[:, 0]), pa.array(chance[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [f"c{i}" for i in range(part.num_columns + 4)])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` as c0, c1, ... and then expected severity, grade, P(toxic), rejected."""
    n = len(docs.columns)
    kinds = [*(f.dataType.simpleString() for f in docs.schema), "double", "int", "double", "boolean"]
    return docs.mapInArrow(_Score(model, docs.columns.index("text")), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).select(
        *(F.col(f"c{i}") for i in range(n + 4))
    )


def severity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, grade, toxic_probability, rejected) of every document."""
    return scored(documents(docs, "doc_id", "text"), fit(docs, labels)).select(
        F.col("c0").alias("doc_id"), F.col("c2").alias("severity"), F.col("c3").alias("grade"), F.col("c4").alias("toxic_probability"), F.col("c5").alias("rejected")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, all columns kept."""
    n = len(docs.columns)
    return scored(docs, fit(docs, labels)).where(f"not c{n + 3}").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
