"""Audit of filters, sharding and whitening against brute force, on small tables and awkward rows."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from veritally.llm import audit, sharding, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, shard string, hash int, failed string, good int, counts int"
SHORT, LONG = "word " * 120, " ".join(f"w{i}" for i in range(30_000))
VARIED = " ".join(f"v{i}" for i in range(150))
ODD = [
    (1, "", "en"), (2, None, "en"), (3, " \n\t ", None), (4, VARIED, "en"), (5, VARIED, "de"), (5, VARIED, "de"), (None, VARIED, "de"), (None, None, None), (6, LONG, ""), (7, LONG, "fr"),
    (8, SHORT + "CAPITALS " * 90, "fr"), (9, VARIED + " 5$ & more", "fr"), (10, "É中🙂 " * 40 + VARIED, "de"), (11, "A\x1cB\x85C", "de"), (4, VARIED, "en"), (0, "x" * 70_000, "en"),
]
LABELS = [(1, 1, 0), (4, 1, None), (4, 0, 1), (5, None, None), (None, 1, 1), (9, 0, 1), (10, 1, 0), (99, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", 1, "f", 1, 1) for i, t, lang in ODD], DOCS)


def expected(rows, labels):
    """Every order on every document, one after the other."""
    says = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            says[i][0] |= q == 1
            says[i][1] |= t == 1
    first, fails = {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", {k for k, v in bad.items() if v}, *(says[i] if i is not None else (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        own, shapley = [f for f in fails if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = sum(x in f[1] for f in own)
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for key in list(out):
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return out


def test_audit_equals_every_order_one_by_one(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = {tuple(r)[:3]: list(r)[3:] for r in audit.audit(odd, labels).collect()}
    assert found == expected([(i, t, lang) for i, t, lang in ODD], LABELS)
    assert len(found) == 4 * 600  # en, de, fr and the null language


def test_audit_equals_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert Counter(map(tuple, audit.audit(docs, labels).collect())) == Counter(db.execute(audit.SQL).fetchall())


def test_audit_of_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(odd.limit(0), labels).collect() == []
    assert {r.good_lost + r.toxic_lost for r in audit.audit(odd, labels).collect()} == {0}


def test_positional_counts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 10_000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_counts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert audit.WORDS[0] == (1 << 32) - 1 and bin(audit.WORDS[31]).count("1") == 1


def brute_shard(key, weights, seed=sharding.SEED):
    """One key at a time, in Python's own integers."""
    mask = (1 << 64) - 1

    def spread(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def number(s):
        salt = spread(((s + 1) * 0x9E3779B97F4A7C15 & mask) ^ spread((seed * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & mask))
        return spread(spread((key * 0xD6E8FEB86659FD93 + salt) & mask) ^ salt)

    if len(set(weights)) == 1:
        return max(range(len(weights)), key=lambda s: (number(s), -s))
    return min((s for s in range(len(weights)) if weights[s]), key=lambda s: (-np.log(((number(s) >> 11) + 0.5) / 2.0**53) / weights[s], s))


def test_sharding_of_odd_rows(odd):
    rows = sharding.shard_table(odd).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key") for i, t, _ in ODD)
    assert Counter(tuple(r)[:4] for r in rows) == want
    for r in rows:
        key = int(sharding._NULL_KEY) if r.doc_id is None else r.doc_id
        assert r.shard == brute_shard(key, [1] * 40) and r.grown_shard == brute_shard(key, [1] * 41)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_table(odd.limit(0)).collect() == []


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    rows = sharding.assign(ids, "k").collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 40 for r in moved) and 0.8 < len(moved) / (len(rows) / 41) < 1.2
    assert max(Counter(r.shard for r in rows).values()) < 1.2 * 500
    again = {r.k: r.shard for r in sharding.assign(ids, "k", 41).collect()}
    assert all(again[r.k] == r.grown_shard for r in rows)


def test_weights(spark):
    ids = spark.range(-5_000, 15_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 0.0, 5.0]
    rows = sharding.assign(ids, "k", 4, weights, grown_weight=2.0).collect()
    share = Counter(r.shard for r in rows)
    assert not share[2] and all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate(weights))
    assert all(r.grown_shard in (4, r.shard) for r in rows) and abs(sum(r.grown_shard == 4 for r in rows) / 20_000 - 0.2) < 0.02
    assert all(r.shard == brute_shard(r.k % (1 << 64), weights) for r in rows[:200])
    less = {r.k: r.shard for r in sharding.assign(ids, "k", 4, [1.0, 2.0, 0.0, 4.0]).collect()}
    assert all(less[r.k] == r.shard for r in rows if r.shard != 3)  # only the lighter shard gives rows
    for bad in ([0.0] * 4, [1.0, -1.0, 1.0, 1.0], [1.0]):
        with pytest.raises(ValueError):
            sharding.assign(ids, "k", 4, bad)
    with pytest.raises(ValueError):
        sharding.assign(ids.withColumn("Shard", ids["k"]), "k")


def test_written_shards(spark, odd, tmp_path):
    rows = odd.drop("shard")
    sharding.write_shards(rows, "doc_id", f"{tmp_path}/out", 5, file_rows=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter((r.doc_id, r.text, r.lang) for r in back.collect()) == Counter(ODD)
    placed = {(r.doc_id, r.shard) for r in back.select("doc_id", "shard").collect()}
    assert placed == {(r.doc_id, r.shard) for r in sharding.assign(rows, "doc_id", 5).collect()}
    words = sharding.assign(rows, "text", 7).collect()  # any column can be the key
    assert len({(r.text, r.shard) for r in words}) == len({r.text for r in words})


VECTORS = "vec_id long, embedding array<float>, component string, n int, width int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", 1, 1) for i, v in rows], VECTORS)


def check(found, rows, most=8):
    """Against exact integers and the eigenvectors of the covariance."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    y = (x - np.array([int(t) / n for t in s])).astype(float)
    e, vectors = np.linalg.eigh(y.T @ y / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    keep = min(most, int((e > 1e-12 * e[0]).sum()))
    by = defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    assert len(found) == len(good) * keep and {r.n for r in found} == {n}
    assert Counter((i, int(d)) for (i, _), d in zip(good, deviation, strict=True) for _ in range(keep)) == Counter((r.vec_id, r.deviation) for r in found)
    white = y @ vectors[:, :keep] / np.sqrt(e[:keep])
    for k in range(keep):
        got = {r.vec_id: r.whitened for r in found if r.component == k + 1}
        want = {i: w for (i, _), w in zip(good, white[:, k].tolist(), strict=True)}
        sign = np.sign(sum(got[i] * want[i] for i in got))
        assert all(abs(got[i] - sign * want[i]) < 1e-6 for i in got)
        explained = {r.explained for r in found if r.component == k + 1}
        assert len(explained) == 1 and abs(explained.pop() / (e[k] / e.sum()) - 1) < 1e-6
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * np.logspace(0, 2, 12) + 50
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)] + [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    check(whitening.whiten(table(spark, rows)).collect(), rows)
    check(whitening.whiten(table(spark, rows), 3).collect(), rows, 3)


def test_whitening_without_full_rank(spark):
    rng = np.random.default_rng(2)
    few = [(i, np.round(v).tolist()) for i, v in enumerate(rng.normal(size=(40, 3)) @ rng.normal(size=(3, 10)) * 5)]
    flat = [(i, [float(3 * i % 7), 2.0, float(i), 2.0 * i]) for i in range(20)]
    single, same = [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]
    for rows in (flat, few):
        check(whitening.whiten(table(spark, rows)).collect(), rows)
    for rows in (single, same, []):
        assert whitening.whiten(table(spark, rows)).collect() == []


def test_whitening_of_repeats_nulls_and_widths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))]
    other = [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 2)))]
    both = whitening.whiten(table(spark, rows + other)).collect()
    check([r for r in both if r.vec_id < 100], rows)
    check([r for r in both if r.vec_id >= 100], other)
    hot = rows + [(None, rows[0][1])] + [(0, rows[0][1])] * 200
    found = whitening.whiten(table(spark, hot)).collect()
    assert len(found) == 4 * len(hot) and {r.n for r in found} == {261} and sum(r.vec_id is None for r in found) == 4
    with pytest.raises(Exception, match="2\\^52"):
        whitening.whiten(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()


def test_triangles_keep_small_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(400, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    sizes = np.logspace(0, -9, 6)
    a = (q * sizes) @ v.T

    def gram(factors):
        rows = whitening._solved(a, factors)
        return rows.T @ rows

    got = np.linalg.svd(whitening.orthogonal_factor(gram, *a.shape))[1]
    assert np.allclose(got / sizes, 1, atol=1e-5)  # the Gram matrix of a has lost all digits of the last


def test_uniform_threshold_touches_few_pairs():
    """Every pair that reaches a cutoff passes; of vectors of very different lengths few partial scores are worked out."""
    from veritally.llm import topk

    rng = np.random.default_rng(7)
    for skew, most in ((2.0, 0.15), (0.0, 1.0)):
        c = np.floor(rng.normal(size=(3000, 32)) * 200 * np.exp(skew * rng.normal(size=(3000, 1))))
        q = np.floor(rng.normal(size=(40, 32)) * 200)
        total = q @ c.T
        cut = np.sort(total, axis=1)[:, -5]
        bounds = topk._bounds(32)
        segments = [(q[:, a:b], c[:, a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        enough, touched = topk.uniform_entries(segments, cut)
        assert enough[total >= cut[:, None]].all() and enough.mean() < 0.3 * (1 + most)
        assert touched <= most * 4 * total.size
        everything, _ = topk.uniform_entries(segments, np.full(40, -np.inf))
        assert everything.all()
        low, _ = topk.uniform_entries(segments, np.full(40, -1e4))  # a cutoff below zero
        assert low[total >= -1e4].all()


def test_blocks_that_cannot_matter_are_not_sent(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veritally.llm import topk

    monkeypatch.setattr(topk, "BLOCK_ROWS", 32)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 1)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCKS", 1)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 12)) * np.exp(3 * rng.normal(size=(1500, 1)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    sizes, sent = [], topk._sent

    def counted(queries, candidates, n):
        out = sent(queries, candidates, n)
        sizes.append((candidates.count() * n, out.count(), queries.where(F.exists("need", lambda x: x > 0)).count()))
        return out

    monkeypatch.setattr(topk, "_sent", counted)
    found = sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0", 5).collect()))
    x = np.floor(v * 256)
    want = []
    for i in range(0, 1500, 50):
        best = sorted(((-int(x[i] @ x[j]), j) for j in range(1500) if j != i))[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert found == sorted(want)
    everything, passed, bounded = sizes[-1]
    assert bounded and passed < 0.5 * everything


def test_severity_by_hand(spark, monkeypatch):
    """A document's severity from the weights and thresholds of the model, word by word; a hot doc_id doesn't fill the sample."""
    from veritally.llm import toxicity
    from veritally.llm.text import KEEP, MIX, MIX_2, _BYTE, _spread

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    mask = (1 << 64) - 1

    def whole(word):
        """The hash of a word of eight bytes at most."""
        lane = int.from_bytes(word[:8].ljust(8, b"\0"), "little")
        return int(_spread(np.array([lane ^ (len(word) * int(MIX_2) & mask)], np.uint64))[0]) ^ int(toxicity.WHOLE)

    def beginning(word, n):
        total, power = 0, 1
        for b in word[:n]:
            total, power = (total + int(_BYTE[b]) * power) & mask, power * int(MIX) & mask
        return int(_spread(np.array([(total + n * int(MIX_2) + 1) & mask], np.uint64))[0])

    assert len(KEEP) == 9 and len(weight) > 10
    rows = {r.doc_id: r for r in toxicity.severity_table(docs, labels).collect()}
    seen = 0
    for d in docs.where("length(text) < 500").collect():
        clean = re.sub(rb"[^a-z\x80-\xff]", b" ", (d.text or "").lower().encode())
        words = clean.split()
        if any(b > 127 for b in clean) or any(len(w) > 8 for w in words):  # capitals beyond ASCII and long words are hashed otherwise
            continue
        count = Counter()
        for w in words:
            count[whole(w)] += 1
            for n in range(3, len(w) + 1):
                count[beginning(w, n)] += 1
        known = {f: c for f, c in count.items() if f in weight}
        score = sum(weight[f] * np.log1p(100 * c / (len(words) + toxicity.SMOOTHING)) for f, c in known.items())
        want = sum(1 / (1 + np.exp(t - score)) for t in model.thresholds) if known else 0.0
        assert abs(rows[d.doc_id].severity - want) < 1e-9
        seen += 1
    assert seen >= 5
    hot = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(500)).drop("id"))
    again = toxicity.fit(hot, labels.unionByName(labels.where("doc_id = 0").crossJoin(spark.range(50)).drop("id")))
    assert (again.vocabulary == model.vocabulary).all() and np.allclose(again.weights, model.weights)
