"""The near-copy stage of the pipeline on large groups, and the whole pipeline on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.llm import simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def groups(texts):
    """Brute force: the smallest document of each group of texts of similarity 0.8."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def kept(spark, texts):
    return {r.doc_id for r in simhash.without_copies(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def test_group_of_mixed_similarity_equals_brute_force(spark):
    """A family whose members lie on both sides of 0.8 from each other and from their origin."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(rng, base, rng.randint(1, 9)) for _ in range(400)]
    rng.shuffle(texts)
    root = groups(texts)
    want, found = set(root), kept(spark, texts)
    assert 20 < len(want) < 300
    assert want <= found  # none goes that has no similar text
    assert len(found - want) <= 0.02 * (len(texts) - len(want))


def test_ten_thousand_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(130)]
    assert kept(spark, [edited(rng, base, 1) for _ in range(10_000)]) == {0}


def test_ten_thousand_look_alikes(spark):
    """Texts that share two thirds of their shingles with one another: none is a copy."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join([*base, *(f"o{rng.randrange(10**9)}" for _ in range(22))]) for _ in range(10_000)]
    assert 0.6 < similarity(shingles(texts[0]), shingles(texts[1])) < 0.72
    assert kept(spark, texts) == set(range(10_000))


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(rng, base, rng.randint(1, 9)) for _ in range(150)]
    whole = kept(spark, texts)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert kept(spark, texts) == whole


def test_estimate_and_keys():
    rng = np.random.default_rng(8)
    for share in (0.75, 0.89, 1.0):  # of shingles in common: similarity 0.6, 0.8, 1
        sets = []
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            own = round(300 * share)
            sets += [np.unique(pool[:300]), np.unique(np.concatenate([pool[:own], pool[300 : 600 - own]]))]
        marks = np.array([np.frombuffer(simhash.sketch(s) + (m >> np.uint64(40)).astype(np.uint8).tobytes(), np.uint8) for s, m in zip(sets, simhash.minima(sets), strict=True)])
        found, want = simhash.estimate(marks[::2], marks[1::2]), np.array([simhash.similarity(a, b) for a, b in zip(sets[::2], sets[1::2], strict=True)])
        assert abs((found - want).mean()) < 0.015 and (found - want).std() < 0.05
        keys = simhash.band_keys(simhash.minima(sets))
        met = (keys[::2] == keys[1::2]).any(axis=1).mean()
        assert abs(met - np.mean(1 - (1 - want**simhash.ROWS) ** simhash.BANDS)) < 0.12
    assert (simhash.minima([np.zeros(0, np.uint64)]) == np.iinfo(np.uint64).max).all()


def test_tables_hold_all_pairs_within_reach(spark):
    """Fingerprints up to ``REACH`` bits apart share an address, however the bits lie; unrelated ones don't."""
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for n in (0, 1, 8, 16, simhash.REACH):
        for spread in (True, False):
            one = rng.integers(0, 2, simhash.WIDE_BITS)
            flips = np.arange(n) * 32 % 256 + np.arange(n) * 32 // 256 if spread else rng.permutation(simhash.WIDE_BITS)[:n]
            other = one.copy()
            other[flips] ^= 1
            assert (one != other).sum() == n
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows) + k, bytearray(np.packbits(x).tobytes() + b"rest")) for k, x in enumerate((one, other))]
    met = simhash.table_rows(spark.createDataFrame(rows, "node long, mark binary"))
    assert met.count() == len(rows) * simhash.WIDE_SEGMENTS * 33
    assert {(r.u, r.v) for r in met.toDF("u", "address").join(met.toDF("v", "address"), "address").where("u < v").collect()} == set(pairs)


def test_tables_find_copies_that_share_no_minima(spark):
    """Two groups of edited texts and single ones, all with keys of their own: what is found is found by the tables."""
    rng = random.Random(10)
    bases = [[f"b{k}-{i}" for i in range(300)] for k in range(12)]
    texts = [edited(rng, bases[k], 1) for k in (0, 1) for _ in range(40)] + [" ".join(b) for b in bases[2:]]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    marked = docs.mapInArrow(simhash._marks, f"doc_id long, {simhash.MARKS}")
    nodes = marked.withColumnRenamed("doc_id", "first_id").withColumn("keys", F.transform("keys", lambda _, i: F.xxhash64("node", i))).localCheckpoint()
    roots = {r.node: r.root for r in simhash.similar_roots(docs, nodes).collect()}
    node = [r.node for r in nodes.orderBy("first_id").collect()]
    assert all(roots[n] == min(node[:40]) for n in node[:40]) and all(roots[n] == min(node[40:80]) for n in node[40:80])
    assert len(roots) == 80


def test_tables_look_at_all_pairs_of_mixed_buckets(spark):
    """Members of different groups up to ``REACH`` bits apart, and none of one group or further apart, in blocks as in one."""
    rng = np.random.default_rng(11)
    one = rng.integers(0, 2, simhash.WIDE_BITS)
    rows = []
    for k in range(60):
        bits = one.copy()
        bits[rng.permutation(simhash.WIDE_BITS)[: k // 3]] ^= 1
        rows.append((7, k, k % 4, bytearray(np.packbits(bits).tobytes())))
    bits = [np.unpackbits(np.frombuffer(r[3], np.uint8)) for r in rows]
    want = {(i, j) for i in range(60) for j in range(i) if i % 4 != j % 4 and (bits[i] != bits[j]).sum() <= simhash.REACH}
    assert 0 < len(want) < 60 * 59 / 2
    members = spark.createDataFrame(rows, "address long, node long, root long, bits binary")
    for block in (8192, 16):
        cells = simhash._in_cells(members, F.count("*") / block, "node", "bits")
        assert {(r.u, r.v) for r in cells.mapInArrow(simhash._reached, "u long, v long").collect()} == want


def family_nodes(spark, texts):
    marked = spark.createDataFrame(list(enumerate(texts)), SCHEMA).mapInArrow(simhash._marks, f"doc_id long, {simhash.MARKS}")
    return marked.dropDuplicates(["node"]).withColumnRenamed("doc_id", "first_id").localCheckpoint()


def test_large_family_is_compared_a_few_times_a_member(spark, monkeypatch):
    """Texts of one origin, some alike and some similar: what is compared doesn't grow with all that meet in some address."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(rng, base, rng.randint(1, 12)) for _ in range(1200)]
    compared, dealt = [], simhash._dealt

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return dealt(pairs, *rest)

    monkeypatch.setattr(simhash, "_dealt", counted)
    nodes = family_nodes(spark, texts)
    simhash.similar_roots(spark.createDataFrame(list(enumerate(texts)), SCHEMA), nodes).collect()
    assert 0 < sum(compared) < 8 * len(texts)


def test_tables_have_a_row_for_each_value_of_a_ball_at_most(spark):
    """However many fingerprints hold a value; and every pair up to ``REACH`` bits apart is led to one group or left to the second look."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(300)]
    nodes = family_nodes(spark, [edited(rng, base, 1 + i % 9) for i in range(300)])
    tables = simhash._tables(nodes.select("node", "mark"))
    assert 0 < tables.groupBy("address").count().agg(F.max("count")).first()[0] <= 33
    assert tables.groupBy("address", "value").count().where("count > 1").isEmpty()
    fp = {r.node: np.unpackbits(np.frombuffer(r.mark[: simhash.WIDE_BITS // 8], np.uint8)) for r in nodes.collect()}
    close = {(u, v) for u in fp for v in fp if u > v and (fp[u] != fp[v]).sum() <= simhash.REACH}
    alone = nodes.select("node", F.col("node").alias("root"), "size", "mark")
    led = {(r.u, r.v) for r in simhash._in_tables(tables, alone).mapInArrow(simhash._led, "u long, v long").collect()}
    assert led <= close and {x for p in led for x in p} == {x for p in close for x in p}


@pytest.mark.parametrize("block", [8192, 16])
def test_lists_of_holders_give_all_pairs_of_different_groups(spark, monkeypatch, block):
    """All pairs up to ``REACH`` bits apart, in blocks as in one, and others only if they can be similar."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(14)
    base = [f"b{i}" for i in range(300)]
    nodes = family_nodes(spark, [edited(rng, base, 1 + i % 9) for i in range(150)])
    placed = nodes.select("node", F.pmod("node", F.lit(3)).alias("root"), "size", "mark")
    rows = {r.node: r for r in placed.collect()}
    marks = {n: np.frombuffer(r.mark, np.uint8)[None] for n, r in rows.items()}
    pairs = [(u, v) for u in rows for v in rows if u > v and rows[u].root != rows[v].root]
    close = {(u, v) for u, v in pairs if simhash.distance(marks[u], marks[v])[0] <= simhash.REACH}
    likely = {(u, v) for u, v in pairs if simhash.is_near(marks[u], marks[v], np.array([rows[u]["size"]]), np.array([rows[v]["size"]]))[0]}
    found = {(r.u, r.v) for r in simhash._in_tables(simhash._tables(placed), placed).mapInArrow(simhash._reached, "u long, v long").collect()}
    assert close and close <= found <= close | likely


ODD = [
    (1, "", "en"), (2, None, "en"), (3, " \n\t ", None), (4, "one", None), (4, "one", None), (None, "no id here", "en"), (None, None, None), (5, " ".join(f"w{i % 700}x{i}" for i in range(40_000)), "en"),
    (6, "x" * 100_000, "en"), (7, "12345 67.8 *** $$$", "fr"), (8, "中文 🙂 é", "de"),
]


@pytest.mark.parametrize("few", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, few):
    """Nulls, empty and very long texts, repeats and columns that clash with those of operators; and an empty table."""
    import corpus_pipeline

    extra = "node long, size int, mark binary, keys array<long>, address long, shard int, root long, text_ string"
    rows = [(i, t, lang, "s", len(t or ""), 1, 1, b"", [1], 1, 1, 1, "t") for i, t, lang in ODD]
    docs = spark.createDataFrame([] if few else rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    if not few:  # something to learn from
        known = spark.read.parquet(f"{SF}/documents.parquet")
        docs = docs.unionByName(known, allowMissingColumns=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == before
    assert (docs.count() == 0) == few
