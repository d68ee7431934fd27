"""The training-data operators against brute force, on small tables and awkward rows."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritally.llm import bpe, graph, html, langid, packing, quality, queries, simhash, substring, tokenstore, topk, toxicity

SF = "/root/testdata/sf0.001"
BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, windows string, fp string, c0 int"
LONG = " ".join(f"w{i % 700}x{i}" for i in range(30_000))
REPEAT = " ".join(f"shared{i}" for i in range(60))
ODD = [
    (1, "", "en"), (2, None, "en"), (3, "   \n\t ", "fr"), (4, "one", None), (4, "one", None), (None, "no id here", "en"), (None, None, None), (5, LONG, "en"), (6, "tail " + REPEAT + " end", "en"),
    (7, "lead " + REPEAT + " more words", "en"), (8, "don't  STOP<|endoftext|> x\x1cy\x85 z é Σς 中文 🙂 \r\n q", "de"), (9, "12345 67.8 *** $$$", "en"), (10, "a" * 5000, "en"), (11, REPEAT, "en"), (12, REPEAT, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "w", "f", 1) for i, t, lang in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def samples(n):
    rng = random.Random(5)
    letters = "aàbéé 'stl1²\n\t,.* 中🙂<|endoftext|>ΣσẞßİIthe tion"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_byte_codec_equals_library(docs):
    codec, library = bpe.byte_codec(BYTE), Tokenizer.from_file(BYTE)
    for t in samples(3000) + [t for _, t in texts(docs)][:60] + [t for _, t, _ in ODD if t]:
        ids = codec.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.failures < codec.words  # some are merged, most aren't


def test_word_codec_equals_library(docs):
    codec, library = bpe.word_codec(WORD), Tokenizer.from_file(WORD)
    some = samples(3000) + [t for _, t in texts(docs)][:60] + [t for _, t, _ in ODD if t]
    ids, at = codec.encode_texts(pa.array(some))
    for t, lo, hi in zip(some, at[:-1], at[1:]):
        assert ids[lo:hi].tolist() == library.encode(t, add_special_tokens=False).ids


def test_op9(odd, empty):
    library, want = Tokenizer.from_file(BYTE), []
    for i, t, _ in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert Counter(map(tuple, bpe.encode_digest(odd, BYTE).collect())) == Counter(want)
    assert bpe.encode_digest(empty, BYTE).collect() == []
    back = bpe.decode(bpe.encode(odd.where("doc_id > 5"), BYTE), BYTE)
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t, _ in ODD if i and i > 5)


def test_op3(odd, empty):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(odd, WORD).collect()
    want = Counter()
    for i, t, _ in ODD:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            want[i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    assert packing.pack(empty, WORD).collect() == []


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 50) for _ in range(rng.randint(1, 120))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in bins if b[0] >= n]
            if fits:
                min(fits)[0] -= n
            else:
                bins.append([50 - n])
        runs = packing.plan(dict(Counter(lengths)), 50)
        load = Counter()
        for length, rank, placed, first, each, offset in runs:
            for j in range(placed):
                load[first + j // each] += length
        assert sorted(50 - b[0] for b in bins) == sorted(load.values())


def test_op5(odd, docs, empty):
    for table in (odd, docs):
        rows, first = texts(table), {}
        for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            w = (t or "").encode().split()
            for k in range(len(w) - 12):
                first.setdefault(tuple(w[k : k + 13]), i)
        want = []
        for i, t in rows:
            w = (t or "").encode().split()
            gone = [False] * len(w)
            for k in range(len(w) - 12):
                if i is not None and first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
            want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
        assert Counter(map(tuple, substring.removal_table(table).collect())) == Counter(want)
    assert substring.removal_table(empty).collect() == []
    left = {r.doc_id: r for r in substring.without_repeats(odd).where("doc_id >= 6").collect()}
    assert left[7].text == "lead more words" and left[12].text == "" and left[6].text == "tail " + REPEAT + " end" and left[7].windows == "w"


def reference_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op10(odd, docs, empty):
    for table in (odd, docs):
        rows = [(i, reference_fingerprint(t)) for i, t in texts(table)]
        values = sorted({f for _, f in rows})
        root = {f: f for f in values}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2:
                    root[find(a)] = find(b)
        least = {}
        for i, f in rows:
            if i is not None:
                least[find(f)] = min(i, least.get(find(f), i))
        want = Counter((i, format(f, "016x"), least.get(find(f))) for i, f in rows)
        assert Counter(map(tuple, simhash.group_table(table).collect())) == want
    assert simhash.group_table(empty).collect() == []

def test_links_reach_distance_two_and_no_further(spark):
    base = 0x0123456789ABCDEF
    near, far = base ^ (1 << 3) ^ (1 << 40), base ^ 0b111
    rows = spark.createDataFrame([(base,), (near,), (far,)], "fp long")
    assert [tuple(sorted(r)) for r in simhash.links(rows).collect()] == [tuple(sorted((base, near)))]


def test_top_k_over_many_cells(spark, monkeypatch):
    """Small blocks and groups, so that the grid has many cells; ties, and values whose sums need 64-bit integers."""
    for name, value in (("QUERY_ROWS", 3), ("BLOCK_ROWS", 7), ("QUERY_BLOCKS", 2), ("CANDIDATE_BLOCKS", 2), ("PROBED", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(4)
    for scale in (1.0, 2.0**20):
        rows = [(i, [float(rng.randint(-3, 3)) * scale for _ in range(6)]) for i in range(400)]
        found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), "vec_id % 20 = 0", 4)
        whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
        want = []
        for q in range(0, 400, 20):
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
        assert sorted(map(tuple, found.collect())) == want
    large = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(large).collect()


def test_language_of_letters_only(spark):
    rows = [(i, f"the words of text number {i} and some more of them", "en") for i in range(60)]
    rows += [(i, f"les mots du texte {i} et quelques autres encore", "fr") for i in range(60, 120)]
    rows += [(1000, "½ ² ³ 12 _", "en"), (1001, "\u0661 \u2164 !", "en"), (1002, "", "fr"), (1003, None, None), (1004, "中文", None)]
    rows += [(5, f"copy {i} of one id with the words of it", "en") for i in range(300)]
    found = {r.doc_id: r for r in langid.language_table(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 1000").collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1000, 1002, 1003)) and found[1001].lang_pred == "und"
    assert found[1004].rejected


def test_links_in_hot_buckets(spark):
    """100,000 fingerprints share a segment; all pairs within two bits are linked, without a row for each pair of the bucket."""
    rng = np.random.default_rng(3)
    low = np.unique(rng.integers(0, 1 << 32, 100_000))
    base = int(low[0]) | 7 << 32
    more = [base ^ 1, base ^ 1 << 40, base ^ 0b11, base ^ (1 << 33 | 1 << 12), base ^ 0b111000, int(low[1]) | 7 << 32 | 1 << 63]
    values = sorted({int(x) | 7 << 32 for x in low} | {x - (1 << 64) if x >> 63 else x for x in more})
    rows = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(rows)).collect()}
    u = np.array(values, np.int64).view(np.uint64)
    known, root = set(u.tolist()), {}
    for v in u.tolist():  # brute force: the two-bit neighbourhood of each value
        if v in root:
            continue
        root[v], stack = v, [v]
        while stack:
            x = stack.pop()
            for m in simhash.ball_masks(64, 2):
                y = x ^ (m & (1 << 64) - 1)
                if y in known and y not in root:
                    root[y] = v
                    stack.append(y)
        if len(root) > 300:  # the rest is found the same way
            break
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for x in root:
        assert (roots.get(signed(x), signed(x)) == roots.get(signed(root[x]), signed(root[x])))
    groups = {}
    for x, r in root.items():
        groups.setdefault(r, []).append(x)
    of = {g: roots.get(signed(g), signed(g)) for g in groups}
    assert len(set(of.values())) == len(of)


def test_balls_follow_segments():
    assert [len(simhash.ball_masks(w, r)) for w, r in ((32, 0), (32, 1), (21, 2), (64, 1))] == [1, 33, 1 + 21 + 210, 65]
    assert len(set(simhash.ball_masks(16, 2))) == 137 and max(m.bit_count() for m in simhash.ball_masks(16, 2)) == 2


def test_importance_by_hand(spark):
    """Eight pages of one host: every number of the tree follows from counts."""
    rows = []
    for i in range(8):
        note = "same words" if i < 4 else f"words of page{i}"
        body = f"alone{i} " + "y " * 20  # 21 words: one feature
        layout = "<p>a</p>" if i % 2 else "<p>a</p><ul></ul>"
        rows.append((i, "http://h.org/", f'<body><div class="k"><a href="/">a menu</a></div><div class="n">{note}</div><div class="m">{body}</div><div class="v">{layout}</div></body>'))
    tree = html.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    path = {n: p for page in [html.Page(rows[0][2])] for n, p in zip(page.name, page.paths())}
    found = {name: next(r for r in tree if r.path == path[name]) for name in ("body", "div.k", "div.n", "div.m", "div.v")}
    log = lambda x: float(np.log(x) / np.log(8))
    note = 4 * log(4) + 8 * log(8) + 4 * log(4)  # same, words, of, and four words of one page each; all in all 4 + 8 + 4 + 4
    want = {
        "div.k": (0.0, 0.0, 2),  # two words, on all pages
        "div.n": (0.0, 1 - note / 20, 20 / 8),
        "div.m": (0.0, 1.0, 21),
        "div.v": (1 - 2 * 4 * log(4) / 8, 0.0, 1),  # two layouts, four pages each
    }
    for name, (presentation, content, words) in want.items():
        r = found[name]
        assert (r.n_pages, r.presentation, r.content, r.own_words, r.own_content) == (8, pytest.approx(presentation), pytest.approx(content), words, pytest.approx(content))
        assert r.importance == pytest.approx(0.1 * presentation + 0.9 * content)
    assert found["body"].own_words == 0 and found["body"].content == pytest.approx(1 - (16 + note + 0 + 8) / (16 + 20 + 8 * 21 + 8))


PARTS = """<article><div class="post-header"><h1>Title {i}</h1></div><p>{text}</p><ul><li>one of {i}</li><li>two</li></ul><table><tr><td>cell</td></tr></table><figure><img src="x"><figcaption>Figure</figcaption></figure>
<dl><dt>term</dt><dd>meaning</dd></dl><section><h2>Part</h2><p>{text}</p></section><div class="box"><p>In a box</p></div><div class="share-buttons">Share</div></article>"""


@pytest.mark.parametrize("pages", [2, 12])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_parts_of_an_article_stay(spark, pages, tag):
    """Lists, tables, captions and sections come out whole, on a host with a tree and on one without; also if no tag tells the article, but for named noise."""
    body = PARTS if tag == "article" else PARTS.replace("<article>", '<div class="c">').replace("</article>", "</div>")
    page = '<html><body><nav><a href="/">Home</a></nav><div class="header-image story"><p>{text}</p></div>' + body + '<div class="site-footer">All rights</div></body></html>'
    words = lambda i: " ".join(f"word{i}x{k}" for k in range(80))
    rows = [(i, f"http://h{pages}{tag}.org/{i}", page.format(i=i, text=words(i))) for i in range(pages)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = "" if tag == "article" else "{1} "  # beside an article; without one nothing says that it isn't part of the text
    want = (story + "Title {0} {1} one of {0} two cell Figure term meaning Part {1} In a box").format
    assert found == {i: want(i, words(i)) for i in range(pages)}


@pytest.mark.parametrize(
    ("box", "stays"),
    [
        ('<div class="header-image story">', True), ('<div class="post-header">', True), ('<div class="site-header">', False), ('<div class="cookie-notice">', False), ('<div id="main-menu">', False), ('<div class="a comments">', False),
        ('<div class="comment-free story">', True), ('<section id="related-work">', True), ('<div class="ads">', False), ('<div class="advert box">', False), ('<div class="wrapper">', True), ('<p class="footer">', True),
    ],
)
def test_names_speak_as_a_whole(box, stays):
    assert html.Page(f"<html><body>{box}words</{box[1 : box.index(' ')]}></body></html>").text() == ("words" if stays else "")


def test_tree_decides_where_names_say_nothing(spark):
    """A host without any telling tag or class: the tree finds its article; a host of two pages keeps all."""
    page = '<html><body><div class="a1"><ul><li><a href="/x">Item {0}</a></li><li><a href="/y">Thing {0}</a></li></ul></div><div class="b2">Offer {0} now</div><div class="c3"><h1>T{0}</h1><p>{1}</p></div><div class="d4"><p>Owner {0}</p></div></body></html>'
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(40 + i))
    rows = [(i, f"http://{'big' if i < 12 else 'tiny'}.org/{i}", page.format(i, text(i))) for i in range(14)]
    clashing = [(*r, "h", [1], True) for r in rows]
    pages = spark.createDataFrame(clashing, "page_id long, url string, html string, host string, above array<int>, good boolean")
    found = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert all(found[i] == f"T{i} {text(i)}" for i in range(12))
    assert all(found[i].startswith(f"Item {i} Thing {i} Offer {i} now T{i}") for i in (12, 13))
    assert all(html.Page(r[2]).text() != found[r[0]] for r in rows[:12])
    alone = {r.page_id: r.text for r in html.extract(pages, prior=False).collect()}
    assert alone == found


@pytest.mark.parametrize("source", ["<a " * 350_000, "<div>" * 200_000, "<a \"'" * 200_000, "<ul><li><ul>" + "<b>" * 100_000 + "<li></li>" * 60_000, "<span>" * 80_000 + "</x>" * 80_000, '<a title="x>' * 80_000])
def test_large_broken_pages_take_linear_time(source):
    import time

    began = time.process_time()
    page = html.Page(source)
    page.profile()
    page.text({1: 1.0})
    assert time.process_time() - began < 20


def test_components(spark):
    rng = random.Random(3)
    edges = [(100 * c + i, 100 * c + rng.randint(max(0, i - 2), i - 1)) for c in range(30) for i in range(1, rng.randint(2, 12))]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {n: 100 * (n // 100) for n in out} and len(out) == len({n for e in edges for n in e})
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_op4_against_sql(odd, docs, empty):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert Counter(con.execute(quality.sql()).fetchall()) == Counter(map(tuple, quality.verdicts(docs).collect()))
    out = {r.doc_id: r for r in quality.verdicts(odd).collect()}
    assert len(quality.verdicts(odd).collect()) == len(ODD) and out[2].n_words == 0 and out[2].base_failed and not out[2].kept
    assert quality.verdicts(empty).collect() == []


def test_repeated_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(200)]
    out = {r.doc_id: r.n_repeat_words for r in quality.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert out[i] == len({k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_op4_quality_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs).where("not base_failed").join(labels, "doc_id")
    wrong = out.where("cast(kept as int) <> quality").count()
    assert wrong <= 0.02 * out.count()


def test_op1(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.severity_table(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert out[out.toxic == 0].rejected.mean() <= 0.01 and out[out.toxic == 1].rejected.mean() >= 0.6
    assert ((out.severity >= 0) & (out.severity <= toxicity.GRADES)).all() and (out.rejected == (out.toxic_probability >= 0.5)).all()
    some = spark.createDataFrame([(7, 1), (6, 0), (None, 1), (9, None), (7, 0)], "doc_id long, toxic int")
    assert toxicity.severity_table(odd, some).count() == len(ODD)
    assert toxicity.severity_table(empty, some).collect() == []
    assert all(r.severity == 0 and not r.rejected for r in toxicity.severity_table(odd, some.where("false")).collect())
    kept = toxicity.without_toxic(odd, some.where("false"))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_thresholds_are_ordered_and_shared():
    g = np.random.default_rng(0)
    x = g.normal(size=(600, 3))
    score = x @ np.array([2.0, -1.0, 0.0]) + g.logistic(size=600)
    grade = np.digitize(score, [-1.0, 0.5, 2.0])
    rows, columns = np.nonzero(x)
    w, cut = toxicity.cumulative_link(toxicity.Sparse(rows, columns, x[rows, columns], 600, 3), grade, 3, penalty=1e-4)
    assert np.allclose(w, [2, -1, 0], atol=0.35) and np.allclose(cut, [-1, 0.5, 2], atol=0.4) and (np.diff(cut) > 0).all()


def test_op2(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = out[out.held_out]
    assert (test.lang == test.lang_pred).mean() >= 0.97 and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    rows = langid.language_table(odd).collect()
    assert len(rows) == len(ODD)
    named = {r.doc_id: r for r in rows}
    assert named[1].lang_pred == named[2].lang_pred == named[3].lang_pred == "und" and named[1].score == 0 and named[9].lang_pred == "und"
    assert langid.language_table(empty).collect() == []
    assert langid.with_language(docs).count() >= 0.99 * docs.count()


def test_op7(spark):
    g = np.random.default_rng(1)
    vectors = np.round(g.normal(size=(400, 10)), 2).astype("f4")
    vectors[50:90] = vectors[0]
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1050, [float("nan")] * 10, 1), (None, vectors[3].tolist(), 1), (1100, [1.0, 2.0], 1), (1150, [], 1), (1200, [1.0, None] * 5, 1), (7, vectors[9].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = sorted(map(tuple, topk.top_k(table).collect()))
    whole = np.floor(256 * np.vstack([vectors, vectors[9:10]]).astype(float)).astype(int)
    ids = np.append(np.arange(400), 7)
    want = []
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
        want += [(q, n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(order)]
    assert out == sorted(want)
    assert topk.top_k(table.where("false")).collect() == []


def test_op7_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(con.execute(queries.OP7_SQL).fetchall()) == sorted(map(tuple, queries.op7_topk(spark, SF).collect()))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav>
<div class="cookie-notice">Cookies</div><!-- <p>no</p> --><div class="ad">Buy</div>{main}<aside>Side</aside><form><label>Name</label><input></form><section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; x</footer>"""


@pytest.mark.parametrize(
    ("main", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>One<br>two</b> three<p>four\n  five&nbsp;six</article>", "A & B One two three four five six"),
        ("<main><div><p>x<i>y</i></p><ul><li>a<li>b</ul></div></main>", "xy a b"),
        ("<div class=content><p>plain</p></div>", "plain"),
        ("<article><p>1 &lt; 2 > 0</p><script>no()</script><div class='share'>no</div></article>", "1 < 2 > 0"),
    ],
)
def test_page_text(main, text):
    assert html.Page(PAGE.format(main=main)).text() == text


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<a href="/wiki/Hidden_Markov_model">kept</a>', "kept"),
        ('<a title="Hidden thing" aria-hidden="false" data-hidden="false">kept</a>', "kept"),
        ('<a href="/x?id=search">kept</a>', "kept"),
        ('<a href=/x?class=ad>kept</a>', "kept"),
        ('<h2 id="search-algorithms">kept</h2>', "kept"),
        ('<h2 id="search">kept</h2>', "kept"),
        ('<section id="related-work"><p>kept</p></section>', "kept"),
        ('<p class="notice-period">kept</p>', "kept"),
        ("<math><mi>x</mi></math>", "x"),
        ("<div hidden>gone</div>", ""),
        ('<div HIDDEN="">gone</div>', ""),
        ("<div class='share wide'>gone</div>", ""),
        ('<div id=comments data-x="1">gone</div>', ""),
        ('<p style="color:red; display: none">gone</p>', ""),
    ],
)
def test_whole_attributes(inner, text):
    assert html.Page(f"<html><body><article><p>lead</p>{inner}</article></body></html>").text() == f"lead {text}".strip()


def test_op6(spark):
    template = "<html><body><div class=box>{box}</div><div class=text><p>{text}</p></div></body></html>"
    rows = [(i, "https://a.example/%d" % i, template.format(box="Same words everywhere", text=f"page {i} says {i * i}")) for i in range(12)]
    rows += [(100, None, None), (101, "https://b.example/", ""), (102, "not a url", template.format(box="b", text="t")), (100, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in html.extract(table).collect()}
    assert html.extract(table).count() == len(rows)
    assert all(out[i].text == f"page {i} says {i * i}" for i in range(12))  # the repeated box went
    assert out[100].text == "" and out[101].n_chars == 0 and out[102].text == "b t"
    assert html.extract(table.where("false")).collect() == []


def test_op6_blocks_and_siblings(spark):
    side = "<div class=box><p>Our story</p><p>Write to us</p><p>All topics</p><p>Places</p><p>People</p><p>Today is day {i}</p></div>"
    page = "<html><body>" + side + "<div class=box><p>page {i} says {j}</p><p>and then {j} again</p></div></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(i=i, j=i * i + 7)) for i in range(20)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"page {i} says {i * i + 7} and then {i * i + 7} again" for i in range(20)}


def test_op6_on_pages(spark):
    out = html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(out) == 50 and all(r.n_chars == len(r.text) > 0 for r in out)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    order = tokenstore.Permutation(n, 9)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.numbers(slots) == np.arange(n)).all()
    assert n < 100 or (slots != tokenstore.Permutation(n, 10).slots(np.arange(n))).any()


def test_op8(odd, empty, tmp_path):
    library = Tokenizer.from_file(WORD)
    rows = tokenstore.records(odd.coalesce(1), WORD, window=64, shard_rows=32).cache()
    got = sorted(rows.collect())
    assert [r.slot for r in got] == list(range(len(got))) and all(r.shard == r.slot // 32 and r.offset == r.slot % 32 * 128 for r in got)
    order = tokenstore.Permutation(len(got), 1)
    by_slot = {r.slot: r for r in got}
    ids = [i for s in order.slots(np.arange(len(got))) for i in np.frombuffer(by_slot[int(s)].ids, "<u2")[: by_slot[int(s)].n_tokens].tolist()]
    assert ids == [i for _, t, _ in ODD for i in [*library.encode(t or "", add_special_tokens=False).ids, 1]]
    folder = f"file://{tmp_path}/shards"
    manifest = tokenstore.write_shards(rows, folder).collect()
    data = b"".join(open(m.path, "rb").read() for m in sorted(manifest))
    assert data == b"".join(bytes(r.ids) for r in got)
    assert not any(m.written for m in tokenstore.write_shards(rows, folder).collect())
    assert tokenstore.records(empty, WORD).collect() == []


def test_op8_writes_shards(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/store"
    want = sorted(tokenstore.records(odd.coalesce(1), WORD, window=64, shard_rows=32).collect())
    got = sorted(tokenstore.store(odd.coalesce(1), WORD, folder, window=64, shard_rows=32).collect())
    assert [tuple(r)[:6] for r in got] == [tuple(r) for r in want]
    for r in got:
        assert open(r.path, "rb").read()[r.offset : r.offset + 128] == bytes(r.ids)
    place = "file://" + os.path.dirname(got[0].path)
    for first in (0, 31, 32, len(want) - 1, len(want)):
        read = list(tokenstore.read_from(place, first, len(want), window=64, shard_rows=32))
        assert [s for s, _ in read] == list(range(first, len(want)))
        assert all(ids.tobytes() == bytes(want[s].ids) for s, ids in read)
    with pytest.raises((EOFError, FileNotFoundError)):
        list(tokenstore.read_from(place, 0, len(want) + 1, window=64, shard_rows=32))
    assert tokenstore.store(empty, WORD).collect() == []
    places = set()
    for df, key in ((odd.coalesce(1), 1), (odd.coalesce(1), 2), (odd.repartition(3, "n_chars"), 1)):  # into one folder: shards never mix
        rows = tokenstore.store(df, WORD, f"file://{tmp_path}/shared", key=key, window=64, shard_rows=32).collect()
        places.add(os.path.dirname(rows[0].path))
        assert len({os.path.dirname(r.path) for r in rows}) == 1 and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert len(places) == 3
    with pytest.raises(Exception, match="don't fit 1 bytes"):
        tokenstore.store(odd, WORD, width=1).collect()
    assert all(r.path for r in queries.op8_tokenstore(spark, SF).collect())


def test_tokenstore_takes_small_batches(spark, tmp_path, monkeypatch):
    """Tasks that hold a vocabulary or whole shards get small batches, and records don't depend on their size."""
    seen, docs = [], spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    whole = sorted(tokenstore.records(docs, WORD, shard_rows=32).drop("shard").collect())

    def noted(df, name, settings=None, write=tokenstore.staged):
        seen.append((name, (settings or {}).get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return write(df, name, settings and settings | {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"})

    monkeypatch.setattr(tokenstore, "staged", noted)
    assert sorted(tokenstore.store(docs, WORD, f"file://{tmp_path}", shard_rows=32).drop("shard", "path").collect()) == whole
    assert {name for name, _ in seen} == {"sequences", "shard-index"} and {most for _, most in seen} == {"1000"}


def test_op8_rewrites_other_bytes(odd, tmp_path):
    folder = f"file://{tmp_path}/shards"
    for key in (1, 2):  # files of equal sizes
        rows = tokenstore.records(odd.coalesce(1), WORD, key=key, window=64, shard_rows=32).cache()
        manifest = sorted(tokenstore.write_shards(rows, folder).collect())
        assert b"".join(open(m.path, "rb").read() for m in manifest) == b"".join(bytes(r.ids) for r in sorted(rows.collect()))


def test_near_duplicate_stage(spark, odd, empty):
    import corpus_pipeline

    rng, rows, pairs = random.Random(8), [], []
    for k in range(300):
        words = [f"t{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        edited = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * rng.choice((1, 2, 4, 8)) // 100)):
            edited[at] = f"e{rng.randrange(5000)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, edited))
        pairs.append((k, len(a & b) / len(a | b)))
    for k in range(300):  # copies with a block added, close to the limit
        words = [f"b{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        rows += [(9000 + 2 * k, " ".join(words)), (9001 + 2 * k, " ".join(words + [f"n{rng.randrange(5000)}" for _ in range(int(0.23 * len(words)))]))]
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    added = 300 - sum(9001 + 2 * k in left for k in range(300))
    print("near copies with an added block found", added, "of 300")
    assert added >= 0.9 * 300
    near = [k for k, s in pairs if s >= 0.8]
    gone = sum(2 * k + 1 not in left for k in near)
    print("near copies found", gone, "of", len(near))
    assert len(near) > 50 and gone >= 0.97 * len(near)
    assert all({2 * k, 2 * k + 1} <= left for k, s in pairs if s < 0.8) and all(2 * k in left for k, _ in pairs)
    twice = [(1, "a b c d e f g"), (1, "another text of some words here"), (2, "a b c d e f g")]
    kept = simhash.without_copies(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert kept == simhash.without_copies(spark.createDataFrame(twice[::-1], "doc_id long, text string")).collect() and [r.doc_id for r in kept] == [1]
    base = [f"h{i}" for i in range(120)]  # a large group, one word edited in each
    group = [(i, " ".join([*base[: i % 120], f"x{i}", *base[i % 120 + 1 :]])) for i in range(400)]
    assert [r.doc_id for r in simhash.without_copies(spark.createDataFrame(group, "doc_id long, text string")).collect()] == [0]
    kept = simhash.without_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 8, 9, 10]
    assert simhash.without_copies(empty).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_in = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == docs_in.columns and docs.select("doc_id").exceptAll(docs_in.select("doc_id")).count() == 0
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(ids) == sizes[-1]
    direct = corpus_pipeline.run(spark, SF)
    assert Counter(tuple(r)[:5] for r in direct.collect()) == Counter(tuple(r)[:5] for r in docs.collect())
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
