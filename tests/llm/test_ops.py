"""The training-data operators against brute force, libraries, round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from acreline.llm import anchors, op1_sentencepiece, op2_substring, op3_minhash, op4_html, op5_ann, op6_winnowing, op7_licenses, op8_suffix, op9_toxicity, op10_packing, queries
from tests.conftest import SF

rng = random.Random(3)
WORDS = ["oak", "elm", "Ash,", "fir.", "é", "日本", "it's", "x²", "—", "a" * 70, "the", "of", "\x00", "▁", "🎉", "ﬁ"]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = " ".join(f"w{rng.randrange(400)}" for _ in range(400))
#: Nulls, empty and tiny texts, ties, repeated rows, repeated ids with other texts, a very long text.
EDGE = [
    (1, BASE), (2, BASE), (2, BASE), (3, None), (4, ""), (5, " \t\n"), (None, BASE + " tail"), (None, None), (6, "one"), (6, "two words"), (7, BASE[:900] + " other " + sentence(50)),
    (8, "ab " * 700), (9, "a" * 3000), (10, sentence(300)), (11, "x" + BASE), (12, sentence(40) + " " + BASE[300:1500]), (13, " ".join(f"q{i}" for i in range(20_000))),
]


@pytest.fixture(autouse=True)
def many_buckets(monkeypatch):
    """Small tables get as many buckets and shelves as large ones."""
    monkeypatch.setattr(anchors, "LEAST_BYTES", 1)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(d, t, "en", "s") for d, t in EDGE], "doc_id long, text string, lang string, TEXT_len string").withColumnRenamed("TEXT_len", "Doc_Id2")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def test_clashing_column_names(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        clash = spark.createDataFrame([(1, "a b", 9, "z")], "doc_id long, text string, DOC_ID long, Text string")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert [r.n_words for r in op2_substring.remove_repeated_words(clash).collect()] == [2]


# 1


def encoded(text, sp):
    ids = [sp.bos_id(), *sp.encode(text or ""), sp.eos_id()]
    return len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(sp.decode(ids))


@pytest.mark.parametrize("which", ["edge", "docs", "empty"])
def test_op1_equals_library(which, request):
    import sentencepiece

    df = request.getfixturevalue(which)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted([(r.doc_id, *encoded(r.text, sp)) for r in df.collect()], key=repr)
    assert rows(op1_sentencepiece.encode_documents(df, public_tokenizers.path("piece_bpe_32k.model"))) == want


def test_op1_table_restarts(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(op1_sentencepiece, "TABLE_ENTRIES", 3)
    table = op1_sentencepiece.ChunkTable(sp)
    for _ in range(30):
        text = sentence(20)
        assert table.encode([text]) == [(b"".join(i.to_bytes(4, "little") for i in sp.encode(text)), sp.decode(sp.encode(text)))]


# 2


def brute_words(items, window=20):
    tag = lambda t: zlib.crc32((t or "").encode())
    first = lambda t: -(1 << 63) + (xxhash.xxh64_intdigest((t or "").encode(), 42) & ((1 << 62) - 1))
    seen, out = set(), []
    for d, t in sorted(items, key=lambda x: (x[0] if x[0] is not None else first(x[1]), tag(x[1]))):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["edge", "docs", "empty"])
def test_op2_equals_brute_force(which, request):
    df = request.getfixturevalue(which)
    assert rows(op2_substring.remove_repeated_words(df)) == brute_words([(r.doc_id, r.text) for r in df.collect()])


# 3


def shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_classes(items):
    nodes = list(items)
    parent = {d: d for d in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: shingles(t) for d, t in items.items()}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            both = sum((sets[a] & sets[b]).values())
            if items[a] == items[b] or both and both / (sets[a].total() + sets[b].total() - both) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in nodes}


def test_op3_equals_brute_force(docs):
    got = {r.doc_id: r.class_id for r in op3_minhash.near_duplicate_classes(docs).collect()}
    assert got == brute_classes({r.doc_id: r.text or "" for r in docs.collect()})


def test_op3_edge_rows(edge, empty):
    got = defaultdict(set)
    for r in op3_minhash.near_duplicate_classes(edge).collect():
        got[r.doc_id].add(r.class_id)
    assert got[1] == got[2] == got[11] == got[None] and len(got[1]) == 1
    assert got[3] == got[4] and got[6] == {6} and got[13] == {13}
    assert op3_minhash.near_duplicate_classes(empty).count() == 0


def test_op3_order_matters():
    a = np.arange(300, dtype=np.uint64)
    assert op3_minhash.aligned(a, a) == 1.0
    assert op3_minhash.aligned(a, np.concatenate([a[150:], a[:150]])) == 0.0
    assert op3_minhash.aligned(a, a[:270]) == pytest.approx(0.9)
    edited = a.copy()
    edited[[20, 150]] += np.uint64(1000)
    assert op3_minhash.aligned(a, edited) == pytest.approx(298 / 302)


def test_op3_star_rounds_lose_no_link(spark):
    """A chain of texts, each like the next but not like those further on, is one class."""
    words = [f"w{i}" for i in range(260)]
    texts = [(i, " ".join(words[i * 8 : i * 8 + 150])) for i in range(12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.class_id for r in op3_minhash.near_duplicate_classes(df).collect()} == set(brute_classes(dict(texts)).values())


def test_op3_crowded_bucket_in_full(spark):
    """Pairs of small classes among a bucket led by many linked near copies are found whatever stands beside them."""
    r = random.Random(8)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    base, texts = words(120, "b"), []
    for i in range(150):
        copy = list(base)
        copy[i % 120] = f"c{i}"
        texts.append(copy)
    for g in range(40):
        own = words(150, f"s{g}_")
        texts += [own, own[:-8] + words(8, f"t{g}_")]
    r.shuffle(texts)
    items = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(items.items()), "doc_id long, text string")
    # one bucket holds all texts
    keys = [x.key for x in op3_minhash.keyed(docs).collect()]
    members = spark.createDataFrame([(k, 0, 1) for k in keys], "key long, band int, bucket long")
    labels = spark.createDataFrame([(k, k) for k in keys], "key long, class long")
    profiles = op3_minhash.sketches(docs).select("key", "n", "parities")
    near = op3_minhash._nearest(members, labels, profiles, 1000, 0.8).collect()
    place = {x.key: x.doc_id for x in op3_minhash.keyed(docs).collect()}
    got = {tuple(sorted((place[x.a], place[x.b]))) for x in near}
    sets = {i: shingles(t) for i, t in items.items()}
    want = set()
    for i in items:
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both >= 0.8 * (sets[i].total() + sets[j].total() - both):
                want.add((j, i))
    assert want <= got and len(want) > 40
    few = op3_minhash._nearest(members, labels, profiles, 1, 0.8).collect()
    assert any(x.more for x in few) and not any(x.more for x in near)


def test_op3_follows_a_crowded_bucket_to_its_end(spark, monkeypatch):
    """With all texts in one bucket for each band, classes equal comparing every pair."""
    r = random.Random(9)
    base, texts = [f"b{i}" for i in range(120)], []
    for i in range(100):
        texts.append(base[:i] + [f"c{i}"] + base[i + 1 :])
    for g in range(30):
        own = [f"s{g}_{r.randrange(10**6)}" for _ in range(150)]
        texts += [own, own[:-8] + [f"t{g}_{i}" for i in range(8)]]
    r.shuffle(texts)
    items = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(items.items()), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(op3_minhash, "sketch", lambda own, bands, kept: np.arange(bands, dtype=np.uint64))
    got = {x.doc_id: x.class_id for x in op3_minhash.near_duplicate_classes(docs, bands=2).collect()}
    assert got == brute_classes(items)


# 4

PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, accept them please, thanks.</p></div><nav><a href=1>a</a></nav>
<main><h1>Title here</h1><p class=lead>First &amp; para, long enough to be content. Yes, it is.</p><p>Second <a href=x>linked</a> para<br>with break, fine.</p><ul><li>One item<li>Two item</ul>
<div class="advert">Buy now, cheap, great!</div><p>Short.</p><script>var a = "<p>no</p>";</script><section id="comments"><h2>Comments</h2><p>Nice article, I liked it. Really, great stuff, indeed, longer than the article.</p></section></main>
<aside><p>Side text, with punctuation.</p></aside><form><input>Form text</form><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize(("page", "want"), [
    (PAGE, "Title here\nFirst & para, long enough to be content. Yes, it is.\nSecond linked para with break, fine.\nOne item\nTwo item\nShort."),
    (None, ""), ("", ""), ("<nav><a href=x>menu</a></nav>", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div><p>x &lt; y  z</p></div>", "x < y z"), ("<p", ""), ("<!-- x", ""), ("<b><i>" * 3000 + "deep.", "deep."),
])
def test_op4_pages(page, want):
    assert op4_html.main_text(page) == want


LONG, SOME = "Long text, of it. " * 30, "Other text, of it. Yes."


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><section><p>{LONG}</p></section><section><p>{SOME}</p></section></article>", [LONG, SOME]),
    (f"<body><p>{SOME} Lead.</p><div class=body><div>{SOME} In.</div><div>Short.</div><blockquote><p>{LONG}</p></blockquote></div><p>{SOME} Last.</p>", [f"{SOME} Lead.", f"{SOME} In.", "Short.", LONG, f"{SOME} Last."]),
    (f"<main><p>{LONG}</p><ul><li><a href=x>Only a link</a></ul><p>{LONG}</p></main><footer>{SOME}</footer>", [LONG, "Only a link", LONG]),
    (f'<div class="page-header"><nav><a href=x>m</a></nav><p>{SOME}</p><div class=comments><p>{LONG}</p></div></div>', [SOME]),
    (f"<nav><ul><li><a href=x>m</a></ul></nav><div><h1>Title</h1><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>", ["Title", LONG]),
    (f'<p>{LONG}<span class="ad">Buy <span>now</span> cheap</span>end</p>', [LONG + "end"]),
])
def test_op4_whole_articles(page, want):
    assert op4_html.main_text(page) == "\n".join(" ".join(x.split()) for x in want)


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "<p>x", "<div>x" * 30_000, "</p>" * 30_000, "<ul>" * 30_000 + "<li>a.", '<a "' * 30_000, '<span class="ad">' * 30_000])
def test_op4_takes_time_in_proportion(page):
    import time

    start = time.process_time()
    op4_html.main_text(page)
    assert time.process_time() - start < 10


def test_op4_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}", 5), (1, "u", f"<p>{LONG}", 5), (None, None, None, None), (2, "v", "", 1), (3, "w", f"<p>{LONG}" * 2000, 1)], "page_id long, url string, html string, text int")
    got = rows(op4_html.extract_pages(df))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "u", len(LONG) - 1)] * 2 + [(2, "v", 0), (3, "w", 2000 * len(LONG) - 1), (None, None, 0)]
    assert op4_html.extract_pages(df.limit(0)).count() == 0


def test_op4_articles(spark):
    import html

    for r in op4_html.extract_pages(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# 5


def test_op5_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    all_ = df.toPandas()
    ids, v = all_["vec_id"].to_numpy(), np.array(all_["embedding"].tolist(), float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in op5_ann.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -9
        want = ids[np.lexsort((ids, -s))[:5]].tolist()
        found = got[ids[i]]
        assert len(found) == 5 and all(abs(x - s[ids == n][0]) < 1e-12 for n, x in found)
        hit += len(set(want) & {n for n, _ in found})
    assert hit / (5 * len(got)) >= 0.9


def test_op5_edge_rows(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0])]
    good = [(50, [1.0, 0.0]), (51, [1.0, 0.0]), (52, [1.0, 0.0]), (53, [0.0, 1.0]), (None, [1.0, 1.0])]
    got = [tuple(r) for r in op5_ann.search(spark.createDataFrame(bad + good, "vec_id long, embedding array<double>"), "vec_id % 50 = 0").collect()]
    assert sorted(got) == [(50, 1, 51, 1.0), (50, 2, 52, 1.0), (50, 3, 53, 0.0)]
    assert op5_ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id % 50 = 0").count() == 0


# 6


def plain_winnow(points, gram, window):
    _, _ = gram, window
    n = len(points)
    if not n:
        return set()
    hashes = op6_winnowing.rolling(op6_winnowing.prefix_sums(op6_winnowing.mix(points.astype(np.uint64) + np.uint64(1))), gram) if n > gram else None
    if hashes is None:
        return {0}
    hashes = (hashes >> np.uint64(32)).tolist()
    w = min(window, len(hashes))
    return {max(j for j in range(i, i + w) if hashes[j] == min(hashes[i : i + w])) for i in range(len(hashes) - w + 1)}


@pytest.mark.parametrize("text", [BASE, "ab " * 200, "a" * 500, "", "x", sentence(80), "日本" * 60])
def test_op6_keeps_rightmost_minima(text):
    points = op6_winnowing.code_points(text)
    assert set(op6_winnowing.winnow(points, 5, 9)[1].tolist()) == plain_winnow(points, 5, 9)


@pytest.mark.parametrize("which", ["edge", "docs", "empty"])
def test_op6_edits_and_likeness(which, request):
    df = request.getfixturevalue(which)
    # rows of one id stand in the order of a hash of their texts
    items = sorted([(r.doc_id, r.text or "") for r in df.collect()], key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) >> 1, x[1].encode()))
    want = Counter()
    for i, (d, t) in enumerate(items):
        after, n = items[(i + 1) % len(items)][1], len(t)
        want[d, n, sha(t[: n - n // 4] + after[: n // 4])] += 1
    got = op6_winnowing.compare_with_next(df).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1 or r.fingerprint != r.edited_fingerprint) for r in got)


def test_op6_whole_results_with_hot_ids(spark):
    """Fingerprints and likeness of all rows equal a plain computation; a third of rows have no id, a third one id."""
    r = random.Random(4)
    items = [([None, 7, i][i % 3], " ".join(r.choice(WORDS) for _ in range(r.randrange(60)))) for i in range(240)]
    got = op6_winnowing.compare_with_next(spark.createDataFrame(items, "doc_id long, text string")).collect()
    items.sort(key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) >> 1, x[1].encode()))
    want = Counter(op6_winnowing.compared(d, t, items[(i + 1) % len(items)][1]) for i, (d, t) in enumerate(items))
    assert Counter(map(tuple, got)) == want


def test_op6_likeness_tells_edits_from_others():
    r = random.Random(6)
    chars = lambda n: "".join(r.choice("abcdefghijklmnop  ") for _ in range(n))
    for n in (40, 60, 100, 300, 1000):
        got = [op6_winnowing.compared(1, chars(n), chars(n))[5:] for _ in range(100)]
        assert min(near for near, _ in got) > max(other for _, other in got)
        assert 0.35 < np.mean([near for near, _ in got]) < 0.75


# 7


def test_op7_finds_declared_licenses(spark, docs):
    lines = {"MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    for name, line in lines.items():
        text = f"{sentence(30)} {line} {sentence(30)}"
        hit = [x for x in op7_licenses.scan(text, op7_licenses.Index(op7_licenses.TEMPLATES)) if x[0] == name]
        assert len(hit) == 1 and hit[0][1] == 1.0 and text[hit[0][5] : hit[0][6]] == line.rstrip(".")
    got = {(r.doc_id, r.license) for r in op7_licenses.scan_documents(docs).collect()}
    want = {(r.doc_id, n) for r in docs.collect() for n, line in op7_licenses.TEMPLATES.items() if line in (r.text or "")}
    assert want <= got and len(got) == len(want)


@pytest.mark.parametrize("name", list(op7_licenses.TEMPLATES))
def test_op7_any_place(name):
    """A notice at the first word, at the last, alone, and repeated back to back."""
    line, index = op7_licenses.TEMPLATES[name], op7_licenses.Index(op7_licenses.TEMPLATES)
    n = len(op7_licenses.words_in(line)[0])
    for before, times, after in ((0, 1, 0), (0, 1, 40), (40, 1, 0), (3, 1, 3), (0, 3, 0), (5, 2, 5)):
        text = " ".join([*[f"x{i}" for i in range(before)], *[line] * times, *[f"y{i}" for i in range(after)]])
        got = [x[1:5] for x in op7_licenses.scan(text, index) if x[0] == name]
        assert got == [(1.0, n, before + k * n, before + (k + 1) * n) for k in range(times)]


def test_op7_edge_rows(edge, empty):
    assert op7_licenses.scan_documents(edge).count() == op7_licenses.scan_documents(empty).count() == 0


# 8


def brute_bytes(items, width):
    count = Counter(b[i : i + width] for b in ((t or "").encode() for _, t in items) for i in range(len(b) - width + 1))
    out = []
    for d, t in items:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("which", ["edge", "docs", "empty"])
def test_op8_equals_brute_force(which, hot, request):
    df = request.getfixturevalue(which)
    items = [(r.doc_id, r.text) for r in df.collect()]
    assert rows(op8_suffix.remove_repeated_bytes(df, hot=hot)) == brute_bytes(items, 200)


def test_layout_follows_bytes(docs, monkeypatch):
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sum(len(r.text.encode()) for r in docs.select("text").collect() if r.text)
    assert anchors.Layout.of(docs).buckets == parts
    monkeypatch.setattr(anchors, "LEAST_BYTES", size)
    assert anchors.Layout.of(docs) == anchors.Layout(1, anchors.SHELVES_A_BUCKET)
    monkeypatch.setattr(anchors, "SHELF_BYTES", size // (3 * parts))
    assert anchors.Layout.of(docs).buckets >= 3 * parts
    assert anchors.Layout.of(docs.limit(0)).buckets == 1


def test_op8_hot_anchors_go_one_way(spark):
    """A window with one copy in a task that holds its hot anchor once and one where it stands often is found."""
    r = random.Random(5)
    chars = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    cores = [chars(120) for _ in range(10)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for single in range(4):
            shelf = lambda i: zlib.crc32(b"%d" % i) % 4
            others = [i for i in range(200) if shelf(i) == (single + 1) % 4][:6]
            alone = next(i for i in range(200) if shelf(i) == single)
            shared = [(chars(60), chars(60)) for _ in cores]
            text = lambda like: "".join(chars(250) + (a + c + b if like else chars(60) + c + chars(60)) for c, (a, b) in zip(cores, shared, strict=True))  # noqa: B023, E731
            items = [(alone, text(True)), (others[0], text(True))] + [(i, text(False)) for i in others[1:]]
            df = spark.createDataFrame(items, "doc_id long, text string")
            assert rows(op8_suffix.remove_repeated_bytes(df, hot=2)) == brute_bytes(items, 200)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text", [b"mississippi" * 5, b"a" * 400, bytes(range(256)) * 3, b"ab" * 300, b"\x00\xff\x00" * 80, b"zyx" * 90 + b"a"])
def test_op8_two_stage_order(text):
    data, width = np.frombuffer(text, np.uint8), 24
    starts = np.arange(len(text) - width + 1)
    order = op8_suffix.two_stage_sort(data, starts, width)
    assert sorted(order.tolist()) == starts.tolist()
    keys = [text[i : i + width] for i in order.tolist()]
    assert keys == sorted(keys)
    same = op8_suffix.common_prefixes(data, order, width) >= width
    assert same.tolist() == [a == b for a, b in zip(keys[:-1], keys[1:], strict=True)]


# 9


def test_op9_learns_on_rows_it_may_use(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in op9_toxicity.toxicity(docs, labels).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for _, r in held)
    toxic, clean = [r.predicted for t, r in held if t], [r.predicted for t, r in held if not t]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.03


def test_op9_edge_rows(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, None), (None, 1), (8, 1), (10, 0)], "doc_id long, toxic int")
    for marks in (none, labels):
        got = op9_toxicity.toxicity(edge, marks).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert op9_toxicity.toxicity(empty, labels).count() == 0


# 10


def check_packing(got, items, tok, capacity=2048):
    want = Counter()
    for d, t in items:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[d, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(r.length for r in got)


@pytest.mark.parametrize("which", ["edge", "docs", "empty"])
def test_op10_packs_every_piece(which, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = op10_packing.pack_documents(df, path).collect()
    n, total = check_packing(got, [(r.doc_id, r.text) for r in df.collect()], Tokenizer.from_file(path))
    assert n <= -(-total // 2048) * 1.05 + 2


def test_op10_words_alone_are_the_text():
    """Every character, alone and before or after letters and signs, gives in a text of such words the tokenizer's ids."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = op10_packing.WordTable(tok)
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x20000)]]
    for at in range(0, len(chars), 2_000):
        text = " ".join(f"{c}. A{c}, {c}b {c}'s" for c in chars[at : at + 2_000])
        assert table.encode([text.encode()])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), at
    odd = "<|endoftext|>x <|startoftext|>. İ. क़. STRASSE. ß, ﬁ. Σ. ΑΣ. \u200b. \u0301. a\u0301, \x1c\x85\xa0.\u2003 I.D. tree.."
    assert table.encode([odd.encode()])[0] == np.array(tok.encode(odd, add_special_tokens=False).ids, "<u4").tobytes()


def counting(table, monkeypatch):
    """The table's tokenizers note the words that they are given."""
    given = []

    class Noting:
        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, texts, **named):
            given.extend(w for t in texts for w in t.split())
            return self.tok.encode_batch_fast(texts, **named)

    for name in {"tokenizer", "plain"} & vars(table).keys():
        monkeypatch.setattr(table, name, Noting(getattr(table, name)))
    return given


def test_op10_tokenizes_a_stem_once(monkeypatch):
    """Letters of any kind share an entry whatever signs end the word; words in use outlive a full table."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    same = lambda text: table.encode([text.encode()])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    table = op10_packing.WordTable(tok)
    given = counting(table, monkeypatch)
    assert same("ñandú ñandú. ñandú, ñandú*** Tree tree?! TREE$$$ (tree) x1*** İ*** क़?! it's* <|endoftext|>. ñ...... ñandú's")
    assert sorted(w for w in given if w.startswith(("ñandú", "tree"))) == ["tree", "ñandú", "ñandú's"]
    monkeypatch.setattr(op10_packing, "TABLE_ENTRIES", 20)
    del given[:]
    for at in range(60):
        assert same("stone Überweg. " + " ".join(f"word{chr(97 + at % 26)}{chr(97 + at // 26)}{chr(97 + i)}" for i in range(10)))
        assert len(table.packed) < 40 and len(table.stems) < 40
    assert given.count("stone") == 1 and given.count("Überweg") == 1


def test_op10_ranks_with_salts(spark):
    """Lengths with many salts, one of them full: each piece has a place of its own."""
    rows = [(i, 0, 0, n, i) for i, n in enumerate([2048] * 40 + [1] * 500 + [700] * 90 + [1300] * 33)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = op10_packing.pack(pieces, salted=7).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_op10_plans_near_the_least():
    for capacity, draw in ((2048, lambda: min(2048, int(rng.lognormvariate(6, 1.2)) + 1)), (100, lambda: rng.randint(1, 100)), (30, lambda: rng.choice([8, 11, 16]))):
        counts = Counter(draw() for _ in range(5000))
        groups = op10_packing.plan_groups(counts, capacity)
        back = Counter()
        for lengths, n in groups:
            assert sum(lengths) <= capacity
            for x in lengths:
                back[x] += n
        assert back == counts
        assert sum(n for _, n in groups) <= 1.25 * -(-sum(k * v for k, v in counts.items()) // capacity)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
