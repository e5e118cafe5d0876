"""Operators 11 to 13 against brute force, on ordinary rows and on the odd ones."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from acreline.llm import op11_neardup as neardup
from acreline.llm import op12_fim as fim
from acreline.llm import op13_vectors as codes

VECTORS = "vec_id long, embedding array<float>, label int"


def linked(ids, v, similar=0.9):
    """n_links and component of each row, by all pairs."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= similar
    np.fill_diagonal(near, False)
    least = ids.copy()
    while True:
        lower = np.array([min([least[i], *least[near[i]]]) for i in range(len(ids))])
        if (lower == least).all():
            return dict(zip(ids.tolist(), zip(near.sum(axis=1).tolist(), least.tolist(), strict=True), strict=True))
        least = lower


def near(rng, base, cosine, n):
    aside = rng.normal(size=(n, base.shape[-1]))
    aside -= (aside * base).sum(axis=-1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * aside


@pytest.mark.parametrize("block", [4096, 60])
def test_neardup_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    # pairs at the threshold, a core of near copies, a ring about it, and many equal rows
    v = np.concatenate([base, *[near(rng, base[:80], c, 80) for c in (0.905, 0.93, 0.99)], near(rng, base[100], 0.99, 250), near(rng, base[100], 0.95, 30), np.repeat(base[101:102], 150, axis=0)]).astype(np.float32)
    ids = rng.permutation(len(v))
    rows = [(int(i), x.tolist(), 0) for i, x in zip(ids, v, strict=True)]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    want = linked(ids, v.astype(np.float64))
    assert set(got) == set(want)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.99 * there
    few = [i for i, (n, _) in want.items() if 0 < n < 20]
    assert sum(got[i].n_links for i in few) >= 0.95 * sum(want[i][0] for i in few)
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)


def test_neardup_tables_keep_every_pair_that_links(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 30))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = near(rng, u, 0.9001, 400)
    index = neardup.Index(u, 8)
    home = index.home_of(v)
    tables, rest = index.codes_of(v, home)
    for at in range(8):
        mine = np.flatnonzero(home == at)
        if len(mine):
            q, m = index.candidates(u, at, tables[mine], rest[mine])
            assert {(i, i) for i in mine} <= set(zip(q.tolist(), mine[m].tolist(), strict=True))
            assert len(q) < 400 * len(mine) / 4  # most others are dropped


def test_neardup_odd_rows(spark):
    bad, good = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1.0, 0.0]], [1.0, 0.0, 0.0, 0.0]
    rows = [(i, x, "x") for i, x in enumerate(bad)] + [(20, good, "x"), (21, good, "x"), (21, [1.0, 0.01, 0.0, 0.0], "x"), (None, good, "x"), (30, [0.0, 1.0, 0.0, 0.0], "x"), (31, [1e30, 1.0, 0.0, 0.0], "x"), (None, None, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, VEC_ID string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in neardup.near_duplicates(table).collect())
    want = [(str(i), 0, str(i), True) for i in range(len(bad))] + [("20", 4, "20", True), ("21", 4, "20", False), ("21", 4, "20", False), ("None", 4, "20", False), ("30", 0, "30", True), ("31", 4, "20", False), ("None", 0, "None", True)]
    assert got == sorted(want)
    assert neardup.near_duplicates(table.limit(0)).count() == 0
    assert neardup.near_duplicates(table.filter("embedding is null")).count() == 2


def plainly(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb\nc\n", "é\nß→\n😀😀\n\n漢字", "<P", "<\nP>", "<P>", "a<S>b\nc", "x\n<<M>\n", "<P\n>", "<Q>\n<p>\n", "S>\nM>\n<\n", "a\r\nb\r\n c\n", "<" * 300 + "\n" + "P>", "😀" * 200 + "\n" + "é" * 127 + "<P>",
    "w " * 200_000 + "\n" + "z\n" * 3_000, *["".join(chr(97 + (i * j) % 26) if (i + j) % 5 else "\n" for i in range(3 * j)) for j in range(1, 120)],
]


def test_fim_against_regular_expressions(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "p\nq\nr\n"), (5, "a\nb\nc\n"), (5, "other\nlines")]
    table = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, text string, TEXT string, form string")
    out = fim.transform(table)
    got = sorted(repr(tuple(r)) for r in out.collect())
    assert got == sorted(repr((i, *plainly(i, t))) for i, t in rows)
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr((i, t or "")) for i, t in rows)
    assert fim.transform(table.limit(0)).count() == 0
    assert {r.form for r in fim.transform(table, rate=0).collect()} == {"plain"}


def test_fim_scan_counts():
    data = "é<P>\n<<S>x\n漢<M".encode()
    scan = fim.Scan(np.frombuffer(data * 40, np.uint8), np.arange(41) * len(data))
    assert set(scan.points.tolist()) == {len(data.decode())} and set(scan.units.tolist()) == {3} and set(scan.sentinels.tolist()) == {2}


def lloyd(x, parts=16, entries=64, rounds=2):
    """Codebooks, codes and errors by looking at every entry."""
    w = x.shape[1] // parts
    books = [[tuple(r[p * w : p * w + w]) for r in x[:entries].tolist()] for p in range(parts)]
    for turn in range(rounds + 1):
        own = np.array([[min((sum((a - b) ** 2 for a, b in zip(r[p * w : p * w + w], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)] for r in x.tolist()])
        if turn == rounds:
            return books, own[:, :, 1], own[:, :, 0].sum(axis=1)
        for p in range(parts):
            for i in range(len(books[p])):
                at = x[own[:, p, 1] == i, p * w : p * w + w]
                if len(at):
                    books[p][i] = tuple(int(s) // len(at) for s in at.sum(axis=0))


@pytest.mark.parametrize(("n", "size"), [(220, 32), (40, 16), (1, 16)])
def test_codes_against_all_entries(spark, n, size):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, size)).round(1)
    x[: n // 3] = x[0]
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    books, own, error = lloyd(np.floor(256 * x).astype(np.int64))
    assert {i: r.code for i, r in got.items()} == {i: "".join(f"{e:02x}" for e in o) for i, o in enumerate(own.tolist())}
    assert [got[i].error for i in range(n)] == error.tolist()
    totals = {k: sum(int(e) for e, r in zip(error, rows, strict=True) if r[2] == k) for k in (None, 0, 1, 2)}
    assert all(got[i].label_error == totals[label] for i, _, label in rows)
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(text.encode()).hexdigest()}


def test_trees_give_whole_nodes_away():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-9, 9, (3000, 4)) + 1000 * i for i in range(3)])
    book = np.array([[1000 * i] * 4 for i in range(3)] + [[0] * 4] + rng.integers(0, 2000, (20, 4)).tolist())
    own, apart, sums, counts, whole = codes.filtered(codes.KdTree(points), book)
    far = ((points[:, None] - book) ** 2).sum(axis=2)
    assert (own == far.argmin(axis=1)).all() and (apart == far.min(axis=1)).all()
    assert counts.tolist() == np.bincount(own, minlength=len(book)).tolist() and (sums.sum(axis=0) == points.sum(axis=0)).all()
    assert whole > 0.9 * len(points)


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 16
    rows = [(None, good, None), (3, None, 1), (4, [nan] * 16, 1), (5, [inf] + [0.0] * 15, 1), (6, [None] + [0.0] * 15, 1), (12, [1.0] * 8, 1), (8, good, 1), (8, [1e300] * 16, 2), (9, [-0.001] * 16, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, Label string")
    got = codes.compress(table).collect()
    assert sorted(str(r.vec_id) for r in got) == ["8", "8", "9", "None"]
    assert {r.error for r in got} == {0}
    assert codes.compress(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0] * 15, 1)], "vec_id long, embedding array<double>, label int"))
