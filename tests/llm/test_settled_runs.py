"""What tasks settle themselves: few bytes, and not all in the bucket of a key that every task has."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from acreline.llm import op8_suffix
from acreline.llm.anchors import SENT, Layout, Sender, joined_runs, sender, settle, shelved, with_found
from tests.llm.test_ops import brute_bytes, rows


def test_settled_places_are_dealt_over_all_buckets():
    """Each task has the least of all keys, as tasks do that share a common passage."""
    tasks, buckets, rng = 200, 20, np.random.default_rng(3)
    dealt = Counter()
    for task in range(tasks):
        keys = np.repeat(np.append(np.uint64(1), rng.integers(2, 1 << 64, 50, dtype=np.uint64)), 2)
        docs, places = np.full(len(keys), task), np.arange(len(keys))
        out = Sender(buckets, False)
        list(out.add(keys, docs, places))
        for batch in out.flush():
            dealt.update(b for b, known in zip(batch["bucket"].to_pylist(), batch["known"].to_pylist(), strict=True) if known)
    assert sum(dealt.values()) == tasks and len(dealt) > buckets / 2 and max(dealt.values()) < tasks / 5, dealt


def test_joined_runs_cover_what_windows_do():
    rng = random.Random(8)
    for width in (1, 3, 7):
        for n in (0, 1, 2, 40):
            windows = [(rng.randint(-2, 2), rng.randint(0, 60) + (rng.randint(0, 2) << 31)) for _ in range(n)]
            docs, places = (np.array(x, np.int64) for x in (zip(*windows, strict=True) if windows else ([], [])))
            got = list(zip(*(x.tolist() for x in joined_runs(docs, places, width)), strict=True))
            cover = Counter((d, x) for d, p, w in got for x in range(p, p + w))
            assert set(cover) == {(d, x) for d, p in windows for x in range(p, p + width)}
            assert max(cover.values(), default=1) == 1 and all((d, p + w) not in cover for d, p, w in got)


def test_a_hot_passage_is_sent_as_runs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage = " ".join(word() for _ in range(120))
    items = [(i, f"{' '.join(word() for _ in range(rng.randint(0, 40)))} {passage if i % 4 else passage[:500]} {word()}") for i in range(400)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    assert rows(op8_suffix.remove_repeated_bytes(docs, hot=50)) == brute_bytes(items, 200)
    layout = Layout(4, 16)
    whole = shelved(docs, layout)
    anchors = settle(whole.mapInArrow(sender(op8_suffix.anchors_of(200, 40), 4), SENT), 16, False, 50)
    moved = with_found(whole, anchors, op8_suffix.windows_on(200, 40, 4), op8_suffix.MOVED)
    size = sum(F.octet_length(c) for c in ("docs", "places", "counts"))
    settled = moved.filter("known and texts is null").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    # some 800 windows a text at 16 bytes, or one run
    assert settled.n and settled.bytes < 400 * 3 * 20, settled
