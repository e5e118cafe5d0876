"""Operator 8's buckets: blocks of whole keys find what brute force does, and hold few objects at a time."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from acreline.llm import op8_suffix

WIDTH = 24


def segments(n, seed, size):
    """(key, text, places): texts of a key share some windows, some texts come twice."""
    r = random.Random(seed)
    chars = lambda k: bytes(r.choice(b"abc\0\xff") for _ in range(k))
    out, place = [], 0
    for key in range(n):
        core = chars(WIDTH + 3)
        for _ in range(r.randint(1, 3)):
            text = chars(r.randint(0, size)) + (core if r.random() < 0.5 else chars(WIDTH)) + chars(r.randint(0, size))
            for _ in range(r.choice((1, 1, 2))):
                count = r.choice((1, 1, 1, 2))
                out.append((key * 7919 % 1009, text, [(place + i, 5 * i) for i in range(count)]))
                place += count
    r.shuffle(out)
    return out


def packed(rows):
    places = np.array([p for _, _, own in rows for p in own], np.int64)
    return np.array([k for k, _, _ in rows], np.uint64), np.array([len(own) for _, _, own in rows], np.int32), np.array([len(t) for _, t, _ in rows], np.int64), places[:, 0], places[:, 1], b"".join(t for _, t, _ in rows)


def covered(found):
    return {(d, x) for d, p, w in zip(*(x.tolist() for x in found), strict=True) for x in range(p, p + w)}


@pytest.mark.parametrize("block", [1, 50, 200_000])
def test_blocks_find_what_brute_force_does(monkeypatch, block):
    monkeypatch.setattr(op8_suffix, "BLOCK", block)
    rows = segments(60, 3, 12)
    count = Counter((k, t[i : i + WIDTH]) for k, t, own in rows for _ in own for i in range(len(t) - WIDTH + 1))
    want = {(d, p + x) for k, t, own in rows for d, p in own for i in range(len(t) - WIDTH + 1) if count[k, t[i : i + WIDTH]] > 1 for x in range(i, i + WIDTH)}
    assert want and covered(op8_suffix.segment_runs(*packed(rows), WIDTH)) == want


def test_a_bucket_is_held_as_bytes(monkeypatch):
    """Beside the bytes that came, a bucket takes memory by the block: here, under three times the bytes in all."""
    monkeypatch.setattr(op8_suffix, "BLOCK", 2_000)
    rows = segments(6_000, 5, 60)
    groups = [rows[at : at + 500] for at in range(0, len(rows), 500)]
    cols = [(0, False, keys.tobytes(), docs.tobytes(), places.tobytes(), counts.tobytes(), lengths.tobytes(), data) for keys, counts, lengths, docs, places, data in map(packed, groups)]
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*cols, strict=True), op8_suffix._PAIR, strict=True)], schema=op8_suffix._PAIR)

    class Moved:
        def groupBy(self, *_):
            return self

        def applyInArrow(self, f, kind):
            return f

    settle = op8_suffix.settle_windows(Moved(), 4, WIDTH)
    settle(table.slice(0, 1))
    tracemalloc.start()
    try:
        got = settle(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(x) for x in got.column("docs").to_pylist()) > 0 and set(got.column("shelf").to_pylist()) <= set(range(4))
    assert peak < 3 * table.nbytes, (peak, table.nbytes)
