"""Licence scans pass over candidates that can't match: the same rows as when each is aligned, in little time."""

import random
import time
from collections import defaultdict

import pytest

from acreline.llm import op7_licenses as op7
from acreline.llm.common import prefix_sums, rolling

INDEX = op7.Index(op7.TEMPLATES)


def scan_all(text: str, least: float = op7.COVERAGE):
    """Every diagonal of every template aligned."""
    words, start, end = op7.words_in(text)
    grams = rolling(prefix_sums(words), op7.GRAM)
    by = defaultdict(set)
    for h, gram in enumerate(grams.tolist()):
        for t, p in INDEX.places.get(gram, ()):
            by[t].add(h - p)
    out = []
    for t, diagonals in by.items():
        n, done = len(INDEX.words[t]), 0
        band = max(2, n // 5)
        for d in sorted(diagonals):
            low, high = max(done, d - band), min(len(words), d + n + band)
            if high - low < least * n:
                continue
            common, first, last = op7.align(INDEX.words[t], words[low:high], band, d - low)
            if common >= least * n:
                a, b = low + first, low + last
                out.append((INDEX.names[t], common / n, common, a, b, int(start[a]), int(end[b - 1])))
                done = b
    return sorted(out, key=lambda x: (x[3], x[4], x[0]))


@pytest.mark.parametrize("seed", range(8))
def test_same_rows_as_aligning_all(seed):
    """Templates whole, with words lost, doubled or swapped, halves and shuffles of them, between other words."""
    draw = random.Random(seed)
    text = []
    for name in draw.sample(list(op7.TEMPLATES), 5):
        words = op7.TEMPLATES[name].split()
        kind = draw.randrange(5)
        if kind == 1:
            words = [w for w in words if draw.random() > 0.15]
        elif kind == 2:
            words = [x for w in words for x in [w] * (1 + (draw.random() < 0.15))]
        elif kind == 3:
            words = words[: len(words) * 2 // 3]
        elif kind == 4:
            draw.shuffle(words)
        text += words + [f"word{draw.randrange(50)}" for _ in range(draw.randrange(12))]
    assert op7.scan(" ".join(text), INDEX) == scan_all(" ".join(text))


def test_in_order_against_the_table():
    draw = random.Random(5)
    for _ in range(200):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        bits = defaultdict(int)
        for i, x in enumerate(a):
            bits[x] |= 1 << i
        assert op7.in_order(bits, len(a), b) == row[-1]


@pytest.mark.parametrize("phrase", ["without restriction, including without limitation the rights to use", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"])
def test_a_repeated_phrase_takes_little_time(phrase):
    text = " ".join([phrase] * (100_000 // len(phrase.split())))
    began = time.perf_counter()
    assert op7.scan(text, INDEX) == []
    assert time.perf_counter() - began < 3
