"""Rows that share an id, or have none, keep what no other row repeats."""

import hashlib
import random

import pytest

from acreline.llm import anchors
from acreline.llm.op2_substring import remove_repeated_words
from acreline.llm.op8_suffix import remove_repeated_bytes


@pytest.fixture(scope="module")
def shared():
    """Texts of different lengths without an id or with one and the same, all different, and a pair that repeats a long stretch."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(30 + i % 40)) for i in range(4_000)]
    long = " ".join(word() for _ in range(80))
    return [(None if i % 2 else 5, t) for i, t in enumerate(texts)] + [(None, long + " one"), (None, "two " + long)]


@pytest.fixture
def few_tags(monkeypatch):
    """Checksums of two bits, so that tags of rows with one id are equal."""
    monkeypatch.setattr(anchors, "TAGS", 3)


def test_words_of_rows_without_an_id(spark, shared, few_tags):
    nulls = [r for r in shared if r[0] is None]
    got = remove_repeated_words(spark.createDataFrame(nulls, "doc_id long, text string")).collect()
    assert len(got) == len(nulls)
    assert sorted(r.n_removed for r in got)[-2:] == [0, 80] and sum(r.n_removed for r in got) == 80
    assert {hashlib.sha256(t.encode()).hexdigest() for _, t in nulls[:-2]} <= {r.kept_sha256 for r in got}


def test_bytes_of_rows_without_an_id(spark, shared, few_tags):
    nulls = [r for r in shared if r[0] is None]
    got = remove_repeated_bytes(spark.createDataFrame(nulls, "doc_id long, text string")).collect()
    assert len(got) == len(nulls)
    assert sum(r.n_removed > 0 for r in got) == 2
    assert {hashlib.sha256(t.encode()).hexdigest() for _, t in nulls[:-2]} <= {r.kept_sha256 for r in got}


@pytest.mark.parametrize("remove", [remove_repeated_words, remove_repeated_bytes])
def test_rows_of_one_id(spark, shared, remove):
    got = remove(spark.createDataFrame(shared, "doc_id long, text string")).collect()
    assert len(got) == len(shared) and sum(r.n_removed > 0 for r in got) <= 2
