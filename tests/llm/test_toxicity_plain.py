"""The classifier's scores against a plain loop, and training that ends early."""

import math
import random

import numpy as np
import pyarrow as pa

from acreline.llm import op9_toxicity as op9
from acreline.llm.common import text_bytes

GOOD, BAD = "river lamp green paper walk seven music stone".split(), "vilword badword awfulthing".split()


def plain_score(model: op9.Model, text: str) -> float:
    """Each filter at each place of the text, word by word."""
    whole, stem = op9.word_numbers(text)
    total = model.offset
    for f, (width, weights) in enumerate(model.filters.items()):
        for k in range(op9.FILTERS):
            best = 0.0
            for at in range(len(whole) - width + 1):
                value = float(model.bias[f * op9.FILTERS + k])
                for j in range(width):
                    vector = model.table[whole[at + j]].astype(float) + model.table[stem[at + j]]
                    value += float(vector @ weights[j][:, k])
                best = max(best, value)
            total += best * model.out[f * op9.FILTERS + k]
    return 1 / (1 + math.exp(-total))


def rows(n: int, seed: int):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = draw.choices(GOOD, k=draw.randrange(3, 30))
        if i % 4 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(BAD))
        out.append((" ".join(words), int(i % 4 == 0), draw.choice(["en", "de", None])))
    return out


def test_scores_against_a_plain_loop():
    model = op9.fit(rows(150, 1), visits=600)
    texts = ["", "one", "two words", "Three BADWORD words, here!", "ünï çode ", "  ", *[r[0] for r in rows(12, 2)]]
    got = op9.scores(model, *text_bytes(pa.array(texts)))
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-5)


def test_training_ends_early_and_keeps_the_best(monkeypatch):
    epochs = []
    scored = op9.encoded_scores
    monkeypatch.setattr(op9, "encoded_scores", lambda model, encoded: epochs.append(1) or scored(model, encoded))
    draw = random.Random(3)
    noise = [(text, draw.randrange(2), None) for text, _, _ in rows(200, 4)]  # nothing to be learnt
    op9.fit(noise, visits=6_400)
    assert len(epochs) < 20  # 40 epochs and the thresholds without an early end
    epochs.clear()
    model = op9.fit(rows(400, 5))
    test = rows(200, 6)
    got = op9.scores(model, *text_bytes(pa.array([r[0] for r in test])))
    assert np.mean((got >= op9.CUT) == [r[1] == 1 for r in test]) >= 0.98


def test_a_step_goes_down_the_slope():
    """After one pass the loss on what was learnt from is less than before."""
    some = rows(80, 7)  # under 100 rows: none set aside
    before, after = op9.fit(some, visits=0), op9.fit(some, visits=400)
    y = np.array([r[1] for r in some])
    loss = lambda m: -np.mean(np.log(np.where(y, p := op9.scores(m, *text_bytes(pa.array([r[0] for r in some]))), 1 - p)))
    assert loss(after) < loss(before)
