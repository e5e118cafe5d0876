"""Operator 9: a convolutional text classifier over hashed words, trained in numpy.

A word's vector is the sum of two rows of one table, chosen by the hash of the word and of
its first bytes (so that inflected forms share one). Filters of widths 1 to 3 slide over
the words, each keeps its largest response in the text, and a logistic layer scores them.
As filters are linear up to the maximum, a filter's share of each table row is computed
once and scoring is a few gathers, sums and maxima.

Fitting takes a sample of labelled ids whose number is bounded by `sample_rows` (the
least by a hash of the id; an id's largest label and least text count), one part of which
sets a threshold for each language. Labels, language, source and id never enter a score.
Texts become word numbers as they arrive and are scored in slices, so the fitting task holds
eight bytes a word of the sample. Scoring maps over whole texts.

Null and empty texts have no words: their score is the logistic layer's own offset, as
for any text of which no filter has responded. Without labels of both kinds the score is
the share of label 1 (0.5 without any labels).
"""

from __future__ import annotations

import copy
import dataclasses
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import arrow_slices, bound_batches, byte_values, plain, prefix_sums, range_hash, text_bytes, texts, words_of

BUCKETS = 1 << 15
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Bytes of a word's stem.
STEM = 4
#: Labelled rows that fitting takes at most.
SAMPLE_ROWS = 16_000
#: Rows that training visits in all: a smaller sample is gone through more often, MOST_EPOCHS times at most.
VISITS = 76_800
MOST_EPOCHS = 40
BATCH = 64
CUT = 0.3
#: Words that are scored at a time, unless one text has more.
WORDS = 150_000
#: Epochs without a gain after which training ends.
PATIENCE = 3
#: A language with fewer rows of either kind has CUT as its threshold.
LEAST_KIND = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Punctuation of ASCII separates words.
_BREAK = np.array([not chr(b).isalnum() and b < 128 for b in range(256)])


@dataclasses.dataclass
class Model:
    table: np.ndarray  # BUCKETS x SIZE
    filters: dict[int, np.ndarray]  # width -> width x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = dataclasses.field(default_factory=dict)
    #: Whether there were labels of both kinds to learn from.
    learned: bool = False


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table row of each word, of its stem, first word of each text)."""
    low = _LOWER[data]
    blank = np.where(_BREAK[low], np.uint8(32), low)
    start, end, first = words_of(blank, offsets)
    sums = prefix_sums(byte_values(blank))
    whole = (range_hash(sums, start, end) % np.uint64(BUCKETS)).astype(np.int32)
    stem = (range_hash(sums, start, np.minimum(end, start + STEM)) % np.uint64(BUCKETS)).astype(np.int32)
    return whole, stem, first


def responses(model: Model, whole: np.ndarray, stem: np.ndarray, first: np.ndarray, places: bool = False):
    """Per text the largest response of each filter (0 at least), and with `places` the word where it starts (-1: none)."""
    n, k = len(first) - 1, FILTERS * len(model.filters)
    best = np.zeros((n, k), np.float32)
    where = np.full((n, k), -1, np.int64)
    vectors = model.table[whole]
    vectors += model.table[stem]
    for f, (width, weights) in enumerate(model.filters.items()):
        cols = slice(f * FILTERS, (f + 1) * FILTERS)
        m = len(whole) - width + 1
        if m <= 0:
            continue
        value = vectors[:m] @ weights[0]
        for j in range(1, width):
            value += vectors[j : j + m] @ weights[j]
        value += model.bias[cols]
        # texts with fewer words than the width have no response
        full = np.flatnonzero(np.diff(first) >= width)
        if not len(full):
            continue
        # the positions that would cross into the next text don't count
        bounds = np.stack([first[full], first[full + 1] - width + 1], axis=1).ravel()
        tail = np.append(value, np.full((1, FILTERS), -1, np.float32), axis=0)
        top = np.maximum.reduceat(tail, bounds, axis=0)[::2]
        best[full, cols] = np.maximum(top, 0)
        if places:
            for i, a, b, peak in zip(full.tolist(), bounds[::2].tolist(), bounds[1::2].tolist(), top, strict=True):
                at = value[a:b].argmax(axis=0) + a
                where[i, cols] = np.where(peak > 0, at, -1)
    return (best, where) if places else best


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    best = responses(model, *word_rows(data, offsets))
    return 1 / (1 + np.exp(-(best.astype(np.float64) @ model.out + model.offset)))


def word_numbers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(table row of each word, of its stem) of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_rows(raw, np.array([0, len(raw)]))[:2]


def fit(rows: list[tuple[str, int, str | None]], seed: int = 7, visits: int = VISITS) -> Model:
    """A model of (text, label, language) rows; the fifth part of them sets thresholds only."""
    return train([word_numbers(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows], seed, visits)


def train(encoded: list[tuple[np.ndarray, np.ndarray]], marks: list[int], langs: list[str | None], seed: int = 7, visits: int = VISITS) -> Model:
    rng = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), {w: rng.normal(0, 0.3 / w**0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(k, np.float32), rng.normal(0, 0.1, k), 0.0,
    )
    labels = np.array(marks, np.float64)
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        share = (labels.sum() + 1) / (len(labels) + 2)
        model.offset = float(np.log(share / (1 - share)))
        return model
    model.learned = True
    share = labels.mean()
    model.offset = float(np.log(share / (1 - share)))
    held = np.arange(len(labels)) % 5 == 4 if len(labels) >= 100 else np.zeros(len(labels), bool)
    learned = np.flatnonzero(~held)
    epochs = min(MOST_EPOCHS, -(-visits // len(learned)))
    slow, fast = {}, {}
    t = 0

    def step(name, value, grad, rate):
        m, v = slow.setdefault(name, np.zeros_like(value)), fast.setdefault(name, np.zeros_like(value))
        m *= 0.9
        m += 0.1 * grad
        v *= 0.999
        v += 0.001 * grad * grad
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    offset = np.array([model.offset])
    aside = np.flatnonzero(held).tolist()
    least, kept, behind = np.inf, None, 0
    for epoch in range(epochs):
        order = rng.permutation(learned)
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            whole, stem = (np.concatenate([encoded[i][j] for i in part]) for j in (0, 1))
            first = np.concatenate([[0], np.cumsum([len(encoded[i][0]) for i in part])])
            best, where = responses(model, whole, stem, first, places=True)
            p = 1 / (1 + np.exp(-(best @ model.out + offset[0])))
            err = (p - labels[part]) / len(part)
            t += 1
            grad_best = (err[:, None] * model.out).astype(np.float32)
            hit = where >= 0
            grads = {"out": best.T @ err + 1e-5 * model.out, "offset": np.array([err.sum()]), "bias": (grad_best * hit).sum(axis=0)}
            grad_table = np.zeros_like(model.table)
            for f, (width, weights) in enumerate(model.filters.items()):
                d, c = np.nonzero(hit[:, f * FILTERS : (f + 1) * FILTERS])
                pos, g = where[d, f * FILTERS + c], grad_best[d, f * FILTERS + c]
                grad_w = np.zeros_like(weights)
                for j in range(width):
                    a, b = whole[pos + j], stem[pos + j]
                    vec = model.table[a] + model.table[b]
                    np.add.at(grad_w[j].T, c, vec * g[:, None])
                    back = weights[j].T[c] * g[:, None]
                    np.add.at(grad_table, a, back)
                    np.add.at(grad_table, b, back)
                grads[width] = grad_w
            step("out", model.out, grads["out"], rate)
            step("offset", offset, grads["offset"], rate)
            step("bias", model.bias, grads["bias"], rate)
            for width, weights in model.filters.items():
                step(width, weights, grads[width], rate)
            step("table", model.table, grad_table, rate)
        model.offset = float(offset[0])
        if aside:
            p = np.clip(encoded_scores(model, [encoded[i] for i in aside]), 1e-7, 1 - 1e-7)
            loss = -float(np.mean(np.log(np.where(labels[aside] > 0, p, 1 - p))))
            if loss < least:
                least, kept, behind = loss, copy.deepcopy(model), 0
            else:
                behind += 1
            if behind == PATIENCE:
                break
    model = kept or model
    if aside:
        calibrate(model, [encoded[i] for i in aside], labels[aside], [langs[i] for i in aside])
    return model


def encoded_scores(model: Model, encoded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Scores of texts given as word numbers, so many words at a time."""
    sizes = np.array([len(w) for w, _ in encoded])
    part = np.cumsum(sizes) // WORDS
    got = np.empty(len(encoded))
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        whole, stem = (np.concatenate([encoded[i][j] for i in at]) for j in (0, 1))
        best = responses(model, whole, stem, np.concatenate([[0], np.cumsum(sizes[at])]))
        got[at] = 1 / (1 + np.exp(-(best.astype(np.float64) @ model.out + model.offset)))
    return got


def calibrate(model: Model, encoded: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str | None]) -> None:
    """Per language the threshold of best F1 on these rows, the widest gap's middle among equals; CUT where rows are few."""
    got = encoded_scores(model, encoded)
    for lang in {x for x in langs if x is not None}:
        at = [i for i, x in enumerate(langs) if x == lang]
        s, y = got[at], labels[at]
        if min(y.sum(), len(y) - y.sum()) < LEAST_KIND:
            model.thresholds[lang] = CUT
            continue
        order = np.argsort(-s)
        s, y = s[order], y[order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        gap = s - np.append(s[1:], 0)
        top = np.flatnonzero(f1 >= f1.max() - 1e-12)
        i = top[np.argmax(gap[top])]
        model.thresholds[lang] = float(s[i] - gap[i] / 2)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit, in one task, on at most `sample_rows` labelled rows that learning may use: crc32 of the id modulo 4 isn't 2."""
    marks = plain(labels, ["doc_id", "toxic"]).filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    chosen = marks.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    bound_batches(docs.sparkSession)
    names = ["doc_id", "text"] + ["lang"] * ("lang" in docs.columns)
    found = plain(docs, names).join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows of two integers
    lang = F.col("lang") if "lang" in names else F.lit(None).cast("string")
    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "toxic", lang.alias("lang"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "lang")).alias("row")).select("doc_id", "row.*")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part in (p for b in batches for p in arrow_slices(iter([b]))):
            words = map(word_numbers, part.column("text").to_pylist())
            rows += zip(*[part.column(c).to_pylist() for c in ("doc_id", "toxic", "lang")], words, strict=True)
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[0]))
        model = train([r[3] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = one.repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(bytes(made[0].model)) if made else fit([])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in arrow_slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(model, *text_bytes(part.column("text"))))], names=["doc_id", "score"])

    return texts(docs).mapInArrow(work, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows under their language's threshold, with all their columns; all rows if there was nothing to learn from."""
    if not model.learned:
        return docs
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")
    at_lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            marked = pa.RecordBatch.from_arrays([*batch.columns, batch.column(at_text).fill_null("")], names=[*map(str, range(batch.num_columns)), "whole"])
            for part in arrow_slices(iter([marked]), "whole", 1 << 20):
                score = scores(model, *text_bytes(part.column("whole")))
                lang = part.column(at_lang).to_pylist() if at_lang is not None else [None] * part.num_rows
                limit = np.array([model.thresholds.get(x, CUT) for x in lang])
                kept = part.filter(pa.array(score < limit))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=batch.schema.names)

    # by place, since names may differ by letter case only
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return placed.mapInArrow(work, placed.schema).toDF(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from CUT on) of each row."""
    scored = score_documents(docs, learn(docs, labels, sample_rows))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
