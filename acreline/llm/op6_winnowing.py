"""Operator 6: document fingerprints by winnowing, with positions.

Rolling hashes of every GRAM code points; of each WINDOW consecutive ones the least is
kept, the rightmost of equal ones, with its position. Two texts that share WINDOW + GRAM - 1
code points share a fingerprint. A text with fewer grams than a window has one window, a
text shorter than a gram one hash of the whole, an empty text (null counts as one) none.

`compare_with_next` also needs each document's successor by id. Ids are cut at quantiles
into ranges, each range is sorted in one task, and only the ends of ranges meet their
successors by a join, so no global window is needed. An id that fills more than a range
(null counts as the least id) is a range of its own, cut further by a hash of the text. Rows
of one id stand in the order of that hash and of their texts; the last row's successor is
the first. Repeated rows give repeated rows, an empty table none; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import minimizers, mix, prefix_sums, range_hash, rolling, sliding, texts

GRAM = 12
WINDOW = 12
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, positions) that winnowing keeps, by position."""
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    sums = prefix_sums(mix(points.astype(np.uint64) + np.uint64(1)))
    if len(points) <= gram:
        hashes = range_hash(sums, np.array([0]), np.array([len(points)]))
    else:
        hashes = rolling(sums, gram)
    hashes >>= np.uint64(32)
    window = min(window, len(hashes))
    at = minimizers(hashes, window)
    own = hashes[at]
    order = np.lexsort((at, own))
    twin = np.flatnonzero(own[order][1:] == own[order][:-1])
    if len(twin):
        # of equal hashes, one stays if some window has it as its least and no equal one further right
        low = sliding(hashes, window, np.minimum)
        drop = []
        for i, after in zip(at[order[twin]].tolist(), at[order[twin + 1]].tolist(), strict=True):
            run = low[max(0, i - window + 1) : max(0, min(i, after - window) + 1)]
            if not (run == hashes[i]).any():
                drop.append(i)
        at = np.setdiff1d(at, np.array(drop, np.int64))
    return hashes[at].astype(np.uint32), at


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """hash@position in hexadecimal, by position."""
    return " ".join([f"{h:08x}@{p:x}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def likeness(a: set, b: set) -> float:
    """Shared share of two sets of hashes; 1 for two empty ones."""
    return len(a & b) / len(a | b) if a or b else 1.0


def compared(doc_id, text: str, after: str, own=None, following=None) -> tuple:
    """A result row; own and following: winnow() of both texts where it is known."""
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    own = own or winnow(code_points(text))
    following = following or winnow(code_points(after))
    changed = winnow(code_points(edited))
    prints = set(own[0].tolist())
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), written(*own), written(*changed), likeness(prints, set(changed[0].tolist())), likeness(prints, set(following[0].tolist()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows followed by another of their range, in ranges sorted by id and text."""
    held, rows, size = None, [], 0
    for batch in batches:
        for part, doc_id, text in zip(zip(batch.column("part").to_pylist(), batch.column("sub").to_pylist(), strict=True), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            prints = winnow(code_points(text))
            if held and held[0] == part:
                rows.append(compared(held[1], held[2], text, held[3], prints))
                size += len(text)
            held = part, doc_id, text, prints
            if size > 1 << 20:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [compared(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("after").to_pylist(), strict=True)]
        if rows:
            yield _batch(rows)


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(x) for x in values]).cast("array<long>")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness to it and to the next row's."""
    rows = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 1))
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = Counter(int(x) for x in rows.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n))  # a few numbers a partition
    # an id that is a quantile m times over has about m ranges' rows
    hot = {c: m for c, m in found.items() if m > 1}
    cuts = sorted({*found, *[c - 1 for c in hot if c > -(1 << 63)]})
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.size(F.filter(_numbers(cuts[::step]), lambda c: c < F.col("key")))
    fine = F.size(F.filter(F.slice(_numbers(cuts), F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step)), lambda c: c < F.col("key")))
    part = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)
    pieces = max(hot.values(), default=1)
    sub = F.when(F.array_contains(_numbers(sorted(hot)), F.col("key")), F.floor(F.col("mark") / (2.0**63 / pieces))).otherwise(F.lit(0)).cast("int")
    order_of = ["part", "sub", "key", "mark", "text"]
    # never null, so that joins on them put no filter under the exchange, which Spark would then run anew
    part, sub = F.coalesce(part, F.lit(0)), F.coalesce(sub, F.lit(0))
    ranges = rows.select(part.alias("part"), sub.alias("sub"), "key", "mark", "doc_id", "text").repartition("part", "sub").sortWithinPartitions(*order_of)
    row = F.struct("key", "mark", "text", "doc_id")
    ends = ranges.groupBy("part", "sub").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    # one row a range: which range comes next, the first one after the last
    order, whole = Window.orderBy("part", "sub"), F.struct("part", "sub")
    chain = ranges.select("part", "sub").distinct().select("part", "sub", F.coalesce(F.lead(whole).over(order), F.first(whole).over(order)).alias("next"))
    heads = ends.select(F.struct("part", "sub").alias("next"), F.col("head.text").alias("after"))
    last = ends.select("part", "sub", "tail.doc_id", "tail.text").join(chain, ["part", "sub"]).join(heads, "next").select("doc_id", "text", "after")
    # all columns on both ways, so that Spark runs their exchange once
    return ranges.mapInArrow(_inside, SCHEMA).unionByName(last.mapInArrow(_ends, SCHEMA))
