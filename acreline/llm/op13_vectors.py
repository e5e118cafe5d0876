"""Operator 13: vector codes from codebooks trained by the filtering form of Lloyd's algorithm.

Components become integers, vectors are cut into equal consecutive parts, and each part
position has a codebook. In every round each slice of a partition builds a kd-tree over its
parts of a position, with the sum, count and bounding box of every node cached. Going down
from the root, an entry is dropped from a node when no point of the node's box is nearer to
it than to the entry nearest the box's middle; a node that is left with one entry gives its
sum and count to it at once, and only leaves with several entries look at their points.
What the slices found is added up in the partition and then by Spark, so a round sends a
row for each partition, position and entry, and the driver holds the codebooks alone.

All distances, sums and divisions are of integers, so the result doesn't depend on how rows
are dealt. Rows whose vector is null or holds null or non-finite components are dropped, as
are those of another length than the row of the least id. Components beyond LARGEST are
taken as it, so that squared distances fit 64 bits. Ids may repeat or be null (last in
order; equal ids in an order of their components); each row gives a row. With fewer rows than
entries the codebooks are as small. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import materialize, plain, told

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Rows whose trees are built at once, and points of a leaf.
SLICE = 8_192
LEAF = 8
#: Largest absolute component, as an integer.
LARGEST = 1 << 26


class KdTree:
    """A balanced kd-tree over the rows of `points`: levels of boxes, sums and counts, the root first."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        n, self.width = points.shape
        depth = 0
        while leaf << depth < n:
            depth += 1
        size = leaf << depth
        # what is missing to a full tree are copies of the last point that count nothing
        order = np.minimum(np.arange(size), n - 1)
        real = np.arange(size) < n
        self.levels = []
        for level in range(depth + 1):
            nodes = 1 << level
            some = points[order].reshape(nodes, size // nodes, self.width)
            low, high = some.min(axis=1), some.max(axis=1)
            counted = real.reshape(nodes, -1)
            self.levels.append((low, high, (some * counted[:, :, None]).sum(axis=1), counted.sum(axis=1)))
            if level < depth:
                axis = (high - low).argmax(axis=1)
                along = np.take_along_axis(some, axis[:, None, None], axis=2)[:, :, 0]
                by = np.argpartition(along, size // nodes // 2 - 1, axis=1)
                order = np.take_along_axis(order.reshape(nodes, -1), by, axis=1).ravel()
                real = np.take_along_axis(counted, by, axis=1).ravel()
        self.order, self.real, self.leaf = order, real, leaf
        self.points = points[order]


def _nearest(keys: np.ndarray, entry: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least key, least entry of that key) in each run of rows; keys may be a matrix of rows."""
    least = np.minimum.reduceat(keys, starts, axis=0)
    tied = keys == np.repeat(least, counts, axis=0)
    shape = (-1, *[1] * (keys.ndim - 1))
    return least, np.minimum.reduceat(np.where(tied, entry.reshape(shape), np.iinfo(np.int64).max), starts, axis=0)


def filtered(tree: KdTree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance of each point; sums, counts of each entry; points that were given away without being looked at)."""
    k = len(book)
    total = int(tree.real.sum())
    own, apart = np.zeros(len(tree.order), np.int64), np.zeros(len(tree.order), np.int64)
    sums, counts = np.zeros((k, tree.width), np.int64), np.zeros(k, np.int64)
    node, entry = np.zeros(k, np.int64), np.arange(k)
    whole = 0
    for level, (low, high, total_of, count_of) in enumerate(tree.levels):
        if not len(node):
            break
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        many = np.diff(np.concatenate([starts, [len(node)]]))
        middle = ((2 * book[entry] - low[node] - high[node]) ** 2).sum(axis=1)
        _, best = _nearest(middle, entry, starts, many)
        best = np.repeat(best, many)
        z, star = book[entry], book[best]
        corner = np.where(z > star, high[node], low[node])
        # how much farther than the best entry this one is at the point of the box that favours it most
        farther = ((z - star) * (z + star - 2 * corner)).sum(axis=1)
        keep = (farther < 0) | (farther == 0) & (entry <= best)
        node, entry = node[keep], entry[keep]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        many = np.diff(np.concatenate([starts, [len(node)]]))
        alone = many == 1
        if alone.any():
            done, its = node[starts[alone]], entry[starts[alone]]
            np.add.at(sums, its, total_of[done])
            np.add.at(counts, its, count_of[done])
            whole += int(count_of[done].sum())
            size = len(tree.order) >> level
            at = (done[:, None] * size + np.arange(size)).ravel()
            own[at] = np.repeat(its, size)
        node, entry = node[np.repeat(~alone, many)], entry[np.repeat(~alone, many)]
        if level < len(tree.levels) - 1:
            # both children take the entries of their node, which stay in order
            many = many[~alone]
            runs = np.repeat(np.arange(len(many)), many)
            inside = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
            base = np.repeat(2 * (np.cumsum(many) - many), many)
            at = np.concatenate([base + inside, base + inside + np.repeat(many, many)]) if len(runs) else np.zeros(0, np.int64)
            children, entries = np.empty(2 * len(node), np.int64), np.empty(2 * len(node), np.int64)
            children[at], entries[at] = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([entry, entry])
            node, entry = children, entries
    if len(node):
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        many = np.diff(np.concatenate([starts, [len(node)]]))
        leaves = node[starts]
        at = leaves[:, None] * tree.leaf + np.arange(tree.leaf)
        far = np.zeros((len(node), tree.leaf), np.int64)
        for d in range(tree.width):
            far += (tree.points[:, d].reshape(-1, tree.leaf)[node] - book[entry, d][:, None]) ** 2
        _, got = _nearest(far, entry, starts, many)
        own[at.ravel()] = got.ravel()
        real = tree.real[at].ravel()
        np.add.at(sums, got.ravel()[real], tree.points[at.ravel()[real]])
        counts += np.bincount(got.ravel()[real], minlength=k)
    apart = ((tree.points - book[own]) ** 2).sum(axis=1)
    back = np.empty(total, np.int64), np.empty(total, np.int64)
    back[0][tree.order[tree.real]], back[1][tree.order[tree.real]] = own[tree.real], apart[tree.real]
    return *back, sums, counts, whole


def units(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, units: the components as 32-bit integers, in a written table; components of a vector)."""
    rows = plain(vectors, ["vec_id", "label", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("embedding").isNotNull() & finite)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("size")).first()
    size = first.size if first else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.clip(np.floor(batch.column("embedding").flatten().to_numpy(zero_copy_only=False) * scale), -LARGEST, LARGEST).astype("<i4")
                held = [r.tobytes() for r in x.reshape(batch.num_rows, size)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(held, pa.binary())], names=["vec_id", "label", "units"])

    kind = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, units binary"
    return materialize(rows.filter(F.size("embedding") == size).mapInArrow(work, kind), "units"), size


def slices(batches: Iterator[pa.RecordBatch], size: int, rows: int = SLICE) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, their integers) of about `rows` rows each."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        flat = np.frombuffer(b"".join(table.column("units").to_pylist()), "<i4")
        return table, flat.reshape(-1, size).astype(np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) >= rows:
                yield out()
                held = []
    if sum(b.num_rows for b in held):
        yield out()


def train(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks, (parts, entries, components of a part)."""
    width = size // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "units").limit(entries).select("units")
    least = np.array([np.frombuffer(r.units, "<i4") for r in first.collect()], np.int64)  # a row an entry
    books = np.ascontiguousarray(least.reshape(len(least), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):

        def work(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            k = books.shape[1]
            sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
            for _, x in slices(batches, size):
                for p in range(parts):
                    _, _, s, c, _ = filtered(KdTree(x[:, p * width : (p + 1) * width]), books[p])
                    sums[p] += s
                    counts[p] += c
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        found = rows.select("units").mapInArrow(work, "part long, entry long, n long, sums array<long>")
        # 38 digits hold the sum of any number of rows
        total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row an entry
            books[r.part, r.entry] = [int(r[f"s{d}"]) // r.n for d in range(width)]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each row, by the nearest entry of every part."""
    parts, _, width = books.shape
    size = parts * width
    digits = np.array([f"{i:02x}" for i in range(256)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x in slices(batches, size):
            own, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                own[:, p], apart, _, _, _ = filtered(KdTree(x[:, p * width : (p + 1) * width]), books[p])
                error += apart
            code = ["".join(r) for r in digits[own].tolist()]
            yield from pa.table({"vec_id": table.column("vec_id"), "label": table.column("label"), "code": pa.array(code, pa.string()), "error": pa.array(error)}).to_batches()

    return rows.mapInArrow(work, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the error summed over the rows of the same label, nulls together."""
    totals = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return told(coded, totals, "label", ["label_error"])


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row."""
    kept, size = units(vectors)
    if not size:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = train(kept, size)
    coded = materialize(encode(kept, books), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(width: int = 4) -> str:
    """The same over vectors of 16 parts of `width` components; entries compete as distance * 64 + number."""
    c = [f"c{d}" for d in range(width)]
    apart = " + ".join(f"(q.{x} - b.{x}) * (q.{x} - b.{x})" for x in c)
    near = f"SELECT q.i, q.p, min(({apart}) * 64 + b.e) AS m FROM parts q JOIN {{book}} b ON q.p = b.p GROUP BY q.i, q.p"
    mean = ", ".join(f"coalesce(CAST(floor(n.{x}) AS BIGINT), b.{x}) AS {x}" for x in c)
    sums = ", ".join(f"CAST(sum(q.{x}) AS DOUBLE) / count(*) AS {x}" for x in c)
    step = f"SELECT b.p, b.e, {mean} FROM {{book}} b LEFT JOIN (SELECT q.p, a.m % 64 AS e, {sums} FROM parts q JOIN {{own}} a ON q.i = a.i AND q.p = a.p GROUP BY 1, 2) n ON b.p = n.p AND b.e = n.e"
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT i, p, {", ".join(f"v[p * {width} + {d + 1}] AS {x}" for d, x in enumerate(c))} FROM kept, range(16) t(p)),
book0 AS (SELECT p, i - 1 AS e, {", ".join(c)} FROM parts WHERE i <= 64),
own0 AS ({near.format(book="book0")}), book1 AS ({step.format(book="book0", own="own0")}),
own1 AS ({near.format(book="book1")}), book2 AS ({step.format(book="book1", own="own1")}),
own2 AS ({near.format(book="book2")}),
coded AS (SELECT i, string_agg(lower(printf('%02x', m % 64)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM own2 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(concat_ws(',', {", ".join(c)}), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (i)
"""


SQL = _sql()
