"""Operator 3: near-duplicate classes by order MinHash, verified by banded alignment.

1. A text is its words (white space cut, lower case) and their runs of five, each labelled
   with its number of earlier occurrences. For each of BANDS hash functions the KEPT
   least labelled runs, put back in text order, are hashed to one value: texts with much
   the same runs in the same order share values, texts with the same runs in another order
   don't.
2. Equal texts are one node. Nodes that share a band's value form a bucket. First each node
   is compared with one node, the hashed center of its most crowded bucket, which links most
   of a large class at one alignment a member. Then every pair of a bucket's members that aren't in one class
   yet is held against an exact bound: texts carry the parities of their labelled runs in
   PARITIES cells, which differ in no more cells than the runs do. The pairs within the bound
   are aligned, nearest first and more a member in each round, until all of them are
   compared or linked; none is left out, whatever a bucket's size. A crowded bucket is cut
   into blocks of members, and each pair of blocks is a group of its own.
3. A pair is compared by aligning its runs: the longest common subsequence within the band
   of diagonals that a similarity of SIMILAR allows. Similarity is common / (a + b - common).
4. Classes are the connected components of the links, by least label and pointer jumping.

Texts under five words have no run: only equal ones are duplicates. Null texts count as
empty ones. Rows without an id take part under the least id. Rows with one id and different
texts are different nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import arrow_slices, byte_values, materialize, mix, prefix_sums, range_hash, rolling, text_bytes, texts, words_of

RUN = 5
BANDS = 20
KEPT = 3
SIMILAR = 0.8
#: Cells of parities a text.
PARITIES = 1024
#: Nearest members that a member is aligned with in the first round, and by how much they grow.
NEAREST, MORE = 3, 16
#: A run that a text has more often than this is looked up as a mask.
OFTEN = 64
#: Members of a bucket's block.
BLOCK = 2_000
NO_ID = -(1 << 63)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def runs_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's five-word runs, unlabelled, in order."""
    low = _LOWER[data]
    start, end, first = words_of(low, offsets)
    hashes = rolling(prefix_sums(range_hash(prefix_sums(byte_values(low)), start, end)), RUN)
    return [hashes[a : max(a, b - RUN + 1)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def labelled(runs: np.ndarray) -> np.ndarray:
    """Runs told apart by how often they occurred before."""
    order = np.argsort(runs, kind="stable")
    new = np.concatenate([[True], runs[order][1:] != runs[order][:-1]]) if len(runs) else np.zeros(0, bool)
    if new.all():
        return runs
    at = np.arange(len(runs))
    nth = np.empty(len(runs), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(runs + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), runs)


def parities(own: np.ndarray) -> bytes:
    """Parities of how many labelled runs fall in each cell."""
    cells = (mix(own ^ _SEEDS[-1]) % np.uint64(PARITIES)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=PARITIES) & 1).tobytes()


def sketch(runs: np.ndarray, bands: int = BANDS, kept: int = KEPT) -> np.ndarray:
    """One value a band: the hash of the least labelled runs in text order."""
    own = labelled(runs)
    out = []
    step = max(1, (1 << 20) // len(own))
    for at in range(0, bands, step):
        h = mix(own[None, :] ^ _SEEDS[at : min(bands, at + step), None])
        least = np.sort(np.argpartition(h, kept - 1, axis=1)[:, :kept], axis=1) if len(own) > kept else np.broadcast_to(np.arange(len(own)), h.shape)
        value = _SEEDS[at : at + len(h)].copy()
        with np.errstate(over="ignore"):
            for j in range(least.shape[1]):
                value = mix(value * np.uint64(31) + own[least[:, j]])
        out.append(value)
    return np.concatenate(out)


def in_band(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Longest common subsequence of x and y that matches i to j only where |i - j| <= band.

    A row of bits holds the places of x from j - band to j + band, one that is 0 having been
    matched; it moves on by a place with each j, so memory follows the band.
    """
    places: dict[int, list[int]] = {}
    for i, v in enumerate(x.tolist()):
        places.setdefault(v, []).append(i)
    masks = {v: sum(1 << i for i in at) for v, at in places.items() if len(at) > OFTEN}
    width = 2 * band + 1
    full = (1 << width) - 1
    row, common = full, 0
    for j, v in enumerate(y.tolist()):
        if j:
            common += 1 - (row & 1)
            row = row >> 1 | 1 << width - 1
        at = places.get(v)
        if not at:
            continue
        low = j - band
        if v in masks:
            hit = (masks[v] >> low if low >= 0 else masks[v] << -low) & full
        else:
            hit = 0
            for i in at:
                if 0 <= i - low < width:
                    hit |= 1 << i - low
        if hit:
            row = ((row + (row & hit)) | (row & ~hit)) & full
    return common + width - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> float:
    """common / (a + b - common) of the best alignment of two rows of runs, or 0 if under `similar`.

    An alignment that reaches `similar` leaves at most (1 - similar) / similar of the
    shorter row out, so it stays on that many diagonals around the equal prefix; the longest
    common subsequence in this band is found bit-parallel, one row of bits a step.
    """
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n < similar * m:
        return 0.0
    same = a == b[:n]
    head = n if same.all() else int(np.argmin(same))
    rest = min(n, m) - head
    tail = 0
    if rest:
        same = a[n - rest :][::-1] == b[m - rest :][::-1]
        tail = rest if same.all() else int(np.argmin(same))
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if len(x) and common + len(np.intersect1d(labelled(x), labelled(y))) >= similar * (n + m) / (1 + similar):
        common += in_band(x, y, int((1 - similar) / similar * n) + 1)
    score = common / (n + m - common)
    return score if score >= similar else 0.0


def sketches(docs: DataFrame, bands: int = BANDS, kept: int = KEPT) -> DataFrame:
    """key, bands: array<long>, n (runs) and parities of each text with runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches):
            own = [labelled(r) if len(r) else r for r in runs_of(*text_bytes(part.column("text")))]
            n = np.array([len(r) for r in own], np.int32)
            rows = [(sketch(r, bands, kept).view(np.int64), parities(r)) for r in own if len(r)]
            cols = [part.column("key").filter(pa.array(n > 0)), pa.array([x for x, _ in rows], pa.list_(pa.int64())), pa.array(n[n > 0]), pa.array([x for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "bands", "n", "parities"])

    return keyed(docs).select("key", "text").mapInArrow(work, "key long, bands array<long>, n int, parities binary")


def keyed(docs: DataFrame) -> DataFrame:
    """key (a checksum of the text), doc_id, text."""
    return texts(docs).select(F.xxhash64("text").alias("key"), "doc_id", "text")


def verified(pairs: DataFrame, rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose texts align to `similar` or more. Both sides meet the rows (key, text) by a join."""
    near = pairs.join(rows.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(rows.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_slices(batches, "text_b"):
            one, two = runs_of(*text_bytes(part.column("text_a"))), runs_of(*text_bytes(part.column("text_b")))
            yield part.select(["a", "b"]).filter(pa.array([aligned(x, y, similar) > 0 for x, y in zip(one, two, strict=True)]))

    return near.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, class): least key of each connected component; labels (key, class) are what is known so far.

    Every round lowers each class's label to the least among its neighbours' and follows
    labels of labels, so paths shrink fast; each round ends in a written table.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    while True:
        told = edges.join(labels, edges["b"] == labels["key"]).groupBy("a").agg(F.min("class").alias("least"))
        lower = labels.join(told, labels["key"] == told["a"], "left").select("key", F.col("class").alias("old"), F.least("class", F.coalesce("least", "class")).alias("class"))
        # the class's own label may have fallen too, as seen by any of its members
        fall = lower.groupBy("old").agg(F.min("class").alias("new"))
        after = materialize(lower.join(fall, "old").select("key", "old", F.least("class", "new").alias("class")), "labels")
        moved = after.filter("class <> old").limit(1).count()
        labels = after.select("key", "class")
        if not moved:
            return labels


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the center, chosen by hash, of its most crowded bucket; each node once."""
    first = F.min(F.struct(F.xxhash64("bucket", "key").alias("order"), "key"))
    centers = members.groupBy("bucket").agg(first.alias("c"), F.count("*").alias("n")).select("bucket", F.col("c.key").alias("center"), "n")
    own = members.join(centers, "bucket").groupBy("key").agg(F.max(F.struct("n", "bucket", "center")).alias("top"))
    return own.select("key", F.col("top.center").alias("center")).filter("key <> center").select(F.least("key", "center").alias("a"), F.greatest("key", "center").alias("b")).distinct()


def _nearest(members: DataFrame, labels: DataFrame, profiles: DataFrame, number: int, similar: float) -> DataFrame:
    """Distinct pairs (a, b) of different classes that the bound lets pass: for each member the `number` nearest in each block of each bucket.

    `more` says whether a member had more than these. Members of a bucket's largest class don't
    ask: all others do.
    """
    most = (1 - similar) / (1 + similar)

    def compared(keys, classes, n, cells, asking, asked) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, 250_000 // max(1, len(asked)))
        for at in range(0, len(asking), step):
            rows = asking[at : at + step]
            apart = np.zeros((len(rows), len(asked)), np.int32)
            for k in range(cells.shape[1]):
                apart += np.bitwise_count(cells[rows, k, None] ^ cells[None, asked, k])
            x, y = n[rows, None], n[None, asked]
            fits = (classes[rows, None] != classes[None, asked]) & (np.minimum(x, y) >= similar * np.maximum(x, y)) & (apart <= most * (x + y) + 1e-6)
            r, c = np.nonzero(fits)
            if not len(r):
                continue
            by = np.lexsort((keys[asked[c]], apart[r, c], r))
            r, c = r[by], c[by]
            few = np.arange(len(r)) - np.searchsorted(r, r) < number
            left = (np.bincount(r, minlength=len(rows)) > number)[r[few]]
            yield keys[rows[r[few]]], keys[asked[c[few]]], left

    def group(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        where = (col("bucket"), col("row"), col("column"))
        order = np.lexsort(where[::-1])
        where = [x[order] for x in where]
        keys, classes, n, asks = (col(c)[order] for c in ("key", "class", "n", "asks"))
        cells = np.frombuffer(b"".join(table.column("parities").to_pylist()), np.uint64).reshape(-1, PARITIES // 64)[order]
        change = np.zeros(max(0, len(keys) - 1), bool)
        for x in where:
            change |= x[1:] != x[:-1]
        edge = np.flatnonzero(np.concatenate([[True], change, [True]]))
        out = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            asking = lo + np.flatnonzero(asks[lo:hi])
            # members of the block itself are asked too; in a pair of two blocks only those that came to be asked
            asked = np.arange(lo, hi) if where[1][lo] == where[2][lo] else lo + np.flatnonzero(~asks[lo:hi])
            out += compared(keys, classes, n, cells, asking, asked)
        one, two, left = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.table({"a": np.minimum(one, two), "b": np.maximum(one, two), "more": left})

    now = members.select("bucket", "key").join(labels, "key")
    sizes = now.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("lead"), F.sum("n").alias("total"), F.count("*").alias("classes")).filter("classes > 1")
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    now = now.join(mixed.select("bucket", F.col("lead.class").alias("lead"), blocks.alias("blocks")), "bucket").join(profiles, "key")
    own, asks = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.col("class") != F.col("lead")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.filter(every, lambda x: x != F.col("own"))
    place = lambda row, column, asks: F.struct(row.alias("row"), column.alias("column"), asks.alias("asks"))
    home = F.array(place(F.col("own"), F.col("own"), asks))
    asked = F.transform(others, lambda x: place(x, F.col("own"), F.lit(False)))
    asking = F.when(asks, F.transform(others, lambda x: place(F.col("own"), x, F.lit(True)))).otherwise(F.array().cast("array<struct<row:int,column:int,asks:boolean>>"))
    now = now.withColumn("own", own).withColumn("at", F.explode(F.concat(home, asked, asking)))
    groups = 8 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = now.select(F.pmod(F.xxhash64("bucket", "at.row", "at.column"), F.lit(groups)).alias("group"), "bucket", "at.row", "at.column", "key", "class", "n", "parities", "at.asks")
    return dealt.groupBy("group").applyInArrow(group, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def text_classes(docs: DataFrame, bands: int = BANDS, kept: int = KEPT, similar: float = SIMILAR) -> DataFrame:
    """key, class of each distinct text (see `keyed`): equal classes are near duplicates, linked directly or by others."""
    drawn = materialize(sketches(docs, bands, kept), "sketches").dropDuplicates(["key"])
    rows = drawn.select("key", F.posexplode("bands").alias("band", "value")).select("key", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = rows.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = materialize(rows.join(shared, "bucket"), "buckets")
    # only texts that share a bucket are ever compared
    nodes = members.select("key").distinct()
    profiles = materialize(drawn.select("key", "n", "parities").join(nodes, "key"), "profiles")
    candidates = materialize(keyed(docs).select("key", "text").join(nodes, "key", "left_semi").dropDuplicates(["key"]), "candidates")
    labels = materialize(nodes.select("key", F.col("key").alias("class")), "labels")

    def linked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        links = materialize(verified(pairs, candidates, similar), "links")
        return components(links, labels) if links.limit(1).count() else labels

    done = materialize(_stars(members), "stars")
    labels = linked(done, labels)
    number = NEAREST
    while True:
        near = materialize(_nearest(members, labels, profiles, number, similar), "near")
        pairs = near.select("a", "b")
        labels = linked(pairs.join(done, ["a", "b"], "left_anti"), labels)
        if not near.filter("more").limit(1).count():
            return labels
        done = materialize(done.union(pairs).distinct(), "compared")
        number *= MORE


def row_classes(docs: DataFrame, bands: int = BANDS, kept: int = KEPT, similar: float = SIMILAR) -> DataFrame:
    """key (a checksum of the text), doc_id, class of each row."""
    rows = keyed(docs).select("key", "doc_id").join(text_classes(docs, bands, kept, similar), "key", "left")
    return materialize(rows.select("key", "doc_id", F.coalesce("class", "key").alias("class")), "classes")


def near_duplicate_classes(docs: DataFrame, bands: int = BANDS, kept: int = KEPT, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id of each row: the least id among its near duplicates, linked directly or by others."""
    ids = row_classes(docs, bands, kept, similar)
    least = ids.groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID).cast("long"))).alias("least"))
    return ids.join(least, "class").select("doc_id", F.when(F.col("least") == NO_ID, None).otherwise(F.col("least")).alias("class_id"))
