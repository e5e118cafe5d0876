"""Finding what repeats across documents, by content-chosen anchors and bucketed keys.

Every stretch of a given length holds an anchor chosen by its content alone (the least
k-gram hash of the stretch), so whatever repeats has anchors that repeat. Keys (hashes of
anchors or windows) travel as packed arrays in rows of one bucket, a bucket being a part
of the hashes, and what is found travels back by shelf, a part of the documents. A task sums
up its own keys first, so however often a key occurs, each task sends it once.

One bucket or shelf is in a worker's memory at a time. Their numbers grow with the bytes
of text (see `Layout`), not only with the partitions, so what a worker holds is bounded
whatever the number of partitions. A shelf sends a row to each bucket it has keys for, so
small tables don't get more of either than their bytes are worth. A document's shelf depends on its id and its text, so
the rows that share an id, or have none, are spread like all others.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import arrow_slices, sliding, text_bytes, texts

#: Keys that a task gathers before it sends them.
FLUSH = 400_000
#: A place is tag << TAG | start; the tag, a checksum of 32 bits of the text, tells rows with one id apart.
TAG = 31
START = (1 << TAG) - 1
TAGS = (1 << 32) - 1
SENT = "bucket int, known boolean, keys binary, docs binary, places binary, counts binary"
FOUND = "shelf int, docs binary, places binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])
#: Rows without an id come before all others, under keys of 62 bits of their text's hash; ids are over -2**62.
NO_ID, NO_ID_BITS = -(1 << 63), (1 << 62) - 1


#: Bytes of text that a shelf has at most, on average; keys of a bucket take about half of that.
SHELF_BYTES = 32 << 20
#: Bytes of text that a bucket is worth having for.
LEAST_BYTES = 1 << 20
#: Shelves a bucket: several a partition even out their sizes.
SHELVES_A_BUCKET = 4


@dataclasses.dataclass(frozen=True)
class Layout:
    """How many buckets of keys and shelves of documents there are."""

    buckets: int
    shelves: int

    @classmethod
    def of(cls, docs: DataFrame) -> Layout:
        """From the bytes of all texts (one aggregate that no row leaves the scan for): one a partition, within the bounds in bytes."""
        size = texts(docs).agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        worth = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES))
        buckets = max(1, worth, -(-size // SHELF_BYTES))
        return cls(buckets, SHELVES_A_BUCKET * buckets)


def shelf_of(doc: int, tag: int, shelves: int) -> int:
    """The shelf of a document, by its id and the checksum of its text."""
    return (zlib.crc32(b"%d" % doc) + 31 * tag) % shelves


def shelved(docs: DataFrame, layout: Layout, carry: Column | None = None) -> DataFrame:
    """(shelf, key, doc_id, text) dealt by shelf; the key is the id, and for null ids one of the least, by the text's hash. `carry`: a column that stays with its row.

    The exchange is the same wherever this is used, so Spark runs it once for all passes.
    """
    rows = texts(docs, carry).withColumn("key", F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(NO_ID_BITS).cast("long")) + F.lit(NO_ID).cast("long")))
    tag = F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(TAGS).cast("long"))
    shelf = ((F.crc32(F.col("key").cast("string").cast("binary")) + 31 * tag) % layout.shelves).cast("int")
    return rows.select(shelf.alias("shelf"), "key", "doc_id", "text", *(["carry"] if carry is not None else [])).repartition("shelf")


class Slice:
    """Some rows: their bytes, offsets, keys and places without a start."""

    def __init__(self, part: pa.RecordBatch) -> None:
        self.part = part
        self.data, self.offsets = text_bytes(part.column("text"))
        self.keys = part.column("key").to_numpy()
        raw = self.data.tobytes()
        o = self.offsets.tolist()
        self.tags = np.array([zlib.crc32(raw[a:b]) & TAGS for a, b in zip(o[:-1], o[1:], strict=True)], np.int64) << TAG
        self.raw = raw

    def __len__(self) -> int:
        return self.part.num_rows


class Places:
    """Places found for the documents of a shelf, and the hot keys; width: how many numbers a place takes."""

    def __init__(self, table: pa.Table, width: int = 1) -> None:
        whole = pc.equal(pc.binary_length(table.column("docs")), 0)
        self.hot = np.unique(np.frombuffer(b"".join(table.filter(whole).column("places").to_pylist()), np.uint64))
        table = table.filter(pc.invert(whole))
        cat = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64)
        docs, places = cat("docs"), cat("places").reshape(-1, width)
        order = np.argsort(docs, kind="stable")
        self.docs, self.places = docs[order], places[order]

    def of(self, rows: Slice, i: int) -> np.ndarray:
        a, b = np.searchsorted(self.docs, rows.keys[i], "left"), np.searchsorted(self.docs, rows.keys[i], "right")
        got = self.places[a:b]
        got = got[(got[:, 0] >> TAG) == rows.tags[i] >> TAG].copy()
        got[:, 0] &= START
        return got


def joined_runs(docs: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, length) of the runs that stretches of `width` at these places cover; those that touch are one run."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (places[1:] - places[:-1] > width))[: len(docs)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs))[: len(first)] - 1
    return docs[first], places[first], places[last] - places[first] + width


class Sender:
    """Gathers (key, doc, place) and packs them into rows by bucket.

    With `width` keys are those of stretches so long, and places that are settled here go as
    runs, with their lengths as counts.
    """

    def __init__(self, buckets: int, later: bool, width: int | None = None) -> None:
        self.buckets, self.later, self.width = buckets, later, width
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.held.append((keys, docs, places))
        self.n += len(keys)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, docs, places = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        order = np.lexsort((places, docs, keys))
        keys, docs, places = keys[order], docs[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        if self.later:
            known = np.ones(len(keys), bool)
            known[first] = False
        else:
            known = np.repeat(counts > 1, counts)
        rows: list[tuple] = []
        if known.any():
            d, p, w = docs[known], places[known], np.zeros(0, np.int32)
            if self.width is not None:
                d, p, w = joined_runs(d, p, self.width)
                w = w.astype(np.int32)
            # what is settled here passes through any bucket; places differ from task to task, where the least keys may be the same in all
            turn = zlib.crc32(p.tobytes(), zlib.crc32(d.tobytes()))
            for i, at in enumerate(range(0, len(d), 50_000)):
                rows.append(((turn + i) % self.buckets, True, b"", d[at : at + 50_000].tobytes(), p[at : at + 50_000].tobytes(), w[at : at + 50_000].tobytes()))
        keys, docs, places = keys[first], docs[first], places[first].copy()
        if not self.later:
            places[counts > 1] = -1
        bucket = ((keys >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(at)):
            i = order[at[b] : at[b + 1]]
            rows.append((int(b), False, keys[i].tobytes(), docs[i].tobytes(), places[i].tobytes(), counts[i].astype(np.int32).tobytes()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SENT_SCHEMA, strict=True)], schema=SENT_SCHEMA)


def sender(make: Callable, buckets: int) -> Callable:
    """A mapInArrow function that sends what make(slice) gives: (key, doc, place) arrays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(buckets, False)
        for part in arrow_slices(batches):
            yield from out.add(*make(Slice(part)))
        yield from out.flush()

    return work


def shelf_slices(table: pa.Table) -> Iterator[Slice]:
    for part in arrow_slices(iter(table.combine_chunks().to_batches())):
        yield Slice(part)


def on_shelves(docs: np.ndarray, places: np.ndarray, shelves: int) -> pa.Table:
    """Places packed by the shelf of their document; places may be rows of several numbers."""
    tags = (places if places.ndim == 1 else places[:, 0]) >> TAG
    pairs, back = np.unique(np.stack([docs, tags], axis=1), axis=0, return_inverse=True)
    shelf = np.array([shelf_of(d, t, shelves) for d, t in pairs.tolist()], np.int64)[back.ravel()] if len(docs) else np.zeros(0, np.int64)
    order = np.argsort(shelf, kind="stable")
    docs, places, shelf = docs[order], places[order], shelf[order]
    first = np.flatnonzero(np.concatenate([[True], shelf[1:] != shelf[:-1]])) if len(docs) else np.zeros(0, np.int64)
    cut = list(zip(first.tolist(), np.append(first[1:], len(docs)).tolist(), strict=False))
    return pa.table({"shelf": pa.array(shelf[first], pa.int32()), "docs": pa.array([docs[a:b].tobytes() for a, b in cut], pa.binary()), "places": pa.array([places[a:b].tobytes() for a, b in cut], pa.binary())})


def settle(sent: DataFrame, shelves: int, later: bool, hot: int | None = None) -> DataFrame:
    """The places whose key occurs more than once (later: those that aren't the key's first place), by shelf.

    With `hot`, keys that occur more often than that go to every shelf, in a row without
    documents, so that all places of a key are taken alike whichever way they came.
    """

    def group(table: pa.Table) -> pa.Table:
        known = table.column("known").to_numpy()
        cat = lambda c, keep, kind: np.frombuffer(b"".join(x for x, k in zip(table.column(c).to_pylist(), keep, strict=True) if k), kind)
        keys, docs, places = cat("keys", ~known, np.uint64), cat("docs", ~known, np.int64), cat("places", ~known, np.int64)
        counts = cat("counts", ~known, np.int32)
        crowded = np.zeros(0, np.uint64)
        order = np.lexsort((places, docs, keys)) if later else np.argsort(keys, kind="stable")
        keys, docs, places, counts = keys[order], docs[order], places[order], counts[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if later:
            keep = ~new
        else:
            total = np.add.reduceat(counts.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            if hot is not None:
                crowded = keys[first][total > hot]
            total = np.repeat(total, np.diff(np.append(first, len(keys))))
            keep = (total > 1) & (places >= 0)
        found = on_shelves(np.concatenate([docs[keep], cat("docs", known, np.int64)]), np.concatenate([places[keep], cat("places", known, np.int64)]), shelves)
        if not len(crowded):
            return found
        told = {"shelf": pa.array(range(shelves), pa.int32()), "docs": pa.array([b""] * shelves, pa.binary()), "places": pa.array([crowded.tobytes()] * shelves, pa.binary())}
        return pa.concat_tables([found, pa.table(told)])

    return sent.groupBy("bucket").applyInArrow(group, FOUND)


def with_found(rows: DataFrame, found: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], kind: str) -> DataFrame:
    """work(rows of a shelf, places found for them) for each shelf."""
    return rows.groupBy("shelf").cogroup(found.groupBy("shelf")).applyInArrow(work, kind)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n units that a run starts[i] .. starts[i]+width covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def least_of(hashes: np.ndarray, chosen: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes: whether its least hash is at a chosen position."""
    shown = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    shown[chosen] = hashes[chosen]
    low = sliding(hashes, width, np.minimum)
    return sliding(shown, width, np.minimum) == low

