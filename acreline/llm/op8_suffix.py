"""Operator 8: exact repeats of 200 bytes by two-stage suffix sorting.

1. Anchors (the least 40-byte gram of every 161 neighbours) that occur once can't lie in a
   repeat; what rests on repeated ones is cut into segments, each the run of windows whose
   least gram is one hash. Equal windows thus lie in segments of one hash.
2. Segments meet by that hash, each task sending a text once however often it has it. In a
   block, the starts of windows are sorted in two stages: those smaller than their
   successors directly, the rest induced from them by scanning the buckets of first bytes
   in order. Neighbours whose common prefix reaches 200 bytes are repeats, and so are all
   windows of a segment that stands at two places.
3. An anchor that occurs more than HOT_ANCHOR times would fill a block with its contexts;
   its windows are counted by their hash instead (each task sending a hash once, and what
   repeats within the task as runs), which needs no group to be together. Such anchors are
   told to every shelf, so all windows of one go the same way. Nothing is capped on either way.

Removed is each byte that a repeated window covers, judged on the input. Null texts are
empty; texts under 200 bytes lose nothing; a row without an id counts as the least id.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from acreline.llm.anchors import FOUND, SENT, SENT_SCHEMA, Layout, Places, Sender, Slice, joined_runs, on_shelves, sender, settle, shelf_slices, shelved, with_found
from acreline.llm.common import byte_values, minimizers, prefix_sums, rolling, sliding
from acreline.llm.op2_substring import gather

WIDTH = 200
GRAM = 40
HOT_ANCHOR = 1_000
#: Window starts that one suffix sort takes, unless one anchor has more.
BLOCK = 200_000
MOVED = SENT + ", lengths binary, texts binary"
_PAIR = pa.schema([*SENT_SCHEMA, ("lengths", pa.binary()), ("texts", pa.binary())])


def two_stage_sort(text: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """`starts` (ascending) in the order of the suffixes there, equal for the first `width` bytes or more.

    Suffixes smaller than their successors are sorted directly by their first `width`
    bytes. The rest follow from them: scanning in order, the suffix one byte before a
    scanned one takes the next place in the bucket of its own first byte.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(1, np.uint8), np.full(width + 8, 255, np.uint8)])
    step = np.sign(padded[1 : n + 2].astype(np.int16) - padded[: n + 1])
    # a run of equal bytes goes the way of the byte that ends it
    kind = np.int32 if n < 1 << 31 else np.int64
    at = np.where(step != 0, np.arange(n + 1, dtype=kind), kind(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = step[at] > 0
    del step, at
    wanted = np.zeros(n + 1, bool)
    wanted[starts] = True
    # whatever is induced needs its successor, up to one that is sorted directly
    needed = wanted.copy()
    edge = np.flatnonzero(wanted[:-1] & ~wanted[1:] & ~smaller[:-1]) + 1
    while len(edge):
        needed[edge] = True
        edge = edge[~smaller[edge]] + 1
        edge = edge[~needed[edge]]
    direct = np.flatnonzero(needed & smaller)
    raw = padded.tobytes()
    direct = direct[np.argsort(padded[direct], kind="stable")]
    bounds = np.searchsorted(padded[direct], np.arange(257))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        # a first byte at a time, so only its keys are held
        keys = [raw[p : p + width] for p in direct[a:b].tolist()]
        direct[a:b] = direct[a:b][np.array(sorted(range(b - a), key=keys.__getitem__), np.int64)]
    del raw
    induced = needed & ~smaller
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []

    def deal(scanned: np.ndarray, byte: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[induced[before]]
        first = padded[before]
        for b in np.unique(first).tolist():
            if b != byte:
                heads[b].append(before[first == b])
        return before[first == byte]

    for byte in range(256):
        scanned = np.concatenate(heads[byte]) if heads[byte] else np.zeros(0, np.int64)
        while len(scanned):
            order.append(scanned)
            scanned = deal(scanned, byte)
        scanned = direct[bounds[byte] : bounds[byte + 1]]
        if len(scanned):
            order.append(scanned)
            deal(scanned, byte)
        heads[byte] = []
    out = np.concatenate(order) if order else np.zeros(0, np.int64)
    return out[wanted[out]]


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For neighbours in `order`: bytes they have in common, in eights, up to `width`."""
    padded = np.concatenate([text, np.zeros(width + 8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k in range(0, width, 8):
        same = eights[a[alive] + k] == eights[b[alive] + k]
        alive = alive[same]
        out[alive] = k + 8
    return out


def repeated_starts(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the starts of windows that stand at another place too, in it or in another."""
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    per = np.maximum(lengths - width + 1, 0)
    starts = np.repeat(base[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    order = two_stage_sort(data, starts, width)
    same = common_prefixes(data, order, width) >= width
    hit = np.zeros(len(data) + 1, bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(base[:-1].tolist(), per.tolist(), strict=True)]


def anchors_of(width: int, gram: int):
    def make(rows: Slice):
        grams = rolling(prefix_sums(byte_values(rows.data)), gram)
        out = []
        for i, (a, b) in enumerate(zip(rows.offsets[:-1].tolist(), rows.offsets[1:].tolist(), strict=True)):
            own = grams[a : max(a, b - gram + 1)]
            at = minimizers(own, width - gram + 1)
            if len(at):
                out.append((own[at], np.full(len(at), rows.keys[i]), at + rows.tags[i]))
        return gather(out)

    return make


def _segment_rows(held: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct segment texts with all their places, in rows by bucket."""
    by: dict[int, list] = {}
    for (key, text), places in held.items():
        by.setdefault((key >> 32) % buckets, []).append((key, text, places))
    cols: list[list] = [[] for _ in range(8)]
    for bucket, items in by.items():
        flat = np.array([p for _, _, places in items for p in places], np.int64)
        row = (bucket, False, np.array([k for k, _, _ in items], np.uint64).tobytes(), flat[:, 0].tobytes(), flat[:, 1].tobytes(), np.array([len(p) for _, _, p in items], np.int32).tobytes(), np.array([len(t) for _, t, _ in items], np.int64).tobytes(), b"".join([t for _, t, _ in items]))
        for c, x in zip(cols, row, strict=True):
            c.append(x)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PAIR, strict=True)], schema=_PAIR)


def windows_on(width: int, gram: int, buckets: int):
    """Of a shelf, what rests on repeated anchors: segments, and for hot anchors window hashes."""

    def wide(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(batch.num_rows, pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, none, none], schema=_PAIR)

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        places, hashes, held, batches = Places(found), Sender(buckets, False, width), {}, []
        top = np.iinfo(np.uint64).max
        for rows in shelf_slices(docs):
            sums = prefix_sums(byte_values(rows.data))
            grams, windows = rolling(sums, gram), rolling(sums, width)
            for i, (base, end) in enumerate(zip(rows.offsets[:-1].tolist(), rows.offsets[1:].tolist(), strict=True)):
                got = places.of(rows, i)[:, 0]
                if not len(got):
                    continue
                own = grams[base : max(base, end - gram + 1)]
                at, doc, tag = got, int(rows.keys[i]), int(rows.tags[i])
                low = sliding(own, width - gram + 1, np.minimum)
                shown = np.full(len(own), top, np.uint64)
                shown[at] = own[at]
                repeated = sliding(shown, width - gram + 1, np.minimum) == low
                hot = np.intersect1d(own[at], places.hot) if len(places.hot) else places.hot
                if len(hot):
                    is_hot = repeated & np.isin(low, hot)
                    at = np.flatnonzero(is_hot)
                    batches += map(wide, hashes.add(windows[base + at], np.full(len(at), doc, np.int64), at + tag))
                    repeated &= ~is_hot
                at = np.flatnonzero(repeated)
                if not len(at):
                    continue
                cut = np.flatnonzero((np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]])) + 1
                for a, b in zip(at[np.append(0, cut)].tolist(), at[np.append(cut - 1, len(at) - 1)].tolist(), strict=True):
                    held.setdefault((int(low[a]), rows.raw[base + a : base + b + width]), []).append((doc, a + tag))
        batches += map(wide, hashes.flush())
        if held:
            batches += _segment_rows(held, buckets)
        return pa.Table.from_batches(batches, _PAIR)

    return work


def segment_runs(keys: np.ndarray, counts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, places: np.ndarray, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, bytes) of what is repeated in segments, whose texts stand in `data` and whose places (`counts` each) in `docs` and `places`.

    Equal segments have one key, so a block of whole keys needs nothing of other blocks.
    """
    begin, own = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.append(keys[order][1:] != keys[order][:-1], True)) + 1 if len(keys) else np.zeros(0, np.int64)
    size = np.concatenate([[0], np.cumsum(lengths[order] - width + 1)])
    out_d, out_p, out_w = array("q"), array("q"), array("q")
    i = 0
    while i < len(order):
        # the least number of whole keys that has BLOCK window starts
        j = int(ends[min(int(np.searchsorted(size[ends], size[i] + BLOCK)), len(ends) - 1)])
        where: dict[bytes, list[int]] = {}
        for k in order[i:j].tolist():
            where.setdefault(data[begin[k] : begin[k + 1]], []).append(k)
        for (text, same), hit in zip(where.items(), repeated_starts(list(where), width), strict=True):
            at = [x for k in same for x in zip(docs[own[k] : own[k + 1]].tolist(), places[own[k] : own[k + 1]].tolist(), strict=True)]
            if len(at) > 1:
                runs = [(0, len(text))]
            elif len(hit):
                cut = np.flatnonzero(np.diff(hit) > width) + 1
                runs = [(a, b + width - a) for a, b in zip(hit[np.append(0, cut)].tolist(), hit[np.append(cut - 1, len(hit) - 1)].tolist(), strict=True)]
            else:
                continue
            for d, p in at:
                for a, w in runs:
                    out_d.append(d)
                    out_p.append(p + a)
                    out_w.append(w)
        i = j
    return np.array(out_d, np.int64), np.array(out_p, np.int64), np.array(out_w, np.int64)


def settle_windows(moved: DataFrame, shelves: int, width: int) -> DataFrame:
    """(place, bytes) pairs of int64 by shelf: the runs of bytes that repeated windows cover."""

    def group(table: pa.Table) -> pa.Table:
        # texts, most of a bucket, are copied once, into one buffer; Python objects are made of a block at a time
        texts = pc.is_valid(table.column("texts")).to_pylist()
        known = table.column("known").to_pylist()
        raw = lambda c, some: b"".join([x.as_py() for x, s in zip(table.column(c), some, strict=True) if s])
        cat = lambda c, some, kind: np.frombuffer(raw(c, some), kind)
        # hot anchors: windows by their hash
        settled, asked = [k and not t for k, t in zip(known, texts, strict=True)], [not k and not t for k, t in zip(known, texts, strict=True)]
        keys, at, counts = cat("keys", asked, np.uint64), cat("places", asked, np.int64), cat("counts", asked, np.int32)
        _, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, weights=counts) if len(keys) else np.zeros(0)
        keep = (total[back] > 1) & (at >= 0) if len(keys) else np.zeros(0, bool)
        asked_runs = joined_runs(cat("docs", asked, np.int64)[keep], at[keep], width)
        settled_runs = cat("docs", settled, np.int64), cat("places", settled, np.int64), cat("counts", settled, np.int32)
        # segments: by suffix arrays over whole anchors
        found = segment_runs(cat("keys", texts, np.uint64), cat("counts", texts, np.int32), cat("lengths", texts, np.int64), cat("docs", texts, np.int64), cat("places", texts, np.int64), raw("texts", texts), width)
        docs, places, widths = (np.concatenate(x) for x in zip(asked_runs, settled_runs, found, strict=True))
        return on_shelves(docs, np.stack([places, widths], axis=1), shelves)

    return moved.groupBy("bucket").applyInArrow(group, FOUND)


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT_ANCHOR, keep_text: bool = False, carry: Column | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with keep_text also `kept`, with `carry` that column as `carry`.

    `kept` is text: a character of which a byte was repeated goes as a whole. Other columns of
    `docs` play no part, whatever their names.
    """
    layout = Layout.of(docs)
    rows = shelved(docs, layout, carry)
    kind = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)
    if carry is not None:
        kind.add("carry", rows.schema["carry"].dataType)

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        places = Places(found, 2)
        ids, out, kept = [], [], []
        for rows in shelf_slices(docs):
            ids += rows.part.column("doc_id").to_pylist()
            for i, (a, b) in enumerate(zip(rows.offsets[:-1].tolist(), rows.offsets[1:].tolist(), strict=True)):
                own, runs = rows.data[a:b], places.of(rows, i)
                edge = np.zeros(len(own) + 1, np.int32)
                np.add.at(edge, runs[:, 0], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((len(own), int(gone.sum()), spans, hashlib.sha256(own[~gone]).hexdigest()))
                if keep_text:
                    char = np.cumsum((own & 0xC0) != 0x80) - 1
                    left = own[~(np.bincount(char, weights=gone) > 0)[char]] if len(runs) else own
                    kept.append(left.tobytes().decode())
        cols = list(zip(*out, strict=True)) or [()] * 4
        table = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept_sha256": pa.array(cols[3], pa.string())}
        table |= {"kept": pa.array(kept, pa.string())} if keep_text else {}
        # slices keep the order of the shelf's rows
        return pa.table(table | ({"carry": docs.column("carry")} if carries else {}))

    carries = carry is not None
    anchors = settle(rows.mapInArrow(sender(anchors_of(width, gram), layout.buckets), SENT), layout.shelves, False, hot)
    moved = with_found(rows, anchors, windows_on(width, gram, layout.buckets), MOVED)
    return with_found(rows, settle_windows(moved, layout.shelves, width), work, kind)
