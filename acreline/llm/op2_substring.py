"""Operator 2: substring dedup over fixed-length token windows by Rabin-Karp hashes.

1. Anchors: the least hash of 8-word grams in every 13 neighbours. Each 20-word window
   holds one, so a window that repeats has an anchor that repeats; anchors are counted.
2. Every window that rests on a repeated anchor sends its 64-bit Rabin-Karp hash; per
   hash the first place (smallest document, then start) is kept, all others are repeats.
3. Per document, repeated windows merge into maximal intervals, and their words go.

The documents are dealt by id and text once and read by all three passes. Rows without an id count
as the smallest one; rows of one id stand in the order of a checksum of their texts, of
identical rows one is the first; null and short
texts (under a window) lose nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreline.llm.anchors import SENT, SENT_SCHEMA, START, Layout, Places, Sender, Slice, cover, least_of, sender, settle, shelf_slices, shelved, with_found
from acreline.llm.common import minimizers, prefix_sums, rolling, word_hashes

WINDOW = 20
GRAM = 8


def gather(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none


def _grams(rows: Slice, gram: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(prefix sums of word hashes, first word of each row, each row's own gram hashes)."""
    hashes, _, _, first = word_hashes(rows.data, rows.offsets)
    sums = prefix_sums(hashes)
    grams = rolling(sums, gram)
    return sums, first, [grams[a : max(a, b - gram + 1)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def anchors_of(window: int, gram: int):
    def make(rows: Slice):
        out = []
        for i, own in enumerate(_grams(rows, gram)[2]):
            at = minimizers(own, window - gram + 1)
            if len(at):
                out.append((own[at], np.full(len(at), rows.keys[i]), at + rows.tags[i]))
        return gather(out)

    return make


def windows_on(window: int, gram: int, buckets: int):
    """Of a shelf, the windows whose least gram is a repeated anchor; identical rows send theirs once."""

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        places, out, seen = Places(found), Sender(buckets, True), set()
        batches = []
        for rows in shelf_slices(docs):
            sums, first, grams = _grams(rows, gram)
            windows = rolling(sums, window)
            for i, own in enumerate(grams):
                row = (int(rows.keys[i]), int(rows.tags[i]))
                if row in seen:
                    continue
                seen.add(row)
                at = np.flatnonzero(least_of(own, places.of(rows, i)[:, 0] & START, window - gram + 1))
                if len(at):
                    batches += out.add(windows[first[i] + at], np.full(len(at), rows.keys[i]), at + rows.tags[i])
        batches += out.flush()
        return pa.Table.from_batches(batches, SENT_SCHEMA)

    return work


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with keep_text also the kept words and removed intervals."""
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<start:int,end:int>>" * keep_text

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        places, seen = Places(found), set()
        ids, total, gone, digest, kept, spans = [], [], [], [], [], []
        for rows in shelf_slices(docs):
            ids += rows.part.column("doc_id").to_pylist()
            for i, (a, b) in enumerate(zip(rows.offsets[:-1].tolist(), rows.offsets[1:].tolist(), strict=True)):
                words = rows.raw[a:b].split()
                n = len(words)
                row = (int(rows.keys[i]), int(rows.tags[i]))
                at = np.arange(n - window + 1) if row in seen else places.of(rows, i)[:, 0] & START
                seen.add(row)
                covered = cover(at, window, n) if len(at) else np.zeros(n, bool)
                if len(at):
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                joined = b" ".join(words)
                total.append(n)
                gone.append(n - len(words))
                digest.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept.append(joined.decode())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if keep_text:
            cols |= {"kept": pa.array(kept, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return pa.table(cols)

    layout = Layout.of(docs)
    rows = shelved(docs, layout)
    anchors = settle(rows.mapInArrow(sender(anchors_of(window, gram), layout.buckets), SENT), layout.shelves, False)
    windows = with_found(rows, anchors, windows_on(window, gram, layout.buckets), SENT)
    return with_found(rows, settle(windows, layout.shelves, True), work, kind)
