"""Operator 1: SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model has a whitespace marker after another character, so no merge
crosses from a word into the next marker: a text is a row of marked words (markers, then
characters up to the next marker) that are segmented alone. Each task keeps a table of
the distinct marked words it has met; a word is segmented and decoded once, and a text's
ids are the table's entries joined by position. The table is a cache of bounded size, so
a hot word costs one lookup and memory doesn't follow the vocabulary; nothing is
shuffled, and a lost executor costs its tasks alone.

Nulls count as empty texts; an empty text has the two outer ids only and decodes to "".
Rows pass through one by one, so repeated rows and ids give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from acreline.llm.common import arrow_slices, texts

MARK = "▁"
#: Entries kept by a task; beyond them the table starts anew.
TABLE_ENTRIES = 800_000
#: Longer words are not kept from one slice to the next.
LONGEST_KEPT = 64
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def check_model(sp) -> None:
    """Raise unless words can be segmented alone with this model."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i).lstrip(MARK)
        if MARK in piece:
            raise ValueError(f"piece {i} crosses a whitespace marker: {sp.id_to_piece(i)!r}")
    if sp.encode("a  b ") != sp.encode(f"a{MARK}{MARK}b{MARK}"):
        raise ValueError("the model normalises white space; its texts can't be cut at markers")


class ChunkTable:
    """Marked word -> its ids as little-endian 32-bit integers."""

    def __init__(self, sp) -> None:
        self.sp = sp
        self.mark = sp.piece_to_id(MARK)
        self.packed: dict[str, bytes] = {}
        self.lossy: dict[str, str] = {}

    def _segment(self, chunks: list[str]) -> None:
        """Segment these marked words; note the decoded form of those that don't decode to themselves."""
        words = [c[1:] for c in chunks]
        ids = [x or [self.mark] for x in self.sp.encode(words, num_threads=1)]
        decoded = self.sp.decode(ids, num_threads=1)
        for chunk, word, x, text in zip(chunks, words, ids, decoded, strict=True):
            self.packed[chunk] = array("I", x).tobytes()
            if text != word and text != word.replace(MARK, " "):
                self.lossy[chunk] = " " + text

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids without the outer two, decoded text) of each text."""
        if len(self.packed) > TABLE_ENTRIES:
            self.packed.clear()
            self.lossy.clear()
        rows = [_MARKED.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {c for row in rows for c in row if c not in self.packed}
        if new:
            self._segment(list(new))
        out = []
        for text, row in zip(texts, rows, strict=True):
            if self.lossy:
                decoded = "".join([self.lossy[c] if c in self.lossy else c.replace(MARK, " ") for c in row])[1:]
            else:
                decoded = text.replace(MARK, " ")
            out.append((b"".join([self.packed[c] for c in row]), decoded))
        for c in new:
            if len(c) > LONGEST_KEPT:
                del self.packed[c]
                self.lossy.pop(c, None)
        return out


@functools.cache
def table_of(model: str) -> ChunkTable:
    """One table for all tasks that a Python worker runs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    check_model(sp)
    return ChunkTable(sp)


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with keep_ids also ids and decoded."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        kind += ", ids array<int>, decoded string"
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        sp = table.sp
        first, last = sp.bos_id().to_bytes(4, "little"), sp.eos_id().to_bytes(4, "little")
        for part in arrow_slices(batches):
            rows = []
            for packed, decoded in table.encode(part.column("text").to_pylist()):
                packed = first + packed + last
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, np.frombuffer(packed, "<i4"), decoded) if keep_ids else row)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, f.type) for x, f in zip(zip(*rows), list(schema)[1:], strict=True)]], schema=schema)

    return texts(docs).mapInArrow(work, kind)
