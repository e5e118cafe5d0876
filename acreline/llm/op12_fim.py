"""Operator 12: fill-in-middle transformation of documents cut at line boundaries.

A table-driven automaton reads the UTF-8 bytes of a slice of documents once. Its states are
the place in a line, the progress of a sentinel and how many continuation bytes are due;
each transition tells whether its byte begins a code point, begins a unit (a line with its
newline) or completes a sentinel. The scan counts the transitions of every document; a
second pass over what the scan told finds the bytes at which the drawn units begin.

The bytes are dealt into chunks of WIDTH that the automaton reads side by side from every
state it could be in; composing the chunks of a document then gives the state that each
truly began in. So a text of any length takes a slice's worth of memory and no step a byte.

The draw depends on `seed` and the document's id alone. Null texts are empty, empty ones and
those that hold a sentinel stay plain; a null id draws as an empty string. Repeated rows and
ids give a row each, equal rows equal ones. Other columns are left out, also such that clash
by letter case. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import arrow_slices, text_bytes, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred documents, those that are transformed, and of these the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50
#: Bytes of a chunk.
WIDTH = 256

#: States: at the start of a unit, within a line, after "<", after "<" and a letter of a sentinel, and with one to three continuation bytes due.
START, LINE, OPENED, LETTERED, DUE_1, DUE_2, DUE_3 = range(7)
STATES = 7
#: Classes of bytes; PAD is what stands after a text's last byte in its chunk.
NEWLINE, OPEN, LETTER, CLOSE, OTHER, MORE, LEAD_2, LEAD_3, LEAD_4, PAD = range(10)
CLASSES = 10
#: What a transition tells, as bits.
POINT, UNIT, SENTINEL = 1, 2, 4


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[ord("\n")], out[ord("<")], out[ord(">")] = NEWLINE, OPEN, CLOSE
    out[[ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)]] = LETTER
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = MORE, LEAD_2, LEAD_3, LEAD_4
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, told bits) of each transition, numbered state * CLASSES + class."""
    to, tells = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    plainly = {NEWLINE: START, OPEN: OPENED, LETTER: LINE, CLOSE: LINE, OTHER: LINE, MORE: LINE, LEAD_2: DUE_1, LEAD_3: DUE_2, LEAD_4: DUE_3}
    for state in range(STATES):
        for kind, after in plainly.items():
            to[state, kind] = after
            tells[state, kind] = POINT | (UNIT if state == START else 0)
        to[state, PAD] = state
    to[OPENED, LETTER] = LETTERED
    tells[LETTERED, CLOSE] |= SENTINEL
    for state, after in ((DUE_1, LINE), (DUE_2, DUE_1), (DUE_3, DUE_2)):
        to[state, MORE], tells[state, MORE] = after, 0
    return to.ravel(), tells.ravel()


CLASS_OF = _classes()
NEXT, TELLS = _tables()
_STEP = (NEXT.astype(np.int16) * CLASSES).astype(np.uint8)


class Scan:
    """One run of the automaton over documents that stand one after the other in `data`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        sizes = np.diff(offsets)
        chunks = -(-sizes // WIDTH)
        first = np.concatenate([[0], np.cumsum(chunks)])
        self.doc = np.repeat(np.arange(len(sizes)), chunks)
        self.start = offsets[self.doc] + (np.arange(first[-1]) - first[self.doc]) * WIDTH
        held = np.minimum(offsets[self.doc + 1] - self.start, WIDTH)
        at = np.arange(WIDTH)[:, None]
        kinds = np.where(at < held, CLASS_OF[data[np.minimum(self.start + at, max(len(data) - 1, 0))]] if len(data) else PAD, PAD).astype(np.uint8)
        told = self._told(kinds, first)
        self.told = told.T.ravel()  # chunk by chunk, in text order
        documents = range(len(sizes))
        count = lambda bit: np.bincount(self.doc, ((told & bit) > 0).sum(axis=0), len(documents)).astype(np.int64)
        self.points, self.units, self.sentinels = count(POINT), count(UNIT), count(SENTINEL)

    def _told(self, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(WIDTH, chunks) bits told by each byte's transition."""
        n = kinds.shape[1]
        at = np.broadcast_to((np.arange(STATES) * CLASSES).astype(np.uint8)[:, None], (STATES, n))
        taken = np.empty((WIDTH, STATES, n), np.uint8)
        for i in range(WIDTH):
            np.add(at, kinds[i], out=taken[i])
            at = _STEP[taken[i]]
        ends = (at // CLASSES).T.tolist()
        began = np.zeros(n, np.int64)
        heads = set(first[:-1].tolist())
        state = START
        for c in range(n):
            state = START if c in heads else state
            began[c] = state
            state = ends[c][state]
        return TELLS[taken[:, began, np.arange(n)]]

    def locate(self, unit: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points of the document before it) where the document's unit of this number begins; the end where it has no such unit."""
        starts = np.flatnonzero(self.told & UNIT)
        points = np.cumsum(self.told & POINT, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(self.units)])[:-1]
        points_before = np.concatenate([[0], np.cumsum(self.points)])[:-1]
        last = unit >= self.units
        if not len(starts):
            return ends.copy(), self.points.copy()
        spot = starts[np.minimum(before + unit, len(starts) - 1)]
        byte = self.start[spot // WIDTH] + spot % WIDTH
        return np.where(last, ends, byte), np.where(last, self.points, points[spot] - 1 - points_before)


def draw(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """The four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        for part in arrow_slices(batches):
            data, offsets = text_bytes(part.column("text"))
            scan = Scan(data, offsets)
            drawn = np.array([draw(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
            plainly = (scan.units == 0) | (scan.sentinels > 0) | (drawn[:, 2] % 100 >= rate)
            one, two = drawn[:, 0] % (scan.units + 1), drawn[:, 1] % (scan.units + 1)
            cut, chars = scan.locate(np.minimum(one, two), offsets[1:])
            cut_2, chars_2 = scan.locate(np.maximum(one, two), offsets[1:])
            forms, out = [], []
            raw = data.tobytes()
            for i, plain in enumerate(plainly.tolist()):
                begin, a, b, end = int(offsets[i]), int(cut[i]), int(cut_2[i]), int(offsets[i + 1])
                if plain:
                    forms.append("plain")
                    out.append(raw[begin:end])
                elif drawn[i, 3] % 100 < suffix_first:
                    forms.append("spm")
                    out.append(b"".join((s, raw[b:end], p, raw[begin:a], m, raw[a:b])))
                else:
                    forms.append("psm")
                    out.append(b"".join((p, raw[begin:a], s, raw[b:end], m, raw[a:b])))
            columns = [part.column("doc_id"), pa.array(scan.units), pa.array(forms, pa.string()), pa.array(chars, mask=plainly), pa.array(chars_2 - chars, mask=plainly), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return texts(docs).mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed document was made from; each sentinel stands in it once."""
    cut = lambda after, until=None: F.substring_index(output, after, -1) if until is None else F.substring_index(F.substring_index(output, after, -1), until, 1)
    psm = F.concat(cut(PREFIX, SUFFIX), cut(MIDDLE), cut(SUFFIX, MIDDLE))
    spm = F.concat(cut(PREFIX, MIDDLE), cut(MIDDLE), cut(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The transformed documents with digests of their output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out, form = F.col("output"), F.col("form")
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(out).alias("output_sha256"), sha(restored(out, form)).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
cuts AS (
  SELECT doc_id, text, units, len(units) AS n, least(CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1), CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1)) AS a,
    greatest(CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1), CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
spans AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:], ''), '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM spans
"""
