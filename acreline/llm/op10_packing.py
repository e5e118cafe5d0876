"""Operator 10: best-fit packing with large-item matching.

Tokenizing is a cached lookup of whitespace-free words inside tasks. Packing works on
lengths alone: there are at most `capacity` of them, so their histogram is bounded
whatever the corpus, and a plan over (length, count) is exact for all documents:

1. pieces of full length fill a sequence alone;
2. large pieces (over a third of the capacity) go at most two to a sequence: taken from
   the longest, each is matched with the longest large piece that still fits;
3. smaller pieces, from the longest, go where they leave the least gap, and open a new
   sequence only if no gap takes them.

Equal sequences are handled as one group with a count, so the plan takes time by distinct
groups, not by documents. A group is a list of slots (length, first rank, offset); the
piece that is r-th of its length takes the slot that holds rank r. Full pieces have no rank:
each is a sequence, numbered where it is read. Other ranks are counted within (length, salt),
a length having a salt for every SALTED of its pieces, and shifted by the salts before, so a
task ranks about that many pieces however many a length has. The driver sees the histogram
of lengths only.

Null texts count as empty ones (a piece with the closing id alone); repeated rows and ids are
packed as often as they come; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import string
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import arrow_slices, materialize, texts

CAPACITY = 2048
#: Words of a generation of a worker's table.
TABLE_ENTRIES = 400_000
LONGEST_KEPT = 64
#: Pieces of a length that one task ranks, about.
SALTED = 20_000
#: Words of letters that are tokenized as one text.
TOGETHER = 256
#: Signs at a word's end that are tokens apart from its letters; apostrophes and what marks special tokens aren't among them.
SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Signs that an end has at most; there are under 25,000 such ends.
LONGEST_END = 3


def check_tokenizer(tokenizer) -> None:
    """Raise unless a text's ids are those of its words, in lower case, the signs at a word's end being a word of their own."""
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    for a, b in (("Stone", "Wall."), ("x1", "'s"), ("é", "日本,")):
        for blank in (" ", "\t", "\n\r", " \f\v "):
            if ids(f"{blank}{a}{blank}{b}{blank}") != ids(a) + ids(b):
                raise ValueError("the tokenizer's ids depend on white space")
    letters = "".join(map(chr, range(65, 91)))
    for word in (*letters, letters, "Tree"):
        for end in ("", "***", "?!.", *map(chr, SIGNS)):
            if ids(word + end) != ids(word.lower()) + (ids(end) if end else []):
                raise ValueError("the tokenizer tells letter case or joins a word and the signs behind it")


def check_plain(tokenizer, plain) -> None:
    """Raise unless words of small ASCII letters have the same ids in `plain`."""
    letters = string.ascii_lowercase
    text = " ".join([letters, letters[::-1], *letters, *map("".join, itertools.product(letters, letters)), "tree tokenization internationally"])
    if plain.encode(text, add_special_tokens=False).ids != tokenizer.encode(text, add_special_tokens=False).ids or any(t.content.isalpha() for t in tokenizer.get_added_tokens_decoder().values()):
        raise ValueError("the tokenizer changes or marks words of small letters")


def parts_of(word: bytes) -> tuple[int, bytes, bool]:
    """(where the end begins, the stem that is tokenized for what is before, whether that is one word of letters)."""
    if word.isalpha():  # ASCII letters only
        return len(word), word.lower(), True
    core = word.rstrip(SIGNS)
    if core and len(word) - len(core) <= LONGEST_END:
        if core.isalpha():
            return len(core), core.lower(), True
        # letters still, once the tokenizer has composed them and made them small
        if not core.isascii() and unicodedata.normalize("NFC", core.decode()).lower().isalpha():
            return len(core), core, True
    return len(word), word, False


class WordTable:
    """Word (UTF-8) -> its ids as little-endian 32-bit integers.

    The tokenizer drops white space and none of its tokens crosses it, so a text's ids are
    those of its words in turn. It lower-cases, and ends a token between a letter and a
    sign, so words of ASCII letters share an entry whatever their case and end, and words of other
    letters whatever their end. What holds other characters is looked up as it stands, and so is
    the case of other letters: letter case and composition may join those.

    Of words and of their stems there are two generations: a full one becomes the older, whose entries move
    on when they are met again, so what is frequent is never tokenized twice.
    """

    def __init__(self, tokenizer) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        check_tokenizer(tokenizer)
        self.tokenizer = tokenizer
        # small ASCII letters are left as they are before the model sees them, so these words need no such steps
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        check_plain(tokenizer, self.plain)
        self.packed: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}
        self.ends: dict[bytes, bytes] = {b"": b""}
        vocab = tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _letters(self, words: list[bytes], tokenizer) -> Iterator[bytes]:
        """Ids of words of letters: many to a text, whose ids are cut after each token that closes a word."""
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for group, found in zip(groups, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cut = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(cut) != len(group):
                yield from self._ids(group)
                continue
            raw = ids.tobytes()
            yield from map(raw.__getitem__, map(slice, [0, *cut[:-1].tolist()], cut.tolist()))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        parts = list(map(parts_of, new))
        stems, older = self.stems, self.older[1]
        small, letters, others = set(), set(), set()
        for _, stem, plain in parts:
            if stem not in stems:
                if stem in older:
                    stems[stem] = older[stem]
                else:
                    (others if not plain else small if stem.isascii() else letters).add(stem)
        for some, ids in ((list(small), self._letters(list(small), self.plain)), (list(letters), self._letters(list(letters), self.tokenizer)), (list(others), self._ids(list(others)))):
            stems.update(zip(some, ids, strict=True))
        ends = list({w[n:] for w, (n, _, _) in zip(new, parts, strict=True)} - self.ends.keys())
        self.ends.update(zip(ends, self._ids(ends), strict=True))
        for w, (n, stem, _) in zip(new, parts, strict=True):
            self.packed[w] = stems[stem] + self.ends[w[n:]] if n < len(w) else stems[stem]
        for stem in small | letters | others:
            if len(stem) > LONGEST_KEPT:
                del stems[stem]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.packed) > TABLE_ENTRIES:
            self.older = self.packed, self.stems
            self.packed, self.stems = {}, {}
        # bytes.split cuts at ASCII white space; any other stays inside words and is the tokenizer's matter
        rows = [t.split() for t in texts]
        # not a difference of sets: that would go through the whole table
        new = list(itertools.filterfalse(self.packed.__contains__, set().union(*rows)))
        older = self.older[0]
        if older:
            met = {w: older[w] for w in new if w in older}
            self.packed.update(met)
            new = [w for w in new if w not in met]
        if new:
            self._learn(new)
        known = self.packed.__getitem__
        out = [b"".join(map(known, row)) for row in rows]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del self.packed[w]
        return out


@functools.cache
def table_of(tokenizer: str) -> WordTable:
    """One table for all tasks that a Python worker runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return WordTable(Tokenizer.from_file(tokenizer))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and `end`, cut into pieces of at most `capacity`."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(tokenizer)
        last = end.to_bytes(4, "little")
        step = 4 * capacity
        for part in arrow_slices(batches):
            rows = []
            raw = part.column("text").cast(pa.binary()).to_pylist()
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), table.encode(raw), strict=True):
                packed += last
                for i, at in enumerate(range(0, len(packed), step)):
                    ids = packed[at : at + step]
                    rows.append((doc_id, i, at // 4, len(ids) // 4, zlib.crc32(ids)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(work, kind)


def plan_groups(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, how many such sequences)] for pieces counted by length."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    open_: dict[int, Counter] = defaultdict(Counter)  # gap -> sequences as tuples of lengths
    done: list[tuple[tuple[int, ...], int]] = []

    def put(lengths: tuple[int, ...], number: int) -> None:
        gap = capacity - sum(lengths)
        if gap:
            if gap not in open_ or not open_[gap]:
                bisect.insort(gaps, gap)
            open_[gap][lengths] += number
        else:
            done.append((lengths, number))

    gaps: list[int] = []
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] - (m == n) > 0), None)
            if mate is None:
                number, lengths = left[n], (n,)
            elif mate == n:
                number, lengths = left[n] // 2, (n, n)
            else:
                number, lengths = min(left[n], left[mate]), (n, mate)
            for x in lengths:
                left[x] -= number
            put(lengths, number)
    for n in small:
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if left[n] >= per:
                    number, lengths = left[n] // per, (n,) * per
                else:
                    number, lengths = 1, (n,) * left[n]
                left[n] -= number * len(lengths)
                put(lengths, number)
                continue
            gap = gaps[at]
            lengths, there = next(iter(open_[gap].items()))
            copies = min(gap // n, left[n])
            # a sequence with this gap takes as many as fit: the gap that is left is the least for the next one
            number = min(there, left[n] // copies)
            if number == there:
                del open_[gap][lengths]
            else:
                open_[gap][lengths] -= number
            if not open_[gap]:
                gaps.pop(at)
            left[n] -= number * copies
            put(lengths + (n,) * copies, number)
    for held in open_.values():
        done += held.items()
    return [(lengths, number) for lengths, number in done if number]


def slots_of(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank of each slot, its first sequence, its offset), ascending by rank."""
    taken: Counter = Counter()
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, number in groups:
        offset = 0
        for n in lengths:
            slots[n].append((taken[n], sequence, offset))
            taken[n] += number
            offset += n
        sequence += number
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in slots.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, salted: int = SALTED) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    `pieces` is read several times, so give it written out. Nothing is lost or cut.
    """
    spark = pieces.sparkSession
    by_length = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    names = [x.split()[0] for x in PACKED.split(", ")]
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    # numbers below zero: full pieces have the others
    slots = slots_of(plan_groups({n: c for n, c in by_length.items() if n < capacity}, capacity))
    salts = spark.createDataFrame([(n, -(-c // salted)) for n, c in by_length.items()], "length long, salts long")
    rest = pieces.filter(F.col("length") < capacity).join(F.broadcast(salts), "length")  # a row a length
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    base = rest.groupBy("length", "salt").count().select("length", "salt", before.alias("base"))
    ranked = rest.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "salt"]).select(*names[:5], (F.col("nth") + F.col("base")).alias("rank"))
    shared = spark.sparkContext.broadcast(slots)  # bounded by the plan's groups

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, seq, off = slots[n]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = -1 - (seq[k] + rank[at] - first[k]), off[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:5]], pa.array(sequence), pa.array(offset)], names=names)

    return full.select(*names).union(ranked.mapInArrow(place, PACKED))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize every text (null: empty), cut what is over the capacity, and pack all pieces."""
    return pack(materialize(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
