"""What the text operators share: shared-folder tables, Arrow slicing, hashing of words and bytes.

Workers see a text column as one byte buffer with offsets, so hashing is a few numpy
passes over the buffer rather than a Python loop over words. Slices are bounded in
bytes, so a worker's memory follows SLICE_BYTES (or the longest single text), never the
partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: A key with over one of so many rows is hot.
HOT_SHARE = 1_000
#: Bytes of an Arrow batch on its way to a worker; Spark's own bound is sixteen times as much, twice per task while a batch is built.
BATCH_BYTES = 4 << 20
#: A column that no table has.
CARRIED = "__carried_with_its_row"
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir. Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = sc.getCheckpointDir()
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files any executor can read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns, whatever others there are (also such that clash by letter case)."""
    keep = [names.index(c) if c in names else -1 for c in df.columns]
    seen: set[int] = set()
    marks = []
    for i, k in enumerate(keep):
        marks.append(f"__keep_{k}" if k >= 0 and k not in seen else f"__drop_{i}")
        seen.add(k)
    out = df.toDF(*marks)
    return out.select(*[F.col(f"__keep_{k}").alias(n) for k, n in enumerate(names)])


def told(rows: DataFrame, totals: DataFrame, key: str, names: list[str]) -> DataFrame:
    """rows with the columns `names` of their key's row in `totals` (key, names, n rows), nulls being equal; totals is read more than once.

    Keys with over a thousandth of all rows are under a thousand, so theirs are broadcast;
    the others meet by a shuffle in which no key has more than that share.
    """
    n = totals.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > n // HOT_SHARE
    few = totals.filter(is_hot).select(F.col(key).alias("__hot"), F.lit(True).alias("__met"), *[F.col(c).alias(f"__hot_{c}") for c in names])
    rest = totals.filter(~is_hot).select(F.col(key).alias("__key"), *names)
    met = rows.join(F.broadcast(few), F.col(key).eqNullSafe(F.col("__hot")), "left")
    first = met.filter("__met").select(*rows.columns, *[F.col(f"__hot_{c}").alias(c) for c in names])
    second = met.filter("__met is null").select(*rows.columns).join(rest, F.col(key).eqNullSafe(F.col("__key"))).select(*rows.columns, *names)
    return first.unionByName(second)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches be cut by bytes, since texts differ in length by orders of magnitude. A smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def texts(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """(doc_id, text) of each row: null texts as empty, other columns left out; with `carry` that column as `carry`."""
    bound_batches(docs.sparkSession)
    rows = plain(docs, ["doc_id", "text"]) if carry is None else plain(docs.withColumn(CARRIED, carry), ["doc_id", "text", CARRIED])
    some = [F.col(CARRIED).alias("carry")] if carry is not None else []
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *some)


def arrow_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of `column` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n+1 offsets) of a string or binary column without nulls; nothing is copied."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    bufs = array.buffers()
    n, kind = len(array), np.int64 if wide else np.int32
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(bufs[1], kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    held = _powers.get(inverse)
    if held is None or len(held) < n:
        size = max(1 << max(n - 1, 1).bit_length(), 1 << 12)
        with np.errstate(over="ignore"):
            steps = np.full(size, _INVERSE if inverse else _ODD, dtype=np.uint64)
            steps[0] = 1
            held = np.multiply.accumulate(steps)
        _powers[inverse] = held
    return held[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums of 64-bit values: n+1 sums of value[i] * base**i modulo 2**64."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of each range start..end, equal for equal contents wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ranges of this width."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix((sums[width:] - sums[:n]) * powers(len(sums), inverse=True)[:n])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document) of the runs of non-space bytes; none crosses an offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end, first word of each document)."""
    start, end, first = words_of(data, offsets)
    return range_hash(prefix_sums(byte_values(data)), start, end), start, end, first


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each run of `width` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return best(out[:n], out[rest : rest + n])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some run of `width` hashes; all of a tie.

    Every run holds one, whatever stands around it, so two equal stretches choose the
    same positions. With fewer hashes than `width` nothing is chosen.
    """
    low = sliding(hashes, width, np.minimum)
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, hashes.dtype)
    high = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    return np.flatnonzero(high == hashes)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
