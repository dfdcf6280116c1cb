"""What the operators share: a shared work folder, Arrow text as bytes, hashing of bytes and words."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestream.session import shared_folder

#: Bytes of text that vectorised code takes at once; its arrays are some ten times that.
CHUNK = 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93


#: Bytes of an Arrow batch, where the session names no bound of its own; by default it is 64 MB, several times in each task.
BATCH = 1 << 23


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH, unless the session has set a bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors.

    Shuffle files behind the written rows are free to go once the JVM has collected
    its garbage, which is asked for here, so that steps don't add up on disk.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.option("compression", codec).parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[out] = folder
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of materialized frames of which all that was made is written by now."""
    for df in frames:
        if folder := _FOLDERS.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


try:  # glibc keeps what is freed
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after another, and offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if column.type == pa.binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.zeros(0, np.uint8) if buffer is None else np.frombuffer(buffer, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of text each; a longer text is a run of its own. Behind the last, free memory goes back to the system."""
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def sorted_tables(batches: Iterator[pa.RecordBatch], keys: list[str], most: int, split: bool = False) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by the keys in tables of about `most` bytes, or a key's rows where these are more: no key is in two tables.

    With `split` a key with more is in several, each with nothing else before it. True: the table begins with more rows of the last one's key.
    """
    held: list[pa.RecordBatch] = []
    size, goes_on = 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            values = table[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        if new.any():
            at = int(np.flatnonzero(new)[-1])
            yield table.slice(0, at).combine_chunks(), goes_on
            rest = table.slice(at).combine_chunks()
            held, size, goes_on = rest.to_batches(), rest.nbytes, False
        elif split:
            # Its last row stays, so that the next table tells by itself whether the key goes on.
            yield table.slice(0, table.num_rows - 1).combine_chunks(), goes_on
            rest = table.slice(table.num_rows - 1).combine_chunks()
            held, size, goes_on = rest.to_batches(), rest.nbytes, True
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), goes_on


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit word for each byte, and the same with A-Z as a-z.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * MIX)
LOWER_WORDS = BYTE_WORDS.copy()
LOWER_WORDS[65:91] = BYTE_WORDS[97:123]
#: Bytes that end words: space and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base & (2**64 - 1))
    return np.multiply.accumulate(out)[:n]


INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    """powers(), kept for sizes up to a chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = powers(base, max(n, CHUNK + 1))
        if n <= 2 * CHUNK:
            _POWERS[base] = have
    return have[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than space, A-Z as a-z), and where each row's begin.

    A word's hash is its polynomial over BASE, from differences of one prefix sum.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first = before.copy()
    first[edges] = False
    starts = np.flatnonzero(inside & ~first)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    after[cuts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(LOWER_WORDS[data] * cached_powers(BASE, n), out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * cached_powers(INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, row by row, and where each row's begin; fewer words than k make one shingle."""
    count = np.diff(bounds)
    shingles = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(shingles) + 1, np.int64)
    np.cumsum(shingles, out=out[1:])
    total = int(out[-1])
    if not total:
        return np.zeros(0, np.uint64), out
    row = np.repeat(np.arange(len(count)), shingles)
    at = np.arange(total) - out[row] + bounds[row]
    size = np.minimum(count, k)[row]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    acc = np.zeros(total, np.uint64)
    for i in range(k):
        acc = mix(acc * MIX + np.where(i < size, padded[at + i], np.uint64(i + 1)))
    return acc, out
