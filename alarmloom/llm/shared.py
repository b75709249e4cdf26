"""Helpers of the text operators: documents with a row key, word hashes, packed rows."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from alarmloom.shipping import ship_by_value

ship_by_value()

# Bytes of text that a Python task looks at together; longer texts make a block of their own.
BLOCK_BYTES = 2 << 20
# Bytes of an Arrow batch where memory is short: the JVM and the Python worker hold up to two or three each.
BATCH_BYTES = 4 << 20
# Bytes of text whose packed pieces meet in one bucket.
BUCKET_BYTES = 8 << 20
# Distinct words whose hashes a Python task remembers.
MEMO_WORDS = 400_000
SPACE = b" \t\n\r\x0b\x0c"
# A missing doc_id counts as larger than any other.
NO_ID = (1 << 63) - 1

ODD = np.uint64(0x9E3779B97F4A7C15)
# Masks of the first bytes of eight, by their number.
EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def keyed(docs: DataFrame) -> DataFrame:
    """Columns doc_id, id (never null), key (64-bit hash of the text) and text as UTF-8 bytes.

    A missing text is an empty one. Rows with the same id and text are the same
    document; rows with the same id and different texts are not.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("bigint").alias("id"),
        F.xxhash64(text).alias("key"),
        text.cast("binary").alias("text"),
    )


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


def bucket_count(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets that hold about bucket_bytes of the input each; never fewer than shuffle partitions."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, math.ceil(text_bytes(docs) / bucket_bytes))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in the column, one row at least."""
    for batch in batches:
        lengths = [len(x) if x is not None else 0 for x in _buffers(batch.column(column))]
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets Arrow batches of about BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(work: Callable) -> Callable:
    """work, after which the Python worker gives back what it no longer holds; an idle one stays for the stages after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def _buffers(array: pa.Array) -> Iterator:
    for x in array:
        yield x.as_buffer() if x.is_valid else None


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Vocabulary(dict):
    """Numbers of words in order of appearance, and their 64-bit hashes."""

    def __init__(self):
        self.words: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; hashes is then up to date."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        fresh = self.words[len(self.hashes) :]
        if fresh:
            more = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), np.uint64, len(fresh))
            self.hashes = np.concatenate((self.hashes, more))
        return numbers

    def of_places(self, raw: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of the words at places of a buffer.

        Words of up to eight bytes are told apart as numbers, and each that occurs is looked up once.
        """
        out = np.empty(len(start), np.int32)
        short = length <= 8
        if b"\0" in raw:
            short[:] = False
        at = np.flatnonzero(short)
        if len(at):
            eight = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
            keys, back = np.unique(eight[start[at]] & EIGHT[length[at]], return_inverse=True)
            out[at] = self.of(keys.view("S8").tolist())[back]
        at = np.flatnonzero(~short)
        out[at] = self.of([raw[low:high] for low, high in zip(start[at].tolist(), (start + length)[at].tolist())])
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (salt * 0x9E3779B97F4A7C15 + size) & (1 << 64) - 1, np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + n]
        out ^= out >> np.uint64(32)
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, from running minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    top = np.iinfo(values.dtype).max
    padded = np.full(-(-len(values) // width) * width, top, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """One compressed string of several arrays."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack(data: bytes, *kinds) -> list:
    """The arrays of pack(); kinds are dtypes, or None for bytes."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    lengths = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(lengths, kinds):
        out.append(raw[at : at + n] if kind is None else np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def packed_sizes(data: bytes, n: int) -> np.ndarray:
    """Bytes of each of the n arrays of pack(), of which only the head is unpacked."""
    return np.frombuffer(zstandard.ZstdDecompressor().stream_reader(data).read(8 * n), np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the indexes of its members in order."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    ranked = buckets[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    for part in np.split(order, cuts):
        yield int(buckets[part[0]]), part


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the half-open ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def referenced(docs: DataFrame) -> DataFrame:
    """Columns doc_id, id (never null), ref (names the row) and text as UTF-8 bytes.

    ref is the id where ids are unique, and else a 64-bit hash of id and text: rows that
    repeat both share it and get the same result.
    """
    rows = keyed(docs)
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null or doc_id is null and count > 1")
    ref = F.col("id") if twice.isEmpty() else F.xxhash64("id", "key")
    return rows.select("doc_id", "id", ref.alias("ref"), "text")


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress well."""
    return np.diff(values, prepend=values.dtype.type(0))


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with the column ranges: all packed ranges that were found for their ref."""
    held = ranges.groupBy("ref").agg(F.collect_list("ranges").alias("ranges"))
    return rows.join(held, "ref", "left")


def read_ranges(packed: list[bytes] | None) -> np.ndarray:
    """Rows (start, end) of the packed ranges of one text."""
    return np.frombuffer(b"".join(packed or []), np.int64).reshape(-1, 2)


RANGES_SQL = "ref bigint, ranges binary"
BUCKETS_SQL = "bucket bigint, packed binary"
BUCKETS = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])


def range_rows(ref: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One row per ref with its ranges packed."""
    pairs = np.stack([start, end], axis=1).astype(np.int64)
    refs, rows = [], []
    order = np.argsort(ref, kind="stable")
    cuts = np.flatnonzero(np.diff(ref[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        refs.append(int(ref[part[0]]))
        rows.append(pairs[part].tobytes())
    return refs, rows
