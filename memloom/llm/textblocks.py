"""Vectorised word access over Arrow string columns, and a packed shuffle.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Whole Arrow batches are cut into
blocks of bounded bytes, and every word of a block gets a 64-bit hash without a Python object a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.session import input_bytes, spread

BLOCK_BYTES = 2 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_B = 0x9E3779B97F4A7C15 | 1
_B_INV = pow(_B, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64's finalizer."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(256, dtype=np.uint64), 7)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            have = np.multiply.accumulate(step)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def running_hash(buf: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[buf] * _powers(_B, len(buf)), out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end) of the bytes behind a running hash; equal byte strings get equal values wherever they stand."""
    with np.errstate(over="ignore"):
        raw = (total[end] - total[start]) * _powers(_B_INV, len(total))[start]
        return mix(raw + (end - start).astype(np.uint64))


def running_sequence(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A running hash of a sequence of 64-bit values, for `span_hash` over stretches of it."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(values, salt) * _powers(_B, len(values)), out=total[1:])
    return total


def utf8_column(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.large_binary()
    col = col.cast(pa.large_string()).cast(big) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.cast(big)
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to `limit` bytes together, and up to `rows` rows; one longer text is a block of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1), i + (rows or n))
        yield i, j
        i = j


class Block:
    """Words of rows i..j of a text column: start, end (in buf), row of each, and the first word of each row."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = False, breaks: np.ndarray = SPACE):
        self.rows = j - i
        self.buf = buf[off[i] : off[j]]
        if lower:
            self.buf = LOWER[self.buf]
        self.off = off[i : j + 1] - off[i]
        gap = breaks[self.buf]
        n = len(gap)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.off] = True
        before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
        self.start = np.flatnonzero(~gap & (before | edge[:n]))
        self.end = np.flatnonzero(~gap & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)  # rows + 1
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return self.prefix_hashes(None)[0]

    def prefix_hashes(self, *lengths: int | None) -> list[np.ndarray]:
        """Hashes of the words' first so many bytes; None: of whole words."""
        total = running_hash(self.buf)
        return [span_hash(total, self.start, self.end if n is None else np.minimum(self.end, self.start + n)) for n in lengths]


def word_blocks(column, lower: bool = False, breaks: np.ndarray = SPACE, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """(first row, Block) over a whole text column."""
    buf, off = utf8_column(column)
    for i, j in blocks(off, limit):
        yield i, Block(buf, off, i, j, lower, breaks)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only what an operator reads, under its own names, so that other columns can't clash."""
    return spread(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def parallelism(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets_for(spark) -> int:
    """A bucket a shuffle partition; `exchange` sees to it that no two share one."""
    return parallelism(spark)


def buckets_of(rows: DataFrame, each: int) -> int:
    """So many buckets that `each` bytes of input fall into one; a bucket a shuffle partition where the input's size isn't known."""
    size = input_bytes(rows)
    return parallelism(rows.sparkSession) if size is None else max(1, -(-size // each))


def give_back() -> None:
    """Returns freed memory to the system, so that reused workers don't keep a past task's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def exchange(packed: DataFrame, key: str = "bucket", n: int | None = None) -> DataFrame:
    """Rows of a bucket (the key modulo n, by default the number of shuffle partitions) meet in one task, and every task has one bucket."""
    n = n or buckets_for(packed.sparkSession)
    return packed.repartitionById(n, F.pmod(F.col(key), F.lit(n)).cast("int"))


def pack(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One blob a non-empty bucket: the row count and each column's rows one after the other, in their given order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(cut)):
        i, j = cut[b], cut[b + 1]
        yield int(b), np.int64(j - i).tobytes() + b"".join(np.ascontiguousarray(c[i:j]).tobytes() for c in columns)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in map(np.dtype, types):
        out.append(np.frombuffer(blob, t, n, at))
        at += n * t.itemsize
    return out


def packed_batches(pairs: Iterator[tuple[int, bytes]], key: str = "bucket", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches (key int, data binary) of bounded bytes."""
    schema = pa.schema([(key, pa.int32()), ("data", pa.binary())])
    keys, data, size = [], [], 0
    for b, blob in pairs:
        keys.append(b)
        data.append(blob)
        size += len(blob)
        if size >= limit:
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], schema=schema)
            keys, data, size = [], [], 0
    if keys:
        yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(data, pa.binary())], schema=schema)


def unpack_all(batches, *types) -> list[np.ndarray]:
    """All rows of a task's blobs, column by column."""
    got: list[list[np.ndarray]] = [[] for _ in types]
    for batch in batches:
        for blob in batch.column(batch.schema.get_field_index("data")).to_pylist():
            for have, col in zip(got, unpack(blob, *types), strict=True):
                have.append(col)
    return [np.concatenate(have) if have else np.zeros(0, t) for have, t in zip(got, types, strict=True)]


def hot_keys(keyed: DataFrame, least: int, column: str = "keys", local: int = 64) -> np.ndarray:
    """Keys of packed lists (64-bit, in a binary column) that would fill a task: at least `least` rows, and an eighth of a task's share of all.

    A task names the keys that it has `local` times or more, so one that goes unnamed has fewer rows than that a task.
    Sums are lower bounds of the true counts, so there are at most eight a shuffle partition.
    """

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64) for b in batches]
        keys, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        own = n >= local
        yield pa.record_batch([pa.array([*keys[own].tolist(), None], pa.int64()), pa.array([*n[own].tolist(), int(n.sum())], pa.int64())], names=["key", "n"])

    named = keyed.select(column).mapInArrow(often, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("key").isNull(), F.col("n")))
    border = max(least, -(-(named.agg(total).first()[0] or 0) // (8 * parallelism(keyed.sparkSession))))
    return np.array(sorted(r["key"] for r in named.where(F.col("key").isNotNull() & (F.col("n") >= border)).select("key").collect()), np.int64)


def deal(keys: np.ndarray, ids: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Buckets by key; of hot keys by id as well, so that all buckets share them."""
    name = keys.view(np.uint64)
    own = np.isin(keys, hot)
    return (np.where(own, mix(mix(name) ^ mix(ids.view(np.uint64), 1), 2), name) % np.uint64(n)).astype(np.int64)
