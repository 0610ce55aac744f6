"""What the operators share: rows with safe names, bounded batches, word hashes."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.session import scratch_path

#: Text that one step of a Python worker holds as separate objects.
CHUNK_BYTES = 2 * 2**20
#: Bytes of the keys of a memo.
MEMO_BYTES = 16 * 2**20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe against lost executors.

    Its schema is known, so that no job has to find it in the files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_uid(df: DataFrame, **columns) -> DataFrame:
    """``uid`` (one per row of the scan), ``row`` (the whole input row), and named expressions.

    Keeping the input as one struct lets extra columns have any name.
    """
    return df.select(
        F.monotonically_increasing_id().alias("uid"),
        F.struct("*").alias("row"),
        *[value.alias(name) for name, value in columns.items()],
    )


def chunks(
    batch: pa.RecordBatch, column: str, field: str | None = None, most: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``most`` bytes of text, with the text as UTF-8; null is empty.

    The text is a column, or the ``field`` of a struct column.  A longer text is a slice of
    its own and is never cut.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if field is not None:
        texts = pc.struct_field(texts, field)
    texts = texts.cast(pa.binary())
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), [t or b"" for t in texts.slice(a, b - a).to_pylist()]


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Give freed memory back to the system: workers outlive the tasks that needed it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(function):
    """A function of batches that ends with ``release``."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


class Memo(dict):
    """Values of a function of the key, forgotten when there are too many, or too many bytes of keys."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most, self.held = function, most, 0

    def __missing__(self, key):
        if len(self) >= self.most or self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        self.held += len(key)
        value = self[key] = self.function(key)
        return value


@functools.cache
def _word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 150_000)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    return np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))


def bounds(counts) -> np.ndarray:
    """Starts of consecutive runs with these lengths, and the end of the last."""
    return np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of ``width`` words."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    base = (0x9E3779B97F4A7C15 + 2 * seed * 0xC2B2AE3D27D4EB4F) % 2**64 | 1
    size = 1 << max(10, (n + 1).bit_length())
    up, down = _powers(base, size), _powers(pow(base, -1, 2**64), size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: n - width + 1]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes with all bits depending on all bits."""
    x = hashes ^ (hashes >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
