"""Shared pieces of the training-data operators: shared scratch space, whole-text reading, vectorised words.

Words everywhere mean maximal runs of bytes outside {0x20, 0x09-0x0D} of the UTF-8 text, which equal the
matches of ``[^\\x20\\x09-\\x0D]+`` on code points. All hashing is done on whole slabs of texts with numpy.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut, drop, scratch, shared_dir, ship, stored  # noqa: F401

#: Bytes of text that are processed together in a Python worker; a longer text is a slab of its own.
SLAB_BYTES = 1 << 19
#: Java regular expression of the separators between words.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch that an operator works on at a time, as rows hold whole texts.
BATCH_ROWS = 1024


def tidy(run):
    """A function for `mapInArrow` that works on small batches and gives memory back at the end of a task.

    Python workers live on between tasks; what the allocators keep would add up over the stages of a job.
    """

    def small(batches):
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    def tidied(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(small(batches))
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that nothing refers to any more.

    Spark removes them when the driver's garbage collector finds their handles, which a small driver heap delays.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """For the queries and the pipeline, not the operators: the JVM, too, sends small batches, unless a number was set."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a query."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_rest(col: str, modulus: int):
    """crc32 of the id as text, modulo; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus, F.lit(-1))


def text_print(text: str = "text"):
    """64 bits that tell a row's text, and null from the empty one."""
    return F.xxhash64(F.col(text).cast("binary"), F.col(text).isNull())


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; nulls are empty."""
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        wide, kind = np.int64, pa.large_binary()
    else:
        wide, kind = np.int32, pa.binary()
    if column.null_count:
        column = column.cast(kind).fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slabs(column: pa.Array, size: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `size` bytes; every row is in one."""
    data, offs = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[0x20, 9, 10, 11, 12, 13]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(0x15091EA7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 2 * SLAB_BYTES)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = _SPACE_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slab, and for each text the index of its first word (one entry more).

    separator: which byte values stand between words.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, independent of its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes unchanged."""
    return _LOWER[data]
