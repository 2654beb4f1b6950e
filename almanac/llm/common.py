"""Shared helpers: tables in the shared folder, text buffers as numpy arrays, word hashes and count sketches."""

from __future__ import annotations

import ctypes
import functools
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clean, fresh, shared_dir, written  # noqa: F401  for the other modules

#: The white space of the word rule, bytes 0x20 and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: The same rule as a Java regular expression.
SPACE_RX = "[\\x20\\x09-\\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 & ~7 | 5
_P_INV = pow(_P, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# ---------------------------------------------------------------- storage


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts lineage and survives lost executors.

    The table stays until clean(), as results that are not yet computed may need it.
    ``rows`` is a bound on its rows where one is known: then no more tasks (and files) than one
    for each 200,000 of them.
    """
    spark = df.sparkSession
    if rows is not None and (tasks := rows // 200_000 + 1) < partitions(spark):
        df = df.coalesce(tasks)
    path = fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BLOCK = 32 << 20  # bytes of what one task holds at once


def blocks_of(spark: SparkSession, size: int | None) -> int:
    """Into how many blocks data of so many bytes are cut: as many as the session's partitions, or more where a block would be larger than BLOCK."""
    return max(partitions(spark), (size or 0) // BLOCK + 1)


def reserve(docs: DataFrame, *names: str) -> None:
    """Raises ValueError if docs has a column by a name that an operator needs for itself."""
    taken = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns can't be named {', '.join(sorted(taken))} here; rename them first")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers how many rows the session sends to Python at once, where it still is the default: texts are long, and each task holds a batch on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(column, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def lean(function):
    """A function over batches that gives its memory back to the system when it ends: workers stay for later tasks."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:
            pass  # another libc

    return run


# ---------------------------------------------------------------- text as numpy


def slices(texts: pa.Array, limit: int = 1 << 20):
    """Yields (first row, row after the last, bytes, offsets) of runs of rows of about ``limit`` bytes.

    Nulls count as empty texts. One text is never cut, so a longer one makes a run alone.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.string()) if pa.types.is_null(texts.type) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_P, _P_INV)):
        while len(_POWERS[k]) < n:
            have = _POWERS[k]
            _POWERS[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    return _POWERS[0][:n], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of data, from differences of one running sum."""
    powers, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses a row's end."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~solid))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return _LOWER[data]


# ---------------------------------------------------------------- sketches of a fixed size


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


SKETCH_SCHEMA = "part int, counts binary"
PARTS = 32  # rows that a sketch is cut into


def sketch_batch(counts: np.ndarray) -> pa.RecordBatch:
    """A sketch of counts (uint32) as a row for each part that isn't empty."""
    rows = [(k, pack(x)) for k, x in enumerate(np.split(counts, PARTS)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "counts"])


def bit_batch(bits: np.ndarray) -> pa.RecordBatch:
    """A sketch of packed bits as a row for each part that isn't empty."""
    rows = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(bits, PARTS)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "counts"])


def merged_bits(rows: DataFrame, bits: int) -> np.ndarray:
    """The union of the bit sketches in rows (part, counts), packed; like merged_sketch()."""
    size = (1 << bits) // 8 // PARTS

    def add(batches):
        unions: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                own = unions.setdefault(part, np.zeros(size, np.uint8))
                own |= np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(unions), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in unions.values()], pa.binary())], ["part", "counts"])

    n = partitions(rows.sparkSession)
    if n > 8 * PARTS:
        rows = rows.withColumn("salt", F.floor(F.rand(1) * (n // PARTS))).repartition(n, "part", "salt").drop("salt").mapInArrow(lean(add), SKETCH_SCHEMA)
    out = np.zeros((PARTS, size), np.uint8)
    for r in rows.repartition(min(PARTS, n), "part").mapInArrow(lean(add), SKETCH_SCHEMA).collect():
        out[r["part"]] |= np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return out.reshape(-1)


def merged_sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """The sum of the count sketches in rows (part, counts): 2**bits counters (uint32, saturated).

    Parts are summed where their rows meet, one row at a time; where there are many rows, first
    in several tasks for each part. Only the summed counters come to the driver; their size
    doesn't depend on the input.
    """
    width = (1 << bits) // PARTS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                x = sums.setdefault(part, np.zeros(width, np.uint32))
                x += np.minimum(unpack(counts, np.uint32), 2**32 - 1 - x)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(x) for x in sums.values()], pa.binary())], ["part", "counts"])

    n = partitions(rows.sparkSession)
    if n > 8 * PARTS:
        rows = rows.withColumn("salt", F.floor(F.rand(1) * (n // PARTS))).repartition(n, "part", "salt").drop("salt").mapInArrow(lean(add), SKETCH_SCHEMA)
    out = np.zeros((PARTS, width), np.uint32)
    for r in rows.repartition(min(PARTS, n), "part").mapInArrow(lean(add), SKETCH_SCHEMA).collect():
        out[r["part"]] = unpack(r["counts"], np.uint32)
    return out.reshape(-1)
