"""Shared helpers: shared working folder, materialised steps, word views of Arrow text."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.tables import shared_dir, work_path  # noqa: F401  (shared_dir: for the operators that write files)

#: The six ASCII white-space bytes between words (fixed values of the word rule ``[^\x20\x09-\x0D]+``).
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Commands within remove their shuffle files when they end, so that what is on disk is one step's, not all steps'."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with cleaned_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def width(df: DataFrame) -> int:
    """Partitions of a hash exchange in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and its n+1 offsets into them; nothing is copied."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_slices(texts: pa.Array, most: int = 1 << 20):
    """Consecutive (start, number) ranges of a string array with about ``most`` bytes of text each, at least one text."""
    _, offsets = utf8(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end - at
        at = end


def pieces(batches, column: str = "text", most: int = 1 << 18):
    """The batches cut into slices of about ``most`` bytes of text, which bounds what is derived from a slice."""
    for batch in batches:
        for at, n in text_slices(batch.column(column), most):
            yield batch.slice(at, n)


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the number of words before it (n+1 values)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | first[:-1]))
    ends = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64, endpoint=False)
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, n values."""
    kept = _POWERS.get((base, 0))
    if kept is None or len(kept) < n:
        size = max(n, 1 << 16)
        kept = np.full(size, base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        _POWERS[(base, 0)] = kept
    return kept[:n]


_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for each span, whatever its place (uint64 arithmetic wraps)."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_BASE_INV, n + 1)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return mix64(span_hash(_RANDOM[data], starts, ends) + (ends - starts).astype(np.uint64) * _ODD)
