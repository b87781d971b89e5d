"""Shared helpers: reading tables, Arrow batches of texts, word splitting and hashing inside tasks.

Text columns cross into Python as Arrow UTF-8 buffers. Null texts are empty texts
everywhere in this subpackage unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.shared import checkpoint_counted

#: Text bytes that a task handles at once; longer single texts are handled alone.
SLICE_BYTES = 8 << 20

#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about SLICE_BYTES of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
        cuts = np.flatnonzero(np.diff(group)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word, kept in a bounded dictionary."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), elementwise."""
    x = (x ^ (x >> U64(32))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def planes(x: np.ndarray, count: int) -> bytes:
    """The low bytes of unsigned integers, all lowest bytes first; bytes of one weight compress well together."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :count].T.tobytes()


def of_planes(data: bytes, count: int, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :count] = np.frombuffer(data, np.uint8).reshape(count, size).T
    return out.reshape(-1).view(U64)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes (a polynomial in the window, then mixed)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, U64)
    out = words[:count].copy()
    for k in range(1, size):
        out *= U64(0x100000001B3)
        out += words[k : k + count]
        if k % 2 == 0:
            out ^= out >> U64(31)
    return mix(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than `size` make one shingle of all of them."""
    if not len(words):
        return np.empty(0, U64)
    return np.unique(gram_hashes(words, min(size, len(words))))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: log2 of the bits of the largest bitmap that preselects rows by key.
KEY_BITS = 24


def with_keys(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among `keys` (distinct or not, of the same type).

    Rows are preselected by a broadcast bitmap of hashed keys, with 64 bits for each key and at most 2**KEY_BITS
    (2 MB), so that few others are shuffled; the exact join follows. Where there are too many keys for that
    bitmap to sort rows out, the join works alone.
    """
    keys, count = checkpoint_counted(keys.distinct())
    bits = max(12, (64 * count).bit_length())
    if bits <= KEY_BITS + 4:
        bits = min(bits, KEY_BITS)
        slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
        place, word, mask = (unused(source, x) for x in ("place", "word", "mask"))
        words = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias(mask))
        marked = source.withColumn(place, slot).withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), word)
        source = marked.where(f"shiftrightunsigned({mask}, cast({place} & 63 as int)) & 1 = 1").select(source.columns)
    # Not a semi-join, which the optimizer would move below the bitmap.
    return source.join(keys, key).select(source.columns)


def bit_table(df: DataFrame, key: str, log2_bits: int) -> np.ndarray:
    """A bitmap of 2**log2_bits bits with one bit set for each value of a long column.

    Its size is fixed by the parameter, whatever the number of rows: Spark ORs the bits of each
    64-bit word, and at most 2**(log2_bits - 6) words reach the driver. A clear bit proves that a
    value is absent; a set bit proves nothing, so users join exactly afterwards.
    """
    slot = F.shiftrightunsigned(F.col(key) * F.lit(1), 64 - log2_bits) if log2_bits < 64 else F.col(key)
    words = (
        df.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).cast("int").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(U64)


def in_bits(bits: np.ndarray, keys: np.ndarray, log2_bits: int) -> np.ndarray:
    """Which of the unsigned 64-bit keys have their bit set in bit_table()."""
    slot = keys >> U64(64 - log2_bits)
    return ((bits[slot >> U64(6)] >> (slot & U64(63))) & U64(1)).astype(bool)
