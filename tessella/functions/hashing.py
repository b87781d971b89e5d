"""Invertible 64-bit and 32-bit hashes and fingerprints as Columns.

Hashes are unsigned numbers in signed longs. Products wrap around, which the ANSI mode of Spark SQL
rejects, so the steps are added to a DataFrame while that mode is off; a plan keeps the mode that it
was built in. Each step is a column of its own, as it uses its argument twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The multipliers of the hashes and of their inverses.
MIX64 = 0xD6E8FEB86659FD93
UNMIX64 = 0xCFEE444D8B59A89B
MIX32 = (0x2C1B3C6D, 0x297A2D39)
UNMIX32 = (0x0CF0B109, 0x64EA2D65)

BLOOM_HASHES = 5


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans built inside have wrapping integer arithmetic."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _signed(x: int, bits: int = 64) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _mix64(df: DataFrame, source: str, target: str, multiplier: int) -> DataFrame:
    factor = F.lit(_signed(multiplier))
    fold = lambda c: F.shiftrightunsigned(c, 32).bitwiseXOR(F.col(c))
    with wrapping(df.sparkSession):
        return (
            df.withColumn("_1", fold(source) * factor).withColumn("_2", fold("_1") * factor)
            .withColumn(target, fold("_2")).drop("_1", "_2")
        )


def with_hash64(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the 64-bit hash of a long column."""
    return _mix64(df, source, target, MIX64)


def with_unhash64(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the number whose hash a long column is."""
    return _mix64(df, source, target, UNMIX64)


def _mix32(df: DataFrame, source: str, target: str, multipliers: tuple[int, int]) -> DataFrame:
    a, b = multipliers
    fold = lambda c: F.shiftright(c, 16).bitwiseXOR(F.col(c))
    cut = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    with wrapping(df.sparkSession):
        return (
            df.withColumn("_0", cut(F.col(source).cast("long")))
            .withColumn("_1", cut(fold("_0") * F.lit(a))).withColumn("_2", cut(fold("_1") * F.lit(b)))
            .withColumn(target, fold("_2")).drop("_0", "_1", "_2")
        )


def with_hash32(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the 32-bit hash of a number's low 32 bits, as an unsigned number."""
    return _mix32(df, source, target, MIX32)


def with_unhash32(df: DataFrame, source: str, target: str) -> DataFrame:
    return _mix32(df, source, target, UNMIX32)


def with_probes(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the array of BLOOM_HASHES probe hashes of a long column: unhash(x) + (69 i hash(x) mod 1024)."""
    both = with_unhash64(with_hash64(df, source, "_h"), source, "_u")
    with wrapping(df.sparkSession):
        probes = [F.col("_u") + (F.lit(69 * i) * F.col("_h")).bitwiseAND(F.lit(1023)) for i in range(BLOOM_HASHES)]
        return both.withColumn(target, F.array(*probes)).drop("_h", "_u")


def with_string_product(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the product of a string's character codes, wrapping; 1 for the empty string."""
    with wrapping(df.sparkSession):
        codes = F.transform(F.filter(F.split(source, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
        return df.withColumn(target, F.aggregate(codes, F.lit(1).cast("long"), lambda acc, x: acc * x))


def floor_log2(x: Column) -> Column:
    """Place of the highest bit of a positive long; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)) - 1)


def with_fingerprint(df: DataFrame, hashed: str, log2_buckets: int, mantissa: int) -> DataFrame:
    """Add bucket (the top bits of a hash) and fp, the fingerprint of the rest: 0 to 254, or 255 for none."""
    bits = 64 - log2_buckets
    return (
        df.withColumn("bucket", F.shiftrightunsigned(hashed, bits))
        .withColumn("_v", F.col(hashed).bitwiseAND(F.lit((1 << bits) - 1)))
        .withColumn("_p", floor_log2(F.col("_v")))
        .withColumn("fp", F.expr(f"""
            CASE WHEN _v = 0 THEN 255 ELSE cast((
                shiftright(_v - shiftleft(1L, _p), greatest(_p - {mantissa}, 0))
                + shiftleft(cast(greatest(_p - 32 + {log2_buckets}, 0) AS BIGINT), {mantissa})) & 255 AS INT) END"""))
        .drop("_v", "_p")
    )
