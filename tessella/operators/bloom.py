"""The Bloom filter of indexed k-mers: 64-bit words of cells, or the set of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions import hashing
from tessella.params import SketchParams


def with_cells(df: DataFrame, params: SketchParams, hashed: str = "khash") -> DataFrame:
    """Add `cells`: the distinct filter cells (bytes) that the probes of a hash touch."""
    probed = hashing.with_probes(df, hashed, "_probes")
    shift = params.log2_bloom + 3
    return probed.withColumn("cells", F.array_distinct(F.transform("_probes", lambda p: F.shiftrightunsigned(p, shift)))).drop("_probes")


def filter_words(cells: DataFrame) -> DataFrame:
    """word, mask: cells (distinct or not) packed into 64-bit words."""
    return cells.groupBy(F.shiftrightunsigned("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("mask"))


def cells_of(words: DataFrame) -> DataFrame:
    """cell: the cells that are set in words."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return words.select(F.col("word"), F.explode(places).alias("_i")).select((F.col("word") * 64 + F.col("_i")).alias("cell"))


def bloom_cells(sketch: DataFrame, params: SketchParams) -> DataFrame:
    """cell: the distinct cells set by a sketch table."""
    return cells_of(filter_words(with_cells(sketch.select("khash"), params).select(F.explode("cells").alias("cell"))))


def pass_bloom(sketch: DataFrame, bloom: DataFrame, params: SketchParams) -> DataFrame:
    """Sketch rows all of whose cells are set, in bloom(word, mask) or bloom(cell). Distinct hashes are tested once each.

    Cells are few: a cell stands for the leading bases of a k-mer.
    """
    words = bloom if "mask" in bloom.columns else filter_words(bloom)
    hashes = with_cells(sketch.select("khash").distinct(), params).select("khash", F.explode("cells").alias("cell"))
    wanted = filter_words_of(hashes)
    missing = wanted.join(words, "word", "left").where(F.coalesce(F.col("mask").bitwiseAND(F.col("asked")), F.lit(0)) != F.col("asked")).select("khash").distinct()
    return sketch.join(missing, "khash", "left_anti").select(sketch.columns)


def filter_words_of(hashes: DataFrame) -> DataFrame:
    """khash, word, asked: the cells of each hash packed into words."""
    return hashes.groupBy("khash", F.shiftrightunsigned("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("asked"))
