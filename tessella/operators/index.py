"""Sketch indexes: build, append, merge, save, load."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tessella.operators import bloom as blooms
from tessella.operators import columns as packing
from tessella.operators import kmers
from tessella.params import SketchParams
from tessella.shared import checkpoint

#: Fixed value: the constant of the cardinality estimate.
ALPHA = 0.72134


#: Name of the sketch's partition column.
RANGE = "bucket_range"


@dataclass(frozen=True)
class Index:
    """sketch(genome_id, bucket, fp, khash; a saved one also bucket_range), genomes(genome_id, name, n_chars, sketch_size, genome_size), bloom(cell).

    Searches use the packed forms where there are any: columns(block, bucket, fps; a saved one also bucket_range), words(word, mask).
    """

    params: SketchParams
    sketch: DataFrame
    genomes: DataFrame
    bloom: DataFrame
    #: Ranges of buckets that the sketch's folders are for, in the column RANGE; 0 if it is no saved one.
    ranges: int = 0
    columns: DataFrame | None = None
    words: DataFrame | None = None


def _size(m: Column, weight: Column, n_chars: Column) -> Column:
    """Estimated k-mers of a genome with m filled buckets, whose 2**-exponent sum up to `weight` (null without any)."""
    raw = F.lit(ALPHA) * (m * m) / weight
    return F.when(weight.isNull(), F.lit(0)).when(raw > n_chars, n_chars).otherwise(F.floor(raw)).cast("long")


def genome_sizes(genomes: DataFrame, sketch: DataFrame, params: SketchParams) -> DataFrame:
    """Metadata of genomes(genome_id, name, n_chars): filled buckets, and the estimated number of k-mers.

    The estimate is capped by the sequence's length; without a filled bucket it is 0.
    """
    filled = sketch.groupBy("genome_id").agg(
        F.count("*").alias("sketch_size"), F.sum(F.pow(F.lit(2.0), -F.shiftright("fp", params.mantissa).cast("double"))).alias("_s")
    )
    size = _size(F.col("sketch_size").cast("double"), F.col("_s"), F.col("n_chars"))
    return genomes.join(filled, "genome_id", "left").select(
        "genome_id", "name", "n_chars", F.coalesce("sketch_size", F.lit(0)).cast("long").alias("sketch_size"), size.alias("genome_size")
    )


def build(genomes: DataFrame, params: SketchParams, seen: Observation | None = None) -> Index:
    """Index of genomes(genome_id, name, seq); sequences shorter than k are left out.

    Sequences are read and sketched once: columns, metadata and filter come from one checkpointed table. The row form of the
    sketch is made only where it is read. `seen` is given genomes, short (left out), letters and kmers as that table is written.
    """
    length = F.length("seq")
    kept = genomes.where(length >= params.k)
    read = genomes
    if seen is not None:
        positions = F.sum(F.greatest(length - params.k, F.lit(0)))
        read = genomes.observe(seen, F.count("*").alias("genomes"), F.count_if(F.coalesce(length < params.k, F.lit(True))).alias("short"), F.sum(length).alias("letters"), positions.alias("kmers"))
    made = checkpoint(packing.parts(read.where(length >= params.k), params))
    weight = F.when(F.col("size") > 0, F.col("weight"))
    meta = made.where(F.col("kind") == packing.GENOME).select(
        F.col("a").alias("genome_id"), F.col("data").cast("string").alias("name"), F.col("b").alias("n_chars"),
        F.col("size").alias("sketch_size"), _size(F.col("size").cast("double"), weight, F.col("b")).alias("genome_size"),
    )
    words = packing.filter_words(made)
    return Index(params, kmers.sketch(kept, params, "genome_id"), meta, blooms.cells_of(words), columns=packing.packed(made), words=words)


def build_of_pieces(pieces: DataFrame, params: SketchParams) -> Index:
    """Index of genomes that come in pieces(genome_id, name, seq, start, carry, prefix, total), each over several tasks."""
    sketch = checkpoint(kmers.sketch_of_pieces(pieces, params, "genome_id"))
    genomes = pieces.groupBy("genome_id", "name").agg(F.max("total").alias("n_chars"))
    words = blooms.filter_words(blooms.with_cells(sketch.select("khash"), params).select(F.explode("cells").alias("cell")))
    return Index(params, sketch, genome_sizes(genomes, sketch, params), blooms.cells_of(words), columns=packing.of_rows(sketch), words=words)


def together(a: Index, b: Index) -> Index:
    """Both collections in one index, with the ids that they have (no id in both)."""
    words = a.words.unionByName(b.words).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    columns = a.columns.select("block", "bucket", "fps").unionByName(b.columns.select("block", "bucket", "fps"))
    return Index(a.params, a.sketch.unionByName(b.sketch), a.genomes.unionByName(b.genomes), blooms.cells_of(words), columns=columns, words=words)


def merge(a: Index, b: Index) -> Index:
    """Both collections in one index; the genomes of `b` are numbered on from those of `a`."""
    if a.params != b.params:
        raise ValueError("indexes of different parameters can't be merged")
    first = (a.genomes.agg(F.max("genome_id")).first()[0] or 0) + 1 if not a.genomes.isEmpty() else 0
    kept = [c for c in ("genome_id", "bucket", "fp", "khash") if c in a.sketch.columns and c in b.sketch.columns]
    moved = lambda df: df.withColumn("genome_id", F.col("genome_id") + F.lit(first))
    columns = words = None
    if a.columns is not None and b.columns is not None:
        columns = a.columns.select("block", "bucket", "fps").unionByName(packing.moved(b.columns, first))
    if a.words is not None and b.words is not None:
        words = a.words.unionByName(b.words).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    cells = a.bloom.unionByName(b.bloom).distinct() if words is None else blooms.cells_of(words)
    return Index(a.params, a.sketch.select(kept).unionByName(moved(b.sketch.select(kept))), a.genomes.unionByName(moved(b.genomes)), cells, columns=columns, words=words)


def append(index: Index, genomes: DataFrame) -> Index:
    """The index with more genomes (their genome_id from 0)."""
    return merge(index, build(genomes, index.params))


def in_range(index_params: SketchParams, ranges: int) -> Column:
    """The range that a row's bucket is in, of so many equal ones."""
    return F.shiftright("bucket", max(0, index_params.log2_buckets - (max(1, ranges) - 1).bit_length())).cast("int")


def save(index: Index, path: str, mode: str = "errorifexists", ranges: int = 256, rows: bool = True) -> None:
    """Parquet tables sketch, columns, genomes, bloom and params.

    Sketch and columns have a folder for each of `ranges` ranges of buckets (up to a power of two), sorted within; a
    search reads only the folders of its queries' buckets. More ranges suit larger collections, whose folders stay full.
    Without `rows` only the packed columns are written, one byte for a bucket of a genome; the sketch is then read
    from them, without its hashes.
    """
    placed = lambda df: df.withColumn(RANGE, in_range(index.params, ranges))
    if rows:
        ordered = placed(index.sketch.select("genome_id", "bucket", "fp", "khash")).repartitionByRange(RANGE, "bucket", "fp").sortWithinPartitions(RANGE, "bucket", "fp")
        ordered.write.mode(mode).partitionBy(RANGE).parquet(f"{path}/sketch")
    columns = packing.of_rows(index.sketch) if index.columns is None else index.columns.select("block", "bucket", "fps")
    placed(columns).sortWithinPartitions(RANGE, "block", "bucket").write.mode(mode).partitionBy(RANGE).option("compression", "zstd").parquet(f"{path}/columns")
    index.genomes.write.mode(mode).parquet(f"{path}/genomes")
    (blooms.filter_words(index.bloom) if index.words is None else index.words).write.mode(mode).parquet(f"{path}/bloom")
    spark = index.sketch.sparkSession
    spark.createDataFrame([asdict(index.params) | {"ranges": ranges, "rows": rows}]).coalesce(1).write.mode(mode).parquet(f"{path}/params")


def load(spark: SparkSession, path: str, threshold: float | None = None) -> Index:
    """A saved index; its parameters come from the files, but the threshold may be given anew."""
    row = spark.read.parquet(f"{path}/params").first().asDict()
    ranges, rows = row.pop("ranges"), row.pop("rows")
    params = SketchParams(**row | ({} if threshold is None else {"threshold": threshold}))
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    columns, words = read("columns"), read("bloom")
    sketch = read("sketch") if rows else packing.to_rows(columns)
    return Index(params, sketch, read("genomes"), blooms.cells_of(words), ranges, columns, words)
