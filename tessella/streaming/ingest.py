"""Growing an index from a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions import hashing
from tessella.operators import bloom, index, kmers
from tessella.params import SketchParams


def grow(stream: DataFrame, params: SketchParams, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of genomes(genome_id, name, seq) to the index tables under `path`.

    Each micro-batch is sketched and appended in a folder of its own number, so a batch that runs
    again replaces its rows. Ids come from the stream. Read the tables with load_grown().
    """

    def append(batch: DataFrame, number: int) -> None:
        built = index.build(batch, params)
        for name, df in (("sketch", built.sketch), ("genomes", built.genomes), ("bloom", built.bloom)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_grown(spark, path: str, params: SketchParams) -> index.Index:
    """The index that grow() has written so far."""
    read = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch")
    return index.Index(params, read("sketch"), read("genomes"), read("bloom").distinct())


def sketch_stream(stream: DataFrame, params: SketchParams) -> DataFrame:
    """Streaming sketch rows of a stream of genomes (stateless, as a sketch needs one row only)."""
    return kmers.sketch(stream.where(F.length("seq") >= params.k), params, "genome_id")


def filter_stream(stream: DataFrame, bloom_: DataFrame, params: SketchParams) -> DataFrame:
    """Streaming sketch rows with a hash all of whose filter cells are set in bloom_(word, mask) or bloom_(cell), as pass_bloom() keeps.

    Stateless: each probe's word is joined with the static filter.
    """
    words = bloom_ if "mask" in bloom_.columns else bloom.filter_words(bloom_)
    kept = hashing.with_probes(stream, "khash", "_probes")
    for i in range(hashing.BLOOM_HASHES):
        cell = F.shiftrightunsigned(F.get("_probes", i), params.log2_bloom + 3)
        kept = kept.withColumn("_cell", cell).withColumn("_word", F.shiftrightunsigned("_cell", 6)).join(words.withColumnRenamed("word", "_word"), "_word")
        kept = kept.where(F.expr("shiftrightunsigned(mask, cast(_cell & 63 as int)) & 1 = 1")).drop("_word", "_cell", "mask")
    return kept.drop("_probes")
