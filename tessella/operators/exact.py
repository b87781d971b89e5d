"""Exact verification of hits, set counts, and the accuracy of estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.operators import kmers
from tessella.shared import broadcast_if_small, checkpoint


#: k-mers of a block that sets of one genome are cut into, about, where their number is known.
BLOCK = 1 << 20


def packed_set(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned numbers as steps from one to the next: their width in bytes, then all lowest bytes first."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    width = data[0]
    size = (len(data) - 1) // width
    steps = np.zeros((size, 8), np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, size).T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers in both of two sorted sets: the smaller is looked up in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def kmer_blocks(seqs: DataFrame, k: int, key: str, ranges: int, seq: str = "seq") -> DataFrame:
    """key, part, n, kmers: the distinct canonical k-mers of sequences, as packed sorted sets.

    Parts are ranges of the k-mers' hashes, `ranges` of them (a power of two), so that each has a like share of a key's k-mers.
    A task packs what it has of a key and part; sets of several sequences or pieces meet in one shuffle and are merged.
    """
    source = seqs.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq")).where("seq IS NOT NULL")
    kind = source.schema["key"].dataType.simpleString()
    bits = (ranges - 1).bit_length()
    names = ["key", "part", "n", "kmers"]

    def batch_of(keys: pa.Array, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        columns = [keys.take(pa.array([i for i, _, _ in rows])), pa.array([p for _, p, _ in rows], pa.int32()), pa.array([len(v) for _, _, v in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([packed_set(v) for _, _, v in rows], pa.binary())], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                for (values,) in kmers.distinct_of(kmers.letters(batch.column("seq")[i].as_py()), k):
                    place = (kmers.hash64(values) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
                    order = np.argsort(place, kind="stable")  # keeps each part sorted
                    values, place = values[order], place[order]
                    edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]).tolist() if len(place) else []
                    rows += [(i, int(place[x]), values[x:y]) for x, y in zip(edges, [*edges[1:], len(values)])]
                    size += len(values)
                if size > kmers.ROWS:
                    yield batch_of(batch.column("key"), rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(batch.column("key"), rows)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def one() -> pa.RecordBatch:
            values = unpacked_set(held[0]) if len(held) == 1 else np.unique(np.concatenate([unpacked_set(h) for h in held]))
            return batch_of(pa.array([at[0]], key_type), [(0, at[1], values)])

        for batch in batches:
            key_type = batch.column("key").type
            for key_, part, data in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "kmers"))):
                if (key_, part) != at:
                    if held:
                        yield one()
                    at, held = (key_, part), []
                held.append(data)
        if held:
            yield one()

    schema = f"key {kind}, part int, n long, kmers binary"
    made = source.mapInArrow(cut, schema).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(merged, schema)
    return made.withColumnRenamed("key", key)


def summary(values: np.ndarray) -> tuple[int, int, int]:
    """Size, least and largest of a sorted set."""
    return len(values), int(values[0]), int(values[-1])


def kmer_summary(segments: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """key, n_kmers, least, largest of the distinct canonical k-mers of each key, as exact_kmers() has them; keys without any have no row.

    A key of one sequence of no more than a piece is counted where it is read. Only those of several sequences, or of a
    longer one, travel, as packed sorted sets by ranges of hashes.
    """
    rows = segments.select(F.col(key).alias("key"), F.col(seq).cast("string").alias("seq")).where(F.length("seq") >= k)
    kind = rows.schema["key"].dataType.simpleString()
    several = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("longest"), F.sum(F.length("seq")).alias("letters"))
    several = broadcast_if_small(several.where((F.col("n") > 1) | (F.col("longest") > kmers.PIECE)), 100_000)
    same = rows["key"].eqNullSafe(several["key"])
    names = ["key", "n_kmers", "least", "largest"]

    def of_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(values) for s in batch.column("seq") for (values,) in kmers.distinct_of(kmers.letters(s.as_py()), k)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in zip(*found))], names=names)

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(unpacked_set(x.as_py())) for x in batch.column("kmers")]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in zip(*found))], names=names)

    schema = f"key {kind}, n_kmers long, least long, largest long"
    one = rows.join(several, same, "left_anti").mapInArrow(of_one, schema)
    most = several.agg(F.max("letters")).first()[0] or 0
    parts = kmer_blocks(rows.join(several, same, "left_semi"), k, "key", 1 << max(0, (most // BLOCK).bit_length()))
    met = parts.select("key", "kmers").mapInArrow(of_part, schema).groupBy("key")
    return one.unionByName(met.agg(F.sum("n_kmers").alias("n_kmers"), F.min("least").alias("least"), F.max("largest").alias("largest"))).withColumnRenamed("key", key)


def exact_counts(pairs: DataFrame, queries: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """The pairs with inter > 0, and n_query, n_genome, inter, union_size, real_jaccard of distinct k-mers.

    queries(query_id, seq); segments(genome_id, seq), several for a genome. Only genomes and queries of the
    pairs are taken apart. Their k-mers travel as packed sorted sets by ranges of hashes, and the sets of each pair
    are merged range by range; neither a k-mer nor all of a genome's k-mers is a row.
    """
    pairs = checkpoint(pairs)  # used on all sides below
    wanted_q = pairs.select("query_id").distinct()
    wanted_g = pairs.select("genome_id").distinct()
    queries = queries.select("query_id", "seq").join(wanted_q, "query_id", "left_semi")
    segments = segments.select("genome_id", "seq").join(wanted_g, "genome_id", "left_semi")
    longest = segments.groupBy("genome_id").agg(F.sum(F.length("seq")).alias("n")).agg(F.max("n")).first()[0] or 0
    ranges = 1 << max(0, (longest // BLOCK).bit_length())
    a = checkpoint(kmer_blocks(queries, k, "query_id", ranges))
    b = checkpoint(kmer_blocks(segments, k, "genome_id", ranges))
    size_a = a.groupBy("query_id").agg(F.sum("n").alias("n_query"))
    size_b = b.groupBy("genome_id").agg(F.sum("n").alias("n_genome"))
    asked = pairs.select("query_id", "genome_id").distinct().join(a.select("query_id", "part", F.col("kmers").alias("asked")), "query_id")
    both = asked.join(b.select("genome_id", "part", "kmers"), ["genome_id", "part"]).select("query_id", "genome_id", "asked", "kmers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [in_both(unpacked_set(x), unpacked_set(y)) for x, y in zip(batch.column("asked").to_pylist(), batch.column("kmers").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("genome_id"), pa.array(counts, pa.int64())], names=["query_id", "genome_id", "inter"])

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "genome_id")}
    met = both.mapInArrow(run, f"query_id {kinds['query_id']}, genome_id {kinds['genome_id']}, inter long")
    inter = met.groupBy("query_id", "genome_id").agg(F.sum("inter").alias("inter")).where(F.col("inter") > 0)
    out = pairs.join(inter, ["query_id", "genome_id"]).join(size_a, "query_id").join(size_b, "genome_id")
    union = F.col("n_query") + F.col("n_genome") - F.col("inter")
    return out.withColumn("union_size", union).withColumn("real_jaccard", F.col("inter") / F.col("union_size"))


def multiset_collisions(one: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """collisions: the rows of `other`, with repeats, whose value occurs in `one`."""
    return other.join(broadcast_if_small(one.select(column).distinct()), column, "left_semi").agg(F.count("*").alias("collisions"))


def set_collisions(one: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """collisions: the number of distinct values in both. `one` is best the smaller: only values in it are shuffled."""
    few = broadcast_if_small(one.select(column).distinct())
    return other.select(column).join(few, column, "left_semi").distinct().agg(F.count("*").alias("collisions"))


def accuracy(hits: DataFrame) -> DataFrame:
    """metric, n, slope, intercept, r2 of the estimates (jaccard, intersection) against the exact values."""
    pairs = hits.select(F.explode(F.array(
        F.struct(F.lit("jaccard").alias("metric"), F.col("real_jaccard").alias("x"), F.col("jaccard").alias("y")),
        F.struct(F.lit("intersection").alias("metric"), F.col("inter").cast("double").alias("x"), F.col("intersection").alias("y")),
    )).alias("p")).select("p.*")
    return pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2")
    )
