"""Approximate search: queries against an index by shared fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from tessella.operators import bloom, columns, kmers
from tessella.operators.index import RANGE, Index, in_range
from tessella.shared import broadcast_if_small, checkpoint

#: Hits of a query, least matches, and the share of the threshold that an
#: intersection must reach, for each kind of search.
RECORDS = {"top": 10, "min_score": 10, "share": 0.5}
FILES = {"top": 10, "min_score": 10, "share": 0.5}
RECORDS_EXACT = {"top": 5, "min_score": 10, "share": 1.0}
FILES_EXACT = {"top": 5, "min_score": 5, "share": 1.0}

#: Rows of one bucket and fingerprint that a task joins, about, and the share of a sketch that is counted to find more frequent ones.
HEAVY = 1_000_000
SAMPLE = 0.01


def query_sketch(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, bucket, fp, khash of queries(query_id, seq), after the Bloom filter."""
    kept = queries.where(F.length("seq") >= index.params.k)
    return bloom.pass_bloom(kmers.sketch(kept, index.params, "query_id"), index.bloom if index.words is None else index.words, index.params)


def stored_for(index: Index, q: DataFrame) -> DataFrame:
    """The index's sketch, of a saved one the folders that rows with the buckets of q may be in."""
    if not index.ranges or RANGE not in index.sketch.columns:
        return index.sketch
    asked = sorted(r[0] for r in q.select(in_range(index.params, index.ranges)).distinct().collect())
    return index.sketch.where(F.col(RANGE).isin(asked))


def dealt(stored: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a match on (bucket, fp), with a `share` to join on as well, so that no key has many more than HEAVY rows.

    A fingerprint that many genomes have in a bucket is found by a counted sample; its genomes are dealt into as many shares as it
    has times HEAVY rows, and each of its queries goes to all of them. All other keys have one share. At most one key in
    HEAVY rows is heavy, so the list of them is broadcast behind a count.
    """
    sample = stored.select("bucket", "fp").sample(SAMPLE, seed=1)
    shares = F.ceil(F.count("*") / F.lit(SAMPLE * HEAVY)).cast("int")
    heavy = broadcast_if_small(sample.groupBy("bucket", "fp").agg(shares.alias("shares")).where("shares > 1"))
    of = lambda df: df.join(heavy, ["bucket", "fp"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    one = F.pmod(F.xxhash64("genome_id"), F.col("shares")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    return of(stored).withColumn("share", one).drop("shares"), of(q).withColumn("share", every).drop("shares")


def match_counts(index: Index, sketched: DataFrame, least: int = 1) -> DataFrame:
    """query_id, genome_id, matches (at least `least`): buckets in which both have the same fingerprint.

    Packed columns are compared whole, queries being packed as well; see the module columns. An index of rows alone, or
    queries whose ids are no whole numbers, are matched by an equi-join on (bucket, fp), counted before the shuffle by pair. Of saved
    columns only the folders of the queries' bucket ranges are read, as broadcast queries prune the scan (of saved rows by a list of
    at most index.ranges numbers from the driver). Pairs without a match have no row.
    """
    q = checkpoint(sketched.select("query_id", "bucket", "fp"))
    kind = q.schema["query_id"].dataType
    if index.columns is not None and isinstance(kind, IntegralType):
        place = (RANGE, in_range(index.params, index.ranges)) if index.ranges and RANGE in index.columns.columns else None
        counts = columns.match_counts(index.columns, q, least, place)
        return counts.withColumn("query_id", F.col("query_id").cast(kind))
    stored, q = dealt(stored_for(index, q).select("genome_id", "bucket", "fp"), q)
    joined = stored.join(q, ["bucket", "fp", "share"])
    return joined.groupBy("query_id", "genome_id").agg(F.count("*").alias("matches")).where(F.col("matches") >= least)


def ranked(index: Index, counts: DataFrame, top: int, min_score: int, share: float) -> DataFrame:
    """query_id, genome_id, matches, jaccard, intersection, rank of the best genomes of each query.

    `jaccard` is the share of the genome's sketch that matched (a containment), `intersection` that share of
    its estimated k-mers. Ties go to the larger genome_id.
    """
    scored = (
        counts.where(F.col("matches") >= min_score)
        .join(index.genomes.select("genome_id", "sketch_size", "genome_size"), "genome_id")
        .withColumn("jaccard", F.col("matches") / F.col("sketch_size"))
        .withColumn("intersection", F.col("jaccard") * F.col("genome_size"))
        .where(F.col("intersection") >= share * index.params.threshold)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("intersection"), F.desc("genome_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "genome_id", "matches", "jaccard", "intersection", "rank"
    )


def search(index: Index, queries: DataFrame, top: int = 10, min_score: int = 10, share: float = 0.5) -> DataFrame:
    return ranked(index, match_counts(index, query_sketch(index, queries), min_score), top, min_score, share)
