"""Sequences by bytes, the filter of a stream, and counts that a build tells as it runs."""

import gzip
import random

import plain
from pyspark.sql import Observation

from tessella.operators import index, kmers, search
from tessella.params import SketchParams
from tessella.sources import fasta
from tessella.streaming import ingest

A = "ACGTTGCATGTCGCATGATGCATGAGAGCTACGTTAGC"
P = SketchParams(k=11, log2_buckets=3, threshold=4)


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def test_a_byte_is_a_character(spark, tmp_path, monkeypatch):
    """Stray bytes, and UTF-8 of two and three bytes, in files of every kind and in both forms of the kernels."""
    odd = A[:14].encode() + b"\xe9" + A[14:20].encode() + "é漢".encode() + A[20:].encode()
    want = odd.decode("latin-1")
    (tmp_path / "a.fa").write_bytes(b">h\xff\n" + odd + b"\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n")
    assert rows(fasta.genomes_of_list(spark, f"{tmp_path}/list", 11)[0], "seq") == [(want,)]
    monkeypatch.setattr(fasta, "LARGE", 1)
    _, pieces, _ = fasta.genome_pieces_of_list(spark, f"{tmp_path}/list", 11)
    assert rows(pieces, "seq", "total") == [(want, len(odd))]
    (tmp_path / "q").write_bytes(">é1\n".encode() + odd + b"\n>b\xff\nACG")
    (tmp_path / "q.gz").write_bytes(gzip.compress((tmp_path / "q").read_bytes()))
    for name in ("q", "q.gz"):
        assert rows(fasta.records(spark, f"{tmp_path}/{name}", 3)) == [(0, ">é1", want), (1, ">b�", "ACG")]
    df = spark.createDataFrame([(0, want), (1, A[:9] + "é漢Ω" + A[9:]), (2, "é" * 30)], "genome_id long, seq string")
    assert rows(kmers.sketch(df, P, "genome_id")) == rows(kmers.sketch_by_sql(df, P, "genome_id"))
    assert rows(kmers.sketch_kmers(df, 11, "genome_id")) == rows(kmers.sketch_kmers_by_sql(df, 11, "genome_id"))
    assert rows(kmers.exact_kmers(df, 11, "genome_id")) == rows(kmers.exact_kmers_by_sql(df, 11, "genome_id"))
    got = {r["bucket"]: r["fp"] for r in kmers.sketch(df.where("genome_id = 0"), P, "genome_id").collect()}
    assert got == {b: fp for b, (fp, _) in plain.sketch(want, 11, 3).items()}


def test_a_stream_is_filtered_as_a_table(spark, tmp_path):
    """Cells decide at k = 31: a hash with some of its cells set, but not all, is left out."""
    p = SketchParams(k=31, log2_buckets=4)
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(40)]
    built = index.build(spark.createDataFrame([(i, "g", s) for i, s in enumerate(seqs[:3])], "genome_id long, name string, seq string"), p)
    spark.createDataFrame([(i, "q", s) for i, s in enumerate(seqs)], "genome_id long, name string, seq string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("genome_id long, name string, seq string").parquet(f"{tmp_path}/in")
    for number, filter_ in enumerate((built.words, built.bloom)):
        out = ingest.filter_stream(ingest.sketch_stream(stream, p), filter_, p)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out{number}").option("checkpointLocation", f"{tmp_path}/state{number}").trigger(availableNow=True).start().awaitTermination()
        queries = spark.read.parquet(f"{tmp_path}/in").withColumnRenamed("genome_id", "query_id")
        want = rows(search.query_sketch(built, queries), "query_id", "bucket", "fp", "khash")
        assert rows(spark.read.parquet(f"{tmp_path}/out{number}"), "genome_id", "bucket", "fp", "khash") == want
        assert 0 < len(want) < 40 * 10


def test_counts_come_with_the_build(spark):
    seen = Observation()
    df = spark.createDataFrame([(0, "a", A), (1, "b", "ACG"), (2, "c", None), (3, "d", A[:20])], "genome_id long, name string, seq string")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    built = index.build(df, P, seen)
    after = len(jobs.getJobIdsForGroup(None))
    assert seen.get == {"genomes": 4, "short": 2, "letters": len(A) + 23, "kmers": len(A) - 11 + 9}
    assert len(jobs.getJobIdsForGroup(None)) == after and after - before <= 2  # the checkpoint's own jobs, none for the counts
    index.build(df, P)
    assert len(jobs.getJobIdsForGroup(None)) - after == after - before
    assert built.genomes.count() == 2
