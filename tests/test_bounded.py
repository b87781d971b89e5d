"""Kernels that hold a bounded part of what a task reads, and sets that travel only where they have to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import columns, exact, index, kmers
from tessella.params import SketchParams


def test_slices_of_columns_are_bounded():
    rows = pa.RecordBatch.from_arrays([pa.array([b"x" * 1000] * 50 + [None, b"y" * 9000, b""], pa.binary())], names=["fps"])
    cut = list(columns.by_bytes([rows], "fps", 4000))
    assert sum(x.num_rows for x in cut) == 53 and [r for x in cut for r in x.column("fps").to_pylist()] == rows.column("fps").to_pylist()
    assert max(sum(len(r or b"") for r in x.column("fps").to_pylist()) for x in cut if x.num_rows > 1) <= 13_000


def test_ids_of_many_blocks_and_filter_words_once_a_task(spark):
    params = SketchParams(k=31, log2_buckets=8, threshold=1)
    rng = np.random.default_rng(5)
    seqs = [(i << 14 | i % 7, f"g{i}", "".join("ACGT"[b] for b in rng.integers(0, 4, 60 + i % 50))) for i in range(3000)]
    genomes = spark.createDataFrame(seqs, "genome_id long, name string, seq string").coalesce(1)
    made = columns.parts(genomes, params).cache()
    want = sorted(map(tuple, kmers.sketch_by_sql(genomes, params, "genome_id").select("genome_id", "bucket", "fp").collect()))
    assert sorted(map(tuple, columns.to_rows(columns.packed(made)).collect())) == want
    words = made.where(F.col("kind") == columns.WORD).select("a").collect()
    assert len(words) == len({r[0] for r in words})
    built = index.build(genomes, params)
    assert sorted(r[0] for r in built.bloom.collect()) == sorted(r[0] for r in index.blooms.bloom_cells(built.sketch, params).collect())


def test_kmer_summary_counts_in_place(spark, monkeypatch):
    k = 11
    seqs = [(1, "ACGTTGCATTACG" * 3), (2, "ACGNTGCATTACGACCA"), (3, "ACG"), (4, None), (5, "ACGTTGCATTACGAA"), (5, "TTACGAAGGCATTAC"), (None, "ACGTTGCATTACG"), (None, "GGGTTGCATTACG")]
    rows = spark.createDataFrame(seqs, "genome_id long, seq string")
    moved = []
    of = exact.kmer_blocks
    monkeypatch.setattr(exact, "kmer_blocks", lambda seqs, *a: moved.append(seqs) or of(seqs, *a))
    got = exact.kmer_summary(rows, k, "genome_id")
    want = kmers.exact_kmers_by_sql(rows, k, "genome_id").groupBy("genome_id").agg(F.count("*"), F.min("canon"), F.max("canon"))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert sorted(r["seq"] for r in moved[0].collect()) == sorted(s for i, s in seqs if i in (5, None))


def test_only_sets_of_several_rows_carry_their_names(spark):
    from tessella.llm import jaccard_join as jj

    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:3])], "key long, text string").repartition(4, "key")
    names = [jj.class_of(jj.set_of(t.encode(), jj.WordHashes())) for t in texts[:3]]
    first = np.array([int.from_bytes(n[:8], "big") for n in names], np.uint64)
    copied = np.zeros(1 << (jj.COPY_BITS - 6), np.uint64)
    slot = first >> np.uint64(64 - jj.COPY_BITS)
    np.bitwise_or.at(copied, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    sent = jj.sent_grams(docs, 2, 40, np.empty(0, np.uint64), copied)
    told = [t["tags"] for t in sent.where("tags IS NOT NULL").collect()]
    found = {t[4 + 4 * m + 8 * i :][:8] for t in told for m in [int.from_bytes(t[:4], "little")] for i in range(m)}
    assert found == {n[:8] for n in names}
    # Shingles of copies are counted once, so that no shingle is shared.
    assert jj.prefixes(jj.counted_grams(sent), 40).count() == 0
