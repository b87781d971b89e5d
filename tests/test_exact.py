"""Exact counts by merging packed sets of k-mers, held against plain sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import exact, kmers


def test_packed_sets_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [(1 << 62) - 1], [0, 1, 2], rng.integers(0, 1 << 62, 5000), rng.integers(0, 300, 200), [1 << 63, (1 << 64) - 1]):
        values = np.unique(np.array(values, np.uint64))
        assert exact.unpacked_set(exact.packed_set(values)).tolist() == values.tolist()
    dense = np.arange(10_000, dtype=np.uint64) * np.uint64(7)
    assert len(exact.packed_set(dense)) == 10_001
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        assert exact.in_both(a, b) == len(set(a.tolist()) & set(b.tolist()))


def every(seq, k):
    flip = str.maketrans("ACGT", "TGCA")
    out = set()
    for i in range(len(seq) - k + 1):
        s = seq[i : i + k].upper()
        out.add(min(s, s[::-1].translate(flip)) if set(s) <= set("ACGT") else "A" * k)
    return out


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_exact_counts_equal_plain_sets(spark, monkeypatch, block):
    """Sets in one part and in many; genomes of several segments, of repeats, with other letters; pieces of a sequence."""
    monkeypatch.setattr(exact, "BLOCK", block)
    monkeypatch.setattr(kmers, "PIECE", 50)
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(4)]
    segments = [(g, part) for g in range(6) for part in (base[g % 4][g * 9 :], base[(g + 1) % 4][:80].lower(), "ACG", "N" * 30 if g == 2 else "ACGT" * 20, None)]
    queries = [(q, s) for q, s in enumerate([base[0][20:90], base[1], base[2][:15] + "N" + base[2][16:60], "T" * 40, base[3][100:120] * 3])]
    pairs = [(q, g, 1.5) for q in range(5) for g in range(6) if (q + g) % 4] + [(0, 99, 0.0)]
    got = exact.exact_counts(
        spark.createDataFrame(pairs, "query_id long, genome_id long, jaccard double"),
        spark.createDataFrame(queries, "query_id long, seq string"),
        spark.createDataFrame(segments, "genome_id long, seq string").repartition(7), 15,
    )
    rows = {(r["query_id"], r["genome_id"]): (r["n_query"], r["n_genome"], r["inter"], r["union_size"], round(r["real_jaccard"], 12), r["jaccard"]) for r in got.collect()}
    of_genome = {g: set().union(*(every(s, 15) for h, s in segments if h == g and s)) for g in range(6)}
    want = {}
    for q, g, _ in pairs:
        a, b = every(queries[q][1], 15), of_genome.get(g, set())
        if a & b:
            want[q, g] = (len(a), len(b), len(a & b), len(a | b), round(len(a & b) / len(a | b), 12), 1.5)
    assert rows == want and len(want) > 8


def test_no_pairs(spark):
    none = spark.createDataFrame([], "query_id long, genome_id long")
    seqs = spark.createDataFrame([(1, "ACGT" * 9)], "query_id long, seq string")
    assert exact.exact_counts(none, seqs, seqs.withColumnRenamed("query_id", "genome_id"), 11).count() == 0
    blocks = exact.kmer_blocks(seqs, 11, "query_id", 8)
    assert blocks.agg(F.sum("n")).first()[0] == len(every("ACGT" * 9, 11))
