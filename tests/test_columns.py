"""The packed form of an index, held against its rows."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from tessella.operators import columns, index, kmers, search
from tessella.params import SketchParams

P = SketchParams(k=11, log2_buckets=4, threshold=1)


def genomes(spark, ids, seed=3, length=300):
    rng = random.Random(seed)
    base = "".join(rng.choice("ACGT") for _ in range(length))
    rows = []
    for i in ids:
        at = rng.randrange(length - 40)
        rows.append((i, f"g{i}", base[at:] + "".join(rng.choice("ACGTNacgt") for _ in range(rng.choice([0, 20, 200])))))
    rows += [(ids[-1] + 1, "short", "ACGTAC"), (ids[-1] + 2, None, "N" * 30), (ids[-1] + 3, "é", "ACGTTGCATGTCGCATGATGCATGAGAGCTÉΩACGTTAGC"), (ids[-1] + 4, "none", None)]
    return spark.createDataFrame(rows, "genome_id long, name string, seq string").repartition(5)


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


IDS = {"dense": [*range(90)], "blocks": [*range(16_370, 16_400), 5 << 14, (5 << 14) + 16_383], "one": [7]}


@pytest.mark.parametrize("ids", IDS.values(), ids=IDS)
def test_columns_hold_the_sketch(spark, ids):
    df = genomes(spark, ids)
    built = index.build(df, P)
    want = rows(kmers.sketch(df.where(F.length("seq") >= P.k), P, "genome_id"), "genome_id", "bucket", "fp")
    assert rows(columns.to_rows(built.columns)) == want and rows(columns.to_rows(columns.of_rows(built.sketch))) == want
    places = rows(built.columns.select("block", "bucket"))
    assert len(places) == len(set(places)) == len({(g >> 14, b) for g, b, _ in want})
    meta = {r["genome_id"]: r for r in built.genomes.collect()}
    old = {r["genome_id"]: r for r in index.genome_sizes(df.where(F.length("seq") >= P.k).select("genome_id", "name", F.length("seq").cast("long").alias("n_chars")), built.sketch, P).collect()}
    assert meta == old and len(meta) == len(ids) + 2
    for by in (0, 1, 16_384, 20_001):
        assert rows(columns.to_rows(columns.moved(built.columns, by))) == [(g + by, b, f) for g, b, f in want]


def test_counts_of_columns_are_those_of_rows(spark, monkeypatch):
    df = genomes(spark, IDS["blocks"])
    built = index.build(df, P)
    by_rows = index.Index(P, built.sketch, built.genomes, built.bloom)
    queries = genomes(spark, [*range(40)], seed=3).withColumnRenamed("genome_id", "query_id")
    sketched = search.query_sketch(built, queries)
    assert rows(sketched) == rows(search.query_sketch(by_rows, queries))
    want = rows(search.match_counts(by_rows, sketched))
    assert len(want) > 1000
    assert rows(search.match_counts(built, sketched)) == want
    assert rows(search.match_counts(built, sketched, 5)) == [r for r in want if r[2] >= 5]
    # Several packs, and the join by shuffle.
    monkeypatch.setattr(columns, "PACK", 3)
    monkeypatch.setattr(columns, "SMALL", 0)
    assert rows(search.match_counts(built, sketched)) == want
    text = sketched.withColumn("query_id", F.col("query_id").cast("string"))
    assert rows(search.match_counts(built, text)) == sorted((str(a), b, c) for a, b, c in want)
    assert rows(search.search(built, queries, **search.RECORDS)) == rows(search.search(by_rows, queries, **search.RECORDS))
    # Both halves of a merged index count, whether their blocks meet or not.
    both = index.merge(built, built)
    top = max(r[0] for r in built.genomes.select("genome_id").collect()) + 1
    assert rows(search.match_counts(both, sketched)) == sorted(want + [(q, g + top, n) for q, g, n in want])


def test_counts_beyond_a_byte(spark):
    """More than 255 equal buckets of one genome, and vectors of both widths."""
    p = SketchParams(k=15, log2_buckets=11, threshold=1)
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(20_000))
    built = index.build(spark.createDataFrame([(0, "a", seq), (1, "b", seq[:9000]), (2, "c", "ACGT" * 20)], "genome_id long, name string, seq string"), p)
    queries = spark.createDataFrame([(5, seq)], "query_id long, seq string")
    got = {r["genome_id"]: r["matches"] for r in search.match_counts(built, search.query_sketch(built, queries)).collect()}
    full, part = plain.sketch(seq, 15, 11), plain.sketch(seq[:9000], 15, 11)
    assert got[0] == len(full) > 2000 and got[1] == sum(part.get(b, (None,))[0] == fp for b, (fp, _) in full.items()) > 255
    for counts in ([0, 0, 7], [1] * 50, [70_000] * 50, [0] * 99 + [1 << 20]):
        total = np.zeros(1 << 14, np.uint32)
        columns._add(total, columns._vector(np.array(counts, np.uint32)))
        assert total[: len(counts)].tolist() == counts and not total[len(counts) :].any()


def test_an_index_saved_without_rows(spark, tmp_path):
    built = index.build(genomes(spark, IDS["dense"]), P)
    index.save(built, f"{tmp_path}/i", ranges=4, rows=False)
    again = index.load(spark, f"{tmp_path}/i")
    assert rows(again.sketch) == rows(built.sketch, "genome_id", "bucket", "fp") and rows(again.bloom) == rows(built.bloom)
    queries = genomes(spark, [*range(10)]).withColumnRenamed("genome_id", "query_id").where("length(seq) > 20")
    assert rows(search.search(again, queries, **search.RECORDS)) == rows(search.search(built, queries, **search.RECORDS))
    both = index.append(again, genomes(spark, [0]))
    assert rows(search.search(both, queries, **search.RECORDS)) and both.genomes.count() == built.genomes.count() + 3


def test_no_genomes_and_no_queries(spark):
    none = spark.createDataFrame([], "genome_id long, name string, seq string")
    built = index.build(none, P)
    queries = genomes(spark, [1]).withColumnRenamed("genome_id", "query_id")
    assert built.genomes.count() == built.columns.count() == built.bloom.count() == 0
    assert search.match_counts(built, search.query_sketch(built, queries)).count() == 0
    full = index.build(genomes(spark, [1]), P)
    assert search.match_counts(full, search.query_sketch(full, queries.limit(0))).count() == 0


def test_sequences_taken_together(spark, monkeypatch):
    """Groups of every size, up to single sequences and with long ones between, give the sketches of each on its own."""
    rng = random.Random(7)
    seqs = [("".join(rng.choice("ACGTNacgt") for _ in range(rng.choice([0, 5, 11, 12, 40, 90, 300])))).encode() for _ in range(60)]
    for p in (P, SketchParams(k=21, log2_buckets=12), SketchParams(k=5, log2_buckets=30)):
        want = {}
        for i, s in enumerate(seqs):
            for bucket, (fp, h) in plain.sketch(s.decode(), p.k, p.log2_buckets).items():
                want[i, bucket] = (fp, plain.signed(h))
        for group in (1 << 18, 400, 64, 8):
            monkeypatch.setattr(kmers, "GROUP", group)
            got = {}
            for rows_, bucket, fp, h in kmers.sketches_of(seqs, p):
                for i, b, f, x in zip(rows_.tolist(), bucket.tolist(), fp.tolist(), h.tolist()):
                    assert (i, b) not in got
                    got[i, b] = (f, x)
            assert got == want


def test_a_fingerprint_of_half_the_sketches_is_dealt_out(spark, monkeypatch):
    """Row form: one key has half of all rows; no share of it is large, and the counts are the same."""
    rng = random.Random(4)
    sketch = [(g, 3, 200, 0) for g in range(4000)] + [(g, rng.randrange(16), rng.randrange(190, 200), 0) for g in range(4000)]
    stored = spark.createDataFrame(sketch, "genome_id long, bucket long, fp int, khash long").dropDuplicates(["genome_id", "bucket"]).cache()
    q = spark.createDataFrame([(f"q{i}", b, f) for i in range(9) for b, f in ((3, 200), (i, 195), (i + 1, 191))], "query_id string, bucket long, fp int")
    made = index.Index(P, stored, stored.select("genome_id").distinct(), stored.select(F.lit(0).alias("cell")))
    want = rows(search.match_counts(made, q))
    assert len(want) >= 9 * 3000
    monkeypatch.setattr(search, "HEAVY", 100)
    monkeypatch.setattr(search, "SAMPLE", 0.5)
    left, right = search.dealt(stored.select("genome_id", "bucket", "fp"), q)
    sizes = left.groupBy("bucket", "fp", "share").count()
    assert sizes.agg(F.max("count")).first()[0] <= 250 and right.where("fp = 200").count() >= 9 * 30
    assert left.count() == stored.count()
    assert rows(search.match_counts(made, q)) == want
    stored.unpersist()
