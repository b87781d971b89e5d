import gzip
import os
import random
import time
import zlib

import plain
from pyspark.sql import functions as F

from tessella import cli
from tessella.operators import bloom, exact, index, kmers, search
from tessella.params import SketchParams
from tessella.sources import fasta, sinks
from tessella.streaming import ingest

P = SketchParams(k=11, log2_buckets=3, threshold=4)
A = "ACGTTGCATGTCGCATGATGCATGAGAGCTACGTTAGC"
#: Known sketches (255: empty) of variants of A.
KNOWN = {
    A: [252, 248, 213, 247, 235, 255, 239, 234],
    A[:20] + "N" + A[21:]: [252, 239, 213, 253, 245, 226, 236, 234],
    A[:10].lower() + A[10:]: [252, 248, 213, 247, 235, 255, 239, 234],
    A.lower(): [246, 251, 219, 233, 243, 255, 250, 255],
    "N" + A[1:]: [231, 250, 213, 247, 232, 255, 239, 236],
}


def sequences(n=60, seed=4):
    rng = random.Random(seed)
    out = [A, A[:12], A[:11], A[:10], "", "N" * 40, "a" * 40, None]
    for _ in range(n):
        letters = rng.choice(["ACGT", "ACGTN", "ACGTacgtN"])
        out.append("".join(rng.choice(letters) for _ in range(rng.randint(5, 120))))
    return out


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"g{i}", s) for i, s in enumerate(seqs)], "genome_id long, name string, seq string")


def sketch_rows(df):
    return sorted((r["genome_id"], r["bucket"], r["fp"], r["khash"]) for r in df.collect())


def test_known_sketches(spark):
    for seq, fps in KNOWN.items():
        got = plain.sketch(seq, 11, 3)
        assert [got.get(b, (255,))[0] for b in range(8)] == fps


def test_both_sketches_equal_the_plain_one(spark):
    seqs = sequences()
    want = sorted((i, b, fp, plain.signed(h)) for i, s in enumerate(seqs) if s for b, (fp, h) in plain.sketch(s, 11, 3).items())
    df = frame(spark, seqs)
    assert sketch_rows(kmers.sketch(df, P, "genome_id")) == want
    assert sketch_rows(kmers.sketch_by_sql(df, P, "genome_id")) == want
    assert sketch_rows(kmers.sketch(df.repartition(7), P, "genome_id")) == want


def test_long_sequences_are_sketched_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(900)).encode()
    whole = [x.tolist() for x in kmers.sketch_of(seq, P)]
    monkeypatch.setattr(kmers, "PIECE", 64)
    assert [x.tolist() for x in kmers.sketch_of(seq, P)] == whole


def test_kmers(spark):
    seqs = sequences()
    got = sorted((r["genome_id"], r["pos"], r["canon"]) for r in kmers.sketch_kmers(frame(spark, seqs), 11, "genome_id").collect())
    assert got == sorted((i, p, x) for i, s in enumerate(seqs) if s for p, x in enumerate(plain.kmers(s, 11)))


def test_index_sizes_merge_save_and_load(spark, tmp_path):
    seqs = [s for s in sequences() if s]
    built = index.build(frame(spark, seqs), P)
    rows = {r["genome_id"]: r for r in built.genomes.collect()}
    for i, s in enumerate(seqs):
        if len(s) < 11:
            assert i not in rows
            continue
        fps = [fp for fp, _ in plain.sketch(s, 11, 3).values()]
        total = sum(2.0 ** -(fp >> 3) for fp in fps)
        raw = 0.72134 * len(fps) ** 2 / total if total else 0
        assert rows[i]["sketch_size"] == len(fps) and rows[i]["genome_size"] == (len(s) if raw > len(s) else int(raw))
    index.save(built, str(tmp_path / "i"))
    again = index.load(spark, str(tmp_path / "i"), threshold=9.7)
    assert again.params.threshold == 9 and sketch_rows(again.sketch) == sketch_rows(built.sketch)
    both = index.append(built, frame(spark, [A]))
    new = max(rows) + 1
    assert {r["genome_id"] for r in both.genomes.collect()} == {*rows, new}
    assert {r["cell"] for r in both.bloom.collect()} >= {r["cell"] for r in built.bloom.collect()}


def test_bloom_is_a_set_of_cells(spark):
    p = SketchParams(k=31, log2_buckets=3)
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(3)]
    other = "".join(rng.choice("ACGT") for _ in range(200))
    built = index.build(frame(spark, seqs), p)
    want = {plain.probe(h, i) >> 36 for s in seqs for _, h in plain.sketch(s, 31, 3).values() for i in range(5)}
    cells = {r["cell"] for r in built.bloom.collect()}
    assert cells == want
    queries = spark.createDataFrame([(0, seqs[0]), (1, other)], "query_id long, seq string")
    kept = {(r["query_id"], r["bucket"]) for r in search.query_sketch(built, queries).collect()}
    assert kept == {
        (q, b) for q, s in ((0, seqs[0]), (1, other)) for b, (_, h) in plain.sketch(s, 31, 3).items() if all(plain.probe(h, i) >> 36 in want for i in range(5))
    }
    assert bloom.bloom_cells(built.sketch, p).count() == len(want)


def test_search_and_exact_counts(spark):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(6)]
    p = SketchParams(k=15, log2_buckets=6, threshold=20)
    built = index.build(frame(spark, seqs), p)
    queries = spark.createDataFrame([(0, ">a", seqs[2][50:300]), (1, ">b", seqs[4]), (2, ">c", "ACGT" * 30)], "query_id long, header string, seq string")
    hits = search.search(built, queries, **search.RECORDS)
    rows = {(r["query_id"], r["genome_id"]): r for r in hits.collect()}
    assert rows[0, 2]["rank"] == 1 and rows[1, 4]["matches"] == len(plain.sketch(seqs[4], 15, 6))
    for (q, g), r in rows.items():
        a, b = (plain.sketch(x, 15, 6) for x in ({0: seqs[2][50:300], 1: seqs[4]}.get(q, "ACGT" * 30), seqs[g]))
        assert r["matches"] == sum(b.get(k, (None,))[0] == v[0] for k, v in a.items())
    checked = exact.exact_counts(hits, queries, built.genomes.join(frame(spark, seqs).select("genome_id", "seq"), "genome_id").select("genome_id", "seq"), 15)
    full = {(r["query_id"], r["genome_id"]): r for r in checked.collect()}

    def every(s):
        flip = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        n = len(s)
        return {min(s[i : i + 15], flip[n - i - 15 : n - i]) for i in range(n - 14)}

    x, y = every(seqs[2][50:300]), every(seqs[2])
    assert full[0, 2]["inter"] == len(x & y) and full[0, 2]["union_size"] == len(x | y)
    report = {r["metric"]: r for r in exact.accuracy(checked).collect()}
    assert set(report) == {"jaccard", "intersection"} and report["jaccard"]["n"] == len(full)
    lines = {r["query_id"]: r["line"] for r in sinks.approximate_lines(queries, hits, empty=True).collect()}
    assert lines[2] == ">c:" and lines[1].startswith(f">b:4\t{rows[1, 4]['matches']}\t")
    assert sinks.exact_lines(checked.join(queries.select("query_id", "header"), "query_id").join(built.genomes.select("genome_id", "name"), "genome_id")).count() == len(full)


def test_collisions(spark):
    one = spark.createDataFrame([(1,), (2,), (2,)], "v long")
    other = spark.createDataFrame([(2,), (2,), (3,)], "v long")
    assert exact.multiset_collisions(one, other, "v").first()[0] == 2
    assert exact.set_collisions(one, other, "v").first()[0] == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(f">x\n{A}\n>y\n{A[:20]}\nACG\n")
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(f">x\n{A[:5]}\n".encode()) + gzip.compress(f">z\n{A}".encode()))
    (tmp_path / "c").write_bytes(zlib.compress(f">h\n{A}\nACGT\nTTTTTTTTTTTTT\n".encode()))
    listing = tmp_path / "list"
    listing.write_text("\n".join([str(tmp_path / "a.fa"), "xx", str(tmp_path / "gone"), str(tmp_path / "b.fa.gz"), str(tmp_path / "c"), ""]))
    genomes, missing = fasta.genomes_of_list(spark, str(listing), 11)
    got = {r["genome_id"]: r["seq"] for r in genomes.collect()}
    assert got == {0: A + A[:20] + "ACG", 2: A[:5] + A, 3: A + "ACGT" + "T" * 13}
    assert [r["id"] for r in missing.collect()] == [1]
    parts = sorted((r["genome_id"], r["seq"]) for r in fasta.segments_of_list(spark, str(listing), 11).collect())
    assert parts == sorted([(0, A), (0, A[:20] + "ACG"), (2, A[:5] + A), (3, A + "ACGT" + "T" * 13)])
    whole, _ = fasta.file_queries(spark, str(listing), 11)
    assert {r["query_id"] for r in whole.collect()} == {0, 2, 3}
    exacts, _ = fasta.file_queries(spark, str(listing), 11, exact=True)
    assert {r["query_id"]: (r["header"], r["seq"]) for r in exacts.collect()}[3] == (">h", A + "T" * 13)
    (tmp_path / "q").write_text(f">q1\n{A}\n>q2\nACG\n>q3\nxCGTTGCATGTCG\n")
    rows = fasta.records(spark, str(tmp_path / "q"), 11)
    assert [(r["query_id"], r["header"]) for r in rows.orderBy("query_id").collect()] == [(0, ">q1"), (2, ">q3")]
    assert fasta.records(spark, str(tmp_path / "q"), 11, exact=True).count() == 1
    assert fasta.genome_of_file(spark, str(tmp_path / "a.fa"), 11).count() == 1


def test_paths_in_lists_as_users_write_them(spark, tmp_path, monkeypatch):
    """Relative, repeated, with a scheme, with characters of patterns; the same for queries and segments."""
    from pathlib import Path

    here = Path(spark.sparkContext._jvm.java.lang.System.getProperty("user.dir"))
    folder = os.path.relpath(tmp_path, here)
    for name, seq in (("a.fa", A), ("b[1]*.fa", A[5:]), ("c d.fa", A[9:])):
        (tmp_path / name).write_text(f">x\n{seq}\n")
    lines = [f"{folder}/a.fa", f"{tmp_path}/a.fa", f"file://{tmp_path}/a.fa", f"{folder}/./b[1]*.fa", f"{folder}/gone.fa", f"{tmp_path}/c d.fa", f"{folder}/a.fa"]
    (tmp_path / "list").write_text("\n".join(lines))
    want = {0: A, 1: A, 2: A, 3: A[5:], 5: A[9:], 6: A}
    for many in (16, 2):
        monkeypatch.setattr(fasta, "MANY", many)
        genomes, missing = fasta.genomes_of_list(spark, f"{tmp_path}/list", 11)
        assert sorted((r["genome_id"], r["name"], r["seq"]) for r in genomes.collect()) == sorted((i, lines[i], s) for i, s in want.items())
        assert [(r["id"], r["path"]) for r in missing.collect()] == [(4, lines[4])]
        assert sorted((r["genome_id"], r["seq"]) for r in fasta.segments_of_list(spark, f"{tmp_path}/list", 11).collect()) == sorted(want.items())
        queries, gone = fasta.file_queries(spark, f"{tmp_path}/list", 11)
        assert {r["query_id"]: (r["header"], r["seq"]) for r in queries.collect()} == {i: (lines[i], s) for i, s in want.items()} and gone.count() == 1
    whole = fasta.read_whole(spark, [lines[0], lines[4], lines[0]]).collect()
    assert [r["path"] for r in whole] == [lines[0]] * 2


def test_missing_inputs_count_as_empty(spark, tmp_path, caplog):
    gone = f"{tmp_path}/gone"
    assert fasta.records(spark, gone, 11).count() == 0 and fasta.genome_of_file(spark, gone, 11).count() == 0
    assert fasta.genomes_of_list(spark, gone, 11)[0].count() == 0 and fasta.segments_of_list(spark, gone, 11).count() == 0
    (tmp_path / "a.fa").write_text(f">x\n{A}\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/none\n")
    base = ["-l", f"{tmp_path}/list", "-k", "11", "-h", "8", "-s", "10"]
    assert cli.main([*base, "-a", gone, "-o", f"{tmp_path}/out"]) == 0 and spark.read.text(f"{tmp_path}/out").count() == 0
    assert gone in caplog.text and f"{tmp_path}/none" in caplog.text
    caplog.clear()
    assert cli.main(["-l", gone, "-k", "11", "-h", "8", "-A", f"{tmp_path}/list", "-o", f"{tmp_path}/out2"]) == 0
    assert gone in caplog.text and f"{tmp_path}/none" in caplog.text


def test_many_records_in_splits(spark, tmp_path):
    """A hundred thousand records over many splits, plain and compressed alike."""
    rng = random.Random(3)
    lines = [f">r{i} \r" if i % 3 else f">r{i}" for i in range(100_000)]
    seqs = ["".join(rng.choice("ACGTNx") for _ in range(rng.choice([0, 5, 30]))) for _ in lines]
    text = "\n".join(x for pair in zip(lines, seqs) for x in pair)
    (tmp_path / "plain").write_bytes(text.encode())
    (tmp_path / "packed").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "odd").write_text(f">a\n{A}\n>b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    began = time.perf_counter()
    for name in ("plain", "packed"):
        got = {r["query_id"]: (r["header"], r["seq"]) for r in fasta.records(spark, f"{tmp_path}/{name}", 5).collect()}
        assert got == {i: (h, s) for i, (h, s) in enumerate(zip(lines, seqs)) if len(s) >= 5}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert time.perf_counter() - began < 60
    assert [tuple(r) for r in fasta.records(spark, f"{tmp_path}/odd", 5).collect()] == [(0, ">a", A)]


def test_segments_take_time_in_proportion(spark):
    text = ">h\n" + (A + "\n") * 200_000 + ">i\nAC\n>j\n" + A
    began = time.perf_counter()
    assert [len(s) for s in fasta.segments(text, 11)] == [200_000 * len(A), 2 + len(A)]
    assert time.perf_counter() - began < 10


def test_a_saved_index_is_read_by_bucket_range(spark, tmp_path):
    rng = random.Random(5)
    p = SketchParams(k=15, log2_buckets=10, threshold=1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(4)]
    built = index.build(frame(spark, seqs), p)
    index.save(built, str(tmp_path / "i"), ranges=64)
    again = index.load(spark, str(tmp_path / "i"))
    assert sketch_rows(again.sketch) == sketch_rows(built.sketch)
    every = len(again.sketch.inputFiles())
    queries = spark.createDataFrame([(0, seqs[2][100:118])], "query_id long, seq string")
    sketched = search.query_sketch(again, queries)
    buckets = {r["bucket"] for r in sketched.collect()}
    few = search.stored_for(again, sketched)
    read = {r[0] for r in few.select(F.input_file_name()).distinct().collect()}
    assert every >= 64 and len(read) <= len(buckets) <= 4 and "PartitionFilters: [bucket_range" in few._jdf.queryExecution().toString()
    assert sorted(map(tuple, search.match_counts(again, sketched).collect())) == sorted(map(tuple, search.match_counts(built, search.query_sketch(built, queries)).collect()))
    assert sketch_rows(index.merge(again, again).sketch)[: len(sketch_rows(built.sketch))] == sketch_rows(built.sketch)


def test_kernels_equal_their_sql_forms(spark, monkeypatch):
    df = frame(spark, sequences()).select("genome_id", F.col("seq"))
    for piece in (1 << 21, 16):
        monkeypatch.setattr(kmers, "PIECE", piece)
        for kernel, by_sql in ((kmers.sketch_kmers, kmers.sketch_kmers_by_sql), (kmers.exact_kmers, kmers.exact_kmers_by_sql)):
            a, b = (sorted(map(tuple, f(df, 11, "genome_id").collect())) for f in (kernel, by_sql))
            assert a == b and a


def test_command_line(spark, tmp_path):
    (tmp_path / "a.fa").write_text(f">x\n{A}\n")
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n")
    (tmp_path / "q").write_text(f">q1\n{A}\n")
    at = str(tmp_path)
    base = ["-l", f"{at}/list", "-k", "11", "-h", "8", "-s", "10", "-d", f"{at}/index"]
    assert cli.main([*base, "-a", f"{at}/q", "-o", f"{at}/out"]) == 0
    assert spark.read.text(f"{at}/out").first()[0].startswith(">q1:0\t")
    assert cli.main(["-i", f"{at}/index", "-a", f"{at}/q", "-e", "-o", f"{at}/exact"]) == 0
    assert spark.read.text(f"{at}/exact").first()[0].split("\t")[2] == "28"
    assert cli.main([]) == 0


def test_streaming_ingest(spark, tmp_path):
    frame(spark, [A, A[5:]]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("genome_id long, name string, seq string").parquet(f"{tmp_path}/in")
    ingest.grow(stream, P, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    grown = ingest.load_grown(spark, f"{tmp_path}/index", P)
    assert sketch_rows(grown.sketch) == sketch_rows(kmers.sketch(frame(spark, [A, A[5:]]), P, "genome_id"))
    assert grown.genomes.count() == 2 and grown.bloom.count() > 0
    assert ingest.sketch_stream(stream, P).isStreaming and ingest.filter_stream(ingest.sketch_stream(stream, P), grown.bloom, P).isStreaming
    assert F.col("x") is not None
