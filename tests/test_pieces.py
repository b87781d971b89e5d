"""Genomes read in splits and taken apart by many tasks."""

import gzip
import random

import pytest

from tessella import cli
from tessella.operators import exact, index, kmers, search
from tessella.params import SketchParams
from tessella.sources import fasta

P = SketchParams(k=13, log2_buckets=6, threshold=1)


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def fasta_text(rng, contigs):
    """Contigs of all sizes, some shorter than k, lines of all lengths, letters of both cases, N, headers in a row, no last line feed."""
    out = []
    for i in range(contigs):
        out += [f">c{i}"] * rng.choice([1, 1, 2])
        for _ in range(rng.choice([0, 1, 1, 6, 30])):
            out.append("".join(rng.choice("ACGTACGTACGTacgtN") for _ in range(rng.choice([0, 3, 7, 20, 70]))))
    return "\n".join(out)


@pytest.fixture()
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(fasta, "LARGE", 1)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for c, v in before.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("split, piece", [("97", 1 << 22), ("700", 50), ("13", 1 << 22)])
def test_pieces_give_what_the_whole_gives(spark, tmp_path, small_splits, monkeypatch, split, piece):
    monkeypatch.setattr(fasta, "PIECE", piece)
    rng = random.Random(int(split))
    texts = [fasta_text(rng, 12), "acgtNNacgtacgtacgt\nACGT\n" + fasta_text(rng, 3), ">x\nACG\n>y\nTTT", "ACGTTGCATGTCGCATGATGCATG", ">only", "A\n" * 60, "acgtacgtacgaACGTTTGACGATCGATCAGCTACGACTACG"]
    lines = []
    for i, text in enumerate(texts):
        path = tmp_path / (f"g {i}+%é.fa" if i == 1 else f"g{i}.fa")
        path.write_text(text)
        lines.append(str(path))
    (tmp_path / "packed").write_bytes(gzip.compress(texts[0].encode()))
    (tmp_path / "list").write_text("\n".join([*lines, f"{tmp_path}/gone", f"{tmp_path}/packed", lines[0]]))
    small_splits(split)
    whole, pieces, missing = fasta.genome_pieces_of_list(spark, f"{tmp_path}/list", P.k)
    want, _ = fasta.genomes_of_list(spark, f"{tmp_path}/list", P.k)
    # The last one is listed twice, the packed one is read whole.
    assert {r["genome_id"] for r in whole.collect()} == {8} and missing.count() == 1
    of_pieces = {}
    for r in pieces.collect():
        of_pieces.setdefault(r["genome_id"], []).append((r["start"], r["seq"], r["total"]))
    assert max(map(len, of_pieces.values())) > 10
    joined = {g: "".join(s for _, s, _ in sorted(ps)) for g, ps in of_pieces.items()}
    assert joined == {r["genome_id"]: r["seq"] for r in want.collect() if r["genome_id"] != 8}
    assert all(total == len(joined[g]) for g, ps in of_pieces.items() for _, _, total in ps)
    full = want.where("genome_id <> 8")
    assert rows(kmers.sketch_of_pieces(pieces, P)) == rows(kmers.sketch(full, P, "genome_id"))
    parts = fasta.segments_of_list(spark, f"{tmp_path}/list", P.k).where("genome_id <> 8")
    assert rows(kmers.exact_kmers(kmers.exact_of_pieces(pieces), P.k, "genome_id")) == rows(kmers.exact_kmers(parts, P.k, "genome_id"))
    blocks = exact.kmer_blocks(kmers.exact_of_pieces(pieces), P.k, "genome_id", 4)
    assert rows(blocks.groupBy("genome_id").sum("n")) == rows(kmers.exact_kmers(parts, P.k, "genome_id").groupBy("genome_id").count())
    both = index.together(index.build(whole, P), index.build_of_pieces(pieces, P))
    plain = index.build(want, P)
    assert rows(both.genomes) == rows(plain.genomes) and rows(both.bloom) == rows(plain.bloom)
    assert rows(both.sketch, "genome_id", "bucket", "fp", "khash") == rows(plain.sketch, "genome_id", "bucket", "fp", "khash")
    queries = want.selectExpr("genome_id AS query_id", "substring(seq, 5, 60) AS seq")
    assert rows(search.match_counts(both, search.query_sketch(both, queries))) == rows(search.match_counts(plain, search.query_sketch(plain, queries)))


def test_command_line_with_large_files(spark, tmp_path, small_splits):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(4000))
    (tmp_path / "a.fa").write_text(">x\n" + "\n".join(seq[i : i + 60] for i in range(0, 4000, 60)))
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n")
    (tmp_path / "q").write_text(f">q1\n{seq[500:1500]}\n")
    small_splits("300")
    base = ["-l", f"{tmp_path}/list", "-k", "15", "-h", "8", "-s", "10", "-d", f"{tmp_path}/index"]
    assert cli.main([*base, "-a", f"{tmp_path}/q", "-o", f"{tmp_path}/out"]) == 0
    assert spark.read.text(f"{tmp_path}/out").first()[0].startswith(">q1:0\t")
    assert cli.main(["-i", f"{tmp_path}/index", "-a", f"{tmp_path}/q", "-e", "-o", f"{tmp_path}/exact"]) == 0
    assert spark.read.text(f"{tmp_path}/exact").first()[0].split("\t")[2] == str(1000 - 14)
