"""Lists of many files: looked up by Spark in bulk, not path by path by the driver."""

from __future__ import annotations

import gzip

from tessella.sources import fasta


def test_listed_files_are_not_asked_for_one_by_one(spark, tmp_path, monkeypatch):
    paths = []
    for i in range(40):
        (tmp_path / f"part={i}").mkdir()
        path = tmp_path / f"part={i}" / ("g.fa" if i % 2 else "g.fa.gz")
        text = f">g{i}\n{'ACGT' * 5}\n{'ACGTTGCA'[i % 8] * 7}\n".encode()
        path.write_bytes(text if i % 2 else gzip.compress(text))
        paths.append(f"file:{path}" if i % 3 else f"file://{path}")
    (tmp_path / "list").write_text("\n".join(paths))
    calls = []
    of = fasta._file
    monkeypatch.setattr(fasta, "_file", lambda *a: calls.append(a) or of(*a))
    whole, pieces, missing = fasta.genome_pieces_of_list(spark, f"file:{tmp_path}/list", 11)
    got = {r["genome_id"]: (r["name"], r["seq"]) for r in whole.collect()}
    assert got == {i: (p, "ACGT" * 5 + "ACGTTGCA"[i % 8] * 7) for i, p in enumerate(paths)}
    assert pieces.isEmpty() and missing.isEmpty()
    assert not calls


def test_missing_files_are_still_told(spark, tmp_path):
    (tmp_path / "a[1].fa").write_text(">a\nACGTACGTACGTA\n")
    lines = [f"file:{tmp_path}/a[1].fa", f"file:{tmp_path}/gone.fa", f"{tmp_path}/./a[1].fa"]
    (tmp_path / "list").write_text("\n".join(lines))
    genomes, missing = fasta.genomes_of_list(spark, f"{tmp_path}/list", 11)
    assert sorted((r["genome_id"], r["name"]) for r in genomes.collect()) == [(0, lines[0]), (2, lines[2])]
    assert [(r["id"], r["path"]) for r in missing.collect()] == [(1, lines[1])]
