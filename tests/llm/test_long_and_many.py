"""Long words, texts of many detections, and license results by brute force over all rules."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, licenses


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_any_length(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    encoder = bpe.Encoder(path)
    assert encoder.merges.ascending
    rng = random.Random(1)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    abc = "abcdefghijklmnopqrstuvwxyz"
    rows = [run(abc, n) for n in (255, 256, 257, 258, 4000)] + ["a" * n for n in (257, 1000, 1001)] + ["ab" * 900, "aab" * 700, "aaab" * 500, "é" * 400, "漢" * 300, run("etaoin", 3000)]
    rows += [f"{run(abc, 300)} {run(abc, 700)} short {'q' * 301}", run("ab", 2000), "thequickbrown" * 90, run(abc + "éüß", 900), "=" * 600 + run("+/0123", 500)]
    for t, ids in zip(rows, encoder.encode(rows)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]
    long = run(abc, 1_000_000)
    began = time.perf_counter()
    ids = np.frombuffer(encoder.encode([long])[0], "<u4").tolist()
    assert time.perf_counter() - began < 30
    assert ids == library.encode(long, add_special_tokens=False).ids


def test_both_kinds_of_rounds_agree():
    merges = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json")).merges
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeet") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)]
    assert merges.encode_long(words) == merges.encode_short(words)


def plain_scan(text, scanner):
    """Words, base places, and what stays of all rules' matches when each is held against all that were kept before it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    norm = " ".join(words).encode().decode("latin-1")  # places of rules are byte places
    found = [(m.start(), m.end(), i) for i, c in enumerate(scanner.compiled) for m in c.finditer(norm)]
    found.sort(key=lambda d: (scanner.rules[d[2]].priority, -(d[1] - d[0]), d[0], d[2]))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    base = [(label, at) for phrase, label in licenses.PHRASES for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
    return words, base, [(scanner.rules[i].name, scanner.rules[i].label, norm[:a].count(" "), norm[:b].count(" ") + 1, scanner.rules[i].confidence) for a, b, i in sorted(kept)]


def license_texts(n=150, seed=2):
    rng = random.Random(seed)
    scanner = licenses.Scanner()
    bits = [k for r in scanner.rules for k in r.keywords]
    bits += ["mit license", "Apache License", "general public license", "Licensed under the", "SPDX-License-Identifier: MIT", "version 2.0", "v3", "GNU", "or later", "and", "Ünïcode", "of the",
             "GNU Lesser General Public License version 2.1", "released under the terms of the BSD 3-clause license", "do what the fuck you want to public license", "All rights reserved", "may not be copied without prior written permission"]
    return [rng.choice([" ", ", ", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_licenses_equal_all_rules_without_prefilter(spark, tmp_path):
    rows = [*license_texts(), None, "", "plain words only", "mit license " * 30, "x" * 300_000 + " mit license"]
    data = [(i, t, "clash", 0.5) for i, t in enumerate(rows)] + [(None, rows[0], "clash", 0.5), (3, rows[3], "clash", 0.5)]
    spark.createDataFrame(data, "doc_id long, text string, labels string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    scanner = licenses.Scanner()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spans = [(r["doc_id"], [tuple(f[c] for c in ("rule", "label", "word", "end_word", "confidence")) for f in r["found"]]) for r in licenses.scan_licenses(docs).collect()]
    got = licenses.op1_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(spans) == len(data)
    many = 0
    for r in got:
        words, base, found = plain_scan(rows[r["doc_id"] or 0], scanner)
        places = sorted(at for _, at in base)
        miss = float(np.prod([1 - c for *_, c in found])) * (0.3 if base else 1)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(base), places[0] if places else None, places[-1] if places else None)
        assert r["base_labels"] == ",".join(sorted({b for b, _ in base})) and r["labels"] == ",".join(sorted({b for b, _ in base} | {f[1] for f in found}))
        assert abs(r["score"] - (1 - miss)) < 1e-9 and r["n_found"] == len(found)
        many += len(found)
    assert many > 100
    for key, found in spans:
        assert found == plain_scan(rows[key or 0], scanner)[2]


def test_many_detections_take_time_in_proportion():
    scanner = licenses.Scanner()
    norm = b" ".join([b"mit license", b"filler words"] * 100_000)
    found = scanner.detections(norm.decode("latin-1"))
    began = time.perf_counter()
    (starts, ends), blanks = licenses.word_places(norm, [a for a, _, _ in found], [b for _, b, _ in found]), norm.count(b" ")
    assert time.perf_counter() - began < 2 and len(found) >= 100_000
    assert starts[0] == 0 and starts[1] == 4 and ends[0] == 1 and max(ends) <= blanks


def test_urls_that_end_in_a_line_feed(spark, tmp_path):
    """A pattern's end is the very end of a URL, in the query as in its SQL."""
    import duckdb

    from tessella.llm import url_filters

    paths = ["/login", "/login\n", "/robots.txt", "/robots.txt\n", "/a/poker", "/a/poker\n", "/cart?x=$", "\n", ""]
    rows = [(i, f"http://site.org{p}", "x", "clash", "clash") for i, p in enumerate(paths)] + [(90, None, None, "", ""), (None, "HTTP://EXAMPLE.com/EN/", None, "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, pattern string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in url_filters.op9_url_filters(spark, str(tmp_path)).collect()}
    assert [got[i]["verdict"] for i in range(6)] == ["block", "allow", "block", "allow", "block", "block"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = [c[0] for c in con.execute(url_filters.oracle()).description]
    want = {r[names.index("page_id")]: dict(zip(names, r)) for r in con.execute(url_filters.oracle()).fetchall()}
    assert {k: r.asDict() for k, r in got.items()} == want


def test_null_texts_keep_their_length(spark):
    from tessella.llm import substrings

    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, 5), (2, f"x {words}", 9), (3, None, 7), (4, "", 8)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substrings.stage_substrings(spark, docs, "").collect()}
    assert got == {1: (words, len(words)), 2: ("x ", 2), 3: (None, 7), 4: ("", 0)}
