"""Every query of documents over very long texts and words, repeated rows, nulls and columns of clashing names."""

import hashlib
import random
import re

import pytest

from tessella.llm import queries

CLASHES = "key, n, class, gram, word, text_, score, kept, labels, part, slice, node, label, id, form, predicted, fingerprint, spans, place, row"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(120_000))
    run = "".join(rng.choice("abcdefghij") for _ in range(400_000))
    rows = [(0, long), (1, long), (2, f"{long} tail"), (3, run), (4, f"{run} {run}"), (5, "x\n" * 200_000), (6, None), (7, ""), (7, ""), (None, "a short text of some words"), (8, "=" * 300_000)]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(80)) + ".") for i in range(30)]
    d = str(tmp_path_factory.mktemp("long"))
    names = [c.strip() for c in CLASHES.split(",")]
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(names):
        df = df.selectExpr("*", f"{k} AS `{name}`" if k % 2 else f"'clash' AS `{name}`")
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(20 + i, i % 2, (i // 2) % 2, "x") for i in range(30)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    return d, rows


@pytest.mark.parametrize("name", [q for q in sorted(queries.queries()) if q.split("_")[0] in ("op1", "op3", "op4", "op5", "op6", "op7", "op8", "op10", "op11")])
def test_one_row_for_each_document(spark, folder, name):
    d, rows = folder
    got = queries.queries()[name](spark, d).collect()
    key = lambda i: -1 if i is None else i
    assert sorted(key(r["doc_id"]) for r in got) == sorted(key(i) for i, _ in rows)
    by = {r["doc_id"]: r for r in got}
    space = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    if name.startswith("op5"):
        assert (by[0]["n_removed"], by[1]["n_removed"], by[2]["n_removed"], by[3]["n_removed"]) == (0, 120_000, 120_000, 0)
        assert by[2]["kept_sha256"] == hashlib.sha256(b"tail").hexdigest() and by[5]["n_removed"] == 0
    if name.startswith("op8"):
        assert by[1]["component_id"] == by[2]["component_id"] == 0 and by[5]["n_shingles"] == 1 and by[4]["component_id"] == 4
    if name.startswith("op3"):
        assert all(by[i]["n_words"] == len(space(t)) for i, t in rows) and by[5]["n_dup_lines"] == 199_999 and by[8]["word_chars"] == 300_000
    if name.startswith("op4"):
        assert by[0]["fingerprint"] == by[1]["fingerprint"] and by[3]["n_chars"] == 400_000
    if name.startswith("op6"):
        assert by[0]["n_tokens"] == 120_001 and by[6]["n_tokens"] == 1 and by[0]["score"] < 0
    if name.startswith("op1_"):
        assert by[0]["n_words"] == 120_000 and by[3]["n_words"] == 1
    if "score" in by[0]:
        assert by[6]["score"] == by[7]["score"]


def test_words_of_spelling_and_pieces_of_packing(spark, folder):
    d, rows = folder
    words = {r["word"]: r["n"] for r in queries.queries()["op13_spelling_variants"](spark, d).collect()}
    run = dict(rows)[3]
    assert words == {} or all(7 <= len(w) for w in words)
    assert run not in words or words[run] >= 2
    pieces = queries.queries()["op2_packing"](spark, d).collect()
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == {i for i, _ in rows} and all(total[r["doc_id"]] >= r["doc_tokens"] for r in pieces)
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
