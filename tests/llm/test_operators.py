"""Each operator on small hand-made tables, held against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, common, elias_fano, fingerprints, graph, jaccard_join, language_model, licenses, packing, quality, substrings, toxicity, url_filters

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "Übung", "año"]


def texts(seed=1, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    near = [t.replace("w3 ", "q3 ", 1) for t in base[:12]]
    glued = [base[i] + " " + base[i + 1] for i in range(6)]
    odd = [None, "", " \n\t ", "one", "a\x1cb \x0b c", "word " * 3000, "line\nline\nother line\nline", "The MIT License, then the mit license."]
    return base + near + glued + odd + base[:4]


def documents(spark, rows=None, doc_ids=None):
    rows = texts() if rows is None else rows
    ids = range(len(rows)) if doc_ids is None else doc_ids
    data = [(i, t, "en", f"src{n % 3}" if n % 7 else None, len(t or ""), 1, 2) for n, (i, t) in enumerate(zip(ids, rows))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, key int, class int").repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def space_words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables as the queries read them, with a null doc_id and a null label."""
    d = str(tmp_path_factory.mktemp("tables"))
    documents(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    documents(spark).limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def test_licenses(spark, folder):
    rows = [*texts(), "see MIT license; Apache License Version 2.0 and GNU General Public License v3", "x general public license general public licenses mit-license"]
    got = by_id(licenses.scan_licenses(documents(spark, rows)))
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    for i, t in enumerate(rows):
        w = [x.lower() if x.isascii() else x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
        places = sorted((n, at) for n, (p, _) in enumerate(phrases) for at in range(len(w)) if w[at : at + len(p)] == p)
        assert got[i]["n_words"] == len(w)
        assert sorted((b["phrase"], b["word"]) for b in got[i]["base"]) == places
    labels = {x["label"] for x in got[len(rows) - 2]["found"]}
    assert {"mit", "apache-2.0", "gpl-3.0"} <= labels and "gpl" not in labels
    r = by_id(licenses.op1_license_scan(spark, folder))[len(texts()) - 5]
    assert (r["n_base"], r["base_labels"], r["first_word"], r["last_word"]) == (2, "mit", 1, 5) and 0 < r["score"] <= 1
    assert len(licenses.rules()) > 300


def test_every_alternative_of_a_license_rule_contains_a_keyword():
    """Texts of each alternative of each rule, so that the prefilter finds what all rules find."""
    from re import _parser

    def examples(parsed):
        """Matches that take every branch and option at least once."""
        out = [""]
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                kind, first = arg[0]
                more = ["1"] if str(kind) == "CATEGORY" else [chr(first if str(kind) == "LITERAL" else first[0])]
            elif op == "ANY":
                more = ["x"]
            elif op == "SUBPATTERN":
                more = examples(arg[3])
            elif op == "BRANCH":
                more = [x for branch in arg[1] for x in examples(branch)]
            else:
                assert op in ("MAX_REPEAT", "MIN_REPEAT"), op
                more = [x * max(arg[0], 1) for x in examples(arg[2])]
                more += [""] * (not arg[0])
            # Long products are cut to combinations that take each part in turn, the last (shortest) one else.
            out = [a + b for a in out for b in more] if len(out) * len(more) <= 64 else [*(a + more[-1] for a in out), *(out[-1] + b for b in more)]
        return out

    scanner = licenses.Scanner()
    found = collections.Counter()
    for n, rule in enumerate(scanner.rules):
        for text in examples(_parser.parse(rule.pattern)):
            assert scanner.compiled[n].fullmatch(text), (rule.name, text)
            assert any(k in text for k in rule.keywords), (rule.name, text)
            found[rule.name] += 1
    assert found["wtfpl.name"] >= 2 and found["libpng.grant"] >= 2
    for text, label in (("do what the fuck you want to public license", "wtfpl"), ("released under the png reference library license", "libpng"), ("libpng licence", "libpng")):
        assert label in {scanner.rules[i].label for _, _, i in scanner.detections(text)}, text


def test_packing(spark):
    df = packing.pack_documents(documents(spark), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    rows = df.collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["length"] == len(r["ids"]) // 4
    for i, t in enumerate(texts()):
        parts = sorted(docs[i], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 0] and parts[0]["doc_tokens"] == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


def test_differencing_is_a_partition():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        windows = packing.pack(sizes, 128)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 128 for w in windows)


def test_quality(spark):
    rows = texts()
    boiler = "Copyright notice of this site and all its pages"
    rng = random.Random(5)
    own = ["\n".join([boiler, " ".join(rng.choice(WORDS) for _ in range(80))]) for _ in range(40)]
    depleted = ["\n".join([boiler] * 30 + [f"tail {i}"]) for i in range(2)]
    got = by_id(quality.quality_rules(documents(spark, rows + own + depleted).withColumn("source", F.lit("one"))))
    for i, t in enumerate(rows + own + depleted):
        w = space_words(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for j in range(len(w) - 2):
            if c[tuple(w[j : j + 3])] > 1:
                hit |= {j, j + 1, j + 2}
        lines = [x for x in (t or "").split("\n") if space_words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r["n_symbols"] == sum((t or "").count(s) for s in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    n = len(rows)
    assert all(got[n + i]["removed_words"] == 9 and got[n + i]["kept"] for i in range(40))
    assert got[n + 40]["removed_words"] == 270 and not got[n + 40]["kept"]


def test_fingerprints(spark, folder):
    rows = texts()
    got = by_id(fingerprints.op4_fingerprints(spark, folder))
    order = sorted(range(len(rows)), reverse=True)
    same = collections.defaultdict(set)
    for n, i in enumerate(order):
        t, after = rows[i] or "", rows[order[(n + 1) % len(order)]] or ""
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
        same[t].add(got[i]["fingerprint"])
    assert all(len(s) == 1 for s in same.values())
    a, b = (fingerprints.fingerprint(spark.createDataFrame([(0, x)], "doc_id long, text string")).first()["sketch"] for x in (rows[0], rows[0] + " " + rows[1]))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(fingerprints.containment(F.col("a"), F.col("b"))).first()[0] > 0.8
    assert df.select(fingerprints.merge(F.col("a"), F.col("b"))).first()[0][: len(b)] is not None


def sketch_by_hand(text):
    """The sketch's hashes by another library: XXH64 of each word, chained over five words, with Spark's seed."""
    one = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)
    chain = lambda hashes: functools.reduce(lambda seed, h: one(h.to_bytes(8, "little"), seed), hashes, 42)
    words = [one(w.lower().encode(), 42) for w in re.findall("[^\x20\x09-\x0d]+", text)]
    every = {chain(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}
    every = sorted(h - (1 << 64) if h >> 63 else h for h in every)
    low = [h for h in every if h < fingerprints.BOUND]
    return low if len(low) >= fingerprints.LEAST else every[: fingerprints.LEAST]


def likeness_by_hand(a, b):
    top = min(2**63 - 1 if len(s) < fingerprints.LEAST else max(s[-1], fingerprints.BOUND - 1) for s in (a, b))
    x, y = {h for h in a if h <= top}, {h for h in b if h <= top}
    if a == b:
        return 1.0, 1.0
    return (len(x & y) / min(len(x), len(y)), len(x & y) / len(x | y)) if x and y else (0.0, 0.0)


def test_fingerprints_and_likenesses_by_hand(spark, tmp_path):
    """Every value of the query, with a very long text, nulls and repeated keys among the rows."""
    rng = random.Random(6)
    rows = [*texts(), " ".join(f"v{rng.randrange(500)}" for _ in range(60_000)), "same", "same"]
    ids = [*range(len(texts())), 900, 901, 901]
    documents(spark, rows, ids).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(fingerprints.op4_fingerprints(spark, str(tmp_path)).collect(), key=lambda r: -r["doc_id"])
    order = sorted(range(len(rows)), key=lambda i: -ids[i])
    shown = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)
    for n, (i, r) in enumerate(zip(order, got)):
        t, after = rows[i] or "", rows[order[(n + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(sketch_by_hand, (t, edited, after))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(a), shown(b)), i
        assert (r["near_edited"], r["jaccard_edited"]) == pytest.approx(likeness_by_hand(a, b))
        assert (r["near_next"], r["jaccard_next"]) == pytest.approx(likeness_by_hand(a, c))


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_each_document_stands_beside_its_successor(spark, partitions):
    """One walk through all rows, with a key that a third of them hold and with rows without a key."""
    rng = random.Random(12)
    for rows in ([(5 if i % 3 == 0 else i if i % 7 else None, f"text {rng.randrange(10**9)}") for i in range(200)], [(None, f"t{i}") for i in range(30)], [(1, "only")]):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = fingerprints.beside_next(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        key = dict((t, k) for k, t in rows)
        after = {r["text"]: r["next_text"] for r in got}
        assert len(after) == len(rows) and set(after.values()) == set(after)
        down = sorted((k for k in key.values() if k is not None), reverse=True) + [None] * sum(k is None for k in key.values())
        start = next(t for t in after if key[t] == down[-1] and key[after[t]] == down[0] and (len(set(down)) == 1 or down[0] != down[-1]))
        walk = [after[start]]
        while len(walk) < len(rows):
            walk.append(after[walk[-1]])
        assert len(set(walk)) == len(rows) and [key[t] for t in walk] == down


def removed(rows):
    first, out = {}, {}
    for i, t in enumerate(rows):
        w = space_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        out[i] = (w, gone)
    return out


@pytest.mark.parametrize("keys", [1 << 23, 0])
@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(spark, folder, hot, keys, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "TABLE_KEYS", keys)
    got = by_id(substrings.op5_substring_dedup(spark, folder))
    for i, (w, gone) in removed(texts()).items():
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_backward_search():
    rng = random.Random(8)
    seqs = [[rng.randint(1, 3) for _ in range(rng.randint(13, 30))] for _ in range(40)]
    docs = np.array([rng.randint(0, 9) for _ in seqs])
    least = {}
    for s, d in zip(seqs, docs):
        for j in range(len(s) - 12):
            k = tuple(s[j : j + 13])
            least[k] = min(least.get(k, 99), d)
    got = substrings.first_documents(np.array([x for s in seqs for x in s], np.uint64), np.array([len(s) for s in seqs]), docs)
    assert got.tolist() == [least[tuple(s[j : j + 13])] for s in seqs for j in range(len(s) - 12)]


def test_packed_passages_come_back():
    rng = random.Random(2)
    made = lambda n: [bytes(rng.randrange(256) for _ in range(substrings.WORD_BYTES)) for _ in range(n)]
    known = made(30)
    words = [b"".join(rng.choices(known, k=rng.randint(13, 25))) for _ in range(20)]
    names = [bytes([i]) * (substrings.NAME_BYTES - 1) + b"\0" for i in range(20)]
    docs = [rng.choice([rng.randint(-5, 9), substrings.LAST]) for _ in range(20)]
    one = substrings.packed(names[:15], docs[:15], docs[:15], words[:15])
    two = substrings.packed(names[10:], docs[10:], [d if d == substrings.LAST else d + 1 for d in docs[10:]], words[10:])
    got, lo, hi, sizes, flat = substrings.distinct_passages([one, two])
    assert got == names and lo.tolist() == docs and sizes.tolist() == [len(w) // substrings.WORD_BYTES for w in words]
    assert hi.tolist() == [d if i < 10 or d == substrings.LAST else d + 1 for i, d in enumerate(docs)]
    assert flat.view(np.uint8).reshape(-1, 8)[:, : substrings.WORD_BYTES].tobytes() == b"".join(words)


def test_matching_statistics(monkeypatch):
    """Spans of sequences that earlier documents have, by comparing all windows; streamed in one piece and in many."""
    rng = random.Random(9)
    for stream in (8192, 3):
        monkeypatch.setattr(substrings, "STREAM", stream)
        for alphabet, longest in ((2, 40), (3, 30), (9, 20)):
            seqs = [[rng.randint(1, alphabet) for _ in range(rng.randint(13, longest))] for _ in range(60)]
            seqs += [rng.choice(seqs)[: rng.randint(13, 60)] for _ in range(20)] + [[5] * 400, [5] * 90, [7] * 14]
            docs = np.array([rng.choice([rng.randint(0, 9), substrings.LAST]) for _ in seqs])
            first = {}
            for s, d in zip(seqs, docs.tolist()):
                for j in range(len(s) - 12):
                    first[tuple(s[j : j + 13])] = min(first.get(tuple(s[j : j + 13]), d), d)
            got = substrings.earlier_spans(np.array([x for s in seqs for x in s], np.uint64), np.array([len(s) for s in seqs]), docs)
            for s, d, spans in zip(seqs, docs.tolist(), got):
                want = np.zeros(len(s), bool)
                for j in range(len(s) - 12):
                    if first[tuple(s[j : j + 13])] < d:
                        want[j : j + 13] = True
                assert substrings.covered(len(s), spans[::2], spans[1::2]).tolist() == want.tolist()
                assert (np.diff(spans.reshape(-1, 2), axis=1) >= 13).all()


def test_a_statistic_is_the_longest_match_of_an_earlier_document():
    rng = random.Random(10)
    seqs = [[rng.randint(1, 2) for _ in range(rng.randint(13, 30))] for _ in range(30)]
    docs = np.array([rng.randint(0, 5) for _ in seqs])
    words, lengths = np.array([x for s in seqs for x in s], np.uint64), np.array([len(s) for s in seqs])
    index = substrings.FmIndex(words, lengths, docs)
    text, _ = index.coded(words, lengths)
    at = 0
    for s, d in zip(seqs, docs):
        places = np.arange(12, len(s))
        got = index.statistics(text, at + places, np.full(len(places), d))
        at += len(s) + 1
        for j, n in zip(places.tolist(), got.tolist()):
            earlier = [" ".join(map(str, o)) + " " for o, e in zip(seqs, docs) if e < d]
            best = max((k for k in range(13, 17) if k <= j + 1 and any(" ".join(map(str, s[j + 1 - k : j + 1])) + " " in o for o in earlier)), default=0)
            assert n == best


def test_the_matrix_takes_about_the_entropy_of_its_words():
    """Words by Zipf's law: codes within half a bit of the entropy, bits of the matrix those of the codes, and all intervals right."""
    rng = np.random.default_rng(3)
    words = (rng.zipf(1.3, 60_000) % 5_000).astype(np.uint64)
    lengths = np.full(3000, 20)
    index = substrings.FmIndex(words, lengths)
    text, place = index.coded(words, lengths)
    counts = np.bincount(text)
    share = counts / counts.sum()
    entropy = -(share * np.log2(share)).sum()
    mean = (share * index.sizes).sum()
    assert entropy <= mean < entropy + 0.5 and (2.0 ** -index.sizes.astype(float)).sum() <= 1
    assert len({(int(c), int(n)) for c, n in zip(index.codes, index.sizes)}) == len(counts)
    assert index.nbytes < len(text) * (mean * 1.25 / 8) + 9 * len(counts) + 64 * 40 < 4 * len(text)
    last = place[substrings.within(lengths) >= 2][::7]
    low, high = index.intervals(text, last, 3)
    grams = collections.Counter(tuple(text[j - 2 : j + 1].tolist()) for j in range(2, len(text)))
    many = high - low > 1
    assert [grams[tuple(text[j - 2 : j + 1].tolist())] for j in last[many]] == (high - low)[many].tolist()
    assert many.any() and all(grams[tuple(text[j - 2 : j + 1].tolist())] == 1 for j in last[~many])


def test_cutting_keeps_what_stands_between():
    text = b"a b\n" + b" ".join(b"x%d" % i for i in range(13)) + b"\n\nc"
    assert substrings.without(text, np.array([2])) == b"a b\n\n\nc"


def test_elias_fano():
    rng = random.Random(1)
    for size, top in ((0, 10), (1, 5), (1000, 1 << 62), (5000, 6000), (300, 1 << 20), (3, 1 << 63), (200, 1 << 45), (100, 1 << 30), (70, 1 << 37)):
        values = np.array(sorted(rng.sample(range(top), size) if top < 1 << 30 else {rng.randrange(top) for _ in range(size)}), np.uint64)
        ef = elias_fano.EliasFano.of(values)
        asked = np.r_[values, np.array([rng.randrange(top) for _ in range(500)], np.uint64)]
        want = {int(v): i for i, v in enumerate(values)}
        assert ef.search(asked).tolist() == [want.get(int(v), -1) for v in asked]
        at = np.array([rng.randrange(len(values)) for _ in range(300)] if len(values) else [], np.int64)
        assert ef.get(at).tolist() == values[at].tolist() and ef.low.nbytes * 8 < len(values) * ef.shift + 128
        assert size < 100 or ef.low.nbytes + ef.high.nbytes <= size * (2 + math.log2(top / size)) / 8 + 32, (size, top)


def test_codebook_of_counts():
    counts = np.unique(np.r_[np.arange(1, 5000), 2.0 ** np.linspace(0, 40, 3000)].round())
    codes = elias_fano.quantised(counts)
    off = np.abs(np.log(elias_fano.COUNTS[codes] / counts))
    assert (off[counts <= elias_fano.EXACT] == 0).all() and off.max() <= math.log(elias_fano.RATIO) / 2 + 1e-9
    assert len(elias_fano.COUNTS) == 256 and elias_fano.RATIO**0.5 < 1.056


@pytest.mark.parametrize("size", [10**7, 60])
def test_language_model(spark, folder, size, monkeypatch):
    monkeypatch.setattr(language_model.totals, "__defaults__", (size,))
    got = by_id(language_model.op6_lm_scoring(spark, folder))
    docs = {i: [*space_words((t or "").translate({c: c + 32 for c in range(65, 91)})), None] for i, t in enumerate(texts())}
    train = [w for i, w in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for w in train for p in zip(w, w[1:]))
    for i, w in docs.items():
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] <= 1e-9
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    assert len(pairs) > 0 and sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


@pytest.mark.parametrize("size", [10**7, 60])
def test_language_model_is_one_model_at_every_size(spark, folder, size, monkeypatch):
    """The whole trigram model by brute force, with counts as the codebook has them: equal in one shard and in many."""
    monkeypatch.setattr(language_model.totals, "__defaults__", (size,))
    got = by_id(language_model.op6_lm_scoring(spark, folder))
    docs = {i: [None, *space_words((t or "").translate({c: c + 32 for c in range(65, 91)})), "</s>"] for i, t in enumerate(texts())}
    train = [w for i, w in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    count = [collections.Counter(tuple(w[j : j + n]) for w in train for j in range(len(w) - n + 1) if n == 3 or w[j] is not None) for n in (1, 2, 3)]
    context = collections.Counter(g[:2] for g in count[2].elements() if g[0] is not None)
    spread = [collections.Counter(g[:-1] for g in c) for c in count]
    tokens, types = sum(count[0].values()), len(count[0])
    D = language_model.D  # noqa: N806

    def q(n):
        return min(elias_fano.COUNTS, key=lambda x: abs(math.log(x / n)))

    def p1(w):
        return (count[0][w,] - language_model.D1 if count[0][w,] else language_model.D1 * types) / tokens

    def p2(u, w):
        if u is None or not count[0][u,]:
            return p1(w)
        return (q(count[1][u, w]) - D) / count[0][u,] if count[1][u, w] else min(D * q(spread[1][u,]) / count[0][u,], 1) * p1(w)

    def p3(t, u, w):
        if t is None or not context[t, u]:
            return p2(u, w)
        return (q(count[2][t, u, w]) - D) / q(context[t, u]) if count[2][t, u, w] else min(D * q(spread[2][t, u]) / q(context[t, u]), 1) * p2(u, w)

    for i, w in docs.items():
        want = sum(math.log10(p3(w[j - 2] if j > 1 else None, w[j - 1], w[j])) for j in range(1, len(w)))
        assert abs(got[i]["score"] - want) < 1e-9 * len(w), i


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [*texts(), "<|endoftext|> it's 3²", "ΣΑΣ 漢字 é", "İstanbul aaaa" + "a" * 500]
    ids = bpe.bpe_encode(documents(spark, rows), path)
    got = by_id(ids)
    back = by_id(bpe.bpe_decode(ids, path))
    for i, t in enumerate(rows):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == want and back[i]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_all_scripts_pass_the_merge_rounds():
    """Generated texts of many scripts, combining marks, specials and odd white space, in both vocabularies."""
    rng = random.Random(13)
    spans = [(0x20, 0x7E), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x6FF), (0x900, 0x97F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4E80), (0xAC00, 0xAC40), (0xFB00, 0xFB06), (0xFF10, 0xFF40), (0x1F600, 0x1F640)]
    char = lambda: chr(rng.randint(*rng.choice(spans)))
    rows = ["".join(char() for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows += [" ".join("".join(char() for _ in range(4)) for _ in range(9)) + rng.choice(["<|endoftext|>", " <|startoftext|>x", "\u2028\x85 \t", ""]) for _ in range(200)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        got = bpe.Encoder(path).encode(rows)
        for t, ids in zip(rows, got):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("part", "hot", "frequent", "rounds"), [(5_000_000, 1000, 16, 3), (300, 4, 2, 3), (50, 2, 1, 0), (1000, 10**9, 16, 0)])
def test_jaccard_components(spark, part, hot, frequent, rounds, monkeypatch):
    for name, value in (("PART", part), ("HOT", hot), ("FREQUENT", frequent), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(11)
    base = [[rng.choice(WORDS) for _ in range(120)] for _ in range(8)]
    rows = texts()
    for b in base:
        for _ in range(9):
            w = list(b)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(" ".join(w))
    rows += [rows[-1], rows[-2] + "  ", "a b c d e f", "A b c d E f g", "common line " * 4 + rows[3], "common line " * 4 + rows[4]]
    got = by_id(jaccard_join.jaccard_components(documents(spark, rows)))
    sets = []
    for t in rows:
        w = space_words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in got} == {i: (len(sets[i]), label[i]) for i in range(len(rows))}


def test_sets_that_share_much_but_do_not_link(spark):
    rng = random.Random(14)
    p, q, r = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "pqr")
    rows = [f"{p} {q}", f"{p} {r}", f"{q} {r}", f"{p} {q} x", "alone"]
    got = by_id(jaccard_join.jaccard_components(documents(spark, rows[:3] + rows[4:])))
    assert [got[i]["component_id"] for i in range(4)] == [0, 1, 2, 3]
    got = by_id(jaccard_join.jaccard_components(documents(spark, rows)))
    assert [got[i]["component_id"] for i in range(5)] == [0, 1, 2, 0, 4]


def test_packed_shingles_come_back():
    rng = np.random.default_rng(3)
    for k in (0, 1, 1000):
        grams, owner, more = np.sort(rng.integers(0, 1 << 62, k).astype(np.uint64)), rng.integers(0, 50, k), rng.integers(0, 1 << 31, k)
        assert [x.tolist() for x in jaccard_join.unpacked(jaccard_join.packed(owner, grams, more))] == [owner.tolist(), grams.tolist(), more.tolist()]
        assert [x.tolist() for x in jaccard_join.unpacked(jaccard_join.packed(owner, grams))] == [owner.tolist(), grams.tolist(), []]


def test_rows_with_keys(spark, monkeypatch):
    """By the bitmap and without it."""
    rows, keys = spark.range(3000).select(F.col("id").alias("key"), F.col("id").alias("_slot")), spark.range(0, 3000, 7).select(F.col("id").alias("key"))
    for bits in (24, 0):
        monkeypatch.setattr(common, "KEY_BITS", bits)
        got = common.with_keys(rows, keys.union(keys), "key").collect()
        assert sorted((r["key"], r["_slot"]) for r in got) == [(i, i) for i in range(0, 3000, 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[100] == got[70] == 50


def test_url_filters(spark):
    urls = ["http://WWW.Example.com/en/1?x=casino", "https://a.net/es/x", "x://com", "x://com/", "http://myexample.com/en/", None, "no host", "http://a.org/Casino/#f",
            "http://spam-farm.example.org/", "http://b.example.com/en/casino", "http://wiki.org/casino", "http://a.net/fr", "https://a.net?u=http://example.com/en/"]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)] + [(0, urls[0], 1, 2)], "page_id long, url string, host int, path int")
    rows = url_filters.judge_urls(pages, list(url_filters.PREFIX_RULES), url_filters.pattern_rules()).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: r for r in rows}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)[^/?#]*", u.split("://", 1)[1]) if u and "://" in u else None
        rest = u.split("://", 1)[1] if m else ""
        host, path = (m[0].lower(), re.match(r"(?s)[^?#]*", rest[m.end() :])[0]) if m else ("", "")
        fit = [p for p in url_filters.PREFIX_RULES if (host == p.host or host.endswith("." + p.host)) and path.startswith(p.path)]
        best = max(fit, key=lambda p: len(p.name), default=None)
        query = re.search(r"\?[^#]*", u or "")
        subject = host + path.lower() + (query[0].lower() if query else "")
        hits = [p for p in url_filters.pattern_rules() if re.search(p.pattern, subject)]
        verdict = best.verdict if best else min((p.verdict for p in hits), default="allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best.name if best else None, verdict), u


def test_url_index_finds_what_all_rules_find(spark):
    hosts = ["linkfarm.org", "contentfarm.net", "link-farm.org", "mycontent-farm.org", "freemalware.org", "malwares.io", "bestphishing.org", "phishing2.org", "myspam-farms.org",
             "spam-farm.org", "spamfarm.org", "spam.org", "a.spam-x.org", "casinos.org", "casino.org", "xadult.org", "adult.org", "wikis.org", "wiki.org", "docs.org", "a.edu.au"]
    paths = ["", "/", "/paydayloans", "/payday-loan", "/xpaydayloan", "/paydayadvance", "/payday_loans2", "/wp-admin/", "/xwp-admin/", "/logins", "/login.php", "/rss/feed", "/robots.txt"]
    pages = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(h + p for h in hosts for p in paths)], "page_id long, url string")
    rules = url_filters.pattern_rules()
    for prefixes in (list(url_filters.PREFIX_RULES), [url_filters.PrefixRule("allow", "com", "/")]):
        for r in url_filters.judge_urls(pages, prefixes, rules).collect():
            hits = [(p.verdict, n, p.name) for n, p in enumerate(rules) if re.search(p.pattern, r["host"] + r["path"])]
            assert r["pattern"] == min(hits, default=(0, 0, None))[2], r
            assert r["rule"] or r["verdict"] == min(hits, default=("allow",))[0], r


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules_may_be_many(spark, limit, monkeypatch):
    """Thousands of generated rules, each url held against all of them; null and repeated urls and keys among the rows."""
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", limit)
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    patterns = []
    for i in range(3000):
        t = sorted({rng.choice(words) for _ in range(rng.randint(1, 2))})
        patterns.append(url_filters.PatternRule(rng.choice(["allow", "block"]), f"p{i}", tuple(t), rf"(?:^|[^a-z0-9]){t[0]}(?:[^a-z0-9]|$).*(?:^|[^a-z0-9]){t[-1]}" if len(t) > 1 else rf"/{t[0]}(?:[^a-z0-9]|$)"))
    patterns = [p if len(p.tokens) == 1 else url_filters.PatternRule(p.verdict, p.name, p.tokens[:1], p.pattern) for p in patterns]
    prefixes = [url_filters.PrefixRule(rng.choice(["allow", "block"]), f"{rng.choice(words)}.org", "/" + rng.choice(words)[:1]) for _ in range(50)]
    urls = ["http://" + ".".join(rng.choice(words) for _ in range(2)) + ".org/" + "/".join(rng.choice(words) for _ in range(3)) for _ in range(60)]
    rows = [*enumerate(urls), (None, urls[0]), (None, None), (7, urls[7]), (90, "//" + urls[3][7:]), (91, "")]
    got = url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), prefixes, patterns).collect()
    assert len(got) == len(rows) and sum(r["page_id"] is None for r in got) == 2
    verdict = {}
    for r in got:
        fit = [(len(p.name), -n, p.name, p.verdict) for n, p in enumerate(prefixes) if (r["host"] == p.host or r["host"].endswith("." + p.host)) and r["path"].startswith(p.path)]
        best = max(fit, default=None)
        hits = [(p.verdict, n, p.name) for n, p in enumerate(patterns) if re.search(p.pattern, r["host"] + r["path"])]
        assert (r["rule"], r["pattern"]) == (best and best[2], min(hits)[2] if hits else None)
        assert r["verdict"] == (best[3] if best else min(hits)[0] if hits else "allow")
        verdict.setdefault((r["host"], r["path"]), set()).add(r["verdict"])
    assert all(len(v) == 1 for v in verdict.values())


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "idiot", "trash"]))
        rows.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    rows += [None, ""]
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {b"scum", b"idiot", b"trash"} <= set(model.lexicon)
    got = by_id(toxicity.toxicity(docs, model))
    assert all(got[i]["predicted"] == y for i, _, y in labels) and 0 <= got[600]["score"] == got[601]["score"] < 0.5
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {none.probability(np.zeros((1, 2)))[0]}


def test_toxicity_scores_by_hand(spark):
    """Lexicon, law, curve's features, segments and scores of every row, from their definitions."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(WORDS) for _ in range(rng.randint(1, 90))]
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 4) * bad + (rng.random() < 0.02)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["scum", "idiotic", "Idiots", "trash"]))
        rows.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    rows += [None, "", "idiot " * 20_000]
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    train = [(rows[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    seen = collections.defaultdict(int)
    for t, y in train:
        seen[t] = max(seen[t], y)
    forms = lambda w: {w, *(w[:n] + b" " for n in (4, 5, 6) if len(w) > n)}
    words = lambda t: re.findall(rb"[a-z0-9'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    count = [collections.Counter(f for t, y in seen.items() if y == k for f in {f for w in words(t) for f in forms(w)}) for k in (0, 1)]
    size = [sum(y == k for y in seen.values()) for k in (0, 1)]
    lexicon = {}
    for token in set(count[0]) | set(count[1]):
        c, both = [count[0][token], count[1][token]], count[0][token] + count[1][token]
        prior = toxicity.LEAST + toxicity.PRIOR / sum(size) * both
        delta = math.log((c[1] + prior) / (size[1] + toxicity.PRIOR)) - math.log((c[0] + prior) / (size[0] + toxicity.PRIOR))
        ratio = 2 * sum(c[k] * math.log(c[k] / (both * size[k] / sum(size))) for k in (0, 1) if c[k])
        if delta >= toxicity.DELTA_LEAST and ratio**0.5 >= toxicity.Z_LEAST:
            lexicon[token] = delta
    assert model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[t] - lexicon[t]) < 1e-9 for t in lexicon) and len(lexicon) >= 3
    got = by_id(toxicity.toxicity(docs, model))
    scale, share = model.law
    for i, t in enumerate(rows):
        w = words(t)
        value = [max((lexicon[f] for f in forms(x) if f in lexicon), default=None) for x in w]
        found = toxicity.segments([(k, v) for k, v in enumerate(value) if v is not None], toxicity.DRIFT)
        over = [(a, b, s, scale * s - math.log(share * max(len(w), 1))) for a, b, s in found]
        x = max([0.0, *(o for *_, o in over)]), math.log1p(sum(max(o, 0) for *_, o in over))
        z = model.curve[0] + model.curve[1] * x[0] + model.curve[2] * x[1]
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-9
        passages = [(a, b, 1 - math.exp(-math.exp(-o))) for a, b, s, o in over if 1 - math.exp(-math.exp(-o)) <= toxicity.ALPHA]
        assert [(r["first"], r["last"]) for r in got[i]["segments"]] == [p[:2] for p in passages]
        assert all(abs(r["p_value"] - p[2]) < 1e-9 for r, p in zip(got[i]["segments"], passages))


def test_extreme_value_law_finds_its_parameters():
    rng = np.random.default_rng(4)
    n = rng.integers(20, 2000, 20_000)
    scale, share = 1.7, 0.01
    best = np.maximum((np.log(share * n) - np.log(-np.log(rng.random(len(n))))) / scale, 0.0)
    got = toxicity.extreme_value_law(best, n)
    assert abs(got[0] / scale - 1) < 0.05 and abs(got[1] / share - 1) < 0.05
    assert all(np.isfinite(toxicity.extreme_value_law(np.zeros(k), np.full(k, 9)))[0] for k in (0, 5))


def test_the_scan_of_segments_is_linear():
    """Scores that fall and rise slowly keep many candidates open; ten times the hits take about ten times the time."""
    took = []
    for n in (20_000, 200_000):
        hits = [(2 * i, 0.5 + (i % 7 == 0) * 0.2) for i in range(n)]
        began = time.perf_counter()
        assert toxicity.segments(hits, -0.7)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


def test_segments_are_the_maximal_ones():
    """Against the recursive definition: the best segment, then the same on either side of it."""

    def brute(s, a, b):
        best = max(((sum(s[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        _, _, i, j = best
        return [*brute(s, a, i), (i, j - 1), *brute(s, j, b)]

    rng = random.Random(7)
    for _ in range(150):
        hits = {i: rng.choice([1.03, 2.11, 0.57]) + rng.random() / 100 for i in range(25) if rng.random() < 0.3}
        s = [hits.get(i, -0.7) for i in range(25)]
        assert sorted((a, b) for a, b, _ in toxicity.segments(sorted(hits.items()), -0.7)) == sorted(brute(s, 0, 25))


@pytest.mark.parametrize("query", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, empty, query):
    from tessella.llm import queries

    f = next(f for name, f in queries.queries().items() if name.startswith(query + "_"))
    assert f(spark, empty).count() == 0


@pytest.mark.parametrize("query", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op10"])
def test_null_and_repeated_ids(spark, tmp_path, query):
    from tessella.llm import queries

    rows = [*texts()[:20], None, texts()[0], "same id", "same id"]
    ids = [*range(20), None, None, 7, 7]
    documents(spark, rows, ids).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    f = next(f for name, f in queries.queries().items() if name.startswith(query + "_"))
    got = f(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) if query != "op2" else len(got) >= len(rows)
