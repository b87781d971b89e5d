"""Boosted trees, embedding whitening and spelling variants, held against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality_trees, spelling, whitening

# ---- spelling variants


def lost_word(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            counts[lost_word(doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), run))] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out, form = {}, {}
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in counts}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def spelling_rows(spark, rows, partitions=5):
    schema = "doc_id long, text string, word string, n long, id long"
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], schema).repartition(partitions)


def found_words(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def spelling_texts(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÿé") for _ in range(rng.randint(6, 10))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "bookkeeper", "Éaaaaaaa"]
    words = []
    for s in stems:
        times = rng.choice([1, 2, 3, 30, 300])
        words += [s] * times
        for _ in range(6):
            i = rng.randrange(len(s))
            words += [s[:i] + rng.choice(["", "a", "ÿ", s[i] * 2]) + s[i + 1 :]] * rng.randint(1, 4)
    rng.shuffle(words)
    return [(d if d % 11 else None, " ".join(w.upper() if rng.random() < 0.05 else w for w in words[d * 60 : d * 60 + 60])) for d in range(-(-len(words) // 60))]


@pytest.mark.parametrize("partitions", ["3", "37"])
def test_spelling_variants_equal_brute_force(spark, partitions):
    long_word = "ab" * 3000
    rows = spelling_texts() + [(900, None), (901, ""), (902, "short a_b 1234567 " * 3), (903, f"{long_word} {long_word} {long_word}x {long_word}x x{long_word}"), (904, f"x{long_word}")]
    rows += [(905, "abcdefg×h abcdefg÷h ABCDEFG ÀBCDEFG àBCDEFG"), (905, "abcdefg×h abcdefg÷h ABCDEFG ÀBCDEFG àBCDEFG"), (906, "Ωabcdefg漢abcdefg😀abcdefg")]
    rows += [(910, "qqchainaa " * 2 + "qqchainab " * 25 + "qqchainbb " * 300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # 37: most partitions start within a group of common prefixes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found_words(spelling.spelling_variants(spelling_rows(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_spelling(rows)
    assert got == want
    assert sum(v[2] is not None for v in want.values()) > 20 and any(v[2] != v[4] for v in want.values() if v[2])


def test_spelling_of_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, "one two")], [(1, "singleton")]):
        assert found_words(spelling.spelling_variants(spelling_rows(spark, rows, 1))) == {}


def test_trie_numbers_are_those_of_distinct_prefixes(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    table = spelling.checkpoint(spark.createDataFrame([(w,) for w in words], "word string").repartitionByRange(23, "word").sortWithinPartitions("word"))
    of_prefix = {}
    for r in spelling.numbered(table, ["word"]).collect():
        got = np.frombuffer(r["nodes"], "<i8").tolist()
        assert len(got) == len(r["word"]) + 1 and got[-1] == r["own"]
        for i, number in enumerate(got):
            assert of_prefix.setdefault(r["word"][:i], number) == number
    assert len(set(of_prefix.values())) == len(of_prefix)
    own = [of_prefix[w] for w in words]
    assert own == sorted(own)


# ---- whitening


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, key string, component int").repartition(4)


def whitened(spark, rows):
    df = embeddings(spark, rows)
    return whitening.whiten(df, whitening.fit(df)).collect()


def vectors(n=300, d=9, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(3, 0.2, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + 0.5).tolist()


def test_whitening_equals_brute_force(spark):
    good = vectors()
    odd = [None, [], [None] + good[0][1:], [float("nan")] + good[0][1:], [float("-inf")] + good[0][1:], [1.0, 2.0]]
    rows = [*enumerate(good + [good[3]] * 400 + [[v + 1e-6 for v in good[4]]]), *((1000 + i, v) for i, v in enumerate(odd)), (None, good[5])]
    got = whitened(spark, rows)
    kept = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows if v and len(v) == 9 and all(c is not None and np.isfinite(c) for c in v)]
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"]) for r in got) == sorted((-1 if i is None else i, c) for i, _ in kept for c in (1, 2, 3, 4))
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    signs = [np.sign(by_id[0, c + 1]["whitened"] * ((kept[0][1] - sums / n) @ basis[:, c])) for c in range(4)]
    for i, x in kept:
        for c in range(4):
            r = by_id[i, c + 1]
            assert r["n"] == n and r["deviation"] == int(((n * x - sums) ** 2).sum())
            assert abs(r["whitened"] - signs[c] * ((x - sums / n) @ basis[:, c]) / np.sqrt(values[c])) < 1e-9
            assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_few_and_flat_vectors(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None), (2, [])]) == []
    one = whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0)] * 4
    line = whitened(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])
    assert {r["component"] for r in line} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-12
    huge = whitened(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [2.0**40, 0.5])])
    assert len(huge) == 6 and all(r["n"] == 3 and r["whitened"] is not None for r in huge if r["component"] == 1)
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}


@pytest.mark.parametrize("spectrum", [np.arange(1, 21.0), np.r_[np.ones(15), 9, 9, 9, 4, 2.0], 10.0 ** -np.arange(0, 20), np.ones(6), np.zeros(5), np.r_[np.zeros(8), 1, 2.0], [3.0]])
def test_components_by_divide_and_conquer(spectrum):
    spectrum = np.asarray(spectrum, float)
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    for a in ((q * spectrum) @ q.T, np.diag(spectrum)):
        a = (a + a.T) / 2
        for count in (1, min(4, d), d):
            values, v = whitening.components_of(a, count)
            scale = max(np.abs(spectrum).max(), 1e-300)
            assert np.allclose(values, np.sort(spectrum)[::-1][:count], atol=1e-13 * scale * d, rtol=0)
            assert np.abs(v.T @ v - np.eye(count)).max() < 1e-13 * d and np.abs(a @ v - v * values).max() <= 1e-13 * scale * d


def test_polar_factor():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((8, 8)))[0]
    values = np.array([1e-9, -1e-6, 1, -2, 3, -4, 1e3, -1e-3])
    assert np.abs(whitening.polar((q * values) @ q.T) - (q * np.sign(values)) @ q.T).max() < 1e-5
    assert whitening.polar(np.zeros((3, 3))) is None and whitening.polar(np.diag([1.0, 0.0, -1.0])) is None


def test_keys_and_products_are_exact():
    x = np.array([[1, -2], [300, -128], [127, -128], [1 << 40, -(1 << 62)], [-(1 << 31), 0]])
    keys = whitening.packed(x)
    assert len(set(keys)) == 5 and sorted(map(tuple, np.vstack(list(whitening.unpacked(keys, 2))).tolist())) == sorted(map(tuple, x.tolist()))
    assert (whitening._products(x) == x.astype(object).T @ x.astype(object)).all()


# ---- quality trees


def quality_rows(n=240, seed=4):
    rng = random.Random(seed)
    words = ["the", "river", "runs", "to", "some", "quiet", "harbour", "and", "boats", "wait"]
    rows = []
    for i in range(n):
        text = ". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))).capitalize() for _ in range(rng.randint(1, 8))) + "."
        bad = i % 4 == 0
        if bad:
            text = [" | ".join(text.split()), text.upper().replace(" ", "!! "), " ".join(w + rng.choice(["***", "$$$"]) for w in text.split()), " ".join(w for w in text.split()[:4] for _ in range(9))][i // 4 % 4]
        rows.append((i, text, 0 if bad else 1))
    return rows


def quality_tables(spark, rows, more=()):
    docs = spark.createDataFrame([(i, t, "y", 1.0) for i, t, _ in rows] + [(i, t, "y", 1.0) for i, t in more], "doc_id long, text string, y string, score double").repartition(3)
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_trees_judge_held_out_rows(spark):
    rows = quality_rows()
    docs, labels = quality_tables(spark, rows, [(5000, None), (5001, ""), (None, "The river runs."), (5002, "word " * 200_000), (5003, "x" * 3_000_000), (5004, " \n\t\n")])
    model = quality_trees.fit(docs, labels)
    got = quality_trees.scored(docs, model).collect()
    assert len(got) == len(rows) + 6
    by = {r["doc_id"]: r for r in got}
    held = [(q, by[i]["predicted"]) for i, _, q in rows if is_held_out(i)]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert by[5000]["score"] == by[5001]["score"]
    # Labels of held-out rows are never read.
    other = spark.createDataFrame([(i, 1 - q if is_held_out(i) else q, 0) for i, _, q in rows] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    again = quality_trees.fit(docs, other)
    assert np.array_equal(again.value, model.value) and np.array_equal(again.threshold, model.threshold)
    flags = docs.select("doc_id", quality_trees.held_out("doc_id").alias("h")).where("doc_id IS NOT NULL").collect()
    assert all(r["h"] == is_held_out(r["doc_id"]) for r in flags)


def test_flat_trees_equal_a_walk_by_hand(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((500, 5)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality_trees.boost(x, y)
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.98

    def walk(row):
        total = model.base
        for node in model.roots:
            while np.isfinite(model.threshold[node]):
                node = model.child[node] + int(row[model.feature[node]] > model.threshold[node])
            total += model.value[node]
        return total

    assert np.allclose(model.margins(x), [walk(r) for r in x])
    # Each leaf's value is the Newton step of the rows that reach it: the first tree by brute force.
    share, first = y.mean(), model.roots[0]
    node = np.full(len(x), first)
    for _ in range(quality_trees.DEPTH):
        node = model.child[node] + (x[np.arange(len(x)), model.feature[node]] > model.threshold[node])
    for leaf in np.unique(node):
        mine = y[node == leaf]
        want = quality_trees.RATE * (mine - share).sum() / (len(mine) * share * (1 - share) + quality_trees.RIDGE)
        assert abs(model.value[leaf] - want) < 1e-9


def test_trees_without_two_labels(spark):
    docs, _ = quality_tables(spark, quality_rows(12))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r["score"], 6) for r in quality_trees.scored(docs, quality_trees.fit(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality_trees.scored(docs, quality_trees.fit(docs, ones)).collect()} == {1}
    empty = docs.limit(0)
    assert quality_trees.scored(empty, quality_trees.fit(empty, ones)).collect() == []


def test_statistics_of_any_bytes():
    assert len(quality_trees.statistics(b"")) == len(quality_trees.FEATURES)
    named = dict(zip(quality_trees.FEATURES, quality_trees.statistics("Ab1é. cd, ef!|$ $ $\n\nAb1é.".encode())))
    assert named["upper"] == 2 / 22 and named["digits"] == 2 / 22 and named["symbols"] == 3 / 22 and named["bars"] == 1 / 22
    assert named["repeats"] == 1 / 6 and np.isclose(named["log_lines"], np.log(3))
