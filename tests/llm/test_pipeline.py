"""The pipeline's stages: what they keep, held against the operators' own verdicts by brute force."""

import re

import random

import corpus_pipeline
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, docs)
    text = {k: {r["doc_id"]: r["text"] for r in v[1].collect()} for k, v in seen.items() if k != "packing"}
    source = {r["doc_id"]: r["text"] for r in seen["quality"][0].collect()}
    words = lambda t: re.findall("[^\x20\x09-\x0d]+", t)
    for i, t in source.items():
        w = words(t)
        if len(w) < 50:
            assert i not in text["quality"]
    first = {}
    for i in sorted(text["near_duplicates"]):
        w, keep = words(text["near_duplicates"][i]), []
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        keep = [x for x, g in zip(w, gone) if not g]
        assert words(text["substrings"][i]) == keep
    pieces = seen["packing"][1]
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(text["substrings"])
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
    assert corpus_pipeline.run(spark, SMALL).count() == pieces.count()


def documents(spark, rows):
    """rows: (doc_id, text); one source."""
    return spark.createDataFrame([(i, t, "en", "one", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def prose(rng, n=80):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_quality_judges_each_row_and_removes_boilerplate(spark):
    rng = random.Random(3)
    boiler = "Ümlaut notice No 12 of this site"
    own = [prose(rng) for _ in range(40)]
    shared = [(i, f"{boiler}\n{t}\n{boiler.lower()}  ") for i, t in enumerate(own)]
    odd = [(None, prose(rng)), (None, prose(rng)), (None, "too short"), (50, prose(rng)), (50, "short as well"), (51, "")]
    docs = documents(spark, [*shared, *odd, odd[0]])
    out = stage("quality")(spark, docs, None)
    assert out.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, len(t)) for i, t in [*enumerate(own), odd[0], odd[0], odd[1], odd[3]]), key=repr)


def test_near_duplicates_judges_each_row(spark):
    rng = random.Random(4)
    a, b, c, d, e, f = (prose(rng) for _ in range(6))
    rows = [(1, a), (2, a + " x"), (2, b), (None, c), (None, d), (5, e), (5, e + " y"), (6, e), (None, f), (9, f + " z"), (7, "")]
    got = {(r["doc_id"], r["text"]) for r in stage("near_duplicates")(spark, documents(spark, rows), None).collect()}
    of5 = got & {(5, e), (5, e + " y")}
    assert len(of5) == 1 and got - of5 == {(1, a), (2, b), (None, c), (None, d), (None, f), (9, f + " z"), (7, "")}
