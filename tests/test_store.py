"""A saved index that grows by versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import columns, index, search, store
from tessella.params import SketchParams

P = SketchParams(k=13, log2_buckets=6, threshold=5)


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


@pytest.fixture(scope="module")
def genomes(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(2000))
    data = [(i, f"g{i}", base[i * 40 : i * 40 + rng.randint(100, 800)]) for i in range(30)] + [(30, "short", "ACG")]
    return spark.createDataFrame(data, "genome_id long, name string, seq string")


def part(genomes, low, high):
    return genomes.where(f"genome_id >= {low} AND genome_id < {high}").withColumn("genome_id", F.col("genome_id") - low)


def same(a, b):
    assert rows(a.sketch, "genome_id", "bucket", "fp") == rows(b.sketch, "genome_id", "bucket", "fp")
    assert rows(a.genomes) == rows(b.genomes) and rows(a.bloom) == rows(b.bloom)


def test_appends_are_versions(spark, tmp_path, genomes, monkeypatch):
    at = f"{tmp_path}/i"
    assert store.create(spark, at, P, ranges=8) == 0
    assert store.open_version(spark, at).genomes.count() == 0
    assert store.append(spark, at, part(genomes, 0, 12)) == 1
    first = store.open_version(spark, at)
    same(first, index.build(part(genomes, 0, 12), P))
    # A failure between writing and committing leaves the index as it was.
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.append(spark, at, part(genomes, 12, 20))
    assert store.versions(spark, at) == [0, 1]
    same(store.open_version(spark, at), first)
    # ... and so does one while files are written.
    with monkeypatch.context() as m:
        m.setattr(store, "_write", lambda *_: (_ for _ in ()).throw(RuntimeError("disk")))
        with pytest.raises(RuntimeError):
            store.compact(spark, at)
    assert store.append(spark, at, part(genomes, 12, 31)) == 2
    whole = index.build(genomes, P)
    same(store.open_version(spark, at), whole)
    same(first, index.build(part(genomes, 0, 12), P))
    same(store.open_version(spark, at, version=1), first)
    queries = genomes.select((F.col("genome_id") + 100).alias("query_id"), F.substring("seq", 20, 300).alias("seq"))
    want = rows(search.search(whole, queries, **search.RECORDS | {"min_score": 2}))
    assert want and rows(search.search(store.open_version(spark, at), queries, **search.RECORDS | {"min_score": 2})) == want
    assert store.compact(spark, at) == 3
    last = store.open_version(spark, at)
    same(last, whole)
    assert rows(last.columns.select("block", "bucket")) == sorted(set(rows(last.columns.select("block", "bucket"))))
    assert rows(search.search(last, queries, **search.RECORDS | {"min_score": 2})) == want
    gone = store.vacuum(spark, at)
    assert len(gone) == 3 and store.versions(spark, at) == [3]  # two generations before the compaction, and the lost append
    same(store.open_version(spark, at), whole)
    store.remove(spark, at)
    with pytest.raises(FileNotFoundError):
        store.open_version(spark, at)


def test_of_two_writers_one_fails(spark, tmp_path, genomes, monkeypatch):
    at = f"{tmp_path}/i"
    store.create(spark, at, P)
    with pytest.raises(store.VersionTaken):
        store.create(spark, at, P)
    write = store._write

    def late(*args):
        with monkeypatch.context() as m:
            m.setattr(store, "_write", write)
            store.append(spark, at, part(genomes, 0, 2))
        write(*args)

    monkeypatch.setattr(store, "_write", late)
    with pytest.raises(store.VersionTaken):
        store.append(spark, at, part(genomes, 2, 6))
    assert store.versions(spark, at) == [0, 1]
    same(store.open_version(spark, at), index.build(part(genomes, 0, 2), P))
    monkeypatch.setattr(store, "_write", write)
    with pytest.raises(ValueError):
        store.append(spark, at, part(genomes, 0, 2), numbered=True)
    store.append(spark, at, genomes.where("genome_id >= 2"), numbered=True)
    same(store.open_version(spark, at), index.build(genomes.where("genome_id <> 30"), P))


def test_queries_prune_the_scan_while_they_run(spark, tmp_path, genomes):
    at = f"{tmp_path}/i"
    store.create(spark, at, P, ranges=32)
    store.append(spark, at, genomes)
    saved = store.open_version(spark, at)
    every = len(saved.columns.inputFiles())
    queries = genomes.where("genome_id = 3").select(F.col("genome_id").alias("query_id"), F.substring("seq", 1, 16).alias("seq"))
    q = search.query_sketch(saved, queries)
    assert 0 < q.count() <= 4
    got = search.match_counts(saved, q)
    want = rows(search.match_counts(index.build(genomes, P), q))
    assert rows(got) == want and want
    plan = got._jdf.queryExecution()
    assert "dynamicpruning" in plan.toString()
    read = [int(x) for x in _scan_metrics(plan.executedPlan(), "numFiles")]
    assert read and max(read) <= 4 < every


def _scan_metrics(plan, name):
    """Values of a metric of the scans of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from _scan_metrics(plan.executedPlan(), name)
        return
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from _scan_metrics(plan.plan(), name)
        return
    if plan.nodeName().startswith("Scan parquet"):
        yield plan.metrics().apply(name).value()
    children = plan.children()
    for i in range(children.size()):
        yield from _scan_metrics(children.apply(i), name)


def test_columns_of_no_range_need_no_pruning(spark, genomes):
    built = index.build(genomes, P)
    q = search.query_sketch(built, genomes.select(F.col("genome_id").alias("query_id"), "seq"))
    assert rows(columns.match_counts(built.columns, q)) == rows(search.match_counts(built, q))
