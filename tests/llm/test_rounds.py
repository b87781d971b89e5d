"""Work of the rounds of components, in Spark jobs."""

import random
import uuid

from tessella.llm import graph


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def labels(df):
    rows = df.collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["label"] for r in rows}


def test_components_of_known_and_new_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    parts = [spark.createDataFrame(x, "a long, b long") for x in (edges[:120], edges[120:])]
    first = graph.components(parts[0])
    whole = labels(graph.components(parts[0].union(parts[1])))
    assert labels(graph.components(parts[1], first)) == {n: c for n, c in whole.items()}
    # Edges within components, and none at all, leave all as it is.
    assert labels(graph.components(parts[0], first)) == labels(first)
    assert labels(graph.components(parts[0].limit(0), first)) == labels(first)


def test_new_edges_take_few_jobs(spark):
    """Of a known chain, only the joined labels go by rounds; a round has no job beside its checkpoint's."""
    chain = [(i, i + 1) for i in range(64)] + [(i, i + 1) for i in range(100, 140)]
    known, whole = jobs_of(spark, lambda: graph.components(spark.createDataFrame(chain, "a long, b long")))
    found, more = jobs_of(spark, lambda: graph.components(spark.createDataFrame([(140, 64)], "a long, b long"), known))
    assert set(labels(found).values()) == {0}
    assert more < whole / 2


def test_estimates_do_not_grow_with_rounds(spark):
    """Spark's estimate of a table's size is a number of a few digits, however many rounds made the table."""
    known = None
    for a, b in ((0, 64), (100, 140), (64, 100)):
        edges = [(i, i + 1) for i in range(a, b)]
        known = graph.components(spark.createDataFrame(edges, "a long, b long"), known)
        assert int(known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**9
    assert set(labels(known).values()) == {0}
