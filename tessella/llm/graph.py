"""Connected components of an edge table by label propagation with shortcuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tessella.shared import shared_folder, stored, stored_counted


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, label (least node of its component) for undirected edges with long columns a and b.

    Each round takes the least label among neighbours and then the label of that label, so long
    paths shrink fast. State is a table of files in the shared folder; no part of the graph reaches the driver.
    `known` has the components of earlier edges: then only the labels that the new edges join go by rounds.
    """
    folder = f"{shared_folder(edges.sparkSession)}/components-{uuid.uuid4().hex}"
    if known is None:
        return labelled(edges, folder)
    found = edges
    for c in ("a", "b"):
        named = known.select(F.col("node").alias(c), "label")
        found = found.join(named, c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
    joined = labelled(found.where("a <> b"), folder).select(F.col("node").alias("label"), F.col("label").alias("joint"))
    # A node of the new edges that was not known is its own label.
    nodes = known.select("node", "label").unionByName(joined.select(F.col("label").alias("node"), "label").join(known.select("node"), "node", "left_anti"))
    return stored(nodes.join(joined, "label", "left").select("node", F.coalesce("joint", "label").alias("label")), f"{folder}/all")


def labelled(edges: DataFrame, folder: str) -> DataFrame:
    """As components(), by rounds over all edges. A round's count of changed labels is taken by the round's own job.

    The folder gets the edges and the labels of the last two rounds.
    """
    edges = stored(edges.select("a", "b"), f"{folder}/edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{folder}/labels0")
    moved, turn = 1, 0
    while moved:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "node").join(jump, "label")
        new = new.select("node", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        turn = 1 - turn
        new, moved = stored_counted(new, f"{folder}/labels{turn}", F.count_if("moved"))
        labels = new.select("node", "label")
    return labels
