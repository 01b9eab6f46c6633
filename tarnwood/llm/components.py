"""Connected components without collecting anything: hook to the least neighbour, jump, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) forests -> (node, root); each round halves the depth."""
    now = stash(parents, "forest")
    while True:
        up = now.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        then = stash(now.join(up, now.parent == up._n).select("node", F.col("_p").alias("parent"), (F.col("_p") != F.col("parent")).alias("moved")), "forest")
        moved = not then.where("moved").isEmpty()
        discard(now)
        now = then.select("node", "parent")
        now.stash_path = then.stash_path
        if not moved:
            return now


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, label): the smallest node reachable, for every node with an edge.

    Each round contracts every tree of least neighbours to its root, so chains shrink by jumping and
    stars in one step. Loops and repeated edges are harmless; an empty table gives an empty one.
    """
    edges = stash(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        roots = _roots(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent")))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("label"))
        else:
            up = roots.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
            labels = stash(labels.join(up, labels.label == up._n, "left").select("node", F.coalesce("_p", "label").alias("label")), "labels")
        to_a, to_b = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra")), roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        fewer = stash(edges.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges = fewer
        if edges.isEmpty():
            return labels
