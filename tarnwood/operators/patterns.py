"""Structural patterns over syntax trees held as rows.

nodes      file, pre (place in document order), post (place of the last node inside), parent (its place; null at the top), kind, text
patterns   pattern, kind, text (regular expression or null), relation, other_kind, other_text, same_text, not_relation, not_kind, not_text, and what else describes it

A pattern matches a node of its kind that stands in the relation to a node of the other kind; a null relation needs none. With same_text both hold the same text. Matches that stand in
not_relation to a node of not_kind are suppressed. Relations: child, parent, descendant, ancestor, sibling (a later one).

Intervals nest, so no pairs of nodes are formed: a node has an ancestor among some nodes if the running maximum of their ends reaches it, a descendant if the next of them begins before its own end;
one window over a file each. Child, parent and sibling are equi-joins. The unit of a window is a file and a pattern. The nodes are kept in the shared folder: each relation reads them, and
parsing or grouping what they come from is done once.

Defined cases: null kinds match nothing, null texts only a null expression; a node is never its own relative; repeated nodes match alike; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import packed

RELATIONS = ("child", "parent", "descendant", "ancestor", "sibling")
#: Patterns up to which they are broadcast; more are joined on the kind by a shuffle.
FEW = 10_000


def _candidates(nodes: DataFrame, patterns: DataFrame, kind: str, text: str, relation: str | None) -> DataFrame:
    """(pattern, relation, key, file, pre, post, parent): nodes of a pattern's role. key is the text where both must be equal."""
    p = patterns.select("pattern", F.col(kind).alias("kind"), F.col(text).alias("wanted"), (F.col(relation) if relation else F.lit(None).cast("string")).alias("relation"), F.col("same_text") if relation == "relation" else F.lit(False).alias("same_text"))
    p = p.where(F.col("kind").isNotNull())
    rows = nodes.join(F.broadcast(p) if p.count() <= FEW else p, "kind").where(F.col("wanted").isNull() | F.expr("text RLIKE wanted"))
    return rows.select("pattern", "relation", F.when(F.col("same_text"), F.coalesce("text", F.lit(""))).otherwise("").alias("key"), "file", "pre", "post", "parent")


def _related(anchors: DataFrame, others: DataFrame) -> DataFrame:
    """(pattern, file, pre) of the anchors that stand in their pattern's relation to one of the others."""
    own = ["pattern", "key", "file"]

    def of(df: DataFrame, relation: str) -> DataFrame:
        return df.where(F.col("relation") == relation)

    def joined(relation: str, mine: str, theirs: str) -> DataFrame:
        o = of(others, relation).select(*own, F.col(theirs).alias(mine)).distinct()
        return of(anchors, relation).join(o, [*own, mine], "left_semi")

    def swept(relation: str, order: Column, seen: Column, test: Column) -> DataFrame:
        both = of(anchors, relation).withColumn("role", F.lit(0)).unionByName(of(others, relation).withColumn("role", F.lit(1)))
        w = Window.partitionBy(*own).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        return both.withColumn("seen", seen.over(w)).where((F.col("role") == 0) & test)

    other = F.col("role") == 1
    later = of(others, "sibling").groupBy(*own, "parent").agg(F.max("pre").alias("last"))
    found = [
        joined("child", "pre", "parent"),
        joined("parent", "parent", "pre"),
        swept("ancestor", F.col("pre").asc(), F.max(F.when(other, F.col("post"))), F.col("seen") >= F.col("pre")),
        swept("descendant", F.col("pre").desc(), F.min(F.when(other, F.col("pre"))), F.col("seen") <= F.col("post")),
        of(anchors, "sibling").join(later, [*own, "parent"]).where("last > pre"),
    ]
    return reduce(DataFrame.unionByName, (f.select("pattern", "file", "pre") for f in found)).distinct()


def matches(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, file, pre, one row for each matched node and pattern."""
    return _matches(_kept(nodes), patterns)


def _kept(nodes: DataFrame) -> DataFrame:
    return packed(nodes.select("file", "pre", "post", "parent", "kind", "text"))


def _matches(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    at = ["pattern", "file", "pre"]
    free = _candidates(nodes, patterns.where("relation IS NULL"), "kind", "text", None).select(*at)
    anchors = _candidates(nodes, patterns.where("relation IS NOT NULL"), "kind", "text", "relation")
    hits = _related(anchors, _candidates(nodes, patterns, "other_kind", "other_text", "relation")).unionByName(free).distinct()
    held = patterns.where("not_relation IS NOT NULL")
    suppressed = _related(_candidates(nodes, held, "kind", "text", "not_relation"), _candidates(nodes, held, "not_kind", "not_text", "not_relation"))
    return hits.join(suppressed, at, "left_anti")


def findings(nodes: DataFrame, patterns: DataFrame, *described: str) -> DataFrame:
    """Matches with the node's text and the columns that describe the pattern."""
    nodes = _kept(nodes)
    hits = _matches(nodes, patterns)
    rows = hits.join(nodes.select("file", "pre", "text").distinct(), ["file", "pre"])
    p = patterns.select("pattern", *described)
    return rows.join(F.broadcast(p) if p.count() <= FEW else p, "pattern")
