"""Queries on summaries by batch and on runs after an edit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as inc
from .registry import query
from .storage import packed

_OWN = "SELECT p_partkey AS node, CASE WHEN p_partkey % 9 = 0 THEN CAST(POWER(2, p_size % 21) AS BIGINT) ELSE 0 END AS caps FROM {part}"
#: After an edit: some functions gained or lost capabilities, and some calls went.
_EDITED = "SELECT p_partkey AS node, CASE WHEN p_partkey % 90 = 0 THEN 0 WHEN p_partkey % 100 = 1 THEN 2097152 WHEN p_partkey % 9 = 0 THEN CAST(POWER(2, p_size % 21) AS BIGINT) ELSE 0 END AS caps FROM {part}"
_KEPT = "NOT (line = 3 AND src % 40 = 7)"


def _reach(edges: str, own: str) -> str:
    own = own.format(part="part")
    return f"""WITH RECURSIVE r AS (SELECT DISTINCT src, dst FROM {edges} UNION SELECT r.src, e.dst FROM r JOIN (SELECT DISTINCT src, dst FROM {edges}) e ON e.src = r.dst)
  SELECT n.node, bit_or(o.caps) AS caps FROM ({own}) n JOIN (SELECT src, dst FROM r UNION SELECT node, node FROM ({own})) x ON x.src = n.node JOIN ({own}) o ON o.node = x.dst GROUP BY 1"""


def _own(h, sql=_OWN):
    return h.spark.sql(sql, part=h.base("part")).select("node", F.col("caps").cast("long").alias("caps"))


@query("g57_batched_summaries", _reach("branching", _OWN))
def _(h):
    own = _own(h)
    planned = inc.plan(h.branching, own)
    return inc.by_node(inc.evaluate(own, planned)[0], planned[0])


@query("g57_after_an_edit", _reach(f"(SELECT * FROM branching WHERE {_KEPT})", _EDITED))
def _(h):
    """The state of a full run is brought up to date; only what an edit can reach is evaluated."""
    own, edited, calls = _own(h), _own(h, _EDITED), packed(h.branching)
    planned = inc.plan(calls, own)
    state, planned, _ = inc.rerun(edited, own, calls.where(_KEPT), calls, inc.evaluate(own, planned)[0], planned)
    return inc.by_node(state, planned[0])


@query("e11_changed_keys", f"""SELECT o.node, CASE WHEN o.caps <> e.caps THEN 'summary' ELSE 'calls' END AS reason FROM ({_OWN.format(part='part')}) o JOIN ({_EDITED.format(part='part')}) e ON e.node = o.node
  WHERE o.caps <> e.caps OR o.node IN (SELECT src FROM (SELECT DISTINCT src, dst FROM branching EXCEPT SELECT DISTINCT src, dst FROM branching WHERE {_KEPT}))""")
def _(h):
    """Functions whose own summary or calls differ between two scans."""
    was, now = _own(h).withColumnRenamed("caps", "was"), _own(h, _EDITED)
    lost = h.branching.select("src", "dst").distinct().join(h.branching.where(_KEPT).select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(F.col("src").alias("node")).distinct().withColumn("calls", F.lit(True))
    j = now.join(was, "node").join(lost, "node", "left").where("caps <> was OR calls")
    return j.select("node", F.when(F.col("caps") != F.col("was"), "summary").otherwise("calls").alias("reason"))


@query("g49_branching_components", """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM branching), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
  n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src = node), node)) AS component FROM n""")
def _(h):
    from ..operators.graph import scc

    return scc(h.branching)
