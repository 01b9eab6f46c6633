"""Queries over functions, call sites and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .registry import query

RESOLVED = """(WITH c AS (SELECT s.site, f.fid, CASE WHEN coalesce(f.container = s.container_hint, false) AND (s.arity IS NULL OR s.arity = f.arity) THEN 1 WHEN coalesce(f.container = s.container_hint, false) THEN 2
  WHEN f.namespace = o.namespace AND (s.arity IS NULL OR s.arity = f.arity) THEN 3 WHEN f.namespace = o.namespace THEN 4 WHEN s.arity IS NULL OR s.arity = f.arity THEN 5 ELSE 6 END AS step
  FROM call_sites s JOIN functions o ON o.fid = s.caller JOIN functions f ON f.lang = o.lang AND f.name = s.name),
 k AS (SELECT site, step, count(*) AS n, min(fid) AS fid, row_number() OVER (PARTITION BY site ORDER BY step) AS r FROM c GROUP BY 1, 2)
 SELECT s.site, CASE WHEN k.n IS NULL THEN 'NotFound' WHEN k.n = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status, CASE WHEN k.n = 1 THEN k.fid END AS callee, k.step FROM call_sites s LEFT JOIN k ON k.site = s.site AND k.r = 1)"""
CLOSURE = "WITH RECURSIVE r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst)"
NODES = "(SELECT src AS node FROM edges UNION SELECT dst FROM edges)"


def resolved(h):
    return g.resolve_calls(h.call_sites, h.functions)


@query("j01_call_resolution", f"SELECT * FROM {RESOLVED}")
def _(h):
    return resolved(h)


@query("j02_hierarchy_widening", "SELECT site, fid AS callee FROM (SELECT site, fid, row_number() OVER (PARTITION BY site ORDER BY fid) AS k FROM (SELECT DISTINCT s.site, f.fid FROM call_sites s JOIN hierarchy t ON t.super_type = s.container_hint JOIN functions f ON f.container = t.sub_type AND f.name = s.name)) WHERE k <= 8")
def _(h):
    return g.widen_by_hierarchy(h.call_sites, h.functions, h.hierarchy)


@query("g48_call_graph", f"SELECT s.caller AS src, r.callee AS dst, count(*) AS sites FROM {RESOLVED} r JOIN call_sites s ON s.site = r.site WHERE r.status = 'Resolved' GROUP BY 1, 2")
def _(h):
    r = resolved(h).where("status = 'Resolved'").select("site", "callee")
    return r.join(h.call_sites.select("site", "caller"), "site").groupBy(F.col("caller").alias("src"), F.col("callee").alias("dst")).agg(F.count("*").alias("sites"))


@query("g48_unresolved_calls", f"SELECT s.name, r.status, count(*) AS n FROM {RESOLVED} r JOIN call_sites s ON s.site = r.site WHERE r.status <> 'Resolved' GROUP BY 1, 2")
def _(h):
    return resolved(h).where("status <> 'Resolved'").join(h.call_sites.select("site", "name"), "site").groupBy("name", "status").agg(F.count("*").alias("n"))


@query("g49_scc", f"{CLOSURE} SELECT n.node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src = n.node AND a.dst < n.node), n.node) AS component FROM {NODES} n")
def _(h):
    return g.scc(h.edges)


@query("g50_recursive_components", f"{CLOSURE} SELECT node FROM {NODES} WHERE node IN (SELECT src FROM r WHERE src = dst)")
def _(h):
    c = g.scc(h.edges)
    big = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return c.join(big, "component").select("node").union(h.edges.where("src = dst").select(F.col("src").alias("node"))).distinct()


@query("g51_cross_file_components", f"{CLOSURE}, c AS (SELECT n.node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src = n.node AND a.dst < n.node), n.node) AS component FROM {NODES} n) SELECT component, count(DISTINCT f.namespace) AS files FROM c JOIN functions f ON f.fid = c.node GROUP BY 1 HAVING count(DISTINCT f.namespace) > 1")
def _(h):
    return g.scc(h.edges).join(h.functions.select(F.col("fid").alias("node"), "namespace"), "node").groupBy("component").agg(F.count_distinct("namespace").alias("files")).where("files > 1")


@query("g52_batches", f"""{CLOSURE}, c AS (SELECT n.node, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src = n.node AND a.dst < n.node), n.node) AS component FROM {NODES} n),
d AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM edges e JOIN c a ON a.node = e.src JOIN c b ON b.node = e.dst WHERE a.component <> b.component),
p AS (SELECT DISTINCT component, 0 AS level FROM c UNION SELECT d.src, p.level + 1 FROM p JOIN d ON d.dst = p.component)
SELECT component, max(level)::INT AS level FROM p GROUP BY 1""")
def _(h):
    return g.batches(h.edges, g.scc(h.edges))


@query("g53_direct_callers", "SELECT dst AS node, count(DISTINCT src) AS callers FROM edges GROUP BY 1")
def _(h):
    return h.edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("callers"))


@query("g54_transitive_callers", f"{CLOSURE} SELECT dst AS start, src AS node FROM r WHERE dst <> src")
def _(h):
    back = h.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = h.edges.select(F.col("dst").alias("start")).distinct()
    return g.reach(back, starts).where("start <> node").select("start", "node")


@query("g55_file_reach", f"{CLOSURE} SELECT DISTINCT a.namespace AS file, b.namespace AS caller FROM r JOIN functions a ON a.fid = r.dst JOIN functions b ON b.fid = r.src")
def _(h):
    ns = h.functions.select("fid", "namespace")
    callers = g.reach(h.edges, h.edges.select(F.col("src").alias("start"))).where("depth > 0").select("start", F.col("node"))
    # a cycle brings a start back to itself, which reach() holds at depth 0
    loops = g.scc(h.edges)
    again = loops.join(loops.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component").select(F.col("node").alias("start"), "node").union(h.edges.where("src = dst").select("src", "dst"))
    pairs = callers.union(again).distinct()
    return pairs.join(ns.withColumnRenamed("fid", "node").withColumnRenamed("namespace", "file"), "node").join(ns.withColumnRenamed("fid", "start").withColumnRenamed("namespace", "caller"), "start").select("file", "caller").distinct()


@query("g56_surface_bfs", "WITH RECURSIVE r AS (SELECT src AS start, src AS node, 0 AS depth FROM edges UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 8) SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def _(h):
    return g.reach(h.edges, h.edges.select(F.col("src").alias("start")).distinct(), g.SURFACE_DEPTH)


def _roots(h):
    """Nodes that nothing calls."""
    return h.edges.select(F.col("src").alias("start")).distinct().join(h.edges.select(F.col("dst").alias("start")), "start", "left_anti")


@query("g64_shortest_distance", "WITH RECURSIVE r AS (SELECT DISTINCT src AS node, 0 AS depth FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 30) SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1")
def _(h):
    return g.distances(h.edges, _roots(h), 30)


@query("g63_reachable", "WITH RECURSIVE r AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node) SELECT node FROM r")
def _(h):
    return g.distances(h.edges, _roots(h)).select("node")


@query("g57_summary_fixpoint", f"{CLOSURE} SELECT n.node, bit_or(coalesce(f.sink_caps, 0)) AS caps, true AS converged FROM {NODES} n LEFT JOIN (SELECT src, dst FROM r UNION SELECT node, node FROM {NODES}) x ON x.src = n.node LEFT JOIN functions f ON f.fid = x.dst GROUP BY 1")
def _(h):
    nodes = h.edges.select(F.col("src").alias("node")).union(h.edges.select("dst")).distinct()
    own = nodes.join(h.functions.select(F.col("fid").alias("node"), F.col("sink_caps").alias("caps")), "node", "left").select("node", F.coalesce("caps", F.lit(0)).cast("long").alias("caps"))
    return g.propagate_caps(h.edges, own)


@query("g58_unconverged")
def _(h):
    own = h.functions.select(F.col("fid").alias("node"), F.col("sink_caps").alias("caps"))
    return g.propagate_caps(h.edges, own, rounds=1).where("NOT converged").select("node", F.lit("fixpoint cap hit").alias("note"))


@query("g59_type_hierarchy", "SELECT super_type, list_sort(list(DISTINCT sub_type)) AS subs FROM hierarchy GROUP BY 1")
def _(h):
    return h.hierarchy.groupBy("super_type").agg(F.array_sort(F.collect_set("sub_type")).alias("subs"))


@query("g60_class_methods", "SELECT lang, container, name, count(*) AS n, min(fid) AS first FROM functions WHERE container <> '' GROUP BY 1, 2, 3")
def _(h):
    return h.functions.where("container <> ''").groupBy("lang", "container", "name").agg(F.count("*").alias("n"), F.min("fid").alias("first"))


@query("j22_typed_receivers", "SELECT s.site, s.container_hint, count(f.fid) AS methods FROM call_sites s LEFT JOIN functions f ON f.container = s.container_hint AND f.name = s.name WHERE s.container_hint IS NOT NULL GROUP BY 1, 2")
def _(h):
    methods = h.functions.groupBy(F.col("container").alias("container_hint"), "name").agg(F.count("*").alias("methods"))
    return h.call_sites.where("container_hint IS NOT NULL").join(methods, ["container_hint", "name"], "left").select("site", "container_hint", F.coalesce("methods", F.lit(0)).alias("methods"))


@query("a32_summary_merge", "SELECT caller AS fid, bit_or(f.source_caps) AS source_caps, bit_or(f.sink_caps) AS sink_caps, coalesce(list_sort(list(DISTINCT s.arity) FILTER (s.arity IS NOT NULL)), []) AS params FROM call_sites s JOIN functions f ON f.fid = s.caller GROUP BY 1")
def _(h):
    parts = h.call_sites.join(h.functions.select(F.col("fid").alias("caller"), "source_caps", "sink_caps"), "caller").select(F.col("caller").alias("fid"), "source_caps", "sink_caps", F.col("arity").alias("param"))
    return g.merge_summaries(parts)


@query("e10_changed_keys", "SELECT coalesce(a.fid, b.fid) AS fid FROM (SELECT fid, sink_caps FROM functions WHERE fid % 7 <> 0) a FULL JOIN (SELECT fid, CASE WHEN fid % 11 = 0 THEN sink_caps + 1 ELSE sink_caps END AS sink_caps FROM functions WHERE fid % 5 <> 0) b ON a.fid = b.fid WHERE a.sink_caps IS DISTINCT FROM b.sink_caps")
def _(h):
    a = h.functions.where("fid % 7 <> 0").select("fid", F.col("sink_caps").alias("x"))
    b = h.functions.where("fid % 5 <> 0").select("fid", F.when(F.col("fid") % 11 == 0, F.col("sink_caps") + 1).otherwise(F.col("sink_caps")).alias("y"))
    return a.join(b, "fid", "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("fid")


@query("e12_caller_files", "SELECT DISTINCT namespace FROM functions WHERE fid IN (SELECT e.src FROM edges e JOIN functions c ON c.fid = e.dst WHERE c.sink_caps <> 0) OR sink_caps <> 0 AND fid IN (SELECT dst FROM edges)")
def _(h):
    changed = h.edges.join(h.functions.where("sink_caps <> 0").select(F.col("fid").alias("dst")), "dst").select("src", "dst")
    ids = changed.select(F.col("src").alias("fid")).union(changed.select("dst")).distinct()
    return h.functions.join(ids, "fid", "left_semi").select("namespace").distinct()


BODY = "(SELECT src // 20 AS body, src, dst FROM edges WHERE src // 20 = dst // 20 UNION SELECT src // 20, src // 20 * 20 + (src * 7 + dst) % 20, src // 20 * 20 + (src + dst * 3) % 20 FROM edges)"
DOMINATORS = f"""WITH RECURSIVE e AS {BODY}, n AS (SELECT body, src AS node FROM e UNION SELECT body, dst FROM e), s AS (SELECT body, min(node) AS entry FROM n GROUP BY 1),
r AS (SELECT s.body, b.node AS banned, s.entry AS node FROM s JOIN (SELECT body, node FROM n UNION SELECT body, -1 FROM s) b ON b.body = s.body WHERE b.node <> s.entry
 UNION SELECT r.body, r.banned, e.dst FROM r JOIN e ON e.body = r.body AND e.src = r.node WHERE e.dst <> r.banned),
live AS (SELECT body, node FROM r WHERE banned = -1),
dom AS (SELECT d.body, d.node AS d, v.node AS v FROM live d JOIN live v ON v.body = d.body WHERE d.node = v.node OR d.node = (SELECT entry FROM s WHERE s.body = d.body) OR NOT EXISTS (SELECT 1 FROM r WHERE r.body = d.body AND r.banned = d.node AND r.node = v.node)),
k AS (SELECT body, v, count(*) AS depth FROM dom GROUP BY 1, 2)
SELECT n.body, n.node, l.node IS NOT NULL AS reachable, CASE WHEN l.node IS NULL THEN NULL WHEN n.node = s.entry THEN n.node ELSE (SELECT arg_max(dom.d, k.depth) FROM dom JOIN k ON k.body = dom.body AND k.v = dom.d WHERE dom.body = n.body AND dom.v = n.node AND dom.d <> n.node) END AS idom
FROM n JOIN s ON s.body = n.body LEFT JOIN live l ON l.body = n.body AND l.node = n.node"""


def bodies(h):
    e = h.edges.withColumn("body", F.floor(F.col("src") / 20))
    local = e.where(F.floor(F.col("dst") / 20) == F.col("body")).select("body", "src", "dst")
    more = e.select("body", (F.col("body") * 20 + (F.col("src") * 7 + F.col("dst")) % 20).alias("src"), (F.col("body") * 20 + (F.col("src") + F.col("dst") * 3) % 20).alias("dst"))
    return local.union(more).distinct()


@query("g03_dominators", DOMINATORS)
def _(h):
    from ..operators.bodies import analyse

    return analyse(bodies(h)).select("body", "node", "reachable", "idom")


@query("g05_frontier_sizes", DOMINATORS.split("SELECT n.body, n.node")[0] + """SELECT n.body, n.node, (SELECT count(DISTINCT e.dst) FROM dom d JOIN e ON e.body = d.body AND e.src = d.v WHERE d.body = n.body AND d.d = n.node AND NOT EXISTS (SELECT 1 FROM dom x WHERE x.body = e.body AND x.d = d.d AND x.v = e.dst AND x.d <> x.v)) AS frontier FROM n""")
def _(h):
    from ..operators.bodies import analyse

    return analyse(bodies(h)).select("body", "node", "frontier")


@query("g43_loops_and_frontiers")
def _(h):
    from ..operators.bodies import analyse

    return analyse(bodies(h)).select("body", "node", "frontier", "loops")


@query("d03_unreachable", DOMINATORS.replace("SELECT n.body, n.node, l.node IS NOT NULL AS reachable, CASE", "SELECT body, node FROM (SELECT n.body, n.node, l.node IS NOT NULL AS reachable, CASE") + ") WHERE NOT reachable")
def _(h):
    from ..operators.bodies import analyse

    return analyse(bodies(h)).where("NOT reachable").select("body", "node")


@query("j29_unguarded_sinks", DOMINATORS.split("SELECT n.body, n.node")[0] + "SELECT DISTINCT v.body, v.node FROM live v WHERE v.node % 3 = 0 AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.body = v.body AND dom.v = v.node AND dom.d % 4 = 1)")
def _(h):
    from ..operators.bodies import analyse

    up = analyse(bodies(h)).where("reachable").select("body", "node", "idom")
    tree = up.where("node <> idom").select("body", F.col("idom").alias("d"), "node")
    # guards cover what they dominate: the dominator tree walked down from them, a level a join
    from ..plans.storage import cut

    tree = cut(tree)
    covered = cut(up.where("node % 4 = 1").select("body", "node"))
    new = covered
    while not new.isEmpty():
        new = cut(tree.join(new.withColumnRenamed("node", "d"), ["body", "d"]).select("body", "node").distinct().join(covered, ["body", "node"], "left_anti"))
        covered = cut(covered.unionByName(new))
    return up.where("node % 3 = 0").select("body", "node").join(covered, ["body", "node"], "left_anti")
