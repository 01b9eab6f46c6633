"""Queries on the attack surface and on chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.findings import one_of
from ..operators import surface as s
from ..operators.numbering import numbered
from .registry import query

POINTS = """CASE WHEN cap_bits & 1024 <> 0 THEN 40.0 WHEN cap_bits & 256 <> 0 THEN 35.0 WHEN cap_bits & 262144 <> 0 THEN 30.0 WHEN cap_bits & (524288 + 16384 + 32768) <> 0 THEN 22.0
 WHEN cap_bits & (1048576 + 65536) <> 0 THEN 18.0 WHEN cap_bits & 64 <> 0 THEN 15.0 WHEN cap_bits & 131072 <> 0 THEN 10.0 ELSE 8.0 END"""
STORE = "CASE store_kind WHEN 'Sql' THEN 12.0 WHEN 'Document' THEN 10.0 WHEN 'KeyValue' THEN 8.0 WHEN 'Filesystem' THEN 8.0 ELSE 4.0 END"
RISK = f"""(SELECT idx, (CASE WHEN auth_required THEN raw ELSE raw * 1.5 + 5 END)::DOUBLE AS score FROM (
 SELECT e.idx, e.auth_required, coalesce(worst, 0) + CASE WHEN n > 1 THEN least((n - 1) * 2, 10) ELSE 0 END + coalesce(w + 5, r, 0) + CASE WHEN x > 0 THEN 8 ELSE 0 END + CASE WHEN method IN ('POST', 'PUT', 'DELETE') THEN 3 ELSE 0 END AS raw
 FROM entries e LEFT JOIN (SELECT entry, max({POINTS}) FILTER (node_kind = 'DangerousLocal') AS worst, count(*) FILTER (node_kind = 'DangerousLocal') AS n,
   max({STORE}) FILTER (node_kind = 'DataStore' AND edge_kind = 'WritesTo') AS w, max({STORE}) FILTER (node_kind = 'DataStore' AND edge_kind <> 'WritesTo') AS r, count(*) FILTER (node_kind = 'ExternalService') AS x FROM surface_edges GROUP BY 1) a ON a.entry = e.idx))"""
TIER = "CASE WHEN score >= 60 THEN 'Critical' WHEN score >= 35 THEN 'High' WHEN score >= 12 THEN 'Medium' ELSE 'Low' END"


@query("a44_entry_risk", f"SELECT idx, score, {TIER} AS tier FROM {RISK}")
def risk(h):
    return s.entry_risk(h.entries, h.surface_edges)


@query("t10_entry_order", f"SELECT idx, row_number() OVER (ORDER BY score DESC, idx)::INT AS place FROM {RISK}")
def _(h):
    return numbered(risk(h).select("idx", "score"), [F.desc("score"), F.col("idx")]).select("idx", (F.col("place") + 1).cast("int").alias("place"))


@query("x56_risk_tier", f"SELECT {TIER} AS tier, count(*) AS n FROM {RISK} GROUP BY 1")
def _(h):
    return risk(h).groupBy("tier").agg(F.count("*").alias("n"))


REACHED = "(SELECT DISTINCT 'src/' || CAST(s_suppkey % 7 AS STRING) || '/f' || CAST(s_suppkey % 50 AS STRING) || '.js' AS file, 'src/' || CAST(s_nationkey % 7 AS STRING) || '/f' || CAST(s_nationkey % 50 AS STRING) || '.py' AS entry_file FROM supplier)"


def reached(h):
    path = lambda c, ext: F.concat(F.lit("src/"), F.col(c) % 7, F.lit("/f"), F.col(c) % 50, F.lit(ext))
    return h.base("supplier").select(path("s_suppkey", ".js").alias("file"), path("s_nationkey", ".py").alias("entry_file")).distinct()


@query("j12_exposure", f"""SELECT f.pos, e.route, e.auth_required AS gated, e.far FROM findings f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file ORDER BY auth_required, far, idx, route) AS k FROM (
 SELECT file, idx, route, auth_required, false AS far FROM entries UNION ALL SELECT r.file, e.idx, e.route, e.auth_required, true FROM entries e JOIN {REACHED} r ON r.entry_file = e.file)) e ON e.file = f.path AND e.k = 1""")
def _(h):
    return s.exposure(h.findings.select("pos", "path"), h.entries, reached(h)).drop("path")


@query("j13_chain_edges", "SELECT f.pos, f.sink_caps AS cap, min(e.idx) AS entry FROM findings f LEFT JOIN entries e ON e.file = f.path WHERE f.severity = 'HIGH' GROUP BY 1, 2")
def _(h):
    first = h.entries.groupBy(F.col("file").alias("path")).agg(F.min("idx").alias("entry"))
    return h.findings.where("severity = 'HIGH'").join(first, "path", "left").select("pos", F.col("sink_caps").alias("cap"), "entry")


@query("j14_entry_affinity", "SELECT DISTINCT a.idx AS a, b.idx AS b FROM entries a JOIN entries b ON a.method = b.method AND a.idx < b.idx AND a.auth_required = b.auth_required")
def _(h):
    a = h.entries.select(F.col("idx").alias("a"), "method", "auth_required")
    b = h.entries.select(F.col("idx").alias("b"), "method", "auth_required")
    return a.join(b, ["method", "auth_required"]).where("a < b").select("a", "b").distinct()


IMPACT = """CASE WHEN (a = 131072 AND b = 4096) OR (b = 131072 AND a = 4096) THEN 'SessionHijack' WHEN (a = 65536 AND b = 1024) OR (b = 65536 AND a = 1024) THEN 'BrowserToLocalRce' WHEN (a = 32 AND b = 8192) OR (b = 32 AND a = 8192) THEN 'InfoDisclosure'
 WHEN a IN (1024, 256) THEN 'Rce' WHEN a = 512 THEN 'InternalNetworkAccess' WHEN b IN (1024, 256) THEN 'Rce' WHEN b = 512 THEN 'InternalNetworkAccess' END"""


@query("a48_impact", f"SELECT DISTINCT a, b, {IMPACT} AS impact FROM (SELECT CAST(POWER(2, p_partkey % 21) AS BIGINT) AS a, CAST(POWER(2, p_partkey // 21 % 21) AS BIGINT) AS b FROM part)")
def _(h):
    p = h.base("part").select(F.expr("CAST(POWER(2, p_partkey % 21) AS BIGINT)").alias("a"), F.expr("CAST(POWER(2, (p_partkey div 21) % 21) AS BIGINT)").alias("b")).distinct()
    return p.select("a", "b", s.impact(F.col("a"), F.col("b")).alias("impact"))


CHAINS = f"""(SELECT path, function_name, list(pos ORDER BY k) AS members, round((sum(w) + 1) * product(f), 6) AS score, {IMPACT.replace('(a =', '(first(sink_caps ORDER BY k) =').replace('AND a =', 'AND first(sink_caps ORDER BY k) =').replace('WHEN a ', 'WHEN first(sink_caps ORDER BY k) ').replace('(b =', '(last(sink_caps ORDER BY k) =').replace('AND b =', 'AND last(sink_caps ORDER BY k) =').replace('WHEN b ', 'WHEN last(sink_caps ORDER BY k) ')} AS impact
 FROM (SELECT *, row_number() OVER (PARTITION BY path, function_name ORDER BY line, col, pos) AS k, CASE severity WHEN 'HIGH' THEN 5.0 WHEN 'MEDIUM' THEN 3.0 ELSE 1.0 END::DOUBLE AS w, CASE WHEN verdict = 'Confirmed' THEN 1.0 WHEN confidence = 'High' THEN 0.8 ELSE 0.5 END::DOUBLE AS f FROM findings) WHERE k <= 4 GROUP BY 1, 2)"""


@query("a45_chains", f"SELECT path, function_name, members, score, impact FROM {CHAINS}")
def _(h):
    return s.chains(h.findings).withColumn("score", F.round("score", 6))


@query("j16_chain_members", f"SELECT unnest(members) AS pos, path, function_name FROM {CHAINS} WHERE score >= 3.5")
def _(h):
    return s.chains(h.findings).where("round(score, 6) >= 3.5").select(F.explode("members").alias("pos"), "path", "function_name")


@query("j17_drop_constituents", f"SELECT pos FROM findings WHERE pos NOT IN (SELECT unnest(members) FROM {CHAINS} WHERE score >= 3.5)")
def _(h):
    members = s.chains(h.findings).where("round(score, 6) >= 3.5").select(F.explode("members").alias("pos"))
    return h.findings.select("pos").join(members, "pos", "left_anti")


@query("a47_chain_severity", f"SELECT path, function_name, CASE WHEN impact IN ('Rce', 'BrowserToLocalRce') THEN 'Critical' WHEN impact IN ('SessionHijack', 'InternalNetworkAccess') THEN 'High' WHEN impact IS NOT NULL THEN 'Medium' ELSE 'Low' END AS severity FROM {CHAINS}")
def _(h):
    sev = one_of(F.col("impact"), {"Rce": "Critical", "BrowserToLocalRce": "Critical", "SessionHijack": "High", "InternalNetworkAccess": "High", "InfoDisclosure": "Medium"}, "Low")
    return s.chains(h.findings).select("path", "function_name", sev.alias("severity"))


@query("w12_chain_canonical", "SELECT path, sink_caps, min(pos) AS pos FROM findings GROUP BY 1, 2")
def _(h):
    w = Window.partitionBy("path", "sink_caps").orderBy("pos")
    return h.findings.withColumn("k", F.row_number().over(w)).where("k = 1").select("path", "sink_caps", "pos")


@query("w13_surface_canonical", "SELECT (dense_rank() OVER (ORDER BY node_kind, target) - 1)::INT AS id, entry, target FROM surface_edges")
def _(h):
    nodes = numbered(h.surface_edges.select("node_kind", "target").distinct(), [F.col("node_kind"), F.col("target")], "id").withColumn("id", F.col("id").cast("int"))
    return h.surface_edges.join(nodes, ["node_kind", "target"]).select("id", "entry", "target")


@query("g66_data_stores", "SELECT store_kind, edge_kind, count(*) AS n FROM surface_edges WHERE node_kind = 'DataStore' GROUP BY 1, 2")
def _(h):
    return h.surface_edges.where("node_kind = 'DataStore'").groupBy("store_kind", "edge_kind").agg(F.count("*").alias("n"))


@query("g68_dangerous_locals", "SELECT target, cap_bits FROM surface_edges WHERE cap_bits & (1024 + 256 + 262144 + 524288 + 64) <> 0")
def _(h):
    return h.surface_edges.where(F.col("cap_bits").bitwiseAND(1024 + 256 + 262144 + 524288 + 64) != 0).select("target", "cap_bits")


