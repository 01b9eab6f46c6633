"""Queries that write an index of artefacts by file, change it and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sinks.snapshots import Snapshots
from .registry import query
from .storage import shared_folder

_TABLES = ("summaries", "ssa_summaries", "ssa_bodies", "auth_summaries")
_FILES = "SELECT namespace AS path, fid, lang, name, source_caps, sink_caps, arity FROM functions"
#: Files that a second scan finds changed, and what it finds in them: a function less in three, other capabilities.
_CHANGED = "(SELECT DISTINCT namespace FROM functions WHERE source_caps > 0 AND arity = 1)"
_AGAIN = f"SELECT namespace AS path, fid, lang, name, source_caps * 2 AS source_caps, sink_caps + 1 AS sink_caps, arity FROM functions WHERE namespace IN {_CHANGED} AND fid % 3 > 0"
_NOW = f"now_rows AS ({_FILES} WHERE namespace NOT IN {_CHANGED} UNION ALL {_AGAIN})"


def _artefacts(rows) -> dict:
    return {
        "summaries": rows.select("path", "fid", "name", "source_caps"),
        "ssa_summaries": rows.select("path", "fid", "sink_caps"),
        "ssa_bodies": rows.select("path", "fid", F.encode(F.to_json(F.struct("name", "arity")), "UTF-8").alias("body")),
        "auth_summaries": rows.where("arity > 0").select("path", "fid", "lang"),
    }


def _scans(h):
    first = h.functions.withColumnRenamed("namespace", "path")
    changed = first.where("source_caps > 0 AND arity = 1").select("path").distinct()
    again = first.join(changed, "path", "left_semi").where("fid % 3 > 0").withColumns({"source_caps": F.col("source_caps") * 2, "sink_caps": F.col("sink_caps") + 1})
    return first, changed, again


def _store(h, tables=_TABLES) -> Snapshots:
    """An index after a first scan of all files and a second of the changed ones."""
    store = Snapshots(h.spark, f"{shared_folder(h.spark)}/index-{uuid.uuid4().hex}")
    first, changed, again = _scans(h)
    store.replace(first, {t: a for t, a in _artefacts(first).items() if t in tables})
    store.replace(changed, {t: a for t, a in _artefacts(again).items() if t in tables})
    return store


@query("k03_replace_artefacts", f"WITH {_NOW} SELECT 'summaries' AS kind, path, count(*) AS n, sum(fid + source_caps) AS value FROM now_rows GROUP BY 2 UNION ALL SELECT 'ssa_summaries', path, count(*), sum(fid + sink_caps) FROM now_rows GROUP BY 2 UNION ALL SELECT 'ssa_bodies', path, count(*), sum(fid) FROM now_rows GROUP BY 2 UNION ALL SELECT 'auth_summaries', path, count(*), sum(fid) FROM now_rows WHERE arity > 0 GROUP BY 2")
def _(h):
    store = _store(h)
    value = {"summaries": F.col("fid") + F.col("source_caps"), "ssa_summaries": F.col("fid") + F.col("sink_caps")}
    parts = [store.read(t).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(value.get(t, F.col("fid"))).alias("value")).select(F.lit(t).alias("kind"), "path", "n", "value") for t in _TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("k04_replace_summaries", f"WITH {_NOW} SELECT path, fid, name, source_caps FROM now_rows")
def _(h):
    return _store(h, ("summaries",)).read("summaries")


@query("k05_replace_ssa_summaries", f"WITH {_NOW} SELECT path, fid, sink_caps FROM now_rows")
def _(h):
    return _store(h, ("ssa_summaries",)).read("ssa_summaries")


@query("k06_replace_ssa_bodies", f"WITH {_NOW} SELECT path, fid, name, arity FROM now_rows")
def _(h):
    """Bodies are bytes in the index (and decoded when they are loaded)."""
    rows = _store(h, ("ssa_bodies",)).read("ssa_bodies")
    return rows.select("path", "fid", F.from_json(F.decode("body", "UTF-8"), "name string, arity int").alias("b")).select("path", "fid", "b.name", "b.arity")


@query("k07_replace_auth_summaries", f"WITH {_NOW} SELECT path, fid, lang FROM now_rows WHERE arity > 0")
def _(h):
    return _store(h, ("auth_summaries",)).read("auth_summaries")


@query("k08_replace_surface_map", "SELECT 'node' AS kind, idx AS a, idx AS b, route AS label FROM entries UNION ALL SELECT 'edge', entry, target, edge_kind FROM surface_edges")
def _(h):
    """The map of a project is replaced altogether; the second one counts."""
    store = Snapshots(h.spark, f"{shared_folder(h.spark)}/index-{uuid.uuid4().hex}")
    nodes, edges = h.entries.select("idx", "route"), h.surface_edges.select("entry", "target", "edge_kind")
    store.replace_whole({"surface_nodes": nodes.limit(0), "surface_edges": edges.where("target < entry")})
    store.replace_whole({"surface_nodes": nodes, "surface_edges": edges})
    n = store.read("surface_nodes").select(F.lit("node").alias("kind"), F.col("idx").alias("a"), F.col("idx").alias("b"), F.col("route").alias("label"))
    return n.unionByName(store.read("surface_edges").select(F.lit("edge").alias("kind"), F.col("entry").alias("a"), F.col("target").alias("b"), F.col("edge_kind").alias("label")))


@query("k14_clear", "SELECT 'scans' AS kind, count(*) AS n FROM scans UNION ALL SELECT 'summaries', 0 UNION ALL SELECT 'removed', 0")
def _(h):
    """Caches go and the history of scans stays; removed files leave nothing behind."""
    store = _store(h, ("summaries",))
    store.replace_whole({"scans": h.scans})
    store.remove(store.read("summaries").select("path"))
    left = store.read("summaries").agg(F.lit("removed").alias("kind"), F.count(F.lit(1)).alias("n"))
    store.clear(["summaries"])
    return store.read("scans").agg(F.lit("scans").alias("kind"), F.count(F.lit(1)).alias("n")).unionByName(store.read("summaries").agg(F.lit("summaries").alias("kind"), F.count(F.lit(1)).alias("n"))).unionByName(left)
