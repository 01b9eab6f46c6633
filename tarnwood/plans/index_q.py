"""Queries on the index, on configuration, and on symbolic values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice as la
from ..functions import symbolic as sy
from ..operators import graph as g
from ..operators import index as ix
from .registry import query

_FILES = "(SELECT p_partkey AS path, p_size AS mtime, p_brand AS hash FROM part WHERE p_retailprice < 1500)"
_INDEX = "(SELECT p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size END AS mtime, CASE WHEN p_size % 6 = 0 THEN 'old' ELSE p_brand END AS hash FROM part WHERE p_retailprice >= 1000)"


def _indexed(h):
    p = h.base("part")
    files = p.where("p_retailprice < 1500").selectExpr("p_partkey AS path", "p_size AS mtime", "p_brand AS hash")
    index = p.where("p_retailprice >= 1000").selectExpr("p_partkey AS path", "CASE WHEN p_size % 3 = 0 THEN p_size + 1 ELSE p_size END AS mtime", "CASE WHEN p_size % 6 = 0 THEN 'old' ELSE p_brand END AS hash")
    return files, index


@query("s16_file_status", f"SELECT coalesce(f.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN f.mtime = i.mtime THEN 'unchanged' WHEN f.hash = i.hash THEN 'touched' ELSE 'changed' END AS status FROM {_FILES} f FULL JOIN {_INDEX} i ON i.path = f.path")
def _(h):
    return ix.file_status(*_indexed(h))


@query("s17_changed_by_hash", f"SELECT f.path FROM {_FILES} f WHERE NOT EXISTS (SELECT 1 FROM {_INDEX} i WHERE i.path = f.path AND i.hash = f.hash)")
def _(h):
    from ..sources import changed

    files, index = _indexed(h)
    return changed(files, index, ["path", "hash"]).select("path")


@query("s25_indexed_files", f"SELECT path, hash FROM {_INDEX} WHERE path IN (SELECT path FROM {_FILES})")
def _(h):
    files, index = _indexed(h)
    return index.join(files.select("path"), "path", "left_semi").select("path", "hash")


@query("u06_rule_toggle", "SELECT id FROM (SELECT p_brand AS id, 1 AS n FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3) UNION ALL SELECT p_type, 1 FROM (SELECT DISTINCT p_type FROM part WHERE p_size < 5) UNION ALL SELECT p_brand, 1 FROM part WHERE p_size = 2 UNION ALL SELECT p_type, 1 FROM part WHERE p_size = 7) GROUP BY 1 HAVING sum(n) % 2 = 1")
def _(h):
    p = h.base("part")
    off = p.where("p_size < 3").select(F.col("p_brand").alias("id")).distinct().union(p.where("p_size < 5").select("p_type").distinct())
    return ix.toggle(off, p.where("p_size = 2").select(F.col("p_brand").alias("id")).union(p.where("p_size = 7").select("p_type")))


@query("u07_rule_clone", "WITH r AS (SELECT DISTINCT p_brand AS id, true AS builtin FROM part) SELECT id, builtin FROM r UNION ALL SELECT id || '-custom', false FROM r WHERE id IN (SELECT p_brand FROM part WHERE p_size = 3)")
def _(h):
    p = h.base("part")
    return ix.clone(p.select(F.col("p_brand").alias("id"), F.lit(True).alias("builtin")).distinct(), p.where("p_size = 3").select(F.col("p_brand").alias("id")))


@query("s28_config_merge", "SELECT key, arg_max(value, n) AS value FROM (SELECT DISTINCT p_type AS key, 'default' AS value, 0 AS n FROM part UNION ALL SELECT DISTINCT p_type, CASE WHEN p_type LIKE 'S%' THEN 'user' END, 1 FROM part UNION ALL SELECT DISTINCT 'x ' || p_type, 'user', 1 FROM part WHERE p_size = 4 UNION ALL SELECT DISTINCT p_type, 'profile', 2 FROM part WHERE p_type LIKE '%E%') WHERE value IS NOT NULL GROUP BY 1")
def _(h):
    p, key = h.base("part"), F.col("p_type").alias("key")
    user = p.select(key, F.when(F.col("p_type").startswith("S"), "user").alias("value")).distinct().union(p.where("p_size = 4").select(F.concat(F.lit("x "), "p_type"), F.lit("user")).distinct())
    return ix.merge_config(p.select(key, F.lit("default").alias("value")).distinct(), user, p.where(F.col("p_type").contains("E")).select(key, F.lit("profile").alias("value")).distinct())


@query("u01_custom_labels", """SELECT call, label, cap_bits FROM (SELECT c.call, r.label, r.cap_bits, row_number() OVER (PARTITION BY c.call ORDER BY r.n, -length(r.matcher), r.matcher, r.label, r.cap_bits) AS k FROM (SELECT site AS call, 'lib' || site % 3 || '.' || name AS callee, name FROM call_sites) c
 JOIN (SELECT 'm1' AS matcher, 'source' AS label, 1 AS cap_bits, 0 AS n UNION ALL SELECT 'lib2.m1', 'sink', 128, 0 UNION ALL SELECT 'lib0.m2', 'sanitizer', 2, 0 UNION ALL SELECT 'm1', 'sink', 4, 1 UNION ALL SELECT 'm2', 'sink', 128, 1 UNION ALL SELECT 'm3', 'source', 1, 1) r ON r.matcher = c.callee OR r.matcher = c.name) WHERE k = 1""")
def _(h):
    calls = h.call_sites.select(F.col("site").alias("call"), F.concat(F.lit("lib"), F.col("site") % 3, F.lit("."), "name").alias("callee"))
    rules = lambda *rows: h.spark.createDataFrame(rows, "matcher string, label string, cap_bits int")
    return ix.custom_labels(calls, rules(("m1", "source", 1), ("lib2.m1", "sink", 128), ("lib0.m2", "sanitizer", 2)), rules(("m1", "sink", 4), ("m2", "sink", 128), ("m3", "source", 1)))


@query("k11_scan_update", "SELECT scan_id, CASE WHEN scan_id % 2 = 0 THEN 'archived' ELSE status END AS status, finding_count FROM scans UNION ALL SELECT 0, 'archived', NULL")
def _(h):
    changes = h.scans.where("scan_id % 2 = 0").select("scan_id", F.lit("archived").alias("status")).union(h.spark.createDataFrame([(0, "archived")], "scan_id long, status string"))
    return ix.update_scans(h.scans.select("scan_id", "status", "finding_count"), changes)


@query("a41_component_records", "SELECT subject, count(*) AS rounds, max(delta) AS largest, arg_max(delta, seq) AS last, count(*) >= 8 AND arg_max(delta, seq) > 0 AS capped FROM deltas GROUP BY 1")
def _(h):
    return ix.fixpoint_records(h.deltas, 8)


@query("d16_decorator_level", "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 1 THEN 'Authed' WHEN 2 THEN 'Admin' WHEN 3 THEN 'Admin' WHEN 4 THEN 'Authed' ELSE 'Unauthed' END AS level FROM part")
def _(h):
    rows = [(0, []), (1, ["app.route", "login_required"]), (2, ["login_required", "requires_Admin"]), (3, ["PreAuthorize hasRole('x')"]), (4, ["auth.permission_required"]), (5, ["login_required_not"])]
    v = h.spark.createDataFrame(rows, "i long, decorators array<string>")
    return h.base("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 6).alias("i")).join(F.broadcast(v), "i").select("k", ix.decorator_level(F.col("decorators")).alias("level"))


@query("a33_summaries_merge", "SELECT caller AS fid, bit_or(f.source_caps) AS source_caps, bit_or(f.sink_caps) AS sink_caps, coalesce(list_sort(list(DISTINCT s.arity) FILTER (s.arity IS NOT NULL)), []) AS params FROM call_sites s JOIN functions f ON f.fid = s.caller GROUP BY 1")
def _(h):
    """Partial summaries of two scans, merged each, then with each other."""
    parts = h.call_sites.join(h.functions.select(F.col("fid").alias("caller"), "source_caps", "sink_caps"), "caller").select(F.col("caller").alias("fid"), "source_caps", "sink_caps", F.col("arity").alias("param"), "site")
    a, b = (g.merge_summaries(parts.where(f"site % 2 = {k}")) for k in (0, 1))
    return g.merge_merged(a.unionByName(b))


_SYM = "(SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN ' ' || lang || ' ' END AS a, 'v' || doc_id AS name, CASE WHEN doc_id % 4 > 0 THEN source END AS b FROM documents)"


def _symbols(h):
    d = h.base("documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" "), "lang", F.lit(" "))).alias("a"), F.concat(F.lit("v"), "doc_id").alias("name"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("b"))
    value = lambda c: F.when(F.col(c).isNotNull(), sy.known(F.col(c))).otherwise(sy.symbol(F.col("name")))
    return d.select("doc_id", value("a").alias("a"), value("b").alias("b"))


def _symbolic(name: str, literal: str, text: str, f):
    @query(name, f"SELECT doc_id, {literal} AS literal, coalesce({literal}, {text}) AS text FROM {_SYM}")
    def _(h):
        return _symbols(h).select("doc_id", f(F.col("a"), F.col("b")).alias("v")).select("doc_id", "v.literal", "v.text")


_symbolic("x33_concat", "a || b", "'concat(' || coalesce(a, name) || ', ' || coalesce(b, name) || ')'", sy.concat)
_symbolic("x34_phi", "CASE WHEN a = b THEN a END", "'phi(' || coalesce(a, name) || ', ' || coalesce(b, name) || ')'", lambda a, b: F.when(F.coalesce(a.literal == b.literal, F.lit(False)), a).otherwise(sy.symbol(F.concat(F.lit("phi("), a.text, F.lit(", "), b.text, F.lit(")")))))
_symbolic("x35_trim", "trim(a)", "'trim(' || name || ')'", lambda a, b: sy.trim(a))
_symbolic("x35_lower_upper", "lower(upper(a))", "'lower(upper(' || name || '))'", lambda a, b: sy.lower(sy.upper(a)))
_symbolic("x36_replace", "replace(a, 'e', b)", "'replace(' || coalesce(a, name) || ', e, ' || coalesce(b, name) || ')'", lambda a, b: sy.replace(a, sy.known(F.lit("e")), b))
_symbolic("x37_substring", "a[2:3]", "'substring(' || name || ', 1, 2)'", lambda a, b: sy.substring(a, F.lit(1), F.lit(2)))
_symbolic("x38_length", "CAST(length(a) AS VARCHAR)", "'length(' || name || ')'", lambda a, b: sy.length(a))

_KINDS = ("html", "url", "shell", "sql", "base64")
_W = "(SELECT doc_id, doc_id % 5 AS k, '<a href=\"x\">O''Neil & ' || lang || ' é*+/' || doc_id AS w FROM documents)"


def _witnesses(h):
    return h.base("documents").select("doc_id", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit("<a href=\"x\">O'Neil & "), "lang", F.lit(" é*+/"), "doc_id").alias("w"))


@query("x39_encode", f"""SELECT doc_id, CASE k WHEN 0 THEN replace(replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') WHEN 1 THEN url_encode(w)
 WHEN 2 THEN chr(39) || replace(w, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) WHEN 3 THEN replace(w, chr(39), chr(39) || chr(39)) ELSE base64(encode(w)) END AS encoded FROM {_W}""")
def _(h):
    return _witnesses(h).select("doc_id", sy.encoded(F.col("kind"), F.col("w")).alias("encoded"))


@query("x40_decode_back", f"SELECT doc_id, CASE WHEN k IN (1, 4) THEN w END AS decoded FROM {_W}")
def _(h):
    return _witnesses(h).select("doc_id", sy.decoded(F.col("kind"), sy.encoded(F.col("kind"), F.col("w"))).alias("decoded"))


_VALUES = "(SELECT p_partkey AS k, p_partkey % 50 AS alo, p_partkey % 50 + p_size AS ahi, p_partkey % 31 AS blo, p_partkey % 31 + p_size % 9 AS bhi, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS an, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS bn, p_partkey * 37 % 1023 + 1 AS aty, p_partkey * 11 % 1023 + 1 AS bty FROM part)"


def _values(h):
    d = h.base("part").selectExpr("p_partkey AS k", "p_partkey % 50 AS alo", "p_partkey % 50 + p_size AS ahi", "p_partkey % 31 AS blo", "p_partkey % 31 + p_size % 9 AS bhi", "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS an", "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS bn", "p_partkey * 37 % 1023 + 1 AS at", "p_partkey * 11 % 1023 + 1 AS bt")
    return d.select("k", la.value_fact(la.interval(F.col("alo"), F.col("ahi")), F.col("an"), F.col("at")).alias("a"), la.value_fact(la.interval(F.col("blo"), F.col("bhi")), F.col("bn"), F.col("bt")).alias("b"))


def _value(name: str, lo: str, hi: str, null: str, types: str, f, none: str = "false"):
    @query(name, f"SELECT k, CASE WHEN {none} THEN 1 ELSE ({lo}) END::BIGINT AS lo, CASE WHEN {none} THEN 0 ELSE ({hi}) END::BIGINT AS hi, CASE WHEN NOT {none} THEN {null} END AS is_null, CASE WHEN {none} THEN 0 ELSE {types} END::BIGINT AS types FROM {_VALUES}")
    def _(h):
        return _values(h).select("k", f(F.col("a"), F.col("b")).alias("v")).select("k", "v.range.lo", "v.range.hi", "v.is_null", "v.types")


_value("x29_value_join", "least(alo, blo)", "greatest(ahi, bhi)", "CASE WHEN an IS NOT DISTINCT FROM bn THEN an END", "aty | bty", la.value_join)
_value("x30_value_widen", "CASE WHEN alo = blo THEN alo END", "CASE WHEN ahi = bhi THEN ahi END", "CASE WHEN an IS NOT DISTINCT FROM bn THEN an END", "aty | bty", la.value_widen)
_value("x28_value_meet", "greatest(alo, blo)", "least(ahi, bhi)", "coalesce(an, bn)", "aty & bty", la.value_meet, "(greatest(alo, blo) > least(ahi, bhi) OR coalesce(an <> bn, false) OR (aty & bty) = 0)")
