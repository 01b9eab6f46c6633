"""Queries on names of functions, files, packages and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as na
from .registry import query

_LANG = "CASE lower(regexp_extract(path, '[.]([a-z]+)$', 1)) WHEN 'rs' THEN 'Rust' WHEN 'c' THEN 'C' WHEN 'cpp' THEN 'C++' WHEN 'java' THEN 'Java' WHEN 'go' THEN 'Go' WHEN 'php' THEN 'PHP' WHEN 'py' THEN 'Python' WHEN 'ts' THEN 'TypeScript' WHEN 'js' THEN 'JavaScript' WHEN 'rb' THEN 'Ruby' END"


@query("p02_point", "SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN 2 ELSE 1 END AS line, (CASE WHEN contains(text, chr(10)) THEN least(3, strlen(split_part(text, chr(10), 2))) ELSE strlen(text) END)::INT AS col FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def _(h):
    """The point up to three bytes into the second line, or the end of a single one."""
    d = h.base("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first, second = F.substring_index("text", "\n", 1), F.regexp_extract("text", "^[^\n]*\n([^\n]*)", 1)
    offset = F.octet_length(first) + F.when(F.instr("text", "\n") > 0, 1 + F.least(F.lit(3), F.octet_length(second))).otherwise(0)
    line, col = na.point(F.col("text"), offset)
    return d.select("doc_id", line.alias("line"), col.alias("col"))


@query("p06_finding_language", f"SELECT {_LANG} AS lang, count(*) AS n FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy(na.display_language(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))


@query("p09_severity_order", "SELECT pos, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS ord FROM findings")
def _(h):
    return h.findings.select("pos", na.severity_order(F.col("severity")).alias("ord"))


_CAPS = ["env_var", "HTML_ESCAPE", "sql_query", "data_exfiltration", "ldapi", "crlf", "redirect", "template_injection", "proto_pollution", "nonsense", "All", "xxe"]
_CAP_BITS = [1, 2, 128, 8192, 16384, 65536, 131072, 262144, 1048576, None, 2097151, 524288]


@query("p12_parse_capability", "SELECT p_partkey AS k, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {'NULL' if b is None else b}" for i, b in enumerate(_CAP_BITS)) + " END::BIGINT AS bit FROM part")
def _(h):
    v = h.spark.createDataFrame(list(enumerate(_CAPS)), "i long, name string")
    return h.base("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 12).alias("i")).join(F.broadcast(v), "i").select("k", na.parse_capability(F.col("name")).alias("bit"))


@query("p14_sarif_base", "SELECT CASE WHEN id = 'taint-data-exfiltration' THEN id WHEN id LIKE 'taint-%' THEN 'taint-unsanitised-flow' ELSE id END AS base, count(*) AS n FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy(na.sarif_base(F.col("id")).alias("base")).agg(F.count("*").alias("n"))


@query("p18_package_namespace", "SELECT fid, CASE WHEN fid % 3 = 0 THEN namespace ELSE '@org/p' || fid % 5 || '::' || namespace END AS qualified, namespace AS back FROM functions")
def _(h):
    package = F.when(F.col("fid") % 3 == 0, "").otherwise(F.concat(F.lit("@org/p"), F.col("fid") % 5))
    q = h.functions.select("fid", na.with_package(package, F.col("namespace")).alias("qualified"))
    return q.select("fid", "qualified", na.without_package(F.col("qualified")).alias("back"))


@query("p23_container_hint", "SELECT fid, CASE WHEN fid % 3 < 2 THEN CASE WHEN container = '' THEN namespace ELSE container END ELSE '' END AS hint, CASE WHEN fid % 3 = 0 THEN name WHEN fid % 3 = 1 THEN namespace || CASE WHEN container = '' THEN '' ELSE '::' || container END || '::' || name ELSE name END AS bare FROM functions")
def _(h):
    parts = lambda mark: F.concat_ws(mark, "namespace", F.nullif("container", F.lit("")), "name")
    callee = F.when(F.col("fid") % 3 == 0, parts(".")).when(F.col("fid") % 3 == 1, parts("::")).otherwise(F.col("name"))
    return h.functions.select("fid", na.container_hint(callee).alias("hint"), na.bare_method(callee).alias("bare"))


_FILES = [
    ("a/x.test.js", True, False), ("a/x.spec.tsx", True, False), ("a/test_x.py", True, False), ("a/x_test.go", True, False), ("a/XTest.java", True, False), ("a/FooIT.java", True, False), ("__tests__/x.js", True, False), ("a/conftest.py", True, False), ("a/test_x.go", False, False), ("a/tests/x.py", False, False),
    ("a/latest.js", False, False), ("a/x.min.js", False, True), ("a/X.BUNDLE.js", False, True), ("vendor/a.ts", False, True), ("Vendors/a.css", False, True), ("vendor/a.go", False, False), ("bower_components/x.go", False, True), ("a/vendor.js", False, False), ("x_spec.rb", True, False), ("a/y_tests.rs", True, False),
]


def _files(h):
    v = h.spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(_FILES)], "i long, tail string")
    return h.base("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % len(_FILES)).alias("i")).join(F.broadcast(v), "i").select("k", F.concat(F.lit("src/d"), "k", F.lit("/"), "tail").alias("path"))


def _flags(at: int) -> str:
    return f"CASE p_partkey % {len(_FILES)} " + " ".join(f"WHEN {i} THEN {f[at]}" for i, f in enumerate(_FILES)) + " END"


@query("p40_test_files", f"SELECT p_partkey AS k, {_flags(1)} AS test FROM part")
def _(h):
    return _files(h).select("k", na.is_test(F.col("path")).alias("test"))


@query("p42_vendored_assets", f"SELECT p_partkey AS k, {_flags(2)} AS vendored FROM part")
def _(h):
    return _files(h).select("k", na.is_vendored(F.col("path")).alias("vendored"))


@query("k22_short_callee", "SELECT fid, CASE fid % 4 WHEN 0 THEN name || '(a(b), c)…' WHEN 1 THEN name || '(x)' WHEN 2 THEN name || '(never' ELSE name END AS short FROM functions")
def _(h):
    tail = F.when(F.col("fid") % 4 == 0, "(a(b), c).then(d)").when(F.col("fid") % 4 == 1, "(x)  ").when(F.col("fid") % 4 == 2, "(never").otherwise("")
    return h.functions.select("fid", na.shorten(F.concat("name", tail)).alias("short"))


@query("x62_terminal_state", "SELECT state, count(*) AS n, bool_and(state IN ('false_positive', 'accepted_risk', 'suppressed', 'fixed')) AS terminal FROM triage GROUP BY 1")
def _(h):
    return h.triage.groupBy("state").agg(F.count("*").alias("n")).select("state", "n", na.is_terminal(F.col("state")).alias("terminal"))


_CALLS = [("js", "Promise.all", "All"), ("tsx", "Promise.race", "Race"), ("JavaScript", "Promise.allSettled", "AllSettled"), ("py", "asyncio.gather", "All"), ("python", "Promise.all", None), ("rust", "tokio::join", "All"), ("go", "sync.Wait", None), ("ts", "Promise.resolve", "Resolve")]


@query("x51_promise_combinators", "SELECT p_partkey AS k, CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{c[2]}'" for i, c in enumerate(_CALLS) if c[2]) + " END AS kind FROM part")
def _(h):
    v = h.spark.createDataFrame([(i, lang, c) for i, (lang, c, _) in enumerate(_CALLS)], "i long, lang string, callee string")
    return h.base("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 8).alias("i")).join(F.broadcast(v), "i").select("k", na.combinator(F.col("lang"), F.col("callee")).alias("kind"))
