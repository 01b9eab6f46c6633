"""The hub tables of program facts, as deterministic projections of a relational test set.

Each is one SQL text in the subset that every engine reads alike, integers only in keys, so a query and its oracle start from the same rows. Real
inputs come from tarnwood.sources; what the operators see has the same columns.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE l_partkey % 10 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.js' WHEN 3 THEN '.ts' WHEN 4 THEN '.go' WHEN 5 THEN '.java' WHEN 6 THEN '.rb' WHEN 7 THEN '.php' WHEN 8 THEN '.c' ELSE '.cpp' END"

#: One finding for each order line.
FINDINGS = f"""
SELECT (((l_orderkey * 10 + l_linenumber) * 20011 + l_partkey) * 1009 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS pos,
  'src/' || CAST(l_suppkey % 7 AS STRING) || CASE WHEN l_partkey % 13 = 0 THEN '/tests' ELSE '' END || '/f' || CAST(l_partkey % 50 AS STRING) || {_EXT} AS path,
  l_linenumber * 10 + l_partkey % 40 AS line, l_suppkey % 80 + 1 AS col,
  CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE l_partkey % 12 WHEN 4 THEN 'taint-data-exfiltration' WHEN 5 THEN 'state-use-after-close' WHEN 6 THEN 'state-resource-leak' WHEN 7 THEN 'cfg-unguarded-sink' WHEN 8 THEN 'cfg-error-fallthrough'
    WHEN 9 THEN 'py.code_exec.eval' WHEN 10 THEN 'rs.quality.unwrap' WHEN 11 THEN 'js.xss.document_write' WHEN 3 THEN 'taint-sql-injection'
    ELSE 'taint-unsanitised-flow (source ' || CAST(l_linenumber * 10 AS STRING) || ':' || CAST(l_suppkey % 9 AS STRING) || ')' END AS id,
  CASE WHEN l_partkey % 12 = 10 THEN 'Quality' WHEN l_partkey % 12 IN (5, 6) THEN 'Reliability' ELSE 'Security' END AS category,
  CASE l_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS confidence,
  CASE l_partkey % 7 WHEN 0 THEN 'UserInput' WHEN 1 THEN 'EnvironmentConfig' WHEN 2 THEN 'Unknown' WHEN 3 THEN 'FileSystem' WHEN 4 THEN 'Database' WHEN 5 THEN 'CaughtException' ELSE NULL END AS source_kind,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linenumber + l_suppkey % 6 END AS hop_count,
  CASE WHEN l_partkey % 11 = 1 THEN NULL ELSE l_linenumber * 10 + l_partkey % 40 - l_suppkey % 30 END AS source_line,
  l_orderkey % 17 AS source_col, CAST(l_orderkey % 3 AS INT) AS function_rank,
  CAST(l_orderkey % 3 AS INT) AS guards, CAST(l_partkey % 2 AS INT) AS sanitizers, l_partkey % 11 <> 1 AS has_source, l_partkey % 19 <> 1 AS has_sink,
  l_orderkey % 9 = 0 AS path_validated, CAST(POWER(2, l_partkey % 21) AS BIGINT) AS sink_caps, CAST(l_suppkey % 3 AS INT) AS cap_specificity, l_suppkey % 4 = 0 AS uses_summary,
  l_suppkey % 6 = 0 AS cross_file, CAST(l_linenumber % 4 AS INT) AS n_steps,
  CASE l_orderkey % 8 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Infeasible' WHEN 2 THEN 'Inconclusive' ELSE NULL END AS symbolic, l_orderkey % 16 = 0 AS witness,
  CASE l_suppkey % 9 WHEN 0 THEN 'Bail' WHEN 1 THEN 'OverReport' WHEN 2 THEN 'UnderReport' WHEN 3 THEN 'Informational' ELSE NULL END AS note_direction,
  CASE l_orderkey % 10 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'PartiallyConfirmed' WHEN 2 THEN 'NotConfirmed' WHEN 3 THEN 'Inconclusive' WHEN 4 THEN 'Unsupported' ELSE NULL END AS verdict, CAST(l_linenumber % 3 AS INT) AS n_attempts,
  CASE WHEN l_suppkey % 5 = 0 THEN l_orderkey % 2 = 0 ELSE NULL END AS auth_required, l_suppkey % 10 = 0 AS transitive,
  'fn_' || CAST(l_partkey % 97 AS STRING) AS function_name, 'sink' || CAST(l_partkey % 30 AS STRING) || '(x)' AS sink_snippet, 'src' || CAST(l_suppkey % 20 AS STRING) || '()' AS source_snippet, l_orderkey % 23 = 0 AS suppressed
FROM {{lineitem}}
"""

#: The next snapshot: some findings gone, some moved, some with another severity.
FINDINGS_B = f"""
SELECT pos, path, CASE WHEN pos % 7 = 0 THEN line + 3 ELSE line END AS line, col, CASE WHEN pos % 29 = 0 THEN 'HIGH' ELSE severity END AS severity, id, category,
  CASE WHEN pos % 31 = 0 THEN 'High' ELSE confidence END AS confidence, sink_caps, CASE WHEN pos % 37 = 0 THEN function_name || '_new' ELSE function_name END AS function_name, sink_snippet, source_snippet,
  CASE WHEN pos % 5 = 0 THEN 'Confirmed' WHEN pos % 41 = 0 THEN 'NotConfirmed' ELSE verdict END AS verdict
FROM ({FINDINGS}) f WHERE pos % 110 >= 10
"""

#: One scan a month, and the fingerprints each found.
SCANS = """
SELECT CAST(EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS scan_id, MIN(o_orderdate) AS started_at,
  CASE WHEN CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) % 6 = 0 THEN 'failed' ELSE 'completed' END AS status, COUNT(*) AS finding_count
FROM {orders} GROUP BY 1, 3
"""
SCAN_FINDINGS = """
SELECT DISTINCT CAST(EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS scan_id, o_custkey % 300 AS fingerprint, CASE WHEN o_custkey % 300 % 3 = 0 THEN 'HIGH' WHEN o_custkey % 300 % 3 = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM {orders}
"""

#: Decisions on findings, and rules that suppress by rule, rule in a file or file.
TRIAGE = """
SELECT (((l_orderkey * 10 + l_linenumber) * 20011 + l_partkey) * 1009 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS pos, CASE l_partkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'fixed' WHEN 2 THEN 'accepted_risk' ELSE 'investigating' END AS state, 'note ' || CAST(l_partkey AS STRING) AS note
FROM {lineitem} WHERE l_linestatus = 'O'
"""
RULES = """
SELECT s_suppkey AS rule_no, CASE s_suppkey % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'rule_in_file' ELSE 'file' END AS suppress_by,
  CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'state-resource-leak' ELSE 'rs.quality.unwrap' END
    WHEN 1 THEN 'cfg-unguarded-sink:src/' || CAST(s_suppkey % 7 AS STRING) || '/f' || CAST(s_suppkey % 50 AS STRING) || '.php'
    ELSE 'src/' || CAST(s_suppkey % 7 AS STRING) || '/f' || CAST(s_suppkey % 50 AS STRING) || '.py' END AS match_value,
  CASE WHEN s_suppkey % 2 = 0 THEN 'suppressed' ELSE 'false_positive' END AS state, s_suppkey * 37 % 101 AS created_at
FROM {supplier}
"""

#: Functions and call sites; names repeat, so some calls are ambiguous and some unresolved.
FUNCTIONS = """
SELECT p_partkey AS fid, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'java' END AS lang, 'ns' || CAST(p_partkey % 40 AS STRING) AS namespace,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'C' || CAST(p_partkey % 25 AS STRING) END AS container, 'm' || CAST(p_partkey % 700 AS STRING) AS name, CAST(p_size % 4 AS INT) AS arity,
  CASE WHEN p_partkey % 23 = 0 THEN CAST(POWER(2, p_size % 21) AS BIGINT) ELSE 0 END AS source_caps, CASE WHEN p_partkey % 17 = 0 THEN CAST(POWER(2, p_size % 21) AS BIGINT) ELSE 0 END AS sink_caps
FROM {part}
"""
CALL_SITES = """
SELECT (((l_orderkey * 10 + l_linenumber) * 20011 + l_partkey) * 1009 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS site, l_partkey AS caller, 'm' || CAST((l_partkey * 7 + l_linenumber) % 730 AS STRING) AS name, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 4 AS INT) END AS arity,
  CASE WHEN l_suppkey % 5 = 0 THEN 'C' || CAST(l_suppkey % 25 AS STRING) ELSE NULL END AS container_hint
FROM {lineitem}
"""
HIERARCHY = "SELECT DISTINCT 'C' || CAST(s_nationkey AS STRING) AS super_type, 'C' || CAST(s_suppkey % 25 AS STRING) AS sub_type FROM {supplier} WHERE s_nationkey <> s_suppkey % 25"

#: A call graph with cycles.
EDGES = "SELECT DISTINCT ps.p_partkey AS src, (ps.p_partkey * 3 + ps.p_size) % (SELECT count(*) FROM {part}) + 1 AS dst FROM {part} ps WHERE ps.p_size % 3 > 0"

#: A call graph that branches and meets: each function calls some of the tier below, nearly all call one of them, and pairs of a tier call each other.
CALLS = """
SELECT DISTINCT p AS src, CASE WHEN l_linenumber = 7 THEN CASE WHEN (p - p % 6) % 12 = 0 AND p + 6 < n THEN p + 6 ELSE p - 6 END WHEN l_linenumber = 1 THEN 0 ELSE (l_orderkey * 6 + p % 6 - 1) % (n - n % 6) END AS dst, l_linenumber AS line
FROM (SELECT l_partkey AS p, l_orderkey, l_linenumber FROM {lineitem}) l CROSS JOIN (SELECT count(*) AS n FROM {part}) c WHERE p % 6 > 0 OR l_linenumber = 7
"""

#: Attack surface: routes, and what they reach.
ENTRIES = "SELECT n_nationkey AS idx, '/r/' || CAST(n_nationkey AS STRING) AS route, CASE n_nationkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method, n_nationkey % 3 = 0 AS auth_required, 'src/' || CAST(n_nationkey % 7 AS STRING) || '/f' || CAST(n_nationkey % 50 AS STRING) || '.py' AS file FROM {nation}"
SURFACE_EDGES = """
SELECT s_nationkey AS entry, s_suppkey AS target, CASE s_suppkey % 4 WHEN 0 THEN 'DangerousLocal' WHEN 1 THEN 'DataStore' WHEN 2 THEN 'ExternalService' ELSE 'Other' END AS node_kind,
  CASE WHEN s_suppkey % 8 = 1 THEN 'WritesTo' WHEN s_suppkey % 8 = 5 THEN 'ReadsFrom' WHEN s_suppkey % 4 = 2 THEN 'TalksTo' ELSE 'Reaches' END AS edge_kind,
  CASE s_suppkey % 5 WHEN 0 THEN 'Sql' WHEN 1 THEN 'Filesystem' WHEN 2 THEN 'KeyValue' WHEN 3 THEN 'Cache' ELSE 'Document' END AS store_kind, CAST(POWER(2, s_suppkey % 21) AS BIGINT) AS cap_bits
FROM {supplier}
"""

#: Lifecycle events of one handle each.
LIFECYCLE = "SELECT user_id AS subject, event_id AS seq, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'use' WHEN 'error' THEN 'close' ELSE 'other' END AS op FROM {events}"

#: An authorization model: routes, what units do and check, line by line, and tokens they look up.
AUTH_ROUTES = """
SELECT o_orderkey AS unit, CASE o_custkey % 4 WHEN 0 THEN '/admin/users' WHEN 1 THEN '/api/admin' WHEN 2 THEN '/administrivia' ELSE '/api/items' END AS path,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'require_login' WHEN '2-HIGH' THEN 'require_login,is_admin' WHEN '3-MEDIUM' THEN 'log,login_required' WHEN '4-NOT SPECIFIED' THEN 'log' ELSE '' END AS guards
FROM {orders}
"""
AUTH_OPS = """
SELECT l_orderkey AS unit, l_linenumber * 10 + l_partkey % 10 AS line, ((l_linenumber * 20011 + l_partkey) * 1009 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS op, CASE l_returnflag WHEN 'R' THEN 'mutation' ELSE 'read' END AS kind, 's' || CAST(l_partkey % 3 AS STRING) AS subject,
  l_suppkey % 2 = 0 AS session_held, l_partkey % 5 < 2 AS batch, l_suppkey % 7 = 0 AS override FROM {lineitem} WHERE l_returnflag <> 'N'
"""
AUTH_CHECKS = """
SELECT l_orderkey AS unit, l_linenumber * 10 + l_partkey % 10 AS line, CASE l_partkey % 4 WHEN 0 THEN 'ownership' WHEN 1 THEN 'membership' WHEN 2 THEN 'admin' ELSE 'login' END AS kind, 's' || CAST(l_partkey % 3 AS STRING) AS subject, l_suppkey % 2 = 0 AS element
FROM {lineitem} WHERE l_returnflag = 'N'
"""
AUTH_LOOKUPS = "SELECT o_orderkey AS unit, o_custkey % 40 AS line, o_orderstatus = 'F' AS expiry_checked, o_custkey % 2 = 0 AS recipient_checked FROM {orders}"

#: Sizes of change sets by round: steady, falling, in turns and of no order.
DELTAS = "SELECT user_id AS subject, event_id AS seq, CASE user_id % 5 WHEN 0 THEN 3 WHEN 1 THEN event_id % 7 WHEN 2 THEN 1000000000 - event_id WHEN 3 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 2 ELSE 0 END AS delta FROM {events}"

#: Lines of text with markers of directives, secrets and conditions put in by rule.
LINES = """
SELECT doc_id, lang, source, n_chars,
  CASE doc_id % 9 WHEN 0 THEN 'if err != nil then return' WHEN 1 THEN 'if x is None:' WHEN 2 THEN 'if (name.length === 0)' WHEN 3 THEN 'if (ALLOWED.includes(name))' WHEN 4 THEN 'if re.match(PAT, name)' WHEN 5 THEN 'x instanceof String' WHEN 6 THEN 'if a < 10' WHEN 7 THEN '' ELSE 'if validate_name(name)' END AS condition,
  CASE doc_id % 8 WHEN 0 THEN 'request.cookies.get' WHEN 1 THEN 'req.headers' WHEN 2 THEN 'os.getenv' WHEN 3 THEN 'open' WHEN 4 THEN 'cursor.fetchone' WHEN 5 THEN 'request.args' WHEN 6 THEN 'compute' ELSE 'sys.argv' END AS callee,
  CASE doc_id % 6 WHEN 0 THEN 'key AKIA' || 'ABCDEFGHIJKLMNOP' || ' here' WHEN 1 THEN 'password = "hunter' || CAST(doc_id AS STRING) || '"' WHEN 2 THEN 'Authorization: Bearer abc.def.' || CAST(doc_id AS STRING) WHEN 3 THEN 'mail joe' || CAST(doc_id AS STRING) || '@example.com now' WHEN 4 THEN 'token ghp_' || 'abcdefghijklmnopqrstuvwxyz0123456789' ELSE 'nothing here ' || CAST(doc_id AS STRING) END AS snippet
FROM {documents}
"""

#: A tree of packages, folders and files; manifests with what they export; path aliases of configurations; and imports of all kinds by file.
MOD_FILES = """
SELECT p_partkey AS fid, 'w/p' || CAST(p_partkey % 60 AS STRING) || '/src' || CASE WHEN p_partkey % 5 = 0 THEN '/sub' ELSE '' END || '/m' || CAST(p_partkey % 7 AS STRING) || '/f' || CAST(p_partkey % 30 AS STRING)
  || CASE p_size % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '/index.ts' ELSE '.mjs' END AS path FROM {part}
"""
MOD_PACKAGES = """
SELECT DISTINCT 'w/p' || CAST(s_suppkey % 60 AS STRING) AS root, CASE WHEN s_suppkey % 60 % 2 = 0 THEN '@org/p' ELSE 'p' END || CAST(s_suppkey % 60 % 50 AS STRING) AS name,
  CASE WHEN s_suppkey % 60 % 3 = 0 THEN './src/m' || CAST(s_suppkey % 60 % 7 AS STRING) || '/f1' ELSE NULL END AS main, s_suppkey % 60 % 4 = 1 AS closed FROM {supplier}
UNION ALL SELECT DISTINCT 'w/p' || CAST(s_suppkey % 60 AS STRING) || '/src/sub', 'inner' || CAST(s_suppkey % 60 AS STRING), NULL, FALSE FROM {supplier} WHERE s_suppkey % 60 % 3 = 0
"""
MOD_EXPORTS = """
SELECT p.root, e.nth, e.key, CASE e.nth WHEN 0 THEN './src/m1/f1.ts' WHEN 1 THEN './src/m2/f2.js' WHEN 2 THEN './src/*' WHEN 3 THEN './src/m*' ELSE NULL END AS target
FROM (SELECT DISTINCT 'w/p' || CAST(s_suppkey % 60 AS STRING) AS root FROM {supplier} WHERE s_suppkey % 60 % 4 = 1) p,
  (SELECT 0 AS nth, '.' AS key UNION ALL SELECT 1, './two' UNION ALL SELECT 2, './lib/*' UNION ALL SELECT 3, './m*.js' UNION ALL SELECT 4, './lib/m3/f3') e
"""
MOD_ALIASES = """
SELECT CAST(config AS STRING) AS config, base, nth, prefix, wildcard, first_target, second_target FROM (
  SELECT 'w/tsconfig.json' AS config, 'w' AS base, 0 AS nth, '@/' AS prefix, TRUE AS wildcard, 'p1/src/*' AS first_target, 'p2/src/*' AS second_target
  UNION ALL SELECT 'w/tsconfig.json', 'w', 1, '@lib', FALSE, 'p3/src/m3/f3', 'p4/src/m4/f4'
  UNION ALL SELECT 'w/tsconfig.json', 'w', 2, '~', TRUE, '*', 'p5/src/m*'
  UNION ALL SELECT DISTINCT 'w/p' || CAST(s_suppkey % 60 AS STRING) || '/jsconfig.json', 'w/p' || CAST(s_suppkey % 60 AS STRING) || '/src', 0, '@/', TRUE, '*', 'sub/*' FROM {supplier} WHERE s_suppkey % 60 % 6 < 2) a
"""
MOD_IMPORTS = """
SELECT f.path AS file, l_linenumber AS nth, 'v' || CAST(l_suppkey % 4 AS STRING) AS local, CASE l_suppkey % 6 WHEN 0 THEN 'default' WHEN 1 THEN '*' ELSE 'fn' || CAST(l_suppkey % 9 AS STRING) END AS exported,
  CASE l_suppkey % 12 WHEN 0 THEN './f' || CAST(l_orderkey % 30 AS STRING) WHEN 1 THEN '../m' || CAST(l_orderkey % 7 AS STRING) || '/f' || CAST(l_orderkey % 30 AS STRING) || '.js' WHEN 2 THEN '@/m' || CAST(l_orderkey % 7 AS STRING) || '/f' || CAST(l_orderkey % 30 AS STRING)
    WHEN 3 THEN '@org/p' || CAST(l_orderkey % 60 AS STRING) || '/src/m' || CAST(l_orderkey % 7 AS STRING) || '/f' || CAST(l_orderkey % 30 AS STRING) WHEN 4 THEN 'p' || CAST(l_orderkey % 60 AS STRING) WHEN 5 THEN 'p' || CAST(l_orderkey % 60 AS STRING) || '/lib/m' || CAST(l_orderkey % 7 AS STRING) || '/f' || CAST(l_orderkey % 30 AS STRING)
    WHEN 6 THEN CASE l_orderkey % 3 WHEN 0 THEN 'node:fs' WHEN 1 THEN 'fs/promises' ELSE 'path' END WHEN 7 THEN 'lodash/' || CAST(l_orderkey % 9 AS STRING) WHEN 8 THEN '@lib' WHEN 9 THEN '~p' || CAST(l_orderkey % 60 AS STRING) || '/src/m1/f1'
    WHEN 10 THEN 'p' || CAST(l_orderkey % 60 AS STRING) || '/m' || CAST(l_orderkey % 7 AS STRING) || '/f2.js' ELSE '../../../../..' END AS spec
FROM {lineitem} JOIN (SELECT p_partkey, path FROM {part} JOIN (""" + MOD_FILES + """) m ON m.fid = p_partkey) f ON f.p_partkey = l_partkey
"""

TABLES = {
    "mod_files": MOD_FILES, "mod_packages": MOD_PACKAGES, "mod_exports": MOD_EXPORTS, "mod_aliases": MOD_ALIASES, "mod_imports": MOD_IMPORTS,
    "findings": FINDINGS, "findings_b": FINDINGS_B, "scans": SCANS, "scan_findings": SCAN_FINDINGS, "triage": TRIAGE, "rules": RULES, "functions": FUNCTIONS, "call_sites": CALL_SITES,
    "hierarchy": HIERARCHY, "edges": EDGES, "branching": CALLS, "entries": ENTRIES, "surface_edges": SURFACE_EDGES, "lifecycle": LIFECYCLE, "deltas": DELTAS, "auth_routes": AUTH_ROUTES, "auth_ops": AUTH_OPS, "auth_checks": AUTH_CHECKS, "auth_lookups": AUTH_LOOKUPS, "text_lines": LINES,
}
BASE = ("lineitem", "orders", "customer", "supplier", "part", "nation", "events", "documents")


def oracle(sql: str) -> str:
    """sql over hub tables, with the ones it names put before it."""
    import re

    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    ctes = [f"{t} AS ({TABLES[t].format(**{b: b for b in BASE})})" for t in used]
    body = sql.strip()
    if m := re.match(r"WITH (RECURSIVE )?", body):
        return f"WITH {m[1] or ''}" + ",\n".join([*ctes, body[m.end() :]])
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


class Hub:
    """Hub tables of one data folder; each is read when it is first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        text = TABLES[name]
        df = self.spark.sql(text, **{b: self.base(b) for b in BASE if "{" + b + "}" in text})
        setattr(self, name, df)
        return df
