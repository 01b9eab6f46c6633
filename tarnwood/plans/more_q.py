"""Queries of the remaining listings, look-ups, unions and text operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import findings as fn
from ..operators import findings as op
from .findings_q import RULE
from .registry import query


@query("p39_rule_for_caps", "SELECT DISTINCT sink_caps AS bits, CASE WHEN sink_caps = 32 THEN 'taint-path-traversal' WHEN sink_caps = 64 THEN 'taint-format-string' WHEN sink_caps = 128 THEN 'taint-sql-injection' WHEN sink_caps = 256 THEN 'taint-deserialization' WHEN sink_caps = 512 THEN 'taint-ssrf' WHEN sink_caps = 1024 THEN 'taint-code-execution' WHEN sink_caps = 2048 THEN 'taint-crypto-misuse' WHEN sink_caps = 4096 THEN 'rs.auth.missing_ownership_check.taint' WHEN sink_caps = 8192 THEN 'taint-data-exfiltration' WHEN sink_caps = 16384 THEN 'taint-ldap-injection' WHEN sink_caps = 32768 THEN 'taint-xpath-injection' WHEN sink_caps = 65536 THEN 'taint-header-injection' WHEN sink_caps = 131072 THEN 'taint-open-redirect' WHEN sink_caps = 262144 THEN 'taint-template-injection' WHEN sink_caps = 524288 THEN 'taint-xxe' WHEN sink_caps = 1048576 THEN 'taint-prototype-pollution' END AS rule FROM findings")
def _(h):
    out = None
    for name, cap, _, _ in fn.CAPABILITY_RULES:
        hit = F.col("sink_caps").bitwiseAND(fn.BIT[cap]) != 0
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return h.findings.select("sink_caps").distinct().select(F.col("sink_caps").alias("bits"), out.alias("rule"))


@query("p17_namespace", "SELECT DISTINCT path, regexp_replace(path, '^src/?', '') AS rel, 'pkg::' || regexp_replace(path, '^src/?', '') AS qualified FROM findings")
def _(h):
    rel = F.regexp_replace("path", "^src/?", "")
    return h.findings.select("path").distinct().select("path", rel.alias("rel"), F.concat(F.lit("pkg::"), rel).alias("qualified"))


@query("p20_qualified_name", "SELECT fid, CASE WHEN container = '' THEN name ELSE container || '::' || name END AS qualified FROM functions")
def _(h):
    return h.functions.select("fid", F.concat_ws("::", F.nullif("container", F.lit("")), "name").alias("qualified"))


@query("p36_rule_ids", "SELECT DISTINCT lang || '.' || container || '.' || name AS rule FROM functions WHERE container <> '' AND sink_caps <> 0")
def _(h):
    return h.functions.where("container <> '' AND sink_caps <> 0").select(F.concat_ws(".", "lang", "container", "name").alias("rule")).distinct()


@query("f08_rules_list", f"SELECT r.suppress_by, r.match_value, count(f.pos) AS findings FROM rules r LEFT JOIN findings f ON r.suppress_by = 'file' AND f.path = r.match_value OR r.suppress_by = 'rule' AND {RULE.replace('id', 'f.id')} = r.match_value GROUP BY 1, 2, r.rule_no")
def _(h):
    by_file = h.findings.groupBy(F.col("path").alias("match_value")).agg(F.count("*").alias("a"))
    by_rule = h.findings.groupBy(fn.canonical_rule(F.col("id")).alias("match_value")).agg(F.count("*").alias("b"))
    j = h.rules.join(by_file, "match_value", "left").join(by_rule, "match_value", "left")
    n = F.when(F.col("suppress_by") == "file", F.coalesce("a", F.lit(0))).when(F.col("suppress_by") == "rule", F.coalesce("b", F.lit(0))).otherwise(0)
    return j.select("suppress_by", "match_value", n.cast("long").alias("findings"))


@query("f09_rule_matches", "SELECT p AS prefix, count(*) AS n FROM (SELECT unnest(['taint-', 'state-', 'cfg-', 'py.', 'js.']) AS p) JOIN findings f ON starts_with(f.id, p) GROUP BY 1")
def _(h):
    prefixes = ["taint-", "state-", "cfg-", "py.", "js."]
    hit = F.array_compact(F.array(*[F.when(F.col("id").startswith(p), F.lit(p)) for p in prefixes]))
    return h.findings.select(F.explode(hit).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("j25_first_seen_lookup", "SELECT fingerprint, min(scan_id) AS first_seen FROM scan_findings WHERE fingerprint IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0) GROUP BY 1")
def _(h):
    wanted = h.base("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("fingerprint"))
    return h.scan_findings.join(wanted, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("scan_id").alias("first_seen"))


@query("j27_explorer_symbols", "SELECT 'fn_' || (fid % 97) AS symbol, count(DISTINCT fid) AS functions, max(n) AS findings FROM functions LEFT JOIN (SELECT function_name, count(*) AS n FROM findings GROUP BY 1) c ON c.function_name = 'fn_' || (fid % 97) GROUP BY 1")
def _(h):
    n = h.findings.groupBy(F.col("function_name").alias("symbol")).agg(F.count("*").alias("findings"))
    f = h.functions.groupBy(F.concat(F.lit("fn_"), F.col("fid") % 97).alias("symbol")).agg(F.count_distinct("fid").alias("functions"))
    return f.join(n, "symbol", "left").select("symbol", "functions", "findings")


@query("j28_file_findings", "SELECT pos, line, severity FROM findings WHERE path = 'src/1/f1.py' ORDER BY line, col, pos")
def _(h):
    return h.findings.where("path = 'src/1/f1.py'").orderBy("line", "col", "pos").select("pos", "line", "severity")


@query("e01_status_union", "SELECT pos, 'inline' AS by FROM findings WHERE suppressed UNION SELECT pos, 'triage' FROM triage WHERE state IN ('false_positive', 'fixed')")
def _(h):
    a = h.findings.where("suppressed").select("pos", F.lit("inline").alias("by"))
    return a.unionByName(h.triage.where("state IN ('false_positive', 'fixed')").select("pos", F.lit("triage").alias("by"))).distinct()


@query("w10_first_across_scans", "SELECT fingerprint, scan_id FROM (SELECT fingerprint, scan_id, row_number() OVER (PARTITION BY fingerprint ORDER BY scan_id DESC) AS k FROM scan_findings) WHERE k = 1 ORDER BY fingerprint LIMIT 100")
def _(h):
    return h.scan_findings.groupBy("fingerprint").agg(F.max("scan_id").alias("scan_id")).orderBy("fingerprint").limit(100)


@query("t07_paged_audit", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def _(h):
    return op.page(h.base("events"), [F.desc("ts"), "event_id"], 3, 20).select("event_id", "user_id", "event_type")


@query("t09_cfg_scores", "SELECT pos, CASE severity WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 50 ELSE 10 END + 5 * has_source::INT - guards AS score FROM findings WHERE id LIKE 'cfg-%' ORDER BY score DESC, pos LIMIT 50")
def _(h):
    s = fn.one_of(F.col("severity"), {"HIGH": 100, "MEDIUM": 50, "LOW": 10}) + 5 * F.col("has_source").cast("int") - F.col("guards")
    return h.findings.where("id LIKE 'cfg-%'").select("pos", s.alias("score")).orderBy(F.desc("score"), "pos").limit(50)


@query("a26_insights", "SELECT * FROM (SELECT 'many high findings' AS insight, count(*) FILTER (severity = 'HIGH') AS n FROM findings UNION ALL SELECT 'unconfirmed share', count(*) FILTER (verdict IS NULL) FROM findings UNION ALL SELECT 'noise in tests', count(*) FILTER (path LIKE '%/tests/%' AND severity = 'LOW') FROM findings) WHERE n > 10")
def _(h):
    a = h.findings.agg(F.count_if(F.col("severity") == "HIGH").alias("a"), F.count_if(F.col("verdict").isNull()).alias("b"), F.count_if(fn.nonprod(F.col("path")) & (F.col("severity") == "LOW")).alias("c"))
    rows = F.array(*[F.struct(F.lit(t).alias("insight"), F.col(c).alias("n")) for t, c in (("many high findings", "a"), ("unconfirmed share", "b"), ("noise in tests", "c"))])
    return a.select(F.explode(rows).alias("r")).select("r.*").where("n > 10")


@query("a30_backwards_verdict", "SELECT path, CASE WHEN bool_or(symbolic = 'Confirmed') THEN 'Confirmed' WHEN bool_and(symbolic = 'Infeasible') THEN 'Infeasible' WHEN bool_or(n_steps = 3) THEN 'BudgetExhausted' ELSE 'Inconclusive' END AS verdict FROM findings WHERE symbolic IS NOT NULL GROUP BY 1")
def _(h):
    s = F.col("symbolic")
    v = F.when(F.bool_or(s == "Confirmed"), "Confirmed").when(F.bool_and(s == "Infeasible"), "Infeasible").when(F.bool_or(F.col("n_steps") == 3), "BudgetExhausted").otherwise("Inconclusive")
    return h.findings.where(s.isNotNull()).groupBy("path").agg(v.alias("verdict"))


@query("a38_points_to_cap", "SELECT caller, list_slice(list_sort(list(DISTINCT name)), 1, 8) AS edges, count(DISTINCT name) > 8 AS overflow FROM call_sites GROUP BY 1")
def _(h):
    g = h.call_sites.groupBy("caller").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return g.select("caller", F.slice("names", 1, 8).alias("edges"), (F.size("names") > 8).alias("overflow"))


@query("j19_surface_reach", "SELECT e.idx, s.node_kind, count(*) AS n FROM entries e JOIN surface_edges s ON s.entry = e.idx GROUP BY 1, 2")
def _(h):
    return h.entries.select("idx").join(h.surface_edges.select(F.col("entry").alias("idx"), "node_kind"), "idx").groupBy("idx", "node_kind").agg(F.count("*").alias("n"))


@query("j20_router_dependencies", "SELECT DISTINCT e.src AS child, d.dst AS dependency FROM edges e JOIN edges d ON d.src = e.dst WHERE e.src <> d.dst")
def _(h):
    d = h.edges.select(F.col("src").alias("mid"), F.col("dst").alias("dependency"))
    return h.edges.select(F.col("src").alias("child"), F.col("dst").alias("mid")).join(d, "mid").where("child <> dependency").select("child", "dependency").distinct()


@query("j26_deferred_release", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def _(h):
    e = h.base("events")
    return e.where("event_type = 'view'").select("user_id").distinct().join(e.where("event_type = 'error'").select("user_id").distinct(), "user_id", "left_anti")


@query("j23_class_method_lookup", "SELECT s.site, min(f.fid) AS method FROM call_sites s JOIN functions f ON f.container = s.container_hint AND f.name = s.name GROUP BY 1")
def _(h):
    first = h.functions.groupBy(F.col("container").alias("container_hint"), "name").agg(F.min("fid").alias("method"))
    return h.call_sites.join(first, ["container_hint", "name"]).select("site", "method")


@query("j24_sub_types", "SELECT super_type, count(DISTINCT sub_type) AS subs FROM hierarchy GROUP BY 1")
def _(h):
    return h.hierarchy.groupBy("super_type").agg(F.count_distinct("sub_type").alias("subs"))


#: Text patterns of rules that need no syntax tree.
PATTERNS = {"js.xss.script_tag": "<script>", "js.code_exec.track": "track[(]", "html.comment": "<!--"}


@query("d01_pattern_scan", "SELECT page_id, rule, n FROM (SELECT page_id, 'js.xss.script_tag' AS rule, len(regexp_extract_all(html, '<script>')) AS n FROM pages UNION ALL SELECT page_id, 'js.code_exec.track', len(regexp_extract_all(html, 'track[(]')) FROM pages UNION ALL SELECT page_id, 'html.comment', len(regexp_extract_all(html, '<!--')) FROM pages) WHERE n > 0")
def _(h):
    counts = F.array(*[F.struct(F.lit(k).alias("rule"), F.regexp_count("html", F.lit(p)).cast("long").alias("n")) for k, p in PATTERNS.items()])
    return h.base("pages").select("page_id", F.explode(counts).alias("r")).select("page_id", "r.rule", "r.n").where("n > 0")


@query("x35_symbolic_strings", "SELECT c_custkey AS k, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, replace(c_mktsegment, 'U', '_') AS rep, substr(c_mktsegment, 2, 4) AS sub, length(c_mktsegment)::INT AS len FROM customer")
def _(h):
    c = F.col("c_mktsegment")
    return h.base("customer").select(F.col("c_custkey").alias("k"), F.upper(c).alias("up"), F.lower(c).alias("low"), F.replace(c, F.lit("U"), F.lit("_")).alias("rep"), F.substring(c, 2, 4).alias("sub"), F.length(c).alias("len"))


@query("x39_encode_witness", "SELECT c_custkey AS k, base64(c_name::BLOB) AS b64, replace(replace(replace('<' || c_name || '&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html, '''' || replace(c_name, '#', '''''') || '''' AS sql_text FROM customer")
def _(h):
    c = F.col("c_name")
    html = F.replace(F.replace(F.replace(F.concat(F.lit("<"), c, F.lit("&")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return h.base("customer").select(F.col("c_custkey").alias("k"), F.base64(F.encode(c, "UTF-8")).alias("b64"), html.alias("html"), F.concat(F.lit("'"), F.replace(c, F.lit("#"), F.lit("''")), F.lit("'")).alias("sql_text"))


@query("x40_decode", "SELECT c_custkey AS k, c_name AS name FROM customer")
def _(h):
    return h.base("customer").select(F.col("c_custkey").alias("k"), F.decode(F.unbase64(F.base64(F.encode("c_name", "UTF-8"))), "UTF-8").alias("name"))


@query("g34_block_distance", "WITH RECURSIVE r AS (SELECT DISTINCT src AS start, src AS node, 0 AS hops FROM edges UNION SELECT r.start, e.dst, hops + 1 FROM r JOIN edges e ON e.src = r.node WHERE hops < 20) SELECT start, node, min(hops)::INT AS hops FROM r GROUP BY 1, 2")
def _(h):
    from ..operators.graph import reach

    return reach(h.edges, h.edges.select(F.col("src").alias("start")).distinct(), 20).select("start", "node", F.col("depth").alias("hops"))


@query("g17_alias_sets", "WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, min(b) AS label FROM r GROUP BY 1")
def _(h):
    from ..operators.graph import alias_sets

    return alias_sets(h.edges)


@query("r08_job_window", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def _(h):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return h.base("events").withColumn("k", F.row_number().over(w)).where("k <= 3").select("user_id", "event_id")
