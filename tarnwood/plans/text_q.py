"""Queries on text: redaction, conditions, sources, labels, directives, patterns, life cycles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import conditions as co
from ..functions import findings as fn
from ..functions import text as tx
from ..operators import state as st
from .registry import query

REDACT = "text"
for _p in tx.SECRETS:
    REDACT = f"regexp_replace({REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '{tx.MARK}', 'g')"


@query("p26_redact", f"SELECT doc_id, {REDACT.replace('text', 'snippet')} AS clean FROM text_lines")
def _(h):
    return h.text_lines.select("doc_id", tx.redact(F.col("snippet")).alias("clean"))


@query("p26_redact_documents", f"SELECT doc_id, sha256({REDACT}) AS clean_sha256 FROM documents")
def _(h):
    return h.base("documents").select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("clean_sha256"))


@query("p27_contains_secret", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for p in tx.SECRETS) + " AS secret FROM documents")
def _(h):
    return h.base("documents").select("doc_id", tx.contains_secret(F.col("text")).alias("secret"))


#: Conditions on a name, with what each tests.
_CONDITIONS = [
    ("", "Unknown"), ("{}", "Unknown"), ("err != nil", "ErrorCheck"), ("if error == nil {{", "ErrorCheck"), ("{}.is_err()", "ErrorCheck"), ("if {} is None:", "NullCheck"), ("{} === null", "NullCheck"), ("{} != nil", "NullCheck"), ("{}.is_some()", "NullCheck"),
    ("{}.is_empty()", "EmptyCheck"), ("{}.len() == 0", "EmptyCheck"), ("if ({}.length === 0)", "EmptyCheck"), ("{} == ''", "EmptyCheck"), ('{}.contains(";")', "ShellMetaValidated"), ("if '|' in {}:", "ShellMetaValidated"), ("{}[0] == '-'", "ShellMetaValidated"),
    ("{}.startswith('/')", "RelativeUrlValidated"), ('{}.starts_with("/")', "RelativeUrlValidated"), ("new URL({}).host === ALLOWED", "HostAllowlistValidated"), ("urlparse({}).netloc == ALLOWED", "HostAllowlistValidated"), ('{}.includes("..")', "Unknown"), ("ALLOWED.indexOf({}) === -1", "Unknown"), ("ALLOWED.indexOf({}) < 0", "Unknown"),
    ("ALLOWED.indexOf({}) !== -1", "AllowlistCheck"), ("ALLOWED.includes({})", "AllowlistCheck"), ("if {} in ALLOWED:", "AllowlistCheck"), ("in_array($x, {})", "AllowlistCheck"), ("allowed.has({})", "AllowlistCheck"), ("isinstance({}, int)", "TypeCheck"), ("typeof {} === 'string'", "TypeCheck"), ("{} instanceof Date", "TypeCheck"),
    ("is_numeric({})", "TypeCheck"), ("if validate_name({})", "ValidationCall"), ("isValidId({})", "ValidationCall"), ("!checkToken({})", "ValidationCall"), ("isSafePath({})", "ValidationCall"), ("ID_REGEX.test({})", "ValidationCall"), ("sanitize({})", "SanitizerCall"), ("escapeHtml({})", "SanitizerCall"), ("{} == 3", "Comparison"), ("{} >= limit", "Comparison"), ("load({})", "Unknown"),
]

@query("f21_condition_kind", "SELECT doc_id, CASE doc_id % " + str(len(_CONDITIONS)) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_CONDITIONS)) + " END AS kind FROM documents")
def _(h):
    v = h.spark.createDataFrame([(i, *t.replace("{{", "{").split("{}")) if "{}" in t else (i, t.replace("{{", "{"), None) for i, (t, _) in enumerate(_CONDITIONS)], "k long, before string, after string")
    name = F.concat(F.lit("arg"), "doc_id")
    c = h.base("documents").select("doc_id", (F.col("doc_id") % len(_CONDITIONS)).alias("k")).join(F.broadcast(v), "k").select("doc_id", F.when(F.col("after").isNull(), F.col("before")).otherwise(F.concat("before", name, "after")).alias("condition"))
    return c.select("doc_id", co.condition_kind(F.col("condition")).alias("kind"))


@query("f22_condition_target", "SELECT doc_id, nullif(regexp_extract(condition, 'validate_[a-z]+[(]([a-z_]+)[)]', 1), '') AS target FROM text_lines")
def _(h):
    return h.text_lines.select("doc_id", F.nullif(F.regexp_extract("condition", "validate_[a-z]+[(]([a-z_]+)[)]", 1), F.lit("")).alias("target"))


#: What reads from outside, by framework, with the kind of what it reads.
_CALLEES = [
    ("req.cookies.get", "Cookie"), ("session['user']", "Cookie"), ("r.Header.Get", "Header"), ("request.getHeader", "Header"), ("req.headers", "Header"), ("sys.argv", "UserInput"), ("sys.stdin.readline", "UserInput"), ("request.args.get", "UserInput"), ("req.query.id", "UserInput"), ("req.params.id", "UserInput"),
    ("r.FormValue", "UserInput"), ("request.getParameter", "UserInput"), ("ctx.body", "UserInput"), ("window.location.href", "UserInput"), ("document.referrer", "UserInput"), ("$_GET", "UserInput"), ("socket.recv", "UserInput"), ("os.getenv", "EnvironmentConfig"), ("process.env.HOME", "EnvironmentConfig"), ("os.environ", "EnvironmentConfig"),
    ("config.get", "EnvironmentConfig"), ("fs.readFile", "FileSystem"), ("open", "FileSystem"), ("fopen", "FileSystem"), ("cursor.fetchone", "Database"), ("stmt.execute", "Database"), ("compute", "Unknown"), ("math.floor", "Unknown"),
]


@query("x45_source_kind", "SELECT doc_id, CASE doc_id % " + str(len(_CALLEES)) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_CALLEES)) + " END AS kind FROM documents")
def _(h):
    v = h.spark.createDataFrame([(i, c) for i, (c, _) in enumerate(_CALLEES)], "k long, callee string")
    return h.base("documents").select("doc_id", (F.col("doc_id") % len(_CALLEES)).alias("k")).join(F.broadcast(v), "k").select("doc_id", co.source_kind(F.col("callee"), F.lit(True)).alias("kind"))


RULES = [("=open", "source"), ("cookies.get", "source"), ("req.headers", "source"), ("getenv", "source"), ("fetchone", "source"), ("arg_", "other"), ("args", "source")]


@query("x48_label_classify", "SELECT callee, CASE WHEN callee = 'open' THEN 'source' WHEN callee = 'cookies.get' OR callee LIKE '%.cookies.get' OR callee = 'req.headers' OR callee LIKE '%.getenv' OR callee LIKE '%.fetchone' OR callee LIKE '%.args' THEN 'source' END AS label, count(*) AS n FROM text_lines GROUP BY 1, 2")
def _(h):
    return h.text_lines.groupBy("callee", tx.label(F.col("callee"), RULES).alias("label")).agg(F.count("*").alias("n"))


@query("p22_callee_parts", "SELECT DISTINCT callee, split_part(callee, '.', -1) AS leaf, CASE WHEN callee LIKE '%.%.%' THEN split_part(callee, '.', -2) || '.' || split_part(callee, '.', -1) ELSE callee END AS last_two FROM text_lines")
def _(h):
    return h.text_lines.select("callee").distinct().select("callee", tx.leaf(F.col("callee")).alias("leaf"), tx.last_two(F.col("callee")).alias("last_two"))


@query("f26_shell_safe", "SELECT doc_id, NOT regexp_matches(callee, '[;|&`$><() ]') AND callee NOT LIKE '% %' AS callee_safe, NOT regexp_matches(snippet, '[;|&`$><()\"'' ]') AS snippet_safe FROM text_lines")
def _(h):
    return h.text_lines.select("doc_id", tx.shell_safe(F.col("callee")).alias("callee_safe"), tx.shell_safe(F.col("snippet")).alias("snippet_safe"))


@query("x53_snake_case", "SELECT DISTINCT lower(regexp_replace('getUser' || c_mktsegment || 'ById', '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM customer")
def _(h):
    return h.base("customer").select(tx.snake(F.concat(F.lit("getUser"), "c_mktsegment", F.lit("ById"))).alias("name")).distinct()


@query("f20_sql_auth", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'UserBound' WHEN 1 THEN 'AclJoin' ELSE 'None' END AS auth FROM orders")
def _(h):
    sql = F.when(F.col("o_orderkey") % 4 == 0, "SELECT *  FROM notes WHERE user_id = ?").when(F.col("o_orderkey") % 4 == 1, "select n.* from notes n\nJOIN acl a ON a.note = n.id").when(F.col("o_orderkey") % 4 == 2, "SELECT * FROM notes WHERE id = ?").otherwise("DELETE FROM notes WHERE user_id = ?")
    return h.base("orders").select(F.col("o_orderkey").alias("k"), tx.sql_auth(sql).alias("auth"))


@query("f34_sampling", "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 5))::BIGINT % 1000 < 250 OR doc_id % 10 = 0")
def _(h):
    return h.base("documents").where((F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 5), 16, 10).cast("long") % 1000 < 250) | (F.col("doc_id") % 10 == 0)).select("doc_id")


@query("f36_trusted_destinations", "SELECT page_id, url LIKE 'https://blog.%' OR url LIKE 'https://www.%' AS trusted FROM pages")
def _(h):
    prefixes = F.array(F.lit("https://blog."), F.lit("https://www."))
    return h.base("pages").select("page_id", F.exists(prefixes, lambda p: F.startswith(F.col("url"), p)).alias("trusted"))


@query("s30_template_scan", "SELECT page_id, count(*) AS scripts FROM (SELECT page_id, unnest(string_split(html, '<')) AS tag FROM pages) WHERE tag LIKE 'script>%' GROUP BY 1")
def _(h):
    return h.base("pages").select("page_id", F.explode(F.split("html", "<")).alias("tag")).where(F.col("tag").startswith("script>")).groupBy("page_id").agg(F.count("*").alias("scripts"))


#: Files by the way they are known: by extension whatever the head says, by interpreter, by content, not at all.
_HEADS = [
    (".py", "", "python"), (".rs", "#!/usr/bin/env python", "rust"), (".TS", "package main", "typescript"), (".cpp", "", "cpp"), (".md", "#!/bin/sh", None), ("", "#!/usr/bin/env python3", "python"), ("", "#!/usr/bin/env -S node", "javascript"),
    ("", "#!/usr/local/bin/ruby -w", "ruby"), ("", "#! /usr/bin/php8", "php"), ("", "#!/opt/deno", "javascript"), ("", "#!/bin/bash\ndef f(x):", "python"), ("", "\n  <?php echo 1", "php"), ("", "package main\nfunc main() {", "go"),
    ("", "package a.b;\n", "java"), ("", "// x\nimport java.util.List;", "java"), ("", "use std::io;", "rust"), ("", "func run(a int) {", "go"), ("", "require_relative 'x'", "ruby"), ("", "export default 1", "javascript"), ("", "const a = 1", "javascript"), ("", "plain words", None), ("", "", None),
]
_HEAD_ROWS = ", ".join("({}, '{}', '{}', {})".format(i, e, t.replace("'", "''"), f"'{x}'" if x else "NULL") for i, (e, t, x) in enumerate(_HEADS))


@query("s05_language_detection", f"SELECT d.doc_id, v.lang FROM documents d JOIN (VALUES {_HEAD_ROWS}) v(k, ext, head, lang) ON v.k = d.doc_id % {len(_HEADS)}")
def _(h):
    v = h.spark.createDataFrame([(i, e, t) for i, (e, t, _) in enumerate(_HEADS)], "k long, ext string, head string")
    files = h.base("documents").select("doc_id", (F.col("doc_id") % len(_HEADS)).alias("k")).join(F.broadcast(v), "k").select("doc_id", F.concat(F.lit("bin/tool"), "doc_id", "ext").alias("path"), "head")
    return files.select("doc_id", fn.language_of(F.col("path"), F.col("head")).alias("lang"))


@query("r03_lifecycle", """SELECT subject, seq, CASE WHEN op = 'use' AND before = 'close' THEN 'use-after-close' WHEN op = 'close' AND before = 'close' THEN 'double-close' WHEN op = 'open' AND before = 'open' THEN 'reopened' END AS issue
FROM (SELECT subject, seq, op, last_value(CASE WHEN op IN ('open', 'close') THEN op END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lifecycle)
WHERE (op = 'use' AND before = 'close') OR (op = 'close' AND before = 'close') OR (op = 'open' AND before = 'open')""")
def _(h):
    return st.lifecycle_issues(h.lifecycle)


@query("d05_resource_leaks", "SELECT subject, max(seq) FILTER (op = 'open') AS opened FROM lifecycle GROUP BY 1 HAVING max(seq) FILTER (op = 'open') > coalesce(max(seq) FILTER (op = 'close'), -1)")
def _(h):
    return st.leaks(h.lifecycle)


@query("r04_auth_level", "SELECT subject, min(CASE op WHEN 'open' THEN 0 WHEN 'use' THEN 1 ELSE 2 END) AS level FROM lifecycle GROUP BY 1")
def _(h):
    return h.lifecycle.groupBy("subject").agg(F.min(F.when(F.col("op") == "open", 0).when(F.col("op") == "use", 1).otherwise(2)).alias("level"))


@query("r09_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(h):
    g = h.base("events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g


@query("r09_session_windows", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def _(h):
    return h.base("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n")).select("user_id", "start", "n")


@query("j32_range_containment", "SELECT e.event_id, c.c_custkey FROM events e JOIN customer c ON e.event_id >= c.c_custkey * 7 AND e.event_id < c.c_custkey * 7 + 3 WHERE e.event_type = 'error'")
def _(h):
    # spans [7k, 7k + 3) meet points in buckets of 7: an equi-join with a residual, no pairwise comparison
    spans = h.base("customer").select("c_custkey", (F.col("c_custkey") * 7).alias("a"), (F.col("c_custkey") * 7 + 3).alias("b"))
    bucket = spans.select("*", F.explode(F.sequence(F.floor(F.col("a") / 7), F.floor((F.col("b") - 1) / 7))).alias("k"))
    points = h.base("events").where("event_type = 'error'").select("event_id", F.floor(F.col("event_id") / 7).alias("k"))
    return points.join(bucket, "k").where("event_id >= a AND event_id < b").select("event_id", "c_custkey")


@query("w11_state_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(h):
    return h.base("events").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@query("a40_convergence_class", """SELECT subject, CASE WHEN len(d) < 2 THEN 'unknown' WHEN len(d) >= 4 AND d[-4] = d[-2] AND d[-3] = d[-1] AND d[-4] <> d[-3] THEN 'oscillation' WHEN d[-1] = d[-2] AND d[-1] > 0 THEN 'plateau'
 WHEN len(list_filter(range(1, len(d)), lambda i: d[i + 1] > d[i])) = 0 THEN 'shrinking' ELSE 'unknown' END AS class FROM (SELECT subject, list(delta ORDER BY seq) AS d FROM deltas GROUP BY 1)""")
def _(h):
    return st.convergence_class(h.deltas)
