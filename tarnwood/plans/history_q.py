"""Queries on triage, suppression and the history of scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import findings as fn
from ..operators import findings as op
from ..operators import history as hi
from .findings_q import RULE
from .registry import query

OVERLAY = f"""(SELECT f.*, coalesce(t.state, r.state, 'open') AS triage_state, CASE WHEN t.state IS NOT NULL THEN 'fingerprint' ELSE r.suppress_by END AS level
FROM (SELECT *, {RULE} AS rule FROM findings) f LEFT JOIN triage t ON t.pos = f.pos
LEFT JOIN LATERAL (SELECT state, suppress_by FROM rules r WHERE (suppress_by = 'rule' AND match_value = f.rule) OR (suppress_by = 'rule_in_file' AND match_value = f.rule || ':' || f.path) OR (suppress_by = 'file' AND match_value = f.path) ORDER BY created_at DESC, rule_no DESC LIMIT 1) r ON true)"""
DONE = "('false_positive', 'accepted_risk', 'suppressed', 'fixed')"


def overlaid(h):
    return hi.overlay(h.findings, h.triage, h.rules)


@query("j05_triage_overlay", f"SELECT pos, triage_state, level FROM {OVERLAY}")
def _(h):
    return overlaid(h).select("pos", "triage_state", "level")


@query("f05_active_for_cli", f"SELECT pos FROM {OVERLAY} WHERE NOT suppressed AND triage_state NOT IN {DONE}")
def _(h):
    return overlaid(h).where(~F.col("suppressed") & ~F.col("triage_state").isin(*hi.TERMINAL)).select("pos")


@query("j08_triage_export", "SELECT f.pos, f.path, t.state, t.note FROM findings f JOIN triage t ON t.pos = f.pos")
def _(h):
    return h.findings.join(h.triage, "pos").select("pos", "path", "state", "note")


@query("a12_suppression_hygiene", f"SELECT level, count(*) AS n, sum((triage_state IN {DONE})::INT)::BIGINT AS closed FROM {OVERLAY} WHERE level IS NOT NULL GROUP BY 1")
def _(h):
    return overlaid(h).where("level IS NOT NULL").groupBy("level").agg(F.count("*").alias("n"), F.count_if(F.col("triage_state").isin(*hi.TERMINAL)).alias("closed"))


@query("a14_noisy_rules", f"SELECT rule, count(*) AS n, sum((triage_state IN {DONE})::INT)::BIGINT AS closed FROM {OVERLAY} GROUP BY 1 HAVING count(*) >= 3 AND sum((triage_state IN {DONE})::INT) >= 0.5 * count(*)")
def _(h):
    g = overlaid(h).groupBy(fn.canonical_rule(F.col("id")).alias("rule")).agg(F.count("*").alias("n"), F.count_if(F.col("triage_state").isin(*hi.TERMINAL)).alias("closed"))
    return g.where("n >= 3 AND closed >= 0.5 * n")


@query("a15_triage_coverage", f"SELECT avg((triage_state <> 'open')::INT::DOUBLE) AS coverage FROM {OVERLAY}")
def _(h):
    return overlaid(h).agg(F.avg((F.col("triage_state") != "open").cast("double")).alias("coverage"))


@query("f10_directive_match", "SELECT f.pos, CASE WHEN d.pos IS NULL THEN false ELSE true END AS hit FROM findings f LEFT JOIN (SELECT DISTINCT path, line, 'taint-unsanitised-flow' AS matcher, min(pos) OVER (PARTITION BY path, line) AS pos FROM findings WHERE pos % 97 = 0) d ON d.path = f.path AND d.line = f.line AND (trim(split_part(f.id, ' (', 1)) = d.matcher OR f.id LIKE d.matcher || '.%')")
def _(h):
    d = h.findings.where("pos % 97 = 0").select("path", "line").distinct().withColumn("matcher", F.lit("taint-unsanitised-flow"))
    hit = F.coalesce((fn.canonical_rule(F.col("id")) == F.col("matcher")) | F.col("id").startswith(F.concat("matcher", F.lit("."))), F.lit(False))
    return h.findings.join(d, ["path", "line"], "left").select("pos", hit.alias("hit"))


@query("w08_previous_state", "SELECT user_id AS subject, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, event_type AS state FROM events")
def _(h):
    e = h.base("events")
    return e.select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("previous"), F.col("event_type").alias("state"))


DIFF = """(SELECT coalesce(a.pos, b.pos) AS pos, a.verdict AS base_verdict, b.verdict AS now_verdict, CASE WHEN a.pos IS NULL THEN 'New' WHEN b.pos IS NULL THEN 'Resolved' WHEN a.verdict IS NOT DISTINCT FROM b.verdict THEN 'Unchanged'
 WHEN b.verdict = 'Confirmed' AND a.verdict = 'NotConfirmed' THEN 'Regressed' WHEN b.verdict = 'Confirmed' THEN 'FlippedConfirmed' WHEN a.verdict = 'Confirmed' THEN 'FlippedNotConfirmed' ELSE 'Unchanged' END AS transition
 FROM (SELECT pos, verdict FROM findings WHERE pos % 13 <> 0) a FULL JOIN findings_b b ON a.pos = b.pos)"""


def diff(h):
    return hi.verdict_diff(h.findings.where("pos % 13 <> 0"), h.findings_b, "pos")


@query("j09_baseline_diff", f"SELECT * FROM {DIFF}")
def _(h):
    return diff(h)


@query("t04_diff_order", f"SELECT pos, transition FROM {DIFF} ORDER BY CASE transition WHEN 'Regressed' THEN 0 WHEN 'FlippedConfirmed' THEN 1 WHEN 'New' THEN 2 WHEN 'FlippedNotConfirmed' THEN 3 WHEN 'Resolved' THEN 4 ELSE 5 END, pos LIMIT 200")
def _(h):
    order = fn.one_of(F.col("transition"), {"Regressed": 0, "FlippedConfirmed": 1, "New": 2, "FlippedNotConfirmed": 3, "Resolved": 4, "Unchanged": 5})
    return diff(h).orderBy(order, "pos").limit(200).select("pos", "transition")


@query("x60_transitions", f"SELECT transition, count(*) AS n FROM {DIFF} GROUP BY 1")
def _(h):
    return diff(h).groupBy("transition").agg(F.count("*").alias("n"))


@query("x61_ci_gate", f"SELECT NOT bool_or(transition = 'FlippedConfirmed' OR (transition = 'New' AND now_verdict = 'Confirmed')) AS no_new_confirmed, NOT bool_or(transition = 'Regressed') AS no_regression FROM (SELECT transition, coalesce(now_verdict, '') AS now_verdict FROM {DIFF})")
def _(h):
    new = (F.col("transition") == "FlippedConfirmed") | ((F.col("transition") == "New") & F.coalesce(F.col("now_verdict") == "Confirmed", F.lit(False)))
    return diff(h).agg((~F.bool_or(new)).alias("no_new_confirmed"), (~F.bool_or(F.col("transition") == "Regressed")).alias("no_regression"))


COMPARE = """(SELECT coalesce(l.path, r.path) AS path, coalesce(l.id, r.id) AS id, coalesce(l.function_name, r.function_name) AS function_name, coalesce(l.n, r.n)::INT AS n,
  CASE WHEN l.n IS NULL THEN 'new' WHEN r.n IS NULL THEN 'fixed' WHEN l.line IS DISTINCT FROM r.line OR l.severity IS DISTINCT FROM r.severity OR l.confidence IS DISTINCT FROM r.confidence THEN 'changed' ELSE 'unchanged' END AS status,
  l.line AS l_line, r.line AS r_line, l.severity AS l_severity, r.severity AS r_severity, l.confidence AS l_confidence, r.confidence AS r_confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY path, id, function_name ORDER BY pos) AS n FROM findings) l FULL JOIN (SELECT *, row_number() OVER (PARTITION BY path, id, function_name ORDER BY pos) AS n FROM findings_b) r
  ON l.path = r.path AND l.id = r.id AND l.function_name = r.function_name AND l.n = r.n)"""


def compared(h):
    return hi.compare(h.findings, h.findings_b, ["path", "id", "function_name"], ["pos"], ["line", "severity", "confidence"])


@query("j10_scan_compare", f"SELECT path, id, function_name, n, status FROM {COMPARE}")
def _(h):
    return compared(h).select("path", "id", "function_name", "n", "status")


@query("j11_field_changes", f"""SELECT path, id, function_name, n, 'line' AS field, l_line::VARCHAR AS old, r_line::VARCHAR AS new FROM {COMPARE} WHERE status = 'changed' AND l_line IS DISTINCT FROM r_line
UNION ALL SELECT path, id, function_name, n, 'severity', l_severity, r_severity FROM {COMPARE} WHERE status = 'changed' AND l_severity IS DISTINCT FROM r_severity UNION ALL SELECT path, id, function_name, n, 'confidence', l_confidence, r_confidence FROM {COMPARE} WHERE status = 'changed' AND l_confidence IS DISTINCT FROM r_confidence""")
def _(h):
    one = lambda x: F.struct(F.lit(x).alias("field"), F.col(f"l.{x}").cast("string").alias("old"), F.col(f"r.{x}").cast("string").alias("new"))
    c = compared(h).where("status = 'changed'").select("path", "id", "function_name", "n", F.explode(F.array(one("line"), one("severity"), one("confidence"))).alias("c"))
    return c.where(~F.col("c.old").eqNullSafe(F.col("c.new"))).select("path", "id", "function_name", "n", "c.field", "c.old", "c.new")


KEYS = "SELECT path, id, function_name FROM {}"


@query("e02_new_findings", f"{KEYS.format('findings_b')} EXCEPT {KEYS.format('findings')}")
def _(h):
    k = ["path", "id", "function_name"]
    return h.findings_b.select(k).subtract(h.findings.select(k))


@query("e03_fixed_findings", f"{KEYS.format('findings')} EXCEPT {KEYS.format('findings_b')}")
def _(h):
    k = ["path", "id", "function_name"]
    return h.findings.select(k).subtract(h.findings_b.select(k))


@query("e05_multiset_fixed", f"{KEYS.format('findings')} EXCEPT ALL {KEYS.format('findings_b')}")
def _(h):
    k = ["path", "id", "function_name"]
    return h.findings.select(k).exceptAll(h.findings_b.select(k))


@query("a16_severity_delta", "SELECT severity, sum(d)::BIGINT AS delta FROM (SELECT severity, 1 AS d FROM findings_b UNION ALL SELECT severity, -1 FROM findings) GROUP BY 1")
def _(h):
    a = h.findings.groupBy("severity").agg((-F.count("*")).alias("d")).unionByName(h.findings_b.groupBy("severity").agg(F.count("*").alias("d")))
    return a.groupBy("severity").agg(F.sum("d").alias("delta"))


@query("a17_trend_points", """WITH recent AS (SELECT * FROM (SELECT * FROM scans ORDER BY started_at DESC, scan_id DESC LIMIT 20) WHERE status = 'completed' ORDER BY started_at DESC LIMIT 10)
SELECT r.scan_id, count(f.fingerprint) AS total, count(*) FILTER (f.severity = 'HIGH') AS high, count(*) FILTER (f.severity = 'MEDIUM') AS medium, count(*) FILTER (f.severity = 'LOW') AS low FROM recent r LEFT JOIN scan_findings f ON f.scan_id = r.scan_id GROUP BY 1""")
def trend(h):
    recent = h.scans.orderBy(F.desc("started_at"), F.desc("scan_id")).limit(20).where("status = 'completed'").orderBy(F.desc("started_at")).limit(10)
    s = F.col("severity")
    return recent.select("scan_id").join(h.scan_findings, "scan_id", "left").groupBy("scan_id").agg(F.count("fingerprint").alias("total"), F.count_if(s == "HIGH").alias("high"), F.count_if(s == "MEDIUM").alias("medium"), F.count_if(s == "LOW").alias("low"))


@query("a18_trend_slope", """WITH recent AS (SELECT * FROM (SELECT * FROM scans ORDER BY started_at DESC, scan_id DESC LIMIT 20) WHERE status = 'completed' ORDER BY started_at DESC LIMIT 5), p AS (SELECT scan_id, (SELECT count(*) FROM scan_findings f WHERE f.scan_id = r.scan_id) AS total FROM recent r)
SELECT CASE WHEN count(*) >= 3 THEN (min_by(total, scan_id) - max_by(total, scan_id))::DOUBLE / greatest(max(total), 1) END AS slope, count(*) AS k FROM p""")
def _(h):
    return hi.trend_slope(trend(h), "scan_id", "total")


@query("a19_new_fixed_reintroduced", """WITH s AS (SELECT DISTINCT scan_id FROM scan_findings), last AS (SELECT max(scan_id) AS now, (SELECT max(scan_id) FROM s WHERE scan_id < (SELECT max(scan_id) FROM s)) AS before FROM s)
SELECT (SELECT count(*) FROM (SELECT fingerprint FROM scan_findings, last WHERE scan_id = now EXCEPT SELECT fingerprint FROM scan_findings, last WHERE scan_id = before)) AS fresh,
 (SELECT count(*) FROM (SELECT fingerprint FROM scan_findings, last WHERE scan_id = before EXCEPT SELECT fingerprint FROM scan_findings, last WHERE scan_id = now)) AS fixed,
 (SELECT count(*) FROM ((SELECT fingerprint FROM scan_findings, last WHERE scan_id = now EXCEPT SELECT fingerprint FROM scan_findings, last WHERE scan_id = before) INTERSECT SELECT fingerprint FROM scan_findings, last WHERE scan_id < before)) AS again""")
def _(h):
    f = h.scan_findings
    now, before = (r[0] for r in f.select("scan_id").distinct().orderBy(F.desc("scan_id")).limit(2).collect())
    # one pass: where each fingerprint was seen
    seen = f.groupBy("fingerprint").agg(F.bool_or(F.col("scan_id") == now).alias("now"), F.bool_or(F.col("scan_id") == before).alias("before"), F.bool_or(F.col("scan_id") < before).alias("earlier"))
    return seen.agg(F.count_if(F.col("now") & ~F.col("before")).alias("fresh"), F.count_if(F.col("before") & ~F.col("now")).alias("fixed"), F.count_if(F.col("now") & ~F.col("before") & F.col("earlier")).alias("again"))


@query("e04_reintroduced", """WITH s AS (SELECT scan_id, fingerprint, lag(scan_id) OVER (PARTITION BY fingerprint ORDER BY scan_id) AS previous FROM scan_findings), p AS (SELECT scan_id, lag(scan_id) OVER (ORDER BY scan_id) AS before FROM (SELECT DISTINCT scan_id FROM scan_findings))
SELECT s.scan_id, count(*) AS again FROM s JOIN p ON p.scan_id = s.scan_id WHERE previous IS NOT NULL AND previous < before GROUP BY 1""")
def _(h):
    hist = hi.fingerprint_history(h.scan_findings)
    scans = h.scan_findings.select("scan_id").distinct()  # a row for each scan
    before = scans.withColumn("before", F.lag("scan_id").over(Window.orderBy("scan_id")))
    return hist.join(F.broadcast(before), "scan_id").where("previous < before").groupBy("scan_id").agg(F.count("*").alias("again"))


@query("w07_first_seen", "SELECT fingerprint, min(scan_id) AS first_seen, max(scan_id) AS last_seen, count(*) AS scans FROM scan_findings GROUP BY 1")
def _(h):
    return h.scan_findings.groupBy("fingerprint").agg(F.min("scan_id").alias("first_seen"), F.max("scan_id").alias("last_seen"), F.count("*").alias("scans"))


@query("w06_latest_scan", "SELECT scan_id, status, finding_count FROM scans WHERE status = 'completed' ORDER BY started_at DESC LIMIT 1")
def _(h):
    return h.scans.where("status = 'completed'").agg(F.max_by(F.struct("scan_id", "status", "finding_count"), "started_at").alias("s")).select("s.*")


@query("t05_list_scans", "SELECT scan_id, status FROM scans ORDER BY started_at DESC, scan_id LIMIT 12")
def _(h):
    return h.scans.orderBy(F.desc("started_at"), "scan_id").limit(12).select("scan_id", "status")


@query("t06_paged_triage", "SELECT pos, state, note FROM triage ORDER BY pos LIMIT 25 OFFSET 25")
def _(h):
    return op.page(h.triage, ["pos"], 2, 25).select("pos", "state", "note")


@query("a13_backlog_age", """WITH a AS (SELECT fingerprint, (SELECT max(scan_id) FROM scan_findings) - min(scan_id) AS age FROM scan_findings GROUP BY 1)
SELECT max(age) AS oldest, (SELECT age FROM (SELECT age, row_number() OVER (ORDER BY age) AS k FROM a) WHERE k = (SELECT count(*) // 2 + 1 FROM a)) AS median, count(*) FILTER (age > 30) AS stale FROM a""")
def _(h):
    last = h.scan_findings.agg(F.max("scan_id")).first()[0]
    a = h.scan_findings.groupBy("fingerprint").agg((F.lit(last) - F.min("scan_id")).alias("age"))
    # the upper median, from a histogram of ages: its size is that of the ages, not of the findings
    hist = a.groupBy("age").agg(F.count("*").alias("c"))
    run = hist.withColumn("upto", F.sum("c").over(Window.orderBy("age"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    return run.agg(F.max("age").alias("oldest"), F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, F.col("age"))).alias("median"), F.sum(F.when(F.col("age") > 30, F.col("c")).otherwise(0)).alias("stale"))


@query("a25_posture", "SELECT CASE WHEN n < 2 THEN 'unknown' WHEN again > 0 THEN 'regressing' WHEN fixed > fresh THEN 'improving' WHEN fixed < fresh THEN 'worsening' ELSE 'stable' END AS posture, k FROM (SELECT k, 3 AS n, k % 2 AS again, k % 3 AS fixed, k % 5 AS fresh FROM (SELECT DISTINCT o_custkey % 30 AS k FROM orders))")
def _(h):
    k = h.base("orders").select((F.col("o_custkey") % 30).alias("k")).distinct()
    again, fixed, fresh = F.col("k") % 2, F.col("k") % 3, F.col("k") % 5
    return k.select(F.when(again > 0, "regressing").when(fixed > fresh, "improving").when(fixed < fresh, "worsening").otherwise("stable").alias("posture"), "k")


@query("r08_retention", "SELECT scan_id FROM (SELECT scan_id, row_number() OVER (PARTITION BY status ORDER BY started_at DESC, scan_id DESC) AS k FROM scans) WHERE k <= 5")
def _(h):
    w = Window.partitionBy("status").orderBy(F.desc("started_at"), F.desc("scan_id"))
    return h.scans.withColumn("k", F.row_number().over(w)).where("k <= 5").select("scan_id")


@query("s16_changed_files", "SELECT DISTINCT b.path FROM findings_b b WHERE NOT EXISTS (SELECT 1 FROM findings a WHERE a.path = b.path AND a.line = b.line AND a.severity = b.severity)")
def _(h):
    from ..sources import changed

    k = ["path", "line", "severity"]
    return changed(h.findings_b.select(*k).distinct(), h.findings.select(*k).distinct(), k).select("path").distinct()


@query("k01_upsert", "SELECT pos, severity FROM (SELECT pos, severity, row_number() OVER (PARTITION BY pos ORDER BY v DESC) AS k FROM (SELECT pos, severity, 1 AS v FROM findings UNION ALL SELECT pos, severity, 2 FROM findings_b)) WHERE k = 1")
def _(h):
    from ..sinks import upsert

    return upsert(h.findings.select("pos", "severity", F.lit(1).alias("v")), h.findings_b.select("pos", "severity", F.lit(2).alias("v")), ["pos"], "v").select("pos", "severity")


@query("k02_replace_issues", "SELECT pos, path FROM findings WHERE path NOT IN (SELECT path FROM findings_b WHERE pos % 50 = 0) UNION ALL SELECT pos, path FROM findings_b WHERE pos % 50 = 0")
def _(h):
    from ..sinks import replace_of_files

    return replace_of_files(h.findings.select("pos", "path"), h.findings_b.where("pos % 50 = 0").select("pos", "path"), ["path"])


@query("k09_remove_files", "SELECT pos FROM findings WHERE path NOT IN (SELECT DISTINCT match_value FROM rules)")
def _(h):
    from ..sinks import remove_files

    return remove_files(h.findings.select("pos", "path"), h.rules.select(F.col("match_value").alias("path")).distinct(), ["path"]).select("pos")


@query("d26_verdict_cache", "SELECT a.pos, b.verdict FROM findings a JOIN (SELECT path, id, line, col, sink_caps, function_name, min(verdict) AS verdict FROM findings_b GROUP BY ALL) b ON a.path = b.path AND a.id = b.id AND a.line = b.line AND a.col = b.col AND a.sink_caps = b.sink_caps AND a.function_name = b.function_name")
def _(h):
    k = ["path", "id", "line", "col", "sink_caps", "function_name"]
    return h.findings.select("pos", *k).join(h.findings_b.groupBy(*k).agg(F.min("verdict").alias("verdict")), k).select("pos", "verdict")

