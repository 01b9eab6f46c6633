"""Queries on authorization models and on triage files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import auth
from ..operators import history as hi
from .findings_q import RULE
from .registry import query

ROUTES = "SELECT unit, path FROM auth_routes WHERE regexp_matches(path, '(^|/)admin(/|$)') AND NOT regexp_matches(guards, 'require_admin|admin_required|is_admin') AND regexp_matches(guards, 'require_login|login_required|authenticate')"
_NONE = "NOT EXISTS (SELECT 1 FROM auth_checks c WHERE c.unit = o.unit AND c.subject = o.subject AND c.kind IN ('ownership', 'membership', 'admin') AND c.line <= o.line"
GAPS = f"SELECT o.unit, o.line, o.op FROM auth_ops o WHERE NOT o.session_held AND {_NONE})"
STALE = f"SELECT o.unit, o.line, o.op FROM auth_ops o WHERE o.session_held AND o.kind = 'mutation' AND {_NONE})"
PARTIAL = f"SELECT o.unit, o.line, o.op FROM auth_ops o WHERE o.batch AND {_NONE} AND NOT c.element) AND {_NONE.replace('NOT EXISTS', 'EXISTS')} AND c.element)"
TOKEN = """SELECT unit, line, CASE WHEN override THEN 'override' WHEN NOT expiry_checked THEN 'expiry' ELSE 'recipient' END AS reason FROM (SELECT o.unit, o.line, o.override, t.expiry_checked, t.recipient_checked, row_number() OVER (PARTITION BY o.unit ORDER BY o.line DESC, o.op DESC) AS r
 FROM auth_ops o JOIN auth_lookups t ON t.unit = o.unit WHERE o.kind = 'mutation' AND o.line >= t.line) WHERE r = 1 AND (override OR NOT expiry_checked OR NOT recipient_checked)"""


def routes(h):
    return h.auth_routes.withColumn("guards", F.split("guards", ","))


@query("d07_admin_routes", ROUTES)
def _(h):
    return auth.admin_routes(routes(h))


@query("d08_ownership_gaps", GAPS)
def _(h):
    return auth.ownership_gaps(h.auth_ops, h.auth_checks).select("unit", "line", "op")


@query("d09_partial_batches", PARTIAL)
def _(h):
    return auth.partial_batches(h.auth_ops, h.auth_checks).select("unit", "line", "op")


@query("d10_stale_authorization", STALE)
def _(h):
    return auth.stale_authorization(h.auth_ops, h.auth_checks).select("unit", "line", "op")


@query("d11_token_override", TOKEN)
def _(h):
    return auth.token_override(h.auth_ops, h.auth_lookups)


@query("d06_auth_analysis", f"""SELECT rule, count(*) AS n, sum(line)::BIGINT AS lines FROM (SELECT 'admin_route_missing_admin_check' AS rule, 0 AS line FROM ({ROUTES}) UNION ALL SELECT 'missing_ownership_check', line FROM ({GAPS}) UNION ALL SELECT 'partial_batch_authorization', line FROM ({PARTIAL})
 UNION ALL SELECT 'stale_authorization', line FROM ({STALE}) UNION ALL SELECT 'token_override_without_validation', line FROM ({TOKEN})) GROUP BY 1""")
def _(h):
    return auth.findings(routes(h), h.auth_ops, h.auth_checks, h.auth_lookups).groupBy("rule").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def portable(h):
    return h.findings.withColumn("portable", F.concat(F.lit("fp"), F.col("pos")))


_DECISIONS = "(SELECT 'fp' || pos AS portable, state, note FROM triage)"
_APPLIED = f"""(SELECT f.pos, coalesce(t.state, r.state, 'open') AS triage_state, CASE WHEN t.state IS NOT NULL THEN 'decision' WHEN r.state IS NOT NULL THEN 'rule' END AS source
FROM (SELECT *, {RULE} AS rule FROM findings) f LEFT JOIN triage t ON t.pos = f.pos
LEFT JOIN LATERAL (SELECT state FROM rules r WHERE (suppress_by = 'rule' AND match_value = f.rule) OR (suppress_by = 'rule_in_file' AND match_value = f.rule || ':' || f.path) OR (suppress_by = 'file' AND match_value = f.path) ORDER BY rule_no LIMIT 1) r ON true)"""


def applied(h):
    decisions = h.triage.select(F.lit(0).alias("nth"), F.concat(F.lit("fp"), F.col("pos")).alias("portable"), "state", "note")
    return hi.apply_triage(portable(h), decisions, h.rules.withColumn("note", F.lit(None).cast("string")))


@query("j06_triage_apply", f"SELECT pos, triage_state, source FROM {_APPLIED}")
def _(h):
    return applied(h).select("pos", "triage_state", "source")


@query("j06_triage_summary", f"SELECT count(*) FILTER (source = 'decision') AS decisions_applied, count(*) FILTER (source = 'rule') AS rules_applied, count(*) FILTER (triage_state IN ('false_positive', 'accepted_risk', 'suppressed', 'fixed')) AS inactive FROM {_APPLIED}")
def _(h):
    return hi.triage_summary(applied(h))


@query("j07_triage_import", f"SELECT f.pos, d.state, d.note FROM findings f JOIN {_DECISIONS} d ON d.portable = 'fp' || f.pos")
def _(h):
    return hi.import_triage(portable(h), h.triage.select(F.lit(0).alias("nth"), F.concat(F.lit("fp"), F.col("pos")).alias("portable"), "state", "note"))


@query("j07_last_decision", "SELECT f.pos, d.s[1] AS state, d.s[2] AS note FROM findings f JOIN (SELECT path, arg_max((t.state, t.note), t.pos) AS s FROM findings g JOIN triage t ON t.pos = g.pos GROUP BY path) d ON d.path = f.path")
def _(h):
    """Decisions on files, one after the other in the order of the triage file: the last one of a file holds for its findings."""
    decisions = h.findings.select("pos", F.col("path").alias("portable")).join(h.triage, "pos").withColumnRenamed("pos", "nth")
    return hi.import_triage(h.findings.select("pos", F.col("path").alias("portable")), decisions)


_ENDS = "(SELECT min(scan_id) AS a, max(scan_id) AS b FROM scans WHERE status = 'completed')"


@query("a20_baseline_drift", f"""SELECT count(DISTINCT fingerprint) FILTER (scan_id = a) AS baseline_total, (SELECT count(*) FROM (SELECT fingerprint FROM scan_findings, {_ENDS} WHERE scan_id = b EXCEPT SELECT fingerprint FROM scan_findings, {_ENDS} WHERE scan_id = a)) AS drift_new,
 (SELECT count(*) FROM (SELECT fingerprint FROM scan_findings, {_ENDS} WHERE scan_id = a EXCEPT SELECT fingerprint FROM scan_findings, {_ENDS} WHERE scan_id = b)) AS drift_fixed FROM scan_findings, {_ENDS}""")
def _(h):
    ends = h.scans.where("status = 'completed'").agg(F.min("scan_id").alias("a"), F.max("scan_id").alias("b")).first()
    return hi.baseline_drift(h.scan_findings.where(F.col("scan_id") == ends.a), h.scan_findings.where(F.col("scan_id") == ends.b), "fingerprint")
