"""Queries over one snapshot of findings: rank, confidence, filters, summaries, rollups, health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import findings as fn
from ..operators import findings as op
from .registry import query

_STARTS = "(id LIKE 'taint-%')"
_SEV = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"
RULE = "trim(split_part(id, ' (', 1))"
EVIDENCE = "least(4, has_source::INT + has_sink::INT + least(2, guards + sanitizers))"
SCORE = f"""CAST(CASE severity WHEN 'HIGH' THEN 60 WHEN 'MEDIUM' THEN 30 WHEN 'LOW' THEN 10 ELSE 0 END
  + CASE WHEN id LIKE 'taint-data-exfiltration%' THEN 7 WHEN id LIKE 'taint-%' THEN 10 WHEN id LIKE 'state-%' THEN 8 WHEN id LIKE 'cfg-%' THEN CASE WHEN {EVIDENCE} > 0 THEN 5 ELSE 3 END ELSE 0 END + {EVIDENCE}
  + CASE source_kind WHEN 'UserInput' THEN 6 WHEN 'EnvironmentConfig' THEN 5 WHEN 'Unknown' THEN 4 WHEN 'FileSystem' THEN 3 WHEN 'Database' THEN 2 WHEN 'CaughtException' THEN 2 ELSE 0 END
  + CASE WHEN auth_required IS NULL THEN 0 WHEN auth_required THEN 4 - CASE WHEN transitive THEN 2 ELSE 0 END ELSE 10 - CASE WHEN transitive THEN 2 ELSE 0 END END
  + CASE {RULE} WHEN 'state-use-after-close' THEN 6 WHEN 'state-unauthed-access' THEN 6 WHEN 'state-double-close' THEN 3 WHEN 'state-resource-leak' THEN 2 WHEN 'state-resource-leak-possible' THEN 1 ELSE 0 END
  - CASE WHEN path_validated THEN 5 ELSE 0 END + CASE confidence WHEN 'High' THEN 3 WHEN 'Low' THEN -5 ELSE 0 END
  + CASE verdict WHEN 'Confirmed' THEN 20 WHEN 'PartiallyConfirmed' THEN 8 WHEN 'NotConfirmed' THEN CASE WHEN n_attempts >= 1 THEN -5 ELSE 0 END ELSE 0 END
  - CASE note_direction WHEN 'Bail' THEN 8 WHEN 'OverReport' THEN 8 WHEN 'UnderReport' THEN 3 ELSE 0 END AS DOUBLE)"""
POINTS = """(CASE source_kind WHEN 'UserInput' THEN 3 WHEN 'EnvironmentConfig' THEN 2 WHEN 'FileSystem' THEN 2 WHEN 'Database' THEN 1 WHEN 'CaughtException' THEN 1 WHEN 'Unknown' THEN 1 ELSE 0 END
  + 1 + has_source::INT + has_sink::INT + CASE WHEN hop_count IS NULL OR hop_count <= 3 THEN 0 WHEN hop_count <= 8 THEN -1 ELSE -2 END - CASE WHEN path_validated THEN 3 ELSE 0 END
  + (cap_specificity = 1)::INT - uses_summary::INT + CASE symbolic WHEN 'Infeasible' THEN -5 WHEN 'Confirmed' THEN 2 + witness::INT ELSE 0 END)"""
CONFIDENCE = f"""(CASE WHEN id LIKE 'taint-%' THEN CASE WHEN {POINTS} >= 5 THEN 2 WHEN {POINTS} >= 2 THEN 1 ELSE 0 END WHEN id IN ('state-use-after-close', 'state-double-close', 'state-unauthed-access') THEN 2
  WHEN id = 'state-resource-leak' THEN 1 WHEN id = 'state-resource-leak-possible' THEN 0 WHEN id LIKE 'state-%' THEN 1 WHEN id LIKE 'cfg-%' THEN CASE WHEN has_source AND has_sink THEN 2 ELSE 1 END ELSE CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END END)"""
CAPPED = f"CASE WHEN note_direction IN ('OverReport', 'Bail') THEN least(1, {CONFIDENCE}) ELSE {CONFIDENCE} END"
DEDUPED = f"""(SELECT * FROM (SELECT *, CASE WHEN id LIKE 'taint-unsanitised-flow%' THEN row_number() OVER (PARTITION BY path, line, severity, sink_caps, id LIKE 'taint-unsanitised-flow%'
  ORDER BY function_rank, coalesce(hop_count, 2147483647), coalesce(abs(line - source_line), 2147483647), coalesce(source_line, 2147483647), coalesce(source_col, 2147483647), pos) ELSE 1 END AS k FROM findings) WHERE k = 1)"""
ORDER = f"rank_score DESC, {_SEV}, id, path, line, col, pos"


def ranked(h):
    f = h.findings
    return f.withColumn("rank_score", op.rank_score(f))


@query("a50_attack_rank", f"SELECT pos, {SCORE} AS rank_score FROM findings")
def _(h):
    return ranked(h).select("pos", "rank_score")


@query("a50_rank_reasons", f"SELECT pos, {SCORE} AS total FROM findings")
def _(h):
    f = h.findings
    parts = F.transform(op.rank_reason(f), lambda x: F.substring_index(x, ":", -1).cast("double"))
    return f.select("pos", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("a51_confidence", f"SELECT pos, CASE {CAPPED} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS level FROM findings")
def _(h):
    return h.findings.select("pos", op.confidence(h.findings).alias("level"))


@query("a52_taint_points", f"SELECT pos, {POINTS} AS points FROM findings WHERE id LIKE 'taint-%'")
def _(h):
    return h.findings.where(F.col("id").startswith("taint-")).select("pos", op.taint_points(h.findings).alias("points"))


@query("a53_exfil_confidence", "SELECT pos, CASE WHEN symbolic = 'Infeasible' THEN 'Low' WHEN source_kind IN ('EnvironmentConfig', 'Database', 'FileSystem') THEN CASE WHEN symbolic = 'Confirmed' THEN 'High' ELSE 'Medium' END ELSE 'Low' END AS level FROM findings WHERE id LIKE 'taint-data-exfiltration%'")
def _(h):
    sensitive = F.coalesce(F.col("source_kind").isin("EnvironmentConfig", "Database", "FileSystem"), F.lit(False))
    level = F.when(F.col("symbolic") == "Infeasible", "Low").when(sensitive, F.when(F.col("symbolic") == "Confirmed", "High").otherwise("Medium")).otherwise("Low")
    return h.findings.where(F.col("id").startswith("taint-data-exfiltration")).select("pos", level.alias("level"))


@query("a54_engine_note_cap", f"SELECT pos, least(1, {CONFIDENCE}) AS capped FROM findings WHERE note_direction IN ('OverReport', 'Bail')")
def _(h):
    f = h.findings.where("note_direction IN ('OverReport', 'Bail')")
    return f.select("pos", fn.confidence_rank(op.confidence(f)).alias("capped"))


@query("w01_flow_dedupe", f"SELECT pos, path, line, id FROM {DEDUPED}")
def _(h):
    return op.dedupe_flows(h.findings).select("pos", "path", "line", "id")


@query("t01_top_findings", f"SELECT pos, path, line, id, severity, rank_score FROM (SELECT *, {SCORE} AS rank_score FROM {DEDUPED}) ORDER BY {ORDER} LIMIT 100")
def flagship(h):
    f = op.dedupe_flows(h.findings)
    f = f.withColumn("rank_score", op.rank_score(f))
    return op.top(f, 100).select("pos", "path", "line", "id", "severity", "rank_score")


@query("t02_tie_order", f"SELECT pos, row_number() OVER (PARTITION BY path ORDER BY {ORDER}) AS place FROM (SELECT *, {SCORE} AS rank_score FROM findings)")
def _(h):
    f = ranked(h)
    return f.select("pos", F.row_number().over(Window.partitionBy("path").orderBy(*op.by_rank(f))).alias("place"))


@query("t03_post_process", f"SELECT pos, id, rank_score FROM (SELECT *, {SCORE} AS rank_score, {CAPPED} AS level FROM {DEDUPED}) WHERE level >= 1 ORDER BY {ORDER} LIMIT 500")
def _(h):
    f = op.dedupe_flows(h.findings)
    f = f.where(fn.confidence_rank(op.confidence(f)) >= 1).withColumn("rank_score", op.rank_score(f))
    return op.top(f, 500).select("pos", "id", "rank_score")


@query("f01_severity_filter", "SELECT pos FROM findings WHERE severity IN ('HIGH', 'MEDIUM')")
def _(h):
    return op.select_findings(h.findings, severity=">=MEDIUM").select("pos")


@query("f02_min_score", f"SELECT pos FROM findings WHERE {SCORE} >= 70")
def _(h):
    return op.select_findings(ranked(h), min_score=70).select("pos")


@query("f03_min_confidence", "SELECT pos FROM findings WHERE confidence IS NULL OR confidence IN ('Medium', 'High')")
def _(h):
    return op.select_findings(h.findings, min_confidence="Medium").select("pos")


@query("f04_converged", "SELECT pos FROM findings WHERE note_direction IS NULL OR note_direction NOT IN ('OverReport', 'Bail')")
def _(h):
    return op.select_findings(h.findings, converged=True).select("pos")


@query("f06_findings_page", f"SELECT pos, path, id FROM (SELECT *, {SCORE} AS rank_score FROM findings) WHERE severity IN ('HIGH', 'LOW') AND category = 'Security' AND path LIKE 'src/1%' AND (confidence IS NULL OR confidence <> 'Low') AND lower(path || ' ' || id || ' ' || sink_snippet) LIKE '%sink1%' ORDER BY {ORDER} LIMIT 50 OFFSET 50")
def _(h):
    f = op.select_findings(ranked(h), severity="HIGH,LOW", category="Security", path_prefix="src/1", min_confidence="Medium", search="SINK1")
    return op.page(f, op.by_rank(f), 2, 50).select("pos", "path", "id")


@query("f07_scan_findings_page", "SELECT pos, id FROM findings_b WHERE severity = 'MEDIUM' AND category = 'Reliability' ORDER BY path, line, col, pos LIMIT 100")
def _(h):
    return op.page(op.select_findings(h.findings_b, severity="MEDIUM", category="Reliability"), ["path", "line", "col", "pos"], 1, 100).select("pos", "id")


@query("f14_redundant_patterns", "SELECT pos FROM findings a WHERE id LIKE '%.%.%' AND NOT EXISTS (SELECT 1 FROM findings t WHERE t.id LIKE 'taint-%' AND t.path = a.path AND t.line = a.line AND t.sink_caps = a.sink_caps)")
def _(h):
    taint = h.findings.where(F.col("id").startswith("taint-")).select("path", "line", "sink_caps").distinct()
    return h.findings.where(F.col("id").rlike(r"^[^.]+\.[^.]+\..")).join(taint, ["path", "line", "sink_caps"], "left_anti").select("pos")


@query("f16_span_dedupe", "SELECT pos FROM findings a WHERE NOT (id = 'cfg-unguarded-sink' AND EXISTS (SELECT 1 FROM findings t WHERE t.id LIKE 'taint-%' AND t.path = a.path AND t.line = a.line AND t.col = a.col))")
def _(h):
    spans = h.findings.where(F.col("id").startswith("taint-")).select("path", "line", "col").distinct()
    unguarded = F.col("id") == "cfg-unguarded-sink"
    kept = h.findings.where(unguarded).join(spans, ["path", "line", "col"], "left_anti")
    return kept.select("pos").unionByName(h.findings.where(~unguarded).select("pos"))


@query("f17_disabled_rules", f"SELECT pos FROM findings WHERE {RULE} NOT IN ('rs.quality.unwrap', 'cfg-error-fallthrough')")
def _(h):
    return op.select_findings(h.findings, disabled_rules=("rs.quality.unwrap", "cfg-error-fallthrough")).select("pos")


@query("a01_findings_summary", f"""
SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM findings GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY ALL
UNION ALL SELECT 'rule', {RULE}, count(*) FROM findings GROUP BY ALL UNION ALL SELECT 'file', path, count(*) FROM findings GROUP BY ALL UNION ALL SELECT 'all', '', count(*) FROM findings""")
def _(h):
    return op.summary(h.findings)


@query("a02_filter_facets", f"SELECT list_sort(list(DISTINCT severity)) AS severities, list_sort(list(DISTINCT category)) AS categories, list_sort(list(DISTINCT {RULE})) AS rules, list_sort(list(DISTINCT confidence) FILTER (confidence IS NOT NULL)) AS confidences FROM findings")
def _(h):
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return h.findings.agg(distinct("severity").alias("severities"), distinct("category").alias("categories"), distinct(fn.canonical_rule(F.col("id"))).alias("rules"), distinct("confidence").alias("confidences"))


LANG = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'cpp' END"


@query("a03_by_language", f"SELECT {LANG} AS language, count(*) AS n FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy(fn.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("a04_top_directories", "SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, directory LIMIT 10")
def _(h):
    return h.findings.groupBy(fn.parent_dir(F.col("path")).alias("directory")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "directory").limit(10)


@query("a05_top_rules", f"SELECT {RULE} AS rule, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, rule LIMIT 5")
def _(h):
    return h.findings.groupBy(fn.canonical_rule(F.col("id")).alias("rule")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(5)


@query("a06_confidence_distribution", "SELECT count(*) FILTER (confidence = 'High') AS high, count(*) FILTER (confidence = 'Medium') AS medium, count(*) FILTER (confidence = 'Low') AS low, count(*) FILTER (confidence IS NULL) AS none FROM findings")
def _(h):
    c = F.col("confidence")
    return h.findings.agg(F.count_if(c == "High").alias("high"), F.count_if(c == "Medium").alias("medium"), F.count_if(c == "Low").alias("low"), F.count_if(c.isNull()).alias("none"))


@query("a07_weighted_files", "SELECT path, sum(CASE severity WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 3 ELSE 1 END)::BIGINT AS score FROM findings GROUP BY 1 ORDER BY score DESC, path LIMIT 10")
def _(h):
    w = fn.one_of(F.col("severity"), {"HIGH": 10, "MEDIUM": 3, "LOW": 1})
    return h.findings.groupBy("path").agg(F.sum(w).alias("score")).orderBy(F.desc("score"), "path").limit(10)


@query("a08_cross_file_ratio", "SELECT avg((uses_summary OR cross_file)::INT::DOUBLE) AS ratio FROM findings")
def _(h):
    return h.findings.agg(F.avg((F.col("uses_summary") | F.col("cross_file")).cast("double")).alias("ratio"))


@query("a09_hot_sinks", "SELECT split_part(sink_snippet, '(', 1) AS callee, count(*) AS n FROM findings WHERE has_sink GROUP BY 1 ORDER BY n DESC, callee LIMIT 10")
def _(h):
    return h.findings.where("has_sink").groupBy(F.substring_index("sink_snippet", "(", 1).alias("callee")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").limit(10)


@query("a10_scanner_quality", "SELECT count(*) FILTER (symbolic IS NOT NULL)::DOUBLE / nullif(count(*), 0) AS symbolic_coverage, count(*) FILTER (note_direction IN ('Bail', 'OverReport', 'UnderReport'))::DOUBLE / nullif(count(*), 0) AS degraded FROM findings")
def _(h):
    n = F.nullif(F.count("*"), F.lit(0))
    return h.findings.agg((F.count_if(F.col("symbolic").isNotNull()) / n).alias("symbolic_coverage"), (F.count_if(F.col("note_direction").isin("Bail", "OverReport", "UnderReport")) / n).alias("degraded"))


@query("a11_language_health", f"SELECT {LANG} AS language, count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM findings GROUP BY 1")
def _(h):
    s = F.col("severity")
    return h.findings.groupBy(fn.language(F.col("path")).alias("language")).agg(F.count("*").alias("total"), F.count_if(s == "HIGH").alias("high"), F.count_if(s == "MEDIUM").alias("medium"), F.count_if(s == "LOW").alias("low"))


OWASP = "CASE WHEN id = 'taint-sql-injection' THEN 'A03' WHEN id = 'taint-data-exfiltration' THEN 'A04' WHEN id LIKE 'taint-%' THEN 'A03' WHEN id LIKE 'state-%' THEN 'A04' WHEN id LIKE '%.code_exec.%' OR id LIKE '%.xss.%' THEN 'A03' END"


@query("p16_owasp_bucket", f"SELECT DISTINCT {RULE} AS rule, {OWASP} AS code FROM findings")
def _(h):
    return h.findings.select(fn.canonical_rule(F.col("id")).alias("rule"), fn.owasp(F.col("id")).alias("code")).distinct()


@query("a21_owasp_totals", f"SELECT {OWASP} AS code, count(*) AS n FROM findings WHERE {OWASP} IS NOT NULL GROUP BY 1")
def _(h):
    return h.findings.groupBy(fn.owasp(F.col("id")).alias("code")).agg(F.count("*").alias("n")).where("code IS NOT NULL")


@query("a22_rule_counts", f"SELECT {RULE} AS rule, count(*) AS n FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy(fn.canonical_rule(F.col("id")).alias("rule")).agg(F.count("*").alias("n"))


@query("a27_verdict_summary", "SELECT coalesce(verdict, 'none') AS verdict, count(*) AS n FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@query("a28_differential_verdict", """SELECT path, bool_or(pos % 2 = 0 AND verdict = 'Confirmed') AS vuln, bool_or(pos % 2 = 1 AND verdict = 'Confirmed') AS benign,
CASE WHEN bool_or(pos % 2 = 0 AND verdict = 'Confirmed') THEN CASE WHEN bool_or(pos % 2 = 1 AND verdict = 'Confirmed') THEN 'BothConfirm' ELSE 'VulnOnly' END ELSE CASE WHEN bool_or(pos % 2 = 1 AND verdict = 'Confirmed') THEN 'BenignOnly' ELSE 'NeitherConfirms' END END AS outcome
FROM (SELECT path, pos, coalesce(verdict, '') AS verdict FROM findings) GROUP BY 1""")
def _(h):
    fired = F.coalesce(F.col("verdict") == "Confirmed", F.lit(False))
    g = h.findings.groupBy("path").agg(F.bool_or(fired & (F.col("pos") % 2 == 0)).alias("vuln"), F.bool_or(fired & (F.col("pos") % 2 == 1)).alias("benign"))
    outcome = F.when(F.col("vuln"), F.when(F.col("benign"), "BothConfirm").otherwise("VulnOnly")).otherwise(F.when(F.col("benign"), "BenignOnly").otherwise("NeitherConfirms"))
    return g.withColumn("outcome", outcome)


@query("a31_symbolic_verdict", "SELECT path, CASE WHEN bool_or(symbolic = 'Confirmed') THEN 'Confirmed' WHEN bool_and(symbolic = 'Infeasible') AND bool_and(NOT uses_summary) THEN 'Infeasible' ELSE 'Inconclusive' END AS verdict FROM findings WHERE symbolic IS NOT NULL GROUP BY 1")
def _(h):
    s = F.col("symbolic")
    v = F.when(F.bool_or(s == "Confirmed"), "Confirmed").when(F.bool_and(s == "Infeasible") & F.bool_and(~F.col("uses_summary")), "Infeasible").otherwise("Inconclusive")
    return h.findings.where(s.isNotNull()).groupBy("path").agg(v.alias("verdict"))


@query("a39_worst_note", "SELECT path, max(CASE note_direction WHEN 'UnderReport' THEN 1 WHEN 'OverReport' THEN 2 WHEN 'Bail' THEN 3 END) AS worst FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy("path").agg(F.max(fn.one_of(F.col("note_direction"), {"UnderReport": 1, "OverReport": 2, "Bail": 3})).alias("worst"))


@query("a43_directory_rollup", f"""
WITH RECURSIVE up AS (SELECT path AS dir, path, severity FROM findings UNION ALL SELECT CASE WHEN dir LIKE '%/%' THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END, path, severity FROM up WHERE dir <> '')
SELECT dir, count(*) AS n, min({_SEV}) AS worst FROM up WHERE dir NOT LIKE '%.%' GROUP BY 1""")
def _(h):
    f = h.findings.groupBy("path").agg(F.count("*").alias("n"), F.min(fn.severity_rank(F.col("severity"))).alias("worst"))  # files first, then their few directories
    return f.select(F.explode(fn.ancestors(F.col("path"))).alias("dir"), "n", "worst").groupBy("dir").agg(F.sum("n").alias("n"), F.min("worst").alias("worst"))


@query("w02_rollup", "SELECT path, id AS rule, count(*) AS n, min_by(line, (line, col, pos)) AS line, min_by(col, (line, col, pos)) AS col, list_transform(list_slice(list_sort(list({'line': line, 'col': col, 'pos': pos})), 1, 5), lambda x: x.line::VARCHAR || ':' || x.col::VARCHAR) AS places FROM findings WHERE severity = 'LOW' AND category = 'Quality' AND id = 'rs.quality.unwrap' GROUP BY 1, 2 HAVING count(*) > 1")
def _(h):
    return op.rollup(h.findings).where("n > 1")


@query("w03_low_budget")
def _(h):
    return op.low_budget(ranked(h))


@query("w04_cap_results", f"SELECT pos, severity FROM (SELECT *, {SCORE} AS rank_score FROM findings) ORDER BY {_SEV}, {ORDER} LIMIT 250")
def _(h):
    return op.cap_results(ranked(h), 250).select("pos", "severity")


@query("w05_prioritise")
def _(h):
    f = ranked(h).where("category <> 'Quality'")
    kept = f.where("severity <> 'LOW'").select("pos", "path", fn.canonical_rule(F.col("id")).alias("rule")).unionByName(op.low_budget(f))
    return kept


@query("w09_alternatives", "SELECT pos, (SELECT count(DISTINCT b.id) FROM findings b WHERE b.path = a.path AND b.line = a.line AND b.function_name = a.function_name AND b.id <> a.id) AS others FROM findings a")
def _(h):
    ids = h.findings.groupBy("path", "line", "function_name").agg(F.collect_set("id").alias("ids"))
    return h.findings.join(ids, ["path", "line", "function_name"]).select("pos", F.size(F.array_except("ids", F.array("id"))).cast("long").alias("others"))


W = """(CASE severity WHEN 'HIGH' THEN 10.0 WHEN 'MEDIUM' THEN 3.0 ELSE 0.5 END::DOUBLE * greatest(0, least(1.2::DOUBLE, CASE confidence WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6 WHEN 'Low' THEN 0.3 ELSE 0.5 END::DOUBLE
 * CASE WHEN verdict = 'Confirmed' OR symbolic = 'Confirmed' THEN 1.2 WHEN symbolic = 'Infeasible' THEN 0.1 WHEN symbolic = 'Inconclusive' THEN 0.7 ELSE 1.0 END::DOUBLE
 * CASE WHEN path LIKE '%/tests/%' THEN 0.3 WHEN n_steps = 0 THEN 0.75 WHEN cross_file OR uses_summary THEN 1.15 ELSE 1.0 END::DOUBLE)))"""


@query("a24_credibility", f"SELECT path, sum(round({W} * 1000)::BIGINT)::BIGINT AS weight, count(*) FILTER (severity = 'HIGH' AND confidence = 'High') AS effective_high FROM findings GROUP BY 1")
def _(h):
    f = h.findings
    return f.select("path", op.health_weight(f).alias("w"), ((F.col("severity") == "HIGH") & (F.col("confidence") == "High")).alias("e")).groupBy("path").agg(F.sum(F.round(F.col("w") * 1000).cast("long")).alias("weight"), F.count_if("e").alias("effective_high"))


@query("a23_health_score", f"""
SELECT round(greatest(0, least(100 - 22 * log10(1 + total / sqrt(greatest(100, least(50000, files)) / 100.0) / 4) - least(15, 0.05 * quality), ceiling))) AS score, highs, quality,
  CASE WHEN round(greatest(0, least(100 - 22 * log10(1 + total / sqrt(greatest(100, least(50000, files)) / 100.0) / 4) - least(15, 0.05 * quality), ceiling))) >= 60 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT sum({W}) FILTER (category <> 'Quality') AS total, count(*) FILTER (severity = 'HIGH' AND confidence = 'High') AS highs, count(*) FILTER (category = 'Quality') AS quality, count(DISTINCT path) AS files,
  CASE WHEN count(*) FILTER (severity = 'HIGH' AND confidence = 'High') > 10 THEN 45 ELSE 58 END AS ceiling FROM findings)""")
def _(h):
    return op.health(h.findings, h.findings.select("path").distinct().count())


@query("p13_canonical_rule", f"SELECT DISTINCT id, {RULE} AS rule, CASE WHEN id LIKE '%.%' THEN split_part(id, '.', 2) ELSE split_part(id, '-', 1) END AS family FROM findings")
def _(h):
    return h.findings.select("id").distinct().select("id", fn.canonical_rule(F.col("id")).alias("rule"), fn.family(F.col("id")).alias("family"))


@query("p07_sanitizer_status", "SELECT pos, CASE WHEN sanitizers = 0 THEN 'none' WHEN suppressed THEN 'applied' ELSE 'bypassed' END AS status FROM findings")
def _(h):
    return h.findings.select("pos", fn.sanitizer_status(F.col("sanitizers"), F.col("suppressed")).alias("status"))


@query("p10_cap_names", "SELECT DISTINCT sink_caps AS bits, log2(sink_caps)::INT AS bit FROM findings")
def _(h):
    names = F.array(*[F.lit(n) for n in fn.CAPABILITIES])
    return h.findings.select("sink_caps").distinct().select(F.col("sink_caps").alias("bits"), (F.array_position(names, fn.cap_labels(F.col("sink_caps"))[0]) - 1).cast("int").alias("bit"))


@query("p11_cap_labels", "SELECT path, bit_count(bit_or(sink_caps))::INT AS n FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy("path").agg(F.bit_or("sink_caps").alias("bits")).select("path", F.size(fn.cap_labels(F.col("bits"))).alias("n"))


@query("p30_fingerprint", f"SELECT pos, sha256({RULE} || chr(0) || path || chr(0) || sink_snippet || chr(0) || source_snippet || chr(0) || function_name) AS fingerprint FROM findings")
def _(h):
    return h.findings.select("pos", fn.fingerprint(fn.canonical_rule(F.col("id")), F.col("path"), F.col("sink_snippet"), F.col("source_snippet"), F.col("function_name")).alias("fingerprint"))


@query("p29_stable_hash", "SELECT pos, substr(sha256(id || chr(0) || path || chr(0) || line::VARCHAR || chr(0) || col::VARCHAR || chr(0) || sink_caps::VARCHAR), 1, 16) AS stable_hash FROM findings")
def _(h):
    return h.findings.select("pos", F.substring(fn.fingerprint(*[F.col(c) for c in ("id", "path", "line", "col", "sink_caps")]), 1, 16).alias("stable_hash"))


@query("p31_portable_fingerprint", "SELECT pos, sha256(id || chr(0) || regexp_replace(path, '^src/?', '') || chr(0) || function_name) AS fingerprint FROM findings")
def _(h):
    return h.findings.select("pos", fn.fingerprint(F.col("id"), F.regexp_replace("path", "^src/?", ""), F.col("function_name")).alias("fingerprint"))


@query("p41_nonprod_paths", "SELECT DISTINCT path, path LIKE '%/tests/%' AS nonprod FROM findings")
def _(h):
    return h.findings.select("path").distinct().select("path", fn.nonprod(F.col("path")).alias("nonprod"))


@query("p43_downgrade", "SELECT pos, CASE severity WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM findings WHERE path LIKE '%/tests/%'")
def _(h):
    return h.findings.where(fn.nonprod(F.col("path"))).select("pos", fn.downgrade(F.col("severity")).alias("severity"))


@query("p33_limiters", "SELECT pos, list_filter(['validated path', 'cross-file summary', 'many hops', 'engine note'], lambda x: CASE x WHEN 'validated path' THEN path_validated WHEN 'cross-file summary' THEN uses_summary WHEN 'many hops' THEN coalesce(hop_count > 8, false) ELSE coalesce(note_direction IN ('Bail', 'OverReport', 'UnderReport'), false) END) AS limiters FROM findings")
def _(h):
    return h.findings.select("pos", F.array_compact(F.array(F.when(F.col("path_validated"), "validated path"), F.when(F.col("uses_summary"), "cross-file summary"), F.when(F.col("hop_count") > 8, "many hops"), F.when(F.col("note_direction").isin("Bail", "OverReport", "UnderReport"), "engine note"))).alias("limiters"))


@query("x46_source_severity", "SELECT DISTINCT source_kind, CASE source_kind WHEN 'UserInput' THEN 'HIGH' WHEN 'EnvironmentConfig' THEN 'HIGH' WHEN 'Unknown' THEN 'HIGH' WHEN 'FileSystem' THEN 'MEDIUM' WHEN 'Database' THEN 'MEDIUM' WHEN 'CaughtException' THEN 'LOW' END AS severity, CASE source_kind WHEN 'UserInput' THEN 'Plain' WHEN 'EnvironmentConfig' THEN 'Sensitive' WHEN 'FileSystem' THEN 'Sensitive' WHEN 'Database' THEN 'Sensitive' WHEN 'CaughtException' THEN 'Sensitive' WHEN 'Unknown' THEN 'Plain' END AS sensitivity FROM findings")
def _(h):
    k = F.col("source_kind")
    severity = fn.one_of(k, {"UserInput": "HIGH", "EnvironmentConfig": "HIGH", "Unknown": "HIGH", "FileSystem": "MEDIUM", "Database": "MEDIUM", "CaughtException": "LOW"})
    plain = fn.one_of(k, {"UserInput": "Plain", "Unknown": "Plain", "EnvironmentConfig": "Sensitive", "FileSystem": "Sensitive", "Database": "Sensitive", "CaughtException": "Sensitive"})
    return h.findings.select("source_kind").distinct().select("source_kind", severity.alias("severity"), plain.alias("sensitivity"))


@query("x55_feasibility", "SELECT pos, CASE WHEN verdict = 'Confirmed' THEN 'Confirmed' WHEN verdict = 'Inconclusive' AND confidence = 'High' THEN 'InconclusiveHighConf' ELSE 'Unverified' END AS bucket FROM findings")
def _(h):
    b = F.when(F.col("verdict") == "Confirmed", "Confirmed").when((F.col("verdict") == "Inconclusive") & (F.col("confidence") == "High"), "InconclusiveHighConf").otherwise("Unverified")
    return h.findings.select("pos", b.alias("bucket"))


@query("x58_lowest_bit", "SELECT path, bit_or(sink_caps) & -bit_or(sink_caps) AS low, CASE WHEN (bit_or(sink_caps) & 1792) <> 0 THEN (bit_or(sink_caps) & 1792) & -(bit_or(sink_caps) & 1792) ELSE bit_or(sink_caps) & -bit_or(sink_caps) END AS preferred FROM findings GROUP BY 1")
def _(h):
    return h.findings.groupBy("path").agg(F.bit_or("sink_caps").alias("b")).select("path", fn.lowest_bit(F.col("b")).alias("low"), op.preferred_chain_cap(F.col("b")).alias("preferred"))


@query("j18_related", "SELECT a.pos, count(b.pos) AS related FROM findings a LEFT JOIN findings b ON b.path = a.path AND b.pos <> a.pos GROUP BY 1")
def _(h):
    # the count of a self join, from the size of each group: no pair is made
    n = h.findings.groupBy("path").agg((F.count("*") - 1).alias("related"))
    return h.findings.join(n, "path").select("pos", "related")


@query("k19_sarif_levels", f"SELECT {RULE} AS rule, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY 1, 2")
def _(h):
    from ..sinks import sarif_level

    return h.findings.groupBy(fn.canonical_rule(F.col("id")).alias("rule"), sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))
