"""What follows detection: confidence, rank, deduplication, filters, summaries, rollups, budgets, health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import BIT, canonical_rule, confidence_rank, nonprod, one_of, severity_rank

TERMINAL = ("false_positive", "accepted_risk", "suppressed", "fixed")


def _starts(c: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


# The points, weights and bounds of taint_points, rank_parts and health_weight.


def taint_points(f: DataFrame) -> Column:
    """Points of a taint finding: source, completeness, hops, guards, precision, verdicts."""
    source = one_of(f.source_kind, {"UserInput": 3, "EnvironmentConfig": 2, "FileSystem": 2, "Database": 1, "CaughtException": 1, "Unknown": 1}, 0)
    complete = F.when(f.has_source & f.has_sink, 3).when(f.has_source | f.has_sink, 2).otherwise(1)
    hops = F.when(f.hop_count.isNull() | (f.hop_count <= 3), 0).when(f.hop_count <= 8, -1).otherwise(-2)
    symbolic = F.when(f.symbolic == "Infeasible", -5).when((f.symbolic == "Confirmed") & f.witness, 3).when(f.symbolic == "Confirmed", 2).otherwise(0)
    return source + complete + hops - F.when(f.path_validated, 3).otherwise(0) + F.when(f.cap_specificity == 1, 1).otherwise(0) - F.when(f.uses_summary, 1).otherwise(0) + symbolic


def confidence(f: DataFrame) -> Column:
    """Low, Medium or High by kind of rule; over-reporting and bailed analyses end at Medium."""
    points = taint_points(f)
    level = (
        F.when(_starts(f.id, "taint-"), F.when(points >= 5, 2).when(points >= 2, 1).otherwise(0))
        .when(f.id.isin("state-use-after-close", "state-double-close", "state-unauthed-access"), 2)
        .when(f.id == "state-resource-leak", 1)
        .when(f.id == "state-resource-leak-possible", 0)
        .when(_starts(f.id, "state-"), 1)
        .when(_starts(f.id, "cfg-"), F.when(f.has_source & f.has_sink, 2).otherwise(1))
        .otherwise(F.when(f.severity == "HIGH", 1).otherwise(0))
    )
    capped = F.when(f.note_direction.isin("OverReport", "Bail"), F.least(level, F.lit(1))).otherwise(level)
    return one_of(capped, {0: "Low", 1: "Medium", 2: "High"})


def rank_parts(f: DataFrame) -> dict[str, Column]:
    """The additive parts of the exploitability score."""
    evidence = F.least(F.lit(4), f.has_source.cast("int") + f.has_sink.cast("int") + F.least(F.lit(2), f.guards + f.sanitizers))
    return {
        "severity": one_of(f.severity, {"HIGH": 60, "MEDIUM": 30, "LOW": 10}, 0),
        "analysis": F.when(_starts(f.id, "taint-data-exfiltration"), 7).when(_starts(f.id, "taint-"), 10).when(_starts(f.id, "state-"), 8).when(_starts(f.id, "cfg-"), F.when(evidence > 0, 5).otherwise(3)).otherwise(0),
        "evidence": evidence,
        "source": one_of(f.source_kind, {"UserInput": 6, "EnvironmentConfig": 5, "Unknown": 4, "FileSystem": 3, "Database": 2, "CaughtException": 2}, 0),
        "exposure": F.when(f.auth_required.isNull(), 0).otherwise(F.when(f.auth_required, 4).otherwise(10) - F.when(f.transitive, 2).otherwise(0)),
        "state": one_of(canonical_rule(f.id), {"state-use-after-close": 6, "state-unauthed-access": 6, "state-double-close": 3, "state-resource-leak": 2, "state-resource-leak-possible": 1}, 0),
        "validated": F.when(f.path_validated, -5).otherwise(0),
        "confidence": one_of(f.confidence, {"High": 3, "Medium": 0, "Low": -5}, 0),
        "dynamic": F.when(f.verdict == "Confirmed", 20).when(f.verdict == "PartiallyConfirmed", 8).when((f.verdict == "NotConfirmed") & (f.n_attempts >= 1), -5).otherwise(0),
        "completeness": F.when(f.note_direction.isin("Bail", "OverReport"), -8).when(f.note_direction == "UnderReport", -3).otherwise(0),
    }


def rank_score(f: DataFrame) -> Column:
    return sum(rank_parts(f).values(), F.lit(0)).cast("double")


def rank_reason(f: DataFrame) -> Column:
    """The parts that count, by name."""
    return F.array_compact(F.array(*[F.when(v != 0, F.concat(F.lit(k + ":"), v.cast("string"))) for k, v in rank_parts(f).items()]))


def dedupe_flows(f: DataFrame) -> DataFrame:
    """Of unsanitised flows at one place, severity and capability the nearest one stays; other rules are left alone.

    The window needs no sort of the other rows: they pass beside it.
    """
    flow = f.id.startswith("taint-unsanitised-flow")
    big = F.lit(2**31 - 1)
    order = [F.col("function_rank"), F.coalesce("hop_count", big), F.coalesce(F.abs(F.col("line") - F.col("source_line")), big), F.coalesce("source_line", big), F.coalesce("source_col", big), F.col("pos")]
    best = Window.partitionBy("path", "line", "severity", "sink_caps").orderBy(*order)
    kept = f.where(flow).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
    return kept.unionByName(f.where(~flow))


def by_rank(f: DataFrame) -> list[Column]:
    """A total order: score, then severity, rule, place."""
    return [F.desc("rank_score"), severity_rank(F.col("severity")), F.col("id"), F.col("path"), F.col("line"), F.col("col"), F.col("pos")]


def top(f: DataFrame, n: int) -> DataFrame:
    return f.orderBy(*by_rank(f)).limit(n)


def parse_severity(expr: str) -> list[str]:
    """'HIGH', 'HIGH,LOW' or '>=MEDIUM' as a list."""
    from ..functions.findings import SEVERITIES

    text = expr.strip().upper()
    if text.startswith(">="):
        return list(SEVERITIES[: SEVERITIES.index(text[2:].strip()) + 1])
    some = [x.strip() for x in text.split(",") if x.strip()]
    if not some or any(x not in SEVERITIES for x in some):
        raise ValueError(f"no severity filter: {expr!r}")
    return some


def select_findings(f: DataFrame, severity: str | None = None, min_score: float | None = None, min_confidence: str | None = None, converged: bool = False, category: str | None = None, rule: str | None = None, path_prefix: str | None = None, search: str | None = None, disabled_rules: tuple = ()) -> DataFrame:
    """The filters of a findings listing, in one conjunction that reaches the scan."""
    if severity:
        f = f.where(F.col("severity").isin(parse_severity(severity)))
    if min_score is not None:
        f = f.where(F.col("rank_score") >= min_score)
    if min_confidence:
        f = f.where(F.col("confidence").isNull() | (confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(min_confidence))))
    if converged:
        f = f.where(F.coalesce(~F.col("note_direction").isin("OverReport", "Bail"), F.lit(True)))
    if category:
        f = f.where(F.col("category") == category)
    if rule:
        f = f.where(canonical_rule(F.col("id")) == rule)
    if path_prefix:
        f = f.where(F.col("path").startswith(path_prefix))
    if search:
        f = f.where(F.lower(F.concat_ws(" ", "path", "id", "sink_snippet")).contains(search.lower()))
    if disabled_rules:
        f = f.where(~canonical_rule(F.col("id")).isin(*disabled_rules))
    return f


def page(f: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    size = min(max(size, 1), 10_000)
    return f.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def summary(f: DataFrame) -> DataFrame:
    """Counts by severity, category, rule and file, and in all, from one pass over partial aggregates."""
    sets = f.select("severity", "category", canonical_rule(F.col("id")).alias("rule"), "path")
    c = [F.col(x) for x in ("severity", "category", "rule", "path")]
    grouped = sets.groupingSets([(c[0],), (c[1],), (c[2],), (c[3],), ()], *c).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = one_of(F.col("g"), {7: "severity", 11: "category", 13: "rule", 14: "file", 15: "all"})
    return grouped.select(kind.alias("dimension"), F.coalesce("severity", "category", "rule", "path", F.lit("")).alias("value"), "n")


ROLLUP_RULES = ("rs.quality.unwrap", "rs.quality.expect", "rs.quality.panic_macro")


def rollup(f: DataFrame, examples: int = 5, rules: tuple = ROLLUP_RULES) -> DataFrame:
    """Low quality findings of noisy rules, several in one file, as one row with a count and the first places."""
    rule = canonical_rule(F.col("id"))
    low = (F.col("severity") == "LOW") & (F.col("category") == "Quality") & rule.isin(*rules)
    some = f.where(low).select("path", rule.alias("rule"), "line", "col", "pos")
    first = some.withColumn("_k", F.row_number().over(Window.partitionBy("path", "rule").orderBy("line", "col", "pos"))).where(F.col("_k") <= examples)
    at = first.groupBy("path", "rule").agg(F.array_sort(F.collect_list(F.struct("line", "col", "pos"))).alias("at"))  # `examples` places at most
    g = some.groupBy("path", "rule").agg(F.count("*").alias("n")).join(at, ["path", "rule"])
    return g.select("path", "rule", "n", F.col("at")[0].line.alias("line"), F.col("at")[0].col.alias("col"), F.transform("at", lambda x: F.concat_ws(":", x.line, x.col)).alias("places"))


def low_budget(f: DataFrame, per_file: int = 1, per_rule: int = 10, total: int = 20) -> DataFrame:
    """The LOW rows that a greedy scan in rank order keeps within its budgets.

    A row refused by one budget uses up none, so a rule's or file's row numbers aren't enough. But a file keeps at most
    `per_file` rows and a rule `per_rule`, and rows are only taken in order: of a (file, rule) pair only the first `per_file`
    rows can ever be taken, of all rows of a file the first `per_file` * rules. That bound is applied by windows; the
    scan itself then stops at `total` rows, reading the rest in order.
    """
    low = f.where("severity = 'LOW'").select("pos", "path", canonical_rule(F.col("id")).alias("rule"), "rank_score", "id", "line", "col", "severity")
    pair = Window.partitionBy("path", "rule").orderBy(*by_rank(low))
    some = low.withColumn("_k", F.row_number().over(pair)).where(F.col("_k") <= per_file).drop("_k")
    # a rule's rows beyond the files that the total can fill are never reached either
    by_rule = Window.partitionBy("rule").orderBy(*by_rank(some))
    some = some.withColumn("_r", F.row_number().over(by_rule)).where(F.col("_r") <= per_rule + total * per_file).drop("_r")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[str, int] = {}
        rules: dict[str, int] = {}
        taken = 0
        for b in batches:
            keep = []
            for row in b.itertuples(index=False):
                if taken < total and files.get(row.path, 0) < per_file and rules.get(row.rule, 0) < per_rule:
                    files[row.path] = files.get(row.path, 0) + 1
                    rules[row.rule] = rules.get(row.rule, 0) + 1
                    taken += 1
                    keep.append((row.pos, row.path, row.rule))
            yield pd.DataFrame(keep, columns=["pos", "path", "rule"])

    return some.orderBy(*by_rank(some)).coalesce(1).mapInPandas(scan, "pos long, path string, rule string")


def cap_results(f: DataFrame, n: int) -> DataFrame:
    """High first, then Medium, then Low, up to n in all."""
    return f.orderBy(severity_rank(F.col("severity")), *by_rank(f)).limit(n)


def health_weight(f: DataFrame) -> Column:
    conf = F.when(f.confidence == "High", 1.0).when(f.confidence == "Medium", 0.6).when(f.confidence == "Low", 0.3).otherwise(0.5)
    verdict = F.when((f.verdict == "Confirmed") | (f.symbolic == "Confirmed"), 1.2).when((f.symbolic == "Infeasible"), 0.1).when(f.symbolic == "Inconclusive", 0.7).otherwise(1.0)
    context = F.when(nonprod(f.path), 0.3).when(f.n_steps == 0, 0.75).when(f.cross_file | f.uses_summary, 1.15).otherwise(1.0)
    base = F.when(f.severity == "HIGH", 10.0).when(f.severity == "MEDIUM", 3.0).otherwise(0.5)
    return base * F.greatest(F.lit(0.0), F.least(F.lit(1.2), conf * verdict * context))


def health(f: DataFrame, files: int) -> DataFrame:
    """The health score of a project and its grade, from one aggregate row."""
    w = f.select(health_weight(f).alias("w"), "severity", "category", ((F.col("severity") == "HIGH") & F.coalesce(F.col("confidence") == "High", F.lit(False))).alias("effective"))
    a = w.agg(F.sum(F.when(F.col("category") != "Quality", F.col("w")).otherwise(0.0)).alias("total"), F.count_if("effective").alias("highs"), F.count_if(F.col("category") == "Quality").alias("quality"))
    size = max(100, min(50_000, files))
    density = F.col("total") / (size / 100) ** 0.5
    base = 100 - 22 * F.log10(1 + density / 4) - F.least(F.lit(15.0), 0.05 * F.col("quality"))
    ceiling = F.when(F.col("highs") == 0, 100.0).when(F.col("highs") <= 1, 85.0).when(F.col("highs") <= 3, 78.0).when(F.col("highs") <= 6, 68.0).when(F.col("highs") <= 10, 58.0).otherwise(45.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(base, ceiling)))
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return a.select(score.alias("score"), grade.alias("grade"), "highs", "quality")


def preferred_chain_cap(bits: Column) -> Column:
    """The lowest bit that has a rule of its own, else the lowest bit."""
    own = bits.bitwiseAND(BIT["CODE_EXEC"] | BIT["DESERIALIZE"] | BIT["SSRF"])
    pick = F.when(own != 0, own).otherwise(bits)
    return pick.bitwiseAND(-pick)
