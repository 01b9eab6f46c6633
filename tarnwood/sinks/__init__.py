"""Outputs: JSON envelopes, SARIF, baselines, console text, index tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import canonical_rule, one_of


def sarif_level(severity: Column) -> Column:
    return one_of(severity, {"HIGH": "error", "MEDIUM": "warning", "LOW": "note"}, "none")


def sarif_results(f: DataFrame) -> DataFrame:
    """One SARIF result object a row, as JSON text; nothing is gathered."""
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return f.select(F.to_json(F.struct(canonical_rule(F.col("id")).alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("id").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def write_sarif(f: DataFrame, path: str, tool: str = "tarnwood") -> None:
    """A SARIF 2.1.0 log in one file; results are streamed to it, rules are the distinct ids."""
    rules = [{"id": r[0]} for r in f.select(canonical_rule(F.col("id"))).distinct().orderBy(F.col(f.select(canonical_rule(F.col("id"))).columns[0])).collect()]
    with open(path, "w") as out:
        head = json.dumps({"tool": {"driver": {"name": tool, "rules": rules}}})[:-1]
        out.write('{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [' + head + ', "results": [')
        for i, r in enumerate(sarif_results(f).toLocalIterator()):
            out.write((", " if i else "") + r.result)
        out.write("]}]}")


def write_json(f: DataFrame, path: str) -> None:
    f.write.mode("overwrite").json(path)


def write_baseline(f: DataFrame, path: str) -> None:
    """Only what a later diff reads."""
    f.select("stable_hash", "verdict", "severity", "path", F.col("id").alias("rule_id")).write.mode("overwrite").json(path)


def write_triage(decisions: DataFrame, path: str) -> None:
    """Decisions in the order of their fingerprints, null fields left out, so that equal decisions make equal files."""
    decisions.select("portable", "state", "note").distinct().orderBy("portable", "state", "note").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_triage(spark, path: str) -> DataFrame:
    return spark.read.schema("portable string, state string, note string").json(path).where("portable IS NOT NULL AND state IS NOT NULL")


def read_baseline(spark, path: str) -> DataFrame:
    """Stripped entries, or full findings of which the same columns are taken."""
    return spark.read.schema("stable_hash string, verdict string, severity string, path string, rule_id string, id string").json(path).select("stable_hash", "verdict", "severity", "path", F.coalesce("rule_id", "id").alias("rule_id"))


def render_console(f: DataFrame, limit: int = 1000) -> str:
    """Findings by file, for people: at most `limit` lines."""
    out, path = [], None
    for r in f.orderBy("path", "line", "col", "id").limit(limit).select("path", "line", "col", "severity", "id").collect():
        if r.path != path:
            path = r.path
            out.append(path)
        out.append(f"  {r.line}:{r.col}  {r.severity:<6} {r.id}")
    return "\n".join(out)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key of both."""
    both = table.unionByName(changes)
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return both.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def replace_of_files(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the files in `rows` replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def remove_files(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone, keys, "left_anti")
