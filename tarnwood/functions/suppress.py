"""Inline suppression directives in source text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A directive of a line, or of the next one, with its rules; '#' and '//' comments.
DIRECTIVE = r"(?:#|//)\s*lint:ignore(-next-line)?\s+([A-Za-z0-9_.*-]+(?:\s*,\s*[A-Za-z0-9_.*-]+)*)"


def directives(files: DataFrame, key: str, text: str, pattern: str = DIRECTIVE) -> DataFrame:
    """key, line_no, line, k (the how many-th of its file) of lines that match; files without a match are left out before they are split."""
    some = files.where(F.col(text).rlike("(?m)" + pattern) if pattern.startswith("^") else F.col(text).rlike(pattern))
    lines = some.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line")).where(F.col("line").rlike(pattern))
    return lines.select(key, (F.col("n") + 1).alias("line_no"), "line", F.row_number().over(Window.partitionBy(key).orderBy("n")).alias("k"))


def matchers(found: DataFrame, key: str) -> DataFrame:
    """key, line that is covered, matcher: one row for each rule a directive names."""
    nxt = F.regexp_extract("line", DIRECTIVE, 1) != ""
    rules = F.split(F.regexp_extract("line", DIRECTIVE, 2), r"\s*,\s*")
    return found.select(key, (F.col("line_no") + nxt.cast("int")).alias("covered"), F.explode(rules).alias("matcher"))


def suppressed(findings: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """Findings on covered lines whose rule is the matcher, or under it if it ends in '.*'."""
    j = findings.join(covers.withColumnRenamed("covered", "line"), [key, "line"])
    hit = (F.col("id") == F.col("matcher")) | (F.col("matcher").endswith(".*") & F.expr("startswith(id, substring(matcher, 1, length(matcher) - 1))"))
    return j.where(hit).drop("matcher").distinct()
