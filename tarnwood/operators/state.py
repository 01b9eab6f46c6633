"""State machines over event sequences: resource life cycles, authorisation before use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lifecycle_issues(events: DataFrame) -> DataFrame:
    """events (subject, seq, op) -> subject, seq, issue: what an operation finds a handle in that it must not."""
    before = Window.partitionBy("subject").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("open", "close"), F.col("op")), ignorenulls=True).over(before)
    e = events.withColumn("before", last)
    op, was = F.col("op"), F.col("before")
    issue = F.when((op == "use") & (was == "close"), "use-after-close").when((op == "close") & (was == "close"), "double-close").when((op == "open") & (was == "open"), "reopened")
    return e.select("subject", "seq", issue.alias("issue")).where("issue IS NOT NULL")


def leaks(events: DataFrame) -> DataFrame:
    """Handles whose last open has no later close; partial aggregates, no sort."""
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    g = events.groupBy("subject").agg(last("open").alias("opened"), last("close").alias("closed"))
    return g.where("opened > coalesce(closed, -1)").select("subject", "opened")


def unchecked(events: DataFrame, use: str, check: str) -> DataFrame:
    """events (subject, seq, event_type): uses with no check at or before them. Only the first check of a subject matters."""
    first = events.where(F.col("event_type") == check).groupBy("subject").agg(F.min("seq").alias("first"))
    return events.where(F.col("event_type") == use).join(first, "subject", "left").where("first IS NULL OR first > seq").select("subject", "seq")


def convergence_class(deltas: DataFrame) -> DataFrame:
    """deltas (subject, seq, delta) in rounds that hit a cap -> subject, class.

    oscillation: the last four are a, b, a, b; plateau: the last two are the same and not 0; shrinking: no round changed more than the one before;
    unknown: anything else, or less than two rounds. One window and a partial aggregate: a subject's rounds are never collected.
    """
    w = Window.partitionBy("subject").orderBy("seq")
    d = deltas.select("subject", "seq", "delta", *[F.lag("delta", k).over(w).alias(f"d{k}") for k in (1, 2, 3)])
    last = F.max_by(F.struct("delta", "d1", "d2", "d3"), "seq").alias("last")
    g = d.groupBy("subject").agg(last, F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("delta") > F.col("d1"), F.lit(False))).alias("grew")).select("subject", "n", "grew", "last.*")
    swings = (F.col("n") >= 4) & (F.col("delta") == F.col("d2")) & (F.col("d1") == F.col("d3")) & (F.col("delta") != F.col("d1"))
    kind = F.when(F.col("n") < 2, "unknown").when(swings, "oscillation").when((F.col("delta") == F.col("d1")) & (F.col("delta") > 0), "plateau").when(~F.col("grew"), "shrinking").otherwise("unknown")
    return g.select("subject", kind.alias("class"))
