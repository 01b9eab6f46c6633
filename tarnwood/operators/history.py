"""Triage overlays and comparisons between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import canonical_rule

TERMINAL = ("false_positive", "accepted_risk", "suppressed", "fixed")


def overlay(f: DataFrame, states: DataFrame, rules: DataFrame) -> DataFrame:
    """f (pos, path, id) with triage_state and level: the finding's own decision, else the newest rule that matches.

    A rule matches a rule id, a rule in a file ('rule:path') or a file. Each level is an equi-join on one key of rules, of which
    the newest of a key is taken first; nothing is compared pairwise.
    """
    newest = rules.groupBy("suppress_by", "match_value").agg(F.max(F.struct("created_at", "rule_no", "state")).alias("r"))
    rule = canonical_rule(F.col("id"))
    out = f.join(states.select("pos", F.col("state").alias("own")), "pos", "left")
    for level, key in (("rule", rule), ("rule_in_file", F.concat_ws(":", rule, F.col("path"))), ("file", F.col("path"))):
        of = newest.where(F.col("suppress_by") == level).select(F.col("match_value").alias("_key"), F.col("r").alias(f"_{level}"))
        out = out.withColumn("_key", key).join(of, "_key", "left").drop("_key")
    hits = F.array_compact(F.array(*[F.when(F.col(f"_{x}").isNotNull(), F.struct(F.col(f"_{x}.created_at").alias("at"), F.col(f"_{x}.rule_no").alias("no"), F.lit(x).alias("level"), F.col(f"_{x}.state").alias("state"))) for x in ("rule", "rule_in_file", "file")]))
    best = F.array_max(hits)
    state = F.coalesce(F.col("own"), F.try_element_at(F.sort_array(hits, False), F.lit(1)).state, F.lit("open"))
    level = F.when(F.col("own").isNotNull(), "fingerprint").otherwise(best.level)
    return out.withColumn("triage_state", state).withColumn("level", level).drop("own", "_rule", "_rule_in_file", "_file")


def transition(base: Column, now: Column, in_base: Column, in_now: Column) -> Column:
    """New, Resolved, Regressed, FlippedConfirmed, FlippedNotConfirmed or Unchanged."""
    bad = F.coalesce(now == "Confirmed", F.lit(False))
    was = F.coalesce(base == "Confirmed", F.lit(False))
    return (
        F.when(~in_base, "New").when(~in_now, "Resolved").when(base.eqNullSafe(now), "Unchanged").when(bad & F.coalesce(base == "NotConfirmed", F.lit(False)), "Regressed")
        .when(bad, "FlippedConfirmed").when(was, "FlippedNotConfirmed").otherwise("Unchanged")
    )


def verdict_diff(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, verdict) twice -> key, base_verdict, now_verdict, transition."""
    a = base.select(key, F.col("verdict").alias("base_verdict"), F.lit(True).alias("_a"))
    b = now.select(key, F.col("verdict").alias("now_verdict"), F.lit(True).alias("_b"))
    j = a.join(b, key, "full_outer")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select(key, "base_verdict", "now_verdict", transition(F.col("base_verdict"), F.col("now_verdict"), there("_a"), there("_b")).alias("transition"))


def compare(left: DataFrame, right: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Multisets matched by key, the i-th on the left with the i-th on the right: key, n, status and changed fields."""
    w = Window.partitionBy(*key).orderBy(*order)
    side = lambda d, s: d.withColumn("n", F.row_number().over(w)).select(*key, "n", F.struct(*fields).alias(s))
    j = side(left, "l").join(side(right, "r"), [*key, "n"], "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")), F.lit(x)) for x in fields]))
    status = F.when(F.col("l").isNull(), "new").when(F.col("r").isNull(), "fixed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return j.select(*key, "n", status.alias("status"), F.when(status == "changed", changed).alias("fields"), "l", "r")


def fingerprint_history(found: DataFrame) -> DataFrame:
    """(scan_id, fingerprint) -> each fingerprint's scans, in order, with the one before."""
    w = Window.partitionBy("fingerprint").orderBy("scan_id")
    return found.withColumn("previous", F.lag("scan_id").over(w)).withColumn("first_seen", F.min("scan_id").over(Window.partitionBy("fingerprint")))


def trend_slope(points: DataFrame, at: str, total: str, n: int = 5) -> DataFrame:
    """(oldest - newest) / largest of the last n points; null with fewer than 3."""
    last = points.orderBy(F.desc(at)).limit(n)
    a = last.agg(F.min_by(total, at).alias("oldest"), F.max_by(total, at).alias("newest"), F.max(total).alias("top"), F.count("*").alias("k"))
    return a.select(F.when(F.col("k") >= 3, (F.col("oldest") - F.col("newest")) / F.greatest(F.col("top"), F.lit(1))).alias("slope"), "k")


def last_decisions(decisions: DataFrame) -> DataFrame:
    """portable, d (state, note): of several decisions on one fingerprint the last of the file counts, by its place `nth`; of equal places the greater state."""
    return decisions.groupBy("portable").agg(F.max(F.struct("nth", "state", "note")).alias("d"))


def import_triage(f: DataFrame, decisions: DataFrame) -> DataFrame:
    """f (pos, portable), decisions (nth, portable, state, note) -> pos, state, note of findings that a decision of another checkout is about."""
    newest = last_decisions(decisions)
    return f.select("pos", "portable").join(newest, "portable").select("pos", "d.state", "d.note")


def apply_triage(f: DataFrame, decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """f (pos, portable, path, id), decisions (nth, portable, state, note) -> with triage_state, triage_note and source: a decision of the file, else the first of its rules that matches.

    rules (rule_no, suppress_by, match_value, state, note) match a fingerprint, a rule, a rule in a file or a file; of a key only the first stays, then each level is an equi-join."""
    own = last_decisions(decisions).withColumnRenamed("d", "_d")
    first = rules.groupBy("suppress_by", "match_value").agg(F.min(F.struct("rule_no", "state", "note")).alias("r"))
    rule, out, hits = canonical_rule(F.col("id")), f.join(own, "portable", "left"), []
    for level, key in (("fingerprint", F.col("portable")), ("rule", rule), ("rule_in_file", F.concat_ws(":", rule, F.col("path"))), ("file", F.col("path"))):
        of = first.where(F.col("suppress_by") == level).select(F.col("match_value").alias("_key"), F.col("r").alias(f"_{level}"))
        out = out.withColumn("_key", key.cast("string")).join(of, "_key", "left").drop("_key")
        hits.append(F.col(f"_{level}"))
    best = F.array_min(F.array_compact(F.array(*hits)))
    source = F.when(F.col("_d").isNotNull(), "decision").when(best.isNotNull(), "rule")
    state = F.coalesce(F.col("_d.state"), best.state, F.lit("open"))
    return out.select(*f.columns, state.alias("triage_state"), F.coalesce(F.col("_d.note"), best.note).alias("triage_note"), source.alias("source"))


def triage_summary(applied: DataFrame) -> DataFrame:
    """decisions_applied, rules_applied, inactive: one row."""
    return applied.agg(F.count_if(F.col("source") == "decision").alias("decisions_applied"), F.count_if(F.col("source") == "rule").alias("rules_applied"), F.count_if(F.col("triage_state").isin(*TERMINAL)).alias("inactive"))


def baseline_drift(base: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """baseline_total, drift_new, drift_fixed: one row."""
    both = base.select(key).distinct().withColumn("a", F.lit(1)).join(now.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    return both.agg(F.count("a").alias("baseline_total"), F.count_if(F.col("a").isNull()).alias("drift_new"), F.count_if(F.col("b").isNull()).alias("drift_fixed"))
