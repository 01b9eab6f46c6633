"""Checks of an authorization model: routes with their guards, operations and checks of a unit by line.

routes (unit, path, guards array); ops (unit, line, subject, kind, session_held, batch); checks (unit, line, kind, subject, element);
lookups (unit, line, expiry_checked, recipient_checked). Each check is an aggregate of one side and an equi-join on (unit, subject):
what stands before an operation is told by the first line of a subject's checks, so no pairs of lines are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Guards by what they ask for, and paths that only administrators may use.
LOGIN_GUARDS, ADMIN_GUARDS = ("require_login", "login_required", "authenticate"), ("require_admin", "admin_required", "is_admin")
ADMIN_PATH = r"(^|/)admin(/|$)"
OWNERSHIP, GRANTS = ("ownership", "membership"), ("ownership", "membership", "admin")


def _any(guards: Column, names: tuple) -> Column:
    return F.arrays_overlap(guards, F.array(*map(F.lit, names)))


def admin_routes(routes: DataFrame) -> DataFrame:
    """unit, path of administrators' routes that ask for a login and no more."""
    admin = _any(F.col("guards"), ADMIN_GUARDS)
    return routes.where(F.col("path").rlike(ADMIN_PATH) & ~admin & _any(F.col("guards"), LOGIN_GUARDS)).select("unit", "path")


def _uncovered(ops: DataFrame, checks: DataFrame, kinds: tuple) -> DataFrame:
    """Operations without a check of these kinds on their subject at or before their line."""
    first = checks.where(F.col("kind").isin(*kinds)).groupBy("unit", "subject").agg(F.min("line").alias("first"))
    return ops.join(first, ["unit", "subject"], "left").where("first IS NULL OR first > line").drop("first")


def ownership_gaps(ops: DataFrame, checks: DataFrame) -> DataFrame:
    """Operations on what an id names, whose subject no ownership or membership check covers before."""
    return _uncovered(ops.where("NOT session_held"), checks, GRANTS)


def stale_authorization(ops: DataFrame, checks: DataFrame) -> DataFrame:
    """Mutations of a subject that the session has held since, with no check at or before them."""
    return _uncovered(ops.where("session_held AND kind = 'mutation'"), checks, GRANTS)


def partial_batches(ops: DataFrame, checks: DataFrame) -> DataFrame:
    """Operations on a whole collection where a check at or before them covers one element, and none the collection."""
    some = checks.where(F.col("kind").isin(*GRANTS)).groupBy("unit", "subject").agg(F.min(F.when(F.col("element"), F.col("line"))).alias("one"), F.min(F.when(~F.col("element"), F.col("line"))).alias("whole"))
    return ops.where("batch").join(some, ["unit", "subject"]).where("one <= line AND (whole IS NULL OR whole > line)").drop("one", "whole")


def token_override(ops: DataFrame, lookups: DataFrame) -> DataFrame:
    """unit, line, reason: the last mutation at or after a unit's first lookup of a token, if it overrides the token or expiry or recipient were not checked."""
    first = lookups.groupBy("unit").agg(F.min(F.struct(F.col("line").alias("looked_up"), "expiry_checked", "recipient_checked")).alias("t")).select("unit", "t.*")
    last = ops.where("kind = 'mutation'").join(first, "unit").where("line >= looked_up").groupBy("unit").agg(F.max_by(F.struct("line", "override", "expiry_checked", "recipient_checked"), F.struct("line", "op")).alias("m"))
    reason = F.when(F.col("m.override"), "override").when(~F.col("m.expiry_checked"), "expiry").when(~F.col("m.recipient_checked"), "recipient")
    return last.select("unit", F.col("m.line").alias("line"), reason.alias("reason")).where("reason IS NOT NULL")


def findings(routes: DataFrame, ops: DataFrame, checks: DataFrame, lookups: DataFrame) -> DataFrame:
    """unit, line, rule of all five checks."""
    as_rule = lambda d, rule, line: d.select("unit", line.cast("long").alias("line"), F.lit(rule).alias("rule"))
    out = as_rule(admin_routes(routes), "admin_route_missing_admin_check", F.lit(0))
    for rule, d in (("missing_ownership_check", ownership_gaps(ops, checks)), ("partial_batch_authorization", partial_batches(ops, checks)), ("stale_authorization", stale_authorization(ops, checks)), ("token_override_without_validation", token_override(ops, lookups))):
        out = out.unionByName(as_rule(d, rule, F.col("line")))
    return out
