"""The index of scanned files, rules and scans: what changed, what is switched off, what is recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_status(files: DataFrame, index: DataFrame) -> DataFrame:
    """files and index (path, mtime, hash) -> path, status: new, unchanged (the time is the same, so the hash isn't compared), touched (time differs, content doesn't), changed, deleted."""
    j = files.select("path", F.struct("mtime", "hash").alias("f")).join(index.select("path", F.struct("mtime", "hash").alias("i")), "path", "full_outer")
    f, i = F.col("f"), F.col("i")
    status = F.when(i.isNull(), "new").when(f.isNull(), "deleted").when(f.mtime == i.mtime, "unchanged").when(f.hash.eqNullSafe(i.hash), "touched").otherwise("changed")
    return j.select("path", status.alias("status"))


def toggle(disabled: DataFrame, ids: DataFrame) -> DataFrame:
    """disabled (id): each of ids is taken out if it is there, put in if not; an id given twice is back where it was."""
    flips = ids.groupBy("id").agg((F.count("*") % 2 == 1).alias("flip"))
    j = disabled.distinct().withColumn("off", F.lit(True)).join(flips, "id", "full_outer")
    return j.where(F.coalesce("off", F.lit(False)) != F.coalesce("flip", F.lit(False))).select("id")


def clone(rules: DataFrame, ids: DataFrame, suffix: str = "-custom") -> DataFrame:
    """rules (id, builtin, ...) with a copy of each named builtin rule as one's own; one that has a copy already gets none."""
    copies = rules.where("builtin").join(ids.distinct(), "id", "left_semi").withColumn("id", F.concat("id", F.lit(suffix))).withColumn("builtin", F.lit(False))
    return rules.unionByName(copies.join(rules.select("id"), "id", "left_anti").select(*rules.columns))


def merge_config(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """(key, value) settings: each layer's non-null values over those before it; keys that no layer before knows are kept too."""
    every = defaults.withColumn("_n", F.lit(0))
    for n, layer in enumerate(layers, 1):
        every = every.unionByName(layer.withColumn("_n", F.lit(n)))
    return every.where("value IS NOT NULL").groupBy("key").agg(F.max_by("value", "_n").alias("value"))


def custom_labels(calls: DataFrame, custom: DataFrame, builtin: DataFrame) -> DataFrame:
    """calls (call, callee), rules (matcher, label, cap_bits) -> call, label, cap_bits: a configured rule for a name or its last part, else a builtin one."""
    last = F.substring_index("callee", ".", -1)
    keys = calls.select("call", F.explode(F.array_distinct(F.array(F.col("callee"), last))).alias("matcher"), "callee")
    rules = custom.withColumn("_n", F.lit(0)).unionByName(builtin.withColumn("_n", F.lit(1)))
    order = F.struct("_n", -F.length("matcher"), "matcher", "label", "cap_bits")
    return keys.join(rules, "matcher").groupBy("call").agg(F.min(order).alias("r")).select("call", F.col("r.label").alias("label"), F.col("r.cap_bits").alias("cap_bits"))


def update_scans(scans: DataFrame, changes: DataFrame) -> DataFrame:
    """scans with what changes (scan_id and some of its columns) says over it; scans that are not recorded yet are put in."""
    cols = [c for c in scans.columns if c != "scan_id"]
    given = [c for c in cols if c in changes.columns]
    j = scans.join(changes.select("scan_id", *[F.col(c).alias(f"_{c}") for c in given]), "scan_id", "full_outer")
    return j.select("scan_id", *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in cols])


def fixpoint_records(deltas: DataFrame, cap: int) -> DataFrame:
    """deltas (subject, seq, delta) -> one record a component: rounds, largest and last change, whether the cap was hit."""
    g = deltas.groupBy("subject").agg(F.count("*").alias("rounds"), F.max("delta").alias("largest"), F.max_by("delta", "seq").alias("last"))
    return g.withColumn("capped", (F.col("rounds") >= cap) & (F.col("last") > 0))


def decorator_level(decorators, rules: tuple = ("login_required", "authenticated", "permission_required")):
    """Admin for a role or administrator's decorator, Authed for one that ends in a rule's name, else Unauthed."""
    low = F.transform(decorators, F.lower)
    admin = F.exists(low, lambda d: d.rlike("admin|hasrole|superuser"))
    authed = F.exists(low, lambda d: d.rlike("(" + "|".join(rules) + ")$"))
    return F.when(F.coalesce(admin, F.lit(False)), "Admin").when(F.coalesce(authed, F.lit(False)), "Authed").otherwise("Unauthed")
