"""Field-sensitive unification: values that are equal have equal fields.

Values are numbers that are unique over all bodies. `equal` (a, b) says that two values are one, `fields` (base, field, value) that a value is a field of another. Congruence closure goes by
levels: classes of the equalities; then the values of one field of one class become equal, their classes are merged, and so on, one field deeper each time, DEPTH times at most. Only
representatives take part after the first level, so later levels handle what is left of the graph. Field names are whatever the caller uses; ELEMENT stands for the contents of containers.

A class that holds a third of all rows is split: the values of one field are tied to the least of their slice, and the least of each slice to the least of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .graph import alias_sets

#: Levels of fields that are told apart (a fixed value), and slices of one field's values.
DEPTH, SLICES = 3, 64
ELEMENT = "<elem>"


def _tied(rows: DataFrame) -> DataFrame:
    """rows (base, field, value), distinct -> equalities (src, dst) that tie all values of a field of a base together."""
    sliced = rows.select("base", "field", "value", F.pmod(F.xxhash64("value"), F.lit(SLICES)).alias("slice"))
    least = sliced.groupBy("base", "field", "slice").agg(F.min("value").alias("low"))
    within = sliced.join(least, ["base", "field", "slice"]).where("value <> low").select(F.col("value").alias("src"), F.col("low").alias("dst"))
    first = least.groupBy("base", "field").agg(F.min("low").alias("lowest"))
    between = least.join(first, ["base", "field"]).where("low <> lowest").select(F.col("low").alias("src"), F.col("lowest").alias("dst"))
    return within.unionByName(between)


def unify(equal: DataFrame, fields: DataFrame, depth: int = DEPTH) -> DataFrame:
    """value, label (the least value of its class), closed (whether another level would change nothing; the same in each row).

    Null ends and null fields are left out. Values that only occur in fields are classes by themselves until merged.
    """
    equal = equal.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    fields = cut(fields.where("base IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL").select("base", "field", "value").distinct())
    every = equal.select(F.col("src").alias("value")).unionByName(equal.select(F.col("dst").alias("value"))).unionByName(fields.select(F.col("base").alias("value"))).unionByName(fields.select("value")).distinct()
    first = alias_sets(equal)
    label = cut(every.join(first.select(F.col("node").alias("value"), F.col("label").alias("found")), "value", "left").select("value", F.coalesce("found", "value").alias("label")))
    rows = _renamed(fields, label)
    level = 0
    while True:
        ties = cut(_tied(rows))
        if ties.isEmpty():
            return label.withColumn("closed", F.lit(True))
        if level == depth:
            return label.withColumn("closed", F.lit(False))
        level += 1
        merged = cut(alias_sets(ties).select(F.col("node").alias("value"), "label"))
        moved = merged.select(F.col("value").alias("label"), F.col("label").alias("then"))
        label = cut(label.join(moved, "label", "left").select("value", F.coalesce("then", "label").alias("label")))
        rows = _renamed(rows, merged)


def _renamed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Fields between representatives."""
    base = label.select(F.col("value").alias("base"), F.col("label").alias("base_label"))
    value = label.select("value", F.col("label").alias("value_label"))
    out = rows.join(base, "base", "left").join(value, "value", "left")
    return cut(out.select(F.coalesce("base_label", "base").alias("base"), "field", F.coalesce("value_label", "value").alias("value")).distinct())


def field_summary(params: DataFrame, accesses: DataFrame, labels: DataFrame) -> DataFrame:
    """fid, param, reads, writes: names of the fields of each parameter that its function reads and writes, in order.

    params (fid, param, value), accesses (fid, base, field, is_write), labels as of `unify`. An access is of every parameter of its function in the class of its base; the receiver's
    place is whatever the caller numbers it. Functions that touch no field of a parameter have no row.
    """
    at = labels.select("value", "label")
    p = params.join(at, "value", "left").select("fid", "param", F.coalesce("label", "value").alias("label"))
    a = accesses.select("fid", F.col("base").alias("value"), "field", "is_write").distinct().join(at, "value", "left").select("fid", F.coalesce("label", "value").alias("label"), "field", "is_write")
    names = lambda write: F.array_sort(F.collect_set(F.when(F.col("is_write") == write, F.col("field"))))
    return p.join(a, ["fid", "label"]).groupBy("fid", "param").agg(names(False).alias("reads"), names(True).alias("writes"))
