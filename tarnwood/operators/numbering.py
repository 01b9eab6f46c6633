"""Places in a total order without bringing all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place from 0 on. Rows are dealt out by ranges of the order and counted; a partition's rows stand behind those before it.

    The order has to be total: rows that tie are numbered in any order. What goes to the driver is a number for each partition."""
    low = (1 << 33) - 1
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted((r.p, r.n) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = list(zip([p for p, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    before = df.sparkSession.createDataFrame(starts, "_p long, _before long")
    out = dealt.withColumn("_p", part.cast("long")).join(F.broadcast(before), "_p")
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(low)).drop("_p", "_before", "_id")
