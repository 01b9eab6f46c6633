"""Structured Streaming: incremental scans, telemetry, life cycles, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_of(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive; only new files are read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by event time; state is dropped once the watermark has passed a window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: Event types as operations on a handle.
OPS = {"view": "open", "click": "use", "error": "close"}


def lifecycle(events: DataFrame) -> DataFrame:
    """subject, seq, issue: the life cycle of one handle for each user, with its last open or close as state.

    Rows of one trigger are taken in order of event_id; the batch fold in operators.state is the specification.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values("event_id").itertuples(index=False):
            op = OPS.get(r.event_type)
            if op == "use" and was == "close":
                rows.append((key[0], r.event_id, "use-after-close"))
            elif op == "close" and was == "close":
                rows.append((key[0], r.event_id, "double-close"))
            elif op == "open" and was == "open":
                rows.append((key[0], r.event_id, "reopened"))
            if op in ("open", "close"):
                was = op
        if was:
            state.update((was,))
        yield pd.DataFrame(rows, columns=["subject", "seq", "issue"])

    return events.groupBy("user_id").applyInPandasWithState(step, "subject long, seq long, issue string", "was string", "append", GroupStateTimeout.NoTimeout)


def append_audit(stream: DataFrame, path: str, checkpoint: str):
    """Every micro-batch appended once: the batch id is part of its folder, so a retry overwrites itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
