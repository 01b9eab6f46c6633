from pyspark.sql import functions as F

from tarnwood.operators.state import lifecycle_issues
from tarnwood.streaming import OPS, append_audit, lifecycle, stream_of, windowed_counts

SF = "/root/testdata/sf0.001"


def feed(spark, folder, n=3):
    e = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(n):  # in order of ids, as they would come
        cut = e.approxQuantile("event_id", [i / n, (i + 1) / n], 0.0)
        part = e.where((F.col("event_id") > cut[0]) & (F.col("event_id") <= cut[1]) if i else F.col("event_id") <= cut[1])
        part.coalesce(1).write.mode("append").parquet(folder)
    return e


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_lifecycle_stream_is_the_batch_fold(spark, tmp_path):
    folder = str(tmp_path / "in")
    e = feed(spark, folder)
    run(lifecycle(stream_of(spark, folder, files_per_trigger=10)), "life", "append")
    op = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in OPS.items()], F.lit("other"))
    want = lifecycle_issues(e.select(F.col("user_id").alias("subject"), F.col("event_id").alias("seq"), op.alias("op")))
    assert sorted(map(tuple, spark.table("life").collect())) == sorted(map(tuple, want.collect()))


def test_windows_and_audit(spark, tmp_path):
    folder = str(tmp_path / "in")
    e = feed(spark, folder, 2)
    run(windowed_counts(stream_of(spark, folder)), "windows", "complete")
    want = e.groupBy(F.window("ts", "1 hour").start.alias("s"), "event_type").agg(F.count("*").alias("n")).collect()
    assert sorted((r.start, r.event_type, r.n) for r in spark.table("windows").collect()) == sorted(map(tuple, want))
    q = append_audit(stream_of(spark, folder), str(tmp_path / "audit"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "audit")).count() == e.count()
