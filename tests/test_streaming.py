"""Streams give what the batch operators give."""

import random

from pyspark.sql import functions as F

from factloom.operators import trace
from factloom.streaming import monitor


def test_lag_monitor_equals_batch(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(u, c, rnd.choice("ab")) for u in range(4) for c in range(60)]
    df = spark.createDataFrame(rows, "u long, c long, s string")
    for k in range(3):
        df.where((F.col("c") >= 20 * k) & (F.col("c") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, c long, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = monitor.lag_monitor(stream, "u", "c", "s", [("s", "a", 2)], "s", 1)
    q = out.writeStream.format("memory").queryName("lagged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = trace.holds(df, "u", "c", "s", [("s", "a", 2)], source="s", latency=1).select("u", "c", "enabled", "ok")
    got = spark.table("lagged")
    assert sorted(map(tuple, got.drop("late").collect())) == sorted(map(tuple, batch.collect())) and not got.where("late").count()


def test_lag_monitor_orders_frames_and_tells_late_ones(spark, tmp_path):
    """Frames shuffled within the wait give what the batch gives; one that comes after its place is told."""
    rnd = random.Random(2)
    rows = [(u, c, rnd.choice("ab")) for u in range(3) for c in range(60)]
    come = sorted(rows, key=lambda r: r[1] + rnd.random() * 5)
    parts = [come[:70], come[70:140], [*come[140:], (0, 3, "b"), (1, 20, "a")]]
    for part in parts:
        spark.createDataFrame(part, "u long, c long, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, c long, s string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = monitor.lag_monitor(stream, "u", "c", "s", [("s", "a", 2)], "s", 1, wait=6)
    q = out.writeStream.format("memory").queryName("waited").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("waited")
    batch = trace.holds(spark.createDataFrame(rows, "u long, c long, s string"), "u", "c", "s", [("s", "a", 2)], source="s", latency=1).where("c <= 53")
    assert sorted(map(tuple, got.where("NOT late").drop("late").collect())) == sorted(map(tuple, batch.select("u", "c", "enabled", "ok").collect()))
    assert sorted((r.u, r.c) for r in got.where("late").collect()) == [(0, 3), (1, 20)]


def test_latest_rows_and_counts(spark, tmp_path):
    rows = [(k % 3, k, f"v{k}", f"2024-01-01 0{k % 4}:10:00") for k in range(12)]
    df = spark.createDataFrame(rows, "key long, version long, value string, t string").withColumn("t", F.to_timestamp("t"))
    for k in range(2):
        df.where(F.col("version") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(monitor.upsert_latest(str(tmp_path / "out"), ["key"], "version")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.key, r.version) for r in spark.read.parquet(str(tmp_path / "out/generation=1")).collect()) == [(0, 9), (1, 10), (2, 11)]
    counts = monitor.findings_by_time(df.withColumns({"code": F.lit("OC1"), "object_id": F.col("value")}), "t").collect()
    assert sorted(r.n for r in counts) == [3, 3, 3, 3]
