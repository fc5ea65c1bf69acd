"""Streaming forms over files, driven to the end of what is there."""

from pyspark.sql import functions as F

from auditloom.streaming import live


def test_live_gate_counts(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 10 / 10).alias("conf"), (F.col("id") % 2 == 0).alias("right"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.live_gate_counts(stream, "ts", 0.5, "conf", F.col("right")).writeStream.format("memory").queryName("gates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("gates").orderBy("start").collect()
    assert len(got) >= 7 and all((r.total, r.shown) == (24, 12) or r.total == 24 for r in got)


def test_live_keep_first(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "2024-01-01 00:00:00"), ("d1", "2024-01-01 00:01:00"), ("d2", "2024-01-01 00:02:00")], "digest string, t string").select("digest", F.to_timestamp("t").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.live_keep_first(stream, "ts", "digest").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.digest for r in spark.table("firsts").collect()) == ["d1", "d2"]
