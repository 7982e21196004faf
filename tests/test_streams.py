"""Streaming twins on a file source, run to the end of the input."""

from pyspark.sql import functions as F

from lodestrand.streaming import streams


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_dedup_and_windows(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 50).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_table_stream(spark, str(tmp_path / "in"), df.schema)
    assert drain(streams.late_dedup(stream, ["k"], "at", "10 hours"), "once").count() == 50
    counts = drain(streams.windowed_counts(stream.withColumn("k", F.lit("x")), "at", "k"), "wins")
    assert counts.count() >= 1 and counts.agg(F.max("n")).first()[0] == 60


def test_leases(spark, tmp_path):
    events = [("j", "claim", "a", 0, 100), ("j", "claim", "b", 50, 100), ("j", "renew", "a", 90, 100), ("j", "claim", "b", 150, 100), ("j", "claim", "b", 191, 100), ("j", "release", "a", 192, 0), ("i", "claim", "a", 0, 10), ("i", "release", "a", 5, 0)]
    df = spark.createDataFrame(events, "key string, kind string, owner string, at_us long, ttl_us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(streams.leases(streams.read_table_stream(spark, str(tmp_path / "in"), df.schema)), "held", "update")
    assert sorted(tuple(r) for r in got.collect()) == [("i", 1, "a", False), ("j", 2, "b", True)]


def test_each_batch(spark, tmp_path):
    df = spark.range(10)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    streams.on_each_batch(streams.read_table_stream(spark, str(tmp_path / "in"), df.schema), lambda b, _: seen.append(b.count()), str(tmp_path / "c")).awaitTermination(120)
    assert sum(seen) == 10
