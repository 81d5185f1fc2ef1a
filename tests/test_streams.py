"""Streams to their end against the same rows at once."""

import random

from pyspark.sql import functions as F

from orespark.operators import intervals
from orespark.streaming import assays
from orespark.streaming.intercepts import STORE, stream_intercepts


def test_windowed_grades(spark, tmp_path):
    rows = [("A", 0.0, 1.0, 2.0, "2024-01-01 00:10:00"), ("A", 1.0, 3.0, 5.0, "2024-01-01 00:50:00"), ("B", 0.0, 2.0, None, "2024-01-01 00:20:00"),
        ("A", 3.0, 4.0, 1.0, "2024-01-01 01:10:00"), ("Z", 0.0, 1.0, 1.0, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "hole_id string, `from` double, `to` double, au double, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = assays.windowed_grades(stream, "au", "at")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["hole_id"], r["start"].hour, r["samples"], r["grade"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["hole_id"] != "Z"}
    assert got == {("A", 0, 2, 4.0), ("B", 0, 1, None), ("A", 1, 1, 1.0)}


def test_intercepts_of_a_disordered_stream(spark, tmp_path):
    random.seed(5)
    rows = []
    for h in range(12):
        for i in range(40):
            if random.random() < 0.9:
                rows.append((f"H{h}", 2.0 * i, 2.0 * i + 2, random.choice([None, 0.5, 1.0, 3.0, 4.0, 5.0]), 60 * i))
    df = spark.createDataFrame(rows, "hole_id string, `from` double, `to` double, au double, s long").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    want = {tuple(r) for r in intervals.significant_intercepts(df, "au", 3.0, 2.0, label=False).select("hole_id", "from", "to", "length", F.round("avg_grade", 9), "n_samples").collect()}
    late = df.withColumn("arrival", F.floor((F.col("s") + F.pmod(F.xxhash64("hole_id", "from"), F.lit(500))) / 600)).cache()  # up to 500 s late
    for k in range(5):
        late.filter(F.col("arrival") == k if k < 4 else F.col("arrival") >= 4).drop("arrival").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    end = df.limit(1).select(F.lit("end").alias("hole_id"), F.lit(0.0).alias("from"), F.lit(1.0).alias("to"), F.lit(0.0).alias("au"), F.lit(0).cast("long").alias("s"),
        F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    end.write.parquet(str(tmp_path / "in" / "5"))
    spark.conf.set(*next(iter(STORE.items())))
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = stream_intercepts(stream, "au", 3.0, 2.0, "at", delay="20 minutes")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination(200)
    finally:
        spark.conf.unset(next(iter(STORE)))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("hole_id", "from", "to", "length", F.round("avg_grade", 9), "n_samples").collect()]
    assert len(got) == len(set(got)) and set(got) == want
