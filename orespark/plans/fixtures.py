"""Drillhole and block tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("DH"), key).alias("hole_id"), F.col("o_orderpriority").alias("project_id"),
        (F.lit(500000.0) + key % 100 * 50).alias("easting"),
        (F.lit(6900000.0) + F.floor(key / 100) * 50).alias("northing"), (F.lit(300.0) + key % 37).alias("elevation"),
    )


def _lines(spark: SparkSession, sf_dir: str, *aggregates) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*aggregates)


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    return lines.select(F.concat(F.lit("DH"), "l_orderkey").alias("hole_id"), ((F.col("l_linenumber") - 1) * F.lit(25.0)).alias("depth"),
        (F.col("q") * F.lit(7.0)).cast("double").alias("azimuth"), (F.lit(-90.0) + F.col("t") * 500).cast("double").alias("dip"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, F.max("l_discount").alias("d"), F.max("l_returnflag").alias("geology_code"))
    return lines.select(F.concat(F.lit("DH"), "l_orderkey").alias("hole_id"), ((F.col("l_linenumber") - 1) * F.lit(2.0)).alias("from"),
        (F.col("l_linenumber") * F.lit(2.0)).alias("to"), (F.col("d") * 100).cast("double").alias("au_ppm"), "geology_code")


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("DH"), "user_id").alias("hole_id"),
        F.col("value").cast("double").alias("depth"), (e % 91).cast("double").alias("dip"), (e * 37 % 360).cast("double").alias("azimuth"),
        F.col("event_type").alias("structure_type"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select(
        k.alias("block_id"), (k % 20 * 10 + F.lit(5.0)).alias("x"), (F.floor(k / 20) % 20 * 10 + F.lit(5.0)).alias("y"),
        (F.floor(k / 400) * 10 + F.lit(5.0)).alias("z"),
        *[F.lit(10.0).alias(c) for c in ("dx", "dy", "dz")], (F.col("p_size") / F.lit(10.0)).alias("grade"),
        (F.col("p_retailprice") / 400).cast("double").alias("density"), F.col("p_type").alias("rock_type"),
    )


def segments(spark: SparkSession, sf_dir: str, length: float = 3.0) -> DataFrame:
    """3 m segments from 0 to the last depth of every hole with intervals."""
    holes = intervals(spark, sf_dir).groupBy("hole_id").agg(F.max("to").alias("end"))
    return holes.select("hole_id", F.explode(F.sequence(F.lit(0),
        F.ceil(F.col("end") / length).cast("int") - 1)).alias("k")).select("hole_id", (F.col("k") * F.lit(length)).alias("seg_from"),
        ((F.col("k") + 1) * F.lit(length)).alias("seg_to"))
