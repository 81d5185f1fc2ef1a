"""What leaves the engine: traces as CSV, corrected traces, and payloads as JSON."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projection import with_utm
from .ingest import number, ref


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="orespark-")
    SHARED.append(path := f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path


#: Paths that this driver has given out and not cleared.
SHARED: list[str] = []


def clear_shared(spark: SparkSession, *only: str) -> int:
    """Delete what was written to all paths of shared_path() so far, or to some of them only, once the results that read them are
    stored; how many."""
    jvm, paths = spark.sparkContext._jvm, [p for p in SHARED if not only or p in only]
    for path in paths:
        SHARED.remove(path)
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what a write has shuffled is deleted as soon as the write is done, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def export_rows(traces: DataFrame, zone: int, south: bool = True) -> DataFrame:
    """hole_id, company_hole_id, project, order, md, x, y, z of holes with at least two points: degrees projected to UTM metres
    about the mean of the collars, z raised by the collar's elevation.

    traces: hole_id, company_hole_id, project, md, lat, lng, z, collar_lat, collar_lng, collar_elevation.
    """
    named = traces.withColumn("company_hole_id", F.coalesce(F.trim(F.col("company_hole_id").cast("string")), F.lit("")))
    placed = with_utm(named.withColumnsRenamed({"lat": "latitude", "lng": "longitude"}), zone, south=south)
    tops = with_utm(traces.select("hole_id", F.col("collar_lat").alias("latitude"), F.col("collar_lng").alias("longitude")).distinct(),
        zone, south=south)
    middle = tops.agg(F.avg("easting").alias("_cx"), F.avg("northing").alias("_cy"))  # one row
    rows = placed.join(F.broadcast(middle)).withColumns({"x": F.col("easting") - F.col("_cx"), "y": F.col("northing") - F.col("_cy"),
        "z": F.col("z") + F.coalesce(number(F.col("collar_elevation")), F.lit(0.0))})
    rows = rows.dropna(subset=["x", "y", "z"])
    w = Window.partitionBy("hole_id")
    rows = rows.withColumns({"_n": F.count("*").over(w), "order": F.row_number().over(w.orderBy("md")) - 1}).filter("_n >= 2")
    name = F.coalesce(F.nullif("company_hole_id", F.lit("")), F.col("hole_id").cast("string"))
    return rows.select(name.alias("hole_id"), "company_hole_id", F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"),
        "order", "md", "x", "y", "z")


def write_csv(df: DataFrame, path: str) -> str:
    """df as CSV files with a header, one per partition; text is quoted where it must be."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """df as JSON lines."""
    df.write.json(path)
    return path


def json_payload(df: DataFrame, key: str) -> DataFrame:
    """key, payload: each row as a JSON text, for pages that embed it."""
    return df.select(ref(key), F.to_json(F.struct(*map(ref, df.columns))).alias("payload"))
