"""Joins that bring a hole's attributes to its rows, by hole key (trimmed, lower case)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW
from ..sources.ingest import number, ref
from .desurvey import first_rows


def hole_key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def with_project(traces: DataFrame, collars: DataFrame) -> DataFrame:
    """traces with the project of their collar where they have none. A trace row meets every collar of its key; traces
    without a collar stay."""
    own = collars.select(hole_key(F.col("hole_id")).alias("_key"), F.col("project_id").alias("_project"))
    joined = traces.join(own, hole_key(F.col("hole_id")) == F.col("_key"), "left")
    project = F.coalesce(F.col("project_id"), F.col("_project")) if "project_id" in traces.columns else F.col("_project")
    return joined.withColumn("project_id", project).drop("_key", "_project")


def with_collar_elevation(traces: DataFrame, collars: DataFrame, z_col: str = "z") -> DataFrame:
    """traces with z raised by the elevation of their collar (of several with one key the last; 0 without a collar). Blanks
    inside a collar's id don't count."""
    order = F.col(ROW) if ROW in collars.columns else F.col("elevation")
    tops = collars.groupBy(F.replace(hole_key(F.col("hole_id")), F.lit(" "),
        F.lit("")).alias("_key")).agg(F.max_by(number(F.col("elevation")), order).alias("_top"))
    joined = traces.join(tops, hole_key(F.col("hole_id")) == F.col("_key"), "left")
    return joined.withColumn(z_col, ref(z_col) + F.coalesce("_top", F.lit(0.0))).drop("_key", "_top")


def of_holes(df: DataFrame, holes: DataFrame) -> DataFrame:
    """Rows of the given holes, under their keys (a semi-join)."""
    keys = holes.select(hole_key(F.col("hole_id")).alias("hole_id")).filter("hole_id <> ''")
    return df.withColumn("hole_id", hole_key(F.col("hole_id"))).join(keys, "hole_id", "left_semi")


def scene_assays(assays: DataFrame, holes: DataFrame, numeric: list[str]) -> DataFrame:
    """hole_id (key), from, to and the numeric properties of the holes' valid intervals."""
    rows = of_holes(assays, holes).filter(number(ref("to")) > number(ref("from")))
    return rows.select("hole_id", number(ref("from")).alias("from"), number(ref("to")).alias("to"),
        *[number(ref(c)).alias(c) for c in numeric if c in assays.columns])


def scene_structures(structures: DataFrame, holes: DataFrame) -> DataFrame:
    """hole_id (key), depth (else mid), angles and type of the holes' structures."""
    depths = [number(F.col(c)) for c in ("depth", "mid") if c in structures.columns]
    rows = of_holes(structures, holes).withColumn("depth", F.coalesce(*depths)).dropna(subset=["depth"])
    angles = [number(F.col(c)).alias(c) for c in ("dip", "azimuth", "alpha", "beta") if c in structures.columns]
    return rows.select("hole_id", "depth", *angles,
        *([F.col("structure_type").cast("string").alias("structure_type")] if "structure_type" in structures.columns else []))


def intervals_of_holes(holes: DataFrame, intervals: DataFrame, list_col: str = "intervals") -> DataFrame:
    """holes with the interval list stored under their id as it is, else under their key (null: neither). intervals:
    hole_id and an array, one row per id."""
    named = intervals.select(F.col("hole_id").alias("_id"), ref(list_col).alias("_list")).filter(F.size("_list") > 0)
    exact = holes.join(named, F.col("hole_id") == F.col("_id"), "left").withColumnsRenamed({"_list": "_exact"}).drop("_id")
    both = exact.join(named, hole_key(F.col("hole_id")) == F.col("_id"), "left")
    return both.withColumn(list_col, F.coalesce("_exact", "_list")).drop("_exact", "_list", "_id")


def project_holes(collars: DataFrame) -> DataFrame:
    """First collar row of each hole key."""
    return first_rows(collars.withColumn("hole_id", hole_key(F.col("hole_id"))), "hole_id")
