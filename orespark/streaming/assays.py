"""Streaming: assay intervals as they arrive, normalised and checked row by row; mean grades by hole and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import interval_bounds, is_missing, number, ref, standardize, with_mid


def normalised_assays(stream: DataFrame) -> DataFrame:
    """Valid intervals under canonical names, with mid (stateless: append mode)."""
    df = with_mid(interval_bounds(standardize(stream)))
    return df.filter(~is_missing(F.col("hole_id")) & (ref("to") > ref("from")))


def windowed_grades(stream: DataFrame, value_col: str, time_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """hole_id, start, samples, length-weighted grade per window; rows later than the watermark are dropped."""
    length = ref("to") - ref("from")
    rows = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), "hole_id")
    out = rows.agg(F.count("*").alias("samples"), F.try_divide(F.sum(number(ref(value_col)) * length), F.sum(length)).alias("grade"))
    return out.select("hole_id", F.col("w.start").alias("start"), "samples", "grade")
