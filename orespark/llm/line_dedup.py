"""Line dedup by site-relative frequency (native expressions only).

A line is boilerplate of a host if at least min_pages of the host's documents have it and they are more than `ratio` of
them all. A host has at most (mean distinct lines per document) / ratio such lines, whatever its size, so the
list per host is short; documents are joined with it on host (broadcast only while the written list is
small, which Spark reads off its files; else a shuffle join, whose hot hosts AQE splits).
Lines are told apart by two 64-bit hashes, so that counting moves 16 bytes a line instead of its text.

A document that has no other lines is left whole (a repeated page: the near-duplicate operators' matter), unless
spare_whole=False; min_pages=1 takes every line beyond the ratio, on hosts of any size.
Blank lines are never counted or dropped; a null text stays null; a null host is a host of its own. A line
that repeats within a document counts once and is dropped at every place. Repeated rows count as
documents of their own. Extra columns stay as they are, whatever their names (n_lines and n_dropped are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hidden, written

RATIO = 0.08
MIN_PAGES = 5


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _is_text(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != ""


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO,
    min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines: array of the keys of its boilerplate lines."""
    hosts = docs.select(F.col(f"`{host_col}`").cast("string").alias("_host"), F.col(f"`{text_col}`").alias("_text"))
    totals = hosts.groupBy("_host").agg(F.count("*").alias("pages"))
    lines = hosts.select("_host", F.explode(F.array_distinct(F.transform(F.filter(F.split("_text", "\n", -1), _is_text),
        _key))).alias("line"))
    counts = lines.groupBy("_host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    common = counts.join(totals.withColumnRenamed("_host", "_h"),
        F.col("_host").eqNullSafe(F.col("_h"))).filter(F.col("n") > F.col("pages") * F.lit(ratio))
    return common.groupBy(F.col("_host").alias("_boiler_host")).agg(F.collect_list("line").alias("_boiler"))


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    spare_whole: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, and n_lines and n_dropped."""
    host, drops, kept_col = hidden(docs, "_boiler_host", "_boiler", "_kept")
    boiler = written(boilerplate_lines(docs, host_col, text_col, ratio, min_pages), "boilerplate").toDF(host, drops)
    joined = docs.join(boiler, F.col(f"`{host_col}`").cast("string").eqNullSafe(F.col(host)), "left")
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n", -1)
    drop = F.coalesce(F.col(drops), F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.filter(lines, lambda x: ~(F.array_contains(drop, _key(x)) & _is_text(x)))
    joined = joined.withColumn(kept_col, F.when(text.isNotNull() & F.col(drops).isNotNull(), kept))
    other = F.exists(kept_col, _is_text) if spare_whole else F.col(kept_col).isNotNull()
    joined = joined.withColumn(kept_col, F.when(other, F.col(kept_col)).when(text.isNotNull(), lines))
    return joined.select(
        *[F.array_join(kept_col, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines",
        "n_dropped")],
        F.coalesce(F.size(F.when(text.isNotNull(), lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(text.isNotNull(), lines)) - F.size(kept_col), F.lit(0)).cast("long").alias("n_dropped"),
    )
