"""Interval algebra along a hole: intercepts, composites, overlaps, merging."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW
from ..sources.ingest import first_column, is_missing, number, ref

GAP = 1e-6
FROM_NAMES = ["from", "samp_from", "sample_from", "depth_from", "fromdepth", "from_depth"]
TO_NAMES = ["to", "samp_to", "sample_to", "depth_to", "todepth", "to_depth"]


def significant_intercepts(df: DataFrame, field: str, min_grade: float, min_length: float, from_col: str = "from", to_col: str = "to",
    hole_col: str = "hole_id", label: bool = True) -> DataFrame:
    """hole, assay_field, from, to, length, avg_grade (length-weighted), n_samples, label of runs of contiguous rows with
    grade >= min_grade; hole and bounds keep the names of their columns.

    Rows are contiguous if they start where the previous qualifying row of the hole ends. The label is "12.0 m @ 1.50 field"
    with Python's rounding (an Arrow UDF on the few result rows; label=False leaves it out).
    """
    if field not in df.columns:
        raise ValueError(f"no column {field}")
    rows = df.select(ref(hole_col).alias("hole_id"), number(ref(from_col)).alias("a"), number(ref(to_col)).alias("b"),
        number(ref(field)).alias("g")).filter((F.col("g") >= min_grade) & F.col("hole_id").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    w = Window.partitionBy("hole_id").orderBy("a", "b")
    rows = rows.withColumn("new", F.coalesce((F.abs(F.col("a") - F.lag("b").over(w)) > GAP).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.col("b") - F.col("a")
    out = rows.groupBy("hole_id", "run").agg(F.min("a").alias("from"), F.max_by("b", F.struct("a", "b")).alias("to"),
        F.try_divide(F.sum(F.col("g") * length), F.sum(length)).alias("grade"), F.count("*").alias("n_samples"))
    out = out.withColumn("length", F.col("to") - F.col("from")).filter(F.col("length") >= min_length)
    out = out.select(F.col("hole_id").alias(hole_col), F.lit(field).alias("assay_field"), F.col("from").alias(from_col),
        F.col("to").alias(to_col), "length", F.col("grade").alias("avg_grade"), "n_samples")
    if not label:
        return out

    @F.pandas_udf("string")
    def text(length: pd.Series, grade: pd.Series) -> pd.Series:
        return pd.Series([f"{a:.1f} m @ {g:.2f} {field}" for a, g in zip(length, grade, strict=True)])

    return out.withColumn("label", text("length", "avg_grade"))


#: Cells or bins that one interval may cover; more is a wrong bound, which would otherwise fill the disk.
MOST_CELLS = 1_000_000


def _few(good: Column, low: Column, high: Column) -> Column:
    """The numbers low..high where the row is good; an error where they are more than MOST_CELLS."""
    many = F.raise_error(F.concat(F.lit("an interval covers too many cells: "), (high - low).cast("string"))).cast("array<bigint>")
    return F.when(good & (high - low >= MOST_CELLS), many).when(good, F.sequence(low, high))


def composite(df: DataFrame, value_col: str, length: float, from_col: str = "from", to_col: str = "to",
    method: str = "average") -> DataFrame:
    """hole_id, from, to and the value column: fixed-length bins from each hole's first depth on; overlap-weighted average, or sum of
    value * overlap. A null value weighs, but adds nothing. Bins without overlap are left out.

    Each interval goes to its own bins by number (an explode), so bins and intervals are never joined.
    """
    if method not in ("average", "sum"):
        raise ValueError(f"unknown method: {method}")
    rows = df.select("hole_id", number(ref(from_col)).alias("a"), number(ref(to_col)).alias("b"),
        number(ref(value_col)).alias("v")).dropna(subset=["hole_id", "a", "b"])
    ends = rows.groupBy("hole_id").agg(F.min("a").alias("start"), F.max("b").alias("stop"))
    rows = rows.join(ends, "hole_id")
    bins = F.ceil((F.col("stop") + length - F.col("start")) / length)
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("a") - F.col("start")) / length) - 1)
    high = F.least(bins - 1, F.ceil((F.col("b") - F.col("start")) / length))
    rows = rows.select("*", F.explode(_few(high >= low, low, high)).alias("bin"))
    rows = rows.withColumns({"from": F.col("start") + F.col("bin") * F.lit(float(length)),
        "to": F.col("start") + (F.col("bin") + 1) * F.lit(float(length))})
    rows = rows.filter((F.col("a") < F.col("to")) & (F.col("b") > F.col("from")))
    over = F.greatest(F.lit(0.0), F.least("b", "to") - F.greatest("a", "from"))
    total = F.coalesce(F.sum(F.col("v") * over), F.lit(0.0))
    value = total if method == "sum" else F.coalesce(F.try_divide(total, F.sum(over)), F.lit(0.0))
    return rows.groupBy("hole_id", "from", "to").agg(value.alias(value_col))


def merge_numeric_categorical(numeric: DataFrame, categorical: DataFrame, on: tuple[str, ...] = ("hole_id", "from", "to")) -> DataFrame:
    """Full outer join of two interval tables on their bounds; clashing columns get _x and _y."""
    clash = (set(numeric.columns) & set(categorical.columns)) - set(on)
    a = numeric.select(*[ref(c).alias(f"{c}_x" if c in clash else c) for c in numeric.columns])
    b = categorical.select(*[ref(c).alias(f"_b_{c}" if c in on else f"{c}_y" if c in clash else c) for c in categorical.columns])
    same = F.lit(True)
    for c in on:
        same = same & ref(c).eqNullSafe(F.col(f"`_b_{c}`"))
    joined = a.join(b, same, "full_outer")
    return joined.select(*[F.coalesce(ref(c), F.col(f"`_b_{c}`")).alias(c) for c in on],
        *[ref(c) for c in [*a.columns, *b.columns] if c not in on and not c.startswith("_b_")])


def overlapping(segments: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Pairs of a segment (hole_id, seg_from, seg_to, ...) and an interval (hole_id, from, to, ...) that overlap, with overlap.

    Both are cut into depth cells of `width`; pairs meet by an equi-join on hole and cell, and count in the cell where the
    later of the two begins, so none counts twice. A hot hole spreads over its cells.
    """
    cells = lambda a, b: F.explode(_few(F.col(b) > F.col(a), F.floor(F.col(a) / width),
        F.floor(F.col(b) / width))).alias("_cell")
    s = segments.select("*", cells("seg_from", "seg_to"))
    i = intervals.select("*", cells("from", "to"))
    joined = s.join(i, ["hole_id", "_cell"])
    start = F.greatest("seg_from", "from")
    over = F.least("seg_to", "to") - start
    return joined.filter((over > 0) & (F.floor(start / width) == F.col("_cell"))).withColumn("overlap", over).drop("_cell")


def weighted_value(segments: DataFrame, intervals: DataFrame, value_col: str, width: float) -> DataFrame:
    """Segments with the overlap-weighted mean of a value (null where nothing overlaps)."""
    pairs = overlapping(segments, intervals.filter(number(ref(value_col)).isNotNull()), width)
    keys = ["hole_id", "seg_from", "seg_to"]
    means = pairs.groupBy(*keys).agg((F.sum(number(ref(value_col)) * F.col("overlap")) / F.sum("overlap")).alias("value"))
    return segments.select(*keys).distinct().join(means, keys, "left")


def dominant_category(segments: DataFrame, intervals: DataFrame, category_col: str, width: float) -> DataFrame:
    """Segments with the category of the interval that overlaps most (the first one on a tie)."""
    pairs = overlapping(segments, intervals.filter(~is_missing(ref(category_col))), width)
    keys = ["hole_id", "seg_from", "seg_to"]
    return pairs.groupBy(*keys).agg(F.max_by(ref(category_col), F.struct("overlap", -F.col("from"), -F.col("to"))).alias("category"))


def with_data(segments: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """Segments with has_data: whether any interval overlaps."""
    keys = ["hole_id", "seg_from", "seg_to"]
    hit = overlapping(segments, intervals, width).select(*keys).distinct().withColumn("_hit", F.lit(True))
    return segments.select(*keys).distinct().join(hit, keys, "left").select(*keys, F.coalesce("_hit", F.lit(False)).alias("has_data"))


def interval_points(df: DataFrame, value_col: str, drop_missing: bool = True, key_with_value: bool = False,
    allow_points: bool = False) -> DataFrame:
    """hole_id, z (middle), val, from_val, to_val, half: one row per interval of a hole, the first in source order (deeper
    ones first: order by z descending when shown).

    key_with_value: intervals with different values stay apart. allow_points: zero-length intervals stay, and rows without
    bounds are points at their depth or md.
    """
    a, b = first_column(df, FROM_NAMES), first_column(df, TO_NAMES)
    points = [number(ref(c)) for c in ("depth", "md") if c in df.columns] if allow_points else []
    if (a is None or b is None) and not points:
        raise ValueError("no interval columns")
    order = [ROW] if ROW in df.columns else sorted(c for c in df.columns if c not in ("hole_id", a, b))
    low, high = (number(ref(c)) if c else F.lit(None).cast("double") for c in (a, b))
    whole = low.isNotNull() & high.isNotNull()
    low, high = (F.when(whole, x).otherwise(F.coalesce(*points)) if points else x for x in (low, high))
    rows = df.select("hole_id", low.alias("from_val"), high.alias("to_val"), ref(value_col).alias("val"),
        *[ref(c).alias(f"_o{i}") for i, c in enumerate(order)])
    rows = rows.filter((F.col("to_val") >= F.col("from_val")) if allow_points else (F.col("to_val") > F.col("from_val")))
    if drop_missing:
        rows = rows.filter(~is_missing(F.col("val")))
    keys = ["hole_id", "from_val", "to_val", *(["val"] if key_with_value else [])]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[f"_o{i}" for i in range(len(order))]))
    rows = rows.withColumn("_n", rank).filter("_n = 1")
    return rows.select("hole_id", ((F.col("from_val") + F.col("to_val")) / 2).alias("z"), "val", "from_val", "to_val",
        ((F.col("to_val") - F.col("from_val")) / 2).alias("half"))


def comment_points(df: DataFrame, text_col: str) -> DataFrame:
    """hole_id, from, to and the text ("" where there is none): the first row of each valid interval, blanks included."""
    texts = df.withColumn(text_col, F.coalesce(ref(text_col).cast("string"), F.lit("")))
    return interval_points(texts, text_col, drop_missing=False).select("hole_id", F.col("from_val").alias("from"),
        F.col("to_val").alias("to"), F.col("val").alias(text_col))


def labelled_intervals(df: DataFrame, label_col: str) -> DataFrame:
    """Rows of a strip log: valid intervals whose label isn't missing."""
    a, b = first_column(df, FROM_NAMES), first_column(df, TO_NAMES)
    return df.filter((number(ref(b)) > number(ref(a))) & ~is_missing(ref(label_col)))


def interval_vertices(df: DataFrame, from_col: str = "from", to_col: str = "to") -> DataFrame:
    """Two rows per interval, at z = from and z = to."""
    return df.select("*", F.explode(F.array(ref(from_col), ref(to_col))).alias("z"))


def intervals_by_hole(df: DataFrame, value: Column, from_col: str = "from", to_col: str = "to") -> DataFrame:
    """hole_id, intervals: array of (from, to, value), sorted by from, the first row of equal bounds."""
    points = df.select("hole_id", number(ref(from_col)).alias("from"), number(ref(to_col)).alias("to"), value.alias("value"),
        *([ROW] if ROW in df.columns else []))
    points = points.filter((F.col("to") > F.col("from")) & F.col("value").isNotNull())
    one = points.groupBy("hole_id", "from", "to").agg(F.min_by("value", ROW if ROW in points.columns else "value").alias("value"))
    return one.groupBy("hole_id").agg(F.array_sort(F.collect_list(F.struct("from", "to", "value"))).alias("intervals"))
