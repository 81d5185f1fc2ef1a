"""Tables that plots and 3-D scenes consume."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.scale import ranked
from ..model import ROW
from ..sources.ingest import number, ref


# Zoom from which each detail level of a photo is shown.
LODS = ((0.0, "thumb"), (4.0, "mid"), (7.0, "full"))


def trace_segments(traces: DataFrame, color_by: str | None = None) -> DataFrame:
    """hole_id, points: array of (md, easting, northing, elevation[, color]) in order of md."""
    fields = ["md", "easting", "northing", "elevation"]
    point = F.struct(*fields, *([ref(color_by).alias("color")] if color_by else []))
    return traces.groupBy("hole_id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def hole_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def scene_holes(traces: DataFrame, max_holes: int = 100) -> DataFrame:
    """Trace points of the first holes by key: the scene's limit is its feature."""
    keyed = traces.withColumn("hole_id", hole_key(F.col("hole_id"))).filter("hole_id is not null and hole_id <> ''")
    first = keyed.select("hole_id").distinct().orderBy("hole_id").limit(max_holes)
    return trace_segments(keyed.join(first, "hole_id", "left_semi"))


def tubes(intervals: DataFrame, radius: float = 1.0, color_by: str | None = None) -> DataFrame:
    return intervals.select("hole_id", "from", "to", F.lit(radius).alias("radius"),
        (ref(color_by) if color_by else F.lit(None).cast("string")).alias("color"))


def annotations(intervals: DataFrame, label_col: str) -> DataFrame:
    return intervals.select("hole_id", ((ref("from") + ref("to")) / 2).alias("depth"), ref(label_col).cast("string").alias("label"))


def discs(structures: DataFrame, radius: float = 5.0, color_by: str = "defect") -> DataFrame:
    """Centre, normal, dip, azimuth and colour value of each placed structure."""
    from ..operators.structural import plane_normal

    dip, azimuth = number(F.col("dip")), number(F.col("azimuth"))
    n = plane_normal(dip, azimuth)
    rows = structures.dropna(subset=["easting", "northing", "elevation"]).filter(dip.isNotNull() & azimuth.isNotNull())
    return rows.select("hole_id", "easting", "northing", "elevation", *[c.alias(f"normal_{a}") for c, a in zip(n, "xyz", strict=True)],
        "dip", "azimuth", F.lit(radius).alias("radius"),
        (ref(color_by) if color_by in structures.columns else F.lit(None)).cast("string").alias("color_value"))


def depth_markers(ranges: DataFrame, interval: float) -> DataFrame:
    """hole_id, depth: multiples of the interval from lo to hi (columns of ranges)."""
    low, high = F.ceil(F.col("lo") / interval), F.floor(F.col("hi") / interval)
    return ranges.select("hole_id", F.explode(F.when(high >= low, F.sequence(low, high))).alias("_k")).select("hole_id",
        (F.col("_k") * F.lit(float(interval))).alias("depth"))


def photo_url(lods: Column, zoom: Column, fallback: Column, breakpoints: tuple[tuple[float, str], ...] = LODS) -> Column:
    """URL of the last detail level whose zoom is reached (the first one below all), else the photo's own, else ""."""
    wanted = F.lit(breakpoints[0][1])
    for least, name in breakpoints:
        wanted = F.when(zoom >= least, F.lit(name)).otherwise(wanted)
    return F.coalesce(F.nullif(F.try_element_at(lods, wanted), F.lit("")), F.nullif(fallback, F.lit("")), F.lit(""))


def photo_pixels(length: Column, zoom: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length * 50 * zoom / 5 + 0.5).cast("int"))


def photos_in_range(photos: DataFrame, low: float, high: float) -> DataFrame:
    """Photos that overlap a depth range, by set (blank: default) and depth."""
    named = with_set(photos)
    return named.filter((F.col("from_depth") < high) & (F.col("to_depth") > low)).orderBy("photo_set", F.coalesce("from_depth", F.lit(0.0)))


def tray_photos(trays: DataFrame, base_url: str, name: str | Callable[[Column], Column] = "tray_%03d.jpg") -> DataFrame:
    """image_url of each tray number under a base URL; name: the format of its file name, or what makes one of the number."""
    number_of = F.col("tray").cast("int")
    file = name(number_of) if callable(name) else F.format_string(name, number_of)
    return trays.withColumn("image_url", F.concat(F.lit(base_url.rstrip("/") + "/"), file))


def wrapped(text: Column, width: int = 40) -> Column:
    """Words in lines of at most `width` characters, joined by <br>."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, w: Column) -> Column:
        fits = (acc["n"] > 0) & (acc["n"] + 1 + F.length(w) <= width)
        return F.struct(F.when(acc["n"] == 0, w).when(fits,
            F.concat(acc["out"], F.lit(" "), w)).otherwise(F.concat(acc["out"], F.lit("<br>"), w)).alias("out"),
            F.when(fits, acc["n"] + 1 + F.length(w)).otherwise(F.length(w)).alias("n"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def collar_extent(collars: DataFrame) -> DataFrame:
    """One row: bounds and median centre of collars in degrees."""
    lat, lon = number(F.col("latitude")), number(F.col("longitude"))
    return collars.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"),
        F.median(lat).alias("lat"), F.median(lon).alias("lon"))


def with_set(photos: DataFrame) -> DataFrame:
    """photo_set as text, blank ones "default"."""
    return photos.withColumn("photo_set", F.coalesce(F.nullif(F.col("photo_set").cast("string"), F.lit("")), F.lit("default")))


def photos_by_set(photos: DataFrame) -> DataFrame:
    """photo_set, first_row (sets appear in its order), photos: the set's photos by depth (a missing depth is 0), then source order.
    A set is one row: for sets of bounded size; see photo_chunks."""
    photo = F.struct(F.coalesce(number(F.col("from_depth")), F.lit(0.0)).alias("at"), F.col(ROW),
        *[ref(c) for c in photos.columns if c not in ("photo_set", ROW)])
    return with_set(photos).groupBy("photo_set").agg(F.min(ROW).alias("first_row"), F.array_sort(F.collect_list(photo)).alias("photos"))


def chunked(df: DataFrame, group_cols: list[str], order: list[str], columns: list[str], size: int = 1000) -> DataFrame:
    """group_cols, chunk, n, rows: each group's rows in order, as arrays of at most `size` rows numbered from 0.

    Groups of up to scale.PER_RANGE rows are numbered each in a task, in the only shuffle. Rows of larger ones are numbered in the order
    of group and order by ranges (see scale.ranked), so a group of any size is dealt to many tasks; no array grows with its group. Rows that
    are equal in the order come in any order.
    """
    groups = [*map(ref, group_cols)]
    key, row = F.struct(*map(ref, [*group_cols, *order])), F.struct(*map(ref, dict.fromkeys([*order, *columns])))
    rows = df.select(*groups, key.alias("_key"), row.alias("_row"))
    small = lambda some: some.withColumn("_at", F.row_number().over(Window.partitionBy(*groups).orderBy("_key")) - 1)
    same = lambda: reduce(lambda a, b: a & b, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in group_cols])
    large = _large_groups(df, group_cols)
    if large is None:
        parts = [small(rows)]
    else:
        many = ranked(rows.alias("r").join(F.broadcast(large.alias("s")), same(), "left_semi"), "_key")
        starts = many.groupBy(*groups).agg(F.min("_stop").alias("_first"))
        placed = many.alias("r").join(F.broadcast(starts.alias("s")), same()).select("r.*", (F.col("_stop") - F.col("_first")).alias("_at"))
        parts = [small(rows.alias("r").join(F.broadcast(large.alias("s")), same(), "left_anti")), placed]

    def arrays(some: DataFrame) -> DataFrame:
        out = some.groupBy(*groups, F.floor(F.col("_at") / size).cast("int").alias("chunk"))
        out = out.agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_all"))
        return out.select(*groups, "chunk", F.size("_all").alias("n"), F.col("_all._row").alias("rows"))

    return reduce(DataFrame.unionByName, map(arrays, parts))


#: Hashes by which groups are counted together.
COUNTED = 1 << 16


def _large_groups(df: DataFrame, group_cols: list[str]) -> DataFrame | None:
    """The groups with more than scale.PER_RANGE rows, known before the plan is made, or None: hashes are counted first, then the groups
    of those that have so many rows."""
    groups, most = [*map(ref, group_cols)], scale.PER_RANGE
    hashed = df.select(*groups).withColumn("_hash", F.pmod(F.xxhash64(*groups), F.lit(COUNTED)))
    over = [r["_hash"] for r in hashed.groupBy("_hash").count().filter(F.col("count") > most).collect()]
    kept = hashed if len(over) == COUNTED else hashed.filter(F.col("_hash").isin(over))
    found = kept.groupBy(*groups).count().filter(F.col("count") > most).select(*groups).collect() if over else []
    return df.sparkSession.createDataFrame(found, df.select(*groups).schema) if found else None


def photo_chunks(photos: DataFrame, size: int = 1000) -> DataFrame:
    """photo_set, chunk, n, rows: the photos of photos_by_set in arrays of at most `size`."""
    rows = with_set(photos).withColumn("at", F.coalesce(number(F.col("from_depth")), F.lit(0.0)))
    return chunked(rows, ["photo_set"], ["at", ROW], [c for c in photos.columns if c not in ("photo_set", ROW)], size)


def rows_by_hole(df: DataFrame, columns: list[str], order: list[str], hole_col: str = "hole_id") -> DataFrame:
    """hole_id, rows: each hole's rows (trimmed id, blank ones go) as an array sorted by `order`, which comes first in a row. A hole is
    one row; see row_chunks."""
    row = F.struct(*map(ref, dict.fromkeys([*order, *columns])))
    keyed = df.withColumn("hole_id", F.trim(ref(hole_col).cast("string"))).filter("hole_id <> ''")
    return keyed.groupBy("hole_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def row_chunks(df: DataFrame, columns: list[str], order: list[str], hole_col: str = "hole_id", size: int = 1000) -> DataFrame:
    """hole_id, chunk, n, rows: the rows of rows_by_hole in arrays of at most `size`."""
    keyed = df.withColumn("hole_id", F.trim(ref(hole_col).cast("string"))).filter("hole_id <> ''")
    return chunked(keyed, ["hole_id"], order, columns, size)


def merge_holes(one: DataFrame, two: DataFrame, rows_col: str = "rows") -> DataFrame:
    """hole_id, rows: the rows of both tables of holes, those of the first before those of the second."""
    right = two.select(F.col("hole_id").alias("_h"), ref(rows_col).alias("_more"))
    none = F.array().cast(one.schema[rows_col].dataType)
    return one.join(right, F.col("hole_id") == F.col("_h"), "full_outer").select(F.coalesce("hole_id", "_h").alias("hole_id"),
        F.concat(F.coalesce(ref(rows_col), none), F.coalesce("_more", none)).alias(rows_col))


def centroid(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mean of each column."""
    return df.agg(*[F.avg(number(ref(c))).alias(c) for c in columns])


def scene_bounds(df: DataFrame, columns: tuple[str, ...] = ("easting", "northing", "elevation")) -> DataFrame:
    """One row: min and max of each axis."""
    return df.agg(*[f(number(ref(c))).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def finite_values(df: DataFrame, value_col: str) -> DataFrame:
    """hole_id, value: the finite values of all intervals."""
    return df.select("hole_id", number(ref(value_col)).alias("value")).dropna(subset=["value"])


def map_points(collars: DataFrame, color_by: str | None = None) -> DataFrame:
    """collars, with color_value where there is a column to colour by."""
    return collars.withColumn("color_value", ref(color_by)) if color_by in collars.columns else collars


def depth_range(md1: Column, md2: Column) -> tuple[Column, Column]:
    """Measured-depth range of a segment, in order; nulls where it has no length."""
    good = F.abs(md1 - md2) > 0
    return F.when(good, F.least(md1, md2)), F.when(good, F.greatest(md1, md2))


def trace_pairs(traces: DataFrame) -> DataFrame:
    """hole_id, segment, seg_from, seg_to: consecutive vertices of each hole that have a depth range."""
    w = Window.partitionBy("hole_id").orderBy("md", *([ROW] if ROW in traces.columns else []))
    low, high = depth_range(number(F.col("md")), F.lead(number(F.col("md"))).over(w))
    return traces.select("hole_id", (F.row_number().over(w) - 1).alias("segment"), low.alias("seg_from"),
        high.alias("seg_to")).dropna(subset=["seg_from"])


def normalized_bounds(df: DataFrame) -> DataFrame:
    """min_x, min_y, max_x, max_y from the same columns, or from x, y, width, height (missing ones 0); a box without a positive
    size fails the query when it is read."""
    if "width" in df.columns or "height" in df.columns or ("x" in df.columns and "max_x" not in df.columns):
        x, y, width, height = (F.coalesce(number(F.col(c)), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in ("x", "y", "width",
            "height"))
        box = {"min_x": x, "min_y": y, "max_x": x + width, "max_y": y + height}
    else:
        box = {c: number(F.col(c)) for c in ("min_x", "min_y", "max_x", "max_y")}
    out = df.withColumns(box)
    wrong = F.raise_error(F.concat(F.lit("bounds without a positive size: "), F.to_json(F.struct(*box)))).cast("double")
    for a in "xy":
        out = out.withColumn(f"max_{a}", F.when(F.col(f"max_{a}") - F.col(f"min_{a}") <= 0, wrong).otherwise(F.col(f"max_{a}")))
    return out


def search_holes(collars: DataFrame, text: str) -> DataFrame:
    """Collars whose hole id holds the pattern, whatever the case; all for a blank one."""
    wanted = text.strip().lower()
    return collars.filter(F.lower("hole_id").rlike(wanted)) if wanted else collars


def focused_holes(holes: DataFrame, focus: str = "", order: str = "hole_id", most: int | None = None) -> DataFrame:
    """hole_id, place: the focused hole first, then the others in their order (the first `most`: as many plots as a grid has)."""
    rank = F.when(F.col("hole_id") == focus, 0).otherwise(1)
    placed = holes.select("hole_id", rank.alias("_r"), ref(order).alias("_o")).orderBy("_r", "_o")
    if most is None:
        return placed.select("hole_id")
    first = placed.limit(most).agg(F.array_sort(F.collect_list(F.struct("_r", "_o", "hole_id"))).alias("a"))  # a grid of plots
    return first.select(F.posexplode("a").alias("place", "h")).select("h.hole_id", "place")


def hole_options(df: DataFrame, placed: bool = False) -> DataFrame:
    """Distinct non-empty hole ids, sorted; placed: not sorted, but with their place (from 1) in that order, by ranges of ids."""
    holes = df.select(F.col("hole_id").cast("string").alias("hole_id")).filter("hole_id <> ''").distinct()
    if placed:
        return ranked(holes, "hole_id").select("hole_id", F.col("_stop").cast("int").alias("place"))
    return holes.orderBy("hole_id")


def union_holes(*tables: DataFrame) -> DataFrame:
    """Hole ids of any of the tables, once each."""
    return reduce(DataFrame.unionByName, [t.select("hole_id") for t in tables]).dropna().distinct()


def common_holes(one: DataFrame, two: DataFrame) -> DataFrame:
    """hole_id: keys (trimmed, lower case) that both tables have."""
    return one.select(hole_key(F.col("hole_id")).alias("hole_id")).intersect(two.select(hole_key(F.col("hole_id")).alias("hole_id")))
