"""Queries over the derived drillhole and block tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colours, projection, scale
from ..operators import asof, blockmodel, columns, desurvey, intervals, structural, validate
from ..operators.pivot import long_to_wide
from ..sources import ingest, loaders
from . import fixtures as fx
from . import payload

STEP = 5.0
WIDTH = 4.0
Query = Callable[[SparkSession, str], DataFrame]


XYZ = ("easting", "northing", "elevation")
#: Millions of metres: millimetres are what two engines agree on.
COARSE = {*XYZ, "x0", "y0", "x1", "y1", "tick_x", "tick_y", "along", "across"}


def r6(c: Column | str) -> Column:
    """To 6 decimals (3 for coordinates), without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 3 if isinstance(c, str) and c in COARSE else 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def significant_intercepts(s: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.significant_intercepts(fx.intervals(s, d), "au_ppm", 3.0, 2.0), "from", "to", "length", "avg_grade")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Intercepts placed on the traces and kept near a section."""
    found = intervals.significant_intercepts(fx.intervals(s, d), "au_ppm", 3.0, 2.0, label=False).withColumn("mid",
        (F.col("from") + F.col("to")) / 2)
    placed = asof.nearest_on_pairs(found, pairs(s, d), "mid", list(XYZ)).dropna(subset=["easting"])
    near = structural.section_view(placed, (502500.0, 6900000.0), 45.0, 2000.0)
    return rounded(near.select("hole_id", "from", "to", F.col("avg_grade").alias("grade"), *XYZ, "along", "across"), "grade", *XYZ, "along",
        "across")


def traces(s: SparkSession, d: str, method: str = "minimum_curvature") -> DataFrame:
    return desurvey.desurvey_holes(fx.collars(s, d), fx.surveys(s, d), STEP, method)


def pairs(s: SparkSession, d: str) -> DataFrame:
    return desurvey.station_pairs(fx.collars(s, d), fx.surveys(s, d), STEP)


def station_vertices(s: SparkSession, d: str) -> DataFrame:
    """Traces with vertices at the stations only: between them positions are linear."""
    return desurvey.desurvey_holes(fx.collars(s, d), fx.surveys(s, d), 1e9)


def _traced(method: str) -> Query:
    return lambda s, d: rounded(traces(s, d, method), "md", *XYZ, "azimuth", "dip")


def station_traces(s: SparkSession, d: str) -> DataFrame:
    tops = fx.collars(s, d).select("hole_id", (F.lit(-30.0) + (F.col("northing") - 6900000.0) / 1e6).alias("latitude"),
        (F.lit(118.0) + (F.col("easting") - 500000.0) / 1e6).alias("longitude"))
    return rounded(desurvey.station_traces(tops, fx.surveys(s, d)), "md", "x", "y", "z", "lat", "lng")


def attach_assay_positions(s: SparkSession, d: str) -> DataFrame:
    out = asof.nearest_on_pairs(ingest.with_mid(fx.intervals(s, d)), pairs(s, d), "mid")
    return rounded(out.select("hole_id", "from", "to", "mid", "md", *XYZ), "md", *XYZ)


def attach_structure_positions(s: SparkSession, d: str) -> DataFrame:
    return rounded(asof.attach_structure_positions(fx.structures(s, d), traces(s, d)).select("event_id", "hole_id", "depth", *XYZ), *XYZ)


def interpolate_positions(s: SparkSession, d: str) -> DataFrame:
    return rounded(asof.interpolate_positions(fx.structures(s, d), station_vertices(s, d)).select("event_id", "hole_id", "depth", *XYZ), *XYZ)


def resample_trace(s: SparkSession, d: str) -> DataFrame:
    return rounded(asof.resample_trace(station_vertices(s, d), 7.0), "md", *XYZ)


def join_assays_to_traces(s: SparkSession, d: str) -> DataFrame:
    a = fx.intervals(s, d).withColumn("md", F.col("from") / 2 * 25)
    t = fx.surveys(s, d).select("hole_id", F.col("depth").alias("md"), "azimuth", F.col("dip").alias("au_ppm"))
    return rounded(asof.join_assays_to_traces(a, t, ["hole_id", "md"]).select("hole_id", "md", "au_ppm", "azimuth", "au_ppm_trace"),
        "au_ppm", "azimuth", "au_ppm_trace")


def _composited(method: str) -> Query:
    return lambda s, d: rounded(intervals.composite(fx.intervals(s, d), "au_ppm", 3.0, method=method).withColumnRenamed("au_ppm", "value"),
        "from", "to", "value")


def overlap_weighted_value(s: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.weighted_value(fx.segments(s, d), fx.intervals(s, d), "au_ppm", WIDTH), "value")


def dominant_category(s: SparkSession, d: str) -> DataFrame:
    return intervals.dominant_category(fx.segments(s, d), fx.intervals(s, d), "geology_code", WIDTH)


def has_data_segments(s: SparkSession, d: str) -> DataFrame:
    return intervals.with_data(fx.segments(s, d), fx.intervals(s, d), WIDTH)


def merge_numeric_categorical(s: SparkSession, d: str) -> DataFrame:
    i = fx.intervals(s, d)
    return rounded(intervals.merge_numeric_categorical(i.filter("au_ppm >= 5").select("hole_id", "from", "to", "au_ppm"),
        i.filter("geology_code <> 'N'").select("hole_id", "from", "to", "geology_code")), "au_ppm")


def flatten_long_assays(s: SparkSession, d: str) -> DataFrame:
    i = fx.intervals(s, d)
    long = i.select("hole_id", "from", "to", F.explode(F.array(F.struct(F.lit("au_ppm").alias("assay_code"),
        F.col("au_ppm").alias("assay_value")), F.struct(F.lit("au_ppb").alias("assay_code"),
        (F.col("au_ppm") * 1000).alias("assay_value")))).alias("p")).select("hole_id", "from", "to", "p.*")
    return rounded(long_to_wide(long, "assay_code", "assay_value", ["au_ppb", "au_ppm"]), "au_ppb", "au_ppm")


def block_volume_by_class(s: SparkSession, d: str) -> DataFrame:
    return rounded(fx.blocks(s, d).groupBy("rock_type").agg(F.sum(F.col("dx") * F.col("dy") * F.col("dz")).alias("volume"),
        F.stddev_samp("grade").alias("grade_std")), "volume", "grade_std")


def filtered_volume(s: SparkSession, d: str) -> DataFrame:
    return blockmodel.volume(fx.blocks(s, d), {"grade": {"gte": 1.0, "lt": 4.0}, "rock_type": {"ne": "nothing"}})


def attribute_stats_numeric(s: SparkSession, d: str) -> DataFrame:
    return rounded(blockmodel.numeric_stats(fx.blocks(s, d), "grade", {"density": {"gt": 2.5}}), "min", "max", "mean", "std", "sum")


def attribute_stats_categorical(s: SparkSession, d: str) -> DataFrame:
    return blockmodel.category_counts(fx.blocks(s, d), "rock_type")


def block_bbox(s: SparkSession, d: str) -> DataFrame:
    return blockmodel.bounding_box(fx.blocks(s, d))


def block_size_stats(s: SparkSession, d: str) -> DataFrame:
    return blockmodel.size_stats(fx.blocks(s, d))


def _wide(s: SparkSession, d: str) -> DataFrame:
    """Blocks of which every seventh is larger, so that some overlap."""
    size = F.when(F.col("block_id") % 7 == 0, 15.0).otherwise(10.0)
    return fx.blocks(s, d).withColumns({c: size for c in ("dx", "dy", "dz")})


def _hollow(s: SparkSession, d: str) -> DataFrame:
    """Blocks of which every eleventh lies far off, so that the grid has cavities."""
    return fx.blocks(s, d).withColumn("x", F.when(F.col("block_id") % 11 == 0, F.col("x") + 1000.0).otherwise(F.col("x")))


def block_overlaps(s: SparkSession, d: str) -> DataFrame:
    return blockmodel.overlaps(_wide(s, d), "block_id")


def exterior_faces(s: SparkSession, d: str) -> DataFrame:
    return blockmodel.exterior_faces(_hollow(s, d), "block_id")


def validate_block_sizes(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_block_sizes(_wide(s, d), {"dx": 20.0, "dy": 45.0, "dz": None}, "block_id")


def validate_blocks_in_bbox(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_blocks_in_bbox(_wide(s, d),
        {"min_x": 0.0, "max_x": 190.0, "min_y": 0.0, "max_y": 200.0, "min_z": 0.0, "max_z": 1e9}, "block_id")


def _shifted(s: SparkSession, d: str) -> DataFrame:
    """Intervals of which some start too early, end where they start, or have no start."""
    k = F.substring("hole_id", 3, 20).cast("long") + (F.col("to") / 2).cast("long")
    return fx.intervals(s, d).withColumn("from", F.when(k % 97 == 0, F.lit(None)).when(k % 53 == 0, F.col("to")).when(k % 7 == 0,
        F.col("from") - 0.5).otherwise(F.col("from")))


def validate_intervals(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_intervals(_shifted(s, d))


def overlapping_intervals(s: SparkSession, d: str) -> DataFrame:
    return validate.overlapping_intervals(_shifted(s, d).dropna(subset=["from"])).select("hole_id", "from", "to")


def validate_surveys(s: SparkSession, d: str) -> DataFrame:
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("depth"))
    return validate.validate_surveys(lines.withColumnRenamed("l_orderkey", "hole_id"), depth_col="depth", order_col="l_linenumber")


def _bent(s: SparkSession, d: str) -> DataFrame:
    return fx.structures(s, d).withColumns({"dip": F.col("dip") * 1.05,
        "azimuth": F.when(F.col("event_id") % 50 == 0, 360.0).otherwise(F.col("azimuth")),
        "depth": F.when(F.col("event_id") % 31 == 0, F.lit(None)).otherwise(F.col("depth"))})


def validate_structural_points(s: SparkSession, d: str) -> DataFrame:
    return validate.validate_structural_points(_bent(s, d))


def plane_normals(s: SparkSession, d: str) -> DataFrame:
    out = structural.with_plane_geometry(fx.structures(s, d)).select("event_id", "normal_x", "normal_y", "normal_z", "strike", "pole_trend",
        "pole_plunge")
    return rounded(out, "normal_x", "normal_y", "normal_z", "strike", "pole_trend", "pole_plunge")


def normalized_angles(s: SparkSession, d: str) -> DataFrame:
    return rounded(structural.normalize_dip_azimuth(_bent(s, d).withColumn("azimuth", F.col("azimuth") - 90)).select("event_id", "dip",
        "azimuth"), "dip", "azimuth")


def tadpole_tails(s: SparkSession, d: str) -> DataFrame:
    return rounded(structural.tadpole_tails(fx.structures(s, d)).select("event_id", "tail_x", "tail_y"), "tail_x", "tail_y")


def strike_dip_symbols(s: SparkSession, d: str) -> DataFrame:
    marks = ("x0", "y0", "x1", "y1", "tick_x", "tick_y")
    placed = fx.structures(s, d).join(fx.collars(s, d).select("hole_id", "easting", "northing"), "hole_id")
    return rounded(structural.strike_dip_symbols(placed).select("event_id", *marks), *marks)


def alpha_beta_normals(s: SparkSession, d: str) -> DataFrame:
    hole = desurvey.direction(F.lit(30.0), F.lit(-60.0))
    rows = fx.structures(s, d).withColumns({"alpha": F.col("dip") * (90 / 91), "beta": F.col("azimuth")})
    return rounded(structural.alpha_beta_normals(rows, hole).select("event_id", "normal_x", "normal_y", "normal_z"), "normal_x", "normal_y",
        "normal_z")


def section_view(s: SparkSession, d: str) -> DataFrame:
    return rounded(structural.section_view(fx.collars(s, d), (502500.0, 6900000.0), 45.0, 500.0).select("hole_id", "along", "across"),
        "along", "across")


def plan_view(s: SparkSession, d: str) -> DataFrame:
    return structural.plan_view(fx.collars(s, d), (320.0, 310.0), "project_id", "elevation").select("hole_id", "elevation", "color_value")


def interval_points(s: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.interval_points(fx.intervals(s, d), "au_ppm"), "val")


def interval_vertices(s: SparkSession, d: str) -> DataFrame:
    return intervals.interval_vertices(fx.intervals(s, d)).select("hole_id", "from", "to", "z")


def labelled_intervals(s: SparkSession, d: str) -> DataFrame:
    return intervals.labelled_intervals(_shifted(s, d).withColumn("geology_code",
        F.when(F.col("geology_code") == "A", " NaN ").otherwise(F.col("geology_code"))), "geology_code").select("hole_id", "from", "to",
        "geology_code")


def unified_dataset(s: SparkSession, d: str) -> DataFrame:
    out = loaders.unified(ingest.with_mid(fx.intervals(s, d)), fx.structures(s, d).select("hole_id", "depth", "dip", "azimuth"))
    return rounded(out.select("hole_id", "from", "to", "mid", "depth", "au_ppm", "dip", "azimuth", "_source").withColumnRenamed("_source",
        "data_source"), "from", "to", "mid", "depth", "au_ppm")


def quantile_colour_bins(s: SparkSession, d: str) -> DataFrame:
    return rounded(scale.quantile_bins(fx.structures(s, d), "depth", 10), "lo", "hi")


def binned_values(s: SparkSession, d: str) -> DataFrame:
    edges = [(0.0, 2.0), (2.0, 5.0), (5.0, 8.0)]
    return fx.intervals(s, d).select("hole_id", "from", scale.bin_index(F.col("au_ppm"), edges).alias("bin"),
        scale.equal_width_index(F.col("au_ppm"), 0.0, 10.0, 4).alias("width_bin"))


def depth_markers(s: SparkSession, d: str) -> DataFrame:
    ranges = fx.intervals(s, d).groupBy("hole_id").agg(F.min("from").alias("lo"), F.max("to").alias("hi"))
    return payload.depth_markers(ranges, 5.0)


def holes_with_assays(s: SparkSession, d: str) -> DataFrame:
    i = fx.intervals(s, d).select("hole_id", "from", "to", F.when(F.col("au_ppm") > 9, F.col("au_ppm")).alias("au_ppm"))
    return loaders.hole_ids(i, True, columns.NO_VALUES)


def hole_properties(s: SparkSession, d: str) -> DataFrame:
    i = fx.intervals(s, d).select("hole_id", F.when(F.col("au_ppm") > 9, F.col("au_ppm")).alias("au_ppm"),
        F.when(F.col("geology_code") == "R", F.col("geology_code")).alias("geology_code"))
    return columns.hole_properties(i, ["au_ppm", "geology_code"]).select("hole_id", F.array_join("properties", ",").alias("properties"))


def trace_segments(s: SparkSession, d: str) -> DataFrame:
    pieces = payload.trace_segments(fx.surveys(s, d).join(fx.collars(s, d), "hole_id").withColumnRenamed("depth", "md"))
    return pieces.select("hole_id", F.array_join(F.transform("points", lambda p: p["md"].cast("long").cast("string")), ",").alias("mds"))


def intervals_by_hole(s: SparkSession, d: str) -> DataFrame:
    out = intervals.intervals_by_hole(fx.intervals(s, d), F.col("geology_code"))
    return out.select("hole_id", F.array_join(F.transform("intervals",
        lambda p: F.concat(p["from"].cast("long").cast("string"), F.lit(":"), p["value"])), ",").alias("intervals"))


def structure_discs(s: SparkSession, d: str) -> DataFrame:
    placed = asof.attach_structure_positions(fx.structures(s, d), traces(s, d))
    return rounded(payload.discs(placed, color_by="structure_type").drop("radius"), *XYZ, "normal_x", "normal_y", "normal_z")


def category_colours(s: SparkSession, d: str) -> DataFrame:
    names = fx.blocks(s, d).select("rock_type").distinct()
    return names.select("rock_type", r6(colours.seeded_unit(F.col("rock_type"))).alias("unit"),
        colours.colour(F.lower(F.substring("rock_type", 1, 2)), {"ST": "#111111", "pr": "#222222"}, "#999999").alias("colour"))


def wrapped_comments(s: SparkSession, d: str) -> DataFrame:
    """Whole texts of turns wrapped as log comments."""
    words = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", payload.wrapped(F.col("text"), 30).alias("wrapped"))
    return words.select("conv_id", "turn", F.size(F.split("wrapped", "<br>")).cast("long").alias("n_lines"),
        F.sha2("wrapped", 256).alias("digest"))


def collar_extent(s: SparkSession, d: str) -> DataFrame:
    tops = fx.collars(s, d).select((F.col("northing") / 1e5).alias("latitude"), (F.col("easting") / 1e4).alias("longitude"))
    return rounded(payload.collar_extent(tops), "west", "south", "east", "north", "lat", "lon")


def projected_collars(s: SparkSession, d: str) -> DataFrame:
    """Collars as degrees in UTM zone 50 south, projected."""
    tops = fx.collars(s, d).select("hole_id", ((F.col("northing") - 6.9e6) / 1e5 - 32).alias("latitude"),
        ((F.col("easting") - 5e5) / 5e3 + 116.5).alias("longitude"))
    return rounded(projection.with_utm(tops, 50, south=True).select("hole_id", "easting", "northing"), "easting", "northing")


def filter_by_project(s: SparkSession, d: str) -> DataFrame:
    return loaders.by_project(fx.collars(s, d), "1-URGENT").select("hole_id", "project_id")


QUERIES: dict[str, Query] = {
    "significant_intercepts": significant_intercepts, "located_intercepts_in_section": flagship,
    "block_volume_by_class": block_volume_by_class, "filtered_volume": filtered_volume, "attribute_stats_numeric": attribute_stats_numeric,
    "attribute_stats_categorical": attribute_stats_categorical, "block_bbox": block_bbox, "block_size_stats": block_size_stats,
    "min_curvature_traces": _traced("minimum_curvature"), "tangential_traces": _traced("tangential"),
    "balanced_tangential_traces": _traced("balanced_tangential"), "station_traces": station_traces,
    "attach_assay_positions": attach_assay_positions, "attach_structure_positions": attach_structure_positions,
    "interpolate_positions": interpolate_positions, "resample_trace": resample_trace,
    "composite_average": _composited("average"), "composite_sum": _composited("sum"),
    "overlap_weighted_value": overlap_weighted_value, "dominant_category": dominant_category, "has_data_segments": has_data_segments,
    "merge_numeric_categorical": merge_numeric_categorical, "join_assays_to_traces": join_assays_to_traces,
    "flatten_long_assays": flatten_long_assays,
    "validate_intervals": validate_intervals, "overlapping_intervals": overlapping_intervals, "validate_surveys": validate_surveys,
    "validate_structural_points": validate_structural_points,
    "validate_block_sizes": validate_block_sizes, "validate_blocks_in_bbox": validate_blocks_in_bbox, "block_overlaps": block_overlaps,
    "exterior_faces": exterior_faces,
    "plan_view": plan_view, "section_view": section_view, "plane_normals": plane_normals, "normalized_angles": normalized_angles,
    "tadpole_tails": tadpole_tails, "strike_dip_symbols": strike_dip_symbols, "alpha_beta_normals": alpha_beta_normals,
    "interval_points": interval_points, "interval_vertices": interval_vertices, "labelled_intervals": labelled_intervals,
    "unified_dataset": unified_dataset,
    "quantile_colour_bins": quantile_colour_bins, "binned_values": binned_values, "depth_markers": depth_markers,
    "holes_with_assays": holes_with_assays, "hole_properties": hole_properties,
    "trace_segments": trace_segments, "intervals_by_hole": intervals_by_hole, "structure_discs": structure_discs,
    "category_colours": category_colours, "wrapped_comments": wrapped_comments,
    "collar_extent": collar_extent, "filter_by_project": filter_by_project, "projected_collars": projected_collars,
}
