"""Joins along a hole: nearest vertex, and linear interpolation between vertices.

Every vertex is given the range of depths from it to the next one (the first and last of a hole reach on without end), so a query
meets the one vertex whose range holds its depth: an equi-join on the hole with the range as a condition. So only vertices are
windowed, queries are not; a hole with a large part of all queries is a skewed join key, whose queries Spark's adaptive
execution deals to many tasks. A query is compared with the vertices of its hole, which its depth bounds.

Where the vertices come from a desurvey, station pairs can stand for them: `nearest_on_pairs` gets the vertex from
the pair by arithmetic, without making the vertices, and linear interpolation needs the stations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW
from ..sources.ingest import number, ref
from . import desurvey

POSITION = ["easting", "northing", "elevation"]


def _ranges(vertices: DataFrame, payload: Column, ties: list[Column], around: tuple[str, ...], last_of_equal: bool = False) -> DataFrame:
    """_hole, _md, _lo, _hi, _v and, as far as they are in `around`, _next and _back: each vertex with its range and the vertices
    beside it. _lo is its md, or null for a hole's first vertex, _hi the next one's. last_of_equal: of equal md only the last."""
    order = Window.partitionBy("_hole").orderBy("_md", "_tie")
    rows = vertices.select(F.col("hole_id").alias("_hole"), number(F.col("md")).alias("_md"), F.struct(*ties).alias("_tie"),
        payload.alias("_v")).filter("_hole is not null and _md is not null")
    if last_of_equal:
        rows = rows.withColumn("_more", F.lead("_md").over(order)).filter("_more is null or _more <> _md").drop("_more")
    beside = {"_next": F.lead("_v").over(order), "_back": F.lag("_v").over(order)}
    ends = {"_lo": F.when(F.row_number().over(order) > 1, F.col("_md")), "_hi": F.lead("_md").over(order)}
    return rows.withColumns(ends | {n: beside[n] for n in around}).drop("_tie")


def _placed(queries: DataFrame, ranges: DataFrame, at: Column, strict: bool, how: str) -> DataFrame:
    """queries with _t and the vertex whose range holds it (with strict, a range ends with its upper depth), and _before: whether the
    depth lies before the hole's first vertex."""
    # two keys: the windows' partitioning by hole alone isn't reused, so that both sides of the join are shuffles, which adaptive
    # execution can split where a hole has too many queries
    q = queries.withColumns({"_t": at, "_key": F.xxhash64(F.col("hole_id").cast("string"))})
    r = ranges.withColumn("_range_key", F.xxhash64(F.col("_hole").cast("string")))
    t, lo, hi = F.col("_t"), F.col("_lo"), F.col("_hi")
    inside = (lo.isNull() | (t > lo if strict else t >= lo)) & (hi.isNull() | (t <= hi if strict else t < hi))
    joined = q.join(r, (F.col("_key") == F.col("_range_key")) & (F.col("hole_id") == F.col("_hole")) & t.isNotNull() & inside, how)
    return joined.withColumn("_before", t <= F.col("_md") if strict else t < F.col("_md")).drop("_hole", "_lo", "_key", "_range_key")


def nearest_vertex(queries: DataFrame, traces: DataFrame, depth_col: str, columns: list[str] | None = None, duplicates: str = "last",
    keep_unplaced: bool = False) -> DataFrame:
    """queries with the columns of the nearest trace vertex of their hole (nulls where the hole has no trace).

    At equal distance the smaller md counts; of vertices with equal md the last (or first) in source order. A clashing
    column gets the suffix _trace. Queries without hole or depth are dropped, or kept unplaced.
    """
    columns = columns or [c for c in traces.columns if c not in ("hole_id", ROW)]
    names = {c: f"{c}_trace" if c in queries.columns else c for c in columns}
    ties = [ref(c) for c in ([ROW] if ROW in traces.columns else sorted(c for c in traces.columns if c != "hole_id"))]
    payload = F.struct(*[ref(c).alias(c) for c in columns])
    if duplicates == "first":  # of equal md the first: before the order of ties is lost
        traces = traces.groupBy("hole_id", number(F.col("md")).alias("md")).agg(F.min_by(payload, F.struct(*ties)).alias("_p"))
        payload, ties = F.col("_p"), [F.lit(0)]
    ranges = _ranges(traces, payload, ties, ("_next",), last_of_equal=True)
    rows = _placed(queries if keep_unplaced else _askable(queries, depth_col), ranges, number(ref(depth_col)), False, "left")
    ahead = ~F.col("_before") & (F.col("_t") - F.col("_md") > F.col("_hi") - F.col("_t"))
    rows = rows.withColumn("_p", F.when(F.coalesce(ahead, F.lit(False)), F.col("_next")).otherwise(F.col("_v")))
    return rows.select(*map(ref, queries.columns), *[F.col("_p").getField(c).alias(n) for c, n in names.items()])


def _askable(queries: DataFrame, depth_col: str) -> DataFrame:
    return queries.filter(F.col("hole_id").isNotNull() & number(ref(depth_col)).isNotNull())


def nearest_on_pairs(queries: DataFrame, pairs: DataFrame, depth_col: str, columns: list[str] | None = None,
    method: str = "minimum_curvature", keep_unplaced: bool = False) -> DataFrame:
    """What nearest_vertex gives for the vertices of desurvey.station_pairs (of the same method), without making them.

    The step nearest to a depth is its place in the pair that holds it, rounded, halves down. A pair's own start is the
    previous pair's last vertex, with that one's angles.
    """
    columns = columns or ["md", *POSITION, "azimuth", "dip"]
    names = {c: f"{c}_trace" if c in queries.columns else c for c in columns}
    before = Window.partitionBy("hole_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    end = desurvey.vertex(F.col("steps"), method)
    made = pairs.filter("steps > 0 or n = 1").withColumns({f"_end_{c}": F.last(end[c]).over(before) for c in ("azimuth", "dip")})
    payload = F.struct(*[c for c in made.columns if c != "hole_id"])
    rows = _placed(queries if keep_unplaced else _askable(queries, depth_col), _ranges(made, payload, [F.col("n")], ()),
        number(ref(depth_col)), False, "left")
    of = lambda c: F.col("_v").getField(c)
    steps = of("steps")
    k = F.when(steps > 0, F.greatest(F.lit(0), F.least(steps, F.ceil((F.col("_t") - of("md")) * steps / of("length") - 0.5).cast("int")))).otherwise(0)
    rows = rows.withColumn("_k", k)
    found = desurvey.vertex(F.col("_k"), method, of)
    start = (F.col("_k") == 0) & (of("n") > 1)
    found |= {c: F.when(start, of(f"_end_{c}")).otherwise(found[c]) for c in ("azimuth", "dip")}
    return rows.select(*map(ref, queries.columns), *[found[c].alias(n) for c, n in names.items()])


def attach_assay_positions(assays: DataFrame, traces: DataFrame, duplicates: str = "last") -> DataFrame:
    """Assays (by mid) with all columns of the nearest vertex."""
    return nearest_vertex(assays, traces, "mid", duplicates=duplicates)


def attach_structure_positions(structures: DataFrame, traces: DataFrame, depth_col: str = "depth") -> DataFrame:
    """Structures (by depth, or mid where there is no depth column) with the nearest vertex's position."""
    return nearest_vertex(structures, traces, depth_col if depth_col in structures.columns else "mid", POSITION)


def interpolate_positions(queries: DataFrame, traces: DataFrame, depth_col: str = "depth", columns: list[str] | None = None,
    clamp: bool = False, direction: bool = False) -> DataFrame:
    """queries with `columns` interpolated at their depth: on the first segment that encloses it, beyond the ends along the
    end segments (or held at the end vertex, with clamp). A single vertex stands for every depth. Holes without a trace drop out.

    Between the stations of a desurvey positions are linear (and angles, by minimum curvature): traces of stations only (a step
    longer than any pair) give what finer ones give.

    direction adds dir_x, dir_y, dir_z, the unit direction of the hole there: from azimuth and dip interpolated between the
    segment's ends (its start's, if the end has none), else along the segment, else (a single vertex, or a segment without
    length) straight down.
    """
    columns = columns or POSITION
    ties = [ref(c) for c in ([ROW] if ROW in traces.columns else columns)]
    angles = [(number(F.col(c)) if c in traces.columns else F.lit(None).cast("double")).alias(f"_{c}") for c in ("azimuth",
        "dip")] if direction else []
    if direction:
        columns = [*columns, *[c for c in POSITION if c not in columns]]
    point = F.struct(number(F.col("md")).alias("md"), *[number(ref(c)).alias(c) for c in columns], *angles)
    rows = _placed(queries, _ranges(traces, point, ties, ("_next", "_back")), number(ref(depth_col)), True, "inner")
    a = F.when(~F.col("_before") & F.col("_next").isNull(), F.coalesce("_back", "_v")).otherwise(F.col("_v"))
    b = F.when(~F.col("_before") & F.col("_next").isNull(), F.col("_v")).otherwise(F.coalesce("_next", "_v"))
    rows = rows.withColumns({"_s": a, "_e": b})
    length = F.col("_e.md") - F.col("_s.md")
    part = F.when(length > 0, (F.col("_t") - F.col("_s.md")) / length).otherwise(0.0)
    if clamp:
        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), part))
    turned = []
    if direction:
        alone = F.col("_next").isNull() & F.col("_back").isNull()
        both = F.col("_e._azimuth").isNotNull() & F.col("_e._dip").isNotNull()
        angle = [F.when(both, F.col(f"_s._{c}") + part * (F.col(f"_e._{c}") - F.col(f"_s._{c}"))).otherwise(F.col(f"_s._{c}")) for c in ("azimuth", "dip")]
        step = [F.col("_e").getField(c) - F.col("_s").getField(c) for c in POSITION]
        size = F.sqrt(sum(x * x for x in step))
        known = F.col("_s._azimuth").isNotNull() & F.col("_s._dip").isNotNull()
        turned = [F.when(alone, down).when(known, d).when(size >= 1e-10, x / size).otherwise(down).alias(n) for n, d, x,
            down in zip(("dir_x", "dir_y", "dir_z"), desurvey.direction(*angle), step, map(F.lit, (0.0, 0.0, -1.0)), strict=True)]
    value = lambda c: F.col("_s").getField(c) + F.coalesce(part * (F.col("_e").getField(c) - F.col("_s").getField(c)),
        F.lit(0.0))
    return rows.select(*map(ref, queries.columns), *[value(c).alias(c if c not in queries.columns else f"{c}_trace") for c in columns], *turned)


def resample_trace(traces: DataFrame, step: float) -> DataFrame:
    """hole_id, md and position every `step` from the first vertex on; positions past the end stay at the last vertex."""
    ends = traces.groupBy("hole_id").agg(F.min("md").alias("lo"), F.max("md").alias("hi"))
    count = F.greatest(F.lit(1), F.ceil((F.col("hi") + step - F.col("lo")) / step).cast("int"))
    marks = ends.select("hole_id", "lo", F.explode(F.sequence(F.lit(0), count - 1)).alias("k")).select("hole_id",
        (F.col("lo") + F.col("k") * F.lit(float(step))).alias("md_out"))
    return interpolate_positions(marks, traces, "md_out", clamp=True).withColumnRenamed("md_out", "md")


def join_assays_to_traces(assays: DataFrame, traces: DataFrame, on: list[str], last_only: bool = False) -> DataFrame:
    """Left join on keys (nulls match); clashing trace columns get the suffix _trace. last_only: the last trace row of each key, no fan-out."""
    right = traces
    if last_only:
        others = [c for c in traces.columns if c not in on]
        row = F.struct(*[ref(c) for c in dict.fromkeys([ROW, *others]) if c in others])
        right = traces.groupBy(*map(ref, on)).agg(F.max(row).alias("_r")).select(*map(ref, on),
            *[F.col("_r").getField(c).alias(c) for c in others])
    right = right.select(*[ref(c).alias(f"_on_{c}" if c in on else f"{c}_trace" if c in assays.columns else c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & ref(c).eqNullSafe(F.col(f"`_on_{c}`"))
    return assays.join(right, same, "left").drop(*[f"_on_{c}" for c in on])
