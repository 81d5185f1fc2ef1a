"""Queries of joins, tables for scenes and plots, colours and photos, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colours, scale
from ..model import ROW
from ..operators import asof, blockmodel, columns, desurvey, enrich, intervals, structural, validate
from ..sources import ingest, loaders
from . import fixtures as fx
from . import payload
from . import source_fixtures as raw
from .oracles import BENT, BLOCKS, COLLARS, INTERVALS, POSITION, SEGMENT_JOIN, SEGMENTS, STRUCTURES, SURVEYS, interpolated, nearest, r, traces
from .queries import STEP, WIDTH, XYZ, Query, _bent, r6, rounded
from .queries import station_vertices
from .queries import traces as traces_of

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Joins


@query(f"""with {raw.LINES}, t as (select hole, l_linenumber n, arg_max(l_tax, rid) tax, max(rid) rid from rl group by hole, l_linenumber), a as (select hole, l_linenumber n, l_returnflag f, rid from rl)
select a.hole hole_id, cast(a.n as int) line, f flag, a.rid, {r("tax", "tax")} from a left join t on t.hole = a.hole and t.n = a.n and a.n <> 7""")
def last_trace_of_assays(s: SparkSession, d: str) -> DataFrame:
    """Repeated keys: each assay gets the last trace row of its key, no fan-out; keys without one stay."""
    t = raw.lines(s, d).select(F.col("hole").alias("hole_id"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).otherwise(-1).alias("line"), F.col("l_tax").alias("tax"),
        F.lit("trace").alias("flag"), ROW)
    a = raw.lines(s, d).select(F.col("hole").alias("hole_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
        F.col(ROW).alias("rid"))
    return rounded(asof.join_assays_to_traces(a, t, ["hole_id", "line"], last_only=True).select("hole_id", "line", "flag", "rid", "tax"),
        "tax")


def _repeated(first: bool) -> str:
    """Nearest of vertices with repeated md: md = 10 * line number, of equal ones the last (or first) by row id."""
    pick = "arg_min" if first else "arg_max"
    return f"""with {raw.LINES}, {STRUCTURES}, tr as (select hole hole_id, l_linenumber * cast(10.0 as double) md, {pick}(cast(l_partkey as double), rid) easting, {pick}(cast(l_suppkey as double), rid) northing, {pick}(cast(l_tax as double), rid) elevation from rl group by hole, l_linenumber),
sq as (select * from fx_structures), {nearest("sq", "depth")} select event_id, hole_id, depth, md, easting, northing, {r("elevation", "tax")} from nv"""


def _nearest(s: SparkSession, d: str, duplicates: str) -> DataFrame:
    t = raw.lines(s, d).select(F.col("hole").alias("hole_id"), (F.col("l_linenumber") * F.lit(10.0)).alias("md"),
        F.col("l_partkey").cast("double").alias("easting"), F.col("l_suppkey").cast("double").alias("northing"),
        F.col("l_tax").alias("tax"), ROW)
    out = asof.nearest_vertex(fx.structures(s, d), t, "depth", ["md", "easting", "northing", "tax"], duplicates=duplicates,
        keep_unplaced=True)
    # coordinates to the millimetre in SQL
    return out.select("event_id", "hole_id", "depth", "md", "easting", "northing", F.round("tax", 3).alias("tax"))


@query(_repeated(False))
def nearest_of_repeated(s: SparkSession, d: str) -> DataFrame:
    """Of vertices with equal md the last in source order."""
    return _nearest(s, d, "last")


@query(_repeated(True))
def nearest_first_of_repeated(s: SparkSession, d: str) -> DataFrame:
    """Of vertices with equal md the first in source order."""
    return _nearest(s, d, "first")


_FRAME = """f0 as (select *, abs(dz) > 0.99 steep from dd),
f1 as (select *, case when steep then dz else -dy end rx0, case when steep then 0 else dx end ry0, case when steep then -dx else 0 end rz0 from f0),
f2 as (select *, rx0 / sqrt(rx0 * rx0 + ry0 * ry0 + rz0 * rz0) rx, ry0 / sqrt(rx0 * rx0 + ry0 * ry0 + rz0 * rz0) ry, rz0 / sqrt(rx0 * rx0 + ry0 * ry0 + rz0 * rz0) rz from f1),
f3 as (select *, dy * rz - dz * ry bx, dz * rx - dx * rz by_, dx * ry - dy * rx bz from f2)"""


@query(f"""with {traces("minimum_curvature")}, {raw.RAW_STRUCTURES}, qs as (select * from rt where hole_id is not null and depth is not null), {interpolated("qs", "depth")},
an as (select hole_id, md, azimuth a0, dip d0, lead(azimuth) over w a1, lead(dip) over w d1, lead(md) over w m1 from tr window w as (partition by hole_id order by md)),
dd0 as (select ip.*, n n_, an.a0 + coalesce(part * (an.a1 - an.a0), 0) za, an.d0 + coalesce(part * (an.d1 - an.d0), 0) zd from ip join an on an.hole_id = ip.hole_id and an.md = ip.md),
dd as (select *, case when n_ = 1 then 0 else cos(radians(zd)) * sin(radians(za)) end dx, case when n_ = 1 then 0 else cos(radians(zd)) * cos(radians(za)) end dy, case when n_ = 1 then -1 else -sin(radians(zd)) end dz from dd0),
{_FRAME}, f4 as (select *, dy * bz - dz * by_ cx, dz * bx - dx * bz cy, dx * by_ - dy * bx cz, radians(coalesce(beta, 0)) w, radians(90 - alpha) q from f3),
nn as (select event_id, hole_id, easting, northing, elevation,
  case when alpha is not null then cos(q) * (bx * cos(w) + cx * sin(w)) + sin(q) * dx else sin(radians(azimuth)) * sin(radians(dip)) end nx,
  case when alpha is not null then cos(q) * (by_ * cos(w) + cy * sin(w)) + sin(q) * dy else cos(radians(azimuth)) * sin(radians(dip)) end ny,
  case when alpha is not null then cos(q) * (bz * cos(w) + cz * sin(w)) + sin(q) * dz else cos(radians(dip)) end nz, alpha, dip from f4)
select event_id, concat(' ', hole_id) hole_id, {POSITION}, round(nx, 5) + cast(0.0 as double) normal_x, round(ny, 5) + cast(0.0 as double) normal_y, round(nz, 5) + cast(0.0 as double) normal_z from nn where alpha is not null or dip is not null""")
def structural_positions(s: SparkSession, d: str) -> DataFrame:
    """Structures on their trace with normals: from core angles and the hole's direction there, else from dip and azimuth."""
    t = loaders.load_structures(s, raw.structures(s, d)).withColumnRenamed(ROW, "event_id")
    out = structural.structural_positions(t, station_vertices(s, d).withColumn("hole_id", F.lower("hole_id")))
    out = rounded(out.select("event_id", "hole_id", *XYZ, "normal_x", "normal_y", "normal_z"), *XYZ)
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("normal_x", "normal_y", "normal_z")})


@query(f"""with {STRUCTURES}, tr as (select hole_id, md, md * 2 easting, md * md northing, -md elevation from (select distinct hole_id, unnest([0, 10, 10, 25]) * cast(1 as double) md from fx_structures where event_id % 3 = 0)),
sg as (select distinct hole_id from tr), q as (select event_id, f.hole_id, depth, case when depth <= 10 then 10 else 15 end len, case when depth <= 10 then 20 else 30 end ex, case when depth <= 10 then 100 else 525 end ny from fx_structures f join sg using (hole_id))
select event_id, {r("ex / sqrt(ex * ex + ny * ny + len * len)", "dir_x")}, {r("ny / sqrt(ex * ex + ny * ny + len * len)", "dir_y")}, {r("-len / sqrt(ex * ex + ny * ny + len * len)", "dir_z")} from q""")
def directions_without_angles(s: SparkSession, d: str) -> DataFrame:
    """Holes whose trace has no angles: the direction of the first segment that encloses the depth."""
    holes = fx.structures(s, d).filter("event_id % 3 = 0").select("hole_id").distinct()
    t = holes.select("hole_id", F.explode(F.array(*map(F.lit,
        (0.0, 10.0, 10.0, 25.0)))).alias("md")).withColumns({"easting": F.col("md") * 2, "northing": F.col("md") * F.col("md"),
        "elevation": -F.col("md")})
    return rounded(asof.interpolate_positions(fx.structures(s, d), t, direction=True).select("event_id", "dir_x", "dir_y", "dir_z"),
        "dir_x", "dir_y", "dir_z")


@query(f"""with {INTERVALS}, {raw.RAW_COLLARS}, h as (select hole_id k from rc where project_id = '1-URGENT') select lower(hole_id) hole_id, "from", "to", {r("au_ppm", "au_ppm")} from fx_intervals join h on k = lower(hole_id)""")
def scene_assays(s: SparkSession, d: str) -> DataFrame:
    """Valid intervals of the holes of a project, by hole key."""
    holes = loaders.by_project(ingest.standardize(raw.collars(s, d)), "1-URGENT")
    return rounded(enrich.scene_assays(fx.intervals(s, d).withColumn("hole_id", F.concat("hole_id", F.lit(" "))), holes,
        ["au_ppm", "absent"]), "au_ppm")


@query(f"""with {raw.RAW_STRUCTURES}, {raw.RAW_COLLARS} select lower(t.hole_id) hole_id, {r("depth", "depth")}, dip, azimuth, alpha, beta, event_type structure_type from rt t join rc c on c.hole_id = lower(t.hole_id) where project_id = '1-URGENT' and depth is not null""")
def scene_structures(s: SparkSession, d: str) -> DataFrame:
    holes = loaders.by_project(ingest.standardize(raw.collars(s, d)), "1-URGENT")
    return rounded(enrich.scene_structures(ingest.standardize(raw.structures(s, d).withColumnRenamed("Type", "structure_type")), holes),
        "depth")


@query(f"""with {INTERVALS}, n as (select hole_id, cast(substr(hole_id, 3) as bigint) k, count(*) c from fx_intervals group by hole_id) select hole_id, case when k % 3 <> 2 then c end n from n""")
def intervals_of_holes(s: SparkSession, d: str) -> DataFrame:
    """Lists stored under a hole's id as it is, or under its key, or under neither."""
    lists = intervals.intervals_by_hole(fx.intervals(s, d), F.col("geology_code"))
    k = F.substring("hole_id", 3, 20).cast("long") % 3
    stored = lists.withColumn("hole_id", F.when(k == 0, F.col("hole_id")).when(k == 1,
        F.lower("hole_id")).otherwise(F.concat(F.lit("x"), "hole_id")))
    return enrich.intervals_of_holes(lists.select("hole_id"), stored).select("hole_id",
        F.when(F.col("intervals").isNotNull(), F.size("intervals")).cast("long").alias("n"))


@query(f"with {COLLARS} select hole_id, project_id from fx_collars where contains(lower(hole_id), 'h1') ")
def search_holes(s: SparkSession, d: str) -> DataFrame:
    return payload.search_holes(fx.collars(s, d), " H1 ").select("hole_id", "project_id")


@query(f"with {INTERVALS}, {STRUCTURES}, a as (select distinct hole_id from fx_intervals), b as (select distinct hole_id from fx_structures), u as (select hole_id from a union select hole_id from b) select u.hole_id, a.hole_id is not null and b.hole_id is not null common from u left join a using (hole_id) left join b using (hole_id)")
def hole_sets(s: SparkSession, d: str) -> DataFrame:
    """Holes of any of two tables, and whether both have them."""
    a, b = fx.intervals(s, d), fx.structures(s, d)
    common = payload.common_holes(a, b).select(F.upper("hole_id").alias("hole_id"), F.lit(True).alias("common"))
    return payload.union_holes(a, b).join(common, "hole_id", "left").select("hole_id", F.coalesce("common", F.lit(False)).alias("common"))


@query(f"with {INTERVALS}, n as (select distinct hole_id from fx_intervals) select hole_id, cast(row_number() over (order by hole_id) as int) place from n")
def hole_options(s: SparkSession, d: str) -> DataFrame:
    """Distinct ids and their place in the sorted list."""
    return payload.hole_options(fx.intervals(s, d), placed=True)


@query(f"with {INTERVALS} select hole_id, starts_with(hole_id, 'DH1') prefixed, max(au_ppm) > 9 has_high from fx_intervals group by hole_id")
def hole_tests(s: SparkSession, d: str) -> DataFrame:
    """Whether a hole's id has a prefix, and whether it has any value of a property."""
    high = fx.intervals(s, d).withColumn("high", F.when(F.col("au_ppm") > 9, F.col("au_ppm")))
    return columns.hole_properties(high, ["high"]).select("hole_id", F.upper("hole_id").startswith("DH1").alias("prefixed"),
        (F.size("properties") > 0).alias("has_high"))


# Intervals and traces


@query(f"""with {INTERVALS}, {SEGMENTS}, {SEGMENT_JOIN}, m as materialized (select hole_id, seg_from, sum(au_ppm * ov) / sum(ov) v from sj group by all)
select hole_id, seg_from, case when v is null then '#9e9e9e' when v <= 2 then '#1' when v <= 5 then '#2' else '#3' end colour from fx_segments left join m using (hole_id, seg_from)""")
def segment_colours(s: SparkSession, d: str) -> DataFrame:
    """Colour of each segment's weighted value on a scale of three bins, grey without one."""
    found = intervals.weighted_value(fx.segments(s, d), fx.intervals(s, d), "au_ppm", WIDTH)
    return found.select("hole_id", "seg_from", scale.bin_colour(F.col("value"), [(0.0, 2.0), (2.0, 5.0), (5.0, 10.0)], ["#1", "#2", "#3"],
        colours.GREY).alias("colour"))


@query(f"with {SURVEYS}, p as (select hole_id, depth a, lead(depth) over w b, row_number() over w - 1 k from fx_surveys window w as (partition by hole_id order by depth)) select hole_id, cast(k as int) segment, a seg_from, b seg_to from p where b is not null")
def trace_pairs(s: SparkSession, d: str) -> DataFrame:
    """Depth ranges of consecutive vertices."""
    return payload.trace_pairs(fx.surveys(s, d).withColumnRenamed("depth", "md")).withColumn("segment", F.col("segment").cast("int"))


@query(f"""with {raw.raw_assays(False)}, p as (select hole, a, b, (a + b) / 2 z, code, rid from ra where hole is not null and b is not null and b >= a), k as (select *, row_number() over (partition by hole, a, b, code order by rid) n from p)
select hole hole_id, {r("z", "z")}, code val, row_number() over (partition by hole order by z desc, a desc, code) place from k where n = 1""")
def interval_points_by_value(s: SparkSession, d: str) -> DataFrame:
    """Repeated bounds with different values stay apart, zero-length intervals stay, deepest first."""
    t = loaders._named(ingest.standardize(raw.assays(s, d, False))).filter("hole_id <> ''")
    out = intervals.interval_points(t, "analyte", key_with_value=True, allow_points=True)
    w = Window.partitionBy("hole_id").orderBy(F.desc("z"), F.desc("from_val"), "val")
    return rounded(out.select("hole_id", "z", "val", F.row_number().over(w).cast("long").alias("place")), "z")


@query(f"with {STRUCTURES} select hole_id, {r('depth', 'z')}, structure_type val, cast(0 as double) half from (select hole_id, depth, structure_type, row_number() over (partition by hole_id, depth, structure_type order by event_id) n from fx_structures where depth is not null) where n = 1")
def depth_points(s: SparkSession, d: str) -> DataFrame:
    """Rows without bounds are points at their depth."""
    t = fx.structures(s, d).withColumnRenamed("event_id", ROW)
    return rounded(intervals.interval_points(t, "structure_type", key_with_value=True, allow_points=True).select("hole_id", "z", "val",
        "half"), "z")


@query(f"""with {raw.raw_assays(False)}, p as (select *, row_number() over (partition by hole, a, b order by rid) k from ra where b > a)
select hole hole_id, {r("a", '"from"')}, {r("b", '"to"')}, case when m = 4 then '' else code end note from p where k = 1 and hole is not null""")
def comment_points(s: SparkSession, d: str) -> DataFrame:
    """The first row of each valid interval, blank comments included."""
    t = ingest.standardize(raw.assays(s, d, False).withColumn("note",
        F.when(F.floor(F.col(ROW) / 1_000_000_000_000) % 50 != 4, F.col("Analyte"))))
    return rounded(intervals.comment_points(loaders._named(t).filter("hole_id <> ''"), "note"), "from", "to")


@query(f"""with {raw.raw_assays()}, p as (select hole, a, b, arg_min(code, rid) v, arg_min(v, rid) g from ra where b > a group by hole, a, b), c as (select hole, string_agg(concat(cast(round(a * 10000) as bigint), ':', v), ',' order by a, b) intervals from p group by hole)
select hole hole_id, intervals from c""")
def category_intervals(s: SparkSession, d: str) -> DataFrame:
    """Each hole's intervals with a category, of equal bounds the first row."""
    t = loaders.parse_assays(s, raw.assays(s, d))
    out = intervals.intervals_by_hole(t, F.col("analyte"))
    return out.select("hole_id", F.array_join(F.transform("intervals",
        lambda p: F.concat(F.round(p["from"] * 10000).cast("long").cast("string"), F.lit(":"), p["value"])), ",").alias("intervals"))


@query(f"""with {raw.RAW_SURVEYS}, {COLLARS}, n as (select hole_id, count(*) n, min(depth) lo, max(depth) hi from rs join fx_collars using (hole_id) group by hole_id)
select lower(hole_id) hole_id, n, lo, hi from n order by lower(hole_id) limit 100""")
def scene_holes(s: SparkSession, d: str) -> DataFrame:
    """Vertex lists of a scene's first hundred holes: its limit is its feature."""
    t = raw.surveys(s, d).select(F.col("HoleId").alias("hole_id"), F.col("SurveyDepth").cast("double").alias("md"))
    tops = fx.collars(s, d).withColumnRenamed("hole_id", "own")
    out = payload.scene_holes(t.join(tops, F.trim("hole_id") == F.col("own")).drop("own"))
    return out.select("hole_id", F.size("points").cast("long").alias("n"), F.element_at("points", 1)["md"].alias("lo"),
        F.element_at("points", -1)["md"].alias("hi"))


@query(f"""with {traces("minimum_curvature")} select {", ".join(f"{r(f'{m}({a})', f'{m}_{a}').replace('6)', '3)')}" for a in XYZ for m in ("min", "max"))}, {", ".join(r(f"avg({a})", f"mean_{a}").replace("6)", "3)") for a in XYZ)} from tr""")
def scene_bounds(s: SparkSession, d: str) -> DataFrame:
    """Bounds and centroid of all vertices."""
    t = traces_of(s, d)
    middle = payload.centroid(t, list(XYZ)).select(*[F.col(c).alias(f"mean_{c}") for c in XYZ])
    out = payload.scene_bounds(t).join(F.broadcast(middle))  # one row each
    return out.select(*[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in out.columns])


@query(f"with {raw.raw_assays(False)} select coalesce(hole, case when m = 7 then '' end) hole_id, {r('v', '\"value\"')} from ra where v is not null")
def finite_values(s: SparkSession, d: str) -> DataFrame:
    t = ingest.standardize(raw.assays(s, d, False)).withColumn("hole_id", F.trim("hole_id"))
    return rounded(payload.finite_values(t, "result"), "value")


@query(f"""with {INTERVALS} select hole_id, "from", "to", cast(2 as double) radius, geology_code color, ("from" + "to") / 2 depth, geology_code "label" from fx_intervals""")
def tubes_and_notes(s: SparkSession, d: str) -> DataFrame:
    """Tubes of intervals and the notes at their middles."""
    i = fx.intervals(s, d)
    notes = payload.annotations(i, "geology_code").withColumnRenamed("hole_id", "h")
    tubes = payload.tubes(i, 2.0, "geology_code").withColumn("middle", (F.col("from") + F.col("to")) / 2)
    return tubes.join(notes, (F.col("hole_id") == F.col("h")) & (F.col("middle") == F.col("depth"))).drop("h", "middle")


@query("""with n as (select l_orderkey, l_partkey, l_suppkey, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 i, count(*) over () t from lineitem), k as (select unnest(range(3000)) j)
select i row_number from n where t <= 3000 or i in (select floor(j * cast(t as double) / 3000) from k, (select any_value(t) t from n)) """)
def systematic_sample(s: SparkSession, d: str) -> DataFrame:
    """Rows floor(i * N / 3000) of the table: the limit of a scene is its feature."""
    t = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = scale.ranked(t.withColumn("k", F.col("l_orderkey").cast("double")).groupBy("k").count(), "k", F.col("count"))
    first = numbered.select((F.col("_stop") - F.col("count")).alias("start"), "count")
    rows = first.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("row_number"))
    return scale.systematic_sample(rows, "row_number")


@query(f"""with {COLLARS}, {SURVEYS}, t as (select hole_id, depth, azimuth, dip from fx_surveys)
select * from (with {traces("tangential")} select hole_id, {r("md", "md")}, {POSITION} from tr)""")
def desurvey_other_names(s: SparkSession, d: str) -> DataFrame:
    """The other dialect's columns: from for depth, x, y, z for the collar; a step that isn't positive is 1, given 5 here."""
    tops = fx.collars(s, d).withColumnsRenamed({"easting": "x", "northing": "y", "elevation": "z"})
    t = desurvey.tangential(tops, fx.surveys(s, d).withColumnRenamed("depth", "from"), STEP, depth_col="from", xyz=("x", "y", "z"))
    return rounded(t.select("hole_id", "md", *XYZ), "md", *XYZ)


# Structures


@query(f"with {STRUCTURES} select event_id, {r('cos(radians(dip))', 'tail_dx')}, {r('sin(radians(dip))', 'tail_dy')} from fx_structures")
def dip_vectors(s: SparkSession, d: str) -> DataFrame:
    return rounded(structural.dip_vectors(fx.structures(s, d)).select("event_id", "tail_dx", "tail_dy"), "tail_dx", "tail_dy")


@query(f"""with {STRUCTURES}, {COLLARS} select event_id, round((easting - 502500) * sin(radians(30)) + (northing - 6900000) * cos(radians(30)), 3) + cast(0 as double) section_along, case when event_id % 31 = 0 then 0 else depth end section_depth
from fx_structures join fx_collars using (hole_id)""")
def structures_on_section(s: SparkSession, d: str) -> DataFrame:
    t = fx.structures(s, d).withColumn("depth", F.when(F.col("event_id") % 31 != 0, F.col("depth"))).join(fx.collars(s, d), "hole_id")
    out = structural.project_structures_to_section(t, (502500.0, 6900000.0), 30.0)
    return out.select("event_id", (F.round("section_along", 3) + F.lit(0.0)).alias("section_along"), "section_depth")


@query(f"with {STRUCTURES}, {BENT} select event_id, not (coalesce(dip < 0 or dip > 90, false) or coalesce(azimuth < 0 or azimuth >= 360, false)) valid from fx_bent")
def split_structural_points(s: SparkSession, d: str) -> DataFrame:
    """Points whose angles are in range, and the others."""
    good, wrong = validate.split_structural_points(_bent(s, d))
    return good.select("event_id", F.lit(True).alias("valid")).unionByName(wrong.select("event_id", F.lit(False).alias("valid")))


@query(f"""with {STRUCTURES}, {BENT}, i as (select *, depth a, depth + event_id % 3 - 0.5 b from fx_bent), ok as (select *, lag(b) over (partition by hole_id order by a, b, event_id) p from i where a is not null and b is not null)
select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, 'missing_depth' issue from i where a is null or b is null union all select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, 'non_positive_length' from ok where b <= a
union all select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, 'overlap' from ok where a < p union all select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, 'dip_out_of_range' from i where dip < 0 or dip > 90
union all select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, 'azimuth_out_of_range' from i where azimuth < 0 or azimuth >= 360""")
def validate_structural_intervals(s: SparkSession, d: str) -> DataFrame:
    t = _bent(s, d).withColumns({"from": F.col("depth"), "to": F.col("depth") + F.col("event_id") % 3 - 0.5}).withColumnRenamed("event_id",
        ROW)
    return rounded(validate.validate_structural_intervals(t), "from", "to")


# Colours


@query(f"""with recursive {BLOCKS}, n as (select distinct p_name nm from part), t as (select nm, lower(trim(nm)) k from n),
h(nm, k, i, v) as (select nm, k, 0, cast(2166136261 as bigint) from t union all select nm, k, i + 1, (xor(v, cast(unicode(substr(k, i + 1, 1)) as bigint)) * 16777619) & 4294967295 from h where i < length(k)),
u as (select nm, v / cast(4294967295 as double) hue from h where i = length(k)), c as (select nm, case when hue < 1 / cast(6 as double) then 1 when hue < 0.5 then 2 else 3 end part, hue from u)
select nm "name", {r("hue", "unit")} from c""")
def category_units(s: SparkSession, d: str) -> DataFrame:
    """Hash of each name, whatever its case: the hue of its colour."""
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")).distinct().select("name",
        r6(colours.seeded_unit(F.lower(F.trim("name")))).alias("unit"))


def _part(h: str) -> str:
    """A channel of hsl(h, 0.7, 0.5), two hex digits."""
    value = f"case when m < 1 / cast(6 as double) then 0.15 + 0.7 * 6 * m when m < 0.5 then 0.85 when m < 2 / cast(3 as double) then 0.15 + 0.7 * 6 * (2 / cast(3 as double) - m) else 0.15 end"
    return f"(select lpad(lower(to_hex(cast(floor(({value}) * 255 + 0.5) as bigint))), 2, '0') from (select (({h} + 1) - floor({h} + 1)) m))"


@query(f"""with recursive n as (select distinct p_brand b from part), h(b, i, v) as (select b, 0, cast(2166136261 as bigint) from n union all
  select b, i + 1, (xor(v, cast(unicode(substr(lower(b), i + 1, 1)) as bigint)) * 16777619) & 4294967295 from h where i < length(b)), u as (select b, v / cast(4294967295 as double) h from h where i = length(b))
select b brand, concat('#', {_part("h + 1 / cast(3 as double)")}, {_part("h")}, {_part("h - 1 / cast(3 as double)")}) colour from u union all select '  ', '#9e9e9e' """)
def category_hash_colours(s: SparkSession, d: str) -> DataFrame:
    """Colour of each brand from its hash; grey for a blank one."""
    names = s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("brand")).distinct().unionByName(s.createDataFrame([("  ",)],
        "brand string"))
    return names.select("brand", colours.category_hash_colour(F.col("brand")).alias("colour"))


@query(f"""with recursive {SURVEYS}, p as (select hole_id, row_number() over (partition by hole_id order by depth) - 1 i from fx_surveys), t as (select hole_id, i, concat(hole_id, ':', i) k from p),
h(hole_id, i, k, j, v) as (select hole_id, i, k, 0, cast(2166136261 as bigint) from t union all select hole_id, i, k, j + 1, (xor(v, cast(unicode(substr(k, j + 1, 1)) as bigint)) * 16777619) & 4294967295 from h where j < length(k)),
u as (select hole_id, i, v / cast(4294967295 as double) * 0.15 + (i % 14) / cast(14 as double) * 0.85 x from h where j = length(k))
select hole_id, cast(i as int) segment, {r("x - floor(x)", "hue")}, {r("(i * 137.5) % 360 / cast(360 as double)", "golden")} from u""")
def segment_hues(s: SparkSession, d: str) -> DataFrame:
    """Hues of segments without a value, and of holes a golden angle apart."""
    w = Window.partitionBy("hole_id").orderBy("depth")
    t = fx.surveys(s, d).select("hole_id", (F.row_number().over(w) - 1).alias("segment"))
    return rounded(t.select("hole_id", "segment", colours.segment_hash_hue(F.col("hole_id"), F.col("segment")).alias("hue"),
        colours.golden_hue(F.col("segment")).alias("golden")), "hue", "golden")


@query(f"with {BLOCKS} select block_id, {r('(1 - (grade - 0.1) / 4.9) * 240', 'hue')}, case lower(rock_type) when 'shale' then '#607D8B' else '#0' end lithology, case when block_id % 2 = 0 then '#FFD700' else '#B0BEC5' end resolved from fx_blocks")
def value_hues(s: SparkSession, d: str) -> DataFrame:
    """Hue of a value on a range, colours by built-in maps, exact or whatever the case."""
    key = F.when(F.col("block_id") % 2 == 0, "AU").otherwise("limestone")
    both = {**colours.resolve_colour_map("commodity"), **colours.resolve_colour_map(" Lithology ")}
    return rounded(fx.blocks(s, d).select("block_id", colours.value_hue(F.col("grade"), 0.1, 5.0).alias("hue"),
        colours.colour(F.col("rock_type"), colours.resolve_colour_map("lithology"), "#0").alias("lithology"),
        colours.colour(key, both, "#0").alias("resolved")), "hue")


@query("""select unnest(['l_ag_ppm', 'cu-pct', 'Fe Total', 'tax']) "column", unnest(['#C0C0C0', '#B87333', '#8B4513', '']) colour, unnest([count(l_tax), count(l_discount) filter (where l_discount > 0), count(l_quantity) filter (where l_quantity > 10), count(l_tax)]) n_values, unnest([max(l_tax), max(l_discount), max(l_quantity), max(l_tax)])::double highest from lineitem""")
def commodity_colours(s: SparkSession, d: str) -> DataFrame:
    """A table's columns by the commodity in their names: its colour, how many values the column has and the highest."""
    t = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_tax").alias("l_ag_ppm"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("cu-pct"),
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("Fe Total"), F.col("l_tax").alias("tax"))
    marks = [F.struct(F.lit(c).alias("column"), F.lit(colours.commodity_colour(c) or "").alias("colour"), F.count(ingest.ref(c)).alias("n_values"),
        F.max(ingest.ref(c)).cast("double").alias("highest")) for c in t.columns]
    return t.agg(F.array(*marks).alias("m")).select(F.explode("m").alias("m")).select("m.*")


@query(f"""with {INTERVALS}, b as (select hole_id, max(au_ppm) hi, min(au_ppm) lo from fx_intervals group by hole_id), f as (select hole_id, unnest([lo * 200, hi * 20 + 0.5, hi / 50]) v from b)
select hole_id, {r("v", "v")}, concat(case when v >= 1000 then format('{{:.0f}}', v) when v >= 10 then format('{{:.1f}}', v) when v >= 0.1 then format('{{:.2f}}', v) else format('{{:.3f}}', v) end, ' – n/a') "label" from f""")
def bin_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels of bins: fewer decimals for larger numbers."""
    b = fx.intervals(s, d).groupBy("hole_id").agg(F.max("au_ppm").alias("hi"), F.min("au_ppm").alias("lo"))
    v = b.select("hole_id", F.explode(F.array(F.col("lo") * 200, F.col("hi") * 20 + 0.5, F.col("hi") / 50)).alias("v"))
    return rounded(v.withColumn("label", scale.bin_label(F.col("v"), F.lit(None).cast("double"))), "v")


# Photos, maps and rasters


@query(f"""with {raw.RAW_PHOTOS} select photo_set, min(rid) first_row, count(*) n, string_agg(cast(rid as varchar), ',' order by coalesce(from_depth, 0), rid) ids from rp group by photo_set""")
def photos_by_set(s: SparkSession, d: str) -> DataFrame:
    """Photos of each set by depth."""
    out = payload.photos_by_set(raw.photos(s, d).select("photo_set", "from_depth", ROW))
    return out.select("photo_set", "first_row", F.size("photos").cast("long").alias("n"),
        F.array_join(F.transform("photos", lambda p: p[ROW].cast("string")), ",").alias("ids"))


@query(f"with {raw.RAW_PHOTOS} select rid, photo_set, from_depth from rp where from_depth < 60 and to_depth > 20")
def photos_in_range(s: SparkSession, d: str) -> DataFrame:
    return payload.photos_in_range(raw.photos(s, d), 20.0, 60.0).select(F.col(ROW).alias("rid"), "photo_set", "from_depth")


@query(f"""with {raw.RAW_PHOTOS}, z as (select *, cast(rid % 9 as double) zoom from rp) select rid, case when rid % 4 = 0 and zoom < 4 then concat('https://photos.test/t/', rid) when rid % 4 = 0 and zoom < 7 then concat('https://photos.test/m/', rid)
when rid % 4 = 1 and zoom < 4 then concat('https://photos.test/t/', rid) else image_url end url, cast(greatest(1, floor((to_depth - from_depth) * 50 * zoom / 5 + 0.5)) as int) pixels, concat('https://trays.test/x/tray_', lpad(cast(rid % 1000 as varchar), 3, '0'), '.jpg') tray from z""")
def photo_urls(s: SparkSession, d: str) -> DataFrame:
    """URL of the detail level for a zoom, height in pixels, and the URL of a tray by number."""
    zoom = (F.col(ROW) % 9).cast("double")
    t = payload.tray_photos(raw.photos(s, d).withColumn("tray", F.col(ROW) % 1000).withColumn("own", F.col("image_url")),
        "https://trays.test/x/")
    pixels = payload.photo_pixels(F.coalesce(F.col("to_depth") - F.col("from_depth"), F.lit(None)), zoom)
    return t.select(F.col(ROW).alias("rid"), payload.photo_url(F.col("lod_urls"), zoom, F.col("own")).alias("url"), pixels.alias("pixels"),
        F.col("image_url").alias("tray"))


@query(f"with {COLLARS} select hole_id, project_id color_value from fx_collars")
def map_points(s: SparkSession, d: str) -> DataFrame:
    """Collars with the value to colour by; an unknown column adds none."""
    return payload.map_points(payload.map_points(fx.collars(s, d), "nothing"), "project_id").select("hole_id", "color_value")


@query(f"with {BLOCKS} select block_id, x min_x, y min_y, x + dx max_x, y + dy max_y from fx_blocks")
def raster_bounds(s: SparkSession, d: str) -> DataFrame:
    """Boxes from a corner and a size, then from their corners."""
    b = fx.blocks(s, d).select("block_id", "x", "y", F.col("dx").alias("width"), F.col("dy").alias("height"))
    return payload.normalized_bounds(payload.normalized_bounds(b).select("block_id", "min_x", "min_y", "max_x", "max_y"))


@query(f"with {BLOCKS} select block_id from fx_blocks where grade >= 2 and rock_type = 'PROMO'")
def filtered_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks by criteria in the other dialect: empty conditions are ignored."""
    return blockmodel.filter_blocks(fx.blocks(s, d), {"grade": {"gte": 2.0}, "rock_type": "PROMO", "density": None},
        unknown_excludes=True).select("block_id")
