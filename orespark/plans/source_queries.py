"""Queries of the loaders, sinks and readers, over raw tables (source_fixtures), each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COLLAR, ROW, STRUCTURE, SURVEY
from ..operators import asof, blockmodel, columns, desurvey, enrich, mesh, validate
from ..sources import ingest, loaders, sinks
from . import fixtures as fx
from . import payload
from . import source_fixtures as raw
from .oracles import BLOCKS, COLLARS, INTERVALS, POSITION, STRUCTURES, SURVEYS, nearest, r, traces
from .queries import STEP, XYZ, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BOUNDS = ("from", "to", "mid")
SHOWN = f"{r('f', '\"from\"')}, {r('u', '\"to\"')}, {r('0.5 * (f + u)', 'mid')}"


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Tables of holes


@query(f"with {raw.raw_assays()}, {raw.BOUNDED} select hole hole_id, {SHOWN}, code analyte, {r('v', 'result')} from rb")
def load_assays(s: SparkSession, d: str) -> DataFrame:
    out = loaders.load_assays(s, raw.assays(s, d).drop("number"))
    return rounded(ingest.coerce_numeric(out, ["result"]).select("hole_id", *BOUNDS, "analyte", "result"), *BOUNDS, "result")


@query(f"""with {raw.raw_assays()}, {raw.BOUNDED}, g as (select hole, f, u, """ + ", ".join(f"arg_min(n, rid) filter (where code = '{c}' and n is not null) {c.lower()}" for c in "ANR") + f""" from rb group by hole, a, b, f, u having count(n) > 0)
select hole hole_id, {SHOWN}, {r("a", "a")}, {r("n", "n")}, {r("r", "r")} from g""")
def load_long_assays(s: SparkSession, d: str) -> DataFrame:
    """A long table with repeated codes: the first value in source order counts."""
    long = raw.assays(s, d).drop("Result").withColumnRenamed("number", "Assay_Value")
    return rounded(loaders.load_assays(s, long, flat=False).select("hole_id", *BOUNDS, F.col("A").alias("a"), F.col("N").alias("n"),
        F.col("R").alias("r")), *BOUNDS, "a", "n", "r")


@query(f"with {raw.raw_assays(equal=False)} select hole hole_id, {r('a', '\"from\"')}, {r('b', '\"to\"')}, {r('0.5 * (a + b)', 'mid')} from ra")
def load_strict_assays(s: SparkSession, d: str) -> DataFrame:
    """The other dialect: bounds as they are, to greater than from."""
    return rounded(loaders.load_assays(s, raw.assays(s, d, equal=False), js=True, keep_all=False), *BOUNDS)


@query(f"with {raw.raw_assays(False)} select hole hole_id, {r('a', '\"from\"')}, {r('b', '\"to\"')}, code analyte from ra where hole is not null and b > a")
def parse_assays(s: SparkSession, d: str) -> DataFrame:
    """Only the rows that are intervals."""
    return rounded(loaders.parse_assays(s, raw.assays(s, d, False)).select("hole_id", "from", "to", "analyte"), "from", "to")


@query(f"with {raw.raw_assays(False)}, h as (select max(hole) hole from ra) select hole hole_id, {r('a', '\"from\"')}, {r('b', '\"to\"')} from ra join h using (hole) where b > a")
def assays_of_one_hole(s: SparkSession, d: str) -> DataFrame:
    """A point lookup: the hole with the greatest id."""
    table = raw.assays(s, d, False)
    last = table.agg(F.max(F.trim("Hole Id"))).head()[0]
    return rounded(loaders.parse_assays(s, table, hole_id=f" {last} ").select("hole_id", "from", "to"), "from", "to")


@query(f"with {raw.raw_assays(False)} select distinct hole hole_id from ra where hole is not null")
def assay_hole_ids(s: SparkSession, d: str) -> DataFrame:
    return loaders.hole_ids(ingest.standardize(raw.assays(s, d, False)))


@query(f"with {raw.RAW_COLLARS} select concat(' ', hole_id) hole_id, concat(' ', hole_id) datasource_hole_id, project_id, cast(elevation as varchar) elevation, 'EPSG:28350' crs, easting x, northing y, 'EPSG:28350' geometry_crs from rc")
def load_collars(s: SparkSession, d: str) -> DataFrame:
    out = loaders.load_collars(s, raw.collars(s, d), crs="EPSG:28350", keep_all=False)
    return out.select("hole_id", "datasource_hole_id", "project_id", "elevation", "crs", "geometry.x", "geometry.y", "geometry_crs")


@query(f"with {raw.RAW_COLLARS} select hole_id, hole_id datasource_hole_id, easting, northing, elevation from rc")
def load_loose_collars(s: SparkSession, d: str) -> DataFrame:
    """The other dialect: an id and either pair of coordinates are enough."""
    return loaders.load_collars(s, raw.collars(s, d).drop("EPSG"), js=True).select("hole_id", "datasource_hole_id", *XYZ)


@query(f"with {raw.RAW_SURVEYS} select concat(hole_id, ' ') hole_id, cast(depth as varchar) depth from rs")
def load_surveys(s: SparkSession, d: str) -> DataFrame:
    """Values as the source has them."""
    return loaders.load_surveys(s, raw.surveys(s, d), keep_all=False).select("hole_id", "depth")


@query(f"with {raw.RAW_SURVEYS} select hole_id, depth, {r('azimuth', 'azimuth')}, {r('dip', 'dip')} from rs")
def load_strict_surveys(s: SparkSession, d: str) -> DataFrame:
    return rounded(loaders.load_surveys(s, raw.surveys(s, d), strict=True).select("hole_id", "depth", "azimuth", "dip"), "azimuth", "dip")


@query(f"with {raw.RAW_SURVEYS} select hole_id, depth, {r('azimuth', 'azimuth')}, {r('dip', 'dip')} from rs where m not in (7, 11, 12, 13)")
def parse_surveys(s: SparkSession, d: str) -> DataFrame:
    return rounded(loaders.parse_surveys(s, raw.surveys(s, d, False)).select("hole_id", "depth", "azimuth", "dip"), "azimuth", "dip")


@query(f"with {raw.RAW_STRUCTURES} select coalesce(concat(' ', hole_id), ' ') hole_id, depth is null no_depth, dip, azimuth, alpha, beta from rt")
def load_structures(s: SparkSession, d: str) -> DataFrame:
    out = loaders.load_structures(s, raw.structures(s, d))
    return out.select("hole_id", F.col("depth").isNull().alias("no_depth"), "dip", "azimuth", "alpha", "beta")


@query(f"with {raw.RAW_STRUCTURES} select event_id, hole_id, {r('depth', 'depth')}, dip, azimuth, alpha, beta from rt where hole_id is not null and depth is not null")
def parse_structural_points(s: SparkSession, d: str) -> DataFrame:
    return rounded(loaders.parse_structures(s, raw.structures(s, d)).select(F.col(ROW).alias("event_id"), "hole_id", "depth", "dip",
        "azimuth", "alpha", "beta"), "depth")


@query(f"""with {raw.RAW_STRUCTURES}, i as (select *, depth a, depth + event_id % 3 b from rt)
select event_id, hole_id, {r("a", '"from"')}, {r("b", '"to"')}, {r("(a + b) * 0.5", "mid")} from i where hole_id is not null and b > a""")
def parse_structural_intervals(s: SparkSession, d: str) -> DataFrame:
    """The same reader, told by from and to: intervals win."""
    table = raw.structures(s, d).withColumns({"Depth_From": F.col("Depth"),
        "Depth_To": (F.col("Depth").try_cast("double") + F.col(ROW) % 3).cast("string")})
    return rounded(loaders.parse_structures(s, table).select(F.col(ROW).alias("event_id"), "hole_id", *BOUNDS), *BOUNDS)


@query(f"with {raw.raw_assays(False)} select coalesce(' ' || hole || ' ', case when m = 7 then '  ' end) hole_id, {r('a', '\"from\"')}, {r('b', '\"to\"')}, {r('(a + b) * 0.5', 'mid')}, {r('v', 'rqd')} from ra")
def load_geotechnical(s: SparkSession, d: str) -> DataFrame:
    """No row is checked; the measures become numbers."""
    table = raw.assays(s, d, False).withColumnRenamed("Result", "RQD")
    return rounded(loaders.load_geotechnical(s, table).select("hole_id", *BOUNDS, "rqd"), *BOUNDS, "rqd")


@query(f"with {INTERVALS} select hole_id, \"from\", \"to\", (\"from\" + \"to\") * 0.5 mid, concat('logged ', geology_code) geology_code, concat('logged ', geology_code) comments from fx_intervals")
def load_geology(s: SparkSession, d: str) -> DataFrame:
    """The code is filled from the comments where its column is absent; overlaps would fail."""
    i = fx.intervals(s, d)
    table = i.select(F.col("hole_id").alias("HoleId"), F.col("from").alias("FromDepth"), F.col("to").alias("ToDepth"),
        F.concat(F.lit("logged "), "geology_code").alias("Geology Comment"))
    return loaders.load_geology(s, table, keep_all=False)


@query(f"""with {raw.LINES} select hole hole_id, (l_linenumber - 1) * cast(2.0 as double) "from", l_linenumber * cast(2.0 as double) "to", {", ".join(f"arg_min(l_linestatus, rid) filter (where l_returnflag = '{c}') code_{c.lower()}" for c in "ANR")}
from rl group by hole, l_linenumber""")
def load_long_geology(s: SparkSession, d: str) -> DataFrame:
    """Long geology: codes with repeated values, the first in source order counts."""
    long = raw.lines(s, d).select(F.col("hole").alias("HoleId"), ((F.col("l_linenumber") - 1) * F.lit(2.0)).alias("from_depth"),
        (F.col("l_linenumber") * F.lit(2.0)).alias("to_depth"), F.col("l_returnflag").alias("lith_code"),
        F.col("l_linestatus").alias("value"), ROW)
    return loaders.load_geology(s, long, flat=False).select("hole_id", "from", "to", F.col("A").alias("code_a"), F.col("N").alias("code_n"),
        F.col("R").alias("code_r"))


@query(f"""with {INTERVALS}, k as (select *, cast(substr(hole_id, 3) as bigint) % 3 q from fx_intervals)
select hole_id, "from", "to", ("from" + "to") * 0.5 mid, case when q = 1 then concat('d', geology_code) else geology_code end geology_code, case when q = 0 then geology_code else concat('d', geology_code) end geology_description from k""")
def load_described_geology(s: SparkSession, d: str) -> DataFrame:
    """The other dialect: code and description fill each other."""
    i = fx.intervals(s, d).withColumn("q", F.substring("hole_id", 3, 20).cast("long") % 3)
    table = i.select("hole_id", "from", "to", F.when(F.col("q") == 1, " ").otherwise(F.col("geology_code")).alias("Lith1"),
        F.when(F.col("q") != 0, F.concat(F.lit("d"), "geology_code")).alias("Description"))
    return loaders.load_geology(s, table, js=True, keep_all=False)


@query(f"with {raw.RAW_SURVEYS} select hole_id, cast(rid as double) as \"order\", azimuth x, dip y, case when m = 12 then cast(0 as double) else depth end z from rs where m <> 7 and m <> 11")
def load_points(s: SparkSession, d: str) -> DataFrame:
    """Points of holes that are desurveyed already."""
    t = raw.surveys(s, d).withColumn("m", F.floor(F.col(ROW) / 1_000_000_000_000) % 50)
    table = t.select(F.when(F.col("m") == 7, " ").otherwise(F.col("HoleId")).alias("hole id"), F.col("Az").cast("double").alias("x"),
        F.col("DIP").cast("double").alias("y"), F.when(F.col("m") == 12, "?").when(F.col("m") != 11, F.col("SurveyDepth")).alias("z"), ROW)
    return loaders.load_points(s, table).drop(ROW)


UNIFIED = f"""{raw.raw_assays(False)}, {raw.RAW_STRUCTURES}, un as (
  select hole hole_id, a "from", b "to", (a + b) * 0.5 mid, (a + b) * 0.5 depth, null::double dip, 'assay' src, 0 part, rid from ra where hole is not null and b > a
  union all select hole_id, null, null, null, depth, dip, 'structural', 1, event_id from rt where hole_id is not null and depth is not null
  union all select hole, a, b, (a + b) * 0.5, (a + b) * 0.5, null, 'geology', 2, rid from ra where hole is not null and b > a)"""


def _unified(s: SparkSession, d: str) -> DataFrame:
    table = raw.assays(s, d, False)
    return loaders.parse_unified(s, table.withColumn("dip", F.lit(1.0)), raw.structures(s, d), table.withColumnRenamed("Analyte", "Lith1"))


@query(f"with {UNIFIED} select hole_id, {r('\"from\"', '\"from\"')}, {r('\"to\"', '\"to\"')}, {r('mid', 'mid')}, {r('depth', 'depth')}, dip, src data_source from un")
def unified_three_sources(s: SparkSession, d: str) -> DataFrame:
    """Assays, structures and geology by name; angles come from structures only."""
    return rounded(_unified(s, d).select("hole_id", *BOUNDS, "depth", "dip", F.col("_source").alias("data_source")), *BOUNDS, "depth")


@query(f"with {UNIFIED} select hole_id, count(*) n, string_agg(concat(src, ':', rid), ',' order by part, case when part <> 1 then \"from\" end, rid) shown from un group by hole_id")
def unified_holes(s: SparkSession, d: str) -> DataFrame:
    """Rows of each hole: those of assays by depth, then structures in source order, then geology."""
    rows = _unified(s, d)
    parts = [payload.rows_by_hole(rows.filter(F.col("_part") == k), ["_source"], ["from", ROW] if k != 1 else [ROW]) for k in (0, 1, 2)]
    plain = [p.select("hole_id", F.transform("rows",
        lambda x: F.concat(x["_source"], F.lit(":"), x[ROW].cast("string"))).alias("rows")) for p in parts]
    holes = payload.merge_holes(payload.merge_holes(plain[0], plain[1]), plain[2])
    return holes.select("hole_id", F.size("rows").cast("long").alias("n"), F.array_join("rows", ",").alias("shown"))


@query(f"""with {raw.raw_assays()}, {raw.RAW_STRUCTURES}, u as (
  select hole hole_id, a, b, null::varchar note, 'assay' data_source from ra union all select coalesce(hole_id, ''), depth - 0.05, depth + 0.05, event_type, 'structure' from rt)
select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, note structcomment, data_source from u""")
def striplog_rows(s: SparkSession, d: str) -> DataFrame:
    assays = ingest.coerce_numeric(ingest.standardize(raw.assays(s, d)), ["from", "to"])
    structures = ingest.standardize(raw.structures(s, d).withColumnRenamed("Type", "comments"))
    return rounded(loaders.striplog_rows(assays, structures).select("hole_id", "from", "to", "structcomment", "data_source"), "from", "to")


@query(f"""with {INTERVALS}, n as (select distinct hole_id from fx_intervals), k as (select hole_id, row_number() over (order by case when hole_id = (select max(hole_id) from n) then 0 else 1 end, hole_id) - 1 place from n)
select hole_id, cast(place as int) place, 'au_ppm' property, 'line' chart from k where place < 4""")
def assay_state(s: SparkSession, d: str) -> DataFrame:
    """What a grid of four logs shows first: the focused hole and the next ones, the default property and its chart."""
    table = loaders.parse_assays(s, fx.intervals(s, d))
    types = columns.classify_typed(table)
    name = columns.default_property(types)
    holes = loaders.hole_ids(table, True, columns.NO_VALUES)
    focus = holes.agg(F.max("hole_id")).head()[0]
    chart = columns.chart_for(name, types, default=columns.default_chart(types[name]))
    return payload.focused_holes(holes, focus, most=4).select("hole_id", F.col("place").cast("int").alias("place"),
        F.lit(name).alias("property"), F.lit(chart).alias("chart"))


@query(f"""with {INTERVALS}, {STRUCTURES} select 'assays' "table", cast(count(*) as bigint) n from fx_intervals union all select 'collars', 0 union all select 'surveys', 0 union all select 'structures', count(*) from fx_structures
union all select 'geology', 0 union all select 'geotechnical', 0""")
def dataset_tables(s: SparkSession, d: str) -> DataFrame:
    """All six tables of a data set; absent ones are empty."""
    tables = loaders.Dataset(assays=fx.intervals(s, d), structures=fx.structures(s, d)).tables(s)
    counts = [t.agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f"""with {traces("minimum_curvature")}, {INTERVALS}, im as (select *, ("from" + "to") * 0.5 mid from fx_intervals), {nearest("im", "mid")}
select nv.hole_id, "from", "to", {POSITION}, project_id from nv left join (select hole_id h, project_id from fx_collars) on h = nv.hole_id and easting is not null""")
def located_assays_of_projects(s: SparkSession, d: str) -> DataFrame:
    """End to end: collars and surveys to traces, assays placed on them, projects of their collars."""
    out = loaders.located_assays(ingest.with_mid(fx.intervals(s, d)), fx.collars(s, d), fx.surveys(s, d), step=STEP)
    return rounded(out.select("hole_id", "from", "to", *XYZ, "project_id"), *XYZ)


# Readers and sinks


@query(f'with {INTERVALS} select hole_id, "from", "to", {r("au_ppm", "au_ppm")}, geology_code from fx_intervals')
def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Written as CSV and read again with inferred types."""
    path = sinks.write_csv(fx.intervals(s, d), sinks.shared_path(s, "intervals-csv"))
    return rounded(ingest.read_table(s, path, "csv").drop(ROW), "au_ppm")


@query(ORACLES["csv_round_trip"])
def parquet_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = sinks.shared_path(s, "intervals-parquet")
    fx.intervals(s, d).write.parquet(path)
    return rounded(ingest.read_table(s, path, "parquet").drop(ROW), "au_ppm")


@query(f'with {INTERVALS} select hole_id, "from", "to", {r("au_ppm", "au_ppm")}, geology_code, \'table\' via from fx_intervals union all select hole_id, "from", "to", {r("au_ppm", "au_ppm")}, geology_code, \'query\' from fx_intervals where au_ppm > 5')
def sql_sources(s: SparkSession, d: str) -> DataFrame:
    """A table and a query of the catalog."""
    fx.intervals(s, d).createOrReplaceTempView("orespark_intervals")
    table = ingest.read_table(s, "", "sql", table="orespark_intervals").drop(ROW).withColumn("via", F.lit("table"))
    found = ingest.read_table(s, "", "sql", query="select * from orespark_intervals where au_ppm > 5").drop(ROW).withColumn("via",
        F.lit("query"))
    return rounded(table.unionByName(found), "au_ppm")


TRACES = f"""{COLLARS}, {SURVEYS}, xt as (select s.hole_id, case when cast(substr(s.hole_id, 3) as bigint) % 2 = 0 then concat('C', substr(s.hole_id, 3)) else '' end company, project_id, depth md, -depth z, elevation,
  (northing - 6900000) / cast(100000 as double) - 32 clat, (easting - 500000) / cast(5000 as double) + 116.5 clng from fx_surveys s join fx_collars using (hole_id)),
xl as (select *, clat + md / cast(1000000 as double) lat, clng lng from xt)"""


def _utm(rows: str, out: str, lat: str, lng: str) -> str:
    """CTE `out`: rows with easting e and northing n in zone 50 south."""
    return f"""{out}_d as (select *, 1 / (2 * cast(298.257222101 as double) - 1) nn, sin(radians({lat})) s, radians({lng} - 117) w from {rows}),
{out}_t as (select *, 2 * sqrt(nn) / (1 + nn) ee, 0.9996 * cast(6378137 as double) / (1 + nn) * (1 + nn * nn / 4 + nn * nn * nn * nn / 64) q from {out}_d),
{out}_u as (select *, sinh(atanh(s) - ee * atanh(ee * s)) t from {out}_t),
{out}_p as (select *, nn / 2 - 2 * nn * nn / 3 + 5 * nn * nn * nn / 16 a1, 13 * nn * nn / 48 - 3 * nn * nn * nn / 5 a2, 61 * nn * nn * nn / 240 a3, atan2(t, cos(w)) xi, atanh(sin(w) / sqrt(1 + t * t)) eta from {out}_u),
{out} as (select * exclude (nn, s, w, ee, q, t, a1, a2, a3, xi, eta), 500000 + q * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) e,
  10000000 + q * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) n from {out}_p)"""


@query(f"""with {TRACES}, xc as (select distinct hole_id, clat, clng from xl), {_utm("xc", "xm", "clat", "clng")}, {_utm("xl", "xp", "lat", "lng")},
o as (select *, row_number() over (partition by hole_id order by md) - 1 i, count(*) over (partition by hole_id) k from xp)
select case when company <> '' then company else hole_id end hole_id, nullif(company, '') company_hole_id, project_id project, cast(i as int) as "order", md, round(e - (select avg(e) from xm), 3) + cast(0 as double) x, round(n - (select avg(n) from xm), 3) + cast(0 as double) y, z + elevation z from o where k >= 2""")
def trace_csv(s: SparkSession, d: str) -> DataFrame:
    """Traces projected about the mean of the collars, written as CSV and read again."""
    rows = fx.surveys(s, d).join(fx.collars(s, d),
        "hole_id").withColumns({"collar_lat": (F.col("northing") - 6.9e6) / 1e5 - 32, "collar_lng": (F.col("easting") - 5e5) / 5e3 + 116.5,
        "n": F.substring("hole_id", 3, 20).cast("long")})
    rows = rows.select("hole_id", F.when(F.col("n") % 2 == 0, F.concat(F.lit(" C"), "n")).alias("company_hole_id"),
        F.col("project_id").alias("project"), F.col("depth").alias("md"), (F.col("collar_lat") + F.col("depth") / 1e6).alias("lat"),
        F.col("collar_lng").alias("lng"), (-F.col("depth")).alias("z"), "collar_lat", "collar_lng",
        F.col("elevation").alias("collar_elevation"))
    path = sinks.write_csv(sinks.export_rows(rows, 50), sinks.shared_path(s, "traces-csv"))
    out = ingest.read_table(s, path, "csv").drop(ROW)
    return out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("x", "y")})


@query(f"with {raw.RAW_SURVEYS}, {raw.RAW_COLLARS} select s.hole_id, depth, -depth + coalesce(c.elevation, 0) z from rs s left join rc c on lower(s.hole_id) = c.hole_id and cast(substr(s.hole_id, 3) as bigint) % 3 <> 0")
def elevation_corrected_traces(s: SparkSession, d: str) -> DataFrame:
    """Traces raised by the elevation of their collar (of two rows of a collar the last), 0 without one; written and read again."""
    rows = raw.surveys(s, d).select(F.trim("HoleId").alias("hole_id"), F.col("SurveyDepth").cast("double").alias("depth"),
        (-F.col("SurveyDepth").cast("double")).alias("z"))
    tops = raw.collars(s, d).filter(F.substring(F.trim("HoleID"), 3, 20).cast("long") % 3 != 0).select(F.regexp_replace("HoleID", "dh",
        "d h ").alias("hole_id"), F.col("RL").cast("double").alias("elevation"), ROW)
    twice = tops.withColumns({"elevation": F.lit(-1.0), ROW: F.col(ROW) - 1_000_000_000}).unionByName(tops)
    path = sinks.write_csv(enrich.with_collar_elevation(rows, twice), sinks.shared_path(s, "corrected-csv"))
    return ingest.read_table(s, path, "csv").drop(ROW)


@query(f"""with {INTERVALS} select hole_id, to_json(struct_pack(hole_id := hole_id, n := count(*), geology_code := min(geology_code))) payload from fx_intervals group by hole_id""")
def json_payload(s: SparkSession, d: str) -> DataFrame:
    """Rows as JSON texts, written and read again."""
    rows = fx.intervals(s, d).groupBy("hole_id").agg(F.count("*").alias("n"), F.min("geology_code").alias("geology_code"))
    path = sinks.write_json(sinks.json_payload(rows, "hole_id"), sinks.shared_path(s, "payload-json"))
    return ingest.read_table(s, path, "json", schema="hole_id string, payload string").drop(ROW)


# Blocks and meshes


@query(f"with {raw.RAW_BLOCKS} select rid block_id, x, y, z, cast(10 as double) dx, cast(10 as double) dy, cast(10 as double) dz, grade \"Grade\", rock \"Rock\" from rk")
def load_blocks(s: SparkSession, d: str) -> DataFrame:
    """Geometry as numbers under its names, other columns as they are; blocks without a centre stay."""
    return blockmodel.load_blocks(s, raw.blocks(s, d)).select(F.col(ROW).alias("block_id"), *blockmodel.GEOMETRY, "Grade", "Rock")


@query(f"with {raw.RAW_BLOCKS} select cast(count(*) as bigint) n, sum(cast(1000 as double)) volume from rk where x is not null")
def load_placed_blocks(s: SparkSession, d: str) -> DataFrame:
    """The other dialect drops blocks without a centre."""
    placed = blockmodel.load_blocks(s, raw.blocks(s, d), drop_unplaced=True)
    return placed.agg(F.count("*").alias("n"), F.sum(F.col("dx") * F.col("dy") * F.col("dz")).alias("volume"))


@query(f"""with {raw.RAW_BLOCKS} select 'Grade' property, true "numeric", min(grade) "min", max(grade) "max", null::bigint n_categories from rk union all select 'Code', false, null, null, count(distinct code) from rk
union all select 'Rock', false, null, null, count(distinct rock) from rk""")
def block_properties(s: SparkSession, d: str) -> DataFrame:
    """Which attributes are numeric: all their values must be numbers."""
    return blockmodel.property_table(blockmodel.load_blocks(s, raw.blocks(s, d)), ["Grade", "Code", "Rock"])


@query(f"""with {raw.RAW_BLOCKS}, f as (select code, min(rid) o from rk group by code), p as (select code "value", cast(rank() over (order by o) - 1 as int) place, count(*) over () n from f)
select "value", place, {r("place / cast(n as double) * 360", "hue")} from p""")
def block_categories(s: SparkSession, d: str) -> DataFrame:
    """Categories in order of appearance, and their hues."""
    from ..functions import colours

    places = blockmodel.property_categories(blockmodel.load_blocks(s, raw.blocks(s, d)), "Code")
    return rounded(places.select("value", "place", colours.category_hue(F.col("place"), places.count()).alias("hue")), "hue")


@query(f"""with {BLOCKS} select cast((select sum(dx * dy * dz) from fx_blocks where grade > 2 and rock_type = 'PROMO') as double) text_query, cast((select sum(dx * dy * dz) from fx_blocks where grade > density) as double) callable,
cast((select sum(dx * dy * dz) from fx_blocks where rock_type in ('PROMO', 'SMALL') and grade <= 3) as double) mapping, cast(0 as double) unknown_excludes, cast((select sum(dx * dy * dz) from fx_blocks) as double) unknown_ignored""")
def criteria_kinds(s: SparkSession, d: str) -> DataFrame:
    """Volumes by a query string, a function, a mapping, and a mapping with an unknown column in both dialects."""
    b = fx.blocks(s, d)
    kinds = {
        "text_query": "grade > 2 and rock_type == 'PROMO'", "callable": lambda df: df["grade"] > df["density"],
        "mapping": {"rock_type": {"in": ["PROMO", "SMALL"]}, "grade": {"lte": 3.0}, "density": None},
    }
    parts = {n: blockmodel.criteria_column(b, c) for n, c in kinds.items()}
    parts |= {f"unknown_{n}": blockmodel.criteria_column(b, {"nothing": 1}, unknown_excludes=x) for n,
        x in (("excludes", True), ("ignored", False))}
    size = F.col("dx") * F.col("dy") * F.col("dz")
    return b.agg(*[F.coalesce(F.sum(F.when(c, size)), F.lit(0.0)).alias(n) for n, c in parts.items()])


@query(f"""with {BLOCKS}, b as (select min(x - dx / 2) x0, max(x + dx / 2) x1, min(y - dy / 2) y0, max(y + dy / 2) y1 from fx_blocks)
select 'given' name, x0 min_x, x1 max_x, y0 min_y, y1 max_y, cast(10 as double) max_dx, cast(1 as double) min_dx, concat_ws(' ', x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) outline from b""")
def block_metadata(s: SparkSession, d: str) -> DataFrame:
    """Metadata of a model: what a JSON text gives wins, the rest is computed from the blocks."""
    given = blockmodel.load_metadata('{"name": "given", "min_block_size": {"dx": 1.0, "dy": 1.0, "dz": 1.0}}')
    m = blockmodel.BlockModel(fx.blocks(s, d), given).metadata()
    ring = " ".join(str(float(v)) for p in m["outline_2d"]["coordinates"][0] for v in p)
    row = (m["name"], *(m["bbox_3d"][k] for k in ("min_x", "max_x", "min_y", "max_y")), m["max_block_size"]["dx"],
        m["min_block_size"]["dx"], ring)
    return s.createDataFrame([row],
        "name string, min_x double, max_x double, min_y double, max_y double, max_dx double, min_dx double, outline string")


MESHES = f"""{BLOCKS}, mk as (select block_id, block_id % 10 q, x, y, z from fx_blocks)"""


def _shell() -> Column:
    """A tetrahedron for a block; some are broken."""
    q, at = F.col("block_id") % 10, [F.col(c) for c in "xyz"]
    corner = lambda i, j, k: F.array(at[0] + i * 5.0, at[1] + j * 5.0, at[2] + k * 5.0)
    flat = F.when(q == 1, corner(2, 0, 0)).otherwise(corner(0, 1, 0))
    points = F.array(corner(0, 0, 0), corner(1, 0, 0), flat, F.when(q == 2, F.array(at[0], at[1])).otherwise(corner(0, 0, 1)))
    faces = F.array(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(0), F.lit(1), F.lit(3)),
        F.when(q == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(2), F.when(q == 4, 4).otherwise(3))))
    return F.struct(F.col("block_id").cast("string").alias("id"), F.col("rock_type").alias("name"),
        F.when(q == 5, F.create_map(F.lit("class"), F.col("rock_type"))).alias("attributes"), points.alias("vertices"),
        faces.alias("triangles"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    """A document for each block."""
    return fx.blocks(s, d).select(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit("m").alias("units"),
        F.array(_shell()).alias("blocks"))).alias("value"))


@query(f"""with {MESHES} select cast(block_id as varchar) id, case q when 1 then 'zero_area_triangle' when 2 then 'vertices_shape' when 3 then 'triangles_shape' else 'index_out_of_range' end issue from mk where q in (1, 2, 3, 4)""")
def mesh_issues(s: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON, read again and checked."""
    path = sinks.shared_path(s, "meshes-json")
    _documents(s, d).write.text(path)
    return mesh.validate_grade_blocks(mesh.load_grade_blocks(s, path, lines=True))


@query(ORACLES["mesh_issues"])
def large_mesh_issues(s: SparkSession, d: str) -> DataFrame:
    """One document with all meshes, in one file, read mesh by mesh."""
    blocks = fx.blocks(s, d)
    first = blocks.agg(F.min("block_id")).head()[0]
    line = F.concat(F.when(F.col("block_id") == first, "").otherwise(","), F.to_json(_shell()))
    rows = blocks.select(F.lit(1).alias("part"), "block_id", line.alias("value"))
    ends = s.createDataFrame([(0, 0, '{"schema_version": "1.0", "blocks": ['), (2, 0, '], "units": "m"}')], "part int, block_id long, value string")
    path = sinks.shared_path(s, "mesh-document")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("part", "block_id").select("value").write.text(path)
    return mesh.validate_grade_blocks(mesh.load_large_grade_blocks(s, path))


@query(f"""with {MESHES} select cast(block_id as varchar) id, cast(case when q = 2 then 11 else 12 end as bigint) n_positions, cast(case when q = 3 then 8 else 9 end as bigint) n_indices, case when q = 2 then 4 * x + 4 * y + 3 * z + 10 when q = 1 then 4 * (x + y + z) + 20 else 4 * (x + y + z) + 15 end total from mk""")
def mesh_arrays(s: SparkSession, d: str) -> DataFrame:
    """Flat position and index arrays of meshes parsed from texts."""
    flat = mesh.flat_geometry(mesh.parse_grade_blocks_text(_documents(s, d), "value"))
    return flat.select("id", F.size("positions").cast("long").alias("n_positions"), F.size("indices").cast("long").alias("n_indices"),
        F.aggregate("positions", F.lit(0.0), lambda a, x: a + x).alias("total"))


# Columns


@query("""select unnest(['hole_id', 'from', 'to', 'au', 'lith', 'comments', 'dip', 'empty', 'flag', 'sample']) "column", unnest(['hidden', 'hidden', 'hidden', 'numeric', 'categorical', 'comment', 'tadpole', 'hidden', 'categorical', 'numeric']) python,
unnest(['hidden', 'hidden', 'hidden', 'categorical', 'categorical', 'comment', 'numeric', 'hidden', 'categorical', 'numeric']) typed, unnest(['bar', 'bar', 'bar', 'bar', 'categorical', 'comment', 'tadpole', 'bar', 'categorical', 'bar']) first_chart,
unnest(['markers+line', 'markers+line', 'markers+line', 'categorical', 'categorical', 'comment', 'line', 'markers+line', 'categorical', 'line']) default_chart from (select count(*) from lineitem)""")
def column_types(s: SparkSession, d: str) -> DataFrame:
    """Display types of all columns in both dialects (one aggregate each), the first chart on offer and the default one."""
    t = raw.lines(s, d).select(
        F.col("hole").alias("hole_id"), F.lit(0.0).alias("from"), F.lit(1.0).alias("to"), F.when(F.col("m") == 3, "1.5").alias("au"),
        F.when(F.col("m") == 4, F.col("l_returnflag")).alias("lith"),
        F.when(F.col("m") == 5, "seen").alias("comments"), F.col("l_tax").alias("dip"), F.lit(None).cast("string").alias("empty"),
        F.when(F.col("m") == 6, "yes").otherwise(" ").alias("flag"), F.col("l_linenumber").alias("sample"),
    )
    python, typed = columns.classify_columns(t), columns.classify_typed(t)
    first = {c: (columns.available_charts(k) or columns.chart_options("none"))[0] for c, k in python.items()}
    rows = [(c, python[c], typed[c], first[c], columns.default_chart(typed[c])) for c in t.columns]
    return s.createDataFrame(rows, "column string, python string, typed string, first_chart string, default_chart string")


@query("""with o as (select count(*) n from orders), l as (select count(*) n from lineitem), e as (select count(*) n from events)
select 'collars' "table", c "column", c in ('hole_id', 'project_id', 'elevation', 'easting', 'northing', 'crs') present, n n_rows, case when c in ('hole_id', 'project_id', 'elevation', 'easting', 'northing', 'crs') then n else 0 end n_values from o, (select unnest(['hole_id', 'project_id', 'latitude', 'longitude', 'elevation', 'easting', 'northing', 'crs']) c)
union all select 'surveys', c, c <> 'to', n, case when c <> 'to' then n else 0 end from l, (select unnest(['hole_id', 'depth', 'to', 'azimuth', 'dip']) c)
union all select 'structures', c, c <> 'comments', n, case when c = 'comments' then 0 when c = 'depth' then (select count(*) from events where event_id % 31 <> 0) when c = 'alpha' then (select count(*) from events where event_id % 3 = 0) when c = 'beta' then (select count(*) from events where event_id % 6 = 0) else n end from e, (select unnest(['hole_id', 'depth', 'dip', 'azimuth', 'alpha', 'beta', 'comments']) c)""")
def missing_columns(s: SparkSession, d: str) -> DataFrame:
    """Columns of the model in each table of a data set: whether the table has them, and how many of its rows have a value."""
    tables = {"collars": (raw.collars(s, d), [c for c in COLLAR if c != "datasource_hole_id"]), "surveys": (raw.surveys(s, d), SURVEY), "structures": (raw.structures(s, d), STRUCTURE)}
    parts = [validate.column_presence(ingest.standardize(t), wanted).select(F.lit(n).alias("table"), "*") for n, (t, wanted) in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""with {raw.LINES} select hole hole_id, coalesce(case when m = 3 then 'early' end, l_returnflag) geology_code, case when m = 4 then null else l_linestatus end last_code, rid from rl""")
def standardized_names(s: SparkSession, d: str) -> DataFrame:
    """Several sources of one column: the first value counts, in the other dialect the last column."""
    t = raw.lines(s, d).select(F.col("hole").alias("HOLE-ID"), F.when(F.col("m") == 3, "early").alias("Lith1"),
        F.col("l_returnflag").alias(" Rock1"), F.when(F.col("m") != 4, F.col("l_linestatus")).alias("lithology"), ROW)
    one = ingest.standardize(t).select("hole_id", "geology_code", F.col(ROW).alias("rid"))
    two = ingest.standardize(t, last_wins=True).select(F.col("geology_code").alias("last_code"), F.col(ROW).alias("rid_2"),
        F.col("hole_id").alias("hole_2"))
    return one.join(two, (F.col("rid") == F.col("rid_2")) & (F.col("hole_id") == F.col("hole_2"))).drop("rid_2", "hole_2")


@query(f"""with {raw.LINES} select hole hole_id, rid, case when m = 3 then 'b' else 'A' end low, case when m <> 0 then {r("v0", "x").removesuffix(" as x")} end number, case when m = 5 then l_linestatus when m = 6 then 'z' else l_returnflag end first_value from rl""")
def scalar_reads(s: SparkSession, d: str) -> DataFrame:
    """Lower-cased names, coerced numbers (infinity is none), first values that aren't empty."""
    t = raw.lines(s, d).select("hole", F.col(ROW).alias("rid"), F.when(F.col("m") == 3, "b").otherwise("A").alias(" LOW "),
        F.when(F.col("m") == 0, "-Infinity").otherwise((F.col("l_discount") * 100).cast("double").cast("string")).alias("Number"),
                              F.when(F.col("m") == 5, "").when(F.col("m") != 6, F.col("l_returnflag")).alias("a"),
                              F.when(F.col("m") != 6, F.col("l_linestatus")).alias("b"), F.lit("z").alias("c"))
    low = ingest.coerce_numeric(ingest.lower_keys(t), ["number", "absent"])
    return rounded(low.select(F.col("hole").alias("hole_id"), "rid", "low", "number",
        ingest.first_value([F.col(c) for c in "abc"]).alias("first_value")), "number")
