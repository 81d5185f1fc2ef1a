"""Hole traces from collars and surveys.

Every sub-step of a station pair adds the same vector, so a trace is a running sum over stations (one window per
hole) and an explode of each pair into its steps; no row depends on the step before it.

The vertical component is -sin(dip): with dips negative downwards, elevation rises down the hole. z_down=True turns it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW
from ..sources.ingest import number, ref

METHODS = ("minimum_curvature", "tangential", "balanced_tangential")


def direction(azimuth: Column, dip: Column) -> tuple[Column, Column, Column]:
    """Unit vector (east, north, up as -sin dip) of angles in degrees."""
    a, d = F.radians(azimuth), F.radians(dip)
    return F.cos(d) * F.sin(a), F.cos(d) * F.cos(a), -F.sin(d)


def displacement(length: Column, az0: Column, dip0: Column, az1: Column, dip1: Column, method: str) -> list[Column]:
    """Vector of a whole station pair."""
    if method == "tangential":
        return [length * c for c in direction(az0, dip0)]
    if method == "balanced_tangential":
        return [length * c for c in direction((az0 + az1) / 2, (dip0 + dip1) / 2)]
    start, end = direction(az0, dip0), direction(az1, dip1)
    dot = start[0] * end[0] + start[1] * end[1] + start[2] * end[2]
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    ratio = F.when(bend > 1e-6, F.tan(bend / 2) * 2 / bend).otherwise(1.0)
    return [length * 0.5 * (s + e) * ratio for s, e in zip(start, end, strict=True)]


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key in source order (by all columns where there is no row id)."""
    others = [c for c in df.columns if c != key]
    order = [c for c in [ROW, *others] if c in others]
    row = F.struct(*[ref(c) for c in dict.fromkeys(order)])
    return df.groupBy(ref(key)).agg(F.min(row).alias("_r")).select(ref(key), "_r.*")


def first_and_last(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, first and last value of each key's rows in source order, and their number n: in one shuffle, which carries a row once."""
    at = df.select(ref(key), ref(value).alias("_v"), ROW).repartition(ref(key)).groupBy(ref(key))
    return at.agg(F.min_by("_v", ROW).alias("first"), F.max_by("_v", ROW).alias("last"), F.count("*").alias("n"))


def station_pairs(collars: DataFrame, surveys: DataFrame, step: float = 1.0, method: str = "minimum_curvature", depth_col: str = "depth",
    z_down: bool = False, xyz: tuple[str, str, str] = ("easting", "northing", "elevation")) -> DataFrame:
    """One row for each station: its number n in the hole, md, angles, position x/y/z, and the way to the next one: length,
    steps, displacement sx/sy/sz and angles az1/dip1 (nothing, for the last station and where the next one isn't deeper).

    The vertices of a trace are k = 0 (of n = 1 only) to steps of every pair: `vertex` gives any of them by arithmetic.
    Station rows without numeric depth, azimuth or dip are left out, as are collars without surveys and surveys without a
    collar. Missing collar coordinates count as 0.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    step = step if step > 0 else 1.0
    tops = first_rows(collars.select(*[c for c in collars.columns if c in ("hole_id", *xyz, ROW)]), "hole_id")
    tops = tops.select("hole_id", *[(F.coalesce(number(F.col(c)), F.lit(0.0)) if c in tops.columns else F.lit(0.0)).alias(n) for c,
        n in zip(xyz, ("_x", "_y", "_z"), strict=True)])
    stations = surveys.select("hole_id", number(ref(depth_col)).alias("md"), number(F.col("azimuth")).alias("az"),
        number(F.col("dip")).alias("dip"), *([ROW] if ROW in surveys.columns else [])).dropna(subset=["hole_id", "md", "az", "dip"])
    order = Window.partitionBy("hole_id").orderBy("md", *([ROW] if ROW in stations.columns else ["az", "dip"]))
    pairs = stations.withColumns({"n": F.row_number().over(order), **{f"{c}1": F.lead(c).over(order) for c in ("md", "az", "dip")}})
    pairs = pairs.withColumn("length", F.coalesce(F.col("md1") - F.col("md"), F.lit(0.0)))
    moves = displacement(F.col("length"), *(F.col(c) for c in ("az", "dip", "az1", "dip1")), method)
    if z_down:
        moves[2] = -moves[2]
    deeper = F.col("length") > 0
    pairs = pairs.withColumns({"steps": F.when(deeper, F.greatest(F.lit(1), F.ceil(F.col("length") / step))).otherwise(0).cast("int"),
        **{f"s{a}": F.when(deeper, m).otherwise(0.0) for a, m in zip("xyz", moves, strict=True)}})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumns({f"o{a}": F.coalesce(F.sum(f"s{a}").over(before), F.lit(0.0)) for a in "xyz"})
    return pairs.join(tops, "hole_id").select("hole_id", "n", "md", "length", "steps", "az", "dip", "az1", "dip1",
        *[(F.col(f"_{a}") + F.col(f"o{a}")).alias(a) for a in "xyz"], "sx", "sy", "sz")


def vertex(k: Column, method: str, of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """md, easting, northing, elevation, azimuth, dip of the k-th step of a station pair; of: where the pair's columns are."""
    part = F.when(of("steps") > 0, k / of("steps")).otherwise(0.0)
    if method == "minimum_curvature":
        angles = [of(c) + F.coalesce(of(f"{c}1") - of(c), F.lit(0.0)) * part for c in ("az", "dip")]
    elif method == "tangential":
        angles = [of("az"), of("dip")]
    else:
        angles = [F.when(k == 0, of(c)).otherwise((of(c) + of(f"{c}1")) / 2) for c in ("az", "dip")]
    place = {n: of(a) + of(f"s{a}") * part for a, n in zip("xyz", ("easting", "northing", "elevation"), strict=True)}
    return {"md": of("md") + of("length") * part, **place, "azimuth": angles[0], "dip": angles[1]}


def desurvey_holes(collars: DataFrame, surveys: DataFrame, step: float = 1.0, method: str = "minimum_curvature", **options) -> DataFrame:
    """hole_id, md, easting, northing, elevation, azimuth, dip: vertices about every `step` along each hole (options:
    depth_col, z_down and xyz of station_pairs)."""
    pairs = station_pairs(collars, surveys, step, method, **options)
    low = F.when(F.col("n") == 1, 0).otherwise(1)
    rows = pairs.select("*", F.explode(F.when(F.col("steps") >= low, F.sequence(low, F.col("steps")))).alias("k"))
    return rows.select("hole_id", *[c.alias(n) for n, c in vertex(F.col("k"), method).items()])


def minimum_curvature(collars: DataFrame, surveys: DataFrame, step: float = 1.0, **options) -> DataFrame:
    return desurvey_holes(collars, surveys, step, "minimum_curvature", **options)


def tangential(collars: DataFrame, surveys: DataFrame, step: float = 1.0, **options) -> DataFrame:
    return desurvey_holes(collars, surveys, step, "tangential", **options)


def balanced_tangential(collars: DataFrame, surveys: DataFrame, step: float = 1.0, **options) -> DataFrame:
    return desurvey_holes(collars, surveys, step, "balanced_tangential", **options)


build_traces = minimum_curvature
M_PER_DEGREE = 111132.0
M_PER_DEGREE_EQUATOR = 111320.0


def inclination(dip: Column) -> Column:
    return F.least(F.lit(180.0), F.greatest(F.lit(0.0), dip + 90.0))


def station_traces(collars: DataFrame, surveys: DataFrame) -> DataFrame:
    """hole_id, md, x, y, z, lat, lng at the stations only, in metres about the first collar (by row id, else by hole id).

    Holes match by trimmed lower-case id. x sums the northward and y the eastward part, and the degrees add the collar's
    offset twice: kept as the source of these numbers has them.
    """
    key = F.lower(F.trim("hole_id"))
    tops = first_rows(collars.select(key.alias("hole_id"), number(F.col("latitude")).alias("lat0"),
        number(F.col("longitude")).alias("lng0"), *([ROW] if ROW in collars.columns else [])), "hole_id")
    origin = tops.agg(F.min_by(F.struct("lat0", "lng0"),
        F.col(ROW) if ROW in tops.columns else F.col("hole_id")).alias("o")).select(F.col("o.lat0").alias("rlat"),
        F.col("o.lng0").alias("rlng"))
    tops = tops.join(F.broadcast(origin))  # one row
    per_lng = F.lit(M_PER_DEGREE_EQUATOR) * F.cos(F.radians("rlat"))
    tops = tops.select("hole_id", "rlat", "rlng", ((F.col("lng0") - F.col("rlng")) * per_lng).alias("bx"),
        ((F.col("lat0") - F.col("rlat")) * M_PER_DEGREE).alias("by"))
    order = Window.partitionBy("hole_id").orderBy("md", "az", "dip")
    s = surveys.select(key.alias("hole_id"), *(number(F.col(a)).alias(b) for a,
        b in (("depth", "md"), ("azimuth", "az"), ("dip", "dip")))).dropna()
    s = s.withColumns({"inc": F.radians(inclination(F.col("dip"))), "a": F.radians("az")})
    s = s.withColumns({c + "0": F.lag(c).over(order) for c in ("md", "inc", "a")})
    length = F.col("md") - F.col("md0")
    dot = F.cos(F.col("inc0")) * F.cos(F.col("inc")) + F.sin(F.col("inc0")) * F.sin(F.col("inc")) * F.cos(F.col("a") - F.col("a0"))
    bend = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    half = F.when(bend > 1e-6, F.tan(bend / 2) * 2 / bend).otherwise(1.0) * length / 2
    sums = {
        "dx": half * (F.sin("inc0") * F.cos("a0") + F.sin("inc") * F.cos("a")),
        "dy": half * (F.sin("inc0") * F.sin("a0") + F.sin("inc") * F.sin("a")),
        "dz": half * (F.cos("inc0") + F.cos("inc")),
    }
    s = s.withColumns({k: F.sum(F.when(length > 0, v).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k,
        v in sums.items()})
    out = s.join(tops, "hole_id").withColumns({"x": F.col("bx") + F.col("dx"), "y": F.col("by") + F.col("dy")})
    return out.select("hole_id", "md", "x", "y", (-F.col("dz")).alias("z"),
        (F.col("rlat") + (F.col("by") + F.col("y")) / M_PER_DEGREE).alias("lat"),
        (F.col("rlng") + (F.col("bx") + F.col("x")) / per_lng).alias("lng"))
