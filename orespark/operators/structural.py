"""Structural geology and section geometry, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import number, ref


def plane_normal(dip: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Unit normal (east, north, up) of a plane from dip and dip direction in degrees."""
    d, a = F.radians(dip), F.radians(azimuth)
    return F.sin(a) * F.sin(d), F.cos(a) * F.sin(d), F.cos(d)


def turned(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def strike(azimuth: Column) -> Column:
    return turned(azimuth - 90.0)


def pole(dip: Column, azimuth: Column) -> tuple[Column, Column]:
    """Trend and plunge of the pole (trend is the strike)."""
    return strike(azimuth), F.lit(90.0) - dip


def normalize_dip_azimuth(df: DataFrame, dip_col: str = "dip", az_col: str = "azimuth") -> DataFrame:
    """Dip clamped to [0, 90], azimuth to [0, 360); nulls stay null."""
    dip = number(ref(dip_col))
    return df.withColumns({dip_col: F.when(dip.isNotNull(), F.least(F.lit(90.0), F.greatest(F.lit(0.0), dip))),
        az_col: turned(number(ref(az_col)))})


def with_plane_geometry(df: DataFrame, dip_col: str = "dip", az_col: str = "azimuth") -> DataFrame:
    """Adds normal_x/y/z, strike, pole_trend and pole_plunge."""
    dip, azimuth = number(ref(dip_col)), number(ref(az_col))
    normal = plane_normal(dip, azimuth)
    trend, plunge = pole(dip, azimuth)
    return df.withColumns({"normal_x": normal[0], "normal_y": normal[1], "normal_z": normal[2], "strike": strike(azimuth),
        "pole_trend": trend, "pole_plunge": plunge})


def tadpole_tails(df: DataFrame, dip_col: str = "dip", az_col: str = "azimuth", scale: float = 10.0) -> DataFrame:
    """Adds tail_x, tail_y of length scale * |dip| / 90 towards the azimuth."""
    length, a = F.abs(number(ref(dip_col))) / 90.0 * scale, F.radians(number(ref(az_col)))
    return df.withColumns({"tail_x": length * F.sin(a), "tail_y": length * F.cos(a)})


def dip_vectors(df: DataFrame, dip_col: str = "dip") -> DataFrame:
    """Adds tail_dx = cos(dip), tail_dy = sin(dip)."""
    d = F.radians(number(ref(dip_col)))
    return df.withColumns({"tail_dx": F.cos(d), "tail_dy": F.sin(d)})


def strike_dip_symbols(df: DataFrame, x_col: str = "easting", y_col: str = "northing", size: float = 10.0) -> DataFrame:
    """Adds symbol: the strike line through the point (half length `size`) and the dip tick (0.4 * size * dip / 90)."""
    x, y, azimuth = ref(x_col), ref(y_col), number(F.col("azimuth"))
    s, d = F.radians(strike(azimuth)), F.radians(azimuth)
    tick = F.lit(0.4 * size) * number(F.col("dip")) / 90.0
    return df.withColumns({
        "x0": x - F.sin(s) * size, "y0": y - F.cos(s) * size, "x1": x + F.sin(s) * size, "y1": y + F.cos(s) * size,
        "tick_x": x + F.sin(d) * tick, "tick_y": y + F.cos(d) * tick,
    })


def _cross(a: str, b: str) -> dict[str, Column]:
    p, q = ([F.col(f"{v}{x}") for x in "xyz"] for v in (a, b))
    return {"x": p[1] * q[2] - p[2] * q[1], "y": p[2] * q[0] - p[0] * q[2], "z": p[0] * q[1] - p[1] * q[0]}


def _with_vector(df: DataFrame, name: str, parts: dict[str, Column], fallback: tuple[float, float, float] | None = None) -> DataFrame:
    """df with name + x/y/z; as a unit vector (fallback where it has no length) if a fallback is given."""
    df = df.withColumns({f"{name}{a}": c for a, c in parts.items()})
    if fallback is None:
        return df
    size = F.sqrt(sum(F.col(f"{name}{a}") * F.col(f"{name}{a}") for a in "xyz"))
    return df.withColumn("_size", size).withColumns({f"{name}{a}": F.when(F.col("_size") > 0,
        F.col(f"{name}{a}") / F.col("_size")).otherwise(v) for a, v in zip("xyz", fallback, strict=True)}).drop("_size")


def alpha_beta_normals(df: DataFrame, hole: tuple[Column, Column, Column], alpha_col: str = "alpha", beta_col: str = "beta",
    zero_at: str = "bottom", clockwise: bool = True) -> DataFrame:
    """Adds normal_x/y/z: the unit normal of a plane from its core angles and the hole's direction.

    Frame: right = up x hole (up is z, or y for a nearly vertical hole), bottom = hole x right. The reference line is
    turned by beta (0 where missing) about the hole, then tilted towards the hole by alpha.
    """
    names = df.columns
    df = _with_vector(df, "_d", dict(zip("xyz", hole, strict=True)), (0.0, 0.0, -1.0))
    steep = F.abs("_dz") > 0.99
    df = _with_vector(df, "_u", {"x": F.lit(0.0), "y": F.when(steep, 1.0).otherwise(0.0), "z": F.when(steep, 0.0).otherwise(1.0)})
    df = _with_vector(df, "_r", _cross("_u", "_d"), (1.0, 0.0, 0.0))
    df = _with_vector(df, "_b", _cross("_d", "_r"), (0.0, 1.0, 0.0))
    start = "_b" if zero_at == "bottom" else "_r"
    df = _with_vector(df, "_c", _cross("_d", start))
    beta = F.coalesce(number(ref(beta_col)), F.lit(0.0))
    df = df.withColumns({"_turn": F.radians(beta if clockwise else -beta), "_tilt": F.radians(F.lit(90.0) - number(ref(alpha_col)))})
    around = {a: F.cos("_tilt") * (F.col(f"{start}{a}") * F.cos("_turn") + F.col(f"_c{a}") * F.sin("_turn")) + F.sin("_tilt") * F.col(f"_d{a}") for a in "xyz"}
    df = _with_vector(df, "normal_", around, (0.0, 0.0, 1.0))
    return df.select(*[ref(c) for c in names if c not in ("normal_x", "normal_y", "normal_z")],
        *[F.when(F.col("_tilt").isNotNull(), F.col(f"normal_{a}")).alias(f"normal_{a}") for a in "xyz"])


def structural_positions(structures: DataFrame, traces: DataFrame, zero_at: str = "bottom", clockwise: bool = True) -> DataFrame:
    """Structures on their trace (holes by trimmed lower-case id; depth, else mid) with position and normal_x/y/z: from alpha and
    beta (0 where missing) with the hole's direction there, else from dip and azimuth; rows with neither go."""
    from .asof import interpolate_positions

    depths = [number(F.col(c)) for c in ("depth", "mid") if c in structures.columns]
    key = F.lower(F.trim(F.col("hole_id").cast("string")))
    rows = structures.withColumns({"_own": F.col("hole_id"), "_at": F.coalesce(*depths), "hole_id": key})
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("alpha", "beta", "dip", "azimuth") if c not in rows.columns})
    oriented = number(F.col("alpha")).isNotNull() | (number(F.col("dip")).isNotNull() & number(F.col("azimuth")).isNotNull())
    placed = interpolate_positions(rows.filter((F.col("hole_id") != "") & oriented), traces.withColumn("hole_id", key), "_at",
        direction=True)
    placed = alpha_beta_normals(placed, (F.col("dir_x"), F.col("dir_y"), F.col("dir_z")), zero_at=zero_at, clockwise=clockwise)
    plane = plane_normal(number(F.col("dip")), number(F.col("azimuth")))
    placed = placed.withColumns({f"normal_{a}": F.coalesce(f"normal_{a}", c) for a, c in zip("xyz", plane, strict=True)})
    return placed.withColumn("hole_id", F.col("_own")).drop("_own", "_at", "dir_x", "dir_y", "dir_z")


def project_to_section(df: DataFrame, origin: tuple[float, float], azimuth: float, x_col: str = "easting",
    y_col: str = "northing") -> DataFrame:
    """Adds along and across: distances along and off a vertical section through origin at an azimuth."""
    dx, dy, a = ref(x_col) - origin[0], ref(y_col) - origin[1], F.radians(F.lit(float(azimuth)))
    return df.withColumns({"along": dx * F.sin(a) + dy * F.cos(a), "across": dx * F.cos(a) - dy * F.sin(a)})


def project_structures_to_section(df: DataFrame, origin: tuple[float, float], azimuth: float) -> DataFrame:
    """Adds section_along and section_depth (depth, else mid, else 0)."""
    depths = [number(F.col(c)) for c in ("depth", "mid") if c in df.columns]
    return project_to_section(df, origin, azimuth).withColumnRenamed("along", "section_along").drop("across").withColumn("section_depth",
        F.coalesce(*depths, F.lit(0.0)))


def section_view(df: DataFrame, origin: tuple[float, float], azimuth: float, width: float | None = 50.0,
    color_by: str | None = None) -> DataFrame:
    """The rows within width / 2 of the section (all, without a width), with color_value."""
    out = project_to_section(df, origin, azimuth)
    out = out if width is None else out.filter(F.abs("across") <= width / 2)
    return _coloured(out, color_by)


def plan_view(df: DataFrame, depth_slice: tuple[float, float] | None = None, color_by: str | None = None, z_col: str = "z") -> DataFrame:
    """The rows with z between the top and bottom of a slice, with color_value."""
    out = df if depth_slice is None else df.filter(ref(z_col).between(min(depth_slice), max(depth_slice)))
    return _coloured(out, color_by)


def _coloured(df: DataFrame, color_by: str | None) -> DataFrame:
    return df if color_by is None else df.withColumn("color_value", ref(color_by) if color_by in df.columns else F.lit(None).cast("string"))
