"""Map projection: geographic coordinates to transverse Mercator (UTM) metres, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import number, ref

#: GRS80 semi-major axis and inverse flattening; UTM scale and false origin.
AXIS, INVERSE_FLATTENING = 6378137.0, 298.257222101
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def utm(latitude: Column, longitude: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of degrees in a zone (any longitude within some degrees of its meridian), by Krueger's series
    to the third order of the third flattening: below a millimetre inside a zone. Nulls stay null."""
    n = 1 / (2 * INVERSE_FLATTENING - 1)
    radius = SCALE * AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    sin_lat, turn = F.sin(F.radians(latitude)), F.radians(longitude - float(6 * zone - 183))
    t = F.sinh(F.atanh(sin_lat) - e * F.atanh(e * sin_lat))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east = eta + sum(c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(series, 1))
    north = xi + sum(c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(series, 1))
    return FALSE_EASTING + radius * east, (FALSE_NORTHING_SOUTH if south else 0.0) + radius * north


def with_utm(df: DataFrame, zone: int, south: bool = False, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """df with easting and northing; values that are no numbers give null."""
    east, north = utm(number(ref(lat_col)), number(ref(lon_col)), zone, south)
    return df.withColumns({"easting": east, "northing": north})


def degrees(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Latitude and longitude of metres in a zone: the inverse of utm(), to 1e-9 degrees inside a zone."""
    n = 1 / (2 * INVERSE_FLATTENING - 1)
    radius = SCALE * AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    e = 2 * math.sqrt(n) / (1 + n)
    xi, eta = (northing - (FALSE_NORTHING_SOUTH if south else 0.0)) / radius, (easting - FALSE_EASTING) / radius
    north = xi - sum(c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(series, 1))
    east = eta - sum(c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(series, 1))
    isometric = F.atanh(F.sin(north) / F.cosh(east))
    s = F.tanh(isometric)
    for _ in range(6):  # each step leaves a 150th of the error
        s = F.tanh(isometric + e * F.atanh(e * s))
    return F.degrees(F.asin(s)), float(6 * zone - 183) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))


# First code, first zone, number of zones and hemisphere of the UTM systems that a code can name.
SYSTEMS = [(32601, 1, 60, False), (32701, 1, 60, True), (28348, 48, 11, True), (7846, 46, 14, True), (26901, 1, 23, False), (25828, 28, 11, False),
    (31978, 18, 8, True), (2134, 59, 2, True)]
GEOGRAPHIC = {4326, 4283, 7844, 4269, 4258}


def code_of(crs: str | int | None) -> int | None:
    """The number of an EPSG code, given as a number, a text of digits or "EPSG:digits"."""
    digits = str(crs).strip().upper().removeprefix("EPSG:") if crs is not None else ""
    return int(digits) if digits.isdigit() else None


def zone_of(crs: str | int | None) -> tuple[int, bool] | None:
    """UTM zone of a code and whether it is a southern one; None where the code names no UTM system that is known."""
    code = code_of(crs)
    return next(((zone + code - first, south) for first, zone, n, south in SYSTEMS if code is not None and 0 <= code - first < n), None)


def extent(df: DataFrame, x_col: str = "easting", y_col: str = "northing", by: list[str] | None = None) -> DataFrame:
    """One row (for each value of `by`): west, south, east, north of the rows with both coordinates, and rectangle [[south, west],
    [north, east]]."""
    x, y = number(ref(x_col)), number(ref(y_col))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    box = df.groupBy(*map(ref, by or [])).agg(F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"))
    return box.withColumn("rectangle", F.array(F.array("south", "west"), F.array("north", "east")))


def with_centre(box: DataFrame, crs: str | int | None = 4326, lonlat: bool = False) -> DataFrame:
    """extent() with centre_x, centre_y: the middle of the box, in its own system, or with lonlat as longitude and latitude. A
    system of degrees, and one whose code isn't known, gives the raw middle."""
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    zone = zone_of(crs) if lonlat else None
    if zone is not None:
        y, x = degrees(x, y, *zone)
    return box.withColumns({"centre_x": x, "centre_y": y})
