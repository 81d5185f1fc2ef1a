"""Raw tables as sources have them, derived from the given tables: source names, texts for numbers, repeated keys, bad
values, and a row id that gives the order of the source. RAW holds the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW


def lines(s: SparkSession, d: str) -> DataFrame:
    """All lineitems with a row id that is unique within an order, a hole, and m: which kind of bad value a row has."""
    key = F.col("l_partkey") * 1_000_000_000_000 + F.col("l_suppkey") * 10_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return s.read.parquet(f"{d}/lineitem.parquet").withColumns({ROW: key, "m": F.col("l_partkey") % 50,
        "hole": F.concat(F.lit("DH"), "l_orderkey")})


def _bounds(valid: bool, equal: bool) -> tuple[Column, Column]:
    a = (F.col("l_linenumber") - 1) * F.lit(2.0) + (F.col("l_partkey") % 3) * F.lit(0.0004)
    b = F.when(F.col("l_partkey") % 11 == 0,
        a).otherwise(F.col("l_linenumber") * F.lit(2.0)) if equal else F.col("l_linenumber") * F.lit(2.0)
    return a, b if valid else F.when(F.col("m") == 9, a - 1).otherwise(b)


def assays(s: SparkSession, d: str, valid: bool = True, equal: bool = True) -> DataFrame:
    """Hole Id, SampFrom, Samp_To, Analyte, Result (all text); valid: every row is an interval of a hole."""
    a, b = _bounds(valid, equal)
    hole = F.concat(F.lit(" "), "hole", F.lit(" "))
    b = b.cast("string")
    if not valid:
        hole, b = F.when(F.col("m") == 7, "  ").when(F.col("m") != 8, hole), F.when(F.col("m") == 10, "x").otherwise(b)
    value = (F.col("l_discount") * 100).cast("double")
    text = F.when(F.col("m") == 0, "Infinity").when(F.col("m") == 1, "bad").when(F.col("m") != 2, value.cast("string"))
    return lines(s, d).select(hole.alias("Hole Id"), a.cast("string").alias("SampFrom"), b.alias("Samp_To"),
        F.col("l_returnflag").alias("Analyte"), text.alias("Result"), F.when(F.col("m") != 2, value).alias("number"), ROW)


def collars(s: SparkSession, d: str) -> DataFrame:
    """HoleID (with blanks), Project, RL, X, Y (text), EPSG of every order."""
    key = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(
        F.concat(F.lit(" dh"), key).alias("HoleID"), F.col("o_orderpriority").alias("Project"),
        (F.lit(300.0) + key % 37).cast("string").alias("RL"),
        (F.lit(500000.0) + key % 100 * 50).cast("string").alias("X"),
        (F.lit(6900000.0) + F.floor(key / 100) * 50).cast("string").alias("Y"), F.lit("EPSG:28350").alias("EPSG"), key.alias(ROW),
    )


def surveys(s: SparkSession, d: str, valid: bool = True) -> DataFrame:
    """HoleId, SurveyDepth, Az, DIP (text) of every lineitem."""
    bad = lambda k, c: c.cast("string") if valid else F.when(F.col("m") == k, "n/a").otherwise(c.cast("string"))
    hole = F.concat("hole", F.lit(" ")) if valid else F.when(F.col("m") == 7, " ").otherwise(F.concat("hole", F.lit(" ")))
    return lines(s, d).select(
        hole.alias("HoleId"), bad(11, (F.col("l_linenumber") - 1) * F.lit(25.0)).alias("SurveyDepth"),
        bad(12, (F.col("l_quantity") * 7).cast("double")).alias("Az"), bad(13, F.lit(-90.0) + F.col("l_tax") * 500).alias("DIP"), ROW,
    )


def structures(s: SparkSession, d: str) -> DataFrame:
    """HoleId, Depth, Computed_Plane_Dip, DipDir, Alpha, Beta (text, some bad), Type of every event."""
    e = F.col("event_id")
    return s.read.parquet(f"{d}/events.parquet").select(
        F.when(e % 41 == 0, " ").otherwise(F.concat(F.lit(" DH"), "user_id")).alias("HoleId"),
        F.when(e % 31 != 0, F.col("value").cast("string")).alias("Depth"),
        F.when(e % 17 == 0, "steep").otherwise((e % 91).cast("double").cast("string")).alias("Computed_Plane_Dip"),
        (e * 37 % 360).cast("double").cast("string").alias("DipDir"),
        F.when(e % 3 == 0, (e % 90).cast("double").cast("string")).alias("Alpha_Angle"),
        F.when(e % 6 == 0, (e * 11 % 360).cast("double").cast("string")).alias("Beta"),
        F.col("event_type").alias("Type"), e.alias(ROW),
    )


def blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks under other names, some without a centre, with an attribute that mixes numbers and text."""
    k = F.col("p_partkey")
    return s.read.parquet(f"{d}/part.parquet").select(
        F.when(k % 13 != 0, (k % 20 * 10 + F.lit(5.0)).cast("string")).alias("XC"),
        (F.floor(k / 20) % 20 * 10 + F.lit(5.0)).alias("Center_Y"), (F.floor(k / 400) * 10 + F.lit(5.0)).alias("zCentre"),
        F.lit("10").alias("size_x"), F.lit(10).alias("SY"), F.lit(10.0).alias("dim_z"), (F.col("p_size") / F.lit(10.0)).alias("Grade"),
        F.when(k % 7 == 0, "mixed").otherwise(F.col("p_size").cast("string")).alias("Code"), F.col("p_type").alias("Rock"), k.alias(ROW),
    )


def photos(s: SparkSession, d: str) -> DataFrame:
    """Photos of every event: from_depth (some missing), to_depth, photo_set (some blank), image_url, lod_urls."""
    e = F.col("event_id")
    url = lambda n: F.concat(F.lit(f"https://photos.test/{n}/"), e)
    return s.read.parquet(f"{d}/events.parquet").select(
        F.concat(F.lit("DH"), "user_id").alias("hole_id"), F.when(e % 19 != 0, F.col("value")).alias("from_depth"),
        (F.col("value") + 1).alias("to_depth"),
        F.when(e % 5 == 0, "").when(e % 5 != 1, F.col("event_type")).alias("photo_set"), url("full").alias("image_url"),
        F.when(e % 4 == 0, F.create_map(F.lit("thumb"), url("t"), F.lit("mid"), url("m"))).when(e % 4 == 1,
        F.create_map(F.lit("thumb"), url("t"), F.lit("full"), F.lit(""))).alias("lod_urls"), e.alias(ROW),
    )


LINES = """rl as (select *, l_partkey * 1000000000000 + l_suppkey * 10000000 + cast(round(l_extendedprice * 100) as bigint) rid, l_partkey % 50 m, concat('DH', l_orderkey) hole,
  (l_linenumber - 1) * cast(2.0 as double) + (l_partkey % 3) * cast(0.0004 as double) a0, l_linenumber * cast(2.0 as double) b0, cast(l_discount * 100 as double) v0 from lineitem)"""
EQUAL = "case when l_partkey % 11 = 0 then a0 else b0 end"


def raw_assays(valid: bool = True, equal: bool = True) -> str:
    """ra: hole (trimmed, null where blank), a, b (null: no number), code, v (null: no finite number), n (null where missing), rid."""
    b = EQUAL if equal else "b0"
    return f"""{LINES}, ra as (select {"hole" if valid else "case when m not in (7, 8) then hole end"} hole, a0 a,
  {b if valid else f"case when m = 9 then a0 - 1 when m = 10 then null else {b} end"} b, l_returnflag code, case when m > 2 then v0 end v, case when m <> 2 then v0 end n, rid, m from rl)"""


#: Bounds of loaded intervals: three decimals, half to even, equal ones 1 mm long.
BOUNDED = """rb as (select *, case when t = f then round_even((f + 0.001) * 1000, 0) / 1000 else t end u from (select *, round_even(a * 1000, 0) / 1000 f, round_even(b * 1000, 0) / 1000 t from ra))"""
RAW_COLLARS = """rc as (select concat('dh', o_orderkey) hole_id, o_orderpriority project_id, cast(300.0 as double) + o_orderkey % 37 elevation,
  cast(500000.0 as double) + (o_orderkey % 100) * 50 easting, cast(6900000.0 as double) + floor(o_orderkey / 100) * 50 northing, o_orderkey rid from orders)"""
RAW_SURVEYS = f"""{LINES}, rs as (select hole hole_id, (l_linenumber - 1) * cast(25.0 as double) depth, cast(l_quantity * 7 as double) azimuth, cast(-90.0 as double) + l_tax * 500 dip, rid, m from rl)"""
RAW_STRUCTURES = """rt as (select event_id, case when event_id % 41 <> 0 then concat('DH', user_id) end hole_id, case when event_id % 31 <> 0 then value end depth, case when event_id % 17 <> 0 then cast(event_id % 91 as double) end dip,
  cast(event_id * 37 % 360 as double) azimuth, case when event_id % 3 = 0 then cast(event_id % 90 as double) end alpha, case when event_id % 6 = 0 then cast(event_id * 11 % 360 as double) end beta, event_type from events)"""
RAW_BLOCKS = """rk as (select p_partkey rid, case when p_partkey % 13 <> 0 then (p_partkey % 20) * 10 + cast(5.0 as double) end x, (floor(p_partkey / 20) % 20) * 10 + cast(5.0 as double) y, floor(p_partkey / 400) * 10 + cast(5.0 as double) z,
  p_size / cast(10.0 as double) grade, case when p_partkey % 7 = 0 then 'mixed' else cast(p_size as varchar) end code, p_type rock from part)"""
RAW_PHOTOS = """rp as (select event_id rid, concat('DH', user_id) hole_id, case when event_id % 19 <> 0 then value end from_depth, value + 1 to_depth, case when event_id % 5 in (0, 1) then 'default' else event_type end photo_set,
  concat('https://photos.test/full/', event_id) image_url from events)"""
