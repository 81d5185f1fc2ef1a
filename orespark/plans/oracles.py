"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

COLLARS = """fx_collars as (
  select concat('DH', o_orderkey) hole_id, o_orderpriority project_id, cast(500000.0 as double) + (o_orderkey % 100) * 50 easting,
         cast(6900000.0 as double) + floor(o_orderkey / 100) * 50 northing, cast(300.0 as double) + (o_orderkey % 37) elevation from orders)"""
SURVEYS = """fx_surveys as (
  select concat('DH', l_orderkey) hole_id, (l_linenumber - 1) * cast(25.0 as double) depth, max(l_quantity) * cast(7.0 as double) azimuth,
         cast(-90.0 as double) + max(l_tax) * 500 dip from lineitem group by l_orderkey, l_linenumber)"""
INTERVALS = """fx_intervals as materialized (
  select concat('DH', l_orderkey) hole_id, (l_linenumber - 1) * cast(2.0 as double) "from", l_linenumber * cast(2.0 as double) "to",
         max(l_discount) * 100 au_ppm, max(l_returnflag) geology_code from lineitem group by l_orderkey, l_linenumber)"""
STRUCTURES = """fx_structures as (
  select event_id, concat('DH', user_id) hole_id, cast(value as double) depth, cast(event_id % 91 as double) dip,
         cast((event_id * 37) % 360 as double) azimuth, event_type structure_type from events)"""
BLOCKS = """fx_blocks as (
  select p_partkey block_id, (p_partkey % 20) * 10 + cast(5.0 as double) x, (floor(p_partkey / 20) % 20) * 10 + cast(5.0 as double) y,
         floor(p_partkey / 400) * 10 + cast(5.0 as double) z, cast(10.0 as double) dx, cast(10.0 as double) dy, cast(10.0 as double) dz,
         p_size / cast(10.0 as double) grade, p_retailprice / 400 density, p_type rock_type from part)"""
WIDE = """fx_wide as (
  select * replace (s as dx, s as dy, s as dz) from (select *, case when block_id % 7 = 0 then cast(15.0 as double) else cast(10.0 as double) end s from fx_blocks))"""
SEGMENTS = """fx_segments as materialized (
  select hole_id, k * cast(3.0 as double) seg_from, (k + 1) * cast(3.0 as double) seg_to
  from (select hole_id, unnest(range(cast(ceil(max("to") / 3) as int))) k from fx_intervals group by hole_id))"""
SHIFTED = """fx_shifted as (
  select hole_id, case when k % 97 = 0 then null when k % 53 = 0 then "to" when k % 7 = 0 then "from" - 0.5 else "from" end "from", "to", au_ppm, geology_code
  from (select *, cast(substr(hole_id, 3) as bigint) + cast("to" / 2 as bigint) k from fx_intervals))"""
BENT = """fx_bent as (
  select event_id, hole_id, case when event_id % 31 = 0 then null else depth end depth, dip * cast(1.05 as double) dip,
         case when event_id % 50 = 0 then cast(360.0 as double) else azimuth end azimuth from fx_structures)"""


COARSE = {"easting", "northing", "elevation", "x0", "y0", "x1", "y1", "tick_x", "tick_y", "along", "across"}


def r(expression: str, name: str) -> str:
    return f"round({expression}, {3 if name in COARSE else 6}) + cast(0.0 as double) as {name}"


def traces(method: str) -> str:
    """Traces by a method, step 5."""
    if method == "minimum_curvature":
        move = {a: f"case when md1 > md then 0.5 * (md1 - md) * ({d0} + {d1}) * rf else 0 end" for a, d0,
            d1 in (("x", "x0", "x1"), ("y", "y0", "y1"), ("z", "z0", "z1"))}
        angle = {c: f"{c} + coalesce({c}1 - {c}, 0) * f" for c in ("az", "dip")}
    elif method == "tangential":
        move = {a: f"case when md1 > md then (md1 - md) * {a}0 else 0 end" for a in "xyz"}
        angle = {"az": "az", "dip": "dip"}
    else:
        move = {a: f"case when md1 > md then (md1 - md) * {a}m else 0 end" for a in "xyz"}
        angle = {c: f"case when k = 0 then {c} else ({c} + {c}1) / 2 end" for c in ("az", "dip")}
    return f"""{COLLARS}, {SURVEYS},
st as (
  select hole_id, depth md, azimuth az, dip, row_number() over w n, lead(depth) over w md1, lead(azimuth) over w az1, lead(dip) over w dip1
  from fx_surveys window w as (partition by hole_id order by depth)
), dc as (
  select *, cos(radians(dip)) * sin(radians(az)) x0, cos(radians(dip)) * cos(radians(az)) y0, -sin(radians(dip)) z0,
         cos(radians(dip1)) * sin(radians(az1)) x1, cos(radians(dip1)) * cos(radians(az1)) y1, -sin(radians(dip1)) z1,
         cos(radians((dip + dip1) / 2)) * sin(radians((az + az1) / 2)) xm, cos(radians((dip + dip1) / 2)) * cos(radians((az + az1) / 2)) ym, -sin(radians((dip + dip1) / 2)) zm
  from st
), rf as (
  select *, case when b > 1e-6 then 2 * tan(b / 2) / b else 1 end rf, case when md1 > md then cast(greatest(1, ceil((md1 - md) / 5)) as int) else 0 end steps
  from (select *, acos(greatest(-1, least(1, x0 * x1 + y0 * y1 + z0 * z1))) b from dc)
), mv as (select *, {move["x"]} sx, {move["y"]} sy, {move["z"]} sz from rf),
cu as (
  select *, coalesce(sum(sx) over w, 0) ox, coalesce(sum(sy) over w, 0) oy, coalesce(sum(sz) over w, 0) oz from mv
  window w as (partition by hole_id order by md rows between unbounded preceding and 1 preceding)
), ex as (select *, unnest(range(case when n = 1 then 0 else 1 end, steps + 1)) k from cu),
fr as (select *, case when steps > 0 then k / cast(steps as double) else 0 end f from ex),
tr as (
  select hole_id, md + coalesce(md1 - md, 0) * f md, easting + ox + sx * f easting, northing + oy + sy * f northing, elevation + oz + sz * f elevation,
         {angle["az"]} azimuth, {angle["dip"]} dip
  from fr join fx_collars using (hole_id)
)"""


def _traced(method: str) -> str:
    names = ("md", "easting", "northing", "elevation", "azimuth", "dip")
    return f"with {traces(method)} select hole_id, {', '.join(r(n, n) for n in names)} from tr"


def nearest(rows: str, depth: str) -> str:
    """nv: rows with the nearest vertex (b: at or above, f: below)."""
    return f"""nq as (select *, row_number() over () qid from {rows} where hole_id is not null and {depth} is not null),
bk as (select nq.*, tr.md bmd, tr.easting bx, tr.northing by_, tr.elevation bz from nq asof left join tr on nq.hole_id = tr.hole_id and nq.{depth} >= tr.md),
fw as (select nq.qid, tr.md fmd, tr.easting fx, tr.northing fy, tr.elevation fz from nq asof left join tr on nq.hole_id = tr.hole_id and nq.{depth} <= tr.md),
nv as (
  select * exclude (bmd, bx, by_, bz, fmd, fx, fy, fz), case when u then bmd else fmd end md, case when u then bx else fx end easting, case when u then by_ else fy end northing, case when u then bz else fz end elevation
  from (select bk.*, fmd, fx, fy, fz, fmd is null or (bmd is not null and {depth} - bmd <= fmd - {depth}) u from bk join fw using (qid))
)"""


POSITION = ", ".join(r(n, n) for n in ("easting", "northing", "elevation"))
INTERCEPTS = """q as (select *, lag("to") over (partition by hole_id order by "from") p from fx_intervals where au_ppm >= 3),
g as (select *, sum(case when p is null or abs("from" - p) > 1e-6 then 1 else 0 end) over (partition by hole_id order by "from") run from q),
hits as (
  select hole_id, min("from") "from", max("to") "to", sum(au_ppm * ("to" - "from")) / sum("to" - "from") grade, count(*) n_samples
  from g group by hole_id, run having max("to") - min("from") >= 2 - 1e-6)"""
SEGMENT_JOIN = """sj as materialized (select s.*, i.* exclude (hole_id), least(seg_to, "to") - greatest(seg_from, "from") ov from fx_segments s join fx_intervals i on s.hole_id = i.hole_id and i."from" < s.seg_to and i."to" > s.seg_from)"""


def composited(value: str) -> str:
    return f"""with {INTERVALS}, e as (select hole_id, min("from") a, max("to") b from fx_intervals group by hole_id),
bins as (select hole_id, a + k * cast(3 as double) lo, a + (k + 1) * cast(3 as double) hi from (select *, unnest(range(cast(ceil((b + 3 - a) / 3) as int))) k from e)),
o as (select b.hole_id, lo, hi, au_ppm v, least("to", hi) - greatest("from", lo) ov from bins b join fx_intervals i on b.hole_id = i.hole_id and i."from" < hi and i."to" > lo)
select hole_id, {r("lo", '"from"')}, {r("hi", '"to"')}, {r(value, '"value"')} from o group by hole_id, lo, hi"""


def interpolated(rows: str, depth: str) -> str:
    """ip: rows with the position on the first enclosing segment, ends open."""
    return f"""sg as (
  select hole_id, md, lead(md) over w md1, easting x, lead(easting) over w x1, northing y, lead(northing) over w y1, elevation z, lead(elevation) over w z1, row_number() over w rn, count(*) over (partition by hole_id) n
  from tr window w as (partition by hole_id order by md)
), sq as (select *, case when rn = 1 then -1e300 else md end lo, case when md1 is null or rn = n - 1 then 1e300 else md1 end hi from sg where md1 is not null or n = 1),
sp as (
  select q.*, sq.* exclude (hole_id), coalesce((q.{depth} - sq.md) / (md1 - sq.md), 0) part, row_number() over (partition by q.qid order by rn) pick
  from (select *, row_number() over () qid from {rows}) q join sq on q.hole_id = sq.hole_id and q.{depth} >= lo and q.{depth} <= hi
), ip as (select *, x + coalesce(part * (x1 - x), 0) easting, y + coalesce(part * (y1 - y), 0) northing, z + coalesce(part * (z1 - z), 0) elevation from sp where pick = 1)"""


ORACLES: dict[str, str] = {
    "significant_intercepts": f"""with {INTERVALS}, {INTERCEPTS}
select hole_id, {r('"from"', '"from"')}, {r('"to"', '"to"')}, {r('"to" - "from"', "length")}, {r("grade", "avg_grade")}, n_samples, 'au_ppm' assay_field, format('{{:.1f}} m @ {{:.2f}} au_ppm', "to" - "from", grade) as label from hits""",
    "located_intercepts_in_section": f"""with {traces("minimum_curvature")}, {INTERVALS}, {INTERCEPTS}, hm as (select *, ("from" + "to") / 2 mid from hits), {nearest("hm", "mid")},
sv as (select *, (easting - 502500) * sin(radians(45)) + (northing - 6900000) * cos(radians(45)) along, (easting - 502500) * cos(radians(45)) - (northing - 6900000) * sin(radians(45)) across from nv where easting is not null)
select hole_id, "from", "to", {r("grade", "grade")}, {POSITION}, {r("along", "along")}, {r("across", "across")} from sv where abs(across) <= 1000""",
    "block_volume_by_class": f"with {BLOCKS} select rock_type, {r('sum(dx * dy * dz)', 'volume')}, {r('stddev_samp(grade)', 'grade_std')} from fx_blocks group by rock_type",
    "filtered_volume": f"with {BLOCKS} select coalesce(sum(dx * dy * dz), 0) volume from fx_blocks where grade >= 1 and grade < 4 and rock_type is distinct from 'nothing'",
    "attribute_stats_numeric": f"with {BLOCKS} select count(grade) \"count\", {r('min(grade)', 'min')}, {r('max(grade)', 'max')}, {r('avg(grade)', 'mean')}, {r('stddev_samp(grade)', 'std')}, {r('coalesce(sum(grade), 0)', 'sum')} from fx_blocks where density > 2.5",
    "attribute_stats_categorical": f'with {BLOCKS} select rock_type as "value", count(*) as "count" from fx_blocks where rock_type is not null group by rock_type',
    "block_bbox": f"with {BLOCKS} select " + ", ".join(f"{m}({a} {s} d{a} / 2) {m}_{a}" for a in "xyz" for m,
    s in (("min", "-"), ("max", "+"))) + " from fx_blocks",
    "block_size_stats": f"with {BLOCKS} select " + ", ".join(f"{m}({c}) {m}_{c}" for c in ("dx", "dy", "dz") for m in ("min",
    "max")) + " from fx_blocks",
    "min_curvature_traces": _traced("minimum_curvature"),
    "tangential_traces": _traced("tangential"),
    "balanced_tangential_traces": _traced("balanced_tangential"),
    "station_traces": f"""with {COLLARS}, {SURVEYS},
cl as (select lower(trim(hole_id)) hole_id, cast(-30 as double) + (northing - 6900000) / 1e6 lat0, cast(118 as double) + (easting - 500000) / 1e6 lng0 from fx_collars),
og as (select lat0 rlat, lng0 rlng from cl order by hole_id limit 1),
tp as (select hole_id, rlat, rlng, (lng0 - rlng) * 111320 * cos(radians(rlat)) bx, (lat0 - rlat) * 111132 by_ from cl, og),
s0 as (select lower(trim(hole_id)) hole_id, depth md, radians(least(180, greatest(0, dip + 90))) inc, radians(azimuth) a from fx_surveys),
s1 as (select *, lag(md) over w md0, lag(inc) over w i0, lag(a) over w a0 from s0 window w as (partition by hole_id order by md)),
s2 as (select *, acos(greatest(-1, least(1, cos(i0) * cos(inc) + sin(i0) * sin(inc) * cos(a - a0)))) b from s1),
s3 as (select *, case when b > 1e-6 then 2 * tan(b / 2) / b else 1 end * (md - md0) / 2 h from s2),
s4 as (
  select hole_id, md, sum(coalesce(h * (sin(i0) * cos(a0) + sin(inc) * cos(a)), 0)) over w dx, sum(coalesce(h * (sin(i0) * sin(a0) + sin(inc) * sin(a)), 0)) over w dy, sum(coalesce(h * (cos(i0) + cos(inc)), 0)) over w dz
  from s3 window w as (partition by hole_id order by md))
select hole_id, {r("md", "md")}, {r("bx + dx", "x")}, {r("by_ + dy", "y")}, {r("-dz", "z")}, {r("rlat + (by_ + by_ + dy) / 111132", "lat")}, {r("rlng + (bx + bx + dx) / (111320 * cos(radians(rlat)))", "lng")} from s4 join tp using (hole_id)""",
    "attach_assay_positions": f"""with {traces("minimum_curvature")}, {INTERVALS}, im as (select *, ("from" + "to") * 0.5 mid from fx_intervals), {nearest("im", "mid")}
select hole_id, "from", "to", mid, {r("md", "md")}, {POSITION} from nv""",
    "attach_structure_positions": f"with {traces('minimum_curvature')}, {STRUCTURES}, {nearest('fx_structures', 'depth')} select event_id, hole_id, depth, {POSITION} from nv",
    "interpolate_positions": f"with {traces('minimum_curvature')}, {STRUCTURES}, {interpolated('fx_structures', 'depth')} select event_id, hole_id, depth, {POSITION} from ip",
    "resample_trace": f"""with {traces("minimum_curvature")}, en as (select hole_id, min(md) lo_, max(md) hi_ from tr group by hole_id),
mk as (select hole_id, lo_ + k * cast(7 as double) md_out, least(lo_ + k * cast(7 as double), hi_) t from (select *, unnest(range(cast(greatest(1, ceil((hi_ + 7 - lo_) / 7)) as int))) k from en)),
{interpolated("mk", "t")} select hole_id, {r("md_out", "md")}, {POSITION} from ip""",
    "composite_average": composited("case when sum(ov) > 0 then coalesce(sum(v * ov), 0) / sum(ov) else 0 end"),
    "composite_sum": composited("coalesce(sum(v * ov), 0)"),
    "overlap_weighted_value": f"""with {INTERVALS}, {SEGMENTS}, {SEGMENT_JOIN}, m as materialized (select hole_id, seg_from, seg_to, sum(au_ppm * ov) / sum(ov) v from sj group by all)
select hole_id, seg_from, seg_to, {r("v", '"value"')} from fx_segments left join m using (hole_id, seg_from, seg_to)""",
    "dominant_category": f"""with {INTERVALS}, {SEGMENTS}, {SEGMENT_JOIN}, k as (select *, row_number() over (partition by hole_id, seg_from, seg_to order by ov desc, "from", "to") n from sj)
select hole_id, seg_from, seg_to, geology_code category from k where n = 1""",
    "has_data_segments": f"with {INTERVALS}, {SEGMENTS}, {SEGMENT_JOIN}, hit as materialized (select distinct hole_id, seg_from, true hit from sj) select hole_id, seg_from, seg_to, coalesce(hit, false) has_data from fx_segments left join hit using (hole_id, seg_from)",
    "merge_numeric_categorical": f"""with {INTERVALS} select hole_id, "from", "to", {r("au_ppm", "au_ppm")}, geology_code
from (select hole_id, "from", "to", au_ppm from fx_intervals where au_ppm >= 5) full join (select hole_id, "from", "to", geology_code from fx_intervals where geology_code <> 'N') using (hole_id, "from", "to")""",
    "join_assays_to_traces": f"""with {INTERVALS}, {SURVEYS} select a.hole_id, a.md, {r("a.au_ppm", "au_ppm")}, {r("t.azimuth", "azimuth")}, {r("t.dip", "au_ppm_trace")}
from (select *, "from" / 2 * 25 md from fx_intervals) a left join fx_surveys t on a.hole_id = t.hole_id and a.md = t.depth""",
    "flatten_long_assays": f'with {INTERVALS} select hole_id, "from", "to", {r("au_ppm * 1000", "au_ppb")}, {r("au_ppm", "au_ppm")} from fx_intervals',
    "validate_intervals": f"""with {INTERVALS}, {SHIFTED}, ok as (select *, lag("to") over (partition by hole_id order by "from", "to") p from fx_shifted where "from" is not null and "to" is not null)
select hole_id, "from", "to", 'missing_depth' issue from fx_shifted where "from" is null or "to" is null
union all select hole_id, "from", "to", 'non_positive_length' from ok where "to" <= "from"
union all select hole_id, "from", "to", 'overlap' from ok where "from" < p""",
    "overlapping_intervals": f"""with {INTERVALS}, {SHIFTED}, ok as (select *, lag("to") over (partition by hole_id order by "from", "to") p from fx_shifted where "from" is not null)
select hole_id, "from", "to" from ok where "from" < p""",
    "validate_surveys": """with l as (select l_orderkey hole_id, l_linenumber n, max(l_quantity) depth from lineitem group by all), p as (select *, lag(depth) over (partition by hole_id order by n) b from l)
select distinct hole_id, 'non_monotonic_depth' issue from p where depth < b""",
    "validate_structural_points": f"""with {STRUCTURES}, {BENT} select hole_id, depth, 'missing_depth' issue from fx_bent where depth is null
union all select hole_id, depth, 'dip_out_of_range' from fx_bent where depth is not null and (dip < 0 or dip > 90)
union all select hole_id, depth, 'azimuth_out_of_range' from fx_bent where depth is not null and (azimuth < 0 or azimuth >= 360)""",
    "validate_block_sizes": f"""with {BLOCKS}, {WIDE}, a as (select block_id, 'dx' axis, dx block_size, cast(20 as double) max_size from fx_wide union all select block_id, 'dy', dy, cast(45 as double) from fx_wide)
select block_id, axis, case when block_size <= 0 then 'non_positive_block_size' else 'invalid_block_size_divisor' end issue, block_size, max_size from a
where block_size is null or block_size <= 0 or abs(max_size / block_size - round_even(max_size / block_size, 0)) > 1e-6""",
    "validate_blocks_in_bbox": f"with {BLOCKS}, {WIDE} "
    + " union all ".join(f"select block_id, '{a}' axis, {a} block_centre, d{a} block_dim from fx_wide where {a} - d{a} / 2 < 0 - 1e-6 or {a} + d{a} / 2 > {m} + 1e-6" for a, m in (("x", 190), ("y", 200), ("z", "1e9"))),
    "block_overlaps": f"""with {BLOCKS}, {WIDE} select a.block_id block_a, b.block_id block_b from fx_wide a join fx_wide b on a.block_id < b.block_id
where """ + " and ".join(f"a.{x} - a.d{x} / 2 < b.{x} + b.d{x} / 2 - 1e-6 and b.{x} - b.d{x} / 2 < a.{x} + a.d{x} / 2 - 1e-6" for x in "xyz"),
    "exterior_faces": f"""with {BLOCKS}, k as (select * replace (case when block_id % 11 = 0 then x + 1000 else x end as x) from fx_blocks), f as ("""
    + " union all ".join(f"select block_id, '{a}' axis, {s} side, " + ", ".join(f"floor({x}{f' + {s} * d{a}' if x == a else ''} + 0.5) k{x}" for x in "xyz") + " from k" for a in "xyz" for s in (-1, 1))
    + ") select block_id, axis, side from f where not exists (select 1 from k where floor(k.x + 0.5) = kx and floor(k.y + 0.5) = ky and floor(k.z + 0.5) = kz)",
    "plan_view": f"with {COLLARS} select hole_id, elevation, project_id color_value from fx_collars where elevation between 310 and 320",
    "section_view": f"""with {COLLARS}, p as (select hole_id, (easting - 502500) * sin(radians(45)) + (northing - 6900000) * cos(radians(45)) along, (easting - 502500) * cos(radians(45)) - (northing - 6900000) * sin(radians(45)) across from fx_collars)
select hole_id, {r("along", "along")}, {r("across", "across")} from p where abs(across) <= 250""",
    "plane_normals": f"""with {STRUCTURES} select event_id, {r("sin(radians(azimuth)) * sin(radians(dip))", "normal_x")}, {r("cos(radians(azimuth)) * sin(radians(dip))", "normal_y")}, {r("cos(radians(dip))", "normal_z")},
{r("((azimuth - 90) % 360 + 360) % 360", "strike")}, {r("((azimuth - 90) % 360 + 360) % 360", "pole_trend")}, {r("90 - dip", "pole_plunge")} from fx_structures""",
    "normalized_angles": f"with {STRUCTURES}, {BENT} select event_id, {r('least(90, greatest(0, dip))', 'dip')}, {r('((azimuth - 90) % 360 + 360) % 360', 'azimuth')} from fx_bent",
    "tadpole_tails": f"with {STRUCTURES} select event_id, {r('abs(dip) / 90 * 10 * sin(radians(azimuth))', 'tail_x')}, {r('abs(dip) / 90 * 10 * cos(radians(azimuth))', 'tail_y')} from fx_structures",
    "strike_dip_symbols": f"""with {STRUCTURES}, {COLLARS}, p as (select event_id, easting x, northing y, radians(((azimuth - 90) % 360 + 360) % 360) s, radians(azimuth) d, 4 * dip / 90 t from fx_structures join fx_collars using (hole_id))
select event_id, {r("x - sin(s) * 10", "x0")}, {r("y - cos(s) * 10", "y0")}, {r("x + sin(s) * 10", "x1")}, {r("y + cos(s) * 10", "y1")}, {r("x + sin(d) * t", "tick_x")}, {r("y + cos(d) * t", "tick_y")} from p""",
    "alpha_beta_normals": f"""with {STRUCTURES}, d as (select cos(radians(-60)) * sin(radians(30)) x, cos(radians(-60)) * cos(radians(30)) y, -sin(radians(-60)) z),
f as (select x, y, z, -y / sqrt(x * x + y * y) rx, x / sqrt(x * x + y * y) ry, cast(0 as double) rz from d),
b as (select *, y * rz - z * ry bx, z * rx - x * rz by_, x * ry - y * rx bz from f),
c as (select *, y * bz - z * by_ cx, z * bx - x * bz cy, x * by_ - y * bx cz from b),
t as (select event_id, c.*, radians(azimuth) w, radians(90 - dip * (cast(90 as double) / 91)) q from fx_structures, c)
select event_id, """ + ", ".join(r(f"cos(q) * (b{a} * cos(w) + c{n} * sin(w)) + sin(q) * {n}", f"normal_{n}") for a, n in (("x", "x"), ("y_", "y"), ("z", "z"))) + " from t",
    "interval_points": f'with {INTERVALS} select hole_id, ("from" + "to") / 2 z, {r("au_ppm", "val")}, "from" from_val, "to" to_val, ("to" - "from") / 2 half from fx_intervals where au_ppm is not null',
    "interval_vertices": f'with {INTERVALS} select hole_id, "from", "to", unnest(["from", "to"]) z from fx_intervals',
    "labelled_intervals": f"""with {INTERVALS}, {SHIFTED} select hole_id, "from", "to", geology_code from fx_shifted where "to" > "from" and geology_code <> 'A'""",
    "unified_dataset": f"""with {INTERVALS}, {STRUCTURES}, u as (
select hole_id, "from" a, "to" b, ("from" + "to") * 0.5 m, ("from" + "to") * 0.5 d, au_ppm, cast(null as double) dip, cast(null as double) azimuth, 'assay' data_source from fx_intervals
union all select hole_id, depth - 0.05, depth + 0.05, depth, depth, null, dip, azimuth, 'structural' from fx_structures)
select hole_id, {r("a", '"from"')}, {r("b", '"to"')}, {r("m", "mid")}, {r("d", "depth")}, {r("au_ppm", "au_ppm")}, dip, azimuth, data_source from u""",
    "quantile_colour_bins": f"""with {STRUCTURES}, s as (select depth v, row_number() over (order by depth) - 1 i, count(*) over () n from fx_structures where depth is not null),
b as (select unnest(range(10)) k) select cast(k as int) bin, {r("(select v from s where i = floor(k / cast(10 as double) * n))", "lo")}, {r("(select v from s where i = least(n - 1, floor((k + 1) / cast(10 as double) * n)))", "hi")} from b""",
    "binned_values": f"""with {INTERVALS} select hole_id, "from", case when au_ppm >= 0 and au_ppm <= 2 then 0 when au_ppm >= 2 and au_ppm <= 5 then 1 when au_ppm >= 5 then 2 else -1 end bin,
cast(least(3, greatest(0, floor(au_ppm / 2.5))) as int) width_bin from fx_intervals""",
    "depth_markers": f"""with {INTERVALS}, e as (select hole_id, min("from") lo, max("to") hi from fx_intervals group by hole_id)
select hole_id, k * cast(5 as double) as depth from (select hole_id, unnest(range(cast(ceil(lo / 5) as int), cast(floor(hi / 5) as int) + 1)) k from e)""",
    "holes_with_assays": f"with {INTERVALS} select distinct hole_id from fx_intervals where au_ppm > 9",
    "hole_properties": f"with {INTERVALS} select hole_id, concat_ws(',', case when max(au_ppm) > 9 then 'au_ppm' end, case when bool_or(geology_code = 'R') then 'geology_code' end) properties from fx_intervals group by hole_id",
    "trace_segments": f"with {COLLARS}, {SURVEYS} select hole_id, string_agg(cast(cast(depth as bigint) as varchar), ',' order by depth) mds from fx_surveys join fx_collars using (hole_id) group by hole_id",
    "intervals_by_hole": f"""with {INTERVALS} select hole_id, string_agg(concat(cast(cast("from" as bigint) as varchar), ':', geology_code), ',' order by "from") intervals from fx_intervals group by hole_id""",
    "structure_discs": f"""with {traces("minimum_curvature")}, {STRUCTURES}, {nearest("fx_structures", "depth")}
select hole_id, {POSITION}, {r("sin(radians(azimuth)) * sin(radians(dip))", "normal_x")}, {r("cos(radians(azimuth)) * sin(radians(dip))", "normal_y")}, {r("cos(radians(dip))", "normal_z")}, dip, azimuth, structure_type color_value from nv where easting is not null""",
    "category_colours": f"""with recursive {BLOCKS}, n as (select distinct rock_type from fx_blocks),
h(rock_type, i, v) as (select rock_type, 0, cast(2166136261 as bigint) from n union all select rock_type, i + 1, (xor(v, cast(ascii(substr(rock_type, i + 1, 1)) as bigint)) * 16777619) & 4294967295 from h where i < length(rock_type))
select rock_type, {r("v / cast(4294967295 as double)", "unit")}, case lower(substr(rock_type, 1, 2)) when 'st' then '#111111' when 'pr' then '#222222' else '#999999' end colour from h where i = length(rock_type)""",
    "wrapped_comments": r"""with recursive t as (select conv_id, turn, [x for x in regexp_split_to_array(text, '\s+') if x <> ''] w from conversations),
h(conv_id, turn, w, i, o, n) as (select conv_id, turn, w, 1, coalesce(w[1], ''), length(coalesce(w[1], '')) from t union all
  select conv_id, turn, w, i + 1, case when n + 1 + length(w[i + 1]) <= 30 then o || ' ' || w[i + 1] else o || '<br>' || w[i + 1] end,
    case when n + 1 + length(w[i + 1]) <= 30 then n + 1 + length(w[i + 1]) else length(w[i + 1]) end from h where i < len(w))
select conv_id, turn, cast(len(string_split(o, '<br>')) as bigint) n_lines, sha256(o) digest from h where i >= len(w)""",
    "collar_extent": f"with {COLLARS} select {r('min(easting / 1e4)', 'west')}, {r('min(northing / 1e5)', 'south')}, {r('max(easting / 1e4)', 'east')}, {r('max(northing / 1e5)', 'north')}, {r('median(northing / 1e5)', 'lat')}, {r('median(easting / 1e4)', 'lon')} from fx_collars",
    "filter_by_project": f"with {COLLARS} select hole_id, project_id from fx_collars where project_id = '1-URGENT'",
    "projected_collars": f"""with {COLLARS}, g as (select 1 / (2 * cast(298.257222101 as double) - 1) n),
d as (select hole_id, n, 2 * sqrt(n) / (1 + n) e, sin(radians((northing - 6900000) / cast(100000 as double) - 32)) s, radians((easting - 500000) / cast(5000 as double) + 116.5 - 117) w, 0.9996 * cast(6378137 as double) / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) q from fx_collars, g),
t as (select *, sinh(atanh(s) - e * atanh(e * s)) t from d),
p as (select *, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 a1, 13 * n * n / 48 - 3 * n * n * n / 5 a2, 61 * n * n * n / 240 a3, atan2(t, cos(w)) xi, atanh(sin(w) / sqrt(1 + t * t)) eta from t)
select hole_id, {r("500000 + q * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta))", "easting")},
{r("10000000 + q * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta))", "northing")} from p""",
}
