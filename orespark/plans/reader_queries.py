"""Queries of source order, lookups, criteria texts, extents, locale order, chunks and streams, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import projection
from ..model import ROW
from ..operators import blockmodel, columns, desurvey
from ..sources import ingest, loaders, sinks
from ..streaming.intercepts import STORE, stream_intercepts
from . import fixtures as fx
from . import payload
from . import source_fixtures as raw
from .oracles import BLOCKS, COLLARS, INTERCEPTS, INTERVALS, r
from .queries import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Source order

#: The number of the file that a row is written to: files of unequal sizes, in another order than the rows' own.
FILE = "case when l_linenumber = 7 then 0 when l_linenumber in (2, 4) then 1 when l_linenumber = 1 then 2 else 3 end"
BY_FILE = f"""{raw.LINES}, fl as (select *, {FILE} f from rl),
fo as (select hole hole_id, arg_min(rid, (f, rid)) first_rid, arg_max(rid, (f, rid)) last_rid, count(*) n from fl group by hole)"""


def _written_files(s: SparkSession, d: str, kind: str) -> str:
    """All lines, written to folders of several files, to be read again: the source's order is that of paths, then of rows in a file."""
    rows = raw.lines(s, d).select(F.col("hole").alias("hole_id"), F.col(ROW).alias("rid"), F.expr(FILE).alias("f"))
    path = sinks.shared_path(s, f"order-{kind}")
    dealt = rows.repartitionByRange("f", "rid").sortWithinPartitions("f", "rid").write.partitionBy("f")
    dealt.option("header", True).csv(path) if kind == "csv" else dealt.format(kind).save(path)
    return path


@query(f"with {BY_FILE} select hole_id, first_rid, last_rid, n, kind from fo, (select unnest(['csv', 'parquet', 'json']) kind)")
def source_order(s: SparkSession, d: str) -> DataFrame:
    """First and last row of each hole in the order of its source, a table in several files of unequal sizes, by three readers: one after
    the other, each one's files and shuffles deleted when its rows are stored."""

    def of(kind: str) -> DataFrame:
        out = sinks.shared_path(s, f"order-of-{kind}")
        with sinks.shuffles_dropped(s):
            path = _written_files(s, d, kind)
            rows = ingest.read_table(s, path, kind).select("hole_id", F.col("rid").cast("long").alias("rid"), ROW)
            found = desurvey.first_and_last(rows, "hole_id", "rid").withColumnsRenamed({"first": "first_rid", "last": "last_rid"})
            found.write.parquet(out)
        sinks.clear_shared(s, path)
        return s.read.schema(found.schema).parquet(out).withColumn("kind", F.lit(kind))

    return reduce(DataFrame.unionByName, map(of, ("csv", "parquet", "json")))


@query(f"""with {raw.raw_assays(False)}, p as (select *, row_number() over (partition by hole order by a, b nulls last, rid) k from ra where hole is not null)
select hole hole_id, rid, cast(k as int) place from p""")
def ordered_rows(s: SparkSession, d: str) -> DataFrame:
    """The order in which a loaded table is shown: by hole, from and to, missing values last, then as in the source."""
    table = ingest.coerce_numeric(ingest.standardize(raw.assays(s, d, False)), ["from", "to"]).withColumn("hole_id", F.trim("hole_id"))
    placed = loaders.in_order(table.filter("hole_id <> ''")).withColumn("at", F.monotonically_increasing_id())  # of sorted rows
    return placed.select("hole_id", F.col(ROW).alias("rid"), F.row_number().over(Window.partitionBy("hole_id").orderBy("at")).alias("place"))


@query(f"""with {COLLARS}, n as (select hole_id, project_id, cast(substr(hole_id, 3) as bigint) k from fx_collars),
m as (select hole_id, project_id, case when k % 19 <> 0 then concat(case k % 6 when 0 then 'é' when 1 then 'e' when 2 then 'E' when 3 then 'f' when 4 then 'D' else 'É' end, case when k % 2 = 0 then 'a' else 'B' end, ' ', k % 10) end name from n)
select hole_id, cast(row_number() over (partition by project_id order by name collate en nulls last, hole_id) as int) place from m""")
def locale_order(s: SparkSession, d: str) -> DataFrame:
    """Names with accents and mixed case in the order of a reader's list, missing ones last."""
    k = F.substring("hole_id", 3, 20).cast("long")
    letter = F.element_at(F.array(*map(F.lit, "éeEfDÉ")), (k % 6 + 1).cast("int"))
    name = F.when(k % 19 != 0, F.concat(letter, F.when(k % 2 == 0, "a").otherwise("B"), F.lit(" "), k % 10))
    t = fx.collars(s, d).select("hole_id", "project_id", name.alias("name"))
    w = Window.partitionBy("project_id").orderBy(F.asc_nulls_last(loaders.sort_key(t, "name")), "hole_id")
    return t.select("hole_id", F.row_number().over(w).alias("place"))


# Readers


@query(f"""with {raw.raw_assays(False)}, h as (select unnest([min(hole), max(hole)]) hole from ra) select hole hole_id, {r('a', '"from"')}, {r('b', '"to"')}, rid from ra join h using (hole)""")
def hole_lookup(s: SparkSession, d: str) -> DataFrame:
    """Point lookups in a table that is clustered by hole: two holes, each from the row groups that can hold it."""
    table = ingest.standardize(raw.assays(s, d, False))
    path = loaders.write_holes(ingest.coerce_numeric(table, ["from", "to"]), sinks.shared_path(s, "holes"), partitions=8)
    ends = s.read.parquet(path).agg(F.min("hole_id"), F.max("hole_id")).head()
    found = [loaders.rows_of_hole(s, path, f" {h}") for h in ends]
    return rounded(found[0].unionByName(found[1]).select("hole_id", "from", "to", F.col(ROW).alias("rid")), "from", "to")


@query(f"""with {INTERVALS}, n as (select count(*) n from fx_intervals) select kind, false refused, n from n, (select unnest(['csv', 'json', 'orc', 'parquet', 'sql']) kind)
union all select kind, true, 0 from n, (select unnest(['xlsx', 'parquet in the other dialect', 'sql in the other dialect']) kind)""")
def source_kinds(s: SparkSession, d: str) -> DataFrame:
    """A table read from every kind of source; kinds that aren't known are refused, as are two in the other dialect."""
    rows = fx.intervals(s, d)
    rows.createOrReplaceTempView("orespark_kinds")

    def of(kind: str) -> DataFrame:
        path = sinks.shared_path(s, f"kind-{kind}")
        if kind == "csv":
            rows.write.option("header", True).csv(path)
        elif kind != "sql":
            rows.write.format(kind).save(path)
        table = ingest.read_table(s, path, kind, **({"table": "orespark_kinds"} if kind == "sql" else {}))
        return table.agg(F.lit(kind).alias("kind"), F.lit(False).alias("refused"), F.count("*").alias("n"))

    parts = [of(k) for k in ("csv", "json", "orc", "parquet", "sql")]
    for name, kind, js in (("xlsx", "xlsx", False), ("parquet in the other dialect", "parquet", True), ("sql in the other dialect", "sql", True)):
        try:
            part = ingest.read_table(s, "somewhere", kind, js=js).agg(F.lit(name).alias("kind"), F.lit(False).alias("refused"), F.count("*").alias("n"))
        except ValueError:
            part = rows.limit(0).agg(F.lit(name).alias("kind"), F.lit(True).alias("refused"), F.count("*").alias("n"))
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


@query(f"with {raw.LINES} select hole hole_id, l_linestatus geology_code, l_returnflag rock, rid from rl")
def own_names(s: SparkSession, d: str) -> DataFrame:
    """A source's own names, given by the caller, win over the known ones."""
    t = raw.lines(s, d).select(F.col("hole").alias("Bore No"), F.col("l_linestatus").alias(" MY CODE "), F.col("l_returnflag").alias("Lith1"), F.col(ROW).alias("rid"))
    return ingest.standardize(t, {"bore no": "hole_id", "My Code": "geology_code", "lith1": "rock"})


# Criteria texts

CRITERIA = {
    "chained": ("1 < grade < 3", "grade > 1 and grade < 3"),
    "loose_and": ("grade > 1 & grade < 3 | density >= @least", "(grade > 1 and grade < 3) or density >= 4"),
    "negated": ("~(grade > 2) and not rock_type == 'PROMO'", "not grade > 2 and not rock_type = 'PROMO'"),
    "listed": ("rock_type in ['PROMO', 'SMALL'] and grade not in @grades", "rock_type in ('PROMO', 'SMALL') and grade not in (0.1, 0.5)"),
    "quoted": ("`block no` % 7 == 3 or `block no` // 100 == 2", "block_id % 7 = 3 or block_id // 100 = 2"),
    "computed": ("grade * 2 - density / 4 > 3.5", "grade * 2 - density / 4 > 3.5"),
}


@query(f"with {BLOCKS} select block_id, " + ", ".join(f"({sql}) {n}" for n, (_, sql) in CRITERIA.items()) + " from fx_blocks")
def criteria_texts(s: SparkSession, d: str) -> DataFrame:
    """Criteria in the syntax of data-frame queries, each as a column."""
    b = fx.blocks(s, d).withColumn("block no", F.col("block_id"))
    given = {"least": 4, "grades": [0.1, 0.5]}
    return b.select("block_id", *[blockmodel.criteria_column(b, text, given=given).alias(n) for n, (text, _) in CRITERIA.items()])


@query(f"""with {raw.RAW_BLOCKS} select 'numbers as texts' kind, cast(sum(1000) as double) volume from rk where grade > 2 union all select 'texts that are no numbers', cast(sum(case when rid % 7 = 0 then 0 else 100 * cast(code as double) end) as double) from rk where grade > 2""")
def volume_of_texts(s: SparkSession, d: str) -> DataFrame:
    """Sizes that are texts count as their numbers, those that are none as 0."""
    b = ingest.standardize_blocks(raw.blocks(s, d))
    parts = {"numbers as texts": b.withColumn("dz", F.lit("10")), "texts that are no numbers": b.withColumn("dz", F.col("Code"))}
    return reduce(DataFrame.unionByName, [blockmodel.volume(t, "Grade > 2").select(F.lit(n).alias("kind"), "volume") for n, t in parts.items()])


# Extents

INVERSE = """zd as (select *, 1 / (2 * cast(298.257222101 as double) - 1) nn from box),
zr as (select *, 2 * sqrt(nn) / (1 + nn) ee, 0.9996 * cast(6378137 as double) / (1 + nn) * (1 + nn * nn / 4 + nn * nn * nn * nn / 64) q from zd),
zx as (select *, (cy - 10000000) / q xi, (cx - 500000) / q eta, nn / 2 - 2 * nn * nn / 3 + 37 * nn * nn * nn / 96 b1, nn * nn / 48 + nn * nn * nn / 15 b2, 17 * nn * nn * nn / 480 b3 from zr),
zp as (select *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) xp, eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) ep from zx),
zs as (select *, asin(sin(xp) / cosh(ep)) chi from zp),
zl as (select *, chi + (2 * nn - 2 * nn * nn / 3 - 2 * nn * nn * nn) * sin(2 * chi) + (7 * nn * nn / 3 - 8 * nn * nn * nn / 5) * sin(4 * chi) + 56 * nn * nn * nn / 15 * sin(6 * chi) lat from zs)"""


@query(f"""with {COLLARS}, box as (select project_id, min(easting) w, max(easting) e, min(northing) s, max(northing) n, (min(easting) + max(easting)) / 2 cx, (min(northing) + max(northing)) / 2 cy from fx_collars group by project_id), {INVERSE}
select project_id, w west, s south, e east, n north, concat_ws(' ', s, w, n, e) rectangle, cx raw_x, cy raw_y, round(117 + degrees(atan2(sinh(ep), cos(xp))), 7) lon, round(degrees(lat), 7) lat, cx unknown_x from zl""")
def extent_centre(s: SparkSession, d: str) -> DataFrame:
    """Bounds of each project's collars, their rectangle, and their middle: raw, in degrees, and raw where the system isn't known."""
    box = projection.extent(fx.collars(s, d), by=["project_id"])
    box = projection.with_centre(box, "EPSG:28350").withColumnsRenamed({"centre_x": "raw_x", "centre_y": "raw_y"})
    box = projection.with_centre(box, "EPSG:28350", lonlat=True).withColumnsRenamed({"centre_x": "lon", "centre_y": "lat"})
    box = projection.with_centre(box, "EPSG:1234", lonlat=True).withColumnRenamed("centre_x", "unknown_x").drop("centre_y")
    shown = F.concat_ws(" ", F.transform(F.flatten("rectangle"), ingest.plain_text))
    return box.withColumn("rectangle", shown).withColumns({c: F.round(c, 7) for c in ("lon", "lat")})


# Groups of any size


@query(f"""with {raw.RAW_PHOTOS}, k as (select photo_set, rid, row_number() over (partition by photo_set order by coalesce(from_depth, 0), rid) - 1 i from rp)
select photo_set, cast(i // 100 as int) chunk, cast(count(*) as int) n, string_agg(rid, ',' order by i) ids from k group by photo_set, i // 100""")
def photo_chunks(s: SparkSession, d: str) -> DataFrame:
    """Photos of each set by depth, in arrays of at most 100."""
    out = payload.photo_chunks(raw.photos(s, d).select("photo_set", "from_depth", ROW), 100)
    return out.select("photo_set", "chunk", "n", F.array_join(F.transform("rows", lambda p: p[ROW].cast("string")), ",").alias("ids"))


@query(f"""with {raw.raw_assays(False)}, k as (select hole hole_id, a, rid, row_number() over (partition by hole order by a, rid) - 1 i from ra where hole is not null)
select hole_id, cast(i // 3 as int) chunk, cast(count(*) as int) n, string_agg(rid, ',' order by i) ids from k group by hole_id, i // 3""")
def hole_chunks(s: SparkSession, d: str) -> DataFrame:
    """Rows of each hole by depth, in arrays of at most three."""
    table = ingest.coerce_numeric(ingest.standardize(raw.assays(s, d, False)), ["from"])
    out = payload.row_chunks(table, [], ["from", ROW], size=3)
    return out.select("hole_id", "chunk", "n", F.array_join(F.transform("rows", lambda p: p[ROW].cast("string")), ",").alias("ids"))


@query(f"""with {raw.LINES}, t as (select l_tax, l_discount, count(*) n from rl group by all) select kind, names, n from (select count(*) n from rl), (select unnest(['numeric', 'tadpole', 'categorical', 'comment', 'all']) kind, unnest(['au,zn', 'dip', 'lith', 'comments', 'au,zn,dip,lith,comments']) names)""")
def property_lists(s: SparkSession, d: str) -> DataFrame:
    """The columns of a table by display type, and all that are shown in their order, with the number of its rows."""
    t = raw.lines(s, d).select(F.col("hole").alias("hole_id"), F.col("l_tax").alias("zn"), F.col("l_discount").alias("au"), F.col("l_tax").alias("dip"),
        F.col("l_returnflag").alias("lith"), F.lit("seen").alias("comments"))
    lists = columns.property_lists(columns.classify_columns(t))
    marks = [F.struct(F.lit(k).alias("kind"), F.lit(",".join(v)).alias("names"), F.count("*").alias("n")) for k, v in lists.items()]
    return t.agg(F.array(*marks).alias("m")).select(F.explode("m").alias("m")).select("m.*")


# Streams


@query(f"""with {INTERVALS}, {INTERCEPTS} select hole_id, {r('"from"', '"from"')}, {r('"to"', '"to"')}, {r('"to" - "from"', "length")}, {r("grade", "avg_grade")}, n_samples from hits""")
def streamed_intercepts(s: SparkSession, d: str) -> DataFrame:
    """All intervals streamed to their end, each hole down its depth with some disorder: every run is emitted once, when it closes."""
    rows = fx.intervals(s, d)
    late = F.pmod(F.xxhash64("hole_id", "from"), F.lit(300))  # seconds by which a row comes late
    seconds = F.col("from").cast("long") * 300
    rows = rows.withColumns({"at": F.timestamp_seconds(F.lit(1_700_000_000) + seconds), "batch": F.least(F.lit(2), F.floor((seconds + late) / 1500)).cast("int")})
    path = sinks.shared_path(s, "interval-stream")
    rows.write.partitionBy("batch").parquet(path)  # three deliveries, then the end of the log
    rows = rows.drop("batch")
    end = s.read.schema(rows.schema).parquet(path).limit(1).select(F.lit("").alias("hole_id"), F.lit(0.0).alias("from"), F.lit(0.0).alias("to"),
        F.lit(0.0).alias("au_ppm"), "geology_code", F.timestamp_seconds(F.lit(1_900_000_000)).alias("at"))
    end.write.parquet(f"{path}/end")
    out = sinks.shared_path(s, "streamed-intercepts")
    before = {k: s.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            s.conf.set(k, v)
        stream = s.readStream.schema(end.schema).option("recursiveFileLookup", True).parquet(path)
        found = stream_intercepts(stream, "au_ppm", 3.0, 2.0, "at", delay="10 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", sinks.shared_path(s, "stream-state")).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            s.conf.set(k, v) if v is not None else s.conf.unset(k)
    return rounded(s.read.schema(found.schema).parquet(out), "from", "to", "length", "avg_grade")
