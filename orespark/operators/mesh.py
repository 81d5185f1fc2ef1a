"""Grade shells: triangulated meshes as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

VERSION = "1.0"
BLOCK = "struct<id:string,name:string,attributes:map<string,string>,material:struct<color:string,opacity:double>,vertices:array<array<double>>,triangles:array<array<int>>>"
DOCUMENT = f"schema_version string, units string, blocks array<{BLOCK}>"


def load_grade_blocks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per mesh of JSON documents, one a file or (lines) one a line; wrong version or missing parts fail."""
    return parse_grade_blocks(spark.read.schema(DOCUMENT).option("multiLine", not lines).json(path))


def parse_grade_blocks_text(df: DataFrame, text_col: str) -> DataFrame:
    """The same from documents held as texts in a column."""
    return parse_grade_blocks(df.select(F.from_json(text_col, DOCUMENT).alias("d")).select("d.*"))


def parse_grade_blocks(docs: DataFrame) -> DataFrame:
    """One row per mesh of parsed documents (schema DOCUMENT)."""
    bad = docs.filter((F.coalesce("schema_version", F.lit("")) != VERSION) | F.col("blocks").isNull())
    if bad.limit(1).count():
        raise ValueError("grade blocks: schema_version must be 1.0 and blocks a list")
    return _checked(docs.select("units", F.explode("blocks").alias("b")).select("units", "b.*"))


def _checked(blocks: DataFrame) -> DataFrame:
    blocks = blocks.withColumn("attributes", F.coalesce("attributes", F.expr("map()").cast("map<string,string>")))
    if blocks.filter("id is null or name is null or vertices is null or triangles is null").limit(1).count():
        raise ValueError("grade blocks: id, name, vertices and triangles are required")
    return blocks


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _above(own: bool) -> WindowSpec:
    """The pieces of a block before each one, with own and itself."""
    return Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Documents cut at closing braces, which are left out: file, block of the file (a task's), at (place in the block), value, quotes,
    whether an odd number of them stands before it in its block, and what it holds outside of texts if the block begins outside of a
    text (out) or inside (ins): net braces (its own closing one too) and brackets, whether it opens a bracket and how many it closes
    before that; key: the one before an opening bracket."""
    text = spark.read.option("lineSep", "}").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", F.regexp_replace("value", r"\\.", "").alias("_plain"))  # without escapes
    rows = rows.withColumn("quotes", _count(F.col("_plain"), '"'))
    rows = rows.withColumns({f"_bare{k}": F.regexp_replace(F.concat(F.lit('"' * k), "_plain"), '"[^"]*("|$)', "") for k in (0, 1)})

    def held(k: int) -> Column:
        bare, outside = F.col(f"_bare{k}"), (F.col("quotes") + k) % 2 == 0
        return F.struct((_count(bare, "{") - outside.cast("int")).alias("braces"), (_count(bare, "[") - _count(bare, "]")).alias("brackets"),
            bare.contains("[").alias("opens"), _count(F.substring_index(bare, "[", 1), "]").alias("closes"), outside.alias("outside"))

    key = F.when(F.contains("value", F.lit("[")), F.regexp_extract("value", r'"([^"\\]*)"\s*:\s*\[\s*\{', 1))
    rows = rows.select("file", "block", "at", "value", "quotes", held(0).alias("_0"), held(1).alias("_1"), key.alias("key"))
    odd = F.coalesce(F.sum("quotes").over(_above(False)), F.lit(0)) % 2 == 1
    return rows.withColumn("_odd", odd).withColumns({"out": F.when(F.col("_odd"), F.col("_1")).otherwise(F.col("_0")),
        "ins": F.when(F.col("_odd"), F.col("_0")).otherwise(F.col("_1"))}).drop("_0", "_1", "_odd")


def _placed(pieces: DataFrame, begins: DataFrame) -> DataFrame:
    """pieces with last: whether the closing brace could end a mesh, by depth, and array: the key of the array at the root that it is
    in, null where that begins in an earlier block. begins: file, block, inside, braces, brackets where each block begins."""
    rows = pieces.join(F.broadcast(begins), ["file", "block"]).withColumn("_c", F.when(F.col("inside"), F.col("ins")).otherwise(F.col("out")))
    rows = rows.withColumns({k: F.col(k) + F.sum(f"_c.{k}").over(_above(True)) for k in ("braces", "brackets")})
    starts = F.col("_c.opens") & (F.col("_c.closes") >= F.col("brackets") - F.col("_c.brackets"))
    return rows.withColumns({"last": F.col("_c.outside") & (F.col("braces") == 1) & (F.col("brackets") == 1),
        "array": F.last(F.when(starts, F.col("key")), ignorenulls=True).over(_above(True))})


def _blocks(rows: DataFrame) -> dict[str, list]:
    """A row for each block, a task's read of a file, by file in order."""
    out: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["file"], r["block"])):
        out.setdefault(r["file"], []).append(r)
    return out


def _context(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, value of all pieces with ends: whether the piece's closing brace ends a mesh, mesh: how many have ended before in
    the file, meshes: how many do in all, and edge: whether the block has pieces before the first end or after the last one.

    Depths and quotes are running sums along each block; sums of whole blocks, a few numbers each, are known before the plan is made.
    """
    pieces = _pieces(spark, path)
    sums = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *[F.sum(f"{s}.{k}").alias(f"{s}_{k}") for s in ("out", "ins") for k in ("braces", "brackets")])
    begins = []
    for file, blocks in _blocks(sums).items():
        inside, braces, brackets = False, 0, 0
        for r in blocks:
            begins.append((file, r["block"], inside, braces, brackets))
            side = "ins" if inside else "out"
            inside, braces, brackets = inside ^ (r["quotes"] % 2 == 1), braces + r[f"{side}_braces"], brackets + r[f"{side}_brackets"]
    placed = _placed(pieces, spark.createDataFrame(begins, "file string, block long, inside boolean, braces long, brackets long"))
    own = F.col("array") == "blocks"
    found = placed.groupBy("file", "block").agg(F.max_by("array", "at").alias("array"), F.count_if(F.col("last") & own).alias("own"),
        F.count_if(F.col("last") & F.col("array").isNull()).alias("carried"))
    starts = []
    for file, blocks in _blocks(found).items():
        array, mesh, seen = None, 0, []
        for r in blocks:
            before, carried = mesh, array == "blocks"
            mesh += r["own"] + (r["carried"] if carried else 0)
            seen.append((file, r["block"], carried, before, mesh))
            array = r["array"] if r["array"] is not None else array
        starts += [(*x[:4], mesh, x[3] == 0 or x[4] == mesh) for x in seen]
    known = spark.createDataFrame(starts, "file string, block long, carried boolean, mesh long, meshes long, edge boolean")
    rows = placed.join(F.broadcast(known), ["file", "block"])
    rows = rows.withColumn("ends", F.col("last") & F.coalesce(own, F.col("carried")))
    return rows.withColumn("mesh", F.col("mesh") + F.coalesce(F.sum(F.col("ends").cast("long")).over(_above(False)), F.lit(0))).select(
        "file", "block", "at", "value", "ends", "mesh", "meshes", "edge")


def load_large_grade_blocks(spark: SparkSession, path: str) -> DataFrame:
    """load_grade_blocks() for documents of any size, one a file: a document is read in pieces, up to each closing brace, and put
    together mesh by mesh, so no row holds more than a mesh, and no task more than its block of a file. Wrong version or missing parts
    fail."""
    rows = _context(spark, path)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "}")
    together = lambda some: some.groupBy("file", "mesh").agg(whole.alias("text"), F.bool_or("ends").alias("ended"))
    # what isn't a mesh: the document before the first one and after the last one
    around = together(rows.filter(F.col("edge") & ((F.col("mesh") == 0) | (F.col("mesh") == F.col("meshes")))))
    head = F.regexp_extract("text", r'^([\s\S]*?"blocks"\s*:\s*\[)', 1)
    frame = around.select("file", F.when(~F.col("ended"), F.col("text")).when(F.col("mesh") == 0, head).alias("text")).dropna()
    said = lambda k: F.max(F.nullif(F.regexp_extract("text", f'"{k}"\\s*:\\s*"([^"]*)"', 1), F.lit("")))
    known = frame.groupBy("file").agg(said("schema_version").alias("schema_version"), said("units").alias("units"),
        F.max(F.col("text").rlike(r'"blocks"\s*:\s*\[')).alias("listed")).collect()  # a row for each document
    if any(r["schema_version"] != VERSION or not r["listed"] for r in known):
        raise ValueError("grade blocks: schema_version must be 1.0 and blocks a list")
    units = spark.createDataFrame([(r["file"], r["units"]) for r in known], "file string, units string")
    own = F.regexp_replace(F.when(F.col("mesh") == 0, F.regexp_replace("text", r'^[\s\S]*?"blocks"\s*:\s*\[', "")).otherwise(F.col("text")), r"^[\s,]+", "")
    # generated, so that filters above don't take the parsing into each of their terms
    meshes = together(rows.filter(F.col("mesh") < F.col("meshes"))).select("file", F.inline(F.array(F.from_json(F.concat(own, F.lit("}")), BLOCK))))
    return _checked(meshes.join(F.broadcast(units), "file").drop("file").select("units", *[c for c in meshes.columns if c != "file"]))


def validate_grade_blocks(meshes: DataFrame) -> DataFrame:
    """id, issue of each mesh: vertices not (n, 3), triangles not (m, 3), an index out of range, a triangle without area."""
    vertices = F.exists("vertices", lambda v: F.size(v) != 3)
    triangles = F.exists("triangles", lambda t: F.size(t) != 3)
    outside = F.exists("triangles", lambda t: F.exists(t, lambda i: (i < 0) | (i >= F.size("vertices"))))

    def flat(t):
        p, q, r = (F.get("vertices", F.get(t, F.lit(k))) for k in range(3))
        u, v = ([F.get(b, F.lit(k)) - F.get(p, F.lit(k)) for k in range(3)] for b in (q, r))
        area = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return area[0] * area[0] + area[1] * area[1] + area[2] * area[2] < 1e-24

    issue = F.when(vertices, "vertices_shape").when(triangles, "triangles_shape").when(outside,
        "index_out_of_range").when(F.exists("triangles", flat), "zero_area_triangle")
    return meshes.withColumn("issue", issue).filter("issue is not null").select("id", "issue")


def flat_geometry(meshes: DataFrame) -> DataFrame:
    """id, positions, indices: flat arrays."""
    return meshes.select("id", F.flatten("vertices").alias("positions"), F.flatten("triangles").alias("indices"))
