"""Source order over files, filters that reach the scan, lookups in clustered tables, partitioned JDBC."""

import pytest
from pyspark.sql import functions as F

from orespark.model import ROW
from orespark.operators import blockmodel, desurvey
from orespark.sources import ingest, loaders


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_ids_follow_paths_not_packing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hole_id,x\nH,first\n")
    (tmp_path / "b.csv").write_text("hole_id,x\n" + "".join(f"H,b{i}\n" for i in range(500)))
    (tmp_path / "c.csv").write_text("hole_id,x\nH,c\nH,last\n")
    for read in ({}, {"inferSchema": False}):
        df = ingest.read_table(spark, str(tmp_path), "csv", **read)
        assert desurvey.first_rows(df, "hole_id").select("x").collect()[0][0] == "first"
        got = [r["x"] for r in df.orderBy(ROW).collect()]
        assert got == ["first", *[f"b{i}" for i in range(500)], "c", "last"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # a file in several blocks
        assert [r["x"] for r in ingest.read_table(spark, str(tmp_path), "csv").orderBy(ROW).collect()] == got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("0", "1"):
        ingest.read_table(spark, str(tmp_path / ("b.csv" if name == "1" else "a.csv")), "csv").drop(ROW).coalesce(1).write.parquet(str(tmp_path / "pq" / name))
    df = ingest.read_table(spark, str(tmp_path / "pq"), "parquet", recursiveFileLookup=True)
    assert [r["x"] for r in df.orderBy(ROW).collect()] == got[:-2]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.concat(F.lit("H"), F.col("id") % 7).alias("hole_id"), F.col("id").cast("double").alias("from"),
        (F.col("id") + 1.0).alias("to"), F.col("id").alias("grade"), *[F.lit(1.0).alias(c) for c in ("x", "y", "z", "dx", "dy", "dz")]).write.parquet(path)
    one = loaders.parse_assays(spark, path, "H3", exact=True, kind="parquet")
    assert "EqualTo(hole_id,H3)" in plan(one) and one.count() == 14
    assert "EqualTo(hole_id,H3)" in plan(loaders.exact_hole(ingest.read_table(spark, path, "parquet"), "H3"))
    blocks = blockmodel.filter_blocks(blockmodel.load_blocks(spark, path, "parquet"), {"grade": {"gt": 90}})
    assert "GreaterThan(grade,90)" in plan(blocks) and blocks.count() == 9
    early = ingest.read_table(spark, path, "parquet", where=lambda df: df["grade"] < 5)
    assert "LessThan(grade,5)" in plan(early) and early.count() == 5
    csv = str(tmp_path / "c")
    spark.read.parquet(path).write.option("header", True).csv(csv)
    early = ingest.read_table(spark, csv, where=lambda df: df["grade"] < 5)
    assert "LessThan(grade,5)" in plan(early) and early.count() == 5 and early.select(ROW).distinct().count() == 5


def scanned(df):
    """Rows that the scan of a collected frame gave out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    todo = [node]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            return node.metrics().apply("numOutputRows").value()
        todo += [node.executedPlan()] if hasattr(node, "executedPlan") and "Adaptive" in node.nodeName() else []
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    raise AssertionError("no scan")


def test_lookups_read_a_row_group(spark, tmp_path):
    n = 60_000
    table = spark.range(n).select(F.concat(F.lit(" h"), F.col("id") % 3000, F.lit(" ")).alias("hole_id"),
        F.col("id").cast("double").alias("from"), F.sha2(F.col("id").cast("string"), 256).alias("note")).repartition(5)
    path = loaders.write_holes(table, str(tmp_path / "holes"), partitions=8)
    one = loaders.rows_of_hole(spark, path, "h777 ")
    assert sorted(r["from"] for r in one.collect()) == [777.0 + 3000 * k for k in range(20)]
    assert 20 <= scanned(loaders.rows_of_hole(spark, path, "h777")) <= n / 6
    assert scanned(loaders.rows_of_hole(spark, path, "h777x")) == 0  # inside the range of a row group: the Bloom filter says no
    assert loaders.rows_of_hole(spark, path, "none").count() == 0


def test_partitioned_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    connection = {"url": url, "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(500).select(F.col("id").cast("int").alias("N"), F.when(F.col("id") != 7, (F.col("id") * 37 % 101 - 50).cast("int")).alias("K"), F.concat(F.lit("h"), F.col("id")).alias("HOLE"))
    rows.write.jdbc(url, "assays", properties={"driver": connection["driver"]})
    want = sorted(map(tuple, rows.collect()), key=repr)
    for how, least in (({}, 1), ({"partition_column": "N", "partitions": 4}, 4), ({"hash_column": "K", "partitions": 3}, 3)):
        for what in ({"table": "assays"}, {"query": "select * from assays where n >= 0"}):
            df = ingest.read_table(spark, "", "sql", connection=connection, **what, **how)
            assert sorted((tuple(r)[:3] for r in df.collect()), key=repr) == want
            assert df.rdd.getNumPartitions() == least
    none = ingest.read_table(spark, "", "sql", connection=connection, query="select * from assays where n < 0", partition_column="N")
    assert none.count() == 0


def test_dialects_and_unknown_kinds(spark):
    with pytest.raises(ValueError):
        ingest.read_table(spark, "x", "parquet", js=True)
    with pytest.raises(ValueError):
        ingest.read_table(spark, "x", "sql", js=True, table="t")
    with pytest.raises(ValueError):
        ingest.read_table(spark, "x", "sql")


def test_projection_there_and_back(spark):
    from orespark.functions import projection

    rows = [(lat / 1.0, 114 + k * 0.37) for lat in range(-80, 0, 7) for k in range(17)]
    df = spark.createDataFrame(rows, "latitude double, longitude double")
    east, north = projection.utm(F.col("latitude"), F.col("longitude"), 50, south=True)
    back = df.withColumns({"e": east, "n": north})
    lat, lon = projection.degrees(F.col("e"), F.col("n"), 50, south=True)
    for r in back.withColumns({"lat": lat, "lon": lon}).collect():
        assert abs(r["lat"] - r["latitude"]) < 1e-9 and abs(r["lon"] - r["longitude"]) < 1e-9
    assert projection.zone_of("EPSG:32719") == (19, True) and projection.zone_of(28350) == (50, True) and projection.zone_of("7850") == (50, True)
    assert projection.zone_of("epsg:4326") is None and projection.zone_of("local grid") is None and projection.zone_of(None) is None
    box = projection.extent(spark.createDataFrame([(1.0, 2.0), (3.0, None), (5.0, 8.0)], "easting double, northing double"))
    assert box.collect()[0]["rectangle"] == [[2.0, 1.0], [8.0, 5.0]]
    assert tuple(projection.with_centre(box, "local grid", lonlat=True).collect()[0][-2:]) == (3.0, 5.0)


def test_located_assays_prefer_given_traces(spark):
    assays = spark.createDataFrame([("A", 0.0, 2.0, 1.0), ("B", 0.0, 2.0, 1.0)], "hole_id string, `from` double, `to` double, mid double")
    collars = spark.createDataFrame([(" a", "p", 0.0, 0.0, 0.0), ("b", "q", 0.0, 0.0, 0.0)], "hole_id string, project_id string, easting double, northing double, elevation double")
    surveys = spark.createDataFrame([("A", 0.0, 0.0, -90.0)], "hole_id string, depth double, azimuth double, dip double")
    traces = spark.createDataFrame([("A", 1.0, 7.0, 8.0, 9.0)], "hole_id string, md double, easting double, northing double, elevation double")
    got = {r["hole_id"]: (r["easting"], r["project_id"]) for r in loaders.located_assays(assays, collars, surveys, traces).collect()}
    assert got == {"A": (7.0, "p"), "B": (None, "q")}
    top = collars.withColumn("hole_id", F.upper(F.trim("hole_id")))
    got = {r["hole_id"]: (r["easting"], r["project_id"]) for r in loaders.located_assays(assays, top, surveys, project="p").collect()}
    assert got == {"A": (0.0, "p")}
    assert loaders.located_assays(assays).select("easting").distinct().collect()[0][0] is None


def test_clearing_what_was_written(spark):
    from orespark.sources import sinks

    path = sinks.write_json(sinks.json_payload(spark.range(3).withColumn("hole_id", F.lit("A")), "hole_id"), sinks.shared_path(spark, "x"))
    assert spark.read.json(path).count() == 3 and sinks.clear_shared(spark) >= 1
    with pytest.raises(Exception):  # noqa: B017
        spark.read.json(path).count()
