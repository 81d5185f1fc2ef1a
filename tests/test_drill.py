import math
import random

import pytest
from pyspark.sql import functions as F

from orespark.functions import colours, projection, scale
from orespark.operators import asof, blockmodel, columns, desurvey, intervals, mesh, structural, validate
from orespark.operators.pivot import long_to_wide
from orespark.sources import ingest, loaders


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


GRADES = "hole_id string, `from` double, `to` double, CU double"


def test_intercepts(spark):
    rows = [("A", 0.0, 10.0, 0.3), ("A", 10.0, 20.0, 0.3), ("A", 20.0, 30.0, 0.3)]
    (r,) = intervals.significant_intercepts(frame(spark, rows, GRADES), "CU", 0.2, 5.0).collect()
    assert (r["from"], r["to"], r["n_samples"], r["label"]) == (0.0, 30.0, 3, "30.0 m @ 0.30 CU") and abs(r["avg_grade"] - 0.3) < 1e-12
    split = [("A", 0.0, 20.0, 1.0), ("A", 20.0, 30.0, 0.0), ("A", 30.0, 50.0, 1.0), (None, 0.0, 50.0, 9.0)]
    out = intervals.significant_intercepts(frame(spark, split, GRADES), "CU", 0.5, 5.0).orderBy("from").collect()
    assert [(r["from"], r["to"]) for r in out] == [(0.0, 20.0), (30.0, 50.0)]
    with pytest.raises(ValueError):
        intervals.significant_intercepts(frame(spark, rows, GRADES), "AU", 0.2, 5.0)


def test_interval_bounds(spark):
    df = frame(spark, [("A", "10.1234", "10.1234"), ("A", "20.0004", "20.0004"), ("A", "x", "3")],
        "hole_id string, `from` string, `to` string")
    assert [tuple(r)[1:] for r in ingest.interval_bounds(df).collect()] == [(10.123, 10.124), (20.0, 20.001), (None, 3.0)]


def test_standardize(spark):
    df = frame(spark, [("h", None, "b", 1.0)], "HoleId string, Lith1 string, rock1 string, ` My.Col ` double")
    out = ingest.standardize(df)
    assert out.columns == ["hole_id", "geology_code", "my.col"] and out.collect()[0][1] == "b"
    assert ingest.standardize(df, {"my.col": "grade"}).columns[-1] == "grade"
    assert ingest.standardize_blocks(frame(spark, [(1, 2)], "XC int, Rock int")).columns == ["x", "Rock"]


def test_loaders(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "w") as f:
        f.write("HoleId,FromDepth,ToDepth,Au\nA,0,1,0.5\nA,1,2,\n")
    out = loaders.load_assays(spark, path)
    assert [(r["from"], r["mid"], r["au"]) for r in out.collect()] == [(0.0, 0.5, 0.5), (1.0, 1.5, None)]
    geology = "HoleId string, FromDepth double, ToDepth double, Lith1 string"
    with pytest.raises(ValueError):
        loaders.load_geology(spark, frame(spark, [("A", 0.0, 10.0, "x"), ("A", 9.5, 20.0, "y")], geology))
    assert loaders.load_geology(spark, frame(spark, [("A", 0.0, 10.12349, "x"), ("A", 10.12351, 20.0, "y")], geology)).count() == 2
    with pytest.raises(ValueError):
        loaders.load_assays(spark, frame(spark, [(None, 0.0, 1.0)], "hole_id string, `from` double, `to` double"))
    with pytest.raises(KeyError):
        loaders.load_collars(spark, frame(spark, [(1.0,)], "latitude double"))
    collars = loaders.load_collars(spark, frame(spark, [("A", "p", -30.0, 118.0, 5.0)],
        "hole_id string, project_id string, lat double, lon double, z double"))
    assert collars.collect()[0]["geometry_crs"] == "EPSG:4326"
    assert loaders.load_surveys(spark, frame(spark, [("A", 0.0, 1.0, 2.0)], "hole_id string, depth double, azimuth double, dip double"),
        keep_all=False).columns == ["hole_id", "depth", "azimuth", "dip"]
    with pytest.raises(ValueError):
        ingest.read_table(spark, "x", kind="avro2")


def test_long_to_wide(spark):
    rows = [("A", 0.0, "au", 1.0), ("A", 0.0, "cu", 2.0), ("A", None, "au", 3.0)]
    out = long_to_wide(frame(spark, rows, "hole_id string, `from` double, code string, value double"), "code", "value").collect()
    assert [tuple(r) for r in out] == [("A", 0.0, 1.0, 2.0)]


def loop_trace(collar, stations, step):
    """Minimum curvature, one step after another."""
    x, y, z = collar
    out = [(stations[0][0], x, y, z)]
    for (m0, a0, d0), (m1, a1, d1) in zip(stations, stations[1:], strict=False):
        if m1 <= m0:
            continue
        u, v = ([math.cos(math.radians(d)) * math.sin(math.radians(a)), math.cos(math.radians(d)) * math.cos(math.radians(a)),
            -math.sin(math.radians(d))] for a, d in ((a0, d0), (a1, d1)))
        b = math.acos(max(-1, min(1, sum(p * q for p, q in zip(u, v, strict=True)))))
        rf = 2 * math.tan(b / 2) / b if b > 1e-6 else 1
        n = max(1, math.ceil((m1 - m0) / step))
        for k in range(1, n + 1):
            x, y, z = (c + (m1 - m0) / n * 0.5 * (p + q) * rf for c, p, q in zip((x, y, z), u, v, strict=True))
            out.append((m0 + (m1 - m0) * k / n, x, y, z))
    return out


def test_desurvey(spark):
    random.seed(1)
    stations = {h: sorted((random.uniform(0, 100), random.uniform(0, 360), random.uniform(-90, -40)) for _ in range(6)) for h in "ABC"}
    collars = frame(spark, [(h, 10.0 * i, 5.0, 300.0) for i, h in enumerate("ABCD")],
        "hole_id string, easting double, northing double, elevation double")
    surveys = frame(spark, [(h, *s) for h, ss in stations.items() for s in ss], "hole_id string, depth double, azimuth double, dip double")
    got = desurvey.minimum_curvature(collars, surveys, 3.0).orderBy("hole_id", "md").collect()
    want = [(h, *v) for i, h in enumerate("ABC") for v in loop_trace((10.0 * i, 5.0, 300.0), stations[h], 3.0)]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and all(abs(a - b) < 1e-8 for a, b in zip(g[1:5], w[1:], strict=True))
    with pytest.raises(ValueError):
        desurvey.desurvey_holes(collars, surveys, method="guess")


def test_nearest_and_interpolation(spark):
    traces = frame(spark, [("A", 0.0, 0.0), ("A", 10.0, 1.0), ("A", 10.0, 2.0), ("A", 20.0, 3.0)],
        "hole_id string, md double, easting double").withColumns({"northing": F.lit(0.0), "elevation": 50.0 - F.col("md")})
    traces = traces.withColumn("_row_id", F.monotonically_increasing_id())
    q = frame(spark, [("A", 5.0), ("A", 6.0), ("A", 99.0), ("B", 1.0)], "hole_id string, depth double")
    got = {(r[0], r[1]): r["easting"] for r in asof.attach_structure_positions(q, traces).collect()}
    assert got == {("A", 5.0): 0.0, ("A", 6.0): 2.0, ("A", 99.0): 3.0, ("B", 1.0): None}
    got = {r["depth"]: r["easting"] for r in asof.nearest_vertex(q, traces, "depth", duplicates="first").collect()}
    assert got[6.0] == 1.0
    line = frame(spark, [("A", 0.0, 50.0), ("A", 10.0, 40.0)], "hole_id string, md double, elevation double")
    q = frame(spark, [("A", 5.0), ("A", -5.0), ("A", 30.0)], "hole_id string, depth double")
    got = {r["depth"]: r["elevation"] for r in asof.interpolate_positions(q, line, columns=["elevation"]).collect()}
    assert got == {5.0: 45.0, -5.0: 55.0, 30.0: 20.0}


def test_composite_against_loop(spark):
    random.seed(2)
    rows, depth = [], 0.0
    for _ in range(60):
        depth += random.choice([0, 0.25, 0.5])
        end = depth + random.choice([0.25, 0.5, 1.25, 3.0])
        rows.append(("A", depth, end, random.choice([None, random.uniform(0, 5)])))
        depth = end
    for length in (2.0, 2.5, 3.0):
        got = {r["from"]: r["CU"] for r in intervals.composite(frame(spark, rows, GRADES), "CU", length).collect()}
        start, stop, want = rows[0][1], max(r[2] for r in rows), {}
        for i in range(math.ceil((stop + length - start) / length)):
            a, b = start + i * length, start + (i + 1) * length
            over = [(min(r[2], b) - max(r[1], a), r[3]) for r in rows if r[1] < b and r[2] > a]
            if over:
                want[a] = sum(o * (v or 0) for o, v in over) / sum(o for o, _ in over)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_structural(spark):
    df = frame(spark, [(45.0, 270.0), (95.0, 370.0), (None, -10.0)], "dip double, azimuth double")
    n = structural.with_plane_geometry(df).collect()[0]
    assert all(abs(a - b) < 1e-9 for a, b in zip((n.normal_x, n.normal_y, n.normal_z), (-math.sqrt(0.5), 0, math.sqrt(0.5)),
        strict=True)) and n.strike == 180.0
    assert [tuple(r) for r in structural.normalize_dip_azimuth(df).collect()] == [(45.0, 270.0), (90.0, 10.0), (None, 350.0)]
    (p,) = structural.project_to_section(frame(spark, [(10.0, 0.0)], "easting double, northing double"), (0.0, 0.0), 0.0).collect()
    assert (p.along, p.across) == (0.0, 10.0)
    core = frame(spark, [(90.0, 0.0), (30.0, None)], "alpha double, beta double")
    hole = (F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    first, second = structural.alpha_beta_normals(core, hole).collect()
    assert abs(first.normal_y - 1) < 1e-9 and abs(second.normal_z + math.sin(math.radians(60))) < 1e-9


def test_blocks(spark):
    rows = [(i, 5.0 + 10 * (i % 3), 5.0 + 10 * (i // 3 % 2), 5.0 + 10 * (i // 6), 10.0, 10.0, 5.0, i / 10, "ab"[i % 2]) for i in range(12)]
    df = frame(spark, rows, "block_id int, x double, y double, z double, dx double, dy double, dz double, grade double, rock string")
    model = blockmodel.BlockModel(df)
    assert model.volume() == 12 * 500 and model.volume({"grade": {"gt": 0.75}}) == 2000
    assert model.volume("grade > 0.75 and rock == 'a'") == 1000 and model.volume({"nothing": 1}) == 6000
    assert model.attribute_stats("rock") == {"count": 12, "value_counts": {"a": 6, "b": 6}}
    assert model.bbox_3d["max_x"] == 30.0 and model.outline_2d["coordinates"][0][0] == [0.0, 0.0]
    random.seed(3)
    cloud = [(i, *(random.uniform(0, 30) for _ in range(3)), *(random.uniform(1, 8) for _ in range(3))) for i in range(120)]
    boxes = frame(spark, cloud, "block_id int, x double, y double, z double, dx double, dy double, dz double")
    want = {(p[0], q[0]) for p in cloud for q in cloud if p[0] < q[0] and all(abs(p[k] - q[k]) < (p[k + 3] + q[k + 3]) / 2 - 1e-6 for k in (1, 2, 3))}
    assert {tuple(r) for r in blockmodel.overlaps(boxes, "block_id").collect()} == want and want
    assert blockmodel.property_stats(df, ["grade", "rock"])["rock"]["categories"] == ["a", "b"]


def test_mesh(spark, tmp_path):
    path = str(tmp_path / "m.json")
    good = '{"id":"1","name":"n","vertices":[[0,0,0],[1,0,0],[0,1,0]],"triangles":[[0,1,2]]}'
    bad = '{"id":"2","name":"n","vertices":[[0,0,0],[1,0,0],[2,0,0]],"triangles":[[0,1,2]]}'
    with open(path, "w") as f:
        f.write(f'{{"schema_version":"1.0","units":"m","blocks":[{good},{bad}]}}')
    meshes = mesh.load_grade_blocks(spark, path)
    assert [tuple(r) for r in mesh.validate_grade_blocks(meshes).collect()] == [("2", "zero_area_triangle")]
    assert len(mesh.flat_geometry(meshes).collect()[0].positions) == 9


def test_columns_and_colours(spark):
    df = frame(spark, [("A", "1.5", "note", None, 10.0, "x")],
        "hole_id string, au string, comments string, empty string, dip double, lith string")
    assert columns.classify_columns(df) == {"hole_id": "hidden", "au": "numeric", "comments": "comment", "empty": "hidden",
        "dip": "tadpole", "lith": "categorical"}
    assert colours.commodity_colour("au_ppm") == "#FFD700" and colours.commodity_colour("x") is None
    with pytest.raises(ValueError):
        colours.resolve_colour_map("rainbow")
    with pytest.raises(TypeError):
        colours.resolve_colour_map(3)
    c = colours.colour(F.col("lith"), {"X": "#1"}, "#0")
    assert df.select(c).collect()[0][0] == "#1"
    bins = scale.quantile_bins(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v", 4).orderBy("bin").collect()
    assert [(b.lo, b.hi) for b in bins] == [(1.0, 26.0), (26.0, 51.0), (51.0, 76.0), (76.0, 100.0)]


def test_validators(spark):
    df = frame(spark, [("A", 0.0, 5.0), ("A", 4.0, 4.0), ("A", None, 9.0)], "hole_id string, `from` double, `to` double")
    assert sorted(r.issue for r in validate.validate_intervals(df).collect()) == ["missing_depth", "non_positive_length", "overlap"]
    points = frame(spark, [("A", None, 99.0, 0.0), ("A", 1.0, 99.0, 360.0)], "hole_id string, depth double, dip double, azimuth double")
    assert sorted(r.issue for r in validate.validate_structural_points(points).collect()) == ["azimuth_out_of_range", "dip_out_of_range",
        "missing_depth"]
    surveys = frame(spark, [("A", 5.0, 1), ("A", 3.0, 2), ("B", 1.0, 3)], "hole_id string, depth double, o int")
    assert [r.hole_id for r in validate.validate_surveys(surveys, depth_col="depth", order_col="o").collect()] == ["A"]


def test_streaming(spark, tmp_path):
    from orespark.streaming.assays import normalised_assays

    frame(spark, [("A", 0.0, 1.0), ("A", 3.0, 2.0)], "HoleId string, FromDepth double, ToDepth double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("HoleId string, FromDepth double, ToDepth double").parquet(str(tmp_path / "in"))
    query = normalised_assays(stream).writeStream.format("memory").queryName("assays").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select mid from assays").collect()[0][0] == 0.5


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_utm(spark):
    """Against the meridian arc by numeric integration, a published point, and symmetry about the meridian."""
    df = frame(spark, [("tower", "43.64256", "-79.38714"), ("axis", "-31.5", "-81"), ("west", "20", "-82"), ("east", "20", "-80"),
        ("bad", "x", "-81"), ("null", None, None)], "id string, latitude string, longitude string")
    got = {r.id: (r.easting, r.northing) for r in projection.with_utm(df, 17).collect()}
    assert abs(got["tower"][0] - 630084) < 2 and abs(got["tower"][1] - 4833438) < 2
    f, steps = 1 / projection.INVERSE_FLATTENING, 20_000
    e2, width = f * (2 - f), math.radians(31.5) / steps
    arc = sum((1 - e2 * math.sin((k + 0.5) * width) ** 2) ** -1.5 for k in range(steps)) * width * projection.AXIS * (1 - e2)
    assert abs(got["axis"][0] - 500_000) < 1e-6 and abs(got["axis"][1] + 0.9996 * arc) < 1e-3
    assert abs(got["west"][0] + got["east"][0] - 1_000_000) < 1e-6 and abs(got["west"][1] - got["east"][1]) < 1e-6
    assert got["bad"][1] is None and got["null"] == (None, None)


LONG = "hole_id string, `from` double, `to` double, assay_type string, assay_result double"


def test_long_tables(spark):
    """flat=False widens a long table, the first value in source order counts; flat=True leaves it alone."""
    rows = [("A", 0.0, 1.0, "cu", 1.0), ("A", 0.0, 1.0, "cu", 9.0), ("A", 0.0, 1.0, "au", None), ("A", 1.0, 2.0, "au", 2.0),
        ("A", 1.0, 2.0, "cu", None)]
    table = ingest.with_row_id(frame(spark, rows, LONG).coalesce(1))
    wide = loaders.in_order(loaders.load_assays(spark, table, flat=False))
    assert [c for c in wide.columns if c not in ("hole_id", "from", "to", "mid", "_row_id")] == ["cu", "au"]  # by appearance
    assert [(r["from"], r["cu"], r["au"]) for r in wide.collect()] == [(0.0, 1.0, None), (1.0, None, 2.0)]
    assert loaders.load_assays(spark, table).count() == len(rows)
    with pytest.raises(ValueError, match="long table"):
        loaders.load_assays(spark, table.drop("assay_type"), flat=False)
    with pytest.raises(ValueError, match="more than 1 codes"):
        long_to_wide(table, "assay_type", "assay_result", max_codes=1)
    geology = frame(spark, [("A", 0.0, 10.0, "lith", "x"), ("A", 0.0, 10.0, "min", "y")],
        "hole_id string, `from` double, `to` double, lith_code string, description string")
    assert loaders.load_geology(spark, geology.withColumnRenamed("description", "value"), flat=False).select("lith",
        "min").collect()[0] == ("x", "y")


def test_strict_loaders(spark):
    """What one dialect accepts and the other doesn't."""
    equal = frame(spark, [("A", 1.0, 1.0)], "hole_id string, `from` double, `to` double")
    assert loaders.load_assays(spark, equal).collect()[0]["to"] == 1.001
    with pytest.raises(ValueError, match="to_le_from"):
        loaders.load_assays(spark, equal, js=True)
    xy = frame(spark, [("A", "1", "2")], "hole_id string, x string, y string")
    assert loaders.load_collars(spark, xy, js=True).collect()[0]["easting"] == 1.0
    with pytest.raises(ValueError, match="crs"):
        loaders.load_collars(spark, xy.withColumns({"project": F.lit("p"), "z": F.lit(0.0)}))
    with pytest.raises(ValueError, match="missing_coordinates"):
        loaders.load_collars(spark, frame(spark, [("A", "far", "2")], "hole_id string, x string, y string"), js=True)
    with pytest.raises(ValueError, match="missing_dip"):
        loaders.load_surveys(spark, frame(spark, [("A", "0", "1", "?")], "hole_id string, depth string, azimuth string, dip string"),
            strict=True)
    kept = loaders.load_surveys(spark, frame(spark, [("A", 0.0, 5.0, 1.0, 2.0)],
        "hole_id string, depth double, `to` double, azimuth double, dip double"), keep_all=False)
    assert kept.columns == ["hole_id", "depth", "to", "azimuth", "dip"]
    with pytest.raises(ValueError, match="neither"):
        loaders.load_geology(spark, equal, js=True)
    with pytest.raises(ValueError, match="blank"):
        loaders.parse_assays(spark, equal, hole_id=" ")
    assert ingest.coerce_numeric(frame(spark, [("Infinity",), ("NaN",), ("1e3",)], "v string"), ["v"]).collect() == [(None,), (None,),
        (1000.0,)]
    empty = loaders.Dataset().tables(spark)
    assert len(empty) == 6 and empty["collars"].count() == 0 and "hole_id" in empty["geotechnical"].columns


def test_sinks_and_bounds(spark, tmp_path):
    from orespark.plans import payload
    from orespark.sources import sinks

    rows = [("A", None, "p, q", 0.0, -32.0, 117.0, 0.0, -32.0, 117.0, 5.0), ("A", None, "p, q", 9.0, -32.0, 117.0, -9.0, -32.0, 117.0, 5.0),
        ("B", " C ", None, 0.0, -32.0, 117.0, 0.0, -32.0, 117.0, None)]
    traces = frame(spark, rows,
        "hole_id string, company_hole_id string, project string, md double, lat double, lng double, z double, collar_lat double, collar_lng double, collar_elevation double")
    path = sinks.write_csv(sinks.export_rows(traces, 50), str(tmp_path / "t"))
    got = ingest.read_table(spark, path).orderBy("order").collect()
    assert [(r.hole_id, r.project, r.order, r.z) for r in got] == [("A", "p, q", 0, 5.0),
        ("A", "p, q", 1, -4.0)] and abs(got[0].x) < 1e-6  # a hole of one point is left out
    box = "min_x double, min_y double, max_x double, max_y double"
    assert payload.normalized_bounds(frame(spark, [(0.0, 0.0, 1.0, 2.0)], box)).collect()[0].max_y == 2.0
    with pytest.raises(Exception, match="positive"):
        payload.normalized_bounds(frame(spark, [(0.0, 0.0, 0.0, 2.0)], box)).collect()
    with pytest.raises(Exception, match="too many cells"):
        intervals.composite(frame(spark, [("A", 0.0, 1e12, 1.0)], GRADES), "CU", 1.0).collect()
    with pytest.raises(TypeError):
        blockmodel.criteria_column(frame(spark, [(1,)], "x int"), 5)
    path = str(tmp_path / "m.json")
    with open(path, "w") as f:
        f.write('{"name": "n"}')
    assert blockmodel.load_metadata(path) == {"name": "n"}


def test_block_size_classes(spark):
    """One huge block among small ones, and blocks of all sizes, against all pairs."""
    random.seed(9)
    cloud = [(0, 50.0, 50.0, 50.0, 500.0, 500.0, 500.0)] + [(i, *(random.uniform(0, 100) for _ in range(3)),
        *(random.choice([0.3, 1.0, 4.0, 30.0]) for _ in range(3))) for i in range(1, 150)]
    boxes = frame(spark, cloud, "block_id int, x double, y double, z double, dx double, dy double, dz double")
    want = {(p[0], q[0]) for p in cloud for q in cloud if p[0] < q[0] and all(abs(p[k] - q[k]) < (p[k + 3] + q[k + 3]) / 2 - 1e-6 for k in (1, 2, 3))}
    got = [tuple(r) for r in blockmodel.overlaps(boxes, "block_id").collect()]
    assert set(got) == want and len(got) == len(want) > 149


def test_ranks(spark):
    """Ranks over several ranges, with ties, against a sort."""
    from orespark.functions import scale as s

    random.seed(6)
    values = [float(random.randrange(500)) for _ in range(3000)]
    s.PER_RANGE, kept = 400, s.PER_RANGE
    try:
        df = frame(spark, [(v,) for v in values], "v double").repartition(5)
        ordered = sorted(values)
        got = s.quantile_bins(df, "v", 7).orderBy("bin").collect()
        assert [(b.lo, b.hi) for b in got] == [(ordered[int(i / 7 * 3000)], ordered[min(2999, int((i + 1) / 7 * 3000))]) for i in range(7)]
        ids = spark.range(0, 9000, 3).select(F.col("id").alias("k"))
        assert sorted(r.k for r in s.systematic_sample(ids, "k", 700).collect()) == [3 * (i * 3000 // 700) for i in range(700)]
        assert s.systematic_sample(ids, "k", 3000).count() == 3000
    finally:
        s.PER_RANGE = kept


def test_hash_units_beyond_the_plane(spark):
    """Hashes take UTF-16 units: two for a character beyond the basic plane."""

    def unit(text):
        h = 2166136261
        raw = text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % (1 << 32)
        return h / 4294967295

    texts = ["", "granite", "né", "\U0001f600 x"]
    got = {r.t: r.u for r in frame(spark, [(t,) for t in texts], "t string").select("t",
        colours.seeded_unit(F.col("t")).alias("u")).collect()}
    assert all(abs(got[t] - unit(t)) < 1e-12 for t in texts)
    assert frame(spark, [("",)], "t string").select(colours.hsl(F.lit(0.0), 1.0, 0.5), colours.hsl(F.lit(1 / 3), 1.0, 0.5),
        colours.hsl(F.lit(0.6), 0.0, 0.5)).collect()[0] == ("#ff0000", "#00ff00", "#808080")
