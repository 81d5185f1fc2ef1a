"""Joins along a hole against plain loops: long holes, repeated depths, all methods, and a hole with most of the queries."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from orespark.operators import asof, desurvey

XYZ = ("easting", "northing", "elevation")


@pytest.fixture(scope="module")
def stations():
    random.seed(11)
    out = {}
    for h, n in (("A", 90), ("B", 1), ("C", 2), ("D", 40)):
        depths = sorted(random.choice((0, 5, 5, 13)) + 20.0 * i for i in range(n))
        if h == "D":  # repeated depths, the first ones too
            depths[:3] = [depths[0]] * 3
            depths[20] = depths[19]
        out[h] = [(m, random.uniform(0, 360), random.uniform(-90, -30)) for m in depths]
    return out


def tables(spark, stations):
    collars = spark.createDataFrame([(h, 100.0 * i, 50.0, 300.0) for i, h in enumerate(stations)], "hole_id string, easting double, northing double, elevation double")
    rows = [(h, *s, i) for h, ss in stations.items() for i, s in enumerate(ss)]
    return collars, spark.createDataFrame(rows, "hole_id string, depth double, azimuth double, dip double, _row_id long")


def asked(spark, stations):
    random.seed(12)
    depths = [random.uniform(-10, 1900) for _ in range(300)] + [m for m, _, _ in stations["A"]] + [m for m, _, _ in stations["D"]] + [2.5, 0.0]
    rows = [(h, d, i) for i, d in enumerate(depths) for h in (*stations, "none")] + [(None, 1.0, -1), ("A", None, -2)]
    return spark.createDataFrame(rows, "hole_id string, depth double, q long")


@pytest.mark.parametrize("method", desurvey.METHODS)
def test_nearest_on_pairs_equals_nearest_vertex(spark, stations, method):
    collars, surveys = tables(spark, stations)
    queries = asked(spark, stations)
    vertices = desurvey.desurvey_holes(collars, surveys, 3.0, method)
    by_hole = {}
    for r in vertices.collect():
        by_hole.setdefault(r["hole_id"], []).append((r["md"], *[r[c] for c in (*XYZ, "azimuth", "dip")]))
    pairs = desurvey.station_pairs(collars, surveys, 3.0, method)
    for got in (asof.nearest_on_pairs(queries, pairs, "depth", method=method, keep_unplaced=True),
            asof.nearest_vertex(queries, vertices, "depth", keep_unplaced=True)):
        rows = got.collect()
        assert len(rows) == queries.count()
        for r in rows:
            mine = sorted(by_hole.get(r["hole_id"], [])) if r["depth"] is not None else []
            if not mine:
                assert r["md"] is None and r["easting"] is None
                continue
            best = min(abs(v[0] - r["depth"]) for v in mine)
            near = [v for v in mine if abs(abs(v[0] - r["depth"]) - best) < 1e-9]
            assert any(all(abs(a - r[c]) < 1e-6 for a, c in zip(v, ("md", *XYZ, "azimuth", "dip"), strict=True)) for v in near), (r, near)
            clear = [v for v in mine if abs(v[0] - r["depth"]) < best + 1e-6]
            if len(clear) == 1:
                assert abs(clear[0][0] - r["md"]) < 1e-9
    assert asof.nearest_on_pairs(queries, pairs, "depth", method=method).count() == queries.count() - 2


def test_interpolation_on_stations_equals_vertices(spark, stations):
    collars, surveys = tables(spark, stations)
    queries = asked(spark, stations)
    fine, coarse = (desurvey.desurvey_holes(collars, surveys, step) for step in (3.0, 1e9))
    key = lambda r: (r["hole_id"], r["q"])
    a, b = (sorted(asof.interpolate_positions(queries, t).collect(), key=key) for t in (fine, coarse))
    assert len(a) == len(b) and len({r["hole_id"] for r in a}) == len(stations)
    inside = {h: (ss[0][0], ss[-1][0]) for h, ss in stations.items()}
    for x, y in zip(a, b, strict=True):
        lo, hi = inside[x["hole_id"]]
        if lo <= x["depth"] <= hi:
            assert all(abs(x[c] - y[c]) < 1e-6 for c in XYZ), (x, y)


def test_runs_of_many_vertices(spark):
    """Repeated depths at the ends of runs; ties by source order; strictly before or at the depth."""
    random.seed(13)
    depths = sorted(float(random.randrange(60)) for _ in range(300))
    vertices = spark.createDataFrame([("H", d, float(i), i) for i, d in enumerate(depths)], "hole_id string, md double, easting double, _row_id long")
    queries = spark.createDataFrame([("H", x / 2, x) for x in range(-4, 130)], "hole_id string, depth double, q long")
    for duplicates, pick in (("last", max), ("first", min)):
        rows = asof.nearest_vertex(queries, vertices, "depth", ["md", "easting"], duplicates=duplicates).collect()
        for r in rows:
            best = min(set(depths), key=lambda d: (abs(d - r["depth"]), d))
            assert (r["md"], r["easting"]) == (best, float(pick(i for i, d in enumerate(depths) if d == best)))
    rows = asof.interpolate_positions(queries, vertices, columns=["easting"]).collect()
    assert len(rows) == 134
    for r in rows:
        i = min(max(bisect.bisect_left(depths, r["depth"]), 1), len(depths) - 1)  # the first segment that encloses the depth
        if depths[i] > depths[i - 1] and depths[0] < r["depth"] < depths[-1]:
            part = (r["depth"] - depths[i - 1]) / (depths[i] - depths[i - 1])
            assert abs(r["easting"] - (i - 1 + part)) < 1e-9


def test_a_hot_hole_is_dealt_to_many_tasks(spark, stations):
    """One hole with a third of all queries: adaptive execution splits it, and no task gets several times the median."""
    collars, surveys = tables(spark, stations)
    pairs = desurvey.station_pairs(collars, surveys, 3.0)
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        i = F.col("id")
        queries = spark.range(0, 60_000, 1, 12).select(F.when(i % 3 == 0, "A").otherwise(F.concat(F.lit("h"), i % 997)).alias("hole_id"),
            (i % 1700).cast("double").alias("depth"), F.sha2(i.cast("string"), 256).alias("note"))
        out = asof.nearest_on_pairs(queries, pairs, "depth")
        rows = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("hole_id") == "A").alias("hot")).collect()
        hot = [r["hot"] for r in rows if r["hot"]]
        assert sum(r["n"] for r in rows) == 60_000 and sum(hot) == 20_000
        assert len(hot) >= 6 and max(hot) <= 20_000 / 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
