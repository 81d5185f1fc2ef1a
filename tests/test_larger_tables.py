"""Registered queries on rows that only larger tables have."""

import duckdb
from pyspark.sql import functions as F

from orespark.plans import reader_queries
from orespark.sources import ingest


def test_coordinates_beyond_ten_million(spark, tmp_path):
    orders = spark.createDataFrame([(0, "a"), (8_999_999, "a"), (77, "b"), (12_000_077, "b")], "o_orderkey long, o_orderpriority string")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in reader_queries.QUERIES["extent_centre"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(reader_queries.ORACLES["extent_centre"]).fetchall())
    assert got[0][5] == "6900000.0 500000.0 11399950.0 504950.0"


def test_texts_of_doubles(spark):
    values = [0.0, -1.5, 9999999.5, 1e7, -12345678.125, 1234567890123456.0, 1e16, 0.001, 0.00012345, 1e-5, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", ingest.plain_text(F.col("v")).alias("t"))
    assert [t for _, t in sorted(rows.collect())] == ["0.0", "-1.5", "9999999.5", "10000000.0", "-12345678.125", "1234567890123456.0", "1.0E16", "0.001",
        "0.00012345", "1.0E-5", None]
