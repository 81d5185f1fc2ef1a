"""What source_order leaves on disk while it goes from reader to reader."""

import time

import duckdb
from pyspark.sql import functions as F

from orespark.operators import desurvey
from orespark.plans import reader_queries
from orespark.sources import sinks

SF = "/root/testdata/sf0.001"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_files_go_when_their_rows_are_stored(spark):
    given, before = len(sinks.SHARED), spark.conf.get(CLEANUP)
    out = reader_queries.QUERIES["source_order"](spark, SF)
    left = [p.rsplit("/", 1)[1] for p in sinks.SHARED[given:]]
    assert len(left) == 3 and all(name.startswith("order-of-") for name in left) and spark.conf.get(CLEANUP) == before
    con = duckdb.connect()
    con.execute(f"create view lineitem as from '{SF}/lineitem.parquet'")
    assert sorted(map(tuple, out.select("hole_id", "first_rid", "last_rid", "n", "kind").collect())) == sorted(con.execute(reader_queries.ORACLES["source_order"]).fetchall())


def test_shuffles_are_dropped(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    with sinks.shuffles_dropped(spark):
        spark.range(1000).repartitionByRange("id").write.parquet(str(tmp_path / "x"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.read.parquet(str(tmp_path / "x")).count() == 1000


def test_first_and_last_in_one_shuffle(spark):
    df = spark.createDataFrame([("a", 3, 2), ("b", 1, 9), ("a", 1, 7), (None, 4, 4), ("a", 2, 5)], "h string, _row_id int, v int")
    out = desurvey.first_and_last(df, "h", "v")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {tuple(r) for r in out.collect()} == {("a", 7, 2, 3), ("b", 9, 9, 1), (None, 4, 4, 1)}
    empty = desurvey.first_and_last(df.filter(F.lit(False)), "h", "v")
    assert empty.count() == 0
