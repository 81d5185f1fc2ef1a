"""Chunks of many small groups take one shuffle; only large groups are cut into ranges."""

import pytest
from pyspark.sql import functions as F

from orespark.functions import scale
from orespark.plans import payload


def chunks(spark, rows, size):
    df = spark.createDataFrame(rows, "hole_id string, at double, _row_id long").repartition(6)
    out = payload.row_chunks(df, [], ["at", "_row_id"], size=size)
    want = {}
    for h, a, i in sorted(rows, key=lambda r: r[1:]):
        want.setdefault(h, []).append(i)
    want = {(h, k // size): ids[k:k + size] for h, ids in want.items() for k in range(0, len(ids), size)}
    return out, want


def held(out):
    got = [((r["hole_id"], r["chunk"]), [x["_row_id"] for x in r["rows"]]) for r in out.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("most,large", [(500, 0), (40, 1), (5, 31)])
def test_chunks_of_small_and_large_groups(spark, monkeypatch, most, large):
    monkeypatch.setattr(scale, "PER_RANGE", most)
    monkeypatch.setattr(payload, "COUNTED", 8)  # several groups share a hash
    rows = [(f"H{i % 30}" if i % 4 else "hot", float(i * 7919 % 100), i) for i in range(400)]
    out, want = chunks(spark, rows, 3)
    found = payload._large_groups(spark.createDataFrame(rows, "hole_id string, at double, _row_id long"), ["hole_id"])
    assert (found.count() if found is not None else 0) == large
    assert held(out) == want


def test_small_groups_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(scale, "PER_RANGE", 40)  # ten ranges of rows, none of a group
    rows = [(f"H{i % 30}", float(i * 7919 % 100), i) for i in range(400)]
    df = spark.createDataFrame(rows, "hole_id string, at double, _row_id long")
    out = payload.row_chunks(df, [], ["at", "_row_id"], size=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and held(out) == chunks(spark, rows, 3)[1]


def test_place_among_cuts(spark):
    for n in (0, 1, 2, 3, 10, 97):
        cuts = [F.lit(3 * i) for i in range(n)]
        df = spark.range(-2, 3 * n + 4).select("id", scale._place(cuts, F.col("id")).alias("p"))
        assert all(r["p"] == sum(3 * i <= r["id"] for i in range(n)) for r in df.collect())


def test_sampled_keys_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(scale, "PER_RANGE", 100)
    monkeypatch.setattr(scale, "SAMPLED", 4)
    unique = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    keys = [r["k"] for r in unique.orderBy(F.xxhash64("k"), "k").limit(80).orderBy("k").collect()]
    assert scale.cut_points(unique, "k").__len__() == 19
    cuts = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(scale.cut_points(unique, "k"))]).head()
    assert list(cuts) == [keys[i * 80 // 20] for i in range(1, 20)]
    repeated = unique.withColumn("k", F.concat(F.lit("k"), F.length("k"), F.substring("k", -1, 1)))  # few keys
    assert 0 < len(scale.cut_points(repeated, "k")) <= 19
