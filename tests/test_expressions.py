"""Criteria texts against the data-frame library's own evaluation; ranks, chunks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orespark.functions import expressions, scale
from orespark.operators import blockmodel
from orespark.plans import payload

TEXTS = ["1 < grade < 3", "(grade > 1) & (grade < 3)", "grade > 1 & grade < 3", "grade >= 2 and rock == 'A'", "not (grade > 2)", "~(grade > 2) | rock == 'B'",
    "rock in ['A', 'C']", "rock not in ['A', 'C']", "rock == ['A', 'C']", "rock != 'A'", "grade != 2", "`block size` * 2 + 1 >= @least", "grade ** 2 - n / 4 > -1",
    "n % 3 == 1", "-n // 4 < -2", "rock in @wanted", "flag", "flag and grade > 1", "grade == grade", "grade > n"]


def test_texts_equal_the_library(spark):
    random.seed(3)
    rows = [(i, random.choice([None, 0.5, 1.0, 2.0, 2.5, 3.0, 4.0]), random.choice("ABCD"), float(random.randrange(9)), random.randrange(12), random.random() < 0.5) for i in range(200)]
    names = ["i", "grade", "rock", "block size", "n", "flag"]
    df = spark.createDataFrame(rows, "i int, grade double, rock string, `block size` double, n long, flag boolean")
    frame = pd.DataFrame(rows, columns=names)
    least, wanted = 7, ["B", "D"]
    for text in TEXTS:
        want = sorted(frame.query(text, engine="python")["i"])
        got = sorted(r["i"] for r in df.filter(expressions.predicate(df, text, {"least": least, "wanted": wanted})).collect())
        assert got == want, (text, len(got), len(want))
    assert blockmodel.filter_blocks(df, "1 < grade < 3").count() == len(frame.query("1 < grade < 3"))


@pytest.mark.parametrize("text", ["__import__('os')", "grade", "grade.abs() > 1", "nothing > 1", "grade > ", "[x for x in rock]", "rock == @absent", "`grade > 1",
    "grade > 1; n > 2", "lambda: 1", "rock in 'A'", "rock[0] == 'A'", "1"])
def test_anything_else_is_refused(spark, text):
    df = spark.createDataFrame([(1.0, "A", 1)], "grade double, rock string, n long")
    if text in ("grade", "1"):
        expressions.predicate(df, text)  # a column or a constant is its own truth
        return
    with pytest.raises(expressions.Refused):
        expressions.predicate(df, text)


def test_ranks_of_texts_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(scale, "PER_RANGE", 50)
    random.seed(4)
    words = [None, *("".join(random.choices("abAB é", k=random.randint(0, 6))) for _ in range(700))]
    df = spark.createDataFrame([(w, i % 5) for i, w in enumerate(words)], "w string, weight int").repartition(7)
    assert len(scale.cut_points(df, "w")) > 5
    rows = scale.ranked(df, "w", F.col("weight")).collect()
    total = sum(i % 5 for i in range(len(words)))
    assert {r["_total"] for r in rows} == {total}
    stops = sorted((("" if r["w"] is None else "x" + r["w"]).encode(), r["_stop"]) for r in rows)
    assert [s for _, s in stops] == sorted(s for _, s in stops) and stops[-1][1] == total
    plan = scale.ranked(df, "w")._jdf.queryExecution().optimizedPlan().toString()
    assert "[_range#" in plan
    assert scale.ranked(df.limit(0), "w").count() == 0


def test_chunks_join_to_the_whole(spark, monkeypatch):
    monkeypatch.setattr(scale, "PER_RANGE", 100)
    rows = [("hot" if i % 3 else f"s{i % 7}" if i % 5 else None, float(i * 7919 % 1000), i) for i in range(1200)]
    photos = spark.createDataFrame([(*r, f"u{r[2]}") for r in rows], "photo_set string, from_depth double, _row_id long, url string").repartition(5)
    chunks = payload.photo_chunks(photos, 64).collect()
    assert max(r["n"] for r in chunks) == 64 and all(len(r["rows"]) == r["n"] for r in chunks)
    whole = {r["photo_set"]: [p["url"] for p in r["photos"]] for r in payload.photos_by_set(photos).collect()}
    parts = {}
    for r in sorted(chunks, key=lambda r: (r["photo_set"], r["chunk"])):
        parts.setdefault(r["photo_set"], []).extend(p["url"] for p in r["rows"])
    assert parts == whole
    assert payload.row_chunks(photos.limit(0), ["url"], ["from_depth"], "photo_set").count() == 0
