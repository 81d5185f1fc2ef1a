"""Holes that share a state give what each hole gives by itself, in few calls to the state store."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orespark.operators import intervals
from orespark.streaming.intercepts import STORE, Runs, stream_intercepts


class State(list):
    """A list state in memory; counts calls."""

    calls = 0

    def count(self):
        State.calls += 1

    def exists(self):
        self.count()
        return bool(len(self))

    def get(self):
        self.count()
        return iter(list(self))

    def put(self, rows):
        self.count()
        self[:] = rows

    def appendValue(self, row):
        self.count()
        self.append(row)

    def clear(self):
        self.count()
        self[:] = []


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return State()

    def listTimers(self):
        State.calls += 1
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        State.calls += 1
        self.timers.discard(at)

    def registerTimer(self, at):
        State.calls += 1
        self.timers.add(at)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def advanced(runs, handle, frames, watermark):
    """What a batch gives: its rows, then the timers that are due."""
    out = list(runs.handleInputRows((0,), iter(frames), Times(watermark))) if frames else []
    for at in [t for t in handle.timers if t <= watermark]:
        handle.timers.discard(at)
        out += list(runs.handleExpiredTimer((0,), Times(watermark), None))
    return [tuple(r) for frame in out for r in frame.itertuples(index=False)]


def frame(rows):
    return pd.DataFrame(rows, columns=["hole_id", "t", "a", "b", "g"])


def test_many_holes_few_calls():
    runs, handle = Runs(3.0, 2.0, 86_400_000), Handle()
    runs.init(handle)
    State.calls = 0
    holes = [f"H{k}" for k in range(5000)]
    got = advanced(runs, handle, [frame([(h, 60_000 * i, 2.0 * i, 2.0 * i + 2, 4.0 if i != 3 else 1.0) for h in holes for i in range(3)])], 0)
    got += advanced(runs, handle, [frame([(h, 60_000 * i, 2.0 * i, 2.0 * i + 2, 5.0 if i != 3 else None) for h in holes for i in (4, 3)])], 120_000)
    assert got == []  # every run is open or waits
    got = advanced(runs, handle, [], 240_001)
    assert sorted(got) == sorted((h, 0.0, 6.0, 6.0, 4.0, 3) for h in holes)
    got = advanced(runs, handle, [], 240_000 + 86_400_001)  # silent for a day
    assert sorted(got) == sorted((h, 8.0, 10.0, 2.0, 5.0, 1) for h in holes)
    assert State.calls < 50 and not handle.timers


@pytest.mark.parametrize("seed", range(5))
def test_any_batches(seed):
    random.seed(seed)
    rows = [(f"H{h}", 60_000 * i, 2.0 * i, 2.0 * i + 2, random.choice([None, 1.0, 3.0, 4.0, 5.0])) for h in range(20) for i in range(40) if random.random() < 0.9]
    want = set()
    for h in range(20):
        run = None
        for _, _, a, b, g in [*(r for r in rows if r[0] == f"H{h}"), (None, 0, 1e9, 1e9, 3.0)]:
            if g is None or g < 3:
                continue
            if run and a == run[-1][1]:
                run.append((a, b, g))
                continue
            if run:
                want.add((f"H{h}", run[0][0], run[-1][1], run[-1][1] - run[0][0], round(sum(2 * x[2] for x in run) / (2 * len(run)), 9), len(run)))
            run = [(a, b, g)]
    random.shuffle(rows)
    rows.sort(key=lambda r: r[1] // 300_000)  # five minutes' rows come in any order
    runs, handle, got, watermark = Runs(3.0, 2.0, 86_400_000), Handle(), [], 0
    runs.init(handle)
    while rows:
        n = random.randint(1, 60)
        batch, rows = rows[:n], rows[n:]
        got += advanced(runs, handle, [frame(batch[:n // 2]), frame(batch[n // 2:])], watermark)
        watermark = max(watermark, max(r[1] for r in batch) - 400_000)
    got += advanced(runs, handle, [], watermark)
    got += advanced(runs, handle, [], 10**9)
    got = [(*r[:4], round(r[4], 9), r[5]) for r in got]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("groups", [1, None])
def test_groups_of_a_stream(spark, tmp_path, groups):
    rows = [(f"H{h}", 2.0 * i, 2.0 * i + 2, float((h * 7 + i * i) % 6), 60 * i) for h in range(15) for i in range(30)]
    df = spark.createDataFrame(rows, "hole_id string, `from` double, `to` double, au double, s long").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s")))
    shown = ("hole_id", "from", "to", "length", F.round("avg_grade", 9), "n_samples")
    want = {tuple(r) for r in intervals.significant_intercepts(df, "au", 3.0, 2.0, label=False).select(*shown).collect()}
    for k in range(3):
        df.filter(F.floor(F.col("s") / 600) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    df.limit(1).withColumns({"hole_id": F.lit("end"), "au": F.lit(0.0), "at": F.timestamp_seconds(F.lit(1_800_000_000))}).write.parquet(str(tmp_path / "in" / "3"))
    spark.conf.set(*next(iter(STORE.items())))
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream_intercepts(stream, "au", 3.0, 2.0, "at", delay="5 minutes", groups=groups).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)
    finally:
        spark.conf.unset(next(iter(STORE)))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*shown).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
