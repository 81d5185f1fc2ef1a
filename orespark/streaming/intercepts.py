"""Significant intercepts of a stream, hole by hole, as intervals arrive in any order within a delay.

Each hole has two states: the qualifying intervals that are newer than the watermark, and the open run. When the watermark passes intervals
they are final: nothing older can come any more. Final intervals, by depth, extend the open run or close it; a closed run that is long
enough is emitted once. An event-time timer wakes holes whose intervals became final, and closes the open run of a hole that has been silent
for `idle`.

Holes are kept in groups by hash: calls to the state store cost a round trip each, so a group's states are a few packed batches of rows
instead of rows of many keys, and its holes advance together. Rows that arrive are appended to them unread; a timer reads the group.

A hole's event times must follow its depths (core is logged down the hole), but for disorder within the delay. Rows that are later than
the watermark are dropped, as in every windowed aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from ..operators.intervals import GAP
from ..sources.ingest import number, ref

OUT = "hole_id string, `from` double, `to` double, length double, avg_grade double, n_samples long"
#: The state store that keeps lists and timers; a session that runs these queries must name it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Groups of holes that share a state.
GROUPS = 1024
#: Rows of the states: intervals are runs of one.
RUN = pa.schema([("hole", pa.string()), ("a", pa.float64()), ("b", pa.float64()), ("metal", pa.float64()), ("length", pa.float64()), ("n", pa.int64()), ("t", pa.int64())])


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    return (pa.RecordBatch.from_pandas(rows[RUN.names], RUN, preserve_index=False).serialize().to_pybytes(),)


def _unpacked(state: ListState) -> list[pd.DataFrame]:
    return [pa.ipc.read_record_batch(pa.py_buffer(bytes(x)), RUN).to_pandas() for (x,) in state.get()] if state.exists() else []


class Runs(StatefulProcessor):
    """Runs of contiguous intervals with at least min_grade, of all holes of a group."""

    def __init__(self, min_grade: float, min_length: float, idle_ms: int):
        self.min_grade, self.min_length, self.idle_ms = min_grade, min_length, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getListState("open", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            good = frame[frame["g"] >= self.min_grade]  # the gap that another row leaves closes a run
            if len(good):
                length = good["b"] - good["a"]
                good = good.rename(columns={"hole_id": "hole"}).assign(length=length, metal=good["g"] * length, n=1)
                self.waiting.appendValue(_packed(good))
                first = int(good["t"].min()) if first is None else min(first, int(good["t"].min()))
        if first is not None and first <= watermark:
            yield from self._advance(watermark)
        elif first is not None:
            self._wake(first + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def _wake(self, at: int, anew: bool = False) -> None:
        """One timer a group: at a time, or earlier if it was set so (unless anew)."""
        set_to = list(self.handle.listTimers())
        if not anew and set_to and min(set_to) <= at:
            return
        for timer in set_to:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _advance(self, watermark: int) -> Iterator[pd.DataFrame]:
        held, runs = _unpacked(self.waiting), _unpacked(self.open)
        waiting = pd.concat(held, ignore_index=True) if held else RUN.empty_table().to_pandas()
        later = waiting[waiting["t"] > watermark]
        rows = pd.concat([*[x.assign(fresh=0) for x in runs], waiting[waiting["t"] <= watermark].assign(fresh=1)], ignore_index=True)
        rows = rows.sort_values(["hole", "fresh", "a", "b"], kind="stable", ignore_index=True)  # a hole's open run, then its rows by depth
        hole = rows["hole"].to_numpy(object)
        other = np.ones(len(rows), bool)  # than the hole above
        other[1:] = hole[1:] != hole[:-1]
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        starts = other.copy()
        starts[1:] |= ~(np.abs(a[1:] - b[:-1]) <= GAP)
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(rows)) - 1 if len(at) else at
        sums = {c: np.add.reduceat(rows[c].to_numpy(), at) if len(at) else rows[c].to_numpy() for c in ("metal", "length", "n")}
        latest = np.maximum.reduceat(rows["t"].to_numpy(), at) if len(at) else rows["t"].to_numpy()
        found = pd.DataFrame({"hole": hole[at], "a": a[at], "b": b[ends], **sums, "t": latest})
        last = np.append(other[at][1:], True) if len(at) else np.zeros(0, bool)  # run of its hole
        live = last & (found["t"].to_numpy() + self.idle_ms > watermark)
        still, closed = found[live], found[~live]
        for state, before, now in ((self.waiting, held, later), (self.open, runs, still)):
            if len(now):
                state.put([_packed(now)])
            elif before:
                state.clear()
        wake = min([*([int(later["t"].min())] if len(later) else []), *([int(still["t"].min()) + self.idle_ms] if len(still) else [])], default=None)
        if wake is not None:
            self._wake(max(wake, watermark) + 1, anew=True)
        closed = closed[closed["b"] - closed["a"] >= self.min_length]
        if len(closed):
            grade = (closed["metal"] / closed["length"]).where(closed["length"] != 0)
            yield pd.DataFrame({"hole_id": closed["hole"], "from": closed["a"], "to": closed["b"], "length": closed["b"] - closed["a"], "avg_grade": grade,
                "n_samples": closed["n"]})

    def close(self) -> None:
        pass


def stream_intercepts(stream: DataFrame, value_col: str, min_grade: float, min_length: float, time_col: str, delay: str = "1 hour",
    idle: str = "1 day", groups: int | None = GROUPS) -> DataFrame:
    """hole_id, from, to, length, avg_grade, n_samples of every run when it closes (append mode): what significant_intercepts gives
    for the whole table. The session must name the state store (STORE).

    groups: how many groups holes are dealt to. One group's rows above the watermark and open runs are in a task's memory at a time, and are
    read and written together, so a stream of very many holes with open runs needs more; None: a group for each hash of a hole.
    """
    rows = stream.withWatermark(time_col, delay)
    rows = rows.select(ref("hole_id").cast("string").alias("hole_id"), F.unix_millis(ref(time_col)).alias("t"), number(ref("from")).alias("a"),
        number(ref("to")).alias("b"), number(ref(value_col)).alias("g"), ref(time_col)).filter("hole_id is not null and a is not null and b is not null")
    key = F.xxhash64("hole_id") if groups is None else F.pmod(F.xxhash64("hole_id"), F.lit(groups))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withColumn("_group", key).groupBy("_group").transformWithStateInPandas(statefulProcessor=Runs(min_grade, min_length, idle_ms), outputStructType=OUT,
        outputMode="Append", timeMode="EventTime")
