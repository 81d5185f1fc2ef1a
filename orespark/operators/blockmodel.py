"""Block models: criteria, volumes, statistics, overlaps, exterior faces."""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import predicate
from ..functions.scale import ranked
from ..model import GEOMETRY, ROW
from ..sources.ingest import coerce_numeric, number, read_table, ref, standardize_blocks

Criteria = str | Mapping[str, object] | Callable[[DataFrame], Column] | None
COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "eq": operator.eq,
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "in": lambda c, v: c.isin(list(v)),
}
TOLERANCE = 1e-6


def criteria_column(df: DataFrame, criteria: Criteria, unknown_excludes: bool = False, given: Mapping[str, object] | None = None) -> Column:
    """One predicate; plain comparisons reach the scan. Unknown columns of a mapping are ignored (or exclude every row). A text is a
    data-frame query (functions.expressions), given the values of its @names."""
    if criteria is None:
        return F.lit(True)
    if callable(criteria):
        return criteria(df)
    if isinstance(criteria, str):
        return predicate(df, criteria, given)
    if not isinstance(criteria, Mapping):
        raise TypeError(f"criteria are a mapping, a query string or a function, not {type(criteria).__name__}")
    parts = [F.lit(True)]
    for name, wanted in criteria.items():
        if wanted is None:
            continue
        if name not in df.columns:
            parts += [F.lit(False)] * unknown_excludes
        elif isinstance(wanted, Mapping):
            parts += [COMPARE[op](ref(name), v) for op, v in wanted.items()]
        else:
            parts.append(ref(name) == F.lit(wanted))
    return reduce(operator.and_, parts)


def filter_blocks(df: DataFrame, criteria: Criteria, unknown_excludes: bool = False) -> DataFrame:
    return df.filter(criteria_column(df, criteria, unknown_excludes))


def load_blocks(spark: SparkSession, source, kind: str = "csv", source_column_map=None, drop_unplaced: bool = False, **read) -> DataFrame:
    """Blocks with the six geometry columns as numbers; rows without a centre stay unless drop_unplaced."""
    df = standardize_blocks(read_table(spark, source, kind, **read), source_column_map)
    missing = [c for c in GEOMETRY if c not in df.columns]
    if missing:
        raise KeyError(f"blocks: missing columns {missing}")
    df = coerce_numeric(df, GEOMETRY)
    return df.dropna(subset=["x", "y", "z"]) if drop_unplaced else df


def volume(df: DataFrame, criteria: Criteria = None) -> DataFrame:
    """One row: volume of the blocks that fit."""
    size = reduce(operator.mul, [F.coalesce(number(F.col(c)), F.lit(0.0)) for c in ("dx", "dy", "dz")])
    return filter_blocks(df, criteria).agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("volume"))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType | T.BooleanType)


def numeric_stats(df: DataFrame, name: str, criteria: Criteria = None) -> DataFrame:
    """count, min, max, mean, std (sample), sum of a numeric attribute."""
    if name not in df.columns:
        raise KeyError(name)
    v = number(ref(name))
    return filter_blocks(df, criteria).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"))


def category_counts(df: DataFrame, name: str, criteria: Criteria = None) -> DataFrame:
    """value, count of an attribute's non-null values."""
    return filter_blocks(df, criteria).dropna(subset=[name]).groupBy(ref(name).alias("value")).agg(F.count("*").alias("count"))


def bounding_box(df: DataFrame) -> DataFrame:
    """One row: min and max of each axis over centre -/+ half a size."""
    return df.agg(*[f(F.col(a) + sign * F.col(f"d{a}") / 2).alias(f"{n}_{a}") for a in "xyz" for n, f,
        sign in (("min", F.min, -1), ("max", F.max, 1))])


def size_stats(df: DataFrame) -> DataFrame:
    """One row: smallest and largest size on each axis."""
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in ("dx", "dy", "dz") for n, f in (("min", F.min), ("max", F.max))])


def property_stats(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """property_table() and property_categories() as a dictionary, for small domains: categories come to the driver."""
    marks = [f(ref(c)).alias(f"{i}{k}") for i, c in enumerate(names) for k,
        f in (("n", F.count), ("v", lambda x: F.count(number(x))), ("lo", lambda x: F.min(number(x))), ("hi", lambda x: F.max(number(x))))]
    row, out = df.agg(*marks).head(), {}
    for i, c in enumerate(names):
        if row[f"{i}n"] and row[f"{i}n"] == row[f"{i}v"]:
            out[c] = {"type": "numeric", "min": row[f"{i}lo"], "max": row[f"{i}hi"]}
        else:
            seen = df.dropna(subset=[c]).groupBy(ref(c).alias("v")).agg((F.min(ROW) if ROW in df.columns else F.min(ref(c))).alias("o")).orderBy("o")
            out[c] = {"type": "categorical", "categories": [r["v"] for r in seen.collect()]}
    return out


class BlockModel:
    """Blocks and their metadata; what the metadata doesn't give is computed on first use, in one aggregate."""

    def __init__(self, blocks: DataFrame, metadata: Mapping | None = None):
        self.blocks, self.given, self._box = blocks, dict(metadata or {}), None

    def _derived(self) -> dict[str, float]:
        if self._box is None:
            self._box = bounding_box(self.blocks).head().asDict() | size_stats(self.blocks).head().asDict()
        return self._box

    @property
    def bbox_3d(self) -> dict[str, float]:
        return self.given.get("bbox_3d") or {f"{m}_{a}": self._derived()[f"{m}_{a}"] for a in "xyz" for m in ("min", "max")}

    @property
    def outline_2d(self) -> dict:
        """GeoJSON ring of the box's plan."""
        if self.given.get("outline_2d"):
            return self.given["outline_2d"]
        b = self.bbox_3d
        ring = [[b[f"{i}_x"], b[f"{j}_y"]] for i, j in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"), ("min", "min"))]
        return {"type": "Polygon", "coordinates": [ring]}

    @property
    def max_block_size(self) -> dict[str, float]:
        return self.given.get("max_block_size") or {c: self._derived()[f"max_{c}"] for c in ("dx", "dy", "dz")}

    @property
    def min_block_size(self) -> dict[str, float]:
        return self.given.get("min_block_size") or {c: self._derived()[f"min_{c}"] for c in ("dx", "dy", "dz")}

    def metadata(self) -> dict:
        return self.given | {k: getattr(self, k) for k in ("bbox_3d", "outline_2d", "max_block_size", "min_block_size")}

    def volume(self, criteria: Criteria = None) -> float:
        return volume(self.blocks, criteria).head()[0]

    def attribute_stats(self, name: str, criteria: Criteria = None) -> dict:
        if name not in self.blocks.columns:
            raise KeyError(name)
        if is_numeric(self.blocks, name):
            return numeric_stats(self.blocks, name, criteria).head().asDict()
        counts = {r["value"]: r["count"] for r in category_counts(self.blocks, name, criteria).collect()}
        return {"count": sum(counts.values()), "value_counts": counts}


def load_metadata(source: str | Mapping) -> dict:
    """A mapping as it is, a JSON text, or the path of a JSON file (read by Spark, so any store will do)."""
    if isinstance(source, Mapping):
        return dict(source)
    if source.lstrip().startswith("{"):
        return json.loads(source)
    return json.loads(SparkSession.active().read.text(source, wholetext=True).head()[0])


def property_table(df: DataFrame, names: list[str]) -> DataFrame:
    """property, numeric, min, max, n_categories: numeric if all its non-null values are numbers, else its distinct values are
    counted. One aggregate over the blocks."""
    marks = [F.struct(F.lit(c).alias("property"), (F.count(ref(c)) > 0).alias("some"),
        (F.count(ref(c)) == F.count(number(ref(c)))).alias("all"), F.min(number(ref(c))).alias("min"), F.max(number(ref(c))).alias("max"),
        F.count_distinct(ref(c)).alias("n")) for c in names]
    rows = df.agg(F.array(*marks).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    numeric = F.col("some") & F.col("all")
    return rows.select("property", numeric.alias("numeric"), F.when(numeric, F.col("min")).alias("min"),
        F.when(numeric, F.col("max")).alias("max"), F.when(~numeric, F.col("n")).alias("n_categories"))


def property_categories(df: DataFrame, name: str) -> DataFrame:
    """value, place: distinct values of a column and their place in order of appearance (by row id, else by value)."""
    seen = df.dropna(subset=[name]).groupBy(ref(name).alias("value")).agg((F.min(ROW) if ROW in df.columns else F.min(ref(name))).alias("_o"))
    placed = ranked(seen.select("value", F.struct("_o", "value").alias("_key")), "_key")
    return placed.select("value", (F.col("_stop") - 1).cast("int").alias("place"))


def _in_cells(rows: DataFrame) -> DataFrame:
    """rows once for each cell that a block covers in the grid of its level."""
    size = F.pow(F.lit(2.0), "level")
    along = {a: F.sequence(F.floor(F.col(f"lo{a}") / size), F.floor(F.col(f"hi{a}") / size)) for a in "xyz"}
    cells = F.transform(along["x"], lambda x: F.flatten(F.transform(along["y"],
        lambda y: F.transform(along["z"], lambda z: F.struct(x.alias("cx"), y.alias("cy"), z.alias("cz"))))))
    return rows.select("*", size.alias("cell"), F.explode(F.flatten(cells)).alias("c")).select("*", "c.*").drop("c")


def overlaps(df: DataFrame, id_col: str = ROW) -> DataFrame:
    """Pairs (block_a < block_b) of blocks that overlap on all axes.

    Blocks are classed by the power of two that holds their largest size. A pair meets in the grid of its larger class, where
    each of the two covers at most 8 cells: an equi-join of the blocks of a class with those of it and of smaller classes, so
    one huge block meets the small ones inside it but doesn't bring these together. A pair counts in the cell of its common
    corner only, so no distinct step follows.
    """
    size = F.greatest("dx", "dy", "dz")
    rows = df.select(ref(id_col).alias("id"), F.ceil(F.log2(F.when(size > 0, size))).cast("int").alias("class"),
        *[(F.col(a) + s * F.col(f"d{a}") / 2).alias(f"{n}{a}") for a in "xyz" for n, s in (("lo", -1), ("hi", 1))]).dropna()
    levels = rows.agg(F.collect_set("class").alias("levels"))  # one row: a few powers of two
    larger = F.explode(F.filter("levels", lambda k: k >= F.col("class")))
    a = _in_cells(rows.withColumn("level", F.col("class"))).alias("a")
    b = _in_cells(rows.join(F.broadcast(levels)).select("*", larger.alias("level")).drop("levels")).alias("b")
    cell = reduce(operator.and_, [F.col(f"a.{x}") == F.col(f"b.{x}") for x in ("level", "cx", "cy", "cz")])
    meet = reduce(operator.and_,
        [(F.col(f"a.lo{x}") < F.col(f"b.hi{x}") - TOLERANCE) & (F.col(f"b.lo{x}") < F.col(f"a.hi{x}") - TOLERANCE) for x in "xyz"])
    corner = reduce(operator.and_, [F.floor(F.greatest(f"a.lo{x}", f"b.lo{x}") / F.col("a.cell")) == F.col(f"a.c{x}") for x in "xyz"])
    once = (F.col("b.class") < F.col("a.class")) & (F.col("a.id") != F.col("b.id")) | (F.col("a.id") < F.col("b.id"))
    return a.join(b, cell & once & meet & corner).select(F.least("a.id", "b.id").alias("block_a"),
        F.greatest("a.id", "b.id").alias("block_b"))


def exterior_faces(df: DataFrame, id_col: str = ROW) -> DataFrame:
    """id, axis, side of the faces without a block centre on their other side (at one size away, to whole units)."""
    whole = lambda c: F.floor(c + 0.5)
    faces = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"),
        *[whole(F.col(x) + (s * F.col(f"d{a}") if x == a else F.lit(0.0))).alias(f"k{x}") for x in "xyz"]) for a in "xyz" for s in (-1, 1)])
    rows = df.select(ref(id_col), F.explode(faces).alias("f")).select(ref(id_col), "f.*")
    centres = df.select(*[whole(F.col(x)).alias(f"k{x}") for x in "xyz"])
    return rows.join(centres, ["kx", "ky", "kz"], "left_anti").select(ref(id_col), "axis", "side")
