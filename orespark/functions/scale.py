"""Colour scales: quantile bins and equal-width bins."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.ingest import number, ref


#: Rows of a range, and keys that are sampled for each.
PER_RANGE, SAMPLED = 500_000, 32


def _literal(value: object) -> Column:
    """A value as the driver got it, structs included, as a column."""
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(n) for n, v in value.asDict(recursive=False).items()])
    return F.lit(value)


def cut_points(df: DataFrame, order_col: str) -> list[Column]:
    """Bounds of about equal ranges of a column of any type that can be ordered, as few as its rows need: from the keys with the
    smallest hashes, a sample that depends on the keys alone."""
    total = df.count()
    n = min(1024, -(-total // PER_RANGE))
    if n <= 1:
        return []
    keys, most = df.select(ref(order_col).alias("k")).dropna(), n * SAMPLED
    smallest = lambda rows: rows.distinct().orderBy(F.xxhash64("k"), "k").limit(most).orderBy("k").collect()
    # below this hash there are about four times as many, unless keys repeat: then all are looked through
    sample = smallest(keys.filter(F.xxhash64("k") < int(-2**63 + 2**64 * 4 * most / total))) if 4 * most < total else []
    sample = sample if len(sample) == most else smallest(keys)
    kind = df.schema[order_col].dataType
    return [_literal(sample[i * len(sample) // n]["k"]).cast(kind) for i in range(1, n)] if sample else []


def _place(cuts: list[Column], value: Column) -> Column:
    """How many of the ascending cuts are at most a value: first among every so manieth, then among those up to the next one."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts) - 1) + 1
    blocks = [F.array(*cuts[i:i + wide]) for i in range(0, len(cuts), wide)]
    passed = F.size(F.filter(F.array(*cuts[::wide]), lambda c: c <= value))
    return F.coalesce(F.size(F.filter(F.get(F.array(*blocks), passed - 1), lambda c: c <= value)) + (passed - 1) * wide, F.lit(0))


def ranked(df: DataFrame, order_col: str, weight: Column | None = None) -> DataFrame:
    """df with _stop and _total: the running sum of weights (1 each by default) in the order of a column, and their sum.

    Rows are cut into ranges at sampled keys (see cut_points), dealt by range, and each range is summed by itself and
    shifted by the sums of those before it: a few numbers, known before the plan is made, so that neither the number of
    partitions nor a repeated task can change a rank. Null keys come first. A table that one range holds is ranked in one task.
    """
    weight = F.lit(1) if weight is None else weight
    cuts = cut_points(df, order_col)
    rows = df.withColumns({"_range": F.when(ref(order_col).isNull(), 0).otherwise(_place(cuts, ref(order_col))), "_weight": weight.cast("long")})
    whole = Window.partitionBy("_range")
    own = F.sum("_weight").over(whole.orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0))
    if not cuts:
        return rows.withColumns({"_stop": own, "_total": F.sum("_weight").over(whole)}).drop("_range", "_weight")
    sums = {r["_range"]: r["w"] for r in rows.groupBy("_range").agg(F.sum("_weight").alias("w")).collect()}
    before = dict(zip(sorted(sums), accumulate([0, *(sums[k] for k in sorted(sums))]), strict=False))
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range")) if before else F.lit(0)
    return rows.withColumns({"_stop": own + shift.cast("long"), "_total": F.lit(sum(sums.values()))}).drop("_range", "_weight")


def quantile_bins(df: DataFrame, value_col: str, n: int, group_cols: list[str] | None = None) -> DataFrame:
    """group, bin, lo, hi: values at the ranks floor(i / n * N) and min(N - 1, floor((i + 1) / n * N)) of the sorted values.

    Without groups, distinct values are ranked by ranges (see ranked), so no task sees all of many. With groups, ranks are per group.
    """
    values = df.select(*map(ref, group_cols or []), number(ref(value_col)).alias("v")).dropna(subset=["v"])
    counts = values.groupBy(*map(ref, group_cols or []), "v").agg(F.count("*").alias("k"))
    if group_cols:
        w = Window.partitionBy(*map(ref, group_cols))
        placed = counts.withColumns({"stop": F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)),
            "N": F.sum("k").over(w)})
    else:
        placed = ranked(counts, "v", F.col("k")).withColumnsRenamed({"_stop": "stop", "_total": "N"})
    at = lambda i: F.least(F.col("N") - 1, F.floor(F.lit(i / n) * F.col("N")))
    holds = lambda r: (r >= F.col("stop") - F.col("k")) & (r < F.col("stop"))
    edges = F.array_compact(F.array(*[F.when(holds(at(i)), F.lit(i)) for i in range(n + 1)]))
    found = placed.select(*map(ref, group_cols or []), "v",
        F.explode(edges).alias("i")).groupBy(*map(ref,
        group_cols or [])).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return found.select(*map(ref, group_cols or []), "m",
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")).select(*map(ref, group_cols or []), "bin",
        F.element_at("m", F.col("bin")).alias("lo"), F.element_at("m", F.col("bin") + 1).alias("hi"))


def systematic_sample(df: DataFrame, order_col: str, most: int = 3000) -> DataFrame:
    """Rows floor(i * N / most), i < most, in the order of a numeric column without ties (a row id); all where there are at
    most `most`: a scene's limit."""
    placed = ranked(df.filter(ref(order_col).isNotNull()), order_col)
    n, total = F.col("_stop") - 1, F.col("_total")
    i = F.ceil(n * most / total)
    return placed.filter((total <= most) | (F.floor(i * total / most) == n)).drop("_stop", "_total")


def bin_index(value: Column, edges: list[tuple[float, float]]) -> Column:
    """The first bin that holds the value: lo <= value <= hi (the last one has no upper end)."""
    if edges and edges[0] == edges[-1] and edges[0][0] == edges[0][1]:
        return F.when(value == edges[0][0], 0).otherwise(-1)
    out = F.lit(-1)
    for i in reversed(range(len(edges))):
        lo, hi = edges[i]
        out = F.when((value >= lo) & ((value <= hi) | F.lit(i == len(edges) - 1)), i).otherwise(out)
    return out


def bin_label(lo: Column, hi: Column) -> Column:
    """"lo – hi", with fewer decimals for larger numbers."""

    def shown(v: Column) -> Column:
        size = F.abs(v)
        fixed = lambda k: F.format_string(f"%.{k}f", v)
        return F.when(v.isNull(), "n/a").when(size >= 1000, fixed(0)).when(size >= 10, fixed(1)).when(size >= 0.1,
            fixed(2)).otherwise(fixed(3))

    return F.concat(shown(lo), F.lit(" – "), shown(hi))


def bin_colour(value: Column, edges: list[tuple[float, float]], colours: list[str], fallback: str) -> Column:
    """Colour of the value's bin, the fallback outside all of them or without a value."""
    return F.coalesce(F.get(F.array(*map(F.lit, colours)), F.nullif(bin_index(value, edges), F.lit(-1))), F.lit(fallback))


def equal_width_index(value: Column, low: float, high: float, n: int) -> Column:
    """Bin of n equal ones over [low, high], values outside in the end bins."""
    if high <= low:
        return F.lit(0)
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((value - low) / ((high - low) / n)).cast("int")))
