"""Validators: tables of issues, empty where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW
from ..sources.ingest import number, ref

TOLERANCE = 1e-6


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def column_presence(df: DataFrame, wanted: list[str]) -> DataFrame:
    """column, present, n_rows, n_values of the wanted columns: whether df has them and how many rows have a value, in one aggregate."""
    absent = set(missing_columns(df, wanted))
    marks = [F.struct(F.lit(c).alias("column"), F.lit(c not in absent).alias("present"), F.count("*").alias("n_rows"),
        (F.lit(0).cast("long") if c in absent else F.count(ref(c))).alias("n_values")) for c in wanted]
    return df.agg(F.array(*marks).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def _chain(df: DataFrame, hole_col: str, order: list[str]) -> Window:
    return Window.partitionBy(ref(hole_col)).orderBy(*[ref(c) for c in order if c in df.columns])


def overlapping_intervals(df: DataFrame, from_col: str = "from", to_col: str = "to", hole_col: str = "hole_id") -> DataFrame:
    """Intervals that start before the previous one of their hole ends (at 3 decimals)."""
    w = _chain(df, hole_col, [from_col, to_col, ROW])
    before = F.lag(F.rint(ref(to_col) * 1000)).over(w)
    return df.withColumn("_before", before).filter(F.rint(ref(from_col) * 1000) < F.col("_before")).drop("_before")


def _issues(df: DataFrame, found: list[tuple[Column, str]], keep: list[str]) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in found]))
    return df.select(*map(ref, keep), F.explode(names).alias("issue"))


def validate_intervals(df: DataFrame, from_col: str = "from", to_col: str = "to", hole_col: str = "hole_id") -> DataFrame:
    """hole, from, to, issue: missing_depth (such a row takes no part in the overlap test), non_positive_length, overlap."""
    keep = [hole_col, from_col, to_col]
    df = df.withColumns({c: number(ref(c)) for c in (from_col, to_col)})
    missing = ref(from_col).isNull() | ref(to_col).isNull()
    whole = df.filter(~missing)
    whole = whole.withColumn("_before", F.lag(ref(to_col)).over(_chain(df, hole_col, [from_col, to_col, ROW])))
    found = _issues(whole, [(ref(to_col) <= ref(from_col), "non_positive_length"), (ref(from_col) < F.col("_before"), "overlap")], keep)
    return found.unionByName(df.filter(missing).select(*map(ref, keep), F.lit("missing_depth").alias("issue")))


def validate_surveys(df: DataFrame, hole_col: str = "hole_id", depth_col: str = "from", order_col: str = ROW) -> DataFrame:
    """Holes whose depths decrease somewhere in the order of the source (order_col)."""
    w = Window.partitionBy(ref(hole_col)).orderBy(ref(order_col))
    falls = df.withColumn("_falls", number(ref(depth_col)) < F.lag(number(ref(depth_col))).over(w))
    return falls.groupBy(ref(hole_col)).agg(F.bool_or("_falls").alias("_falls")).filter("_falls").select(ref(hole_col),
        F.lit("non_monotonic_depth").alias("issue"))


def _angles() -> list[tuple[Column, str]]:
    dip, azimuth = number(F.col("dip")), number(F.col("azimuth"))
    return [(~dip.between(0, 90), "dip_out_of_range"), ((azimuth < 0) | (azimuth >= 360), "azimuth_out_of_range")]


def validate_structural_points(df: DataFrame, hole_col: str = "hole_id") -> DataFrame:
    """hole, depth, issue: missing_depth (then nothing else), dip outside [0, 90], azimuth outside [0, 360)."""
    missing = number(F.col("depth")).isNull()
    rest = [(~missing & c, name) for c, name in _angles()]
    return _issues(df, [(missing, "missing_depth"), *rest], [hole_col, "depth"])


def split_structural_points(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points whose angles are in range, and the others."""
    wrong = F.lit(False)
    for c, _ in _angles():
        wrong = wrong | F.coalesce(c, F.lit(False))
    return df.filter(~wrong), df.filter(wrong)


def validate_structural_intervals(df: DataFrame, from_col: str = "from", to_col: str = "to", hole_col: str = "hole_id") -> DataFrame:
    return validate_intervals(df, from_col, to_col, hole_col).unionByName(_issues(df, _angles(), [hole_col, from_col, to_col]))


def validate_block_sizes(blocks: DataFrame, max_block_size: dict[str, float], id_col: str = ROW) -> DataFrame:
    """id, axis, issue, block_size, max_size: sizes that aren't positive, or don't divide the largest size evenly."""
    axes = [F.struct(F.lit(a).alias("axis"), number(F.col(a)).alias("block_size"), F.lit(float(m)).alias("max_size")) for a,
        m in max_block_size.items() if m is not None and m > 0]
    if not axes:
        return blocks.select(ref(id_col), F.lit("").alias("axis"), F.lit("").alias("issue"), F.lit(0.0).alias("block_size"),
            F.lit(0.0).alias("max_size")).limit(0)
    rows = blocks.select(ref(id_col), F.explode(F.array(*axes)).alias("a")).select(ref(id_col), "a.*")
    ratio = F.col("max_size") / F.col("block_size")
    issue = F.when(F.col("block_size").isNull() | (F.col("block_size") <= 0),
        "non_positive_block_size").when(F.abs(ratio - F.rint(ratio)) > TOLERANCE, "invalid_block_size_divisor")
    return rows.withColumn("issue", issue).filter(F.col("issue").isNotNull()).select(ref(id_col), "axis", "issue", "block_size", "max_size")


def validate_blocks_in_bbox(blocks: DataFrame, bbox: dict[str, float], id_col: str = ROW) -> DataFrame:
    """id, axis, block_centre, block_dim of every axis on which a block leaves the box."""
    axes = [a for a in "xyz" if bbox.get(f"min_{a}") is not None and bbox.get(f"max_{a}") is not None]
    out = F.array_compact(F.array(*[
        F.when((F.col(a) - F.col(f"d{a}") / 2 < bbox[f"min_{a}"] - TOLERANCE) | (F.col(a) + F.col(f"d{a}") / 2 > bbox[f"max_{a}"] + TOLERANCE), F.struct(F.lit(a).alias("axis"), F.col(a).alias("block_centre"), F.col(f"d{a}").alias("block_dim")))
        for a in axes
    ]))
    return blocks.select(ref(id_col), F.explode(out).alias("o")).select(ref(id_col), "o.*")
