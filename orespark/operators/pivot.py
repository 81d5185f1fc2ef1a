"""Long (code, value) tables to wide ones."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW
from ..sources.ingest import ref


def long_to_wide(df: DataFrame, code_col: str, value_col: str, codes: list[str] | None = None, max_codes: int = 2000) -> DataFrame:
    """One column per code with the first non-null value in source order (without a row id, the smallest value); rows with a
    null in any other column go, and keys without any value. The row id of a key is that of its first row.

    codes: the columns to make; else the distinct codes are read first, in order of appearance: a list of analytes, checked to
    be at most max_codes (they become columns). One aggregate with map-side combine does the rest.
    """
    base = [c for c in df.columns if c not in (code_col, value_col, ROW)]
    order = F.col(ROW) if ROW in df.columns else ref(value_col)
    rows = df.dropna(subset=[*base, code_col, value_col])
    if codes is None:
        found = rows.groupBy(ref(code_col).cast("string").alias("code")).agg(F.min(order).alias("first"))
        codes = [r["code"] for r in found.orderBy("first", "code").limit(max_codes + 1).collect()]
        if len(codes) > max_codes:
            raise ValueError(f"more than {max_codes} codes in {code_col}")
    of = lambda c: F.when(ref(code_col).cast("string") == c, order)
    values = [F.min_by(ref(value_col), of(c)).alias(str(c).strip()) for c in codes]
    some = reduce(operator.or_, [ref(str(c).strip()).isNotNull() for c in codes], F.lit(False))
    return rows.groupBy(*map(ref, base)).agg(*([F.min(ROW).alias(ROW)] if ROW in df.columns else []), *values).filter(some)
