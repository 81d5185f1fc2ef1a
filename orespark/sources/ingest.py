"""Reading of tables, name normalisation and numeric coercion. All lazy: one projection each."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BLOCK_SOURCE_NAMES, DESCRIPTIONS, MISSING, ROW, SOURCE_NAMES, STRIKES


def ref(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column) -> Column:
    """c as a double; what isn't a finite number is null (NaN and infinity too, so that there is one kind of missing value)."""
    value = c.try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def with_row_id(df: DataFrame, kind: str | None = None) -> DataFrame:
    """df with its rows' place in the source, unless it has one: something to order by, not a number to count with.

    Rows of files (of a kind that scan() reads): struct<file, block, at>, ordered by path, then by place in the file, however Spark
    packs files into tasks. Parquet knows each row's number, so the id is deterministic and filters above it reach the scan; other
    files know where a task's block of the file begins, and rows count upwards inside it: filter these before the id is
    added. Other frames (no kind): their own order at the time.
    """
    if ROW in df.columns:
        return df
    if kind not in ("csv", "json", "orc", "parquet"):
        return df.withColumn(ROW, F.monotonically_increasing_id())
    block, at = (F.lit(0).cast("long"), F.col("_metadata.row_index")) if kind == "parquet" else (F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id())
    return df.withColumn(ROW, F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), at.alias("at")))


#: Tasks that read a table over JDBC.
JDBC_PARTITIONS = 16


def _jdbc(spark: SparkSession, query: str | None, table: str | None, connection: Mapping[str, str], partition_column: str | None,
    hash_column: str | None, partitions: int) -> DataFrame:
    """Over JDBC, in many connections if there is a column to cut by: a numeric one between its smallest and largest value (one query
    finds them), or the remainders of any integer expression of the database, by predicates."""
    reader = lambda: spark.read.format("jdbc").options(**connection)
    source = f"({query}) orespark_q" if query else table
    if hash_column:
        rest = [f"MOD({hash_column}, {partitions}) = {i}" + (f" OR MOD({hash_column}, {partitions}) = {-i}" if i else f" OR {hash_column} IS NULL") for i in range(partitions)]
        return spark.read.jdbc(connection["url"], source, predicates=rest, properties={k: v for k, v in connection.items() if k != "url"})
    if not partition_column:
        return reader().option("dbtable", source).load()
    found = reader().option("dbtable", f"(SELECT MIN({partition_column}) lo, MAX({partition_column}) hi FROM {source}) orespark_b"
        if table else f"(SELECT MIN({partition_column}) lo, MAX({partition_column}) hi FROM ({query}) orespark_i) orespark_b").load().head()
    if found[0] is None:
        return reader().option("dbtable", source).load()
    return reader().options(dbtable=source, partitionColumn=partition_column, numPartitions=partitions, lowerBound=str(found[0]),
        upperBound=str(found[1])).load()


def scan(spark: SparkSession, source: str | DataFrame, kind: str = "csv", query: str | None = None, table: str | None = None,
    connection: Mapping[str, str] | None = None, partition_column: str | None = None, hash_column: str | None = None,
    partitions: int = JDBC_PARTITIONS, js: bool = False, **options) -> DataFrame:
    """read_table() without the row id."""
    if isinstance(source, DataFrame):
        return source
    if js and kind not in ("csv", "json"):
        raise ValueError(f"a {kind} source isn't read in this dialect")
    if kind == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(options.pop("schema")) if "schema" in options else reader.option("inferSchema", True)
        return reader.options(**options).csv(source)
    if kind in ("parquet", "json", "orc"):
        return getattr(spark.read.options(**options), kind)(source) if "schema" not in options else getattr(
            spark.read.schema(options.pop("schema")).options(**options), kind)(source)
    if kind == "sql":
        if not (query or table):
            raise ValueError("a sql source needs a query or a table")
        if connection:
            return _jdbc(spark, query, table, connection, partition_column, hash_column, partitions)
        return spark.sql(query) if query else spark.table(table)
    raise ValueError(f"unknown kind of source: {kind}")


def read_table(spark: SparkSession, source: str | DataFrame, kind: str = "csv", where: Callable[[DataFrame], Column] | None = None,
    **how) -> DataFrame:
    """A source as a DataFrame with a row id. kind: csv, parquet, json, orc or sql.

    where: a predicate on the source's columns, below the row id, so that the scan gets it. sql reads a query or table over JDBC if
    `connection` gives the reader's options (url, driver, ...), else from the session's catalog; partition_column
    (numeric) or hash_column (an integer expression of the database) spread a JDBC read over `partitions` connections. A DataFrame passes
    through, whatever the kind. CSV columns are typed by inference unless a schema is given; header names that differ only by case
    stay apart. js: the other dialect, which reads csv and json only.
    """
    df = scan(spark, source, kind, **how)
    return with_row_id(df if where is None else df.filter(where(df)), None if isinstance(source, DataFrame) else kind)


def _targets(columns: list[str], names: Mapping[str, list[str]], own: Mapping[str, str] | None, js: bool) -> list[str]:
    known = {variant: target for target, variants in names.items() for variant in variants}
    own = {k.strip().lower(): v for k, v in (own or {}).items()}
    out = []
    for c in columns:
        key = "_".join(c.strip().lower().split()) if js else c.strip().lower()
        spaced = c.strip().lower()
        out.append(own.get(spaced) or known.get(key) or known.get(spaced) or key)
    return out


#: The other dialect's names: descriptions are a column of their own.
OTHER_NAMES = {k: [v for v in vs if v not in DESCRIPTIONS] for k, vs in SOURCE_NAMES.items()} | {"geology_description": DESCRIPTIONS,
    "strike": STRIKES}


def standardize(df: DataFrame, source_column_map: Mapping[str, str] | None = None, last_wins: bool = False) -> DataFrame:
    """Columns under their canonical names, unknown ones lower-cased and stripped. Where several sources have one
    target, the first non-null value counts; with last_wins (the other dialect) the last source column, under that
    dialect's names."""
    return _renamed(df, _targets(df.columns, OTHER_NAMES if last_wins else SOURCE_NAMES, source_column_map, last_wins), last_wins)


def lower_keys(df: DataFrame) -> DataFrame:
    """Columns under their lower-cased, stripped names; of several with one name the last."""
    return _renamed(df, [c.strip().lower() for c in df.columns], True)


def standardize_blocks(df: DataFrame, source_column_map: Mapping[str, str] | None = None) -> DataFrame:
    """The same for block models, whose unknown columns keep their names as they are."""
    known = {v for names in BLOCK_SOURCE_NAMES.values() for v in names} | {k.strip().lower() for k in source_column_map or {}}
    found = _targets(df.columns, BLOCK_SOURCE_NAMES, source_column_map, False)
    return _renamed(df, [t if c.strip().lower() in known else c for c, t in zip(df.columns, found, strict=True)], False)


def _renamed(df: DataFrame, targets: list[str], last_wins: bool) -> DataFrame:
    places = [f"c{i}" for i in range(len(targets))]  # source names may clash but for case
    df = df.toDF(*places)
    columns = []
    for target in dict.fromkeys(targets):
        mine = [F.col(p) for p, t in zip(places, targets, strict=True) if t == target]
        kinds = {df.schema[places[i]].dataType.simpleString() for i, t in enumerate(targets) if t == target}
        if len(mine) > 1 and not last_wins and len(kinds) > 1:
            mine = [c.cast("string") for c in mine]
        columns.append((mine[-1] if last_wins or len(mine) == 1 else F.coalesce(*mine)).alias(target))
    return df.select(*columns)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that exist as doubles, bad values null."""
    return df.withColumns({c: number(ref(c)) for c in columns if c in df.columns})


def plain_text(c: Column) -> Column:
    """A double as a text: the digits of a cast, but without an exponent from 0.0001 up to 1e16."""
    size, digits = F.abs(c), F.regexp_replace(c.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), digits).otherwise(c.cast("string"))


def rounded(c: Column) -> Column:
    """To 3 decimals, half to even on the scaled value."""
    return F.rint(c * 1000) / 1000


def interval_bounds(df: DataFrame, from_col: str = "from", to_col: str = "to") -> DataFrame:
    """Bounds as numbers to 3 decimals; equal ones become 1 mm long."""
    df = df.withColumns({c: rounded(number(ref(c))) for c in (from_col, to_col)})
    return df.withColumn(to_col, F.when(ref(to_col) == ref(from_col), rounded(ref(from_col) + 0.001)).otherwise(ref(to_col)))


def with_mid(df: DataFrame, from_col: str = "from", to_col: str = "to") -> DataFrame:
    return df.withColumn("mid", (ref(from_col) + ref(to_col)) * 0.5)


def is_missing(c: Column) -> Column:
    """Null, blank or one of the texts that stand for a missing value."""
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING)


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def first_value(candidates: list[Column]) -> Column:
    """The first value that is neither null nor an empty text."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in candidates])
