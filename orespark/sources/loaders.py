"""Loaders of drillhole tables.

Checks that must fail a whole table take one aggregate each (validate=False skips it). Tables come in the order of their
source; in_order() sorts them the way they are shown, once, at the end. js=True is the other dialect of the same loaders:
last of several source columns, strict bounds, no long tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ASSAY, COLLAR, GEOLOGY, GEOTECHNICAL, ROW, STRUCTURE, SURVEY
from ..operators.asof import nearest_on_pairs, nearest_vertex
from ..operators.desurvey import first_rows, station_pairs
from ..operators.enrich import hole_key
from ..operators.pivot import long_to_wide
from ..operators.validate import overlapping_intervals
from .ingest import coerce_numeric, first_column, interval_bounds, is_missing, number, read_table, ref, rounded, scan, standardize, with_mid, with_row_id

# Names of the code and value columns of long tables.
CODES = {
    "assays": (["assay_code", "assay_type", "analyte", "element", "code"], ["assay_value", "value", "result", "assay_result"]),
    "geology": (["geology_code", "lith_code", "code"], ["comments", "geology_value", "value", "description"]),
}


class MissingColumns(ValueError, KeyError):
    """A table lacks columns that its kind must have."""


def _require(df: DataFrame, columns: list[str], label: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{label}: missing columns {missing}")


def _projected(df: DataFrame, columns: list[str], keep_all: bool) -> DataFrame:
    return df if keep_all else df.select(*[ref(c) for c in columns if c in df.columns])


def _guard(df: DataFrame, tests: dict[str, Column], label: str, sample: list[str]) -> None:
    """Fail if any row fails a test: how many fail each, and up to five of them, in one aggregate."""
    bad = F.lit(False)
    for c in tests.values():
        bad = bad | F.coalesce(c, F.lit(True))
    place = F.col(ROW) if ROW in df.columns else F.lit(0)
    shown = F.when(bad, F.struct(place.alias("at"), *[ref(c).cast("string").alias(c) for c in sample]))
    counts = df.agg(F.count_if(bad).alias("total_invalid"), F.min(shown).alias("first"),
        *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in tests.items()]).head()
    if counts["total_invalid"]:
        rows = [r.asDict() for r in df.filter(bad).select(*map(ref, sample)).limit(5).collect()]
        raise ValueError(f"{label}: missing or invalid values, {({k: v for k, v in counts.asDict().items() if k != 'first'})}, for example {rows}")


def in_order(df: DataFrame, columns: list[str] | None = None, locale: bool = False) -> DataFrame:
    """Sorted by hole, then from and to (or depth), missing values last, then by source order; or by other columns.

    locale: texts in the order of Unicode's collation (case and accents count after letters), as readers expect lists of names;
    else by their bytes. Numbers sort as numbers, in a column of texts they are texts.
    """
    names = columns or ["hole_id", *(("from", "to") if "from" in df.columns else ("depth",))]
    return df.orderBy(*[F.asc_nulls_last(sort_key(df, c) if locale else ref(c)) for c in [*names, ROW] if c in df.columns])


def sort_key(df: DataFrame, name: str) -> Column:
    """A column to sort by in locale order."""
    return F.collate(ref(name), "UNICODE") if df.schema[name].dataType.typeName() == "string" else ref(name)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("hole_id", F.trim(F.col("hole_id").cast("string")))


def load_collars(spark: SparkSession, source, crs: str | None = None, source_column_map=None, keep_all: bool = True, js: bool = False,
    validate: bool = True, **read) -> DataFrame:
    """Collars with geometry struct<x, y> and geometry_crs: longitude/latitude (EPSG:4326 unless given), else easting/northing.

    All columns of the model are required but the coordinates of the kind that is absent; crs isn't where there are only
    degrees. js: an id and either pair of coordinates are enough, coordinates become numbers, and one bad row fails the table.
    """
    df = standardize(read_table(spark, source, **read), source_column_map, last_wins=js)
    _require(df, ["hole_id"], "collars")
    geographic, projected = ({"latitude", "longitude"} <= set(df.columns)), ({"easting", "northing"} <= set(df.columns))
    if js:
        df = coerce_numeric(_named(df), ["latitude", "longitude", "elevation", "easting", "northing"])
    if "datasource_hole_id" not in df.columns:
        df = df.withColumn("datasource_hole_id", F.col("hole_id"))
    x, y = ("longitude", "latitude") if geographic else ("easting", "northing")
    if js:
        _require(df, [x, y], "collars")
        if validate:
            _guard(df, {"missing_hole_id": F.col("hole_id") == "", "missing_coordinates": ref(x).isNull() | ref(y).isNull()}, "collars",
                ["hole_id", x, y])
        return df
    skipped = {"easting", "northing", "crs"} if geographic and not projected else {"latitude",
        "longitude"} if projected and not geographic else set()
    required = [c for c in COLLAR if c not in skipped]
    _require(df, required, "collars")
    geometry = F.struct(number(F.col(x)).alias("x"), number(F.col(y)).alias("y"))
    return _projected(df.withColumns({"geometry": geometry,
        "geometry_crs": F.lit(crs or ("EPSG:4326" if geographic else None)).cast("string")}), [*required, "geometry", "geometry_crs"],
        keep_all)


def load_surveys(spark: SparkSession, source, source_column_map=None, keep_all: bool = True, strict: bool = False, **read) -> DataFrame:
    """Surveys. strict: every depth, azimuth and dip must be a number and every id a text, else the table fails."""
    df = standardize(read_table(spark, source, **read), source_column_map, last_wins=strict)
    _require(df, [c for c in SURVEY if c != "to"], "surveys")
    if strict:
        df = coerce_numeric(_named(df), ["depth", "to", "azimuth", "dip"])
        _guard(df, {"missing_hole_id": F.col("hole_id") == "", **{f"missing_{c}": F.col(c).isNull() for c in ("depth", "azimuth", "dip")}},
            "surveys", ["hole_id", "depth", "azimuth", "dip"])
    return _projected(df, SURVEY, keep_all)


def parse_surveys(spark: SparkSession, source, source_column_map=None, **read) -> DataFrame:
    """Surveys without the rows that lack an id or a finite depth, dip or azimuth."""
    df = coerce_numeric(standardize(read_table(spark, source, **read), source_column_map, last_wins=True), ["depth", "azimuth", "dip"])
    return _named(df).filter("hole_id <> ''").dropna(subset=["depth", "azimuth", "dip"])


def _intervals(df: DataFrame, label: str, validate: bool, strict: bool = False) -> DataFrame:
    """Intervals with trimmed ids, numeric bounds and mid. strict: bounds as they are, and to must be greater than from."""
    _require(df, ["hole_id", "from", "to"], label)
    df = coerce_numeric(_named(df), ["from", "to"]) if strict else interval_bounds(_named(df))
    if validate:
        wrong = ref("to") <= ref("from") if strict else ref("to") < ref("from")
        _guard(df, {"missing_hole_id": F.col("hole_id") == "", "missing_from": ref("from").isNull(), "missing_to": ref("to").isNull(),
            "to_le_from": wrong}, label, ["hole_id", "from", "to"])
    return with_mid(df)


def _widened(df: DataFrame, label: str) -> DataFrame:
    code, value = (first_column(df, c) for c in CODES[label])
    if code is None or value is None:
        raise MissingColumns(f"{label}: a long table needs code and value columns; found code={code}, value={value}")
    _require(df, ["hole_id", "from", "to"], label)
    return long_to_wide(df, code, value)


def load_assays(spark: SparkSession, source, source_column_map=None, flat: bool = True, keep_all: bool = True, validate: bool = True,
    js: bool = False, **read) -> DataFrame:
    """Assay intervals with mid. flat=False: a long table (code, value) that becomes wide. One invalid row fails the table. A
    null id is invalid (it isn't turned into text). js: bounds aren't rounded, and equal ones are invalid."""
    df = standardize(read_table(spark, source, **read), source_column_map, last_wins=js)
    if not flat and not js:
        df = _widened(df, "assays")
    return _projected(_intervals(df, "assays", validate, strict=js), ASSAY, keep_all)


def parse_assays(spark: SparkSession, source, hole_id: str | None = None, exact: bool = False, source_column_map=None,
    **read) -> DataFrame:
    """Assay intervals without the rows that are not intervals; of one hole if asked.

    The hole is compared with trimmed ids, for which all rows are read, or with exact with the ids as they are stored, which the
    scan takes over. Either way the row id comes after the filter. For many lookups see write_holes.
    """
    df = standardize(scan(spark, source, **read), source_column_map, last_wins=True)
    kind = None if isinstance(source, DataFrame) else read.get("kind", "csv")
    if hole_id is not None:
        if not hole_id.strip():
            raise ValueError("blank hole id")
        df = exact_hole(df, hole_id) if exact else df.filter(F.trim(F.col("hole_id").cast("string")) == hole_id.strip())
    return _named(coerce_numeric(with_row_id(df, kind), ["from", "to"])).filter((F.col("hole_id") != "") & (ref("to") > ref("from")))


def exact_hole(df: DataFrame, hole_id: str) -> DataFrame:
    """Rows whose id is stored as `hole_id`: a predicate that Parquet's statistics and JDBC take over."""
    return df.filter(F.col("hole_id") == hole_id)


def write_holes(df: DataFrame, path: str, partitions: int | None = None, row_group_bytes: int = 16 << 20) -> str:
    """Write a table clustered by hole, for lookups: ids trimmed (rows without one go), dealt by ranges of hole and sorted by it,
    with a Bloom filter of the ids in each row group. A hole that fills several ranges keeps its rows together.

    Returns the path. Row ids become an ordinary column.
    """
    named = _named(df).filter("hole_id <> ''")
    order = [c for c in ("hole_id", *(("from",) if "from" in df.columns else ("depth",)), ROW) if c in named.columns]
    ranged = named.repartitionByRange(partitions, *map(ref, order)) if partitions else named.repartitionByRange(*map(ref, order))
    ranged.sortWithinPartitions(*map(ref, order)).write.options(**{"parquet.bloom.filter.enabled#hole_id": "true",
        "parquet.block.size": str(row_group_bytes)}).parquet(path)
    return path


def rows_of_hole(spark: SparkSession, path: str, hole_id: str) -> DataFrame:
    """Rows of one hole of a table that write_holes wrote: only files and row groups whose statistics and Bloom filter hold the
    id are read."""
    return exact_hole(spark.read.parquet(path), hole_id.strip())


def load_structures(spark: SparkSession, source, source_column_map=None, keep_all: bool = True, **read) -> DataFrame:
    """Structural points; angles as numbers, bad ones null."""
    df = standardize(read_table(spark, source, **read), source_column_map)
    _require(df, ["hole_id", "depth"], "structures")
    return _projected(coerce_numeric(df, ["dip", "azimuth", "alpha", "beta"]), STRUCTURE, keep_all)


def parse_structures(spark: SparkSession, source, source_column_map=None, **read) -> DataFrame:
    """Structural points or intervals, told apart by their columns (intervals win); rows that are neither go."""
    df = standardize(read_table(spark, source, **read), source_column_map, last_wins=True)
    named = _named(coerce_numeric(df, ["from", "to", "depth", "dip", "azimuth", "alpha", "beta"])).filter("hole_id <> ''")
    if {"from", "to"} <= set(df.columns):
        return with_mid(named.filter(ref("to") > ref("from")))
    _require(df, ["depth"], "structures")
    return named.filter(F.col("depth").isNotNull())


def load_geotechnical(spark: SparkSession, source, source_column_map=None, **read) -> DataFrame:
    """Geotechnical intervals with mid; the five measures as numbers."""
    df = standardize(read_table(spark, source, **read), source_column_map)
    _require(df, ["hole_id", "from", "to"], "geotechnical")
    return with_mid(coerce_numeric(df, ["from", "to", *GEOTECHNICAL]))


def _filled_both_ways(df: DataFrame) -> DataFrame:
    names = ("geology_code", "geology_description")
    df = df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})
    said = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in names}
    return df.withColumns({c: F.coalesce(said[c], said[o], F.col(c).cast("string")) for c, o in (names, names[::-1])})


def load_geology(spark: SparkSession, source, source_column_map=None, flat: bool = True, keep_all: bool = True, validate: bool = True,
    js: bool = False, **read) -> DataFrame:
    """Geology intervals with mid, without overlaps; the code is filled from comments where its column is absent. flat=False: a
    long table that becomes wide. js: code and description fill each other, equal bounds become 1 mm long."""
    df = standardize(read_table(spark, source, **read), source_column_map, last_wins=js)
    if js:
        _require(df, ["hole_id", "from", "to"], "geology")
        if "geology_code" not in df.columns and "geology_description" not in df.columns:
            raise MissingColumns("geology: neither geology_code nor geology_description")
        same = number(ref("from")) == number(ref("to"))
        df = coerce_numeric(df, ["from", "to"]).withColumns({"from": F.when(same, rounded(ref("from"))).otherwise(ref("from")),
            "to": F.when(same, rounded(ref("from")) + 0.001).otherwise(ref("to"))})
        df = _filled_both_ways(_intervals(df, "geology", validate, strict=True))
    else:
        if not flat:
            df = _widened(df, "geology")
        df = _intervals(df, "geology", validate)
        if flat and "geology_code" not in df.columns:
            if "comments" not in df.columns:
                raise MissingColumns("geology: neither geology_code nor comments")
            df = df.withColumn("geology_code", F.col("comments"))
    if validate:
        clash = overlapping_intervals(df).limit(1).collect()
        if clash:
            raise ValueError(f"geology: overlapping intervals, for example {clash[0].asDict()}")
    return _projected(df, GEOLOGY if not js else [c if c != "comments" else "geology_description" for c in GEOLOGY], keep_all)


def load_points(spark: SparkSession, source, source_column_map=None, **read) -> DataFrame:
    """hole_id, order, x, y, z: points of holes that are desurveyed already, by their order column, else by source order (the row id
    where it is a number, else the place in the hole); rows without id or coordinates go, a coordinate that isn't a number is 0."""
    df = standardize(read_table(spark, source, **read), source_column_map, last_wins=True)
    _require(df, ["hole_id", "easting", "northing", "elevation"], "points")
    place = F.col(ROW).cast("double") if df.schema[ROW].dataType.typeName() != "struct" else (F.row_number().over(
        Window.partitionBy("hole_id").orderBy(ROW)) - 1).cast("double")
    order = F.coalesce(number(F.col("order")), place) if "order" in df.columns else place
    kept = _named(df).filter("hole_id <> ''").dropna(subset=["easting", "northing", "elevation"])
    return kept.select("hole_id", order.alias("order"),
        *[F.coalesce(number(F.col(c)), F.lit(0.0)).alias(n) for c, n in (("easting", "x"), ("northing", "y"), ("elevation", "z"))], ROW)


def _depth_rows(df: DataFrame, kind: str) -> DataFrame:
    """Valid intervals without angles, depth := mid, tagged."""
    rows = with_mid(_named(coerce_numeric(df, ["from", "to"])).filter((F.col("hole_id") != "") & (ref("to") > ref("from")))).drop("dip",
        "azimuth")
    return rows.withColumns({"depth": F.col("mid"), "_source": F.lit(kind)})


def parse_interval_rows(spark: SparkSession, source, kind: str, source_column_map=None, **read) -> DataFrame:
    """Assay or geology rows for unified holes: kind is "assay" or "geology"."""
    return _depth_rows(standardize(read_table(spark, source, **read), source_column_map, last_wins=True), kind)


def parse_unified(spark: SparkSession, assays=None, structures=None, geology=None, **read) -> DataFrame:
    """Rows of up to three sources by name, tagged in _source, in the order assays, structures, geology (_part). Structural points
    have no from and to."""
    parts = []
    if assays is not None:
        parts.append(parse_interval_rows(spark, assays, "assay", **read).withColumn("_part", F.lit(0)))
    if structures is not None:
        parts.append(parse_structures(spark, structures, **read).withColumns({"_source": F.lit("structural"), "_part": F.lit(1)}))
    if geology is not None:
        parts.append(parse_interval_rows(spark, geology, "geology", **read).withColumn("_part", F.lit(2)))
    if not parts:
        raise ValueError("no source")
    if len({p.schema[ROW].dataType.simpleString() for p in parts}) > 1:  # numbers beside places in files
        parts = [p if p.schema[ROW].dataType.typeName() == "struct" else p.withColumn(ROW, F.struct(F.lit("").alias("file"),
            F.lit(0).cast("long").alias("block"), F.col(ROW).cast("long").alias("at"))) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def unified(assays: DataFrame, structures: DataFrame, geology: DataFrame | None = None) -> DataFrame:
    """Assays (depth := mid), structures (intervals of 0.1 around their depth) and geology by name, tagged in _source."""
    parts = [assays.withColumns({"depth": F.col("mid"), "_source": F.lit("assay")})]
    depth = number(F.col("depth"))
    parts.append(structures.withColumns({"from": depth - 0.05, "to": depth + 0.05, "mid": depth, "depth": depth,
        "_source": F.lit("structural")}))
    if geology is not None:
        parts.append(geology.withColumns({"depth": F.col("mid"), "_source": F.lit("geology")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def striplog_rows(assays: DataFrame, structures: DataFrame) -> DataFrame:
    """Assays and structures by name, tagged in data_source: structural points become intervals of 0.1 around their depth, equal
    bounds 0.1 long; comments are also structcomment."""
    if "comments" in structures.columns and "structcomment" not in structures.columns:
        structures = structures.withColumn("structcomment", F.col("comments"))
    if {"from", "to"} <= set(structures.columns):
        a, b = number(ref("from")), number(ref("to"))
        structures = structures.withColumn("to", F.when(a == b, b + 0.1).otherwise(b))
    elif "depth" in structures.columns:
        structures = structures.withColumns({"from": number(F.col("depth")) - 0.05, "to": number(F.col("depth")) + 0.05})
    both = assays.withColumn("data_source", F.lit("assay")).unionByName(structures.withColumn("data_source", F.lit("structure")),
        allowMissingColumns=True)
    return _named(both)


def hole_ids(df: DataFrame, with_values: bool = False, skipped: frozenset[str] = frozenset()) -> DataFrame:
    """Distinct trimmed hole ids; with_values: only those with a value in a column outside the skipped ones."""
    if with_values:
        values = [c for c in df.columns if c.lower() not in skipped and c != ROW]
        some = F.lit(False)
        for c in values:
            some = some | (ref(c).isNotNull() & (F.trim(ref(c).cast("string")) != ""))
        df = df.filter(some)
    return df.filter(~is_missing(F.col("hole_id"))).select(F.trim("hole_id").alias("hole_id")).distinct()


def located_assays(assays: DataFrame, collars: DataFrame | None = None, surveys: DataFrame | None = None, traces: DataFrame | None = None,
    step: float = 1.0, project: str | None = None) -> DataFrame:
    """Assays with easting, northing, elevation and project_id, end to end: on the given traces where there are any, which are preferred,
    else on those that collars and surveys give; projects come from the collars, by hole key.

    A hole that has neither leaves its assays without a place. project: only its assays.
    """
    placed = assays
    names = ["md", "easting", "northing", "elevation"]
    if traces is None and collars is not None and surveys is not None:
        placed = nearest_on_pairs(placed, station_pairs(collars, surveys, step), "mid", names)
    elif traces is not None:
        placed = nearest_vertex(placed, traces, "mid", names)
    else:
        placed = placed.withColumns({c: F.lit(None).cast("double") for c in names})
    if collars is not None and "project_id" in collars.columns:
        own = collars.select(hole_key(F.col("hole_id")).alias("hole_id"), "project_id", *[c for c in (ROW,) if c in collars.columns])
        own = first_rows(own, "hole_id").select(F.col("hole_id").alias("_key"), F.col("project_id").alias("_project"))
        placed = placed.join(own, hole_key(F.col("hole_id")) == F.col("_key"), "left").drop("_key")
        given = F.col("project_id") if "project_id" in placed.columns else F.lit(None)
        placed = placed.withColumn("project_id", F.coalesce(given, F.col("_project"))).drop("_project")
    return by_project(placed, project)


TABLES = {"collars": COLLAR, "surveys": SURVEY, "assays": ASSAY, "structures": STRUCTURE, "geology": GEOLOGY,
    "geotechnical": ["hole_id", "from", "to", "mid", *GEOTECHNICAL]}


@dataclass
class Dataset:
    """The tables of a project; absent ones are None (tables() gives them as empty tables)."""

    collars: DataFrame | None = None
    surveys: DataFrame | None = None
    assays: DataFrame | None = None
    structures: DataFrame | None = None
    geology: DataFrame | None = None
    geotechnical: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """All six tables by name; an absent one is empty, with the columns of its model as text."""
        empty = lambda names: spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))
        return {n: empty(names) if getattr(self, n) is None else getattr(self, n) for n, names in TABLES.items()}

    def project(self, project_id: str | None) -> Dataset:
        """All tables of one project (tables without project_id stay whole)."""
        of = lambda df: by_project(df, project_id) if df is not None else None
        return Dataset(*(of(getattr(self, n)) for n in TABLES), metadata=dict(self.metadata))


def by_project(df: DataFrame, project_id: str | None) -> DataFrame:
    return df if project_id is None or "project_id" not in df.columns else df.filter(F.col("project_id") == project_id)
