"""Helpers shared by the text operators: shared folder, written tables, bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words: \x20 and \x09-\x0D (the separators of bytes.split()).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on a local
    master (tests); elsewhere an error, as each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orespark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table of the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this driver has written and not cleared.
WRITTEN: list[str] = []


def clear_written(spark: SparkSession) -> int:
    """Delete all tables that written() has made so far, once the results that read them have been stored; how many."""
    jvm = spark.sparkContext._jvm
    for path in (paths := [WRITTEN.pop() for _ in range(len(WRITTEN))]):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of `column` hold about `limit` bytes (a longer string is a slice of its own)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Column names for use inside an operator that df doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, whatever else the table has."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


SALTS = 16


def block_pairs(rows: DataFrame, keys: list[str], by: str, block: int, apart: str | None = None) -> DataFrame:
    """rows grouped by keys and the numbers u <= v of two blocks of a group, so that every two rows of a group meet in some
    (keys, u, v): in (s, t) if they are in blocks s and t, and rows of one block in (s, s). side: the row's own block.

    A group of up to `block` rows is one block. Larger ones are split by the hash of `by`; their sizes (one row for each
    such group) are joined over SALTS salts, and each pair of blocks is dealt on its own, so that no task gets a whole
    hot group. Pairs of blocks with a single row are left out.

    apart: only rows that differ in this column need to meet. The rows of a large group's most common value then go to
    blocks of their own, which meet those of the other rows, but not each other.
    """
    values = [F.count("*").alias("k")]
    large = (rows.groupBy(*keys, apart).agg(*values) if apart else rows.groupBy(*keys).agg(*values,
        F.lit(None).alias("v"))).withColumnsRenamed({apart: "v"} if apart else {})
    large = large.groupBy(*keys).agg(F.sum("k").alias("n"), F.max(F.struct("k", "v")).alias("top")).filter(F.col("n") > block)
    main = F.col("top.k") if apart else F.lit(0)
    large = large.select(*keys, F.col("top.v").alias("_main"), F.ceil((F.col("n") - main) / block).cast("int").alias("_mixed"),
        F.ceil(main / block).cast("int").alias("_pure"))
    large = large.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(1)), F.lit(SALTS)).cast("int")).join(large, [*keys, "salt"], "left")
    mixed, pure = F.coalesce("_mixed", F.lit(1)), F.coalesce("_pure", F.lit(0))
    own = F.coalesce(F.col(apart) == F.col("_main"), F.lit(False)) if apart else F.lit(False)
    side = F.when(own, mixed + F.pmod(F.xxhash64(by), pure)).otherwise(F.pmod(F.xxhash64(by), mixed)).cast("int")
    others = F.when(~own, F.sequence(F.lit(0), mixed + pure - 1)).when(mixed > 0, F.sequence(F.lit(0), mixed - 1))
    out = out.withColumn("side", side).select("*", F.explode(others).alias("other"))
    out = out.withColumns({"u": F.least("side", "other"), "v": F.greatest("side", "other")}).drop("salt", "_main", "_mixed", "_pure",
        "other")
    pair = [*keys, "u", "v"]
    return out.repartition(*pair).withColumn("_n", F.count("*").over(Window.partitionBy(*pair))).filter("_n > 1").drop("_n")


#: A key is hot with more than a 1,000th of all rows, and this many at least: there are fewer than 1,000 hot keys.
HOT, LEAST_HOT = 1000, 100_000


def keyed(rows: DataFrame, table: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined with a written table of one row a key, whose k is how many rows the key has; n_rows: the sum of k.

    Rows of hot keys stay where they are: those keys' part of the table, fewer than HOT rows, is broadcast. The others are shuffled.
    """
    most = max(LEAST_HOT, n_rows // HOT)
    if n_rows <= most:  # no key can be hot
        return rows.join(table, key)
    hot, cold = F.broadcast(table.filter(F.col("k") > most)), table.filter(F.col("k") <= most)
    return rows.join(hot.select(key), key, "left_anti").join(cold, key).unionByName(rows.join(hot, key))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(values: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """`order` (which sorts the values) cut where the value changes: as many pieces as there are values, however many parts."""
    if not len(order):
        return []
    ranked = values[order]
    return np.split(order, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1)


def squeeze(values: np.ndarray | bytes) -> bytes:
    """Zstandard over bytes, or over an array's byte planes (all lowest bytes first), which small numbers leave almost empty."""
    import zstandard

    if not isinstance(values, bytes):
        values = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(values)


def unsqueeze(raw: bytes, kind: type | None = None) -> np.ndarray | bytes:
    """What squeeze() was given: bytes, or an array of the kind."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    if kind is None:
        return data
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
