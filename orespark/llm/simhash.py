"""SimHash fingerprints, and permuted block tables that find all fingerprints within a Hamming radius.

Terms are pairs of adjacent words (the word itself in a one-word text), weighted by occurrences times length, so that long,
rare pairs count more than pairs of function words. Each term's 64-bit hash votes on 64 signed bits; the sign of a
bit's sum is the fingerprint's bit. Unrelated texts agree on about half of the bits.

Null texts count as empty; a text without words has fingerprint 0. Documents are ordered by id (nulls first), then text;
a single document is its own next one; repeated rows follow each other. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, block_pairs, slices, texts, written
from .wordhash import Words, inside, windows

BITS = 64
RADIUS = 3
#: One table per choice of two of five blocks: 10 tables, keys of 25 bits or more.
BLOCKS = 5


def fingerprints(strings: pa.Array) -> np.ndarray:
    """One 64-bit fingerprint per text (null: 0)."""
    words = Words(strings)
    counts = words.counts
    out = np.zeros(len(counts), np.uint64)
    at = inside(words.first, 2)
    terms, owner = windows(words.hash, 2)[at], np.searchsorted(words.first, at, "right") - 1
    length = np.minimum(words.end[at + 1] - words.start[at], 64) if len(at) else np.zeros(0)
    bits = np.unpackbits(terms.view(np.uint8)).reshape(-1, BITS)
    edges = np.searchsorted(owner, np.arange(len(counts) + 1))
    for i in np.flatnonzero(counts):
        if counts[i] == 1:
            out[i] = words.hash[words.first[i]]
            continue
        a, b = edges[i], edges[i + 1]
        votes = np.zeros(BITS)
        for k in range(a, b, 1 << 16):  # whole numbers below 2**24: exact in single precision
            w = length[k : min(b, k + (1 << 16))].astype(np.float32)
            votes += (w @ bits[k : k + len(w)]).astype(np.float64)
        out[i] = np.packbits(votes * 2 > length[a:b].sum()).view(np.uint64)[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def _hex(x: np.ndarray) -> pa.Array:
    return pa.array([f"{v:016x}" for v in x.tolist()], pa.string())


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (long) of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text")).view(np.int64))],
                ["doc_id", "fingerprint"])

    return texts(docs, id_col, text_col).mapInArrow(of, "doc_id long, fingerprint long")


def _tables(radius: int, n_blocks: int) -> list[int]:
    """Bit masks of the tables' keys: one table per choice of n_blocks - radius of the blocks."""
    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(n_blocks), n_blocks - radius)]


def _met(table: DataFrame, radius: int, n_blocks: int, block: int) -> tuple[DataFrame, Callable]:
    """Different fingerprints dealt by the tables' keys (hot buckets in pairs of blocks), and a function that finds the
    links of such a group: index pairs of fingerprints at most `radius` bits apart that no earlier table brings together."""
    masks = _tables(radius, n_blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = table.select("fingerprint").dropna().distinct()
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    rows = entries.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.t", "k.key")

    def links(key, group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t, _, u, v = (k.as_py() for k in key)
        values, side = group.column("fingerprint").to_numpy().view(np.uint64), group.column("side").to_numpy()
        for i in range(len(values) - 1):
            differ = values[i + 1 :] ^ values[i]
            good = np.bitwise_count(differ) <= radius
            if u != v:
                good &= side[i + 1 :] != side[i]
            near = np.flatnonzero(good)
            for m in masks[:t]:
                near = near[differ[near] & np.uint64(m) != 0]
            if len(near):
                yield values, np.full(len(near), i), near + i + 1

    return block_pairs(rows, ["t", "key"], "fingerprint", block).groupBy("t", "key", "u", "v"), links


def near_fingerprints(table: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS, block: int = 2048) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most `radius` bits apart, by permuted block tables.

    At most `radius` of the n_blocks blocks hold the differing bits, so the others agree: one table per choice of
    n_blocks - radius blocks has those blocks as its key. A pair is reported by the first table that it agrees in, so
    no distinct step follows. Equal fingerprints are one entry, however many documents share them. The output holds
    every pair, so k near fingerprints give up to k * k / 2 rows: near_documents() counts them inside the tasks instead.
    """
    groups, links = _met(table, radius, n_blocks, block)

    def of(key, group):
        found = [(v[i], v[j]) for v, i, j in links(key, group)]
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return groups.applyInArrow(of, "a long, b long")


def link_counts(table: DataFrame, radius: int = RADIUS, n_blocks: int = BLOCKS, block: int = 2048) -> DataFrame:
    """fingerprint, n_links: how many other fingerprints are within the radius, of those that have any. Pairs are counted in
    the tasks that compare them; a task sends one row per fingerprint."""
    groups, links = _met(table, radius, n_blocks, block)

    def of(key, group):
        counts = np.zeros(group.num_rows, np.int64)
        for _, i, j in links(key, group):
            counts[i[0]] += len(j)
            counts[j] += 1
        values, some = group.column("fingerprint").to_numpy(), counts > 0
        return pa.table({"fingerprint": values[some], "n": counts[some]})

    return groups.applyInArrow(of, "fingerprint long, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_links"))


def near_documents(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, class_id (smallest id with an equal fingerprint) and n_links (other fingerprints within the radius) of every
    row of table (doc_id, fingerprint). A null fingerprint has neither class nor links."""
    classes = table.dropna(subset="fingerprint").groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).join(link_counts(table,
        radius), "fingerprint", "left")
    classes = classes.select("*", F.explode(F.sequence(F.lit(0),
        F.lit(SALTS - 1))).alias("salt"))  # a fingerprint may be a third of all rows
    salted = table.withColumn("salt", (F.rand(1) * SALTS).cast("int"))
    return salted.join(classes, ["fingerprint", "salt"], "left").select("doc_id", "class_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: pa.Array, own: list[str], nexts: list[str], fp: np.ndarray, fp_next: np.ndarray) -> list[pa.Array]:
    edited = []
    for text, after in zip(own, nexts, strict=True):
        take = len(text) // 4
        edited.append(text[: len(text) - take] + after[:take])
    of_edited = fingerprints(pa.array(edited, pa.string()))
    digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string())
    sizes = pa.array([len(x) for x in own], pa.int64())
    return [ids, sizes, digests, _hex(fp), _hex(of_edited), pa.array(likeness(fp, of_edited)), pa.array(likeness(fp, fp_next))]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document against its edited text (last quarter replaced by the start of the next document) and the next document.

    Documents are sorted by id in range partitions, each of which streams once; only the first and last document of
    a partition meet in a second, small step (one row per partition).
    """
    names = [x.split()[0] for x in OUT.split(", ")]
    edge = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("text", pa.string()), ("fp", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last = TaskContext.get().partitionId(), None

        def row(kind: int, doc_id: int | None, text: str, fp: int) -> pa.RecordBatch:
            values = {"doc_id": doc_id, "kind": kind, "pid": pid, "text": text, "fp": fp}
            return pa.RecordBatch.from_pylist([{f.name: values.get(f.name) for f in schema}], schema)

        for batch in slices(batches):
            own, fp, ids = batch.column("text").to_pylist(), fingerprints(batch.column("text")), batch.column("doc_id").to_pylist()
            if last is None:
                yield row(2, ids[0], own[0], int(fp[:1].view(np.int64)[0]))
            else:
                own, fp, ids = [last[1], *own], np.concatenate([last[2], fp]), [last[0], *ids]
            last = ids[-1], own[-1], fp[-1:]
            n = len(own) - 1
            made = _compare(pa.array(ids[:-1], pa.int64()), own[:-1], own[1:], fp[:-1], fp[1:])
            yield pa.RecordBatch.from_arrays([*made, pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()),
                pa.nulls(n, pa.int64())], schema=schema)
        if last is not None:
            yield row(1, last[0], last[1], int(last[2].view(np.int64)[0]))

    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([*((x.split()[0], types[x.split()[1]]) for x in OUT.split(", ")), *edge])
    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    table = written(ordered.mapInArrow(of, OUT + ", kind int, pid int, text string, fp long"), "simhash")
    heads = table.filter("kind = 2").select("pid", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    places = heads.select("pid", F.coalesce(F.lead("pid").over(Window.orderBy("pid")),
        F.min("pid").over(Window.partitionBy())).alias("after"))  # one row per partition
    edges = table.filter("kind = 1").select("doc_id", "pid", "text", "fp").join(places, "pid").join(heads.withColumnRenamed("pid", "after"),
        "after")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = [b.column(c).to_numpy().view(np.uint64) for c in ("fp", "next_fp")]
            yield pa.RecordBatch.from_arrays(_compare(b.column("doc_id"), b.column("text").to_pylist(), b.column("next_text").to_pylist(),
                *fp), names)

    met = edges.select("doc_id", "text", "fp", "next_text", "next_fp").mapInArrow(meet, OUT)
    return table.filter("kind = 0").select(*names).unionByName(met)
