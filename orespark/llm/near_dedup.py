"""Near-duplicate documents by MinHash with tensored banding; links are confirmed on full shingle sets.

1. A document's set of word shingles; documents with equal sets are one class, however many copies there are.
2. Banding. Two small collections of m minhash groups each (2 * m * width hash values a set) give m * m tables: table
   (i, j) has group i of the first and group j of the second as its key, so that the minhash work is about the
   square root of that of m * m separate tables. A pair of similarity s shares a table with probability
   (1 - (1 - s**width)**m)**2: 0.9994 at 0.8, above 0.99999 at 0.9 for m = 8, width = 2. Groups without a
   partner in either collection drop out before tables are formed.
3. Exact bounds. A shingle that only one candidate class has can't be shared: classes whose shared part is too small for any
   link go, and so do pairs whose shared parts are too small for each other.
4. Links. In each table's bucket every class is first compared with one centre (the class whose shingles most other classes
   have: an original rather than an edited copy), so that large groups cost one pair per class. Components of these
   links are formed; then only pairs of a bucket that are still in different components are compared, inside the
   tasks that hold them (a large group in pairs of blocks, each of which is dealt on its own). A task joins
   the components that it links as it goes, so that it sends at most one link fewer than it has components, and no link
   that could join two components is left out.
5. Components by large-star / small-star; a document's component is the smallest id reachable.

Null or wordless texts have an empty set and no link. A null id has no links and a null component, and is
kept. Rows that repeat an id are one document: their links count for the id. Extra columns are ignored by classes(),
and stay in dedup(). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import WINDOW_PART_BYTES, part_count
from .common import block_pairs, hidden, keyed, runs, slices, texts, written
from .components import components
from .wordhash import BASE, Words, inside, mix, windows

PERCENT = 80
SHINGLE = 5
TABLES = 8
WIDTH = 2


def shingle_sets(strings: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and their bounds."""
    words = Words(strings, lower=True)
    at = inside(words.first, size)
    hashes, owner = windows(words.hash, size)[at], np.searchsorted(words.first, at, "right") - 1
    for i in np.flatnonzero((words.counts > 0) & (words.counts < size)):  # few words: all of them are one shingle
        short = windows(words.hash[words.first[i] : words.first[i + 1]], int(words.counts[i]))
        hashes, owner = np.append(hashes, short), np.append(owner, i)
    if len(owner) > 1 and (np.diff(owner) < 0).any():
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(words.counts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(fresh)])[edges]


def class_ids(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that tell sets apart; None for an empty one."""
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets * np.uint64(k)))]) for k in (BASE, 0xC2B2AE3D27D4EB4F))
    sums = np.stack([one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]], axis=1)
    return [x.tobytes() if a < b else None for x, a, b in zip(sums, bounds, bounds[1:], strict=False)]


def minhash_groups(sets: np.ndarray, bounds: np.ndarray, n_groups: int, width: int) -> np.ndarray:
    """(texts, n_groups): hash of `width` minima each; texts with an empty set have any value."""
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.zeros((len(bounds) - 1, n_groups), np.uint64)
    if not len(full):
        return out
    starts = bounds[:-1][full]
    spread = mix(sets)
    for g in range(n_groups):
        acc = np.zeros(len(full), np.uint64)
        for w in range(width):
            k = int(mix(np.array([g * width + w + 1], np.uint64))[0]) | 1
            acc = acc * np.uint64(BASE) + np.minimum.reduceat(spread * np.uint64(k), starts)
        out[full, g] = mix(acc)
    return out


def signatures(docs: DataFrame, size: int, tables: int, width: int) -> DataFrame:
    """doc_id, n (set size), class (binary, null: empty) and the groups of both collections (arrays of long)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, bounds = shingle_sets(batch.column("text"), size)
            groups = minhash_groups(sets, bounds, 2 * tables, width).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(class_ids(sets, bounds), pa.binary()),
                *(pa.array(list(groups[:, a : a + tables]), pa.list_(pa.int64())) for a in (0, tables))],
                ["doc_id", "n", "class", "left", "right"],
            )

    return docs.mapInArrow(of, "doc_id long, n long, class binary, left array<long>, right array<long>")


def _candidates(reps: DataFrame) -> DataFrame:
    """Classes that share a group of each collection with another class."""
    out = reps
    for side in ("left", "right"):
        keys = reps.select("class", F.posexplode(side).alias("i", "g"))
        again = keys.groupBy("i", "g").agg(F.count("*").alias("k"), F.first("class").alias("one")).filter("k > 1").select("i", "g")
        out = out.join(keys.join(again, ["i", "g"]).select("class").distinct(), "class", "left_semi")
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class, set (binary) of the wanted classes (class, rep), each read from its representative document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, bounds = shingle_sets(batch.column("text"), size)
            mine = [i for i, (a, b) in enumerate(zip(class_ids(sets, bounds), batch.column("class").to_pylist(), strict=True)) if a == b]
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(mine, pa.int64())),
                pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in mine], pa.binary())], ["class", "set"])

    rows = docs.join(wanted.select("class", "rep"), F.col("doc_id") == F.col("rep")).select("class", "text")
    return rows.mapInArrow(of, "class binary, set binary").groupBy("class").agg(F.first("set").alias("set"))


def _shared(sets: DataFrame, n_parts: int) -> DataFrame:
    """class, shared: how many of its shingles another class has too (at least; hashes are cut to 32 bits within a part);
    holders: the classes of each of its shingles, summed."""
    schema = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()),
        ("classes", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "set"):
            own = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
            flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            part = ((flat >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            rows = [{"part": -1 - number, "slice": number, "classes": b"".join(batch.column("class").to_pylist())}]
            for mine in runs(part, order):
                rows.append({"part": int(part[mine[0]]), "slice": number, "hashes": flat[mine].astype(np.uint32).tobytes(),
                    "owners": np.diff(owner[mine], prepend=0).astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)
            number += 1

    def count(key, group):
        if key[0].as_py() < 0:
            return group.select(["slice", "classes"]).append_column("counts", pa.nulls(group.num_rows, pa.binary()))
        rows = group.to_pylist()
        hashes = [np.frombuffer(r["hashes"], np.uint32) for r in rows]
        _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        again, done, out = counts[inverse] > 1, 0, []
        for r, h in zip(rows, hashes, strict=True):
            owners = np.cumsum(np.frombuffer(r["owners"], np.uint32), dtype=np.int64)
            mine = slice(done, done + len(h))
            both = np.stack([np.bincount(owners, again[mine]), np.bincount(owners, counts[inverse[mine]])])
            out.append({"slice": r["slice"], "classes": None, "counts": both.astype(np.int64).tobytes()})
            done += len(h)
        return pa.Table.from_pylist(out, pa.schema([("slice", pa.int64()), ("classes", pa.binary()), ("counts", pa.binary())]))

    def total(key, group):
        rows = group.to_pylist()
        classes = next(r["classes"] for r in rows if r["classes"] is not None)
        out = np.zeros((2, len(classes) // 16), np.int64)
        for r in rows:
            if r["counts"] is not None:
                found = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
                out[:, : found.shape[1]] += found
        return pa.table({"class": pa.array([classes[i : i + 16] for i in range(0, len(classes), 16)], pa.binary()), "shared": out[0],
            "holders": out[1]})

    packed = sets.mapInArrow(spread, "part long, slice long, hashes binary, owners binary, classes binary")
    return packed.groupBy("part").applyInArrow(count, "slice long, classes binary, counts binary").groupBy("slice").applyInArrow(total,
        "class binary, shared long, holders long")


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and shared parts of two classes allow a link: |A and B| is at most the smaller shared part."""
    most = F.least(f"{a}.shared", f"{b}.shared")
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """The pairs (x, y, of classes; centre: one of them; k: about how many the centre has) with
    100 * |X and Y| >= percent * |X or Y|.

    A centre's pairs are dealt over k / block salts. The centre's set goes to each of its salts once and comes before the sets of the other
    ends, which stream past it: no task gets a whole star, no row has two sets, and memory is bounded by a slice.
    """
    ends = pairs.select("centre", F.when(F.col("x") == F.col("centre"), F.col("y")).otherwise(F.col("x")).alias("member"),
        F.ceil(F.col("k") / block).alias("salts"))
    ends = ends.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts"))).drop("salts")
    heads = ends.select("centre", "salt").distinct().select("*", F.lit(None).cast("binary").alias("member"))
    rows = heads.withColumn("class", F.col("centre")).unionByName(ends.withColumn("class", F.col("member"))).join(sets, "class")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in slices(batches, "set"):
            good = []
            for i, (member, raw) in enumerate(zip(batch.column("member"), batch.column("set"), strict=True)):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member.is_valid:
                    head = own.copy()
                    continue
                both = np.sort(np.concatenate([head, own]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    good.append(i)
            yield batch.select(["centre", "member"]).take(pa.array(good, pa.int64()))

    dealt = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())
    found = dealt.select("centre", "member", "set").mapInArrow(of, "centre binary, member binary")
    return found.select(F.least("centre", "member").alias("x"), F.greatest("centre", "member").alias("y"))


def _links(group: pa.Table, i: int, crossed: bool, percent: int, verify: bool) -> list[tuple[bytes, bytes]]:
    """Of one group: with verify, links that join its components (none between components that earlier ones have joined);
    else the classes with a possible partner, as (class, class)."""
    names, n, shared, at = group.column("class").to_pylist(), *(group.column(c).to_numpy() for c in ("n", "shared", "at"))
    left, right = (np.array(group.column(c).to_pylist(), np.int64) for c in ("left", "right"))
    side, at = group.column("side").to_numpy(), at.copy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()] if verify else []
    out = []
    for x in range(len(names)):
        most = np.minimum(shared, shared[x])
        good = (at != at[x]) & (100 * most >= percent * (n + n[x] - most)) & (right == right[x]).any(axis=1)
        good &= (side != side[x]) if crossed else True
        if not verify:
            out += [(names[x], names[x])] * bool(good.any())
            continue
        good[: x + 1] = False
        good &= ~(left[:, :i] == left[x, :i]).any(axis=1)  # else an earlier group has the pair
        for y in np.flatnonzero(good).tolist():
            if at[y] != at[x]:
                both = np.sort(np.concatenate([sets[x], sets[y]]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    at[at == at[y]] = at[x]
                    out.append((names[x], names[y]))
    return out


def _compared(rest: DataFrame, percent: int, verify: bool, block: int = 256) -> DataFrame:
    """x, y: see _links. Classes meet by each group of the first collection, large groups by pairs of blocks."""

    def of(key, group):
        i, _, u, v = (k.as_py() for k in key)
        found = _links(group, i, u != v, percent, verify)
        return pa.table({c: pa.array([f[k] for f in found], pa.binary()) for k, c in enumerate("xy")})

    rows = block_pairs(rest.select("*", F.posexplode("left").alias("i", "g")), ["i", "g"], "class", block, apart="at")
    return rows.groupBy("i", "g", "u", "v").applyInArrow(of, "x binary, y binary")


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tables: int = TABLES, width: int = WIDTH, id_col: str = "doc_id",
    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = texts(docs, id_col, text_col)
    rows = written(signatures(docs, size, tables, width), "signatures")
    full = rows.filter("class is not null and doc_id is not null")
    reps = full.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("left").alias("left"),
        F.first("right").alias("right"))
    reps = written(reps, "classes")
    found = written(_candidates(reps), "candidates")
    sets = written(_sets(docs, found, size), "sets")
    shared = _shared(sets, part_count(docs, WINDOW_PART_BYTES))
    found = written(found.join(shared, "class").filter(100 * F.col("shared") >= percent * F.col("n")), "linkable")
    attributes = ["class", "n", "shared", "holders"]
    bands = found.select(*attributes, F.posexplode("left").alias("i", "g"), "right").select(*attributes, "i", "g",
        F.posexplode("right").alias("j", "h"))
    bands = bands.select(*attributes, F.xxhash64("i", "g", "j", "h").alias("key"))
    rank = F.struct((F.col("holders") / F.col("n")).alias("mean"), "class", "n", "shared")
    buckets = written(bands.groupBy("key").agg(F.count("*").alias("k"), F.max(rank).alias("c")).filter("k > 1"), "buckets")
    bands = written(keyed(bands, buckets, "key", buckets.agg(F.sum("k")).first()[0] or 0), "bands")
    pairs = bands.alias("a").filter(F.col("c.class") != F.col("class")).filter(_possible("a", "c", percent))
    pairs = pairs.select(F.least("class", "c.class").alias("x"), F.greatest("class", "c.class").alias("y"), "c.class", "k")
    pairs = pairs.groupBy("x", "y").agg(F.min("class").alias("centre"), F.max("k").alias("k"))
    stars = written(_verified(pairs, sets, percent), "stars")
    names = reps.select("class", "rep")

    def links(pairs: DataFrame) -> DataFrame:
        ends = (names.select(F.col("class").alias(c), F.col("rep").alias(n)) for c, n in (("x", "a"), ("y", "b")))
        return pairs.join(next(ends), "x").join(next(ends), "y").select("a", "b")

    twins = full.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("z")).filter("x <> z").select("doc_id", "x")
    twins = full.select("doc_id", F.col("class").alias("y")).join(twins, "doc_id").filter("x <> y").select("x",
        "y").distinct()  # rows that repeat an id
    edges = written(links(stars.unionByName(twins)).filter("a <> b").distinct(), "edges")
    groups = components(edges)
    # what stars may have missed: pairs of a bucket in different components
    placed = found.select("class").join(names, "class").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("class",
        F.coalesce("component", "rep").alias("at"))
    mixed = bands.select("key", "class", "k").join(placed, "class").groupBy("key").agg(F.max("k").alias("k"), F.min("at").alias("lo"),
        F.max("at").alias("hi")).filter("lo <> hi").select("key", "k")
    mixed = written(mixed, "mixed")
    rest = keyed(bands.select("key", "class"), mixed, "key", mixed.agg(F.sum("k")).first()[0] or 0).select("class").distinct()
    rest = written(found.join(rest, "class").join(placed, "class").select("class", "n", "shared", "left", "right", "at"), "rest")
    open_ = _compared(rest, percent, verify=False).select(F.col("x").alias("class")).distinct()
    rest = rest.join(open_, "class", "left_semi").join(sets, "class")
    more = written(links(_compared(rest, percent, verify=True)), "more")
    if more.limit(1).count():
        groups = components(edges.unionByName(more))
    joined = rows.join(names, "class", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs without near duplicates: all rows but those whose id isn't its component's smallest. Of rows that
    repeat an id and text, one stays; null ids stay."""
    found = classes(docs, id_col=id_col, text_col=text_col, **parameters)
    gone_id, twice_id = hidden(docs, "_gone", "_twice")
    gone = written(found.filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    left = docs.join(gone, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
    twice = written(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice_id)), "repeated-ids")
    if not twice.limit(1).count():
        return left
    alone = left.join(twice, F.col(f"`{id_col}`") == F.col(twice_id), "left_anti")
    return alone.unionByName(left.join(twice, F.col(f"`{id_col}`") == F.col(twice_id), "left_semi").dropDuplicates([id_col, text_col]))
