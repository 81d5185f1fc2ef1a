"""Substring dedup: words of repeated 20-word windows are removed, all but their earliest occurrence.

Any 20 consecutive words hold one whole aligned block of 10 (a block that starts at a multiple of 10 words). So:

1. Anchors. Aligned blocks of all documents are the reference index; every rolling 10-word window probes it. Hashes are
   packed by hash range into parts of bounded size (4 bytes a window instead of a row); a part reports the windows whose
   content occurs elsewhere too, with an aligned block among the occurrences.
2. Extension. Only 20-word windows around such hits are candidates for maximal repeats. Their 64-bit hashes are packed
   by hash range; a part finds each content's earliest occurrence (document id, then start) and marks the later ones.
3. Marked windows are joined back to their documents and their words removed.

Within a slice of texts, equal windows are resolved on the spot and sent once, so a passage that a third of all
documents share is one entry per slice. Texts are shuffled once, by document; all three steps read that exchange. A slice
sends one row to each part that it has windows of: at most slices x parts rows, and never more than windows, so rows grow
with the corpus beyond some terabytes (a row a window is where the packing ends).

Anchors are told apart by 64-bit hashes (a false hit costs time only). Candidate windows are told apart by two independent 64-bit
hashes of their words' hashes: of 3e11 distinct windows the expected number of pairs taken for equal is 1e-16.

Null texts count as empty. A null id sorts first. Rows that repeat an id count as the same document: a window is not
earlier than one with the same id and start, so equal rows are judged alike. Extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WINDOW_PART_BYTES, part_count
from .common import runs, slices, squeeze, texts, unsqueeze
from .wordhash import Words, inside, mix, windows

SIZE = 20
BLOCK = SIZE // 2
FIRST_ID = -(1 << 63)
#: What makes a second word hash of the first.
SECOND = np.uint64(0xA0761D6478BD642F)

PACKED = "part long, slice long, hashes binary, gaps binary, aligned binary, keys binary, tags binary, first binary, known binary"
PACKED_SCHEMA = pa.schema([("part", pa.int64()), ("slice", pa.int64()),
    *((n, pa.binary()) for n in ("hashes", "gaps", "aligned", "keys", "tags", "first", "known"))])


def _gaps(sorted_values: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_values, prepend=0).astype(np.uint32))


def _values(gaps: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(gaps, np.uint32), dtype=np.int64)


def _anchors(n_parts: int):
    """Packed rolling windows of each slice, and one row (part < 0) of its documents and the repeats known already."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            words = Words(batch.column("text"))
            at = inside(words.first, BLOCK)
            hashes = windows(words.hash, BLOCK)[at]
            owner = np.searchsorted(words.first, at, "right") - 1
            aligned = (at - words.first[owner]) % BLOCK == 0
            unique, index, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            any_aligned = np.zeros(len(unique), bool)
            any_aligned[inverse[aligned]] = True
            part = ((unique >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((index, part))
            rows = [{"part": -1 - number, "slice": number, "keys": _int64(batch, "key"), "tags": _int64(batch, "tag"),
                "first": words.first.astype(np.uint32).tobytes(), "known": _gaps(at[counts[inverse] > 1])}]
            for mine in runs(part, order):
                rows.append({"part": int(part[mine[0]]), "slice": number, "hashes": unique[mine].astype(np.uint32).tobytes(),
                    "gaps": _gaps(at[index[mine]]), "aligned": np.packbits(any_aligned[mine]).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, PACKED_SCHEMA)
            number += 1

    return of


def _int64(batch: pa.RecordBatch, name: str) -> bytes:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()


def _probe(key, group):
    """Of a part: the offsets of windows that occur again, with an aligned block among the occurrences."""
    if key[0].as_py() < 0:
        return group.select(["slice", "keys", "tags", "first", "known"]).append_column("gaps", pa.nulls(group.num_rows, pa.binary()))
    rows = group.select(["slice", "hashes", "gaps", "aligned"]).to_pylist()
    hashes = [np.frombuffer(r["hashes"], np.uint32) for r in rows]
    aligned = np.concatenate([np.unpackbits(np.frombuffer(r["aligned"], np.uint8), count=len(h)) for r,
        h in zip(rows, hashes, strict=True)]).astype(bool)
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    again = (np.diff(np.append(edges, len(flat))) > 1) & (np.add.reduceat(aligned[order].astype(np.int64), edges) > 0)
    hit = np.zeros(len(flat), bool)
    hit[order] = np.repeat(again, np.diff(np.append(edges, len(flat))))
    out, done = [], 0
    for r, h in zip(rows, hashes, strict=True):
        mine = hit[done : done + len(h)]
        done += len(h)
        if mine.any():
            out.append({"slice": r["slice"], "gaps": _gaps(_values(r["gaps"])[mine])})
    return pa.Table.from_pylist(out, HITS_SCHEMA)


HITS = "slice long, keys binary, tags binary, first binary, known binary, gaps binary"
HITS_SCHEMA = pa.schema([("slice", pa.int64()), *((n, pa.binary()) for n in ("keys", "tags", "first", "known", "gaps"))])


def _by_document(key, group):
    """Of a slice: each document's positions among those found by the parts and those known in the slice."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["keys"] is not None)
    hits = np.unique(np.concatenate([_values(r["gaps"]) for r in rows if r["gaps"] is not None] + [_values(head["known"])]))
    first = np.frombuffer(head["first"], np.uint32).astype(np.int64)
    owner = np.searchsorted(first, hits, "right") - 1
    docs, starts = np.unique(owner, return_index=True)
    keys, tags = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["tags"], np.int64)
    found = [_gaps(x - first[d]) for d, x in zip(docs, np.split(hits, starts[1:]), strict=True)] if len(docs) else []
    return pa.table({"key": keys[docs], "tag": tags[docs], "hits": pa.array(found, pa.binary())})


CANDIDATES = "part long, slice long, hashes binary, second binary, gaps binary, docs binary, starts binary, keys binary, tags binary, first binary, known binary"
CANDIDATES_SCHEMA = pa.schema([("part", pa.int64()), ("slice", pa.int64()),
    *((n, pa.binary()) for n in ("hashes", "second", "gaps", "docs", "starts", "keys", "tags", "first", "known"))])


def _earliest(hashes: np.ndarray, second: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether a window is as early as any of its content (equal in both hashes), by id, then start."""
    order = np.lexsort((pos, keys, second, hashes))
    head = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (second[order][1:] != second[order][:-1])])
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    out = np.zeros(len(hashes), bool)
    out[order] = (keys[order] == keys[lead]) & (pos[order] == pos[lead])
    return out


def _candidates(n_parts: int):
    """Packed hashes of the 20-word windows around hits: of equal ones in a slice the earliest; the others are known
    to be later (in the slice's own row, part < 0)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            words = Words(batch.column("text"))
            counts, first = words.counts, words.first
            near = np.zeros(len(words.hash) + 1, np.int32)
            for i, raw in enumerate(batch.column("hits").to_pylist()):
                if raw is not None and counts[i] >= SIZE:
                    at = _values(raw)
                    np.add.at(near, first[i] + np.maximum(at - BLOCK, 0), 1)
                    np.add.at(near, first[i] + np.minimum(at + 1, counts[i]), -1)
            at = inside(first, SIZE)
            at = at[np.cumsum(near)[at] > 0]
            if not len(at):
                continue
            hashes, second = windows(words.hash, SIZE)[at], windows(mix(words.hash + SECOND), SIZE)[at]
            owner = np.searchsorted(first, at, "right") - 1
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            early = _earliest(hashes, second, keys[owner], at - first[owner])
            rows = [{"part": -1 - number, "slice": number, "keys": keys.tobytes(), "tags": _int64(batch, "tag"),
                "first": first.astype(np.uint32).tobytes(), "known": _gaps(at[~early])}]
            kept = np.flatnonzero(early)
            part = ((hashes[kept] >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
            for run in runs(part, np.argsort(part, kind="stable")):
                mine = kept[run]
                docs, doc = np.unique(owner[mine], return_inverse=True)
                rows.append({"part": int(part[run[0]]), "slice": number, "hashes": hashes[mine].tobytes(),
                    "second": second[mine].tobytes(), "gaps": _gaps(at[mine]), "docs": _gaps(doc), "starts": first[docs].astype(np.uint32).tobytes(), "keys": keys[docs].tobytes()})
            number += 1
            yield pa.RecordBatch.from_pylist(rows, CANDIDATES_SCHEMA)

    return of


def _later(key, group):
    """Of a part: the offsets of all windows but each content's earliest."""
    if key[0].as_py() < 0:
        return group.select(["slice", "keys", "tags", "first", "known"]).append_column("gaps", pa.nulls(group.num_rows, pa.binary()))
    rows = group.select(["slice", "hashes", "second", "gaps", "docs", "starts", "keys"]).to_pylist()
    at, doc = [_values(r["gaps"]) for r in rows], [_values(r["docs"]) for r in rows]
    keys = np.concatenate([np.frombuffer(r["keys"], np.int64)[d] for r, d in zip(rows, doc, strict=True)])
    pos = np.concatenate([a - np.frombuffer(r["starts"], np.uint32)[d] for r, a, d in zip(rows, at, doc, strict=True)])
    hashes, second = (np.concatenate([np.frombuffer(r[n], np.uint64) for r in rows]) for n in ("hashes", "second"))
    early = _earliest(hashes, second, keys, pos)
    out, done = [], 0
    for r, a in zip(rows, at, strict=True):
        mine = ~early[done : done + len(a)]
        done += len(a)
        if mine.any():
            out.append({"slice": r["slice"], "gaps": _gaps(a[mine])})
    return pa.Table.from_pylist(out, HITS_SCHEMA)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by spaces), or with digests kept_sha256."""
    docs = texts(docs, id_col, text_col)
    n_parts = part_count(docs, WINDOW_PART_BYTES)
    rows = docs.select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("key"), F.xxhash64("text").alias("tag"), "text")
    rows = rows.repartition("key", "tag").sortWithinPartitions("key", "tag")
    packed = rows.mapInArrow(_anchors(n_parts), PACKED)
    hits = packed.groupBy("part").applyInArrow(_probe, HITS).groupBy("slice").applyInArrow(_by_document, "key long, tag long, hits binary")
    hits = hits.groupBy("key", "tag").agg(F.first("hits").alias("hits"))  # equal rows of one document have equal hits
    near = rows.join(hits, ["key", "tag"]).select("key", "tag", "text", "hits")
    marks = near.mapInArrow(_candidates(n_parts), CANDIDATES).groupBy("part").applyInArrow(_later, HITS)
    marks = marks.groupBy("slice").applyInArrow(_by_document, "key long, tag long, hits binary")
    marks = marks.groupBy("key", "tag").agg(F.first("hits").alias("marks"))
    own = "kept_sha256" if digests else "kept"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for text, mine in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                words = text.encode().split()
                n = len(words)
                if mine is not None:
                    cover, at = np.zeros(n + 1, np.int64), _values(mine)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + SIZE, -1)
                    words = list(compress(words, (np.cumsum(cover)[:n] == 0).tolist()))
                n_words.append(n), n_removed.append(n - len(words))
                rest = b" ".join(words)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest.decode())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", own])

    out = rows.join(marks, ["key", "tag"], "left").select("key", "text", "marks").mapInArrow(cut,
        f"doc_id long, n_words long, n_removed long, {own} string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(FIRST_ID)))
