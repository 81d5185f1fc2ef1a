"""Ranked lexical search over bit-sliced Bloom signatures.

The index cuts the corpus into chunks of documents with about as many keys. A document's keys are its terms, and for a term
that occurs more than 1, 2, 4, ... times a further key for each of these levels. Every key sets HASHES bits of the document's Bloom
signature; a chunk stores the signatures bit by bit (row i: the documents whose bit i is set), so the documents that may hold a key
are the AND of a few rows. A query term is never missed, only overestimated: the level found bounds its frequency from above, and
the level's score with the document's exact length, summed over the query's terms, bounds the document's score.

A search takes queries in blocks of bounded size, and each block against all chunks:
1. exact document frequencies of the block's terms (summed in the tasks first), so exact weights;
2. bounds of all documents; the k best bounds of each query are scored exactly, their k-th score is the query's floor;
3. bounds again; every document whose bound reaches the floor is scored exactly on its whole text (terms compared byte by byte), the
   others provably rank below k. Each task keeps its k best, and Spark ranks these.

Null texts and texts without a term hold nothing and are never found; a query without terms finds nothing. Repeated rows and repeated
queries count each on their own; equal scores rank by doc_id, null ids last. A text longer than a slice is a chunk of its own. Extra columns
are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _bounds, _ids, _ids_back
from .common import slices, squeeze, texts, unsqueeze, written
from .wordhash import Words, mix

#: Bits of a signature for each key, and those that a key sets.
BITS, HASHES = 12, 4
#: Documents of a chunk at most, how many more keys its largest document may have, text that is indexed at a time.
CHUNK_DOCS, SPREAD, INDEX_BYTES = 1024, 1.5, 8 << 20
#: Bytes of query text that make a block, and query terms that are looked up at a time.
QUERY_BYTES, TERMS = 1 << 20, 4096
#: Bytes of terms: ASCII letters (to lower case) and digits, and all bytes of other characters; the rest separates.
FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        FOLD[_b] = _b + 32 * (65 <= _b <= 90)


def folded(strings: pa.Array) -> pa.Array:
    """The strings with lower-case ASCII letters and a space for every byte between terms."""
    strings = strings.cast(pa.large_string()) if pa.types.is_string_view(strings.type) else strings
    width = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    offsets = np.frombuffer(strings.buffers()[1], width)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = strings.buffers()[2]
    data = FOLD[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    return joined(data.tobytes(), offsets - offsets[0])


def joined(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data))


def bit_rows(keys: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    """The signature rows of each key at a level: HASHES columns."""
    seeds = (np.arange(HASHES, dtype=np.uint64) + np.uint64(1 + level * HASHES)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mix(keys[:, None] ^ seeds) % np.uint64(n_bits)).astype(np.int64)


def levels_of(tf: np.ndarray) -> np.ndarray:
    """Keys of a term that occurs tf times: 1 for once, 2 for twice, 3 for up to 4, 4 for up to 8."""
    return 1 + np.ceil(np.log2(tf)).astype(np.int64)


INDEX = "chunk long, n_docs long, n_terms long, ids binary, n binary, n_bits long, bits binary, offsets binary, terms binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The signature index of all documents, written: one row for each chunk, with the folded texts for exact scores."""
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in INDEX.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", INDEX_BYTES):
            words = Words(folded(batch.column("text")))
            doc = np.repeat(np.arange(batch.num_rows), words.counts)
            order = np.argsort(words.hash, kind="stable")  # documents stay in order within a hash
            keys, doc = words.hash[order], doc[order]
            fresh = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else order
            levels = levels_of(np.diff(np.append(fresh, len(keys))))
            keys, doc = keys[fresh], doc[fresh]
            n_keys = np.bincount(doc, levels, batch.num_rows).astype(np.int64)
            by_doc = np.argsort(doc, kind="stable")
            at = _bounds(np.bincount(doc, minlength=batch.num_rows))
            ranked, i = np.argsort(n_keys, kind="stable"), 0
            ranked = ranked[n_keys[ranked] > 0]  # documents without a term are never found
            while i < len(ranked):
                most = max(16, int(n_keys[ranked[i]] * SPREAD))
                j = min(i + CHUNK_DOCS, int(np.searchsorted(n_keys[ranked], most, "right")))
                mine = ranked[i:j]
                n_bits = BITS * int(n_keys[mine[-1]])
                bits = np.zeros((n_bits, len(mine)), bool)
                place = np.concatenate([by_doc[at[d] : at[d + 1]] for d in mine])
                slot = np.repeat(np.arange(len(mine)), at[mine + 1] - at[mine])
                for level in range(int(levels[place].max())):
                    has = levels[place] > level
                    bits[bit_rows(keys[place[has]], level, n_bits), slot[has][:, None]] = True
                spans = [words.data[words.offsets[d] : words.offsets[d + 1]] for d in mine]
                yield pa.RecordBatch.from_pylist([{
                    "chunk": chunk, "n_docs": len(mine), "n_terms": int(words.counts[mine].sum()), "ids": _ids(batch.column("doc_id").take(pa.array(mine))), "n": words.counts[mine].astype(np.int64).tobytes(),
                    "n_bits": n_bits, "bits": squeeze(np.packbits(bits, axis=1).tobytes()),
                    "offsets": _bounds(np.array([len(x) for x in spans])).tobytes(), "terms": squeeze(np.concatenate(spans).tobytes()),
                }], schema)
                chunk, i = chunk + 1, j

    return written(texts(docs, id_col, text_col).mapInArrow(of, INDEX), "search-index")


class Queries:
    """A block of queries: its distinct terms and, for each query, the places of its terms (repeats included)."""

    def __init__(self, strings: list[str]):
        words = Words(folded(pa.array([s or "" for s in strings], pa.string())))
        spelled = [words.data[a:b].tobytes() for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        order = sorted({(h, t) for h, t in zip(words.hash.tolist(), spelled, strict=True)})
        self.hash = np.array([h for h, _ in order], np.uint64)
        place = {t: i for i, (_, t) in enumerate(order)}
        self.data = np.frombuffer(b"".join(t for _, t in order), np.uint8)
        self.at = _bounds(np.array([len(t) for _, t in order], np.int64))
        #: Terms that share a hash, at most (1 but by chance): all of them are compared.
        self.alike = int(np.unique(self.hash, return_counts=True)[1].max(initial=1))
        flat = np.array([place[t] for t in spelled], np.int64)
        self.terms = [flat[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.weight = np.zeros(len(order), np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def matches(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of a word, place of a query term) for all words that are query terms, compared byte by byte."""
        found = []
        first = np.searchsorted(self.hash, words.hash)
        for k in range(self.alike):
            term = np.minimum(first + k, len(self.hash) - 1)
            word = np.flatnonzero((self.hash[term] == words.hash) & (first + k < len(self.hash))) if len(self.hash) else np.zeros(0, np.int64)
            term = term[word]
            n = self.at[term + 1] - self.at[term]
            same = words.end[word] - words.start[word] == n
            word, term, n = word[same], term[same], n[same]
            step = np.arange(n.sum()) - np.repeat(_bounds(n)[:-1], n)
            differs = words.data[np.repeat(words.start[word], n) + step] != self.data[np.repeat(self.at[term], n) + step]
            good = np.diff(_bounds(differs)[_bounds(n)]) == 0
            found.append((word[good], term[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Chunk:
    """A row of the index."""

    def __init__(self, row: dict, total: tuple[int, int]):
        self.row = row
        self.n = np.frombuffer(row["n"], np.int64)
        n_docs, n_terms = total
        self.m = 75 + 25 * self.n * n_docs // max(n_terms, 1)

    def doc_ids(self) -> list[int | None]:
        return _ids_back(self.row["ids"], len(self.n)).to_pylist()

    def part(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """A term's share of the score, before its weight."""
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def bounds(self, queries: Queries) -> np.ndarray:
        """Upper bounds of the scores: a row for each query, a column for each document."""
        size, n_bits = len(self.n), self.row["n_bits"]
        bits = np.frombuffer(unsqueeze(self.row["bits"]), np.uint8).reshape(n_bits, -1)
        out = np.zeros((len(queries.terms), size), np.int64)
        most = int(levels_of(self.n.max(keepdims=True))[0])
        share = np.array([np.zeros(size, np.int64), *[self.part(np.int64(1 << level), self.m) for level in range(most)]])
        for begin in range(0, len(queries.hash), TERMS):
            keys = queries.hash[begin : begin + TERMS]
            reached, here = np.zeros((len(keys), size), np.int8), np.arange(len(keys))
            on = np.full((len(keys), bits.shape[1]), 255, np.uint8)
            for level in range(most):  # a level counts only above all lower ones
                on = on & np.bitwise_and.reduce(bits[bit_rows(keys[here], level, n_bits)], axis=1)
                some = on.any(axis=1)
                here, on = here[some], on[some]
                if not len(here):
                    break
                reached[here] += np.unpackbits(on, axis=1, count=size).view(np.int8)
            some = np.flatnonzero(reached.any(axis=1))
            value = np.zeros((len(some) + 1, size), np.int64)  # the last row: terms that no document holds
            value[:-1] = share[reached[some], np.arange(size)] * queries.weight[begin + some][:, None]
            row = np.full(len(keys), len(some))
            row[some] = np.arange(len(some))
            for i, terms in enumerate(queries.terms):
                mine = row[terms[(terms >= begin) & (terms < begin + TERMS)] - begin]
                for k in range(0, len(mine), TERMS):
                    out[i] += value[mine[k : k + TERMS]].sum(axis=0)
        return out

    def words(self, slots: np.ndarray) -> Words:
        """Words of some of the documents."""
        offsets, data = np.frombuffer(self.row["offsets"], np.int64), unsqueeze(self.row["terms"])
        spans = [data[offsets[s] : offsets[s + 1]] for s in slots.tolist()]
        return Words(joined(b"".join(spans), _bounds(np.array([len(x) for x in spans], np.int64))))

    def scores(self, queries: Queries, query: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of a query and a document."""
        slots, at = np.unique(slot, return_inverse=True)
        words = self.words(slots)
        word, term = queries.matches(words)
        doc = np.searchsorted(words.first, word, "right") - 1
        key, tf = np.unique(doc * len(queries.hash) + term, return_counts=True)
        doc, term = np.divmod(key, max(len(queries.hash), 1))
        value = self.part(tf.astype(np.int64), self.m[slots[doc]]) * queries.weight[term]
        begin = np.searchsorted(doc, np.arange(len(slots) + 1))
        out = np.zeros(len(query), np.int64)
        own = np.zeros(len(queries.hash), np.int64)
        by_doc = np.argsort(at, kind="stable")
        for pair in np.split(by_doc, np.flatnonzero(np.diff(at[by_doc])) + 1):
            d = at[pair[0]]
            held = slice(begin[d], begin[d + 1])
            own[term[held]] = value[held]
            for p in pair.tolist():
                out[p] = own[queries.terms[query[p]]].sum()
            own[term[held]] = 0
        return out


def _chunks(batches: Iterator[pa.RecordBatch], total: tuple[int, int]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(batch.slice(i, 1).to_pylist()[0], total)


FOUND = {"query": pa.int64(), "chunk": pa.int64(), "slot": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()}
FOUND_DDL = ", ".join(f"{n} long" for n in FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "chunk", "slot")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Best:
    """The k best rows of each query that a task has seen: by score, then by id (null last), then by place."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, query: int, rows: list[tuple[int, bool, int, int, int]]) -> None:
        """rows: (-score, null id, id, chunk, slot)."""
        self.rows[query] = sorted(self.rows.get(query, []) + rows)[: self.k]

    def batch(self) -> pa.RecordBatch:
        flat = [(q, chunk, slot, None if null else i, -score) for q, rows in self.rows.items() for score, null, i, chunk, slot in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(FOUND.values())], list(FOUND))


def _best_bounds(index: DataFrame, queries: Queries, total: tuple[int, int], k: int) -> DataFrame:
    """The k highest bounds of each query in each task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(queries.terms)
        kept = [np.zeros((n, 0), np.int64)] * 3  # bound, chunk, slot
        for c in _chunks(batches, total):
            bounds = c.bounds(queries)
            fresh = [bounds, np.full_like(bounds, c.row["chunk"]), np.broadcast_to(np.arange(bounds.shape[1]), bounds.shape)]
            kept = [np.concatenate([a, b], axis=1) for a, b in zip(kept, fresh, strict=True)]
            if kept[0].shape[1] > k:
                top = np.argpartition(-kept[0], k - 1, axis=1)[:, :k]
                kept = [np.take_along_axis(x, top, axis=1) for x in kept]
        query = np.repeat(np.arange(n), kept[0].shape[1])
        some = np.flatnonzero(kept[0].ravel() > 0)
        bound, chunk, slot = (pa.array(x.ravel()[some]) for x in kept)
        yield pa.RecordBatch.from_arrays([pa.array(query[some]), chunk, slot, pa.nulls(len(some), pa.int64()), bound], list(FOUND))

    return index.select("chunk", "n", "n_bits", "bits").mapInArrow(of, FOUND_DDL)


def _seed_scores(index: DataFrame, queries: Queries, total: tuple[int, int], seeds: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Exact scores of the seeds: at most k of each query of the block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, total):
            query, slot = np.array(seeds[c.row["chunk"]], np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(c.scores(queries, query, slot))], ["query", "score"])

    spark = index.sparkSession
    mine = spark.createDataFrame([(c,) for c in seeds], "chunk long")
    rows = index.select("chunk", "n", "offsets", "terms").join(F.broadcast(mine), "chunk", "left_semi")
    return rows.mapInArrow(of, "query long, score long")


def _not_excluded(index: DataFrame, queries: Queries, total: tuple[int, int], floor: np.ndarray, k: int) -> DataFrame:
    """Each task's k best by exact score, of all documents whose bound reaches the floor."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for c in _chunks(batches, total):
            query, slot = np.nonzero(c.bounds(queries) >= floor[:, None])
            if not len(query):
                continue
            score, ids = c.scores(queries, query, slot), c.doc_ids()
            good = np.flatnonzero(score >= floor[query])
            for q, rows in _by_query(query[good], slot[good], score[good]):
                best.add(q, [(-s, ids[d] is None, ids[d] or 0, c.row["chunk"], d) for d, s in rows])
        yield best.batch()

    return index.mapInArrow(of, FOUND_DDL)


def _by_query(query: np.ndarray, slot: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    for mine in np.split(np.arange(len(query)), np.flatnonzero(np.diff(query)) + 1):  # np.nonzero goes query by query
        if len(mine):
            yield int(query[mine[0]]), list(zip(slot[mine].tolist(), score[mine].tolist(), strict=True))


def document_frequencies(index: DataFrame, queries: Queries) -> np.ndarray:
    """In how many documents each term of the block occurs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.hash), np.int64)
        for c in _chunks(batches, (0, 0)):
            words = c.words(np.arange(len(c.n)))
            word, term = queries.matches(words)
            doc = np.searchsorted(words.first, word, "right") - 1
            df += np.bincount(np.unique(doc * len(df) + term) % max(len(df), 1), minlength=len(df))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    out = np.zeros(len(queries.hash), np.int64)
    for r in index.select("n", "offsets", "terms").mapInArrow(of, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def search_block(index: DataFrame, strings: list[str], total: tuple[int, int], k: int) -> DataFrame:
    """query (its place in strings), rank, doc_id, score of the k best documents of each query. total: documents and terms of the index."""
    queries = Queries(strings)
    queries.weigh(total[0], document_frequencies(index, queries))
    seeds: dict[int, list[tuple[int, int]]] = {}
    for r in _ranked(_best_bounds(index, queries, total, k), k).collect():
        seeds.setdefault(r["chunk"], []).append((r["query"], r["slot"]))
    scores: dict[int, list[int]] = {}
    for r in _seed_scores(index, queries, total, seeds).collect() if seeds else []:
        scores.setdefault(r["query"], []).append(r["score"])
    floor = np.ones(len(strings), np.int64)  # a score above 0
    for query, found in scores.items():
        floor[query] = max(1, min(found)) if len(found) >= k else 1
    return _ranked(_not_excluded(index, queries, total, floor, k), k).select("query", F.col("rank").cast("int"), "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each row of queries."""
    spark, kind = index.sparkSession, queries.schema[id_col].dataType
    total = tuple(index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).head())
    rows = queries.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n_blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // QUERY_BYTES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    parts = [spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")]
    for b in range(n_blocks):
        block = rows.filter(F.col("block") == b).collect()
        if not block or not total[0]:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"query long, item_id {kind.simpleString()}")
        found = search_block(index, [r["text"] for r in block], total, k)
        parts.append(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts)
