"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, by diagonal run skipping.

A task encodes slices of texts with both tokenizers and walks the two arrays of token ends (byte offsets, over the slice's
texts one after another) along a diagonal, a fixed shift between the two indices. Probes of doubling length compare the arrays
at that shift and jump over stretches in which every token ends with its counterpart; where they differ, the side that is
behind moves on until the ends meet, and the shift is updated. Every common end closes a group and is a link of the two
tokens that end there.

Two tokens that end together are one a suffix of the other, so the possible id pairs are bounded by the two vocabularies
whatever the corpus is (`pair_bound`): their counts, made by Spark, are small enough for every task.

Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens. Repeated rows and ids are
documents of their own; a text longer than a slice is a slice of its own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _bounds, _ids, _ids_back
from .common import slices, squeeze, texts, unsqueeze, written

#: Bytes of text of a slice.
ALIGN_BYTES = 2 << 20
SPACE = "▁"


class Encoder:
    """Ids of whole texts, and the bytes of each id."""

    names: list[bytes]

    def __init__(self) -> None:
        self.lengths = np.fromiter(map(len, self.names), np.uint32, len(self.names))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with the space that both tokenizers see."""
        raise NotImplementedError

    def tokens(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, their number in each text, and which texts their bytes give back."""
        found = [self.encode(s) if s else np.zeros(0, np.uint32) for s in strings]
        kept = np.array([b"".join(map(self.names.__getitem__, x.tolist())) == s.encode() for x, s in zip(found, strings, strict=True)], bool)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found)), kept


class ByteLevel(Encoder):
    """A tokenizer file (.json) of byte-level BPE, read as ranks (its ids rise with the order of its merges) and encoded by the
    rank library, which is several times as fast. Special tokens' strings are plain text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        back = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][x + y] for x, y in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: ids don't follow the merges, so they are no ranks")
        ranks = {bytes(back[c] for c in x): model["vocab"][x] for x in {*back, *(x + y for x, y in merges)}}
        self.names = [b""] * (max(ranks.values()) + 1)
        for name, i in ranks.items():
            self.names[i] = name
        self.library = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        super().__init__()

    def encode(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=())


class Pieces(Encoder):
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.names = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        super().__init__()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text[1:]), np.uint32)


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str, pattern: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a, pattern), Pieces(path_b)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices i, j of all equal ends ends_a[i] == ends_b[j] (both arrays increase): diagonal run skipping."""
    ends_a, ends_b = np.ascontiguousarray(ends_a, np.uint32), np.ascontiguousarray(ends_b, np.uint32)
    a, b, raw_a, raw_b = memoryview(ends_a), memoryview(ends_b), ends_a.tobytes(), ends_b.tobytes()
    n_a, n_b, i, j, runs = len(a), len(b), 0, 0, []
    while i < n_a and j < n_b:
        x, y = a[i], b[j]
        while x != y:  # an irregular group: the side that is behind moves on
            if x < y:
                i += 1
                if i == n_a:
                    break
                x = a[i]
            else:
                j += 1
                if j == n_b:
                    break
                y = b[j]
        if x != y:
            break
        at, step, left = 1, 1, n_a - i if n_a - i < n_b - j else n_b - j
        while at < left:  # probes of doubling length at the shift j - i
            if step == 1:
                if a[i + 1] != b[j + 1]:
                    break
                at, step = 2, 2
                continue
            to = at + step if at + step < left else left
            if raw_a[4 * (i + at) : 4 * (i + to)] == raw_b[4 * (j + at) : 4 * (j + to)]:
                at, step = to, 2 * step
                continue
            while to - at > 1:  # the first difference lies in [at, to)
                mid = (at + to) // 2
                if raw_a[4 * (i + at) : 4 * (i + mid)] == raw_b[4 * (j + at) : 4 * (j + mid)]:
                    at = mid
                else:
                    to = mid
            break
        runs.append((i, j, at))
        i, j = i + at, j + at
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start_a, start_b, n = np.array(runs, np.int64).T
    steps = np.arange(n.sum()) - np.repeat(_bounds(n)[:-1], n)
    return np.repeat(start_a, n) + steps, np.repeat(start_b, n) + steps


PACKED = {"ids": pa.binary(), "sizes": pa.binary(), "a": pa.binary(), "b": pa.binary(), "last_a": pa.binary(), "last_b": pa.binary()}


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of every text, a row for each slice of texts, written: what the functions below read.

    a and b are the ids of both tokenizers over the slice, last_a and last_b the steps between the positions of the tokens that
    close a group, sizes the numbers of a's and b's tokens and of groups in each text. path_a: byte-level BPE (.json) of
    a space and the text; path_b: a sentencepiece model of the text.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = encoders(path_a, path_b, pattern)
        for batch in slices(batches, limit=ALIGN_BYTES):
            strings = [" " + t if t else "" for t in batch.column("text").to_pylist()]
            (a, n_a, kept_a), (b, n_b, kept_b) = first.tokens(strings), second.tokens(strings)
            kept = kept_a & kept_b
            a, b, n_a, n_b = a[np.repeat(kept, n_a)], b[np.repeat(kept, n_b)], n_a * kept, n_b * kept
            last_a, last_b = common_ends(np.cumsum(first.lengths[a]), np.cumsum(second.lengths[b]))
            groups = np.diff(np.searchsorted(last_a, _bounds(n_a)))
            yield pa.RecordBatch.from_pylist([{
                "ids": _ids(batch.column("doc_id")), "sizes": squeeze(np.concatenate([n_a, n_b, groups]).astype(np.uint32)),
                "a": squeeze(a), "b": squeeze(b), "last_a": squeeze(np.diff(last_a, prepend=-1).astype(np.uint32)),
                "last_b": squeeze(np.diff(last_b, prepend=-1).astype(np.uint32)),
            }], pa.schema(PACKED))

    return written(texts(docs, id_col, text_col).mapInArrow(of, ", ".join(f"{n} binary" for n in PACKED)), "aligned")


class Slice:
    """A row of align(): doc_ids, ids a and b, positions last_a and last_b, and bounds of all three for each text."""

    def __init__(self, row: dict):
        sizes = unsqueeze(row["sizes"], np.uint32).reshape(3, -1).astype(np.int64)
        self.doc_ids = _ids_back(row["ids"], sizes.shape[1])
        self.n_a, self.n_b, self.n_groups = sizes
        self.at_a, self.at_b, self.at_groups = map(_bounds, sizes)
        self.a, self.b = unsqueeze(row["a"], np.uint32), unsqueeze(row["b"], np.uint32)
        self.last_a, self.last_b = (np.cumsum(unsqueeze(row[n], np.uint32), dtype=np.int64) - 1 for n in ("last_a", "last_b"))

    @property
    def links(self) -> np.ndarray:
        """The id pair of every link: a's in the upper half."""
        return self.a[self.last_a].astype(np.uint64) << np.uint64(32) | self.b[self.last_b]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Slice(batch.slice(i, 1).to_pylist()[0])


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def alignments(aligned: DataFrame) -> DataFrame:
    """doc_id, a_ids, b_ids, and a_last, b_last: the positions in them (from 0) of the tokens that close each group."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _unpacked(batches):
            last_a = s.last_a - np.repeat(s.at_a[:-1], s.n_groups)
            last_b = s.last_b - np.repeat(s.at_b[:-1], s.n_groups)
            yield pa.RecordBatch.from_arrays([s.doc_ids, _lists(s.a, s.at_a), _lists(s.b, s.at_b), _lists(last_a, s.at_groups),
                _lists(last_b, s.at_groups)], ["doc_id", "a_ids", "b_ids", "a_last", "b_last"])

    return aligned.mapInArrow(of, "doc_id long, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a_id, b_id, n (links of the corpus that hold the pair), best (n is the highest of its b_id)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for s in _unpacked(batches):  # a task's distinct pairs: as many as the vocabularies allow, at most
            fresh, times = np.unique(s.links, return_counts=True)
            merged, place = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            total = np.zeros(len(merged), np.int64)
            np.add.at(total, place, np.concatenate([n, times]))
            pairs, n = merged, total
        yield pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(32)).astype(np.int32)),
            pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n)], ["a_id", "b_id", "n"])

    counts = aligned.select("a", "b", "last_a", "last_b", "sizes", "ids").mapInArrow(of, "a_id int, b_id int, n long")
    counts = counts.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def pair_bound(path_a: str, path_b: str, pattern: str) -> int:
    """How many id pairs can ever end together: one token's bytes are a suffix of the other's."""
    a, b = (Counter(x.names) for x in encoders(path_a, path_b, pattern))
    longer_a = sum(n * b[name[i:]] for name, n in a.items() for i in range(len(name)))
    return longer_a + sum(n * a[name[i:]] for name, n in b.items() for i in range(1, len(name)))


def summarize(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    counts: pair_counts(), of at most `bound` rows; a larger table is refused, as every task holds it.
    """
    known = counts.limit(bound + 1).toArrow()
    if known.num_rows > bound:
        raise ValueError(f"more than the {bound} id pairs that the vocabularies allow")
    pairs = known["a_id"].to_numpy().astype(np.uint64) << np.uint64(32) | known["b_id"].to_numpy().astype(np.uint64)
    order = np.argsort(pairs)
    pairs, n, best = pairs[order], known["n"].to_numpy()[order], known["best"].to_numpy()[order]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown: list[bytes] = []
        for s in _unpacked(batches):
            place = np.searchsorted(pairs, s.links)
            n_best, count_sum = (np.diff(_bounds(x[place])[s.at_groups]) for x in (best, n))
            top = 1 + int(max(s.a.max(initial=0), s.b.max(initial=0)))
            if 3 * top > len(shown):
                shown = [b"%d%s" % (i, mark) for i in range(top) for mark in (b",", b"|", b";")]
            # Groups in a row: a's tokens follow all b's tokens of earlier groups, b's follow all a's tokens up to their own
            code_a, code_b = 3 * s.a.astype(np.int64), 3 * s.b.astype(np.int64)
            code_a[s.last_a] += 1
            code_b[s.last_b] += 2
            of_a = np.repeat(np.arange(len(s.last_a)), np.diff(s.last_a, prepend=-1))
            of_b = np.repeat(np.arange(len(s.last_b)), np.diff(s.last_b, prepend=-1))
            codes = np.empty(len(code_a) + len(code_b), np.int64)
            codes[np.arange(len(code_a)) + np.concatenate([[0], s.last_b + 1])[of_a]] = code_a
            codes[np.arange(len(code_b)) + (s.last_a + 1)[of_b]] = code_b
            bounds = (s.at_a + s.at_b).tolist()
            digests = [hashlib.sha256(b"".join(map(shown.__getitem__, codes[x:y].tolist()))[:-1]).hexdigest() if y > x else ""
                for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([s.doc_ids, *map(pa.array, (s.n_a, s.n_b, s.n_groups, s.n_groups, n_best, count_sum)),
                pa.array(digests, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(of, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
