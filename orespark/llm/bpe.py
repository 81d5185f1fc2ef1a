"""Byte-level BPE over the distinct pre-tokens of a corpus: encoding, decoding and token counts.

A task splits its texts into blocks of bounded size. A block's pre-tokens become local numbers in order of first
appearance; the number sequence (the positions) is written once to the shared folder, and only the block's distinct
pre-tokens are shuffled, packed by hash into bounded parts. Each part encodes each of its distinct pre-tokens once for the
whole corpus and sends the ids back to the blocks, which reassemble their documents by position. A hot
pre-token is one entry per block, so no key can be hot. Decoding joins a document's ids with the token-byte table where the
ids are (the vocabulary has a fixed size). Token counts travel the same way with frequencies in place of positions.

Null texts count as empty; repeated rows and repeated ids are documents of their own; a text longer than a block is a
block by itself. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, slices, squeeze, texts, unsqueeze, written

BLOCK_BYTES = 32 << 20
#: Bytes of text whose distinct pre-tokens one part holds, and whose windows or shingles.
PART_BYTES, WINDOW_PART_BYTES = 64 << 20, 24 << 20
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str, special: bool = False):
    """The library's encoder of a rank file; with special, SPECIAL in a text is one id, the one after the ranks."""
    import tiktoken

    table = ranks(path)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=table, special_tokens={SPECIAL: len(table)} if special else {})


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """Token bytes by id (a vocabulary: fixed size, whatever the corpus)."""
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


@lru_cache(maxsize=2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Numbers(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pack(words: list[bytes]) -> tuple[bytes, bytes]:
    return squeeze(np.fromiter(map(len, words), np.uint32, len(words))), squeeze(b"".join(words))


def unpack(lengths: bytes, blob: bytes) -> list[bytes]:
    ends, blob = np.cumsum(unsqueeze(lengths, np.uint32)).tolist(), unsqueeze(blob)
    return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


BLOCKS = "block long, part int, at binary, lengths binary, blob binary, ids binary, bytes binary, sizes binary, numbers binary, times binary"


def blocks(docs: DataFrame, pattern: str, n_parts: int, counts: bool, special: str | None) -> DataFrame:
    """Rows of two kinds. part >= 0: distinct pre-tokens of a block (lengths, blob) and their local numbers (gaps in at).
    part -1: the block's documents (ids, bytes, sizes) and the local numbers of all positions; or with counts of each
    distinct pre-token of a document (as differences), and its times."""
    columns = [x.split()[0] for x in BLOCKS.split(", ")]
    types = {"block": pa.int64(), "part": pa.int32()}
    schema = pa.schema([(n, types.get(n, pa.binary())) for n in columns])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = splitter(pattern), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK_BYTES):
            numbers, sequences = Numbers(), []
            number = numbers.__getitem__
            for text in batch.column("text").to_pylist():
                if special and special in text:
                    found = []
                    for i, piece in enumerate(text.split(special)):
                        found += [special] * (i > 0) + find(piece)
                else:
                    found = find(text)
                sequences.append(np.fromiter(map(number, found), np.uint32, len(found)))
            sizes = np.array([len(s) for s in sequences], np.uint32)
            flat = np.concatenate(sequences) if len(numbers) else np.zeros(0, np.uint32)
            frequent = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")  # small numbers for common ones
            rank = np.empty(len(frequent), np.uint32)
            rank[frequent] = np.arange(len(frequent), dtype=np.uint32)
            flat, times = rank[flat], np.zeros(0, np.int64)
            if counts and len(flat):
                keys, times = np.unique(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | flat,
                    return_counts=True)
                flat, sizes = keys.astype(np.uint32), np.bincount((keys >> np.uint64(32)).astype(np.int64),
                    minlength=len(sizes)).astype(np.uint32)
                flat = np.diff(flat, prepend=np.uint32(0))
            names = list(numbers)
            words = [names[i].encode() for i in frequent.tolist()]
            part = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.int32, len(words))
            rows = []
            for mine in runs(part, np.argsort(part, kind="stable")):
                lengths, blob = pack([words[i] for i in mine])
                rows.append({"block": block, "part": int(part[mine[0]]), "at": squeeze(np.diff(mine, prepend=0).astype(np.uint32)),
                    "lengths": lengths, "blob": blob})
            sizes_of = batch.column("text").cast(pa.binary())
            n_bytes = np.array([len(x) for x in sizes_of.to_pylist()], np.int64)
            rows.append({
                "block": block, "part": -1, "ids": _ids(batch.column("doc_id")), "bytes": n_bytes.tobytes(), "sizes": sizes.tobytes(),
                "numbers": squeeze(flat), "times": squeeze(times.astype(np.uint32)),
            })
            yield pa.RecordBatch.from_pylist(rows, schema)
            block += 1

    return docs.mapInArrow(of, BLOCKS)


def _ids(column: pa.Array) -> bytes:
    """Ids with a flag for null."""
    values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.tobytes() + column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()


def _ids_back(raw: bytes, n: int) -> pa.Array:
    return pa.array(np.frombuffer(raw, np.int64, n), mask=np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool))


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def part_count(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts in proportion to the bytes of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(8, -(-total // part_bytes))


def encoded_parts(table: DataFrame, encode, ids: bool) -> DataFrame:
    """Of every part, each distinct pre-token encoded once: (block, at, n) and with ids their concatenation."""
    schema = "block long, at binary, n binary, tokens binary"

    def of(group: pa.Table) -> pa.Table:
        seen: dict[bytes, object] = {}
        rows = group.to_pylist()
        words = [unpack(r["lengths"], r["blob"]) for r in rows]
        fresh = list(dict.fromkeys(w for ws in words for w in ws))
        for i in range(0, len(fresh), 20_000):
            seen |= zip(fresh[i : i + 20_000], encode(fresh[i : i + 20_000]), strict=True)
        out = []
        for r, ws in zip(rows, words, strict=True):
            if ids:
                found = [seen[w] for w in ws]
                n, tokens = np.fromiter(map(len, found), np.uint32, len(ws)) // 4, squeeze(np.frombuffer(b"".join(found), np.uint32))
            else:
                n, tokens = np.fromiter(map(seen.__getitem__, ws), np.uint32, len(ws)), None
            out.append({"block": r["block"], "at": r["at"], "n": squeeze(n), "tokens": tokens})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("at", pa.binary()), ("n", pa.binary()),
            ("tokens", pa.binary())]))

    return table.filter("part >= 0").select("block", "part", "at", "lengths", "blob").groupBy("part").applyInArrow(of, schema)


def _gathered(parts: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
    rows = parts.to_pylist()
    return [np.cumsum(unsqueeze(r["at"], np.uint32), dtype=np.int64) for r in rows], [unsqueeze(r["n"],
        np.uint32) for r in rows], [r["tokens"] for r in rows]


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens by a byte-level tokenizer file (.json), SPECIAL in a text counted as its one id."""
    docs = texts(docs, id_col, text_col)
    table = written(blocks(docs, pattern, part_count(docs), counts=True, special=SPECIAL), "count-blocks")

    def encode(words: list[bytes]) -> list[int]:
        return [len(x.ids) for x in json_tokenizer(path).encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def of(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        at, n, _ = _gathered(right)
        pieces = np.zeros(sum(map(len, at)), np.int64)
        for a, b in zip(at, n, strict=True):
            pieces[a] = b
        sizes = np.frombuffer(row["sizes"], np.uint32)
        numbers = np.cumsum(unsqueeze(row["numbers"], np.uint32), dtype=np.uint32)
        each = pieces[numbers] * unsqueeze(row["times"], np.uint32) if len(numbers) else np.zeros(0, np.int64)
        total = np.diff(_bounds(each)[_bounds(sizes)])
        return pa.table({"doc_id": _ids_back(row["ids"], len(sizes)), "n_bytes": np.frombuffer(row["bytes"], np.int64),
            "n_tokens": total.astype(np.int64)})

    documents = table.filter("part = -1").select("block", "ids", "bytes", "sizes", "numbers", "times")
    return documents.groupBy("block").cogroup(encoded_parts(table, encode, ids=False).groupBy("block")).applyInArrow(of,
        "doc_id long, n_bytes long, n_tokens long")


class TokenBytes:
    """The token-byte table as Arrow's binary array, by id: a vocabulary, of fixed size whatever the corpus is."""

    def __init__(self, path: str):
        self.table = pa.array(byte_table(path), pa.binary())

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each run ids[bounds[i]:bounds[i + 1]]: the ids joined with the table, their bytes one after another."""
        if not len(ids):
            return [b""] * (len(bounds) - 1)
        joined = self.table.take(pa.array(ids))
        ends = np.frombuffer(joined.buffers()[1], np.int32)[: len(ids) + 1][bounds]
        blob = joined.buffers()[2].to_pybytes() if joined.buffers()[2] is not None else b""
        return [blob[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary) of every row of encoded: its array of ids joined with the token-byte table of the rank file.

    The vocabulary is joined in the tasks that hold the ids, so no token is shuffled. Null ids count as none; repeated rows
    are decoded as often as they occur; extra columns are ignored; an id outside the vocabulary raises IndexError.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column("ids")
                bounds = _bounds(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"),
                    pa.array(table.decode(lists.flatten().to_numpy(zero_copy_only=False), bounds), pa.binary())], ["doc_id", "decoded"])

    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(of, "doc_id long, decoded binary")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    digests: bool = False) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary: the ids joined with the token-byte table); with digests only
    doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = texts(docs, id_col, text_col)
    table = written(blocks(docs, pattern, part_count(docs), counts=False, special=None), "bpe-blocks")

    def encode(words: list[bytes]) -> list[bytes]:
        encoder = rank_encoder(path, pattern)
        return [np.array(encoder.encode_ordinary(w.decode()), np.uint32).tobytes() for w in words]

    def assembled(sizes: np.ndarray, numbers: np.ndarray, own: np.ndarray, starts: np.ndarray,
        lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For runs of documents: their pre-tokens' numbers, ids by position, and bounds of both for each document."""
        stops, at = _bounds(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(stops, stops[at] + (1 << 20), "right")) - 1)
            mine = numbers[stops[at] : stops[to]]
            n = lengths[mine]
            ends = _bounds(n)
            ids = own[np.repeat(starts[mine] - ends[:-1], n) + np.arange(ends[-1])]
            yield mine, ids, stops[at : to + 1] - stops[at], ends[stops[at : to + 1] - stops[at]]
            at = to

    def of(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        at, n, tokens = _gathered(right)
        starts, lengths, parts, done = np.zeros(sum(map(len, at)), np.int64), np.zeros(sum(map(len, at)), np.int64), [], 0
        for a, b, raw in zip(at, n, tokens, strict=True):
            parts.append(unsqueeze(raw, np.uint32))
            lengths[a], starts[a] = b, done + _bounds(b)[:-1]
            done += len(parts[-1])
        own = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        sizes, numbers = np.frombuffer(row["sizes"], np.uint32), unsqueeze(row["numbers"], np.uint32)
        doc_ids, names = _ids_back(row["ids"], len(sizes)), token_bytes(path)
        shown = [(",".join(map(str, own[a : a + k].tolist())) + ",").encode() for a,
            k in zip(starts.tolist(), lengths.tolist(), strict=True)] if digests else []
        n_tokens, ids_out, decoded_out = [], [], []
        for mine, ids, words, bounds in assembled(sizes, numbers, own, starts, lengths):
            decoded, mine = names.decode(ids, bounds), mine.tolist()
            n_tokens += np.diff(bounds).tolist()
            if digests:
                decoded_out += [hashlib.sha256(x).hexdigest() for x in decoded]
                ids_out += [hashlib.sha256(b"".join(map(shown.__getitem__, mine[a:b]))[:-1]).hexdigest() for a,
                    b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True)]
            else:
                decoded_out += decoded
                ids_out += np.split(ids.astype(np.int32), bounds[1:-1])
        if not digests:
            return pa.table({"doc_id": doc_ids, "ids": pa.array(ids_out, pa.list_(pa.int32())),
                "decoded": pa.array(decoded_out, pa.binary())})
        return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_out, pa.string()),
            "decoded_sha256": pa.array(decoded_out, pa.string())})

    documents = table.filter("part = -1").select("block", "ids", "sizes", "numbers")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return documents.groupBy("block").cogroup(encoded_parts(table, encode, ids=True).groupBy("block")).applyInArrow(of, schema)
