"""Packing of documents into sequences: a sharded BM25 index returns unused neighbours of each seed document, which
greedily fill its window.

1. Every document is tokenized once into a written table (the library encodes each distinct part of a slice of texts once),
   with a lexical key: the nearest of a few centroids of token use (in practice its language or register), then two
   minhashes of its rare tokens. Token frequencies and centroids are fitted on a bounded sample (sample_docs); every
   document is keyed.
2. Documents are sorted by that key over shards of about `shard_docs`, fewer where documents are long, so that documents
   with words in common meet and a shard is bounded whatever the corpus is; a hot key goes on over as many shards as it
   fills. A shard reads the texts back from the ids and builds an inverted index of all their
   words with their frequencies, and a seed queries it with all of its own. A seed fills whole windows by itself; the open
   rest of its last window takes its best-scored unused neighbours that fit, down to the last with a positive score, then
   the first part of the best one that doesn't, whose other part opens the next window as the new seed. Only a shard's last window has padding.
   shard_docs=None makes one shard of all documents: the exact search over the corpus, for tables that one task can hold.
3. The pieces are cut from the ids where the shard is packed.

Null texts count as empty and hold the end token alone; repeated rows are packed as often as they occur; ties of score go
to the earlier document in the order of keys; an empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPECIAL, byte_table, rank_encoder
from .common import SLICE_BYTES, slices, texts, written
from .wordhash import BASE, SPACES, mix

K1, B = 1.2, 0.75
#: Words with most documents that a shard's index keeps as whole rows.
DENSE = 512
#: Documents whose products with those words are made at once, where more than one document in SEEDS will be a seed, and bytes
#: of products that a shard keeps (beyond them, seeds are scored one by one).
STEP, SEEDS, BLOCK_BYTES = 64, 3, 32 << 20
#: Token ids of a shard (about; a longer document is whole).
SHARD_IDS = 8 << 20


#: Documents in the sample, centroids, tokens that the centroids count, and the share of documents of a token that isn't rare.
SAMPLE, CENTROIDS, COMMON, RARE = 1000, 8, 256, 0.05


#: The pattern whose matches never go on over white space that follows another character, and look ahead from white space only:
#: so a text cut there has the same tokens. Texts of other patterns aren't cut.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that end no white space of the pattern: other printable ASCII, and last bytes that no Unicode white space has.
NO_SPACE = np.zeros(256, bool)
NO_SPACE[0x21:0x7F] = NO_SPACE[0x80:0xC0] = True
NO_SPACE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens by id, SPECIAL last, and where each begins."""
    table = [*byte_table(path), SPECIAL.encode()]
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all runs, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    kind = np.int32 if max(len(values), int(ends[-1])) < 1 << 31 else np.int64
    return values[np.repeat((starts - ends + sizes).astype(kind), sizes) + np.arange(ends[-1], dtype=kind)]


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, and where each begins."""
    if pa.types.is_large_string(strings.type):
        strings = strings.cast(pa.string())
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = strings.buffers()[2]
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8), offsets - offsets[0]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)),
        pa.py_buffer(np.ascontiguousarray(data))])


def token_ids(encoder, texts: list[str] | pa.Array, end_id: int) -> list[np.ndarray]:
    """The ids of each text and the end token: 16 bits each, or 32 for a larger vocabulary.

    Texts are cut before white space, and the library encodes each distinct part of them once: those that begin and end where
    a cut can be in one run, whose ids are told apart by their bytes, the others (first and last in a text, mostly) singly.
    """
    kind = np.uint16 if encoder.n_vocab <= 1 << 16 else np.uint32
    encode = partial(encoder.encode_to_numpy, allowed_special={SPECIAL})
    if encoder._pat_str != CUT_PATTERN:
        return [np.append(encode(text), end_id).astype(kind) for text in (texts if isinstance(texts, list) else texts.to_pylist())]
    if not len(texts):
        return []
    data, offsets = _buffers(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = SPACES[data[1:]] & NO_SPACE[data[:-1]]
    cut[offsets] = True
    cuts = np.flatnonzero(cut)
    found = _binary(data, cuts).dictionary_encode()
    which, parts = found.indices.to_numpy(), found.dictionary
    flat, at = np.frombuffer(parts.buffers()[2] or b"", np.uint8), np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1]
    free = SPACES[flat[at[:-1]]] & NO_SPACE[flat[at[1:] - 1]]
    sizes = np.diff(at).astype(np.int64)
    ids = encode(_spread(flat, at[:-1][free].astype(np.int64), sizes[free]).tobytes().decode())
    ends = np.zeros(len(parts), np.int64)
    ends[free] = np.searchsorted(np.cumsum(np.diff(token_table(encoder.name)[1])[ids]), np.cumsum(sizes[free])) + 1
    single = [encode(parts[i].as_py().decode()) for i in np.flatnonzero(~free).tolist()]
    counts = np.zeros(len(parts), np.int64)
    counts[free], counts[~free] = np.diff(ends[free], prepend=0), [len(x) for x in single]
    ends[~free] = len(ids) + np.cumsum(counts[~free])
    ids = np.concatenate([ids, *single]).astype(kind)
    many = counts[which]
    total = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(cuts, offsets)]  # ids before each text
    out = np.insert(_spread(ids, (ends - counts)[which], many), total[1:], end_id)
    return np.split(out, total[1:-1] + np.arange(1, len(total) - 1))


class Keys:
    """Lexical keys of documents, fitted on the distinct tokens of a sample of them."""

    def __init__(self, sample: list[np.ndarray], n_vocab: int):
        df = np.bincount(np.concatenate(sample), minlength=n_vocab) if sample else np.zeros(n_vocab, np.int64)
        self.common = np.argsort(-df, kind="stable")[:COMMON]
        self.rare = df <= RARE * len(sample)
        column = np.full(n_vocab, -1)
        column[self.common] = np.arange(len(self.common))
        self.column = column
        points = np.stack([self._point(x) for x in sample]) if sample else np.zeros((1, len(self.common)))
        centres = points[:1]
        while len(centres) < min(CENTROIDS, len(points)):  # each next one is the sample's farthest from all so far
            centres = np.vstack([centres, points[np.argmin((points @ centres.T).max(axis=1))]])
        for _ in range(20):
            near = np.argmax(points @ centres.T, axis=1)
            means = np.stack([points[near == k].sum(axis=0) if (near == k).any() else c for k, c in enumerate(centres)])
            centres = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
        self.centres = centres

    def _point(self, distinct: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.common))
        at = self.column[distinct]
        out[at[at >= 0]] = 1
        return out / max(1.0, np.sqrt(out.sum()))

    def of(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid and two minhashes of each document (every document has its end token)."""
        flat, first = np.concatenate(documents), np.cumsum([0, *map(len, documents)])[:-1]
        column, owner = self.column[flat], np.repeat(np.arange(len(documents)), np.diff(np.append(first, len(flat))))
        points = np.zeros((len(documents), len(self.common)), np.float32)
        points[owner[column >= 0], column[column >= 0]] = 1
        cluster = np.argmax(points @ self.centres.T.astype(np.float32),
            axis=1).astype(np.int32)  # a point's length doesn't change its nearest
        hashes = []
        for k in (1, 2):
            spread = mix(np.arange(1, len(self.rare) + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(k)) >> np.uint64(1)
            spread[~self.rare] |= np.uint64(1 << 63)  # a common token only where there is no rare one
            hashes.append(mix(np.minimum.reduceat(spread[flat], first)).view(np.int64))  # mixed: long texts have small minima
        return cluster, *hashes


def fitted(docs: DataFrame, path: str, pattern: str, end_id: int, sample_docs: int) -> Keys:
    """Keys from the documents with the smallest hashes, at most sample_docs of them (some four times as many are sorted)."""
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)  # 53 bits, as a double holds them
    most = min(1.0, 4 * sample_docs / max(1, docs.count())) * (1 << 53)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern, special=True)
        for batch in slices(batches):
            found = [np.unique(x).astype(np.int32) for x in token_ids(encoder, batch.column("text"), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["tokens"])

    sample = docs.filter(spread < F.lit(most)).orderBy(spread, "doc_id").limit(sample_docs).select("doc_id", "text").mapInArrow(of,
        "tokens array<int>")
    return Keys([np.array(r.tokens) for r in sample.collect()], rank_encoder(path, pattern, special=True).n_vocab)


TOKENS = "row long, doc_id long, n long, ids binary, cluster int, first_hash long, second_hash long"


def tokenized(docs: DataFrame, path: str, pattern: str, keys: Keys, end_id: int = 1) -> DataFrame:
    """row (unique), doc_id, n, ids (binary, 16 bits each, or 32 for a larger vocabulary) and the lexical key."""
    names = [x.split()[0] for x in TOKENS.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern, special=True)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            ids = token_ids(encoder, batch.column("text"), end_id)
            rows = np.arange(row, row + len(ids))
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
                *map(pa.array, keys.of(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id"), *columns], names)
            row += len(ids)

    return docs.mapInArrow(of, TOKENS)


def words_of(encoder, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of every word of every document (given by its ids and an end token), equal for equal words, and the document's number."""
    table, begins = token_table(encoder.name)
    sizes, words, owners, done = np.diff(begins), [], [], 0
    most = np.cumsum([len(ids) for ids in documents]) // (SLICE_BYTES // 4) if documents else np.zeros(0, np.int64)
    for part in np.split(np.arange(len(documents)), np.flatnonzero(np.diff(most)) + 1):
        if not len(part):
            continue
        ids = np.concatenate([documents[k][:-1] for k in part.tolist()])
        data, ends = _spread(table, begins[ids], sizes[ids]), np.concatenate([[0], np.cumsum(sizes[ids])])
        first = ends[np.concatenate([[0], np.cumsum([len(documents[k]) - 1 for k in part.tolist()])])]  # bytes before each document
        inside = ~SPACES[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        at = first[first < len(data)]
        opens[at] = inside[at]  # a text's edge bounds a word
        letters = data[inside]
        starts = np.flatnonzero(opens[inside])
        words.append(_binary(letters, np.append(starts, len(letters))))
        owners.append(np.repeat(np.arange(done, done + len(part), dtype=np.int32), np.diff(np.searchsorted(np.flatnonzero(opens), first))))
        done += len(part)
    if not sum(map(len, words)):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    found = pa.chunked_array(words).dictionary_encode()
    del words
    return np.concatenate([x.indices.to_numpy() for x in found.chunks]), np.concatenate(owners)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; sorts them in place."""
    keys.sort()
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.diff(np.append(heads, len(keys)))


class Index:
    """BM25 inverted index of one shard: words and owners are the words of its documents, as any numbers. A word that no second
    document has finds nothing and is left out. The most frequent words' part of the scores comes as products of matrices, for
    `step` documents in a row at once."""

    def __init__(self, words: np.ndarray, owners: np.ndarray, lengths: np.ndarray):
        self.n, self.step, self.blocks = len(lengths), 1, {}
        self.docs = np.arange(self.n)
        keys = owners.astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= pa.array(words).dictionary_encode().indices.to_numpy().view(np.uint32)
        by_doc, times = _runs(keys)
        del keys
        number = (by_doc & np.uint64(0xFFFFFFFF)).astype(np.int64)
        df = np.bincount(number)
        good = df[number] > 1
        by_doc, self.times, self.number = by_doc[good], times[good], (np.cumsum(df > 1) - 1)[number[good]].astype(np.int32)
        df = df[df > 1]
        self.first = np.searchsorted(by_doc, np.arange(self.n + 1, dtype=np.uint64) << np.uint64(32))
        shift = np.uint64(len(by_doc).bit_length())
        at = self.number.astype(np.uint64) << shift
        at |= np.arange(len(at), dtype=np.uint64)
        at.sort()
        at &= (np.uint64(1) << shift) - np.uint64(1)
        self.posting, tf = (by_doc >> np.uint64(32)).astype(np.int32)[at], self.times[at]
        edges = np.cumsum(df) - df
        self.start, self.size = edges, df
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if self.n else 1.0))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.posting])
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[16 * df[often] > self.n]
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        for k, word in enumerate(often.tolist()):
            mine = slice(edges[word], edges[word] + df[word])
            self.dense[k, self.posting[mine]] = self.weight[mine]
        self._cut(self.row[np.repeat(np.arange(len(df)), df)] < 0)

    def _cut(self, good: np.ndarray) -> None:
        """Keep the good postings."""
        total = np.concatenate([[0], np.cumsum(good)])
        stop = total[self.start + self.size]
        self.start = total[self.start]
        self.size = stop - self.start
        self.posting, self.weight = self.posting[good], self.weight[good]

    def keep(self, unused: np.ndarray) -> None:
        """Leave out documents that can't be found any more; the scores of the others stay as they are."""
        good, place = unused[self.docs], (np.cumsum(unused[self.docs]) - 1).astype(np.int32)
        self._cut(good[self.posting])
        self.docs, self.dense, self.posting = self.docs[good], self.dense[:, good], place[self.posting]
        for k, (docs, part) in self.blocks.items():
            self.blocks[k] = docs, part[:, good]

    def _often(self, doc: int) -> np.ndarray:
        """The most frequent words' part of the scores."""
        block = doc // self.step
        docs, part = self.blocks.get(block, (self.docs[:0], None))
        if doc not in docs:
            room = self.step * len(self.docs) * 4 * (len(self.blocks) + 1) <= BLOCK_BYTES
            low, high = (block * self.step, min(self.n, (block + 1) * self.step)) if room else (doc, doc + 1)
            mine = slice(self.first[low], self.first[high])
            rows, times = self.row[self.number[mine]], self.times[mine]
            often = np.flatnonzero(rows >= 0)
            if high - low == 1:
                return times[often].astype(np.float32) @ self.dense[rows[often]]
            asked = np.zeros((high - low, len(self.dense)), np.float32)
            owner = np.repeat(np.arange(high - low), np.diff(self.first[low : high + 1]))
            asked[owner[often], rows[often]] = times[often]
            docs = np.union1d(self.docs[slice(*np.searchsorted(self.docs, [low, high]))], [doc])  # the others were seeds before
            self.blocks[block] = docs, part = docs, asked[docs - low] @ self.dense
        return part[np.searchsorted(docs, doc)]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of `docs` for the whole text of `doc` as the query."""
        mine, times = (x[self.first[doc] : self.first[doc + 1]] for x in (self.number, self.times))
        sizes = self.size[mine]
        rare = np.flatnonzero(sizes)
        starts, sizes = self.start[mine[rare]], sizes[rare]
        if not len(sizes):
            return self._often(doc).astype(np.float64)
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        at += np.arange(len(at))
        weight = self.weight[at]
        weight *= np.repeat(times[rare], sizes)
        return np.bincount(self.posting[at], weight, len(self.docs)) + self._often(doc)


def fill(lengths: np.ndarray, index: Index, window: int, batch: int = 32) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    unused = np.ones(len(lengths), bool)
    if SEEDS * lengths.sum() > window * len(lengths):
        index.step = STEP
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = offset = 0

    def lay(doc: int, start: int, most: int | None = None) -> int:
        """Put `doc` from start on into the open windows; up to `most` ids. Returns the ids laid."""
        nonlocal sequence, offset
        end = lengths[doc] if most is None else min(lengths[doc], start + most)
        at = start
        while at < end:
            n = min(end - at, window - offset)
            pieces.append((doc, at, n, sequence, offset))
            at, offset = at + n, offset + n
            if offset == window:
                sequence, offset = sequence + 1, 0
        return at - start

    scan, seed, done = 0, -1, 0
    while True:
        if seed < 0:
            while scan < len(unused) and not unused[scan]:
                scan += 1
            if scan == len(unused):
                return pieces
            seed, done = scan, 0
            unused[seed] = False
        lay(seed, done)
        rest, split = window - offset, -1
        if offset:
            if 2 * (left := np.count_nonzero(unused)) < len(index.docs) and left:
                index.keep(unused)
            scores = index.scores(seed)
            some, many = np.flatnonzero(unused[index.docs] & (scores > 0)), batch
            while rest and len(some):
                mine = scores[some]
                least = np.partition(mine, len(some) - many)[len(some) - many] if len(some) > many else 0.0
                best, some = some[mine >= least], some[mine < least]  # equal scores stay together
                for doc in index.docs[best[np.argsort(-scores[best], kind="stable")]].tolist():
                    if lengths[doc] <= rest:
                        unused[doc] = False
                        lay(doc, 0)
                        rest -= lengths[doc]
                        if not rest:
                            break
                    elif split < 0:
                        split = doc
                if split >= 0:
                    some = some[lengths[index.docs[some]] <= rest]
                many *= 4
            if rest:
                if split < 0:  # no neighbour is left to cut: the shard's next document
                    while scan < len(unused) and not unused[scan]:
                        scan += 1
                    split = scan if scan < len(unused) else -1
                if split < 0:
                    return pieces
                unused[split] = False
                done = lay(split, 0, rest)
                seed = split if done < lengths[split] else -1
                continue
        seed = -1


def _shards(batches: Iterator[pa.RecordBatch], shard_docs: int | None) -> Iterator[pa.Table]:
    """The partition's rows in tables of bounded size: one, if it is about what it should be."""
    most_docs, most_ids = (2 * shard_docs, 2 * SHARD_IDS) if shard_docs else (math.inf, math.inf)
    held, n_docs, n_ids = [], 0, 0
    for batch in batches:
        for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            n = sum(part.column("n").to_pylist())
            if held and (n_docs + len(part) > most_docs or n_ids + n > most_ids):
                yield pa.Table.from_batches(held)
                held, n_docs, n_ids = [], 0, 0
            held, n_docs, n_ids = [*held, part], n_docs + len(part), n_ids + n
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1, shard_docs: int | None = 4096,
    sample_docs: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ids (array), or with digests ids_crc32."""
    docs = texts(docs, id_col, text_col)
    keys = fitted(docs, path, pattern, end_id, sample_docs)
    table = written(tokenized(docs, path, pattern, keys, end_id), "tokens")
    n_docs, n_ids = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = max(1, -(-n_docs // shard_docs), -(-n_ids // SHARD_IDS)) if shard_docs else 1
    own = "ids_crc32 long" if digests else "ids array<int>"
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", own.split()[0]]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = TaskContext.get().partitionId() << 32
        for group in _shards(batches, shard_docs):
            doc_ids, lengths = group.column("doc_id").combine_chunks(), group.column("n").to_numpy()
            documents = [np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32) for raw,
                n in zip(group.column("ids").to_pylist(), lengths.tolist(), strict=True)]
            index = Index(*words_of(rank_encoder(path, pattern, special=True), documents), lengths.astype(np.float64))
            pieces = np.array(fill(lengths, index, window), np.int64).reshape(-1, 5)
            for k in range(0, len(pieces), 4096):
                doc, start, length, sequence, offset = pieces[k : k + 4096].T
                made = [documents[d][a : a + n] for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                made = [zlib.crc32(ids.astype(np.uint32).tobytes()) for ids in made] if digests else [ids.astype(np.int32) for ids in made]
                columns = [start, length, lengths[doc], sequence + sequences, offset]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *map(pa.array, columns),
                    pa.array(made, pa.int64() if digests else pa.list_(pa.int32()))], names)
            sequences += int(pieces[-1, 3]) + 1

    order = ["cluster", "first_hash", "second_hash", "row"]
    shards = table.repartitionByRange(n_shards, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    return shards.mapInArrow(of, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {own}")
