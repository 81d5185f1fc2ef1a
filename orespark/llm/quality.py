"""Quality rules: statistics of every text, fixed base rules, and gradient-boosted trees over the statistics.

Trees are trained here on a bounded sample of labelled documents (max_rows, the rows with the smallest hash of their
id, so that the sample is the same on every run) and flattened into numpy node arrays; every text is then scored in its
Arrow batch. Chosen features have monotonic constraints: more symbols, repeated lines or repeated words never
raise the score.

Null texts count as empty: all statistics 0, base rules fail, not kept. Without any labelled row of either class the model
accepts what passes the base rules. Repeated rows are judged each on their own; of rows that repeat a labelled id the model
learns from one text (the smallest). Extra columns stay; one that has the name of an added column gives way to it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .wordhash import Words, inside, windows

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees with the sign of the allowed trend (-1: a higher value never raises the score; 0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines_per_line": -1, "repeat_words": -1, "words_per_line": 0,
    "ends_with_stop": 0, "distinct_words": 0, "upper_share": 0, "short_words": 0, "digit_share": 0}


def _bytes(characters: str) -> np.ndarray:
    """A flag for every byte: whether it is one of the (ASCII) characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


def statistics(strings: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's counts of each text, and the matrix of features."""
    words = Words(strings)
    n_words = words.counts
    n = len(n_words)
    doc = np.repeat(np.arange(n), n_words)
    lengths = words.end - words.start
    inner = np.flatnonzero((words.data & 0xC0) == 0x80)  # UTF-8's continuation bytes
    chars = lengths - (np.searchsorted(inner, words.end) - np.searchsorted(inner, words.start))
    per = lambda values: np.bincount(doc, values, n).astype(np.int64)
    at_text = lambda among: np.diff(np.searchsorted(np.flatnonzero(among[words.data]), words.offsets))
    word_chars = per(chars)
    n_symbols = at_text(_bytes(SYMBOLS))
    repeats = np.zeros(len(words.hash), bool)
    at = inside(words.first, 3)
    if len(at):
        keys = windows(words.hash, 3)[at]
        order = np.lexsort((keys, doc[at]))
        a, b = order[:-1], order[1:]
        same = (keys[a] == keys[b]) & (doc[at[a]] == doc[at[b]])
        twice = np.zeros(len(at), bool)
        twice[a[same]] = twice[b[same]] = True
        for k in range(3):
            repeats[at[twice] + k] = True
    n_repeat = per(repeats)
    n_dup, n_lines = _lines(words, n)
    order = np.lexsort((words.hash, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], fresh, n)
    ends, upper, digits = at_text(_bytes(".!?")), at_text(_bytes(string.ascii_uppercase)), at_text(_bytes(string.digits))
    w, c, l = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    features = np.stack([np.log1p(n_words), word_chars / w, n_symbols / w, n_dup / l, n_repeat / w, n_words / l, ends / w, distinct / w,
        upper / c, per(chars <= 3) / w, digits / c], axis=1)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols.astype(np.int64), "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat}, features


def _lines(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and all lines with a word."""
    data, offsets = words.data, words.offsets
    if not len(words.start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, "right") - 1
    nexts = np.concatenate([starts[1:], [len(data)]])
    stops = np.minimum(nexts, offsets[doc + 1])
    stops = np.where((stops > starts) & (data[np.maximum(stops - 1, 0)] == 10), stops - 1, stops)
    has_word = np.searchsorted(words.start, stops) > np.searchsorted(words.start, starts)
    starts, stops, doc = starts[has_word], stops[has_word], doc[has_word]
    raw, seen, dup, last = data.tobytes(), set(), np.zeros(n, np.int64), -1
    for d, a, b in zip(doc.tolist(), starts.tolist(), stops.tolist(), strict=True):
        if d != last:
            seen, last = set(), d
        line = raw[a:b]
        if line in seen:
            dup[d] += 1
        else:
            seen.add(line)
    return dup, np.bincount(doc, minlength=n)


@dataclass
class Trees:
    """Flattened trees: node arrays of all trees one after another; a leaf's feature is -1 and its value is in `value`."""

    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: list[int] = field(default_factory=list)
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f >= 0, self.left[at] + right, at)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    l2: float = 1.0, min_rows: int = 5) -> Trees:
    """Newton boosting of the logistic loss on binned features.

    A split on a constrained feature is allowed only if the two children's values follow its sign; the middle of the two
    bounds all values below them, so that the whole tree, and the sum of trees, is monotonic.
    """
    if len(y) == 0 or y.min() == y.max():
        return Trees(base=10.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    trees = Trees(base=float(np.log(p0 / (1 - p0))), depth=depth)
    feature, threshold, left, value = [], [], [], []
    margin = np.full(len(y), trees.base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-12)
        trees.roots.append(len(feature))
        feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
        todo = [(trees.roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            g, h = grad[rows], hess[rows]
            mine = leaf(g.sum(), h.sum(), low, high)
            best = None
            if level < depth and len(rows) >= 2 * min_rows:
                score = lambda a, b: a * a / (b + l2)
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = len(c) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(binned[rows, j], w, k))[:-1] for w in (g, h, None))
                    gain = score(gs, hs) + score(g.sum() - gs, h.sum() - hs) - score(g.sum(), h.sum())
                    ok = (ns >= min_rows) & (len(rows) - ns >= min_rows)
                    if signs[j]:
                        a, b = np.clip(-gs / (hs + l2), low, high), np.clip(-(g.sum() - gs) / (h.sum() - hs + l2), low, high)
                        ok &= signs[j] * (b - a) >= 0
                    gain = np.where(ok, gain, -1.0)
                    at = int(np.argmax(gain))
                    if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                        best = (gain[at], j, at)
            if best is None:
                value[node] = rate * mine
                margin[rows] += value[node]
                continue
            _, j, at = best
            goes = binned[rows, j] > at
            feature[node], threshold[node], left[node] = j, cuts[j][at], len(feature)
            bounds = [(low, high), (low, high)]
            if signs[j]:
                halves = [leaf(g[m].sum(), h[m].sum(), low, high) for m in (~goes, goes)]
                middle = sum(halves) / 2
                bounds = [(low, middle), (middle, high)] if signs[j] > 0 else [(middle, high), (low, middle)]
            for side, (a, b) in zip((~goes, goes), bounds, strict=True):
                todo.append((len(feature), rows[side], a, b, level + 1))
                feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
    trees.feature, trees.threshold, trees.left, trees.value = np.array(feature, np.int32), np.array(threshold), np.array(left,
        np.int32), np.array(value)
    return trees


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_rows: int = 6000) -> Trees:
    """Trees fitted on at most max_rows labelled documents: a documented bound, for training only. A document with contradicting
    labels is left out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).dropna()
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_high")).filter(F.col("_y") == F.col("_high")).drop("_high")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = F.broadcast(known).join(docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")),
        "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min("text").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("_y")], ["x", "y"])

    found = rows.select("text", "_y").mapInArrow(of, "x array<double>, y double").toArrow()
    if not found.num_rows:
        return Trees(base=10.0)
    x = np.array(found.column("x").to_pylist())
    y = found.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # the same trees whatever order the rows came in
    return fit(x[order], y[order], list(FEATURES.values()))


def quality_rules(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.5,
    keep_columns: list[str] | None = None) -> DataFrame:
    """keep_columns of docs (all by default), with the statistics, score, base_failed and kept."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    keep = [c for c in (docs.columns if keep_columns is None else keep_columns) if c not in own]
    hidden = "_text"  # the text's name inside the tasks
    while hidden in map(str.lower, keep):
        hidden += "_"
    shown = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shown.schema.fields[:-1]), *(f"{c} long" for c in STATS),
        "score double, base_failed boolean, kept boolean"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, hidden):
            stats, x = statistics(batch.column(hidden))
            score = trees.probability(x)
            failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])
            made = [*(pa.array(stats[c], pa.int64()) for c in STATS), pa.array(score), pa.array(failed),
                pa.array(~failed & (score >= threshold))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], [*keep, *own])

    return shown.mapInArrow(of, schema)
