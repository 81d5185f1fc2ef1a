"""Secrets: fixed base patterns, and literals that reach a name which says secret.

The lexer reads assignments of source and configuration syntax: `name = "x"`, `name: x`, `"name": "x"`, `name := x`, `name => x`,
`name["key"] = x`, `a = b = x`, `name: type = x`, `export NAME=x`, `--name x`, `<name>x</name>` and `://user:x@host`. A value is made of quoted
strings, bare words, references to earlier names (`x`, `$x`, `${x}`, `%x%`) and joins of these with + or side by side; a call counts only if it
passes its text on (bytes, b64decode and the like). Every assignment is a node above the literals and earlier nodes that its value
names, so constants are propagated: after the text is read, nodes hand their name's sensitivity down, last to first, and
a literal has the highest of all names it reaches. Its score is that sensitivity plus how random it looks; literals of
1.2 or more are spans of kind `literal`, unless a base span overlaps them.

Reading is linear in the text: a run of name characters is entered at its start only and never given back, and the nodes of a text are as many as
its assignments. All work is on one document at a time, in slices of texts, without a shuffle.

Null texts count as empty; repeated rows are judged each on their own; an empty table gives an empty result; extra columns are
ignored by find() and assignments() and stay untouched by redact(). Offsets are code points. Base spans of different kinds may overlap and all stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

Span = tuple[str, int, int]

#: The contract's patterns. Shorter runs of hex digits would be dropped, and aren't looked at.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "literal"]
ORDER = {k: i for i, k in enumerate(KINDS)}

#: A name and the sign that assigns to it.
TARGET = re.compile(r"""(?<![\w.$-])([A-Za-z_][\w.$-]*+)["'`]?\]?[ \t]{0,8}(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*+""", re.A)
#: Names of options, of elements, and the user part of an address.
OPTION = re.compile(r"(?<![\w-])--([A-Za-z][\w-]*+)[ \t]+(?=[^\s-])", re.A)
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\s]++)</", re.A)
ADDRESS = re.compile(r"://[^\s/:@\"']++:([^\s/:@\"']++)@")
#: Parts of a value.
STRING = re.compile(r"""[rRbBfFuU]{0,2}(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`)""")
REFERENCE = re.compile(r"\$\{([A-Za-z_][\w.]*+)\}|\$([A-Za-z_][\w.]*+)|%([A-Za-z_]\w*+)%|([A-Za-z_][\w.]*+)(?![^\s,;+)\]}.(=])", re.A)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>&=:]++(?:==?(?!\w))?""")
JOIN = re.compile(r"[ \t]*+\+[ \t]*+\n?[ \t]*+|[ \t]++(?=[\"'`])")
CALLS = re.compile(r"(?:[A-Za-z_][\w.]*\.)?(?:bytes|str|String|SecretStr|Secret|b64decode|decodeString|from|encode|Buffer|getBytes|quote)\([ \t]*", re.A)
SCHEME = re.compile(r"(?:Bearer|Basic|Token|token|bearer|basic)[ \t]+")

#: How much a part of a name says that its value is secret; parts that say it is a key to something; parts that say the
#: value only describes it; texts that stand for a value.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.9, "pw": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.95,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "authorization": 0.9, "auth": 0.7, "bearer": 0.9, "cookie": 0.6, "session": 0.5,
    "signature": 0.5, "salt": 0.6, "seed": 0.5, "key": 0.5, "keys": 0.5, "pin": 0.5, "cert": 0.4, "jwt": 0.9, "otp": 0.7, "dsn": 0.6}
KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "storage", "auth", "client", "service", "session",
    "shared", "ssh", "aws", "server", "webhook", "app", "admin"}
DESCRIBES = {"id", "name", "names", "url", "uri", "path", "file", "dir", "length", "len", "size", "count", "type", "field", "label", "hint", "prompt",
    "expires", "expiry", "ttl", "policy", "public", "pub", "limit", "max", "min", "regex", "pattern", "header", "endpoint", "placeholder", "error",
    "message", "title", "text", "description", "version", "algorithm", "format", "index", "column", "table"}
STANDS_FOR = re.compile(r"(?i)x{4,}|\*{3,}|\.{3,}|<[^>]*>|\$\{|\{\{|%\(|changeme|change_me|placeholder|example|sample|dummy|redacted|your[_-]|insert[_-]|^(?:none|null|nil|true|false|undefined|default|required|optional|string|test|todo)$")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A literal's sensitivity and randomness together, from which it is a span.
THRESHOLD = 1.2


@lru_cache(maxsize=10_000)
def sensitivity(name: str) -> float:
    """0 to 1: how much a name says that its value is secret."""
    parts = [p.lower() for p in PARTS.findall(name)]
    own = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if {"key", "keys"} & set(parts) and (KEY_OF & set(parts) or "apikey" in name.lower()):
        own = max(own, 1.0)
    return own * 0.3 if parts and own and (parts[-1] in DESCRIBES or "public" in parts) else own


def randomness(literal: str, quoted: bool) -> float:
    """0 to 1: the literal's entropy in 60 bits; letters of one case count less, and bare words must mix letters and digits. Below 0: never a secret."""
    if len(literal) < 6 or STANDS_FOR.search(literal) or "://" in literal or any(map(str.isspace, literal)):
        return -1.0
    digits, letters = any(map(str.isdigit, literal)), any(map(str.isalpha, literal))
    if not quoted and not (digits and letters):
        return -1.0
    n = len(literal)
    bits = sum(-k * math.log2(k / n) for k in Counter(literal).values())
    plain = literal.isalpha() and (literal.islower() or literal.isupper() or literal.istitle()) or literal.isdigit()
    return min(1.0, bits / 60) * (0.4 if plain else 1.0)


@dataclass
class Node:
    """An assignment: its name, the literals (start, end, quoted) that its value holds, and the earlier nodes it refers to."""

    name: str
    literals: list[tuple[int, int, bool]] = field(default_factory=list)
    sources: list[int] = field(default_factory=list)
    score: float = 0.0


class Lexer:
    """Assignments of one text, in order, with their references resolved."""

    def __init__(self, text: str):
        self.text, self.nodes, self.known = text, [], {}
        names: list[str] = []
        for m in TARGET.finditer(text):
            names.append(m[1])
            if TARGET.match(text, m.end()):  # a = b = x, or name: type = x
                continue
            node = Node(m[1])
            if self.value(m.end(), node) > m.end():
                self.define(names, node)
            names = []
        for p in (OPTION, ELEMENT, ADDRESS) if "--" in text or "</" in text or "://" in text else ():
            for m in p.finditer(text):
                node = Node("password" if p is ADDRESS else m[1])
                if p is OPTION:
                    self.value(m.end(), node)
                else:
                    node.literals.append((*m.span(m.lastindex), False))
                self.nodes.append(node)

    def define(self, names: list[str], node: Node) -> None:
        for name in names:
            self.nodes.append(Node(name, node.literals, node.sources))
            self.known[name.rsplit(".", 1)[-1]] = len(self.nodes) - 1

    def value(self, at: int, node: Node) -> int:
        """Read a value from `at` on into node; where it ends."""
        text = self.text
        if m := SCHEME.match(text, at):
            at = m.end()
        while True:
            if m := CALLS.match(text, at):
                at = m.end()
            if m := STRING.match(text, at):
                inner = m.lastindex
                node.literals.append((*m.span(inner), True))
            elif (m := REFERENCE.match(text, at)) and (source := self.known.get(m[m.lastindex].rsplit(".", 1)[-1])) is not None:
                node.sources.append(source)
            elif (m := BARE.match(text, at)) and not text.startswith("(", m.end()):
                if not node.literals and not node.sources:
                    node.literals.append((*m.span(), False))
                return m.end()
            else:
                return at
            at = m.end()
            if not (m := JOIN.match(text, at)):
                return at
            at = m.end()

    def reached(self) -> dict[tuple[int, int, bool], tuple[float, str]]:
        """For every literal the highest sensitivity of the names that it reaches, and the first such name."""
        best: dict[tuple[int, int, bool], tuple[float, str]] = {}
        said = [n.name for n in self.nodes]
        for i in range(len(self.nodes) - 1, -1, -1):  # nodes refer to earlier ones only
            node = self.nodes[i]
            if (own := sensitivity(node.name)) >= node.score:
                node.score, said[i] = own, node.name
            for s in node.sources:
                if self.nodes[s].score < node.score:
                    self.nodes[s].score, said[s] = node.score, said[i]
            for x in node.literals:
                if x not in best or best[x][0] <= node.score:
                    best[x] = (node.score, said[i])
        return best


def base_spans(text: str) -> list[Span]:
    """The contract's spans by start, then kind."""
    out: list[Span] = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def found_literals(text: str) -> list[tuple[int, int, str, float, float]]:
    """start, end, name, sensitivity and score of each literal of a name-literal pair, in order."""
    if "=" not in text and ":" not in text and "--" not in text and "</" not in text:
        return []
    out = []
    for (a, b, quoted), (own, name) in Lexer(text).reached().items():
        random = randomness(text[a:b], quoted) if own else -1.0
        out.append((a, b, name, own, own + random if random >= 0 else 0.0))
    return sorted(out)


def added_spans(text: str, base: list[Span], threshold: float = THRESHOLD) -> list[Span]:
    """Literals that score enough and that no base span overlaps."""
    starts, ends = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    out, last = [], 0
    for a, b, _, _, score in found_literals(text):
        before = bisect_left(starts, b)
        if score >= threshold and a >= last and (not before or ends[before - 1] <= a):
            out.append(("literal", a, b))
            last = b
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def assignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, literal, name (the most sensitive one that it reaches), sensitivity, score of all name-literal pairs."""
    names = ["doc_id", "start", "end", "literal", "name", "sensitivity", "score"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, a, b, t[a:b], name, own, score) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(),
                strict=True) for a, b, name, own, score in found_literals(t)]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return texts(docs, id_col, text_col).mapInArrow(of, "doc_id long, start long, end long, literal string, name string, sensitivity double, score double")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base and added), n_literal (added) of every document."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                added = added_spans(text, base, threshold)
                every = sorted([*base, *added], key=lambda s: (s[1], ORDER[s[0]])) if added else base
                count = Counter(s[0] for s in base)
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every),
                    len(added)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return texts(docs, id_col, text_col).mapInArrow(of, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span in text_col (overlapping ones as one) replaced by <SECRET>; null stays null."""
    names = docs.columns
    at = names.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, out, end = base_spans(text), [], 0
        for _, a, b in sorted([*base, *added_spans(text, base, threshold)], key=lambda s: s[1]):
            if a >= end:
                out += [text[end:a], "<SECRET>"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            made = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if i == at else batch.column(i) for i in range(batch.num_columns)], names)

    return docs.mapInArrow(of, docs.schema)
