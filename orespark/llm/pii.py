"""Personal data: fixed base patterns, and further spans found by weak supervision.

Candidates are broad matches (bracketed "at" addresses, digit runs without a plus sign, keys and tokens, and capitalised runs
that a cue or a given name makes a person's, a place of residence or an employer) that no base span covers. Four labelers
vote on each: its exact form (regex), known prefixes and endings (gazetteer), cue words before it
(context), and its mix of characters (shape). Expectation-maximisation over the counts of all vote patterns
of the corpus (at most kinds x 3**4 rows) estimates each labeler's reliability and each candidate's probability; a
logistic span classifier is then trained on those probabilities, on a bounded sample of candidates (max_rows, the
smallest hashes). It sees surface features only, not the votes, except that names come with their cue and gazetteer entry: nothing
in its letters tells a name from another capitalised word. Spans that it accepts are added; base spans always stay.

The gazetteers of names below are short. Lists of any published size are a parameter of train() (`gazetteer`), which the model keeps;
gazetteer() reads them from a table, up to a stated number of entries.

All patterns are linear in the text: a run of characters is entered at its start only and never given back.

Null texts count as empty; repeated rows are judged each on their own; an empty table gives an empty result, a
corpus without candidates adds no spans. Offsets are code points. Overlapping base spans of different kinds all stay. Extra
columns are ignored by find() and stay untouched by redact(), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

Span = tuple[str, int, int]

#: The contract's patterns. Runs that the pattern can't leave earlier are possessive, and a run of digits
#: before dots is entered at its first digit (a match that starts later would have started there).
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
NAMES = ["person", "place", "employer"]
KINDS = [*BASE, "secret", *NAMES]
ORDER = {k: i for i, k in enumerate(KINDS)}
ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: The characters before an @ that belong to an address, read backwards.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")

#: Broad candidates by kind.
CANDIDATES = {
    "email": re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)*"),
    "phone": re.compile(r"(?<![\w.+])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![\w])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}"),
}
#: Exact forms, known prefixes and endings, and cue words of each kind.
FORMS = {
    "email": re.compile(r"\S+ ?[(\[]at[)\]] ?\S+?(?: ?[(\[]dot[)\]] ?|\.)[a-z]{2,6}"),
    "phone": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "secret": re.compile(r"[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{32,64}|[a-z]{2,4}[_-][A-Za-z0-9]{16,}|[A-Za-z0-9/+]{40}"),
}
#: Top-level domains, toll-free and fictional area codes and trunk prefixes, published prefixes of access keys.
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "dev", "app", "io", "ai", "co", "me", "tv", "eu", "de", "fr",
    "es", "it", "nl", "be", "ch", "at", "pl", "pt", "se", "no", "dk", "fi", "ie", "uk", "us", "ca", "mx", "br", "ar", "cl", "au", "nz",
    "jp", "kr", "cn", "in", "sg", "za", "ru", "tr", "gr", "cz"),
    "phone": ("800", "888", "877", "866", "855", "844", "833", "555", "202", "212", "(800", "(888", "(877", "(866", "(555", "(202", "(212",
    "(0", "0"),
    "secret": ("AKIA", "ASIA", "AIza", "ya29", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "pypi-", "sk-",
    "sk_", "pk_", "rk_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "hf_", "dop_v1_", "shpat_", "SK", "key-", "eyJ"),
}
CUES = {"email": re.compile(r"mail|contact|write", re.I), "phone": re.compile(r"tel|phone|call|fax|mobile", re.I),
    "secret": re.compile(r"key|token|secret|passw|pwd|auth|api", re.I)}


#: A run of up to four capitalised words, initials between them allowed.
_CAPITAL = "[A-ZÀ-ÖØ-Þ]"
_REST = r"[^\W\d_]*+(?:['’-][^\W\d_]++)*+"
RUN = re.compile(rf"{_CAPITAL}(?<![\w'’-]{_CAPITAL}){_REST}(?:(?: [A-Z]\.)? {_CAPITAL}{_REST}){{0,3}}+")
#: Titles and cue words at whose end a run begins.
TITLES = r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?"
NAME_CUES = re.compile(rf"(?:(?P<title>{TITLES})|(?<!\w)(?:(?P<person>my name is|name:|dear|signed by|sincerely,|regards,|call me|contact person:)"
    r"|(?P<place>lives? in|living in|resident of|born in|moved to|home address:|city:)"
    r"|(?P<employer>works? (?:for|at)|working (?:for|at)|employed (?:by|at)|employer:)))\s?$", re.I)
#: Frequent given names, large cities, and endings of company names.
GIVEN = frozenset("""Aaron Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anne Anthony Arthur Ashley Barbara
Benjamin Betty Brandon Brenda Brian Carl Carol Carolyn Catherine Charles Christina Christine Christopher Cynthia Daniel David Deborah
Dennis Diane Donald Donna Dorothy Douglas Edward Elizabeth Emily Emma Eric Frances Frank Gary George Gerald Gloria Grace Gregory Hannah
Harold Heather Helen Henry Jack Jacob Jacqueline James Janet Jason Jeffrey Jennifer Jessica Joan John Jonathan Jose Joseph Joshua Joyce
Judith Julia Julie Justin Karen Katherine Kathleen Keith Kelly Kenneth Kevin Kimberly Larry Laura Lauren Lawrence Linda Lisa Margaret
Maria Marie Mark Martha Martin Mary Matthew Megan Melissa Michael Michelle Nancy Nathan Nicholas Nicole Olivia Pamela Patricia Patrick
Paul Peter Philip Rachel Raymond Rebecca Richard Robert Roger Ronald Ruth Ryan Samantha Samuel Sandra Sarah Scott Sharon Sophia Stephanie
Stephen Steven Susan Teresa Theresa Thomas Timothy Victoria Virginia Walter William""".split())
CITIES = frozenset(("Amsterdam", "Athens", "Bangkok", "Barcelona", "Beijing", "Berlin", "Boston", "Brussels", "Buenos Aires", "Cairo",
    "Chicago", "Copenhagen", "Delhi", "Denver", "Dublin", "Hamburg", "Helsinki", "Hong Kong", "Houston", "Istanbul", "Jakarta",
    "Johannesburg", "Lagos", "Lima", "Lisbon", "London", "Los Angeles", "Lyon", "Madrid", "Melbourne", "Mexico City", "Milan", "Montreal",
    "Moscow", "Mumbai", "Munich", "Nairobi", "New York", "Oslo", "Paris", "Philadelphia", "Prague", "Rio de Janeiro", "Rome",
    "San Francisco", "Santiago", "Seattle", "Seoul", "Shanghai", "Singapore", "Stockholm", "Sydney", "Tokyo", "Toronto", "Vienna",
    "Warsaw", "Zurich"))
COMPANY_ENDS = frozenset(("Inc", "Incorporated", "Corp", "Corporation", "Company", "Co", "Ltd", "Limited", "LLC", "LLP", "PLC", "Plc", "AG",
    "GmbH", "SA", "SARL", "SpA", "BV", "NV", "AB", "Oy", "Group", "Holdings", "Bank", "University"))
#: Capitalised words after a cue that name nobody.
NO_NAMES = frozenset(("Sir", "Sirs", "Madam", "All", "Customer", "Customers", "Friend", "Friends", "Team", "Colleagues", "Reader", "Readers",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday",
    "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "The", "This", "That", "It", "I", "We", "You", "He", "She",
    "They", "Yes", "No"))
#: Last words of titles and cues, and those that a run itself begins with.
CUE_ENDS = frozenset(("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora", "is", "name:", "dear",
    "by", "sincerely,", "regards,", "me", "person:", "in", "of", "to", "address:", "city:", "for", "at", "employer:"))
LEADS = frozenset(("Dear", "Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"))
Gazetteer = dict[str, frozenset[str]]
KNOWN: Gazetteer = {"person": GIVEN, "place": CITIES, "employer": frozenset()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, looked for around each @ only."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[max(floor, text.rfind("@", floor, at) + 1) : at]
        m = BASE["email"].match(text, at - n) if (n := LOCAL.match(before[::-1]).end()) else None
        if m:
            yield m.span()
            floor = m.end()
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str) -> list[Span]:
    """The contract's spans by start, then kind."""
    if not ANY.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in BASE["ip"].finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in BASE["card"].finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in BASE["phone"].finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


@dataclass
class Candidate:
    span: Span
    votes: tuple[int, int, int, int]
    features: list[float]


def gazetteer(entries: DataFrame, max_entries: int = 1_000_000) -> Gazetteer:
    """Names by kind (person: given names; place; employer) from a table (kind, name), beside the fixed ones. It goes to every task, so more
    than max_entries distinct rows are an error; other kinds, nulls and empty names are left out."""
    rows = entries.select("kind", F.trim("name").alias("name")).filter(F.col("kind").isin(NAMES) & (F.col("name") != "")).distinct()
    found = rows.limit(max_entries + 1).collect()
    if len(found) > max_entries:
        raise ValueError(f"gazetteer: more than {max_entries} entries")
    return {k: KNOWN[k] | {r["name"] for r in found if r["kind"] == k} for k in NAMES}


def _names(text: str, known: Gazetteer) -> Iterator[Candidate]:
    """Capitalised runs after a title or cue, and those of two words or more that begin with a given name."""
    for m in RUN.finditer(text):
        a = m.start()
        words = m[0].split(" ")
        while len(words) > 1 and words[0] in LEADS:
            a += len(words.pop(0)) + 1
        before = text[max(0, a - 12) : a].split()
        cue = NAME_CUES.search(text, max(0, a - 24), a) if before and before[-1].lower().rstrip(".") in CUE_ENDS else None
        kind = "person" if cue is None or cue.lastgroup == "title" else cue.lastgroup
        if (cue is None and (len(words) < 2 or words[0] not in known["person"])) or words[0] in NO_NAMES:
            continue
        run = text[a : m.end()]
        title = cue is not None and cue.lastgroup == "title"
        if kind == "person":
            listed, form = words[0] in known[kind], len(words) > 1 or title
        elif kind == "place":
            listed, form = run in known[kind] or words[0] in known[kind], len(words) < 4
        else:
            listed = run in known[kind] or words[-1] in COMPANY_ENDS
            form = len(words) > 1 or listed
        entry = int(listed)
        distinct = len(set(words)) == len(words)
        shape = distinct and all(len(w) <= 24 for w in words) and max(map(len, words)) > 2
        votes = (1 if form else -1, entry, 1 if cue else 0, 1 if shape else -1)
        surface = [1.0, len(words) / 4, min(len(run), 64) / 64, float(distinct), float(run.isupper()), float(title), float(cue is not None),
            float(entry)]
        yield Candidate((kind, a, m.end()), votes, _placed(kind, surface))


def candidates(text: str, taken: list[Span], known: Gazetteer = KNOWN) -> list[Candidate]:
    """Candidates that no span in `taken` overlaps, and that don't overlap each other (leftmost, then kind)."""
    found = [(c.span[1], ORDER[c.span[0]], c.span[0], c) for c in _names(text, known)]
    if ANY.search(text):
        found += [(m.start(), ORDER[k], k, m) for k, p in CANDIDATES.items() for m in p.finditer(text) if k != "secret" or _mixed(m[0])]
    taken = sorted(taken, key=lambda s: s[1])
    starts, ends = [s[1] for s in taken], list(accumulate((s[2] for s in taken), max))
    out, last = [], 0
    for a, _, kind, m in sorted(found, key=lambda x: x[:2]):
        b = m.span[2] if kind in NAMES else m.end()
        before = bisect_left(starts, b)
        if a >= last and (not before or ends[before - 1] <= a):
            last = b
            out.append(m if kind in NAMES else _voted(kind, a, b, m[0], text[max(0, a - 32) : a]))
    return out


def _mixed(word: str) -> bool:
    return any(map(str.isdigit, word)) and any(map(str.isalpha, word))


#: Character classes of the surface features.
LETTER_CLASSES = str.maketrans({c: k for k, cs in {"v": "aeiouAEIOU", "c": "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ",
    "0": "123456789"}.items() for c in cs})


#: Numbers of surface features by kind.
FEATURES = dict.fromkeys(CANDIDATES, 10) | dict.fromkeys(NAMES, 8)


def _placed(kind: str, surface: list[float]) -> list[float]:
    """The features of all kinds: zeros but for those of this kind."""
    return [x for k, n in FEATURES.items() for x in (surface if k == kind else [0.0] * n)]


def _voted(kind: str, a: int, b: int, word: str, before: str) -> Candidate:
    digits, uppers, letters = (sum(map(f, word)) for f in (str.isdigit, str.isupper, str.isalpha))
    distinct, n = len(set(word)), len(word)
    form = 1 if FORMS[kind].fullmatch(word) else -1
    if kind == "email":
        known = 1 if word.rsplit(".",
            1)[-1].strip(")] ").lower() in GAZETTEER[kind] or word.rstrip().lower().endswith(GAZETTEER[kind]) else -1
        shape = 1 if digits < n / 2 else -1
    elif kind == "phone":
        known = 1 if word.startswith(GAZETTEER[kind]) else 0
        shape = 1 if 9 <= digits <= 13 else -1
    else:
        known = 1 if word.startswith(GAZETTEER[kind]) else 0
        shape = 1 if digits >= 2 and letters >= 4 and distinct >= 8 else -1
    context = 1 if CUES[kind].search(before) else 0
    kinds = word[:256].translate(LETTER_CLASSES)  # vowels, consonants and digits alike; other characters are themselves
    changes = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / len(kinds)
    surface = [1.0, min(n, 64) / 64, digits / n, uppers / n, min(distinct, 64) / 64, (n - digits - letters) / n,
        kinds.count("v") / len(kinds), changes, float(before[-1:] in ("=", ":", '"', "'")), float(before[-1:].isspace())]
    return Candidate((kind, a, b), (form, known, context, shape), _placed(kind, surface))


@dataclass
class Model:
    """Labeler reliabilities by kind, the span classifier's weights (None: no candidate was seen), and the gazetteer of names."""

    reliability: dict[str, list[float]]
    weights: list[float] | None
    known: Gazetteer = field(default_factory=lambda: KNOWN)

    def added(self, text: str, base: list[Span], threshold: float = 0.5) -> list[Span]:
        if self.weights is None:
            return []
        cut = math.log(threshold / (1 - threshold))
        return [c.span for c in candidates(text, base, self.known) if float(np.dot(self.weights, c.features)) >= cut]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict[str, list[float]], dict[tuple, float]]:
    """EM for one reliability per kind and labeler, from counts of vote patterns; 0 abstains. Returns them and P(personal | pattern).

    Reliabilities stay between 0.55 and 0.99 and start at 0.7: labelers are better than chance, which fixes the labels' sense.
    """
    reliability, posterior = {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        mine = sorted((v, n) for k, v, n in patterns if k == kind)
        votes, counts = np.array([v for v, _ in mine], float), np.array([n for _, n in mine], float)
        r, prior = np.full(votes.shape[1], 0.7), 0.5
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + votes @ np.log(r / (1 - r)))))
            right = np.where(votes > 0, p[:, None], 1 - p[:, None]) * (votes != 0) * counts[:, None]
            r = np.clip((right.sum(0) + 7) / (((votes != 0) * counts[:, None]).sum(0) + 10), 0.55, 0.99)
            prior = float(np.clip((p @ counts + 1) / (counts.sum() + 2), 0.05, 0.95))
        reliability[kind] = r.tolist()
        posterior |= {(kind, tuple(int(x) for x in v)): float(q) for v, q in zip(votes, p, strict=True)}
    return reliability, posterior


def train(docs: DataFrame, text_col: str = "text", max_rows: int = 20_000, known: Gazetteer = KNOWN) -> Model:
    """Reliabilities from all candidates of the corpus; the classifier from at most max_rows of them. known: see gazetteer()."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [c for t in batch.column("text").to_pylist() for c in candidates(t, base_spans(t), known)]
            yield pa.RecordBatch.from_arrays([pa.array([c.span[0] for c in found], pa.string()),
                pa.array([list(c.votes) for c in found], pa.list_(pa.int32())),
                pa.array([c.features for c in found], pa.list_(pa.float64()))], ["kind", "votes", "features"])

    found = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(of,
        "kind string, votes array<int>, features array<double>")
    groups = found.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).persist()
    try:
        patterns = groups.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
        sample = groups.orderBy(F.xxhash64("kind", "votes", "features"), "features").limit(max_rows).collect()
    finally:
        groups.unpersist()
    if not patterns:
        return Model({}, None, known)
    reliability, posterior = estimate([(r.kind, tuple(r.votes), r.n) for r in patterns])
    x = np.array([r.features for r in sample])
    y = np.array([posterior[r.kind, tuple(r.votes)] for r in sample])
    n = np.array([float(r.n) for r in sample])
    w, decay = np.zeros(x.shape[1]), 1e-2 * n.sum() / 100
    for _ in range(30):  # Newton steps of the weighted logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (n * (p - y)) + decay * w)
    return Model(reliability, w.tolist(), known)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base and added) and n_spans of every document."""

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, digests, spans, n_spans = [], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                counts.append([sum(s[0] == k for s in base) for k in BASE])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every = sorted([*base, *model.added(text, base)], key=lambda s: (s[1], ORDER[s[0]]))
                spans.append(_joined(every)), n_spans.append(len(every))
            columns = np.array(counts, np.int64).reshape(-1, len(BASE)).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(digests, pa.string()),
                pa.array(spans, pa.string()), pa.array(n_spans, pa.int64())], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long"
    return texts(docs, id_col, text_col).mapInArrow(of, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span (overlapping ones as one) replaced by its first kind in angle brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced (null stays null)."""

    names = docs.columns
    at = names.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            made = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                made.append(redacted(text, [*base, *model.added(text, base)]) if text else text)
            yield pa.RecordBatch.from_arrays([pa.array(made,
                pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)], names)

    return docs.mapInArrow(of, docs.schema)
