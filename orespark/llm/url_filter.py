"""URL filter by rules held in a Bloom filter cascade (native expressions only).

A rule is (host, path, action). It fits a url whose host is the rule's host or a subdomain of it and whose path starts
with the rule's path; the longest rule (host + path, then host) wins. Every url has a bounded number of candidate keys
(host suffix x prefix of each rule-path length), and a key is a rule or not: set membership, answered by a cascade.
Only the suffixes that have as many labels as some rule's host are built, so that the work is linear in the url.
Level 1 encodes the listed keys; level 2 the false positives of level 1 over all candidate keys of the corpus; level 3 the
listed keys that level 2 wrongly holds; and so on until a level has no false positive. The first level that
does not hold a key decides, exactly for every key of the corpus, so urls are never joined with the rules.
Level 1 takes log2(universe / listed) bits more per key, so that level 2 is about as large as level 1: the cascade
grows with the list, not with the corpus. Its filters go along with every task, so their size is checked before they are
built (max_bits, some 100,000 rules): a longer list goes to an equi-join of the candidate keys, with the same result.

Null urls and urls without "://" have empty host and path and no rule. An empty rule list blocks nothing. Rows keep
their order-free identity: repeated rows stay repeated, extra columns stay (host, path, rule and verdict are replaced). A rule listed
twice with different actions blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hidden, written

#: The contract's rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
WORD_BITS = 32
#: Bits that the filters of a cascade may have in all (0.5 MB).
MAX_BITS = 4 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ?, # or the end)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, labels: list[int], path_lengths: list[int]) -> Column:
    """Array of (key, host length): host suffixes with all prefixes of the lengths that rules have; longest first."""
    lengths = F.array(*[F.lit(n) for n in path_lengths])
    here = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.filter(F.array(*[F.when(here >= n, F.substring_index(host, ".", -n)) for n in labels]), lambda s: s.isNotNull())
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes,
        lambda p: F.struct((-F.length(s) - F.length(p)).alias("size"), (-F.length(s)).alias("hosts"),
        F.concat(s, F.lit("\t"), p).alias("key"), F.concat(s, p).alias("rule")))))
    return F.when(host != "", F.array_sort(pairs)).otherwise(F.array_sort(F.filter(pairs, lambda x: F.lit(False))))


class TooLarge(ValueError):
    """A cascade's filters would be larger than max_bits."""


class Level:
    """One Bloom filter: an array of 32-bit words that grows with its keys only, sent to the rows as a literal."""

    def __init__(self, keys: DataFrame, n_keys: int, bits_per_key: float, salt: int):
        self.bits = max(64, math.ceil(n_keys * bits_per_key))
        self.hashes = max(1, round(bits_per_key * math.log(2)))
        self.salt = salt
        at = F.explode(F.array(*self._places(F.col("key")))).alias("at")
        words = keys.select(at).groupBy(F.floor(F.col("at") / WORD_BITS).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft",
            F.lit(1).cast("long"), (F.col("at") % WORD_BITS).cast("int"))).alias("word"))
        self.words = words.agg(F.map_from_entries(F.collect_list(F.struct("i", "word"))).alias("m")).select(
            F.transform(F.sequence(F.lit(0), F.lit((self.bits - 1) // WORD_BITS)),
            lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0).cast("long"))).alias("words")
        )

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def freeze(self) -> Level:
        """Compute the filter now; it is a bounded array, sent along as a literal."""
        self.literal = self.words.head()[0]
        return self

    def holds(self, key: Column) -> Column:
        words = F.lit([int(x) for x in self.literal])
        tests = [F.getbit(F.element_at(words, F.floor(p / WORD_BITS).cast("int") + 1),
            (p % WORD_BITS).cast("int")) == 1 for p in self._places(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """Exact membership of `listed` among the keys of `universe` (both: one column, key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS, max_levels: int = 40):
        listed = written(listed.select("key").distinct(), "cascade-listed")
        n = listed.count()
        self.levels: list[Level] = []
        if not n:
            return
        size = max(1, universe.agg(F.approx_count_distinct("key")).head()[0])
        # the usual sizing of a filter cascade: false positives of level 1 number about as many as the listed keys
        rate = min(0.5, n * math.sqrt(0.5) / size)
        self.max_bits = max_bits
        self._add(listed, n, -math.log(rate) / math.log(2) ** 2)
        inside, outside = listed, None
        while len(self.levels) < max_levels:
            level = self.levels[-1]
            if outside is None:
                wrong = universe.filter(level.holds(F.col("key"))).distinct().join(listed, "key", "left_anti")
            else:
                wrong = outside.filter(level.holds(F.col("key")))
            wrong = written(wrong, "cascade-level")
            m = wrong.count()
            if not m:
                return
            self._add(wrong, m, 1.0 / math.log(2))
            inside, outside = wrong, inside
        raise RuntimeError("the cascade doesn't end: a hash function that doesn't tell keys apart")

    def _add(self, keys: DataFrame, n: int, bits_per_key: float) -> None:
        if self.bits + n * bits_per_key > self.max_bits:
            raise TooLarge(f"{n} keys of {bits_per_key:.1f} bits")
        self.levels.append(Level(keys, n, bits_per_key, len(self.levels)).freeze())

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def holds(self, key: Column) -> Column:
        """A key in levels 1..i but not in i+1 is listed where i is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """pages with host, path, rule and verdict. rules: columns host, path, action (block or allow).

    Two cascades answer: which keys are listed (over the corpus's keys), and which listed keys block (over the listed
    keys). Where they would be larger than max_bits, the candidate keys are joined with the rules.
    """
    rules = rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("action")).dropna()
    rules = rules.groupBy("host", "path").agg(F.max(F.col("action") == "block").alias("block"))
    rules = rules.withColumn("key", F.concat("host", F.lit("\t"), "path"))
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels")).head()
    host, path = host_path(F.col(f"`{url_col}`"))
    pages = pages.withColumns({"host": host, "path": path})
    if not shape["n"]:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), sorted(shape["labels"]), sorted(shape["lengths"]))
    universe = pages.select("host", "path").distinct().select(F.explode(F.transform(keys, lambda x: x["key"])).alias("key"))
    try:
        listed, blocks = Cascade(rules, universe, max_bits), Cascade(rules.filter("block"), rules.select("key"), max_bits)
    except TooLarge:
        return _joined(pages, rules, keys, default)
    hit, = hidden(pages, "_hit")
    pages = pages.withColumn(hit, F.get(F.filter(keys, lambda x: listed.holds(x["key"])), F.lit(0)))
    action = F.when(blocks.holds(F.col(f"{hit}.key")), "block").otherwise("allow") if blocks.levels else F.lit("allow")
    verdict = F.when(F.col(hit).isNull(), F.lit(default)).otherwise(action)
    return pages.withColumns({"rule": F.col(f"{hit}.rule"), "verdict": verdict}).drop(hit)


def _joined(pages: DataFrame, rules: DataFrame, keys: Column, default: str) -> DataFrame:
    """The way beyond max_bits: an equi-join per distinct (host, path)."""
    places = pages.select("host", "path").distinct()
    hits = places.select("host", "path", F.explode(keys).alias("k")).join(rules.select(F.col("key").alias("_key"), "block"),
        F.col("k.key") == F.col("_key"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct("k.size", "k.hosts", "k.rule", "block")).alias("b"))
    h, p, rule, verdict = hidden(pages, "_host", "_path", "_rule", "_verdict")
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("b.rule").alias(rule), F.when(F.col("b.block"),
        "block").otherwise("allow").alias(verdict))
    joined = pages.join(best, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
    return joined.withColumns({"rule": F.col(rule), "verdict": F.coalesce(verdict, F.lit(default))}).drop(h, p, rule, verdict)
