"""The text operators against brute force on small fixtures with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from orespark.llm.wordhash import BASE, BYTES, mix
from orespark.llm import bpe, common, components, line_dedup, near_dedup, packing, pii, quality, simhash, substring_dedup, url_filter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, part string, kept string"


def words(text):
    return SPACE.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    vocabulary = ["".join(random.choices("abcdeéñß", k=random.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(random.choices(vocabulary, k=n))
    base, shared = make(120).split(), make(60)
    out = [(None, "no id here " + make(30)), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, make(9000)), (7, "x" * 60_000)]
    for i in range(10, 40):
        edited = list(base)
        for _ in range(i % 9):
            edited[random.randrange(len(edited))] = random.choice(vocabulary).upper()
        out.append((i, " ".join(edited)))
    out += [(i, make(30) + "\n" + shared + "\n" + make(20)) for i in range(40, 60)]
    out += [(60, make(50)), (60, make(50)), (61, out[-1][1]), (61, out[-1][1]),
        (62, "a@b.co.uk\nor a.b@c d  +1 (415) 555-0100 and 10.0.0.255 x 300.1.1.1 y 4111 1111 1111 1111 token = \"" + "0a1b2c3d" * 5 + "\" <|endoftext|>end")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s" + str((i or 0) % 2), "clash", "clash") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(got, key=lambda r: tuple(r)):
    return collections.Counter(map(key, got))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q", "http://net", "http://net/", "http://x.org/fr/1#a", "http://org/de/",
        "http://example.com/de/1", "https://é.example.com/de/?", "http://myexample.com/de/", "http://net/", "http://org/fr/",
        "http://.org/fr/", "http://" + "a." * 10_000 + "org/fr/" + "x" * 10_000, "http://" + "a" * 100_000 + ".net", "://" * 30_000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
        host = lowered(host)
        fit = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    for limit in (1 << 20, 0):  # cascade, and the join beyond its size
        got = url_filter.url_filter(pages, rules, max_bits=limit).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    listed, universe = spark.range(0, 3000, 3).selectExpr("cast(id as string) key"), spark.range(3000).selectExpr("cast(id as string) key")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 1 and universe.filter(cascade.holds(universe.key)).exceptAll(listed).count() == 0
    assert universe.filter(cascade.holds(universe.key)).count() == 1000


def test_quality(docs, none, rows):
    got = quality.quality_rules(docs, quality.Trees(base=10.0), keep_columns=["doc_id", "part", "kept"]).collect()

    def stats(text):
        w, t = words(text), text or ""
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))

    assert counted(got, lambda r: (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
        r.n_repeat_words)) == counted([(i, *stats(t)) for i, t in rows])
    assert all(r.part == "clash" and r.kept == (not r.base_failed) for r in got)
    assert quality.quality_rules(none, quality.Trees(base=10.0)).count() == 0
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 3)
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.randn(2000) < 0.7).astype(float)
    trees = quality.fit(x[:1500], y[:1500], [-1, 0, 0])
    assert ((trees.probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.85
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.6)], axis=1)
    assert (np.diff(trees.margin(grid)) <= 1e-9).all()
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, labels).probability(np.zeros((1, 3)))[0] > 0.5


def test_line_dedup(spark, none):
    rows = [(i, f"menu\nown {i}\n \nmenu", "h") for i in range(8)] + [(90, "menu", "h"), (91, None, "h"), (92, "menu\nrare", None),
        (93, "", "g")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(df, ratio=0.5).collect()}
    assert got[3] == ("own 3\n ", 4, 2)
    assert got[90] == ("menu", 1, 0) and got[91] == (None, 0, 0) and got[92] == ("menu\nrare", 2, 0) and got[93] == ("", 1, 0)
    assert line_dedup.line_dedup(none).count() == 0


@pytest.mark.parametrize("least", [common.LEAST_HOT, 3])
def test_near_dedup(docs, none, rows, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_HOT", least)
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = words(lowered(t))
        sets[i].append(frozenset(zip(*(w[k:] for k in range(4)), strict=False)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    got = near_dedup.classes(docs, size=4).collect()
    want = [(i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, ss in sets.items() for s in ss]
    assert counted(got) == counted(want)
    left = near_dedup.dedup(docs, size=4)
    assert left.columns == docs.columns and left.filter("doc_id = 61").count() == 0 and left.filter("doc_id = 60").count() == 2
    assert near_dedup.classes(none).count() == 0


def test_compared_blocks(spark):
    """Blocks of hot groups find what the whole group holds."""
    random.seed(3)
    base = list(range(1, 101))
    rows = []
    for i in range(40):
        s = np.unique(np.array([x if random.random() > 0.06 else random.randrange(1000, 10**9) for x in base], np.uint64))
        rows.append((i.to_bytes(16, "big"), len(s), len(s), [1, 2], [3, 4], i, s.tobytes()))
    rows.append(((99).to_bytes(16, "big"), 100, 100, [1, 2], [3, 4], 99, np.arange(5000, 5100, dtype=np.uint64).tobytes()))
    rest = spark.createDataFrame(rows, "class binary, n long, shared long, left array<long>, right array<long>, at long, set binary")
    made = near_dedup._compared(rest, 80, verify=True, block=7)
    plan = made._jdf.queryExecution().toString()
    assert "hashpartitioning(i#" in plan and re.search(r"Exchange hashpartitioning\(i#\d+, g#\d+L?, u#\d+, v#\d+",
        plan), "each pair of blocks is dealt on its own"
    got = [(bytes(r.x), bytes(r.y)) for r in made.collect()]
    sets = {r[0]: set(np.frombuffer(r[6], np.uint64).tolist()) for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}

    def roots(pairs):
        root = {x: x for x in sets}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {x: new if r == old else r for x, r in root.items()}
        return {frozenset(x for x in sets if root[x] == r) for r in set(root.values())}

    assert {tuple(sorted(p)) for p in got} <= want and roots(got) == roots(want) and len(roots(want)) > 1
    assert len(got) < len(want), "a task doesn't send links between components that it has joined"
    for joined in (0, 30, 41):  # so many of the classes are in one component already
        at = {r[0]: 0 if k < joined else r[5] + 1 for k, r in enumerate(rows)}
        known = [(rows[0][0], r[0]) for r in rows[:joined]]
        some = spark.createDataFrame([(*r[:5], at[r[0]], r[6]) for r in rows], rest.schema)
        got = [(bytes(r.x), bytes(r.y)) for r in near_dedup._compared(some, 80, verify=True, block=7).collect()]
        assert all(at[a] != at[b] for a, b in got) and roots([*known, *got]) == roots([*known, *(p for p in want if at[p[0]] != at[p[1]])])


def test_verified_stars(spark):
    """A star dealt over salts: all links of its centre, whichever end it is, and no other."""
    random.seed(4)
    sets = {k.to_bytes(16, "big"): np.unique(np.array([x if random.random() > 0.003 * k else random.randrange(1000, 10**9) for x in range(100)],
        np.uint64)) for k in range(60)}
    names = sorted(sets)
    pairs = [(min(c, x), max(c, x), c, 59) for c in (names[7], names[40]) for x in names if x != c and {c, x} != {names[7], names[40]}]
    pairs.append((names[7], names[40], names[40], 2))
    table = spark.createDataFrame([(k, v.tobytes()) for k, v in sets.items()], "class binary, set binary")
    made = near_dedup._verified(spark.createDataFrame(pairs, "x binary, y binary, centre binary, k long"), table, 80, block=8)
    got = sorted((bytes(r.x), bytes(r.y)) for r in made.collect())
    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    assert got == sorted((x, y) for x, y, _, _ in pairs if alike(x, y)) and 20 < len(got) < len(pairs)


@pytest.mark.parametrize("least", [common.LEAST_HOT, 3])
def test_keyed(spark, monkeypatch, least):
    """Rows of hot keys meet a broadcast, the others a shuffle; together they are the plain join."""
    monkeypatch.setattr(common, "LEAST_HOT", least)
    rows = spark.createDataFrame([(i % 50 if i < 100 else 7, i) for i in range(300)], "key long, v long")
    table = common.written(rows.groupBy("key").agg(F.count("*").alias("k")), "keys")
    made = common.keyed(rows, table, "key", 300)
    assert counted(made.select("key", "v", "k").collect()) == counted(rows.join(table, "key").select("key", "v", "k").collect())
    assert made.filter("k > 3").count() == 202 and made.count() == 300


@pytest.mark.parametrize("least", [common.LEAST_HOT, 3])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_HOT", least)
    random.seed(5)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)]
    pairs += [(2500, i) for i in range(2000, 2060)] + [(3000, i) for i in range(3001, 3060)]  # stars of the largest and the smallest node
    parent = {x: x for p in pairs for x in p}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_simhash(docs, none, rows, spark):
    got = simhash.compare_with_edits(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, take = order[(k + 1) % len(order)][1], len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - take] + after[:take]).encode()).hexdigest()))
    assert counted(got, lambda r: (r.doc_id, r.n_chars, r.edited_sha256)) == counted(want)
    assert {r.fingerprint for r in got if r.doc_id == 2} == {"0" * 16}
    assert simhash.compare_with_edits(none).count() == 0
    random.seed(4)
    seeds = [random.getrandbits(64) for _ in range(40)]
    values = [s ^ sum(1 << b for b in random.sample(range(64), random.randrange(6))) for s in seeds for _ in range(6)]
    table = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, fingerprint long")
    found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.near_fingerprints(table).collect()}
    assert found == {(a, b) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 3} and found
    for radius, block in ((3, 2048), (3, 4), (5, 16)):  # blocks of a few rows: every bucket is hot
        links = {r.fingerprint % (1 << 64): r.n_links for r in simhash.link_counts(table, radius, radius + 2, block).collect()}
        count = {a: sum(a != b and (a ^ b).bit_count() <= radius for b in set(values)) for a in set(values)}
        assert links == {a: n for a, n in count.items() if n}
    table = table.unionByName(spark.createDataFrame([(None, 5), (None, 5), (1000, 4), (1000, 4), (1001, None)], table.schema))
    got = counted(simhash.near_documents(table).collect())
    every = [(i, v % (1 << 64)) for i, v in enumerate(values)] + [(None, 5), (None, 5), (1000, 4), (1000, 4)]
    first = {}
    for i, v in every:
        if i is not None:
            first[v] = min(i, first.get(v, i))
    count = {a: sum(a != b and (a ^ b).bit_count() <= 3 for _, b in {(0, x) for _, x in every}) for _, a in every}
    assert got == counted([(i, first.get(v), count[v]) for i, v in every] + [(1001, None, 0)])
    assert simhash.near_documents(table.limit(0)).count() == 0


def test_fingerprint_values(docs, rows):
    """Fingerprints and likeness by their definition: signed votes of adjacent word pairs, weighted by length."""

    def hashed(word):
        total, power = 0, 1
        for c in word.encode():
            total, power = (total + int(BYTES[c]) * power) % (1 << 64), power * BASE % (1 << 64)
        return int(mix(np.array([total], np.uint64))[0])

    def fingerprint(text):
        w = [m for m in SPACE.finditer(text)]
        h = [hashed(m[0]) for m in w]
        if len(h) < 2:
            return h[0] if h else 0
        votes = [0.0] * 64
        for a, b, m, n in zip(h, h[1:], w, w[1:], strict=False):
            pair = int(mix(np.array([(a + b * BASE + 2) % (1 << 64)], np.uint64))[0])
            weight = min(64, len(text[m.start() : n.end()].encode()))
            for bit in range(64):
                votes[bit] += weight if pair >> bit & 1 else -weight
        return sum(1 << bit for bit in range(64) if votes[bit] > 0)

    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, take = order[(k + 1) % len(order)][1], len(t) // 4
        a, b, c = map(fingerprint, (t, t[: len(t) - take] + after[:take], after))
        want.append((i, f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    got = simhash.compare_with_edits(docs).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert counted(got.collect()) == counted(want)


def test_packing(docs, none, rows):
    got = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shard_docs=16, digests=True).toPandas()
    tokenizer = bpe.json_tokenizer(P.path("byte_bpe_50k.json"))
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)) for i, t in rows]
    assert got.length.sum() == sum(len(x) for _, x in ids)
    single = {i: x for i, x in ids if i not in (None, 60, 61)}
    for r in got[got.doc_id.isin(list(single))].itertuples():
        x = single[int(r.doc_id)]
        assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert got.groupby(got.sequence_id // 2**32).apply(lambda s: (s.groupby("sequence_id").length.sum() < 2048).sum()).max() <= 1
    assert got.sequence_id.floordiv(2**32).nunique() > 1  # several shards; one shard is the exact search
    exact = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shard_docs=None).toPandas()
    assert exact.sequence_id.max() < 2**32 and exact.length.sum() == got.length.sum() and sum(map(len, exact.ids)) == exact.length.sum()
    assert packing.pack(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing_index(docs):
    """Scores of a shard's index are BM25 over all words of the texts, with their frequencies."""
    docs = docs.selectExpr("doc_id", "coalesce(text, '') text")
    path = P.path("byte_bpe_50k.tiktoken")
    table = packing.tokenized(docs, path, P.PATTERN, packing.fitted(docs, path, P.PATTERN, 1, 20)).orderBy("row").toPandas()
    texts = [words(r.text) for part in docs.rdd.glom().collect() for r in part]
    lengths = table.n.to_numpy().astype(float)
    encoder = bpe.rank_encoder(path, P.PATTERN, special=True)
    index = packing.Index(*packing.words_of(encoder, [np.frombuffer(x, np.uint16) for x in table.ids]), lengths)
    bags, n = [collections.Counter(w) for w in texts], len(texts)
    df = collections.Counter(w for b in bags for w in b)
    assert max(map(len, bags)) > 300 and max(max(b.values()) for b in bags if b) > 20
    norm = packing.K1 * (1 - packing.B + packing.B * lengths / lengths.mean())
    for q in range(n):
        common = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) for w in bags[q]}
        want = [sum(bags[q][w] * i * bags[d][w] * (packing.K1 + 1) / (bags[d][w] + norm[d]) for w,
            i in common.items() if w in bags[d]) for d in range(n)]
        got = index.scores(q)
        assert np.allclose(np.delete(got, q), np.delete(want, q))


def test_packing_fill():
    """A window goes on down the ranking: all unused neighbours that fit, then the best that doesn't."""
    rng = np.random.RandomState(2)
    for few, longest in ((3, 4), (30, 40), (300, 300)):
        terms = [np.unique(rng.randint(few, size=rng.randint(1, 6)).astype(np.uint64)) for _ in range(300)]
        lengths = rng.randint(1, longest, size=300)
        make = lambda: packing.Index(np.concatenate(terms), np.repeat(np.arange(300), [len(t) for t in terms]),
            lengths.astype(float))  # noqa: B023, E731
        index, unused, want, seed, place = make(), set(range(300)), [], None, 0

        while seed is not None or unused:
            if seed is None:
                seed, done = min(unused), 0
                unused.discard(seed)
            want.append((seed, done, lengths[seed] - done))
            place += lengths[seed] - done
            rest, scores, split = -place % 256, index.scores(seed), None
            for doc in sorted(unused, key=lambda d: (-scores[d], d)):  # noqa: B023
                if scores[doc] > 0 and rest:
                    if lengths[doc] <= rest:
                        unused.discard(doc)
                        want.append((doc, 0, lengths[doc]))
                        rest, place = rest - lengths[doc], place + lengths[doc]
                    elif split is None:
                        split = doc
            seed = None
            if rest:
                split = min(unused, default=None) if split is None else split
                if split is None:
                    break
                unused.discard(split)
                part = min(rest, lengths[split])
                want.append((split, 0, part))
                place += part
                seed, done = (split, part) if part < lengths[split] else (None, 0)
        got = [p[:3] for p in packing.fill(lengths, make(), 256)]
        cut = []  # pieces of one document that a window's end divides are one again
        for doc, start, n in got:
            if cut and cut[-1][0] == doc and cut[-1][1] + cut[-1][2] == start and (doc, start) not in {w[:2] for w in want}:
                cut[-1] = (doc, cut[-1][1], cut[-1][2] + n)
            else:
                cut.append((doc, start, n))
        assert cut == want


def test_bpe(docs, none, rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.rank_encoder(path, P.PATTERN)
    got = bpe.encode_documents(docs, path, P.PATTERN).collect()
    assert counted(got, lambda r: (r.doc_id, tuple(r.ids),
        bytes(r.decoded))) == counted([(i, tuple(encoder.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows])
    extra = docs.sparkSession.createDataFrame([(None, None, 1), (70, [], 2), (70, [], 2), (71, [0, 1, 49_000] * 50_000, 3)],
        "doc_id long, ids array<int>, decoded int")
    back = bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN).select("doc_id", "ids").unionByName(extra.drop("decoded")),
        path).collect()
    plain = bpe.byte_table(path)
    assert counted(back, lambda r: (r.doc_id, bytes(r.decoded))) == counted([*((i, (t or "").encode()) for i, t in rows), (None, b""),
        (70, b""), (70, b""), (71, b"".join(plain[i] for i in (0, 1, 49_000)) * 50_000)])
    assert counted(bpe.decode_documents(extra, path).collect(), lambda r: r.doc_id) == counted([None, 70, 70, 71], lambda x: x)
    tokenizer = bpe.json_tokenizer(P.path("byte_bpe_50k.json"))
    counts = bpe.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert counted(counts) == counted([(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i,
        t in rows])
    assert bpe.encode_documents(none, path, P.PATTERN, digests=True).count() == 0 and bpe.token_counts(none, P.path("byte_bpe_50k.json"),
        P.PATTERN).count() == 0


def test_substring_dedup(docs, none, rows):
    first, want = {}, []
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 19):
            key = (i if i is not None else -1, p)
            first[tuple(w[p : p + 20])] = min(first.get(tuple(w[p : p + 20]), key), key)
    for i, t in rows:
        w = words(t)
        gone = {p + k for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] < (i if i is not None else -1, p) for k in range(20)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert counted(substring_dedup.substring_dedup(docs).collect()) == counted(want)
    assert sum(r[2] for r in want) > 500
    assert substring_dedup.substring_dedup(none).count() == 0


def plain_spans(text):
    """The contract's base spans by the plain patterns."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k,
        c in enumerate(d[::-1])) % 10 == 0,
        "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text) if good[k](m[0])]
    return sorted(found, key=lambda s: (s[1], list(kinds).index(s[0])))


def joined(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def added(model, text):
    """All spans, and their number: base ones, and candidates outside them that the classifier accepts."""
    base = plain_spans(text)
    more = [c.span for c in pii.candidates(text, base) if sum(w * x for w, x in zip(model.weights, c.features, strict=True)) >= 0]
    assert all(b <= x or y <= a for _, a, b in more for _, x, y in base)
    every = sorted([*base, *more], key=lambda s: (s[1], pii.KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in every), len(every)


def test_pii(docs, none, rows):
    text = rows[-1][1]
    base = pii.base_spans(text)
    assert [s[0] for s in base] == ["email", "phone", "ip", "card"] and text[base[0][1] : base[0][2]] == "a@b.co.uk"
    model = pii.train(docs)
    (row,) = pii.find(docs, model).filter("doc_id = 62").collect()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and "secret:" in row.spans
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    clean = pii.redact(docs, model)
    assert clean.columns == docs.columns and "<CARD>" in clean.filter("doc_id = 62").collect()[0].text and clean.filter("doc_id = 1").collect()[0].text is None
    assert pii.train(none).weights is None and pii.find(none, pii.Model({}, None)).count() == 0
    random.seed(8)
    for _ in range(5000):
        t = "".join(random.choices("a1@.-+ (9", k=random.randint(1, 30)))
        assert pii.base_spans(t) == plain_spans(t), t
    long = {"1": "1" * 10**6, "-": "-" * 10**6 + "1", "x": "1 " + "x" * 10**6, "@": "a@" * 500_000, ".": "1." * 500_000,
        "+": "+1-" * 300_000, "_": "_1a" * 300_000}
    for t in long.values():  # a quadratic pattern needs hours for these
        began = time.time()
        spans = pii.base_spans(t)
        pii.candidates(t, spans)
        assert time.time() - began < 30 and spans == sorted(spans, key=lambda s: s[1])
    for c, t in long.items():
        assert pii.base_spans(t[:3000]) == plain_spans(t[:3000]), c
    clash = docs.select("doc_id", "text", F.lit("clash").alias("spans"), F.lit(1).alias("n_ip"))
    again = pii.find(clash.unionByName(clash), model).collect()
    assert counted(again) == counted(2 * [(i, *(sum(s[0] == k for s in plain_spans(t or "")) for k in pii.BASE),
        joined(plain_spans(t or "")), *added(model, t or "")) for i, t in rows])
    truth = [random.random() < 0.4 for _ in range(4000)]
    votes = collections.Counter(("secret", tuple((1 if y == (random.random() < r) else -1) for r in (0.9, 0.8, 0.7, 0.6))) for y in truth)
    found, _ = pii.estimate([(k, v, n) for (k, v), n in votes.items()])
    assert all(abs(a - b) < 0.06 for a, b in zip(found["secret"], (0.9, 0.8, 0.7, 0.6), strict=True))


def plain_stats(text):
    """Base statistics and features of a text, by their definitions."""
    w, t = words(text), text or ""
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    dup, symbols, chars = len(lines) - len(set(lines)), sum(t.count(c) for c in "#*$%&|<>"), sum(map(len, w))
    n, c, l = max(1, len(w)), max(1, chars), max(1, len(lines))
    count = lambda among: sum(x in among for x in t)
    upper, digits = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("0123456789")
    features = [np.log1p(len(w)), chars / n, symbols / n, dup / l, len(covered) / n, len(w) / l, count(".!?") / n, len(set(w)) / n,
        upper / c, sum(len(x) <= 3 for x in w) / n, digits / c]
    return (len(w), chars, symbols, dup, len(covered)), features


def plain_kept(text, trees):
    """Base rules, then each tree followed from its root."""
    (n, _, _, _, repeats), x = plain_stats(text)
    margin = trees.base
    for at in trees.roots:
        while trees.feature[at] >= 0:
            at = trees.left[at] + int(x[trees.feature[at]] > trees.threshold[at])
        margin += trees.value[at]
    return n >= 50 and 100 * repeats <= 50 * n and margin >= 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus in the form of the given tables: clean and bad documents, boilerplate lines, near copies, personal data."""
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 8))) for _ in range(3000)]
    make = lambda n: "\n".join(" ".join(random.choices(vocabulary, k=15)) + "." for _ in range(n))
    docs = []
    for i in range(60):
        docs.append((i, make(8) + ("\nhome about contact terms of use" if i % 2 else ""), f"s{i % 3}"))
    docs += [(i, " ".join(random.choices(["###", "|", "$$$", *vocabulary[:6]], k=120)), "s1") for i in range(60, 90)]
    for i in range(90, 100):
        w = docs[3][1].split(" ")
        w[random.randrange(len(w))] = "edited"
        docs.append((i, " ".join(w), f"mirror{i}"))
    docs += [(100, make(6) + "\nmail a.b@c.org or +1 415 555 0100, card 4111 1111 1111 1111, host 10.0.0.1 key = \"sk-" + "0a1B2c3D" * 4 + "\"", "s0"), (101, None, "s0"), (102, "", None), (103, "short", "s0"), (104, make(2500), "s0")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs],
        "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 90)],
        "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_quality_kept(spark, corpus):
    """Which documents the trained trees keep, by a plain walk through their nodes."""
    folder, docs = corpus
    table = spark.read.parquet(f"{folder}/documents.parquet")
    trees = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(trees.roots) > 10
    got = {r.doc_id: r.kept for r in quality.quality_rules(table, trees).collect()}
    assert got == {i: plain_kept(t, trees) for i, t, _ in docs} and set(got.values()) == {True, False}
    twice = table.unionByName(table).withColumns({"_text": F.lit("clash"), "_text_": F.lit("clash")})
    again = quality.train(twice, spark.read.parquet(f"{folder}/labels.parquet"))
    assert (again.threshold == trees.threshold).all() and quality.quality_rules(twice, trees).count() == 2 * len(docs)


def test_pipeline(spark, corpus):
    """Every stage on what the one before kept, against plain versions of the same rules, and run() as a whole."""
    import corpus_pipeline as pipeline

    folder, docs = corpus
    table, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(pipeline.STAGES)
    state = {i: (t, s) for i, t, s in docs}

    def step(name):
        nonlocal table
        out = stages[name](spark, table, folder)
        assert out.columns == pipeline.COLUMNS
        table = out.cache()
        rows = table.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        return {r.doc_id: (r.text, r.source) for r in rows}

    trees = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    want = {i: x for i, x in state.items() if plain_kept(x[0], trees)}
    assert step("quality_rules") == want and 50 < len(want) < len(state)
    hosts = collections.defaultdict(list)
    for t, s in want.values():
        hosts[s].append({x for x in t.split("\n") if words(x)})
    boiler = {s: {x for x in set().union(*pages) if (n := sum(x in p for p in pages)) >= 5 and n > 0.08 * len(pages)} for s,
        pages in hosts.items()}

    def lines(t, s):
        kept = [x for x in t.split("\n") if x not in boiler[s]]
        return "\n".join(kept) if any(map(words, kept)) else t

    want = {i: (lines(t, s), s) for i, (t, s) in want.items()}
    assert step("line_dedup") == want and any(boiler.values())
    sets = {i: set(zip(*(words(lowered(t))[k:] for k in range(5)), strict=False)) for i, (t, _) in want.items()}
    root = {i: i for i in want}
    for a in sorted(want):
        for b in sorted(want):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    want = {i: x for i, x in want.items() if root[i] == i}
    assert step("near_dedup") == want and len({3, *range(90, 100)} & set(want)) == 1  # one of a text and its edits
    model = pii.train(spark.createDataFrame([(i, t) for i, (t, _) in want.items()], "doc_id long, text string"))

    def hidden(t):
        spans, out, end = plain_spans(t), [], 0
        spans = sorted([*spans, *model.added(t, spans)], key=lambda x: (x[1], pii.KINDS.index(x[0])))
        for kind, a, b in spans:
            if a >= end:
                out += [t[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        return "".join([*out, t[end:]])

    want = {i: (hidden(t), s) for i, (t, s) in want.items()}
    assert step("pii") == want and all(k in want[100][0] for k in ("<EMAIL>", "<PHONE>", "<CARD>", "<IP>", "<SECRET>"))
    tokenizer = bpe.json_tokenizer(P.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, (t, _) in want.items()}
    for pieces in (stages["packing"](spark, table, folder).toPandas(), pipeline.run(spark, folder).toPandas()):
        assert {i: g.length.sum() for i, g in pieces.groupby("doc_id")} == {i: len(x) for i, x in ids.items()}
        for r in pieces.itertuples():
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], np.uint32).tobytes()) == r.ids_crc32
        assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_tokens_of_a_whole_table(spark):
    """The rank file and its special token give the ids of the other library's file, over all documents of a table."""
    encoder, tokenizer = bpe.rank_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN,
        special=True), bpe.json_tokenizer(P.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + ["a<|endoftext|>b", "<|endoftext|>" * 3]
    got = packing.token_ids(encoder, texts, 1)
    assert [x.tolist() for x in got] == [[*e.ids, 1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_near_dedup_recall(spark):
    """Planted pairs at similarities from 0.8 on are found; none below."""
    rng = np.random.RandomState(5)
    rows, want = [], set()
    for k in range(200):
        base = [f"w{x}" for x in rng.randint(1 << 40, size=110)]
        other = list(base)
        for at in rng.choice(np.arange(3, 107), 2, replace=False) if k % 2 else [50]:
            other[at] = f"x{rng.randint(1 << 40)}"
        a, b = (set(zip(*(w[j:] for j in range(4)), strict=False)) for w in (base, other))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        if 100 * len(a & b) >= 80 * len(a | b):
            want.add(2 * k)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=4).filter("doc_id <> component_id").collect()
    assert all(r.component_id == r.doc_id - 1 for r in got) and {r.component_id for r in got} <= want
    assert len(want) > 150 and len(got) >= 0.99 * len(want)


def test_edges(spark):
    """Repeated rows, ties, very long texts and empty tables of the operators that no other test covers with them."""
    many = [(i, "menu\nown line " + str(i % 4), "h") for i in range(8)] * 2 + [(90, "x " * 200_000 + "\nmenu", "h")]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    out = line_dedup.line_dedup(df, ratio=0.5).collect()
    assert counted(out, lambda r: (r.doc_id, r.text)) == counted([(i, t.replace("menu\n", "").replace("\nmenu", "")) for i, t, _ in many])
    assert line_dedup.line_dedup(df, ratio=0.01, min_pages=1, spare_whole=False).filter("text <> ''").count() == 0
    rules = spark.createDataFrame([("b.c", "/x", "allow"), ("c", "/xyz", "block"), ("c", "/xyz", "allow")],
        "host string, path string, action string")
    urls = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.b.c/xyz", "http://b.c/x", "http://b.c/xyz"] * 2)],
        "page_id long, url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filter.url_filter(urls, rules).collect()}
    assert got == {"http://a.b.c/xyz": ("b.c/x", "allow"), "http://b.c/x": ("b.c/x", "allow"),
        "http://b.c/xyz": ("b.c/x", "allow")}  # equal lengths: the longer host
    assert url_filter.url_filter(urls, rules.limit(0)).filter("verdict = 'allow'").count() == 6
    clash = spark.createDataFrame([(1, "one two three", "p", 1.0)] * 3, "doc_id long, text string, fingerprint string, near_next double")
    assert counted(simhash.compare_with_edits(clash).collect(), lambda r: (r.doc_id, r.near_next)) == {(1, 1.0): 3}
    tied = packing.pack(spark.createDataFrame([(7, "same words here", "p")] * 40, "doc_id long, text string, ids string"),
        P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shard_docs=8)
    assert tied.count() >= 40 and tied.agg(F.sum("length")).head()[0] == 40 * tied.head().doc_tokens
