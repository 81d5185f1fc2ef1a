"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, lexical_search, line_dedup, near_dedup, packing, pii, quality, secrets, simhash, substring_dedup, url_filter
from .common import read_table, written


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of pages by the contract's rules."""
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the trees' verdict on every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, trees, keep_columns=["doc_id"])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents on sets of 4-word shingles."""
    return near_dedup.classes(read_table(spark, sf_dir, "documents"), size=4)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return simhash.compare_with_edits(read_table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of every document's fingerprint within the Hamming radius, by permuted block tables."""
    table = written(simhash.fingerprint_table(read_table(spark, sf_dir, "documents")), "fingerprints")
    return simhash.near_documents(table)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the boilerplate lines of their source: how many went, and the digest of what stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def line_dedup_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 by the ratio alone: hosts of any size, and documents that have nothing but such lines too."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.line_dedup(docs, min_pages=1, spare_whole=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens: one row per piece."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by a rank file: token count and digests."""
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier in the corpus."""
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), digests=True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = bpe.token_counts(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those that the trained classifier adds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, and literals that reach a sensitive name."""
    return secrets.find(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two tokenizers cut into the groups that end together, and how common its links are."""
    files = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN
    aligned = alignment.align(read_table(spark, sf_dir, "documents"), *files)
    return alignment.summarize(aligned, alignment.pair_counts(aligned), alignment.pair_bound(*files))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_lexical_search": op11_lexical_search,
    "op12_secrets": op12_secrets,
    "op13_alignment": op13_alignment,
    "line_dedup_plain": line_dedup_plain,
    "near_fingerprints": near_fingerprints,
}

ORACLES: dict[str, str] = {
    "op11_lexical_search": r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from documents
), docs as (select doc_id, count(*) n from terms group by doc_id),
totals as (select count(*) docs, sum(n)::bigint words from docs),
tfs as (select doc_id, term, count(*) tf from terms group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint w from tfs, totals group by term, docs),
asked as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from benchmark
), needed as (select item_id, term, count(*) times from asked group by item_id, term),
scores as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::bigint score
  from needed join weights using (term) join tfs using (term) join docs using (doc_id), totals
  group by item_id, doc_id
), ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) place from scores where score > 0)
select item_id, place::integer as rank, doc_id, score from ranked where place <= 20
""",
    "op1_url_filter": r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end rest from pages
), h as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') path
  from u
), r(rhost, rpath, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select page_id, host, path, rhost, rpath, action,
         row_number() over (partition by page_id order by length(coalesce(rhost, '')) + length(coalesce(rpath, '')) desc) k
  from h left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rhost || rpath as rule, coalesce(action, 'allow') verdict from m where k = 1
""",
    "op5_line_dedup": r"""
with d as (select doc_id, coalesce(source, chr(0)) host, text, string_split(text, chr(10)) lines from documents),
e as (select doc_id, host, unnest(list_distinct(lines)) line from d),
t as (select host, count(*) pages from d group by host),
b as (
  select host, line from e join t using (host) where regexp_matches(line, '[^ \t\n\v\f\r]')
  group by host, line, pages having count(*) >= 5 and count(*) > pages * cast(0.08 as double)
),
p as (select doc_id, host, text, lines, generate_subscripts(lines, 1) i from d),
q as (select p.doc_id, p.i, p.lines[p.i] line, b.line is null keeps from p left join b on b.host = p.host and b.line = p.lines[p.i]),
r as (
  select doc_id, count(*) n_lines, bool_or(keeps and regexp_matches(line, '[^ \t\n\v\f\r]')) other,
         count(*) filter (not keeps) n, string_agg(line, chr(10) order by i) filter (keeps) rest
  from q group by doc_id
)
select doc_id, n_lines, case when other then n else 0 end n_dropped, sha256(case when other then rest else text end) text_sha256
from r join d using (doc_id)
"""
}
#: The same without the exemptions: no least number of pages, and no document stays whole.
ORACLES["line_dedup_plain"] = r"""
with d as (select doc_id, coalesce(source, chr(0)) host, text, string_split(text, chr(10)) lines from documents),
e as (select doc_id, host, unnest(list_distinct(lines)) line from d),
t as (select host, count(*) pages from d group by host),
b as (
  select host, line from e join t using (host) where regexp_matches(line, '[^ \t\n\v\f\r]')
  group by host, line, pages having count(*) > pages * cast(0.08 as double)
),
p as (select doc_id, host, text, lines, generate_subscripts(lines, 1) i from d),
q as (select p.doc_id, p.i, p.lines[p.i] line, b.line is null keeps from p left join b on b.host = p.host and b.line = p.lines[p.i]),
r as (select doc_id, count(*) n_lines, count(*) filter (not keeps) n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (keeps), '') rest from q group by doc_id)
select doc_id, n_lines, n_dropped, sha256(rest) text_sha256 from r
"""
