"""A training corpus from raw documents: quality rules, line dedup, near-duplicate removal, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows as
Parquet in the shared folder and hands the reread table to the next one. All but the last stage return the columns of
documents; texts that a stage changes get their new length in n_chars.

What every stage does with unusual rows: null lang, source and n_chars stay null (a null source is a host of its own in line
dedup); an empty table gives an empty result; extra columns are left behind, whatever their names; texts of any length are
read whole. Null and empty texts, null ids, ties and repeated rows: see each stage.
"""

from __future__ import annotations

import public_tokenizers as P
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orespark.llm import line_dedup, near_dedup, packing, pii, quality
from orespark.llm.common import read_table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep.

    A null or empty text has too few words, so it goes; null ids stay. Repeated rows are judged alike: all stay or all go. A text
    of a million words is judged like any other.
    """
    trees = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, trees).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source.

    A null text stays null, an empty one empty; null ids and repeated rows stay, each counted as a page. A line exactly at the ratio
    stays. A document that has boilerplate lines only stays whole.
    """
    return _columns(line_dedup.line_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (one row of it).

    Documents with null ids, and those without a word, are near to nothing and stay; of rows that repeat an id and text one
    stays. Two documents at exactly the similarity are near.
    """
    return near_dedup.dedup(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    A null text stays null; repeated rows and null ids stay, each rewritten alike. Overlapping spans are replaced as one.
    """
    return _columns(pii.redact(docs, pii.train(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null text counts as empty: one piece, its end id. Repeated rows and null ids are documents of their own; a long text is cut into
    as many pieces as it needs. Ties between neighbours go to the smaller id.
    """
    return packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("pii", pii_stage),
    ("packing", packing_stage)]

#: SQL can't express trees, the classifier, or packing; test_pipeline compares every stage and run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Once its rows are stored, common.clear_written() deletes the tables in between.

    Every case above holds along the way: null and empty texts go with the first stage, so packing sees none of them; a corpus of
    which nothing is kept gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
