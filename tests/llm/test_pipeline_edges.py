"""Every stage of the pipeline on unusual rows: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines int, score double, _boiler int, spans string, n_words int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(31)
    make = lambda n: " ".join("".join(random.choices("abcdefghijklm", k=random.randint(2, 8))) for _ in range(n))
    same = make(90)
    rows = [(None, make(80), None, None), (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, same, "en", "s"), (5, same, "en", "s"),
        (6, same + " more words", None, "s"), (7, make(40_000), "en", "t"), (8, "one line\n" + make(70), "en", "t"), (9, make(80) + " a@b.co 10.0.0.1", "en", None)]
    rows += [rows[-1], rows[0]] + [(20 + i, "shared line of all pages\n" + make(60), "en", "u") for i in range(15)]
    path = str(tmp_path_factory.mktemp("edges"))
    table = [(*r, None if r[1] is None else len(r[1]), False, 1, 0.5, 7, "x", 3) for r in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20, 35)] + [(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none.parquet")
    return path


def found(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_on_unusual_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = found(docs)
    kept = stages["quality_rules"](spark, docs, folder)
    assert kept.columns == corpus_pipeline.COLUMNS and {1, 2, 3}.isdisjoint(i for i, _ in found(kept))
    lines = stages["line_dedup"](spark, docs, folder)
    assert lines.columns == corpus_pipeline.COLUMNS and len(found(lines)) == len(before)
    assert (1, None) in found(lines) and (2, "") in found(lines) and all("shared line" not in t for i, t in found(lines) if (i or 0) >= 20)
    near = found(stages["near_dedup"](spark, docs, folder))
    assert [i for i, _ in near if i in (4, 5, 6)] == [4] and [i for i, _ in near].count(9) == 1 and [i for i, _ in near].count(None) == 2
    assert {1, 2, 3, 7} <= {i for i, _ in near}
    private = found(stages["pii"](spark, docs, folder))
    assert len(private) == len(before) and (1, None) in private and sum("<EMAIL>" in (t or "") and "10.0.0.1" not in t for _, t in private) == 2
    pieces = stages["packing"](spark, docs, folder).toPandas()
    assert len(pieces.groupby(["sequence_id"])) == pieces["sequence_id"].max() - pieces["sequence_id"].min() + 1
    assert (pieces[pieces.doc_id == 1]["doc_tokens"] == 1).all() and (pieces[pieces.doc_id == 7]["length"].sum() == pieces[pieces.doc_id == 7]["doc_tokens"].iloc[0])
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_on_no_rows(spark, folder):
    none = spark.read.parquet(f"{folder}/none.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
