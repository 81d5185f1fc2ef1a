"""Documents read mesh by mesh equal documents read whole."""

import json
import random

import pytest

from orespark.operators import mesh


def document(n, seed):
    random.seed(seed)
    blocks = []
    for i in range(n):
        points = [[random.random() for _ in range(3)] for _ in range(random.randint(3, 40))]
        block = {"id": f"m{i}", "name": random.choice(['plain', 'a "quoted" } name', "back\\slash {", "[é] \\\" }", ""]), "vertices": points,
            "triangles": [[0, 1, 2], [0, 2, 99 if i % 7 == 0 else 1]]}
        if i % 3:
            block["attributes"] = {"class": "x}y", "k": "[{"}
        if i % 4:
            block["material"] = {"color": "#fff", "opacity": 0.5}
        items = list(block.items())
        random.shuffle(items)
        blocks.append(dict(items))
    return blocks


@pytest.mark.parametrize("indent", [None, 2])
def test_large_documents(spark, tmp_path, indent):
    first = {"schema_version": "1.0", "meta": {"a": {"b": [{"c": 1}]}, "list": [{"x": 1}, {"y": "]}"}]}, "units": "m", "blocks": document(60, 1)}
    second = {"blocks": document(45, 2), "extra": [{"id": "no mesh"}], "units": "ft", "schema_version": "1.0"}
    third = {"schema_version": "1.0", "units": "m", "blocks": []}
    for k, d in enumerate((first, second, third)):
        (tmp_path / f"d{k}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=bool(indent)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a document in several blocks
        large = mesh.load_large_grade_blocks(spark, str(tmp_path))
        got = sorted((json.dumps(r.asDict(True), sort_keys=True) for r in large.collect()))
        issues = sorted(map(tuple, mesh.validate_grade_blocks(large).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = mesh.load_grade_blocks(spark, str(tmp_path))
    assert got == sorted(json.dumps(r.asDict(True), sort_keys=True) for r in whole.collect()) and len(got) == 105
    assert issues == sorted(map(tuple, mesh.validate_grade_blocks(whole).collect())) and issues


def test_wrong_documents(spark, tmp_path):
    for k, d in enumerate(({"schema_version": "2.0", "blocks": document(2, 3)}, {"schema_version": "1.0"}, {"schema_version": "1.0", "blocks": [{"id": "a"}]})):
        path = tmp_path / f"w{k}"
        path.mkdir()
        (path / "d.json").write_text(json.dumps(d))
        with pytest.raises(ValueError):
            mesh.load_large_grade_blocks(spark, str(path))
