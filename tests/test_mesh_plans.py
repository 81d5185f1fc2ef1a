"""Large documents of meshes: a mesh is parsed once, and blocks of a file are placed by themselves."""

import json

from orespark.operators import mesh


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(path, blocks):
    path.mkdir()
    (path / "d.json").write_text(json.dumps({"schema_version": "1.0", "extra": {"a": [{"b": ']}{["'}]}, "blocks": blocks, "units": "m"}))
    return str(path)


def test_meshes_are_parsed_once(spark, tmp_path):
    blocks = [{"id": f"m{i}", "name": '} {" [', "vertices": [[0, 0, 0], [1, 0, 0], [0, 1, i % 2]], "triangles": [[0, 1, 2], [0, 1, 3 if i % 5 == 0 else 1]]} for i in range(40)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        meshes = mesh.load_large_grade_blocks(spark, written(tmp_path / "a", blocks))
        issues = mesh.validate_grade_blocks(meshes)
        assert plan(issues).count("from_json(") == 1
        assert not [x for x in plan(issues).splitlines() if "Window [" in x and "block#" not in x.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0]]
        got = {tuple(r) for r in issues.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"m{i}", "index_out_of_range" if i % 5 == 0 else "zero_area_triangle") for i in range(40)}
    assert [r["units"] for r in meshes.select("units").distinct().collect()] == ["m"]


def test_documents_without_a_mesh(spark, tmp_path):
    assert mesh.load_large_grade_blocks(spark, written(tmp_path / "a", [])).count() == 0
