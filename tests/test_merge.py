import os

from nightledger.operators import merge
from nightledger.operators.merge import delete_keys, insert_new, replace_rows, table_rows, update_values

KEYS = ["target", "night", "filter"]


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    folder = f"{tmp_path}/table"
    schema = "target string, night date, filter string, seconds double, row long"
    rows = lambda *r: spark.createDataFrame(r, schema).withColumn("night", merge.F.lit("2024-01-01").cast("date"))
    first = rows(*((f"t{k}", None, "L", float(k), k) for k in range(500)))
    assert len(replace_rows(folder, first, KEYS, "row")) > 50
    before = files(folder)
    new = rows(("t7", None, "L", 70.0, 900), ("t7", None, "L", 71.0, 901), ("fresh", None, None, 1.0, 902), ("fresh", None, "", 2.0, 903))
    changed = replace_rows(folder, new, KEYS, "row")
    after = files(folder)
    same = {f for f in before if f.split("part=")[1].split("/")[0] not in changed}
    assert 1 <= len(changed) <= 2 and same and all(after[f] == before[f] for f in same)
    got = {(r.target, r.filter): r.seconds for r in table_rows(spark, folder, first.schema).collect()}
    assert len(got) == 501 and got["t7", "L"] == 71.0 and got["fresh", ""] == 2.0
    assert replace_rows(folder, new, KEYS, "row") == [] and files(folder) == after  # again: nothing moves


def test_inserts_updates_and_deletes(spark, tmp_path):
    folder = f"{tmp_path}/table"
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, 5), (None, 3, None)], "name string, id long, value long")
    insert_new(folder, rows, ["name"], "id")
    assert insert_new(folder, rows.where("name is not null"), ["name"], "id") == []
    insert_new(folder, rows, ["name"], "id")
    read = lambda: sorted(((r.name, r.id, r.value) for r in table_rows(spark, folder, rows.schema).collect()), key=str)
    assert read() == sorted([("a", 1, None), ("b", 2, 5), (None, 3, None), (None, 3, None)], key=str)  # null keys are distinct
    update_values(folder, spark.createDataFrame([("a", None, 9), ("c", 4, None)], "name string, id long, value long"), "name")
    assert read() == sorted([("a", 1, 9), ("b", 2, 5), ("c", 4, None), (None, 3, None), (None, 3, None)], key=str)
    delete_keys(folder, spark.createDataFrame([(None,), ("b",), ("none",)], "name string"), ["name"], rows.schema)
    assert read() == [("a", 1, 9), ("c", 4, None)]
    assert delete_keys(folder, spark.createDataFrame([(None,), ("b",)], "name string"), ["name"], rows.schema) == []
    assert insert_new(folder, rows.limit(0), ["name"], "id") == []
