import re

from nightledger.operators import ordered


def test_no_input_row_makes_the_pairs_of_two_lists(spark):
    rows = [(i, f"M  {i % 3}", f"M {i % 3}" if i % 2 else (None, "")[i % 4 // 2]) for i in range(60)] + [(100, "M 9", None), (101, None, None), (102, "x", "M   1")]
    found = ordered.orphan_matches(spark.createDataFrame(rows, "id long, name string, canonical_name string"))
    got = [tuple(r) for r in found.collect()]
    squeezed = lambda c: re.sub(" +", " ", c)
    want = {(i, j) for i, name, own in rows if not own and name for j, _, c in rows if c and i != j and squeezed(name) == squeezed(c)}
    assert set(got) == want and len(got) == len(want) > 0
    # rows that a stage's generated code makes of one input row are all held at once, so the two lists must be taken apart in different stages
    stages = re.findall(r"\*\((\d+)\) Generate explode", found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert len(stages) == len(set(stages)) == 2
