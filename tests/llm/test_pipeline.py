import random

import pytest

import corpus_pipeline as pipeline
from nightledger.llm.pieces import MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mi", "no") for b in ("la", "ker", "sun", "dor", "vi") for c in ("", "n", "s", "ble", "ing", "ed", "st")]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=rng.randint(9, 25))) for _ in range(n))
    out = [(i, text(rng.randint(3, 12))) for i in range(200)]
    return out, text, rng


def frame(spark, data, source=lambda i: f"s{(i or 0) % 4}"):
    return spark.createDataFrame([(i, t, "en", source(i), None if t is None else len(t)) for i, t in data], SCHEMA)


def test_near_copies_keep_one_of_each_group(spark, rows, tmp_path):
    base, _, rng = rows
    data = list(base) + [(500 + i, base[i][1]) for i in range(20)]
    for i in range(20, 40):
        words = base[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        data.append((500 + i, " ".join(words)))
    data += [(900, ""), (901, None), (902, " "), (None, base[50][1]), (60, base[60][1])]
    left = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, frame(spark, data), "").collect()]
    ids = [i for i, _ in left]
    # a row without an id is known by a hash, which may be the smaller or the larger of the two
    assert sorted(i for i in ids if i is not None and i < 200 and i != 50) == [i for i in range(200) if i != 50]
    assert sum(i in (50, None) for i in ids) == 1
    assert not any(i is not None and 500 <= i < 520 for i in ids) and sum(i is not None and 520 <= i < 540 for i in ids) <= 1
    assert [i for i in ids if i is not None and i >= 900] == [900]
    assert pipeline.drop_near_copies(spark, frame(spark, data).limit(0), "").count() == 0


def test_similar_lines_go_and_rows_stay(spark, rows):
    base, text, _ = rows
    again = base[0][1].split("\n")[0]
    data = [*base[:10], (50, f"{again}\nfresh line of words that nobody wrote"), (51, None), (None, "Alone")]
    out = pipeline.drop_similar_lines(spark, frame(spark, data), "")
    found = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(found) == len(data)
    assert found[50].text == "fresh line of words that nobody wrote" and found[50].n_chars == len(found[50].text)
    assert found[51].text is None and found[None].text == "Alone" and found[3].text == base[3][1]


def test_quality_goes_by_the_classifier(spark, rows, tmp_path):
    base, _, rng = rows
    bad = [(1000 + i, " ".join(f"{w.upper()}!!" for w in t.split())) for i, t in base[:80]]
    docs = frame(spark, [*base, *bad, (2000, None)])
    spark.createDataFrame([(i, 1 if i < 1000 else 0, 0) for i, _ in [*base, *bad]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in pipeline.keep_good(spark, docs, str(tmp_path)).collect()}
    assert len(kept & set(range(200))) >= 198 and len([i for i in kept if 1000 <= i < 2000]) <= 2


def test_mix_takes_rows_up_to_twice(spark, rows):
    base, _, _ = rows
    docs = frame(spark, [*base, (900, ""), (901, None), (None, base[0][1])])
    out = pipeline.mix(spark, docs, "")
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and set(counts.values()) <= {1, 2} and counts[900] == counts[901] == 1
    words = lambda d: sum(len((r.text or "").split()) for r in d.collect())
    assert abs(words(out) / words(docs) - 1.5) < 0.05


@pytest.mark.skipif(not __import__("os").path.exists(MODEL), reason="the model file is not here")
def test_run(spark):
    found = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(pipeline.STAGES) == 5 and found and all(r.round_trip and r.n_ids == len(r.ids) for r in found)


@pytest.mark.parametrize("stage", ["near copies", "mix", "lines"])
def test_stages_keep_clashing_columns_and_empty_tables(spark, rows, stage):
    base, _, _ = rows
    extra = ["taken", "size", "key", "copy", "row", "place", "time", "words", "id", "own_words", "block", "rest"]
    docs = frame(spark, [*base[:12], (3, base[3][1]), (70, None), (71, "")])
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, docs["doc_id"] * 100 + k)
    run = dict(pipeline.STAGES)[stage]
    out = run(spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert found and (stage == "mix" or {r.doc_id for r in found} >= {i for i, _ in base[:12]})  # the mix may take none of a document
    assert all(r[name] == r.doc_id * 100 + k for r in found for k, name in enumerate(extra))
    empty = run(spark, docs.limit(0), "")
    assert empty.columns == docs.columns and empty.count() == 0


@pytest.mark.parametrize("stage", ["near copies", "mix", "lines"])
def test_stages_take_very_long_texts(spark, rows, stage):
    base, _, rng = rows
    long = "\n".join(" ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3000))
    found = {r.doc_id: r.text for r in dict(pipeline.STAGES)[stage](spark, frame(spark, [*base[:5], (800, long), (801, "x" * 300_000)]), "").collect()}
    assert found.get(800, long) == long and (stage == "mix" or set(found) == {0, 1, 2, 3, 4, 800, 801})


def test_first_and_last_stage_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.createDataFrame([], SCHEMA)
    assert pipeline.keep_good(spark, none, str(tmp_path)).count() == 0 and pipeline.to_ids(spark, none, "").count() == 0
