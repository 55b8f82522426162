from itertools import product

import numpy as np
from pyspark.sql import functions as F

from nightledger.llm.chat import SEEN, STATES, Hmm, as_lines, digest, parse_transcripts

CONVERSATIONS = "/root/testdata/sf0.01/conversations.parquet"


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    return Hmm(np.log(rng.dirichlet(np.ones(STATES))), np.log(rng.dirichlet(np.ones(STATES), STATES)), np.log(rng.dirichlet(np.ones(SEEN), STATES)))


def test_decode_is_the_best_path():
    model = random_model()
    seen = np.array([3, 11, 0, 7, 19])
    cost = lambda path: model.first[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(model.shows[s, o] for s, o in zip(path, seen))
    assert tuple(model.decode(seen)) == max(product(range(STATES), repeat=5), key=cost)


def test_divided_transcripts_decode_as_one(spark):
    model = random_model(1)
    rows = [(1, t, 0, "user", "x" * ((t * 37) % 300) + ("?" if t % 3 else "")) for t in range(600)] + [(c, 0, k, None, "hi") for c in range(2, 40) for k in range(3)]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, line int, role string, text string")
    wide = {(r.conv_id, r.turn, r.line): r for r in parse_transcripts(lines, model).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    narrow = {(r.conv_id, r.turn, r.line): r for r in parse_transcripts(lines, model).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert wide == narrow and len(wide) == len(rows)


def test_held_out_roles(spark):
    found = digest(spark.read.parquet(CONVERSATIONS)).where("held_out")
    right, n, most = found.agg(F.avg((F.col("role") == F.col("true_role")).cast("double")), F.count("*"), F.avg((F.col("true_role") == "assistant").cast("double"))).first()
    # three markers in ten are left out, and one transcript in five has none
    assert n > 300 and right > 0.83 and right > most + 0.05, (right, most)


def test_rendering(spark):
    data = [(1, 0, "user", "Is it?\nwell"), (1, 1, "assistant", "yes"), (None, None, None, None)]
    conversations = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    lines = spark.createDataFrame([(1, 0, 0, "user", "User: Is it?"), (1, 0, 1, "user", "well"), (1, 1, 0, "assistant", "Assistant: yes")], "conv_id long, turn long, line int, role string, text string")
    many = as_lines(spark.read.parquet(CONVERSATIONS))
    found = parse_transcripts(lines, Hmm.fitted(many)).orderBy("turn", "line").collect()
    assert "".join(r.rendered for r in found) == "<|user|>\nIs it?\nwell\n<|end|>\n<|assistant|>\nyes\n<|end|>\n"
    assert parse_transcripts(as_lines(conversations), Hmm.fitted(many)).count() == 4
    assert parse_transcripts(lines.limit(0), Hmm.fitted(lines.limit(0))).count() == 0
