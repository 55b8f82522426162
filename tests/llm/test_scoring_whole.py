import random
import zlib

from nightledger.llm import scoring


def test_scores_do_not_depend_on_the_block(spark, monkeypatch):
    """Tables and weights are learnt from all blocks: one held-out text has one score, whichever block its row falls into."""
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    text = " ".join(rng.choices(words, k=40)) + " neverlearnt"
    rows = [(i, text if i in held else " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(400)]
    found = {r.doc_id: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), table_bits=12).collect()}
    assert len(found) == 400 and len(held) > 40
    for column in ("score", "bits_per_byte"):
        values = [found[i][column] for i in held]
        assert max(values) - min(values) <= 1e-9 * abs(min(values)), (column, min(values), max(values))
