from nightledger.llm.lines import dedup_lines


def test_words_that_agree_in_36_bits_are_different_lines(spark):
    # the hashes of each of the two pairs of words agree in their lower 36 bits
    rows = [(1, "k180207\nk910630 and"), (2, "k912136\nand k825846"), (3, "k180207\nAND k910630")]
    found = {r.doc_id: (r.n_removed, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (0, rows[0][1]), 2: (0, rows[1][1]), 3: (2, "")}
