"""Toxicity: what a word needs to be learned is a number of distinct texts, not a part of all toxic ones."""

import random

from quire.llm import toxicity


def test_words_of_a_small_part_of_the_toxic_texts(spark):
    rng = random.Random(4)
    plain = "winter garden stone river paper window silver morning market bridge".split()
    say = lambda *more: " ".join([*(rng.choice(plain) for _ in range(12)), *more])
    # 40 of 3,000 toxic texts, 1.3 %, have only the rare word; a word of one text in 40 copies is not learned
    rows = [(i, say("villain"), 1) for i in range(2920)] + [(i, say("schurke"), 1) for i in range(2920, 2960)]
    copy = say("harmless")
    rows += [(i, copy, 1) for i in range(2960, 3000)] + [(i, say(), 0) for i in range(3000, 9000)]
    new = [(9001, say("schurke"), None), (9002, say("villain"), None), (9003, say("harmless"), None), (9004, say(), None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + new], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect() if r.doc_id > 9000}
    assert got == {9001: 1, 9002: 1, 9003: 0, 9004: 0}
