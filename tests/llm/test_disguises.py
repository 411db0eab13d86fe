"""Toxicity: every form of disguise that the table of signs covers reaches the decoder."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import toxicity
from quire.llm.text import BLANKS, Words, chunks

FORMS = {
    "leading sign": "$tupid", "leading sign of a short word": "$cum", "leading stroke": "!diot", "closing sign": "idio+", "both ends": "$tupid!", "quoted": "\"$tupid\"", "noise behind": "$tupid***",
    "noise before": "***1diot", "spaced with a sign first": "$ t u p i d", "spaced with a sign inside": "s h ! t", "spaced with noise behind": "s t u p i d !", "doubled": "stuupid", "doubled twice": "iddiott",
    "one letter left": "1d107", "one letter left and noise": "1d107!", "sign and doubled": "$tuupid",
}
WORDS = {"stupid", "scum", "idiot", "shit"}


@pytest.fixture(scope="module")
def lm():
    rng = random.Random(3)
    plain = "winter garden stone river paper window silver morning letter market bridge".split()
    text = " ".join(rng.choice([*plain, *plain, *sorted(WORDS)]) for _ in range(4000))
    return toxicity.trigrams(np.frombuffer(text.encode(), np.uint8))


def tried(lm, text):
    model = toxicity.Model(np.zeros(0, np.int64), np.zeros(0), 0.0, lm)
    return {x for _, _, data, bounds in chunks(pa.array([text])) for _, token in toxicity.disguised(Words(data, bounds, BLANKS)) for x in model.restored(token)}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_forms_are_restored(lm, form):
    assert tried(lm, f"winter {FORMS[form]} stone") & WORDS


def test_plain_words_are_not_tried(lm):
    assert tried(lm, "winter, stone. (paper) river; 12 34") <= {"paper", "cpaper"}


def test_equal_tokens_count_in_each_document(spark):
    rng = random.Random(2)
    plain = "winter garden stone river paper window silver morning market bridge".split()
    rows = [(i, " ".join([rng.choice(plain) for _ in range(30)] + (["stupid"] if i % 4 == 0 else []))) for i in range(400)]
    odd = [(1000 + i, f"winter {token} stone") for i, token in enumerate(["$tupid", "$tupid", "stuupid", "$ t u p i d", "$tupid!", "stup1d"])]
    fine = [(2000, "winter! $tone"), (2001, "wiinter stoone"), (2002, "$ t o n e"), (2003, "* * * 1 2 3")]
    docs = spark.createDataFrame(rows + odd + fine, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert {i: got[i] for i, _ in odd} == dict.fromkeys([i for i, _ in odd], 1)
    assert {i: got[i] for i, _ in fine} == dict.fromkeys([i for i, _ in fine], 0)
