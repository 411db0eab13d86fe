"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, block long, in_lang string"


def sentences(rng, many, words="the of and in that ing tion ent ere ble shore stone river winter garden paper"):
    vocabulary = words.split()
    return " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(many))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    passage = sentences(rng, 60)
    out = []
    for i in range(40):
        out.append((i, sentences(rng, rng.randint(3, 150))))
    for i in range(40, 60):
        out.append((i, sentences(rng, 20) + " " + passage + " " + sentences(rng, rng.randint(1, 20))))
    for i in range(60, 75):
        words = out[5][1].split()
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(1000))
        out.append((i, " ".join(words)))
    out += [(80, out[3][1]), (81, out[3][1]), (82, passage), (83, passage + "x"), (84, "Über Straße ÉLAN naïve 漢字 \U0001f600 " * 12), (85, "ber Straße ÉLAN naïve 漢字 \U0001f600 " * 14)]
    out += [(90, None), (91, ""), (92, "   \n\t "), (93, "one"), (94, "one two"), (95, "12 34 !!"), (96, "a" * 5000), (97, "a" * 49), (98, "ab\x00" * 40), (99, "ab\x00" * 30)]
    out += [(None, out[7][1]), (None, None), (7, out[7][1]), (7, out[8][1]), (100, sentences(rng, 30000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[(i or 0) % 3], f"src{(i or 0) % 2}", len(t or ""), "kept", 1, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
