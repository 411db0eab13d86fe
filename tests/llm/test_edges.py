"""Odd cases that the other tests lack: null ids, ties, repeated rows, empty tables, very long texts and tokens, clashing columns."""

import itertools
import random

import numpy as np
import pytest
from test_text_operators import plain_components, rows

from quire.llm import licenses, minhash, toxicity, urlfilter, warc
from quire.llm.text import BLANKS, Words


# -- op2 --------------------------------------------------------------------------------------------------------------------


def test_spellings_are_of_whole_words(spark, no_docs):
    texts = ["a per century note", "a percentury note", "super centre", "supercentre", "ten per cent per cent", "ten percent percent", "the copyright\nholders", "The Copyright   Owners!", "sub-license it", "sublicense it"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, license_id string, digest string")
    got = {r.doc_id: r.canonical_sha256 for r in licenses.scan(df).collect()}
    assert got[0] != got[1] and got[2] != got[3] and got[4] == got[5] and got[6] == got[7] and got[8] == got[9]
    assert licenses.scan(no_docs).count() == 0


def test_licences_wrapped_long_null_and_given_as_a_table(spark):
    mit = dict(licenses.TEXTS[:3])["MIT"]
    wrapped = "Copyright (c) 2001 Somebody\n\n" + mit.replace(" ", "\n")
    own = "You may use this for tea. You may not use it for coffee."
    df = spark.createDataFrame([(1, wrapped), (1, wrapped), (None, mit), (2, "word " * 400_000 + "\nAll rights reserved."), (3, None), (4, ""), (5, own.upper()), (6, "© Me")], "doc_id long, text string")
    table = licenses.digest_table(spark.createDataFrame([("Tea", own), ("Zea", own), (None, own), ("Empty", "..."), ("Null", None)], "license_id string, text string"))
    got = sorted(((r.doc_id, r.license_id, r.notices, r.licensed) for r in licenses.scan(df, licenses=table).collect()), key=repr)
    assert got == sorted([(1, "MIT", "", True)] * 2 + [(None, "MIT", "", True), (2, None, "Proprietary", True), (3, None, "", False), (4, None, "", False), (5, "Tea", "", True), (6, None, "", False)], key=repr)


# -- op3 --------------------------------------------------------------------------------------------------------------------


def test_exact_mode_needs_no_bands(docs, texts, monkeypatch):
    """With bands that hardly any two sets share, ``exact`` still finds every link, which the bands alone do not."""
    plain = minhash.signatures
    monkeypatch.setattr(minhash, "sketch", _few_bands(minhash.sketch, plain))
    assert rows(minhash.near_duplicates(docs, exact=True)) == plain_components(texts)
    assert rows(minhash.near_duplicates(docs)) != plain_components(texts)


def _few_bands(sketch, plain):
    from pyspark.sql import functions as F

    def run(docs, id_col, text_col, carry=()):
        out = sketch(docs, id_col, text_col, carry)
        return out.withColumn("bands", F.when(F.col("bands").isNotNull(), F.array(F.xxhash64("set_key"))))

    return run


def test_measured_recall_of_the_bands():
    """Pairs of sets at 0.75 to 0.8, the hardest that count: at most one of 2,000 shares no band."""
    rng = np.random.default_rng(11)
    lost = 0
    for _ in range(2000):
        n = int(rng.integers(20, 120))
        shared = rng.integers(0, 1 << 63, 6 * n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, n, dtype=np.uint64)])) for _ in "ab")
        keys = minhash.signatures([a, b])
        lost += not (keys[0] == keys[1]).any()
    assert lost <= 1


def test_carried_columns_follow_their_rows(docs, texts):
    got = minhash.near_duplicates(docs, carry=["text", "kept"])
    assert {"in_text", "in_kept", "kept"} <= set(got.columns)
    assert sorted(((r.doc_id, r.in_text) for r in got.collect()), key=repr) == sorted(texts, key=repr)


# -- op6 --------------------------------------------------------------------------------------------------------------------


def test_long_hosts_are_judged_and_no_captures_give_none(spark):
    long = ".".join(["part"] * 3000) + ".bad.example.org"
    entries = urlfilter.entry_table(spark, [("2024-01-01", "a", "bad.example.org", "add"), ("2024-01-01", "p", "x.org/a/b", "add")])
    schema = "page_id long, url string, fetched_on string, host string, salt int"
    df = spark.createDataFrame([(1, f"http://{long}/x", "2024-02-01", "h", 1), (2, f"http://{long}/x", "2023-02-01", "h", 1), (None, "http://x.org/a/b/c", "2024-01-01", "h", 1), (3, "http://x.org/" + "a/" * 50_000, "2024-01-01", "h", 1), (4, None, None, "h", 1)], schema)
    got = {(r.page_id, r.blocked, r.lists) for r in urlfilter.evaluate(df, entries).collect()}
    assert got == {(1, True, "a"), (2, False, ""), (None, True, "p"), (3, False, ""), (4, False, "")}
    assert urlfilter.evaluate(spark.createDataFrame([], schema), entries).count() == 0
    assert urlfilter.evaluate(df, entries.limit(0)).filter("blocked").count() == 0


# -- op8 --------------------------------------------------------------------------------------------------------------------


def test_archive_of_long_and_equal_payloads_is_read_by_type(spark, tmp_path):
    long = "<p>" + "long é " * 600_000
    pages = spark.createDataFrame([(3, "u", long), (1, "u", long), (1, "u", long), (None, "u", long), (2, "u", None), (4, "u", "x")], "page_id long, url string, html string")
    warc.archive(pages, f"file://{tmp_path}/w")
    df = warc.archived_pages(spark, f"file://{tmp_path}/w")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in df.collect()), key=repr)
    n = len(long.encode())
    assert got == sorted([(3, n, "revisit", 1), (1, n, "response", None), (1, n, "response", None), (None, n, "revisit", 1), (2, 0, "response", None), (4, 1, "response", None)], key=repr)
    assert len({r.payload_digest for r in df.collect()}) == 3


# -- op10 -------------------------------------------------------------------------------------------------------------------


def model():
    text = b"stupid idiot the cat is nice and warm stone paper " * 40
    return toxicity.CharacterModel(toxicity.trigrams(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), BLANKS).lower))


def test_decoding_takes_the_best_of_all_paths():
    lm, rng = model(), random.Random(1)
    for _ in range(200):
        token = "".join(rng.choice("stupidcan1300$$!*..e@") for _ in range(rng.randint(1, 9)))
        lattice = [toxicity._options(c, len(list(g))) for c, g in itertools.groupby(token)]
        best = None
        for path in itertools.product(*lattice):
            x = y = 0
            total = sum(price for _, price in path)
            for c in "".join(t for t, _ in path):
                z = toxicity._symbol(c)
                total += lm.cost[x][y][z]
                x, y = y, z
            total += lm.cost[x][y][0]
            if best is None or total < best[0] - 1e-9:
                best = (total, "".join(t for t, _ in path))
        assert lm.restore(token) == best[1], token


def test_long_tokens_take_time_in_proportion():
    import time

    lm = model()
    began = time.time()
    assert lm.restore("abc" * 1_700_000) == "abc" * 1_700_000
    assert lm.restore("st0ne" * 100_000) == "stone" * 100_000
    assert time.time() - began < 30
    assert len(toxicity.readings("!@$" * 2000 + "a" + "1" * 9)) <= 4


@pytest.fixture(scope="module")
def toxic(spark):
    rows = [(i, ("the warm cat " if i % 2 else "you stupid idiot ") + f"n{i}", "x", 0.5) for i in range(80)]
    rows += [(None, "you st*pid idiot", "x", 0.1), (None, None, "x", 0.1), (4, "you stupid idiot n4", "x", 0.1), (4, "the warm cat", "x", 0.1), (90, "", "x", 0.1), (91, "stupid" * 700_000 + " 1d10t", "x", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")


def test_toxicity_of_odd_rows(spark, toxic):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80)] + [(None, 1), (4, 1), (4, None), (1000, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(toxic, labels).collect()
    assert len(got) == 86 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert sorted(by[4]) == [0, 1, 1] and sorted(by[None]) == [0, 1] and by[90] == [0] and by[91] == [1]
    assert all(by[i] == [int(i % 2 == 0)] for i in range(80) if i != 4)
    none = toxicity.toxicity(toxic.limit(0), labels)
    assert none.count() == 0
    unlabelled = toxicity.toxicity(toxic, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.0}
