"""Every stage of the pipeline, on its own input, against a plain version: repeated ids, nulls, empty and long texts, no rows."""

import hashlib

import numpy as np
import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F
from test_text_operators import encoder, plain_contamination, plain_repeats, shingle_set  # noqa: F401

import corpus_pipeline as pipeline
from quire.llm import langid
from quire.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def cases(texts):
    """The odd documents, and ids that several texts share: 5 is a copy of 1 and another text as well."""
    backwards = lambda k: " ".join(reversed(texts[k][1].split()))
    long, other = backwards(16), backwards(17)
    rows = [*texts, (201, long), (205, long), (205, other + " with an ending"), (205, other + " with an ending"), (206, "Stone RIVER\x1cwinter")]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def frame(spark, cases):
    return spark.createDataFrame(cases, SCHEMA).repartition(4).cache()


def rows(df):
    assert df.columns == pipeline.COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language_id(spark, cases, frame):
    net = langid.train(langid.sample_spans(frame, "doc_id", "text", "lang"))
    got = rows(pipeline.language_id(spark, frame, SF_DIR))
    want = [(i, t, "en", s, n) for i, t, _, s, n in cases if t and any(map(str.isalpha, t))]
    assert net.langs == ["en"] and got == sorted(want, key=repr)
    bare = frame.withColumn("lang", F.lit(None).cast("string"))
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in cases if t and any(map(str.isalpha, t))]
    assert rows(pipeline.language_id(spark, bare, SF_DIR)) == sorted(unlabelled, key=repr), "without labels nothing is rejected but texts without letters"


def test_language_id_takes_the_prediction(spark):
    words = {"aa": "abc bca cab acb", "zz": "xyz zyx yzx xzy"}
    docs = spark.createDataFrame([(i, " ".join([words[lang]] * (1 + i % 5)), lang if i % 4 else None, "s", 1) for i in range(200) for lang in [("aa", "zz")[i % 2]]], SCHEMA)
    got = pipeline.language_id(spark, docs, SF_DIR).collect()
    assert len(got) == 200 and all(r.lang == ("aa", "zz")[r.doc_id % 2] for r in got)


def test_near_duplicates(spark, cases, frame):
    order = [(float("inf") if i is None else i) for i, *_ in cases]
    sets = [shingle_set(t) for _, t, *_ in cases]
    group = list(range(len(cases)))
    for a in range(len(cases)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min(order[k] for k in range(len(cases)) if group[k] == g) for g in group}
    want = [c for k, c in enumerate(cases) if not sets[k] or order[k] == least[group[k]]]
    got = rows(pipeline.near_duplicates(spark, frame, SF_DIR))
    assert got == sorted(want, key=repr)
    assert [r[1][-9:] for r in got if r[0] == 205] == ["an ending"] * 2, "the copy of 201 is gone, the other text of its id is not"


def test_repeated_passages(spark, cases, frame):
    plain = plain_repeats([(i, t) for i, t, *_ in cases])
    want = sorted((i, kept.decode("utf-8", "ignore")) for i, n, *_, kept in plain if i is not None and (n == 0 or kept.decode("utf-8", "ignore")))
    got = rows(pipeline.repeated_passages(spark, frame, SF_DIR))
    assert sorted((r[0], r[1]) for r in got if r[0] is not None) == want
    assert all(r[4] == len(r[1]) for r in got)
    assert {(r[0], r[2], r[3]) for r in got} <= {(c[0], c[2], c[3]) for c in cases}


def test_decontamination(spark, cases, frame):
    items = [(r.item_id, r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    extra = [(900, items[0][1], None, "s", 1), (901, "x " + items[3][1].upper(), None, "s", 1)]
    docs = frame.unionByName(spark.createDataFrame(extra, SCHEMA))
    bad = {i for i, *_, hit in plain_contamination([(c[0], c[1]) for c in [*cases, *extra]], items) if hit}
    got = rows(pipeline.decontamination(spark, docs, SF_DIR))
    assert got == sorted((c for c in cases if c[0] not in bad), key=repr) and {900, 901} <= bad


def test_byte_bpe(spark, cases, frame, encoder):  # noqa: F811
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := encoder.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()), ids, lang) for i, t, lang, *_ in cases]
    got = pipeline.byte_bpe(spark, frame, SF_DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "lang").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_no_documents(spark, name):
    none = spark.createDataFrame([], SCHEMA)
    assert dict(pipeline.STAGES)[name](spark, none, SF_DIR).count() == 0


def test_pooling_is_the_mean_over_positions():
    """A text's distribution against a forward pass of one byte after the other."""
    rng = np.random.default_rng(3)
    net = langid.start(["a", "b", "c"], 4, rng)
    texts = [b"", b"q", b"some bytes", bytes(rng.integers(0, 256, langid.SEGMENT, dtype=np.uint8)), bytes(rng.integers(0, 256, 150, dtype=np.uint8))]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.Reader(net).pool(data, bounds)
    sig = lambda x: 1 / (1 + np.exp(-x))
    hidden = 4

    def cell(d, x, h):
        a, v = net.w[f"u{d}"] @ h, net.w[f"x{d}"][:, x]
        r, z = sig(v[:hidden] + a[:hidden]), sig(v[hidden : 2 * hidden] + a[hidden : 2 * hidden])
        n = np.tanh(v[2 * hidden :] + r * (a[2 * hidden :] + net.w[f"c{d}"][:, 0]))
        return (1 - z) * n + z * h

    def distributions(segment):
        padded = segment.ljust(langid.SEGMENT)
        f, b, fs, bs = np.zeros(hidden), np.zeros(hidden), [], []
        for x in padded:
            f = cell("f", x, f)
            fs.append(f)
        for x in reversed(padded):
            b = cell("b", x, b)
            bs.append(b)
        e = [np.exp(net.w["o"] @ np.r_[x, y] + net.w["q"][:, 0]) for x, y in zip(fs, reversed(bs))]
        return [x / x.sum() for x in e]

    for k, t in enumerate(texts):
        n, size = len(t), langid.SEGMENT
        at = list(range(0, n, size))
        if n > size:
            at[-1] = n - size
        found, done = [], 0
        for a in at:
            segment = t[a : a + size]
            found += distributions(segment)[done - a : len(segment)]
            done = a + len(segment)
        want = np.mean(found, axis=0) if found else np.zeros(3)
        assert np.allclose(got[k], want, atol=1e-4)
