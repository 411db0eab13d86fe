"""Language ID and toxicity by held-out cases, licences, URL lists and archives by plain versions, and the pipeline's stages."""

import datetime
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle import SF_DIR, same

from quire.llm import langid, licenses, queries, toxicity, urlfilter, warc
from quire.llm.text import BLANKS, Words, chunks
from quire.session import table

LETTERS = {"aa": "abcde", "zz": "vwxyz"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    word = lambda lang: "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(3, 60))), lang if i % 7 else None) for i in range(200) for lang in [("aa", "zz")[i % 2]]]
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "12 34 !!", "zz"), (303, "١²Ⅷ", "aa"), (None, "abcde " * 40, "aa"), (5, "vwx " * 5000, "zz")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# -- op5 --------------------------------------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.start(["a", "b", "c"], 3, rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    seq, label = rng.integers(97, 110, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, g = langid.gradients(net, seq, label)
    for name, at in [("xf", (2, int(seq[3, 1]))), ("xb", (7, int(seq[0, 2]))), ("uf", (4, 1)), ("ub", (8, 2)), ("cf", (1, 0)), ("cb", (2, 0)), ("o", (1, 4)), ("q", (2, 0))]:
        kept, step = net.w[name][at], 1e-3
        net.w[name][at] = kept + step
        up = langid.gradients(net, seq, label)[0]
        net.w[name][at] = kept - step
        down = langid.gradients(net, seq, label)[0]
        net.w[name][at] = kept
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 * max(1, abs(g[name][at]) * 10), name


def test_every_byte_counts_once():
    net = langid.start(["a", "b"], 4, np.random.default_rng(3))
    reader = langid.Reader(net)
    for size in (1, 63, 64, 65, 130, 200):
        data = np.random.default_rng(size).integers(97, 120, size).astype(np.uint8)
        p = reader.pool(data, np.array([0, size]))[0]
        assert abs(p.sum() - 1) < 1e-4
    one = np.full(64, 97, np.uint8)
    assert np.allclose(reader.pool(one, np.array([0, 64]))[0], reader.positions(one[:, None])[:, :, 0].mean(axis=0), atol=1e-5)


def test_languages(spark, labelled):
    got = {}
    for r in langid.identify(labelled).collect():
        got.setdefault(r.doc_id, []).append(r)
    right = [got[i][0].lang_pred == ("aa", "zz")[i % 2] for i in range(200) if i != 5 and len(got[i]) == 1]
    assert np.mean(right) > 0.97
    assert all(got[i][0].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(200))
    assert [got[i][0].lang_pred for i in (300, 301, 302, 303)] == ["und"] * 4 and got[300][0].score == 0
    assert got[None][0].lang_pred == "aa" and not got[None][0].held_out and len(got[5]) == 2
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)


def test_no_language_to_learn(spark, no_docs):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(no_docs, carry=["kept"]).count() == 0


# -- op10 -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    plain = "winter garden stone river paper window silver morning letter market bridge".split()
    bad = ["villain", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(i % 4 == 0)))
    hidden = {1000: "winter v1ll4in stone", 1001: "river r-o-t-t-e-n paper", 1002: "silver n a s t y morning", 1003: "letter naaaasty market", 1004: "a r0773n bridge"}
    clean = {1100: "winter gard3n st0ne", 1101: "r-i-v-e-r paper", 1102: "s i l v e r", 1103: "letterrrr mark3t", 1104: None, 1105: ""}
    docs = spark.createDataFrame(rows + list((hidden | clean).items()), "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (4, None), (4, 1), (None, 1)], "doc_id long, toxic int"), hidden, clean


def test_toxicity(judged):
    docs, labels, hidden, clean = judged
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert {i: got[i].predicted for i in hidden} == dict.fromkeys(hidden, 1)
    assert {i: got[i].predicted for i in clean} == dict.fromkeys(clean, 0)


def test_held_out_labels_are_not_read(spark, judged):
    docs, labels, _, _ = judged
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda x: {r.doc_id: round(r.score, 12) for r in toxicity.toxicity(docs, x).collect()}
    a, b = scores(labels), scores(flipped)
    # the rate without features is a rate over labels outside the fold as well
    assert a == b


def test_no_labels(spark, judged, no_docs):
    docs, labels, _, _ = judged
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_character_counts_cover_everything(spark):
    texts = ["abc abd", "  b!!", None, "é1a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for b in [df.select("text").coalesce(1).toArrow()]:
        for _, _, data, bounds in chunks(b.column(0)):
            want += toxicity.trigrams(Words(data, bounds, BLANKS).lower)
    got = toxicity.character_counts(df.coalesce(1), "text")
    assert got.sum() > 0 and (got == want).all()


# -- op2 --------------------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    full = licenses.TEXTS[0][1]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + full.upper()), (2, full.replace("sublicense", "sublicence").replace(",", " ;")), (3, full + " More."), (4, "text\n\n* Released under the MIT licence *\nmore"),
        (5, "All rights reserved\nLicensed under CC BY-NC 4.0"), (6, None), (7, ""), (8, "© 2001 A\n(c) B\nCopyright C"), (1, "no licence"), (None, mit),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.license_id, r.notices, r.licensed) for r in licenses.scan(df).collect()), key=repr)
    want = [(1, "MIT", "", True), (2, "MIT", "", True), (3, None, "", False), (4, None, "MIT", True), (5, None, "CC-BY-NC-4.0,Proprietary", True), (6, None, "", False), (7, None, "", False), (8, None, "", False), (1, None, "", False), (None, "MIT", "MIT", True)]
    assert got == sorted(want, key=repr)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.canonical_sha256 for r in licenses.scan(df).filter("doc_id in (6, 7, 8)").collect()} == {empty}


# -- op6 --------------------------------------------------------------------------------------------------------------------


def plain_blocked(url, day, entries):
    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*(/[^?#]*)?", (url or "").lower())
    if not m or day is None:
        return []
    host, path = m[1].rstrip("."), (m[2] or "") + "/"
    lists = []
    for name, pattern in sorted({(n, p) for _, n, p, _ in entries}):
        state = None
        for d, n, p, action in sorted(entries, key=lambda e: (e[0], e[3])):
            if (n, p) == (name, pattern) and d <= str(day):
                state = action
        h, _, prefix = pattern.partition("/")
        inside = (host == h and path.startswith(f"/{prefix}/")) if prefix else (host == h or host.endswith("." + h))
        if state == "add" and inside:
            lists.append(name)
    return sorted(lists)


def test_url_lists(spark):
    entries = [("2024-01-01", "a", "bad.example", "add"), ("2024-02-01", "a", "bad.example", "remove"), ("2024-03-01", "a", "bad.example", "add"), ("2024-01-15", "b", "ok.example/ads/x", "add"), ("2024-01-01", "c", "example", "add"), ("2024-01-01", "c", "example", "remove"), ("2024-01-01", "d", "www.bad.example", "add"), ("2024-01-01", "d", "www.bad.example", "add")]
    urls = ["http://bad.example/", "https://www.BAD.example:8080/x", "http://user:p@bad.example", "http://notbad.example", "http://ok.example/ads/x/1?q", "http://ok.example/ads/xy", "http://ok.example/ADS/x", "bad.example", "", None, "http://" + "a." * 200 + "bad.example/", "http://bad.example./a"]
    days = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 31), datetime.date(2024, 2, 1), datetime.date(2024, 3, 2), None]
    rows = [(i * 10 + k if url else None, url, day, "x") for i, url in enumerate(urls) for k, day in enumerate(days)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, pattern string")
    got = sorted(((r.page_id, str(r.fetched_on), r.lists, r.n_entries, r.blocked) for r in urlfilter.evaluate(df, urlfilter.entry_table(spark, entries)).collect()), key=repr)
    want = []
    for p, url, day, _ in rows:
        lists = plain_blocked(url, day, entries)
        want.append((p, str(day), ",".join(sorted(set(lists))), len(lists), bool(lists)))
    assert got == sorted(want, key=repr)


# -- op8 --------------------------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    same_page, short = "é" * 60, "x" * 99
    rows = [(3, "http://a/\r\nX: y", same_page), (1, None, same_page), (2, "http://b", same_page), (4, "u", short), (5, "u", short), (6, "u", None), (7, "u", ""), (None, "u", same_page), (1, "u", same_page), (8, "https://c", "y" * 300000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, salt string").repartition(3)
    folder = f"file://{tmp_path}/w"
    warc.archive(df, folder)
    got = sorted((tuple(r) for r in warc.page_records(warc.read(spark, folder)).collect()), key=repr)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = html == same_page and i != 1
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=repr)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("*.warc.gz"))
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(rows)
    revisits = warc.read(spark, folder, payload="none").filter("record_type = 'revisit' and target_uri like 'http%'")
    assert not re.search(r"\bFilter \(", revisits._jdf.queryExecution().executedPlan().toString())
    assert {r.record_id for r in revisits.collect()} == {"<urn:page:3>", "<urn:page:2>"} and revisits.filter("payload is not null").count() == 0
    with pytest.raises(Exception, match="overwrite"):
        df.select(df.page_id.cast("string").alias("record_id")).write.format("warc").mode("append").save(folder)


def test_skipped_payloads_are_not_inflated(monkeypatch):
    import io

    good = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>"}, b"x" * 300000)
    other = warc.record({"WARC-Type": "revisit", "WARC-Record-ID": "<b>"}, b"")
    read = []
    inflate = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self: read.append(1) or inflate(self))
    test = [("record_type", lambda v: v == "revisit")]
    found = list(warc.scan(io.BytesIO(good + other), 0, None, test, True))
    assert [h["warc-record-id"] for h, _, _ in found] == ["<b>"] and len(read) < 6


def test_plain_and_foreign_archives(spark, tmp_path):
    raw = b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, len(body), body) for i, (kind, body) in enumerate([(b"warcinfo", b"a"), (b"response", b"bb" * 70000), (b"response", b"")]))
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw.split(b"\r\n\r\nWARC")[0] + b"\r\n\r\n"))
    got = warc.read(spark, f"file://{tmp_path}").filter("record_type in ('response', 'warcinfo')").collect()
    assert sorted((r.record_type, r.payload_length) for r in got) == [("response", 0), ("response", 140000), ("warcinfo", 1), ("warcinfo", 1)]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(none, f"file://{tmp_path}/e")
    assert warc.page_records(warc.read(spark, f"file://{tmp_path}/e")).count() == 0


# -- registered queries and the pipeline ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    if name in queries.ORACLES:
        assert (what := same(df, con, queries.ORACLES[name])) is None, what
    else:
        source = "pages" if name.startswith("op8") else "documents"
        assert df.count() == table(spark, SF_DIR, source).count()


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as pipeline

    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, SF_DIR).cache()
        assert kept.columns == pipeline.COLUMNS, name
        assert kept.count() <= before.count()
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {90, 91, 92, 95}, "texts without letters go"
    assert not ids & {80, 81}, "copies go"
    assert set(range(40)) - {8} <= ids, "clean documents stay; 8 is a copy of a text that has id 7 as well"
    last = pipeline.STAGES[-1][1](spark, kept, SF_DIR)
    for r, t in zip(last.orderBy("doc_id").collect(), kept.orderBy("doc_id").collect()):
        assert r.decoded_sha256 == hashlib.sha256(t.text.encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_more_labels_than_are_sent_to_tasks(spark, monkeypatch):
    """Every label is learned, however many there are, and the counts of many are joined by a shuffle."""
    rows = [(i, f"text {i % 300} of label", f"l{i % 300}", 1.0, True) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, held_out boolean")
    spans = langid.sample_spans(docs, "doc_id", "text", "lang")
    assert {lang for lang, _ in spans} == {f"l{k}" for k in range(300)}
    monkeypatch.setattr(langid, "BROADCAST_LABELS", 0)
    assert sorted(langid.sample_spans(docs, "doc_id", "text", "lang")) == sorted(spans)
    few = docs.filter("doc_id % 300 < 3")
    got = langid.identify(few, carry=["score", "held_out"]).collect()
    assert len(got) == 15 and all(r.in_score == 1.0 and r.in_held_out and r.lang_pred in ("l0", "l1", "l2") for r in got)
