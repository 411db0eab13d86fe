"""Repeats, near-duplicates, contamination, BPE and media against plain versions."""

import hashlib
import io
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quire.llm import bytebpe, decontam, media, minhash, repeats
from quire.llm.queries import vocabulary

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- op1 --------------------------------------------------------------------------------------------------------------------


def plain_repeats(texts, length=50):
    starts: dict[bytes, float] = {}
    raw = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in texts]
    for order, _, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            starts[w] = min(starts.get(w, float("inf")), order)
    out = []
    for order, i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] < order:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def test_repeats(docs, texts):
    got = rows(repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
    got = sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got), key=repr)
    assert got == plain_repeats(texts)


@pytest.mark.parametrize("hot", [(2, 1, 1), (10**9, 10**9, 10**9)])
def test_repeats_of_hot_anchors(docs, texts, hot):
    got = repeats.remove_repeats(docs, block_bytes=4000, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got.collect()), key=repr) == plain_repeats(texts)


def test_a_passage_in_many_surroundings_makes_no_large_group():
    """100 blocks of 1,000 documents each: one passage of 60 bytes, 100,000 surroundings. No key has many contexts, and all is marked that should be."""
    rng = np.random.default_rng(8)
    passage, around = b"a passage that stands in very many documents, of sixty bytes", rng.integers(97, 123, (100_000, 80), dtype=np.uint8)
    blocks = []
    for n in range(100):
        raw = [x[:40].tobytes() + passage + x[40:].tobytes() for x in around[n * 1000 : n * 1000 + 1000]]
        ids = np.arange(n * 1000, n * 1000 + 1000)
        blocks.append(pa.table({"block": [n] * 1000, "doc_id": ids, "doc": ids, "uid": ids, "raw": pa.array(raw, pa.binary())}))
    by_bucket = lambda tables: pa.concat_tables(tables)
    answers = repeats._answer(*repeats.HOT)(by_bucket([repeats._ask(1)(b) for b in blocks]))
    sent = [repeats._contexts(1)(b, answers.filter(pc.equal(answers.column("block"), n))) for n, b in enumerate(blocks)]
    groups: dict[int, set] = {}
    for t in sent:
        for packed in t.column("packed"):
            key, _, size, text, *_ = repeats._unpack(packed.as_py())
            at = 0
            for k, n in zip(np.cumsum(key).tolist(), np.frombuffer(size, np.uint8).tolist()):
                groups.setdefault(k, set()).add(text[at : at + n + 50])
                at += n + 50
    assert max(map(len, groups.values())) < 1000 and sum(map(len, groups.values())) > 100_000
    marks = repeats._mark(by_bucket(sent))
    few = marks.filter(pc.is_in(marks.column("block"), pa.array([0, 99])))
    for n, removed in ((0, 999), (99, 1000)):
        out = repeats._remove(False, [])(blocks[n], few.filter(pc.equal(few.column("block"), n)))
        assert sum(r >= 60 for r in out.column("n_removed").to_pylist()) == removed


def test_repeats_carry_and_empty(docs, no_docs):
    out = repeats.remove_repeats(docs, carry=["kept", "block", "text"], as_text=True)
    assert {"in_kept", "in_block", "in_text", "kept"} <= set(out.columns) and out.count() == docs.count()
    assert repeats.remove_repeats(no_docs).count() == 0


def test_long_rows_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 200)
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(97, 101, 1500, dtype=np.uint8)), np.uint8)
    cut = repeats.anchors(data, np.array([0, 700, 1500]))
    monkeypatch.setattr(repeats, "_SEGMENT", 1 << 20)
    whole = repeats.anchors(data, np.array([0, 700, 1500]))
    strings = lambda x: sorted((int(h), s, int(r)) for h, a, b, r in zip(*x[:4]) for s in range(a, b + 1))
    assert strings(cut) == strings(whole)


def test_index_is_run_compressed_and_exact():
    rng = np.random.default_rng(3)
    base = [bytes(rng.integers(97, 99, 40, dtype=np.uint8))] * 30 + [b"\x00\xff" * 8]
    text, begin, end = repeats._joined(base)
    index = repeats.RunLengthIndex(text, np.zeros(len(text), np.int64))
    assert index.runs() < len(text) / 8
    pattern = base[0][5:35] + b"zz" + b"\xff\x00\xff"
    p, b, e = repeats._joined([pattern])
    far = index.statistics(p, b, e, np.zeros(1, np.int64))
    for i in range(len(pattern)):
        want = max(n for n in range(len(pattern) - i + 1) if any(pattern[i : i + n] in s for s in base))
        assert far[i] == want


# -- op3 --------------------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(texts):
    sets = [(i, shingle_set(t)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [j for b, (j, t) in enumerate(sets) if find(b) == find(a) and j is not None]
        component = (min(ids) if ids else None) if s else i
        out.append((i, len(s), component, i == component))
    return sorted(out, key=repr)


def test_near_duplicates(docs, texts):
    got = minhash.near_duplicates(docs)
    assert rows(got) == plain_components(texts)


def test_near_duplicates_without_broadcast_and_rows(docs, no_docs, texts, monkeypatch):
    assert minhash.near_duplicates(no_docs).count() == 0
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    assert rows(minhash.near_duplicates(docs)) == plain_components(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in "ab")
    keys = minhash.signatures([a, b], bands=400, rows=1)
    assert abs((keys[0] == keys[1]).mean() - 300 / 400) < 0.08


# -- op4 --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(texts):
    by_id = dict(texts)
    words = by_id[0].split()
    return [(1, " ".join(by_id[45].split()[10:40])), (2, by_id[3]), (3, "one two"), (4, "one"), (5, ""), (6, None), (7, "Nothing like this stands in any document at all here"), (8, by_id[3]), (None, by_id[4]), (9, words[0] + "!! " + words[1])]


def plain_contamination(texts, items, window=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = find(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in texts:
        w = find(t)
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[k : k + size]))) is not None:
                    ids |= got
                    hit.update(range(k, k + size))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "segment"), [(1 << 20, 1 << 14), (200, 1 << 14), (200, 7)])
def test_contamination(spark, docs, texts, items, monkeypatch, limit, segment):
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    assert rows(decontam.contamination(docs, table, block_bytes=limit).drop("items")) == plain_contamination(texts, items)


def test_tables_of_a_block_are_bounded():
    """Six blocks of 4 MB of words each: a worker that reads them one after the other stays within a few blocks' memory, and finds each block's strings."""
    import resource

    rng = np.random.default_rng(6)
    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
    raws, first = [], []
    for k in range(6):
        words = rng.integers(0, 10**6, 4 * (1 << 20) // 7)
        texts = pa.array([" ".join(map(str, words[i : i + 2000])) for i in range(0, len(words), 2000)])
        first.append(" ".join(map(str, words[:10])))
        raws.append(decontam.packed(decontam.build(range(k * 1000, k * 1000 + len(texts)), [10] * len(texts), texts)))
        assert len(raws[-1]) < 40 << 20
    before = peak()
    text = np.frombuffer(" ".join(first).encode(), np.uint8)
    words = decontam.Words(text, np.array([0, len(text)]), decontam.NON_ALNUM)
    found = set()
    for raw in raws:
        for s in decontam.unpacked(raw):
            for string in s.find(words, words.hashes())[1].tolist():
                found.update(s.items_of(string))
    assert found == {k * 1000 for k in range(6)}
    assert peak() - before < 200, "MB beyond what building them took"


def test_contamination_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, none).filter("contaminated").count() == 0
    assert decontam.contamination(no_docs, none, carry=["text"]).count() == 0


# -- op7 --------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    import base64

    import tiktoken

    path, pattern = vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, no_docs, texts, encoder):
    got = rows(bytebpe.round_trip(docs, *vocabulary()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := encoder.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in texts]
    assert got == sorted(want, key=repr)
    assert bytebpe.round_trip(no_docs, *vocabulary(), with_ids=True).count() == 0


def test_bpe_offsets_and_split_characters(spark, encoder):
    df = spark.createDataFrame([(1, "naïve 漢字 \U0001f600 ok"), (2, None)], "doc_id long, text string")
    enc = bytebpe.encode(df, *vocabulary())
    one = enc.filter("doc_id = 1").first()
    text = "naïve 漢字 \U0001f600 ok"
    assert one.ids == encoder.encode_ordinary(text) and one.ends[-1] == len(text)
    assert all(0 <= a <= b <= len(text) for a, b in zip(one.starts, one.ends))
    back = {r.doc_id: (bytes(r.bytes), r.text) for r in bytebpe.decode(enc, *vocabulary()).collect()}
    assert back == {1: (text.encode(), text), 2: (b"", "")}
    half = bytebpe.load(*vocabulary()).decode(one.ids[:-3])
    assert half.decode("utf-8", "replace")


def test_bpe_pieces_keep_matches(encoder):
    text = ("word  two\n\n three 12'll " * 3000) + "x" * 9000
    assert "".join(p for _, p in bytebpe.pieces(text, 1000)) == text
    bpe = bytebpe.load(*vocabulary())
    ids = [i for _, p in bytebpe.pieces(text, 1000) for i in bpe.encode([p])[0][0]]
    assert ids == encoder.encode_ordinary(text)


# -- op9 --------------------------------------------------------------------------------------------------------------------


def test_media_payloads(docs, texts, no_docs):
    import zlib

    got = rows(media.read_payloads(media.store_texts(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = []
    for i, t in texts:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want, key=repr)
    features = {}
    for r in media.read_payloads(media.store_texts(docs)).collect():
        assert features.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.read_payloads(media.store_texts(no_docs)).count() == 0


def plain_area(image, height, width):
    """Sums of cells by single samples, times height * width."""
    rows_, cols = image.shape
    out = np.zeros((height, width))
    for y in range(rows_ * height):
        for x in range(cols * width):
            out[y // rows_, x // cols] += image[y // height, x // width]
    return out


@pytest.mark.parametrize("shape", [(1, 24), (5, 3), (9, 17), (16, 18)])
def test_area_resize(shape):
    image = np.random.default_rng(4).integers(0, 256, shape, dtype=np.uint8)
    assert (media.area_sums(image, 8, 9) == plain_area(image, 8, 9)).all()
    assert media.resize(image, *shape).tolist() == image.tolist()
    assert (np.load(io.BytesIO(media.npy(image))) == image).all()


def test_decoders():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    colour = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    assert (media.decode(b"P5 # c\n4 3\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2\n4 3 255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert (media.decode(b"P6\n4 3\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3\n4 3\n255\n" + b" ".join(b"%d" % x for x in colour.ravel())) == colour).all()
    assert (media.decode(b"P1\n2 2\n10\n01\n") == [[0, 255], [255, 0]]).all()
    assert (media.decode(b"P4\n2 2\n\x80\x40") == [[0, 255], [255, 0]]).all()
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0] == 258
    padded = b"".join(colour[y, :, ::-1].tobytes() for y in (2, 1, 0))
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(padded), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, len(padded), 0, 0, 0, 0) + padded
    assert (media.decode(bmp) == colour).all()
    for bad in (b"", b"P5\n4 3\n255\n", b"P5 x", b"BM", b"GIF89a"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_tiles(spark):
    raw = media.encode_pgm(bytes(range(240)), 24)
    df = spark.createDataFrame([(1, raw), (2, b"nothing"), (3, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.tiles(df, size=4).collect()}
    assert np.load(io.BytesIO(bytes(got[1].tile))).shape == (4, 4) and got[1].error is None and len(got[1].dhash) == 16
    assert got[2].error and got[3].error and Counter(r.tile is None for r in got.values())[True] == 2
