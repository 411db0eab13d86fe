"""Fill-in-middle against one regular expression over whole texts, at every chunk size."""

import hashlib
import random
import re

import pytest

from quire.llm import fim
from quire.llm.queries import QUERIES

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(tokens), "plain", None, None, text
    prefix, middle, suffix = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    form = "spm" if h[3] % 100 < spm else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(tokens), form, len(prefix), len(middle), output


def check(spark, rows, **options):
    schema = "doc_id long, text string, n long, form string, h long, output string, `from` long"
    df = spark.createDataFrame([(i, t, 1, "f", 2, "o", 3) for i, t in rows], schema)
    got = fim.fill_in_middle(df, carry=["text", "form", "from"], **options).collect()
    named = {k: v for k, v in options.items() if k != "chunk"}
    key = lambda r: repr(r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(i, t, **named) for i, t in rows), key=key)
    assert all(r.in_form == "f" and r.in_from == 3 for r in got)
    return got


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunks_of_any_size_give_the_same_cuts(spark, texts, chunk):
    short = [(i, t) for i, t in texts if len(t or "") < 3000] + [(100 + k, t) for k, t in enumerate(["a b", " a", "a ", "\t\r\n", "é é\x0b漢\U0001f600 x", "a\xa0b c", "<P", "x <S> y", "<<S", ">a <", "\x1f\x1c a"])]
    got = check(spark, short, chunk=chunk, rate=100)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_defaults_over_odd_and_long_texts(spark, texts):
    rng = random.Random(3)
    long = "".join(rng.choice(["é", "x", " ", "\n", "漢字", "  ", "word"]) for _ in range(400_000))
    rows = [*texts, (1000, long), (1001, "y" * 300_000), (1002, " " * 200_000), (1003, long[::-1]), (1004, long[1:])]
    check(spark, rows)
    check(spark, rows, seed=7, rate=90, spm=10)


def test_outputs_are_turned_back_into_texts(spark, docs):
    from pyspark.sql import functions as F

    found = fim.fill_in_middle(docs, rate=100, carry=["text"])
    assert found.filter(~fim.restore(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("in_text", F.lit("")))).count() == 0
    assert found.filter("form <> 'plain'").count() > 50


def test_no_documents(spark, no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
    assert "op12_fill_in_middle" in QUERIES
