"""Operators by hand-made cases and plain versions."""

import io
import zipfile
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF_DIR
from pyspark.sql import functions as F

from quire.catalog import rows
from quire.functions import values as V
from quire.operators import grid, model, statements
from quire.operators.assign import greedy
from quire.plans import documents, matching, placement, streams, windows
from quire.session import table
from quire.sources import files, sinks


@pytest.mark.parametrize(
    ("raw", "kind", "text", "num"),
    [
        (None, "empty", "", None), ("  ", "empty", "", None), ("N/A", "empty", "", None), ("–", "empty", "", None), ("(2.85)", "negative", "-2.85", -2.85), ("(1,234)", "negative", "-1234", -1234.0),
        ("5 March 2024", "date", "2024-03-05", None), ("Mar. 5, 2024", "date", "2024-03-05", None), ("3/5/2024", "date", "2024-03-05", None), ("3-5-2024", "date", "2024-03-05", None), ("13/45/2024", "date", "2024-13-45", None),
        ("5 Foo 2024", "text", "5 Foo 2024", None), ("$1,234.50", "amount", "1234.50", 1234.5), ("$ 7", "amount", "7", 7.0), ("1,200", "amount", "1200", 1200.0), ("007", "text", "007", None), ("42", "text", "42", None),
        ("5K", "scaled", "5K", 5000.0), ("1.2M", "scaled", "1.2M", 1200000.0), ("3mm", "scaled", "3mm", 3000000.0), ("1.2.3K", "text", "1.2.3K", None), ("$", "text", "$", None), ("abc", "text", "abc", None), ("-3.5", "amount", "-3.5", -3.5),
    ],
)
def test_normalize(spark, raw, kind, text, num):
    got = spark.range(1).select(V.normalize(F.lit(raw).cast("string")).alias("v")).first().v
    assert (got.kind, got.text, got.num) == (kind, text, num)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 701), min_size=1, max_size=30))
def test_columns_round_trip(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "c int").select("c", V.column_number(V.column_letters(F.col("c"))).alias("back"))
    assert all(r.c == r.back for r in df.collect())


def test_throttle(spark):
    log = table(spark, SF_DIR, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_type").collect()
    by_user = defaultdict(list)
    for r in log:
        by_user[r.user_id].append((r["at"], r.event_id, r.event_type != "purchase"))
    want = {}
    for user, attempts in by_user.items():
        fails, until = 0, 0.0
        for at, i, failed in sorted(attempts):
            locked = bool(until) and at < until
            if not locked:
                if until:
                    fails, until = 0, 0.0
                fails = fails + 1 if failed else 0
                if fails >= 5:
                    until = at + 900
            want[i] = not locked
    got = {r.id: r.allowed for r in streams.r6_throttle(spark, SF_DIR).collect()}
    assert got == want and not all(got.values())


def test_greedy_blocks_both_sides(spark):
    c = rows(spark, "t int, l int, r int, s int", [(1, 1, 1, 0), (1, 1, 2, 1), (1, 2, 1, 0), (1, 3, 2, 2), (2, 1, 1, 0)])
    assert sorted(map(tuple, greedy(c, ["t"], "l", "r", ["s", "l", "r"]).collect())) == [(1, 1, 1), (1, 3, 2), (2, 1, 1)]


def test_slots_and_shifts_add_up(spark):
    s = windows.layout(rows(spark, "template int, section string, header_row int, start_row int, end_row int, extracted int", [(1, "a", 0, 1, 2, 5), (1, "b", 0, 1, 3, 1), (1, "c", 5, 6, 6, 0), (1, "d", 8, 9, 9, 4)]))
    got = {r.section: (r.overflow, r["shift"], r.data_start) for r in s.collect()}
    assert got == {"a": (2, 0, 1), "b": (2, 0, 1), "c": (0, 2, 8), "d": (3, 2, 11)}


def test_line_parse_forms(spark):
    text = "--- page\nCash & Co: $1,200.50\nLess: Depreciation  $(139,800)\nTotal 5\nTotal 7\nno value\n\t\nX\t9\n"
    got = {r.label: r.value for r in documents.parse_lines(rows(spark, "doc_id int, text string", [(1, text), (2, None), (3, "")])).collect()}
    assert got == {"cash & co": "1200.50", "less depreciation": "-139800", "total": "7", "x": "9"}


def test_model_prefers_the_first_usable_provider(spark):
    asked = rows(spark, "doc_id int, task string", [(1, "t"), (2, "t"), (3, "t")])
    recorded = rows(spark, "doc_id int, task string, provider string, raw string", [(1, "t", "a", "no json"), (1, "t", "b", '{"x": 1}'), (2, "t", "b", '{"x": 2}'), (2, "t", "a", 'so: {"x": 3}'), (3, "u", "a", "{}")])
    got = {r.doc_id: (r.provider, r.x) for r in model.respond(asked, recorded, ["a", "b"]).select("doc_id", "provider", F.try_variant_get("parsed", "$.x", "int").alias("x")).collect()}
    assert got == {1: ("b", 1), 2: ("a", 3), 3: (None, None)}


def test_formulas(spark):
    cells = rows(spark, "sheet int, ref string, num double", [(1, "A1", 1.005), (1, "A2", 2.0), (1, "B1", 10.0)])
    asked = rows(spark, "sheet int, id int, formula string", [(1, 1, "=SUM(A1:B2)"), (1, 2, "=sum(a1, B1)"), (1, 3, "=A1+A2"), (2, 4, "=SUM(A1:A2)"), (1, 5, None)])
    got = {r.id: r.value for r in placement.evaluate(asked, cells).collect()}
    assert got == {1: 3.01, 2: 11.01, 3: None, 4: None, 5: None}


def test_workbook_opens():
    raw = sinks.workbook([(0, 0, "a<b"), (0, 27, 2.5), (3, 1, "x")])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert z.testzip() is None and "a&lt;b" in sheet and 'r="AB1"' in sheet and 'r="B4"' in sheet


def test_folder_scan_is_by_extension(spark, tmp_path):
    for name in ("a.PDF", "b.png", "c.exe", "d.pdf"):
        (tmp_path / name).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r.type for r in files.folder(spark, f"file://{tmp_path}").select("path", files.file_type(F.col("path")).alias("type")).collect()}
    assert got == {"a.PDF": "pdf", "b.png": "image", "d.pdf": "pdf"}


def test_plans_stay_declarative(spark):
    """Filters and columns reach the scan, and lookups are broadcast instead of crossed."""
    from quire.plans import analytics, sources

    plan = sources.s12_scan_pushdown(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "o_orderdate" not in plan
    plan = analytics.a6_group_counts(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string,source:string>" in plan
    plan = documents.a15_hint_scores(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_rows_are_collected_in_the_order_of_keys(spark):
    answers = [
        (1, '{"table_rows": [{"a": "1"}], "confidence": "high"}'), (2, '{"z_rows": [{"a": 1}, "x", null, [1], {"b": {"c": 2}}], "n": 5, "a_rows": [{"a": "2"}], "table_rows": [{"a": "3"}]}'),
        (3, "no json"), (4, None), (5, "[1]"), (6, '{"rows": [{"a": 1}], "x_rows": {"a": 1}, "y_rows": null, "q_rows": []}'), (7, '{"p_rows_rows": [{"a": "7"}]}'),
    ]
    df = documents.collect_rows(spark.createDataFrame(answers, "id int, raw string"), "id", "raw")
    got = sorted((r.id, r.pos, r.source, tuple(sorted(r.row.items()))) for r in df.collect())
    assert got == [(1, 1, "table", (("a", "1"),)), (2, 1, "table", (("a", "3"),)), (2, 2, "z", (("a", "1"),)), (2, 3, "z", (("b", '{"c":2}'),)), (2, 4, "a", (("a", "2"),)), (7, 1, "p", (("a", "7"),))]


def plain_kept(sections):
    """The fold by loops: sections in order, each with its rows' labels."""
    drop = set()
    for i, (big, rows_, _) in enumerate(sections):
        for j, (small, others, matched) in enumerate(sections):
            if i != j and big not in drop and small not in drop and set(rows_) and set(others):
                both = len(set(rows_) & set(others))
                if both / len(set(others)) >= 0.9 and len(rows_) > len(others) and matched and len(set(rows_) - set(others)) <= 1:
                    drop.add(big)
    return [name for name, *_ in sections if name not in drop]


def test_redundant_sections_are_folded(spark):
    import random

    rng = random.Random(2)
    docs = {0: [("a", ["x", "y", "z"], True), ("b", ["x", "y", "z", "w"], True), ("c", ["x", "y", "z", "w", "v"], False)]}
    for d in range(1, 200):
        base = [f"l{k}" for k in range(12)]
        docs[d] = [(f"s{k}", [rng.choice(base[: 3 + k]) for _ in range(rng.randint(0, 6))] if rng.random() < 0.4 else base[: rng.randint(1, 12)], rng.random() < 0.7) for k in range(rng.randint(1, 7))]
    df = spark.createDataFrame([(d, pos, name, labels, matched) for d, s in docs.items() for pos, (name, labels, matched) in enumerate(s)], "doc int, pos int, section string, labels array<string>, matched boolean")
    got = defaultdict(list)
    for r in documents_order(matching.drop_redundant(df, "pos"), df):
        got[r.doc].append(r.section)
    assert {d: plain_kept(s) for d, s in docs.items()} == {d: got[d] for d in docs} and got[0] == ["a", "c"]


def documents_order(kept, sections):
    return kept.join(sections, ["doc", "section"]).orderBy("doc", "pos").collect()


def test_long_ranges_make_no_rows(spark):
    cells = rows(spark, "sheet int, ref string, num double", [(1, "A1", 1.0), (1, "A900000", 2.5), (1, "AA7", 4.0)])
    asked = rows(spark, "sheet int, id int, formula string", [(1, 1, "=SUM(A1:A1000000)"), (1, 2, "=SUM(A1,A1, AA7)"), (1, 3, "=SUM(AA1:AA5)"), (1, 4, "=SUM(A5:A1)"), (1, 5, "=SUM(x,A1)")])
    assert {r.id: r.value for r in placement.evaluate(asked, cells).collect()} == {1: 3.5, 2: 6.0, 3: None, 4: None, 5: 1.0}


def test_pictures():
    import struct
    import zlib

    import numpy as np

    from quire.sources import images

    image = np.random.default_rng(1).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (images.read_png(images.png(image)) == image).all() and images.dimensions(images.png(image)) == (5, 7)
    # every filter of the format, written by its definition
    lines, above = b"", np.zeros(15, int)
    for y, kind in enumerate([0, 1, 2, 3, 4, 4, 3]):
        line = image[y].ravel().astype(int)
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, above[:-3]]
        near = left + above - corner
        paeth = np.where((abs(near - left) <= abs(near - above)) & (abs(near - left) <= abs(near - corner)), left, np.where(abs(near - above) <= abs(near - corner), above, corner))
        lines += bytes([kind]) + bytes(((line - [0 * left, left, above, (left + above) // 2, paeth][kind]) & 255).tolist())
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.read_png(raw) == image).all()
    assert images.fitted(4096, 100, 2048) == (2048, 50) and images.fitted(10, 5000, 2048) == (4, 2048) and images.fitted(3, 4, 2048) == (3, 4)
    assert images.shrunk(np.full((10, 8, 3), 9, np.uint8), 4, 5).tolist() == np.full((5, 4, 3), 9).tolist()
    assert images.dimensions(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x01\x02\x03\x04" + b"\0" * 9) == (0x0304, 0x0102)
    for bad in (b"", b"GIF89a", raw[:40], raw.replace(b"IDAT", b"IDAX")):
        with pytest.raises(images.ImageError):
            images.dimensions(bad) and images.read_png(bad)


def test_workbook_of_several_sheets():
    raw = sinks.workbook({"a & \"b\"": [(0, 0, "x")], "lines": [(1, 1, 2)]})
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert 'name="a &amp; &quot;b&quot;"' in z.read("xl/workbook.xml").decode()
        assert 'r="B2"' in z.read("xl/worksheets/sheet2.xml").decode() and len([n for n in z.namelist() if "sheets/" in n]) == 2


def test_keys_are_in_the_order_they_are_met(spark):
    values = rows(spark, "doc_id int, label string, value string, pos int", [(2, "b", "1", 0), (2, "a", "2", 1), (1, "c", "3", 0), (1, "b", None, 1), (3, "_x", "4", 0), (3, "a b.c", "5", 0)])
    assert sinks.key_union(values, "doc_id", "pos") == ["c", "b", "a", "a b.c"]
    docs = rows(spark, "doc_id int, file string, doc_type string, confidence string, needs_review boolean", [(1, "f1", None, None, None), (2, "f2", "t", "low", True), (3, "f3", "t", None, False), (4, "f4", None, None, None)])
    got = sinks.combined_sheet(docs, values, "doc_id", "pos")
    assert got.columns == ["File", "Doc Type", "Confidence", "Status", "c", "b", "a", "a b.c"]
    assert sorted(map(tuple, got.collect())) == [("f1", "", "", "OK", "3", "", "", ""), ("f2", "t", "low", "Review", "", "1", "2", ""), ("f3", "t", "", "OK", "", "", "", "5"), ("f4", "", "", "OK", "", "", "", "")]


def test_silent_users_are_forgotten(spark, tmp_path):
    """Four failures, a month of others' attempts, a fifth failure: not locked out, as the four were forgotten."""
    from quire.streaming import watch

    day = 86400.0
    first = [(1, i, 1.0 + i, True) for i in range(4)]
    batches = [first, [(2, 10, 100 * day, False)], [(2, 11, 101 * day, False)], [(1, 20, 101 * day, True), (1, 21, 101 * day + 1, True)]]
    schema = "user long, id long, at double, failed boolean"
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in").withColumn("seen", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("seen", "1 day")
        watch.throttle(stream).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").option("path", f"file://{tmp_path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.id: r.allowed for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == dict.fromkeys([0, 1, 2, 3, 10, 11, 20, 21], True)


STATEMENT = "ACME LTD\nBALANCE SHEET\nCURRENT ASSETS\nCash $1,200\nInventory 300.50\nTotal Current Assets $1,500.50\nNON-CURRENT ASSETS\nNon current assets\nPlant (2,000)\nTOTAL 2,000\nLIABILITIES & EQUITY\nCurrent Liabilities\nPayables 40\nLONG-TERM LIABILITIES\nLoan 900\nnothing here\nTotal liabilities 940"


def test_sections_of_a_statement(spark):
    zones = F.transform(F.array(*map(F.lit, ["Current assets", "Non current assets", "Current liabilities", "Non current liabilities"])), lambda z: F.struct(z.alias("zone")))
    docs = rows(spark, "doc_id int, text string", [(1, STATEMENT), (2, ""), (3, "CURRENT ASSETS\nno items\n"), (4, None)]).withColumn("zones", zones)
    got = {r.doc_id: {s.zone: ([tuple(i) for i in s["items"]], s.total) for s in r.sections if s.opened is not None} for r in statements.sections(docs).collect()}
    assert got[2] == got[4] == {} and got[3] == {"Current assets": ([], None)}
    assert got[1] == {"Current assets": ([("Cash", "1200"), ("Inventory", "300.50")], "1500.50"), "Non current assets": ([("Plant", "-2000")], "2000"), "Current liabilities": ([("Payables", "40")], None), "Non current liabilities": ([("Loan", "900")], "940")}


def test_value_column_without_a_label_leaves_the_others_free(spark):
    texts = [(0, 0, "Amount"), (0, 1, "Name"), (0, 2, "Kind"), *((r, c, "") for r in (1, 2) for c in range(3))]
    cells = rows(spark, "template int, r int, c int, value string, target boolean, span_rows int, span_cols int", [(1, r, c, v, False, 1, 1) for r, c, v in texts])
    assert [(g.label_col, g.value_col, g.start_row, g.end_row, g.section) for g in grid.column_groups(cells).collect()] == [(1, 2, 1, 2, "Name")]


def test_printed_tables(spark):
    printed = [(1, 0, ["a", "b", "c"]), (1, 1, ["pen", "2", "3"]), (2, 0, ["x", "z"]), (2, 1, ["pen", "2"]), (3, 0, ["Item", "Qty"]), (3, 1, [None, "4"]), (3, 2, [" ink  blue ", "$1,000"]), (3, 3, ["1234", "1"]), (3, 4, ["12345", "1"]), (3, 5, ["Paid in full", "9"]), (3, 6, ["ok"]), (4, 0, None)]
    df = spark.createDataFrame(printed, "tbl int, r int, line array<string>")
    got = {(x.tbl, x.r): (x.cells["item"], x.cells["qty"]) for x in placement.table_rows(df, ["item", "qty"]).collect()}
    assert got == {(3, 2): ("ink blue", "1000"), (3, 4): ("12345", "1"), (3, 6): ("ok", "")}
    near = spark.createDataFrame([(1, "colour", 0, "color"), (1, "colour", 1, "colors"), (1, "colour", 2, "color"), (1, "size", 0, "color"), (2, "Qty", 0, "QTY ordered"), (2, "Qty", 1, "qty")], "tbl int, col string, header int, h string")
    assert {(x.tbl, x.col): x.header for x in matching.match_columns(near).collect()} == {(1, "colour"): 0, (2, "Qty"): 1}


def test_split_decimals_of_odd_fields(spark):
    fields = [(1, [("Net", "7513.0"), ("u", "3"), ("Tax", "12")]), (2, [("a", "1,204."), ("b", "55"), ("c", "9.5"), ("d", "7")]), (3, [("x", "10.25"), ("y", "3")]), (4, [("z", None)]), (5, [("p", "1.0"), ("q", "2"), ("r", "3")]), (6, [])]
    df = spark.createDataFrame(fields, "id int, f array<struct<k:string,v:string>>").select("id", windows.join_split_decimals(F.col("f")).alias("out"))
    got = {r.id: [tuple(x) for x in r.out] for r in df.collect()}
    assert got == {1: [("Net", "7513.03"), ("Tax", "12")], 2: [("a", "1204.55"), ("c", "9.57")], 3: [("x", "10.25"), ("y", "3")], 4: [("z", None)], 5: [("p", "1.02"), ("r", "3")], 6: []}


def test_truncation_of_pages_and_short_texts(spark):
    text = F.col("text")
    df = spark.createDataFrame([(1, None), (2, "a\n--- PAGE BREAK ---\nb"), (3, "x" * 9000), (4, "h" * 1600 + "\nITEMS\nq\n" + "z" * 9000)], "id int, text string")
    out = {r.id: r.x for r in df.select("id", documents.truncate(text, F.col("id") == 3, [(["item"], "")]).alias("x")).collect()}
    assert out[1] == "" and "CONTINUES ON NEXT PAGE" in out[2] and out[3] == "x" * 3000
    assert out[4].startswith("h" * 1500 + "\n\n--- SECTION: Table ---\nITEMS\nq\nzz") and len(out[4]) == 8000
    plain = df.select("id", documents.truncate(text, F.lit(False), []).alias("x")).filter("id = 4").first().x
    assert plain == ("h" * 1500 + "\n" + "h" * 100 + "\nITEMS\nq\n" + "z" * 9000)[:8000]
