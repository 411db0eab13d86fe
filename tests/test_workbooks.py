"""Spreadsheet files written and read back."""

import zipfile
from xml.etree import ElementTree

import pytest

from quire.sources import workbooks

SCHEMA = "book string, sheet string, head boolean, cells array<string>, place int"


def books(spark, folder):
    out = {}
    for r in workbooks.read(spark, folder).collect():
        out.setdefault((r.book, r.sheet), {})[r.row] = list(r.cells)
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_texts_names_and_gaps_come_back(spark, tmp_path):
    texts = ["", " a ", "<&>\"'", "line\nbreak\ttab", "\r\x00\x0b￾", "_x0041_ __x0041_", "ü漢😀", "x" * 40_000, None, "end"]
    rows = [("../b?c*", "in/va:lid[sheet]" + "n" * 30, True, texts, 0), ("../b?c*", "in/va:lid[sheet]" + "n" * 31, False, ["2"] * 30, 1), ("", "s", None, [], 0), (None, "t", False, None, 1), ("B", "Sheet", False, ["1"], 0), ("B", "SHEET", False, ["2"], 1), ("b", None, False, ["3"], 0)]
    workbooks.write(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), ["place"])
    name = "in_va_lid_sheet_" + "n" * 15
    assert books(spark, str(tmp_path)) == {("../b?c*", name): [texts], ("../b?c*", name[:29] + "_2"): [["2"] * 30], ("", "s"): [[]], ("", "t"): [[]], ("B", "Sheet"): [["1"]], ("B", "SHEET_2"): [["2"]], ("b", "Sheet"): [["3"]]}
    assert {p.suffix for p in tmp_path.iterdir()} == {".xlsx"}
    with zipfile.ZipFile(tmp_path / "B.xlsx") as z:
        assert z.testzip() is None
        for part in z.namelist():
            ElementTree.fromstring(z.read(part))
        assert set(z.namelist()) == {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/sheet1.xml", "xl/worksheets/sheet2.xml"}


def test_full_sheets_go_on_under_their_headings(spark, tmp_path):
    rows = [("j", "s", True, ["H"], -1), *[("j", "s", False, [str(i)], i) for i in range(10)], ("j", "t", False, ["plain"], 99)]
    workbooks.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path), ["sheet", "place"], rows_per_sheet=4)
    assert books(spark, str(tmp_path)) == {("j", "s"): [["H"], ["0"], ["1"], ["2"]], ("j", "s_2"): [["H"], ["3"], ["4"], ["5"]], ("j", "s_3"): [["H"], ["6"], ["7"], ["8"]], ("j", "s_4"): [["H"], ["9"]], ("j", "t"): [["plain"]]}


def test_files_are_replaced_and_kept(spark, tmp_path):
    one = lambda *names: spark.createDataFrame([(n, "s", False, [n], 0) for n in names], SCHEMA)
    workbooks.write(one("a", "b"), str(tmp_path), ["place"])
    workbooks.write(one("b", "c"), str(tmp_path), ["place"])
    assert {k[0] for k in books(spark, str(tmp_path))} == {"a", "b", "c"}
    workbooks.write(one("c"), str(tmp_path), ["place"], mode="overwrite")
    assert {k[0] for k in books(spark, str(tmp_path))} == {"c"}
    workbooks.write(one("c").limit(0), str(tmp_path), ["place"])
    assert {k[0] for k in books(spark, str(tmp_path))} == {"c"}


def test_scattered_rows_fail_and_publish_nothing(spark, tmp_path):
    spark.dataSource.register(workbooks.Workbooks)
    rows = spark.createDataFrame([("a", "s", False, ["1"], 0), ("b", "s", False, ["2"], 1), ("a", "s", False, ["3"], 2)], SCHEMA)
    for parts in (rows.coalesce(1).sortWithinPartitions("place"), rows.repartitionByRange(3, "place")):
        with pytest.raises(Exception, match="book 'a'"):
            parts.select("book", "sheet", "head", "cells").write.format("workbooks").option("path", str(tmp_path)).mode("append").save()
        assert list(tmp_path.iterdir()) == []


def test_plain_rows_are_read_as_text_and_others_parsed(tmp_path, monkeypatch):
    """Rows as they are written need no parser; from the first row of another form on, the parser reads."""
    parsed = []
    general = workbooks.sheet_rows
    monkeypatch.setattr(workbooks, "sheet_rows", lambda part: parsed.append(1) or general(part))
    path = tmp_path / "a.xlsx"
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(workbooks, "READ_AT_ONCE", at_once)
        for odd in (None, '<c r="B2"><v>5</v></c>', '<c r="B2" t="inlineStr"><is><t xml:space="preserve">5&#48;<!-- x --></t></is></c>'):
            parsed.clear()
            book = workbooks.Book(workbooks.fs.LocalFileSystem().open_output_stream(str(path)), 100)
            for n in range(3):
                book.add("s", False, ["a &amp; _x0041_", None, "ü"] if n < 2 else [])
            if odd:
                book.rows.insert(2, f'<row r="9">{odd.replace("B2", "B9")}</row>')
            book.close()
            got = [r for p in workbooks.WorkbookReader({"path": str(tmp_path)}).partitions() for b in workbooks.WorkbookReader({"path": str(tmp_path)}).read(p) for r in b.to_pylist()]
            want = [(0, ["a & A", None, "ü"]), *([(8, [None, "5" if "<v>" in odd else "50"])] if odd else []), (1, ["a & A", None, "ü"]), (2, [])]
            assert [(r["row"], r["cells"]) for r in got] == want and {r["book"] + r["sheet"] for r in got} == {"as"}
            assert len(parsed) == bool(odd)


def test_lines_meet_documents_once(spark):
    """The lines of jobs are joined with their documents for their rows, and for sizes and headings only counted."""
    from pyspark.sql import functions as F

    from quire.sources import sinks

    docs = spark.createDataFrame([(1, "j", "a", "f1"), (2, "j", "b", "f2"), (3, "k", "a", "f3")], "doc long, job string, doc_type string, file string").withColumns({"confidence": F.lit("high"), "needs_review": F.lit(False), "notes": F.lit(""), "errors": F.array().cast("array<string>"), "failed": F.lit(False), "seconds": F.lit(1.0)})
    lines = spark.createDataFrame([(1, n) for n in range(9)] + [(3, 0), (None, 1), (7, 2)], "doc long, line int")
    facts = spark.createDataFrame([("j", "c", "p")], "job string, client string, provider string")
    out = sinks.typed_books(docs, {}, lines, ["line"], facts, most_rows=20)
    got = sorted((r.book, r.sheet, r.head, r.cells[0], len(r.cells)) for r in out.filter("sheet <> 'Summary'").collect())
    lined = [("j", "a_lines", False, "f1", 2)] * 9 + [("j", "a_lines", True, "Source File", 2), ("k", "a_lines", False, "f3", 2), ("k", "a_lines", True, "Source File", 2)]
    main = [(b, t, h, n, 4) for b, t, f in (("j", "a", "f1"), ("j", "b", "f2"), ("k", "a", "f3")) for h, n in ((False, f), (True, "Source File"))]
    assert got == sorted(lined + main)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner, (doc") == 1
