"""Archives of spreadsheet files made where their documents are."""

import io
import zipfile

import pytest

from quire.sources import sinks


def test_zips_are_those_of_zipfile(monkeypatch):
    members = [sinks.deflated("ä/b.xml", "text" * 99), sinks.stored("c", b"\0raw"), sinks.stored("empty", b"")]
    raw = sinks.zipped(members)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None
        assert {n: z.read(n) for n in z.namelist()} == {"ä/b.xml": b"text" * 99, "c": b"\0raw", "empty": b""} == dict(sinks.unzipped(raw))
    assert dict(sinks.unzipped(raw, "c")) == {"c": b"\0raw"} and list(sinks.unzipped(sinks.zipped([]))) == []
    with pytest.raises(zipfile.BadZipFile):
        list(sinks.unzipped(raw.replace(b"\0raw", b"\0row")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"other form"
        z.writestr("x/y", "z" * 50)
    assert list(sinks.unzipped(out.getvalue(), "x/")) == [("x/y", b"z" * 50)]
    many = [sinks.stored(str(i), b"") for i in range(66_000)]
    assert sum(1 for _ in sinks.unzipped(sinks.zipped(many))) == 66_000


def test_no_file_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ARCHIVES_AT_ONCE", 2)
    cells = "array<struct<row:bigint,col:int,text:string,num:double>>"
    rows = [(j, f"{j}-{n}.xlsx", [(n, 27, "a<b", None), (0, 0, None, float(j)), (1, 1, None, None)][: n + 1]) for j in range(7) for n in range(j % 4)] + [(9, "none.xlsx", [])]
    made = sinks.book_archives(spark.createDataFrame(rows, f"job long, name string, cells {cells}"), "name", "job")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0 and made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.job: r.files for r in made.collect()} == {1: 1, 2: 2, 3: 3, 5: 1, 6: 2, 9: 1}
    assert {(r.job, r.name): r.cells for r in sinks.listed(made, "job").collect()} == {(j, n): min(len(c), 2) for j, n, c in rows}
    for r in made.collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.zip))) as z:
            for name in z.namelist():
                with zipfile.ZipFile(io.BytesIO(z.read(name))) as book:
                    assert book.testzip() is None
                    sheet = book.read("xl/worksheets/sheet1.xml").decode()
                    assert (f'<c r="A1"><v>{float(r.job)}</v></c>' in sheet) == (len(next(c for _, n, c in rows if n == name)) > 1)
