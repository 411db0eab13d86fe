"""Sinks as relations: flat, combined and per-file sheets, typed workbooks, archives of one workbook a document."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.session import scratch


def flat_sheet(values: DataFrame, columns: Sequence[str], by: str = "doc_id") -> DataFrame:
    """One row for each document and a column for each label, private labels dropped; the columns are given, so one aggregate does it."""
    return values.filter(~F.col("label").startswith("_")).groupBy(by).agg(*[F.first(F.when(F.col("label") == c, F.col("value")), ignorenulls=True).alias(c) for c in columns])


def per_file(wide: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Field and value rows of each document; ready to be written with ``partitionBy``."""
    return wide.select(by, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])))


#: Columns of a spreadsheet.
MOST_COLUMNS = 16_384


def key_union(values: DataFrame, by: str, order: str, most: int = MOST_COLUMNS) -> list[str]:
    """The labels of all documents in the order in which they are first met: documents by id, labels by ``order`` in each; private ones left out.

    One aggregate; only the distinct labels, which become columns, come to the driver. More than ``most`` fit in no sheet and are an error.
    """
    first = values.filter(~F.col("label").startswith("_")).groupBy("label").agg(F.min(F.struct(by, order)).alias("met"))
    found = [r["label"] for r in first.orderBy("met", "label").select("label").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} labels, which fit in no sheet: keep them as rows")
    return found


def combined_sheet(docs: DataFrame, values: DataFrame, by: str, order: str) -> DataFrame:
    """File, Doc Type, Confidence, Status and a column for each label of ``values`` (by, label, value), empty where a document has none."""
    names = key_union(values, by, order)
    wide = docs.join(flat_sheet(values, names, by), by, "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return wide.select(F.col("file").alias("File"), empty(F.col("doc_type")).alias("Doc Type"), empty(F.col("confidence")).alias("Confidence"), F.when(F.coalesce("needs_review", F.lit(False)), "Review").otherwise("OK").alias("Status"), *[empty(F.col(f"`{n}`")).alias(n) for n in names])


def average_confidence(level: Column) -> Column:
    """High from 2.5, Medium from 1.5, else Low; N/A for none. Unknown levels count as medium."""
    mean = F.avg(F.when(level.isNotNull(), V.confidence_rank(level)))
    return F.when(mean.isNull(), "N/A").when(mean >= 2.5, "High").when(mean >= 1.5, "Medium").otherwise("Low")


def summary_sheet(docs: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """The eight figures of each job's summary sheet, from documents with failed, needs_review, confidence and seconds, and jobs with client and provider."""
    unknown = lambda c: F.coalesce(c, F.lit("N/A"))
    counts = docs.groupBy(by).agg(
        F.count("*").alias("Total Documents"), F.count_if(~F.col("failed")).alias("Successfully Extracted"), F.count_if("failed").alias("Failed"), F.count_if("needs_review").alias("Needs Review"),
        average_confidence(F.col("confidence")).alias("Average Confidence"), F.format_string("%.1fs", F.coalesce(F.sum("seconds"), F.lit(0.0))).alias("Total Processing Time"),
    )
    return counts.join(facts, by, "left").select(*counts.columns, unknown(F.col("client")).alias("Client"), unknown(F.col("provider")).alias("LLM Provider"))


#: Rows that one task of ``numbered`` sorts.
NUMBERED_AT_ONCE = 500_000


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with their number (row, from one) in their group by ``order``, each group spread over tasks.

    Rows are dealt by ranges of group and order and written once with their places; the first number of each task in a group follows from the
    counts of the tasks before it, a row for each of them.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // NUMBERED_AT_ONCE + 1)
    path = scratch(spark)
    placed = df.repartitionByRange(tasks, group, *order).sortWithinPartitions(group, *order).withColumn("place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path).withColumn("part", F.shiftright("place", 33))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = kept.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("place").alias("first")).withColumn("above", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = each.select(F.col(group).alias("of"), F.col("part").alias("at"), (F.col("above") - F.col("first") + 1).alias("shift"))
    return kept.join(F.broadcast(starts), (F.col("part") == F.col("at")) & F.col(group).eqNullSafe(F.col("of"))).select(*df.columns, (F.col("place") + F.col("shift")).alias("row"))


def typed_sheets(docs: DataFrame, fields: dict[str, bool], lines: DataFrame, line_fields: Sequence[str]) -> DataFrame:
    """sheet, row, col, value of a workbook with a sheet for each type and one for its lines, headings in row 0.

    ``docs`` has doc, doc_type, file, confidence, needs_review, notes, errors and the fields (true: required, marked in
    the heading); ``lines`` has doc and the line fields, in whose order the lines of a document come. Row numbers run
    over a type, which may be most of the table, so they are counted by ``numbered``.
    """
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    notes = F.concat(cell(F.col("notes")), F.when(F.size("errors") > 0, F.concat(F.lit(" | ERRORS: "), F.array_join("errors", "; "))).otherwise(""))
    own = [F.col("file"), F.coalesce("confidence", F.lit("unknown")), F.when(F.coalesce("needs_review", F.lit(False)), "Yes").otherwise("No"), *[cell(F.col(f)) for f in fields], notes]
    heads = [F.lit(h) for h in ("Source File", "Confidence", "Needs Review")] + [F.concat(V.title(F.lit(f)), F.lit(" *" if need else "")) for f, need in fields.items()] + [F.lit("Notes")]
    sheet = F.substring(F.col("doc_type"), 1, 31)
    own = [c.alias(f"cell{i}") for i, c in enumerate(own)]
    main = numbered(docs.select("doc_type", "doc", *own), "doc_type", "doc")
    cells = [F.col(f"cell{i}") for i in range(len(own))]
    main = main.select(sheet.alias("sheet"), "row", F.posexplode(F.array(*cells)).alias("col", "value"))
    child = numbered(lines.join(docs.select("doc", "doc_type", "file"), "doc").select("doc_type", "doc", "file", *line_fields), "doc_type", "doc", *line_fields)
    line_sheet = F.substring(F.concat("doc_type", F.lit("_lines")), 1, 31)
    rest = child.select(line_sheet.alias("sheet"), "row", F.posexplode(F.array("file", *[cell(F.col(f)) for f in line_fields])).alias("col", "value"))
    top = lambda df, name, cells: df.select("doc_type").distinct().select(name.alias("sheet"), F.lit(0).cast("long").alias("row"), F.posexplode(F.array(*cells)).alias("col", "value"))
    return main.unionByName(top(docs, sheet, heads)).unionByName(rest).unionByName(top(child, line_sheet, [F.lit("Source File"), *title_row(line_fields)]))


#: Places of the rows of ``typed_books`` in their file.
BOOK_ORDER = ["part", "kind", "place", "line"]


def typed_books(docs: DataFrame, fields: dict[str, bool], lines: DataFrame, line_fields: Sequence[str], facts: DataFrame, most_rows: int = 4 * 1_048_576) -> DataFrame:
    """book, sheet, head, cells and ``BOOK_ORDER``: the files of jobs, each with Summary, a sheet for each type and one for its lines.

    ``docs`` is as for ``typed_sheets``, with job, failed and seconds besides; ``lines`` has doc and the line fields (numbers or texts), ``facts``
    a job's client and provider. Nothing numbers rows here: the writer counts them. A job of over ``most_rows``
    rows is cut into several files, its documents dealt by their digests, so that no task writes a whole large job; the summary is in the first.
    """
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    known = docs.withColumns({"job": cell(F.col("job")), "doc_type": F.coalesce("doc_type", F.lit("other"))})
    own = lines.join(known.select("doc", "job", "doc_type", "file"), "doc")
    # lines are counted by document, so that they meet the documents once and not for sizes and headings again
    counted = known.join(lines.groupBy("doc").agg(F.count("*").alias("lines")), "doc", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    sizes = counted.groupBy("job").agg(F.ceil(F.sum(F.col("lines") + 1) / most_rows).cast("long").alias("files"))
    number = F.pmod(F.conv(F.substring(F.md5(F.col("doc").cast("string")), 1, 8), 16, 10).cast("long"), F.col("files"))
    book = F.when(F.col("files") > 1, F.concat("job", F.lit("-"), (F.col("number") + 1).cast("string"))).otherwise(F.col("job"))
    dealt = lambda df: df.join(sizes, "job").withColumn("number", number).withColumn("book", book)

    notes = F.concat(cell(F.col("notes")), F.when(F.size("errors") > 0, F.concat(F.lit(" | ERRORS: "), F.array_join("errors", "; "))).otherwise(""))
    shown = [cell(F.col("file")), F.coalesce("confidence", F.lit("unknown")), F.when(F.coalesce("needs_review", F.lit(False)), "Yes").otherwise("No"), *[cell(F.col(f)) for f in fields], notes]
    heads = [F.lit(h) for h in ("Source File", "Confidence", "Needs Review")] + [F.concat(V.title(F.lit(f)), F.lit(" *" if need else "")) for f, need in fields.items()] + [F.lit("Notes")]
    kind_of = lines.select(*[F.col(f).alias(f) for f in line_fields]).schema
    no_line = F.lit(None).cast(kind_of)
    main_sheet, line_sheet = F.col("doc_type"), F.concat("doc_type", F.lit("_lines"))

    def row(sheet: Column, kind: int, head: bool, cells: list[Column], place: Column, line: Column) -> list[Column]:
        return [F.col("book"), sheet.alias("sheet"), F.lit(head).alias("head"), F.array(*cells).alias("cells"), F.col("doc_type").alias("part"), F.lit(kind).alias("kind"), place.alias("place"), line.alias("line")]

    none = F.lit(None).cast(docs.schema["doc"].dataType)
    ours, theirs = dealt(known), dealt(own)
    headed = dealt(counted).groupBy("book", "doc_type").agg(F.max("lines").alias("lines"))
    main = ours.select(*row(main_sheet, 1, False, shown, F.col("doc"), no_line))
    rest = theirs.select(*row(line_sheet, 2, False, [cell(F.col("file")), *[cell(F.col(f)) for f in line_fields]], F.col("doc"), F.struct(*line_fields)))
    main_head = headed.select(*row(main_sheet, 1, True, heads, none, no_line))
    rest_head = headed.filter("lines > 0").select(*row(line_sheet, 2, True, [F.lit("Source File"), *title_row(line_fields)], none, no_line))

    summary = summary_sheet(known, facts.withColumn("job", cell(F.col("job"))), "job").join(sizes, "job").withColumn("number", F.lit(0)).withColumn("book", book).withColumn("doc_type", F.lit(None).cast("string"))
    figures = [c for c in summary.columns if c not in ("job", "files", "number", "book", "doc_type")]
    listed = F.posexplode(F.array(*[F.array(F.lit(c), F.col(c).cast("string")) for c in figures])).alias("at", "cells")
    told = summary.select("book", "doc_type", listed).select("book", F.lit("Summary").alias("sheet"), F.lit(False).alias("head"), "cells", F.col("doc_type").alias("part"), F.col("at").alias("kind"), none.alias("place"), no_line.alias("line"))
    return told.unionByName(main_head).unionByName(main).unionByName(rest_head).unionByName(rest)


#: Name, bytes as they are stored, checksum and length of a file in a ZIP, and whether it is deflated.
Member = tuple[str, bytes, int, int, bool]
_XML = '<?xml version="1.0" encoding="UTF-8"?>'


def deflated(name: str, text: str) -> Member:
    raw, press = text.encode(), zlib.compressobj(1, zlib.DEFLATED, -15)
    return name, press.compress(raw) + press.flush(), zlib.crc32(raw), len(raw), True


def stored(name: str, raw: bytes) -> Member:
    return name, raw, zlib.crc32(raw), len(raw), False


def zipped(members: Sequence[Member]) -> bytes:
    """A ZIP of files that are compressed already, so that parts which many files share are compressed once."""
    if len(members) > 65_000 or sum(len(m[1]) + 2 * len(m[0]) for m in members) > 1 << 31:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, kept, _, _, deflate in members:
                z.writestr(zipfile.ZipInfo(name), zlib.decompress(kept, -15) if deflate else kept)
        return out.getvalue()
    body, table, at = [], [], 0
    for name, kept, check, size, deflate in members:
        called = name.encode()
        same = struct.pack("<5H3L2H", 20, 0x800, 8 if deflate else 0, 0, 33, check, len(kept), size, len(called), 0)
        body += (b"PK\3\4", same, called, kept)
        table += (b"PK\1\2\24\3", same, struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, at), called)
        at += 30 + len(called) + len(kept)
    listed = b"".join(table)
    return b"".join([*body, listed, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(members), len(members), len(listed), at, 0)])


def unzipped(raw: bytes, prefix: str = "") -> Iterator[tuple[str, bytes]]:
    """Names and bytes of the files in a ZIP whose names begin with ``prefix``; whatever is not in the plain form of ``zipped`` is left to zipfile."""
    begin = prefix.encode()
    mark, _, _, _, n, size, at, _ = struct.unpack("<4s4H2LH", raw[-22:]) if len(raw) >= 22 else (b"", 0, 0, 0, 0, 0, 0, 0)
    entries, plain = [], mark == b"PK\5\6" and at + size + 22 == len(raw)
    for _ in range(n if plain else 0):
        sign, flags, method, check, packed, full, named, extra, comment, local = struct.unpack_from("<4s4x2H4x3L3H8xL", raw, at)
        called = raw[at + 46 : at + 46 + named]
        if sign != b"PK\1\2" or flags & ~0x800 or method not in (0, 8) or extra or comment or raw[local : local + 4] != b"PK\3\4" or raw[local + 28 : local + 30] != b"\0\0":
            plain = False
            break
        at += 46 + named
        if called.startswith(begin):
            entries.append((called, method, check, full, local + 30 + named, packed))
    if not plain:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((name, z.read(name)) for name in z.namelist() if name.startswith(prefix))
        return
    for called, method, check, full, begins, packed in entries:
        kept = raw[begins : begins + packed]
        kept = zlib.decompress(kept, -15, full) if method else kept
        if zlib.crc32(kept) != check:
            raise zipfile.BadZipFile(f"bad checksum of {called!r}")
        yield called.decode(), kept


@lru_cache(1000)
def _letters(c: int) -> str:
    letters = ""
    while c >= 0:
        letters, c = chr(65 + c % 26) + letters, c // 26 - 1
    return letters


@lru_cache(1000)
def _book_parts(names: tuple[str, ...]) -> list[Member]:
    """The parts of a spreadsheet file that say what sheets it has."""
    spread = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    number = list(enumerate(names, 1))
    named = lambda template: "".join(template.format(i=i, name=escape(name, {'"': "&quot;"})) for i, name in number)
    types = named('<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
    listed = named('<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>')
    related = named(f'<Relationship Id="r{{i}}" Type="{office}/worksheet" Target="worksheets/sheet{{i}}.xml"/>')
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{spread}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">{related}</Relationships>',
    }
    return [deflated(name, _XML + text) for name, text in parts.items()]


def workbook(rows: list[tuple[int, int, object]] | dict[str, list[tuple[int, int, object]]]) -> bytes:
    """A minimal spreadsheet file of (row, column, value) cells, by sheet name or of one sheet, by the standard library alone."""
    sheets = rows if isinstance(rows, dict) else {"Sheet1": rows}

    def cell(r: int, c: int, v: object) -> str:
        if isinstance(v, (int, float)):
            return f'<c r="{_letters(c)}{r + 1}"><v>{v}</v></c>'
        return f'<c r="{_letters(c)}{r + 1}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def data(cells: list[tuple[int, int, object]]) -> str:
        by_row: dict[int, list[str]] = {}
        for r, c, v in sorted(cells, key=lambda x: x[:2]):
            by_row.setdefault(r, []).append(cell(r, c, v))
        return "".join([f'<row r="{r + 1}">{"".join(found)}</row>' for r, found in by_row.items()])

    spread = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    told = [deflated(f"xl/worksheets/sheet{i}.xml", f'{_XML}<worksheet xmlns="{spread}"><sheetData>{data(cells)}</sheetData></worksheet>') for i, cells in enumerate(sheets.values(), 1)]
    return zipped([*_book_parts(tuple(sheets)), *told])


def workbooks(cells: DataFrame, by: str) -> DataFrame:
    """One spreadsheet file for each document from its output cells (row, col, text, num, and sheet if there are several); a document's cells are bounded by its sheets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = []
            for found in batch["found"]:
                sheets: dict[str, list[tuple[int, int, object]]] = {}
                for x in found:
                    if x["num"] is not None or x["text"] is not None:
                        sheets.setdefault(x["sheet"], []).append((x["row"], x["col"], x["text"] if x["num"] is None else float(x["num"])))
                raw.append(workbook(sheets or {"Sheet1": []}))
            yield pd.DataFrame({by: batch[by], "file": raw, "cells": batch["found"].map(len)})

    sheet = F.col("sheet") if "sheet" in cells.columns else F.lit("Sheet1").alias("sheet")
    grouped = cells.select(by, sheet, "row", "col", "text", "num").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("sheet", "row", "col", "text", "num"))).alias("found"))
    return grouped.mapInPandas(run, f"{by} {cells.schema[by].dataType.simpleString()}, file binary, cells long")


def archive(files: DataFrame, name: str, group: str) -> DataFrame:
    """One ZIP for each group of files (name, file), which one task holds: groups are to be as large as a user takes home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            zips = []
            for found in batch["found"]:
                zips.append(zipped([stored(x["name"], bytes(x["file"])) for x in found]))
            yield pd.DataFrame({group: batch[group], "zip": zips, "files": batch["found"].map(len)})

    grouped = files.select(group, F.col(name).alias("name"), "file").groupBy(group).agg(F.array_sort(F.collect_list(F.struct("name", "file"))).alias("found"))
    return grouped.mapInPandas(run, f"{group} {files.schema[group].dataType.simpleString()}, zip binary, files long")


#: Groups whose archives are in one batch of results.
ARCHIVES_AT_ONCE = 200


def book_archives(docs: DataFrame, name: str, group: str) -> DataFrame:
    """group, zip, files: one ZIP for each group with a spreadsheet file for each document (name, cells: an array of row, col, text, num).

    Documents are dealt once, as cells; files are made where their archive is, so that no file is shuffled. A group is one task's, as in ``archive``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ARCHIVES_AT_ONCE):
                some = batch.slice(at, ARCHIVES_AT_ONCE)
                found = some.column(1).flatten()
                cells = found.field("cells").flatten()
                told = zip(*[cells.field(f).to_numpy(zero_copy_only=False).tolist() for f in ("row", "col")], *[cells.field(f).to_pylist() for f in ("text", "num")])
                files = []
                for called, n in zip(found.field("name").to_pylist(), found.field("cells").value_lengths().to_pylist()):
                    own = [next(told) for _ in range(n)]
                    files.append(stored(called, workbook([(r, c, text if num is None else num) for r, c, text, num in own if num is not None or text is not None])))
                zips, end, many = [], 0, some.column(1).value_lengths().to_pylist()
                for n in many:
                    zips.append(zipped(files[end : end + n]))
                    end += n
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(zips, pa.binary()), pa.array(many, pa.int64())], [group, "zip", "files"])

    grouped = docs.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "cells"))).alias("found"))
    return grouped.mapInArrow(run, f"{group} {docs.schema[group].dataType.simpleString()}, zip binary, files long")


def listed(archives: DataFrame, group: str) -> DataFrame:
    """group, name, cells of the workbooks in each archive, read from its bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, raw in zip(batch[group], batch["zip"]):
                for name, book in unzipped(bytes(raw)):
                    out.append((key, name, sum(part.count(b"<c r=") for _, part in unzipped(book, "xl/worksheets/"))))
            yield pd.DataFrame(out, columns=[group, "name", "cells"])

    return archives.select(group, "zip").mapInPandas(run, f"{group} {archives.schema[group].dataType.simpleString()}, name string, cells long")


def title_row(columns: Sequence[str]) -> list:
    """Header labels of a typed sheet."""
    return [V.title(F.lit(c)) for c in columns]
