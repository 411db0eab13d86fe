"""Spreadsheet files as a PySpark Python data source, ``format("workbooks")``.

Rows to write are (book, sheet, head, cells): those of a book come together and in order, so a task streams them into one
file after another and holds some ``HELD`` characters of one at a time. A sheet that is full goes on in the next one, under the same
headings. Files are staged by each attempt and get their names when the job commits, so a lost executor or a repeated
task leaves none behind. Folders are reached through pyarrow.fs. Reading gives (book, sheet, row, cells) in Arrow batches; the
plain rows that this writer makes are read as text, all others by an XML parser.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "book string, sheet string, row long, cells array<string>"
#: Rows of a sheet and characters of its name.
MOST_ROWS, MOST_NAME = 1_048_576, 31
SPLIT, TASKS = 128 << 20, 32
#: Characters of a sheet that are held before they are written, bytes read at once, and rows and characters of a batch.
HELD, READ_AT_ONCE, BATCH_ROWS, BATCH_TEXT = 1 << 18, 1 << 20, 10_000, 4 << 20
_SPREAD = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_BEGIN, _END = f'{_HEAD}<worksheet xmlns="{_SPREAD}"><sheetData>', "</sheetData></worksheet>"
_CELL, _CELL_END = '" t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>"
#: Texts with any of these are not written as they are; texts with any of the others are left to the XML parser.
_SPECIAL, _STRANGE = r"[&<>\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]|_x", re.compile("&(?!amp;|lt;|gt;)|[\x00-\x08\x0b-\x1f\ufffe\uffff]")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(book: str) -> str:
    """Books have file names of their own, whatever is in their names."""
    return (quote(book, safe=" ") or "%") + ".xlsx"


def _escaped(text: str) -> str:
    """Signs that XML cannot hold are written by their numbers, as is an underscore that would look like one."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


@cache
def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


@cache
def _column(letters: str) -> int:
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    return column - 1


class _Stream:
    """A file that zipfile writes to without going back."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.write, self.flush, self.close = file.write, file.flush, file.close


class Book:
    """One file while it is written, sheet after sheet. Texts are kept whole, also those over the 32,767 characters that some programs read."""

    def __init__(self, file: pa.NativeFile, most: int) -> None:
        self.file, self.most = _Stream(file), most
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED, compresslevel=1)  # type: ignore[arg-type]
        self.titles: list[str] = []
        self.sheet: str | None = None
        self.head: list[str | None] | None = None
        self.out: Any = None
        self.row, self.held, self.rows = 0, 0, []

    def _open(self, part: int) -> None:
        self._end()
        name = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", self.sheet or "") or "Sheet"
        title = name[:MOST_NAME] if part == 1 else f"{name[: MOST_NAME - 1 - len(str(part))]}_{part}"
        number = len(self.titles)
        while title.lower() in (t.lower() for t in self.titles):
            number += 1
            title = f"{name[: MOST_NAME - 1 - len(str(number))]}_{number}"
        self.titles.append(title)
        self.part, self.row = part, 0
        self.out = self.zip.open(f"xl/worksheets/sheet{len(self.titles)}.xml", "w", force_zip64=True)
        self.rows.append(_BEGIN)

    def _end(self) -> None:
        if self.out is not None:
            self.rows.append(_END)
            self._flush()
            self.out.close()
            self.out = None

    def _flush(self) -> None:
        self.out.write("".join(self.rows).encode())
        self.held, self.rows = 0, []

    def _write(self, cells: list[str | None]) -> None:
        self.row += 1
        told = "".join([f'<c r="{_letters(i)}{self.row}{_CELL}{v}{_CELL_END}' for i, v in enumerate(cells) if v is not None])
        self.rows.append(f'<row r="{self.row}">{told}</row>')
        self.held += len(told)
        if self.held > HELD:
            self._flush()

    def add(self, sheet: str | None, head: bool | None, cells: list[str | None] | None) -> None:
        if self.out is None or sheet != self.sheet:
            self.sheet, self.head = sheet, None
            self._open(1)
        if self.row >= self.most:
            self._open(self.part + 1)
            if self.head is not None:
                self._write(self.head)
        if head and self.row == 0:
            self.head = cells or []
        self._write(cells or [])

    def close(self) -> None:
        if not self.titles:
            self._open(1)
        self._end()
        number = list(enumerate(self.titles, 1))
        name = lambda t: escape(t, {'"': "&quot;"})
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in number)
        sheets = "".join(f'<sheet name="{name(t)}" sheetId="{i}" r:id="r{i}"/>' for i, t in number)
        related = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in number)
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{_SPREAD}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{related}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>',
        }
        for path, text in parts.items():
            self.zip.writestr(path, _HEAD + text)
        self.zip.close()
        self.file.close()


@dataclass
class Written(WriterCommitMessage):
    """Staged files by the names of their books."""

    files: dict[str, str]


def _lists(cells: pa.ListArray) -> Iterator[list[str | None]]:
    """The lists of a batch, empty where they are null, from one array of all their texts, which XML can hold."""
    whole, end = cells.flatten(), 0
    texts = whole.to_numpy(zero_copy_only=False).tolist()
    if pc.any(pc.match_substring_regex(whole, _SPECIAL)).as_py():
        texts = [v and _escaped(v) for v in texts]
    for n in cells.value_lengths().fill_null(0).to_pylist():
        yield texts[end : end + n]
        end += n


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("rows_per_sheet", MOST_ROWS))
        if self.most < 2:
            raise ValueError("a sheet has room for its headings and a row")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        stage = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}"
        store.create_dir(stage, recursive=True)
        files: dict[str, str] = {}
        book, here = None, None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("book", "sheet", "head", "cells")]
            for name, sheet, head, cells in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in columns[:3]], _lists(columns[3])):
                name = name or ""
                if book is None or name != here:
                    if book is not None:
                        book.close()
                    if name in files:
                        raise ValueError(f"the rows of book {name!r} do not come together")
                    files[name], here = f"{stage}/{len(files)}.xlsx", name
                    book = Book(store.open_output_stream(files[name]), self.most)
                book.add(sheet, head, cells)
        if book is not None:
            book.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Publish the staged files; a book that is there already is replaced, and under ``overwrite`` all others go."""
        store, root = filesystem(self.path)
        staged: dict[str, str] = {}
        for m in messages:
            for book, path in (m.files if m is not None else {}).items():
                if book in staged:
                    self.abort(messages)
                    raise ValueError(f"the rows of book {book!r} lie in several partitions")
                staged[book] = path
        store.create_dir(root, recursive=True)
        if self.overwrite:
            kept = set(map(file_name, staged))
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.endswith(".xlsx") and info.base_name not in kept:
                    store.delete_file(info.path)
        for book, path in staged.items():
            store.move(path, f"{root}/{file_name(book)}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = filesystem(self.path)
        stage = f"{root}/_staged-{self.job}"
        if store.get_file_info(stage).type == fs.FileType.Directory:
            store.delete_dir(stage)


@dataclass
class Files(InputPartition):
    paths: list[str]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        """Files together up to ``SPLIT`` bytes, or less so that there are some ``TASKS`` of them."""
        store, root = filesystem(self.path)
        found = sorted((i.path, i.size or 0) for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".xlsx"))
        most = min(SPLIT, sum(size for _, size in found) // TASKS)
        out: list[InputPartition] = []
        paths, size = [], 0
        for path, n in found:
            paths.append(path)
            size += n
            if size > most:
                out.append(Files(paths))
                paths, size = [], 0
        return [*out, Files(paths)] if paths or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        books, sheets, rows, lists, size = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(books, pa.string()), pa.array(sheets, pa.string()), pa.array(rows, pa.int64()), pa.array(lists, pa.list_(pa.string()))], ["book", "sheet", "row", "cells"])

        store, _ = filesystem(self.path)
        for path in partition.paths:
            book = unquote(path.rsplit("/", 1)[1][: -len(".xlsx")])
            book = "" if book == "%" else book
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_SPREAD}}}sheet"):
                    title, part = sheet.get("name"), f"xl/{targets[sheet.get(f'{{{_OFFICE}}}id')]}"
                    for row, cells, n in _any_rows(z, part):
                        books.append(book)
                        sheets.append(title)
                        rows.append(row)
                        lists.append(cells)
                        size += n
                        if len(rows) >= BATCH_ROWS or size > BATCH_TEXT:
                            yield batch()
                            books, sheets, rows, lists, size = [], [], [], [], 0
        if rows:
            yield batch()


def _any_rows(z: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None], int]]:
    """Row numbers, cells and the size of each row of a sheet, as text as far as it has the plain form, then by the parser."""
    done = 0
    with z.open(part) as file:
        for found in _plain_rows(file):
            if found is None:
                break
            yield found
            done += 1
        else:
            return
    with z.open(part) as file:
        for at, (row, cells) in enumerate(sheet_rows(file)):
            if at >= done:
                yield row, cells, sum(map(len, filter(None, cells)))


def _plain_rows(file: Any) -> Iterator[tuple[int, list[str | None], int] | None]:
    """The rows of a sheet as ``Book`` writes them; null, and then nothing more, where it has another form."""
    if file.read(len(_BEGIN)) != _BEGIN.encode():
        yield None
        return
    left, more = b"", b" "
    while more:
        more = file.read(READ_AT_ONCE)
        head, cut, rest = (left + more).rpartition(b"</row>") if more else (left, b"", b"")
        text, left = (head + cut).decode(), rest
        if not more:
            if text != _END:
                yield None
            return
        if _STRANGE.search(text):
            yield None
            return
        for told in text.split("</row>")[:-1]:
            number, opened, cells = told.partition('">')
            number = number[8:] if opened and number.startswith('<row r="') else ""
            found = _plain_cells(cells, number) if number.isdecimal() else None
            if found is None:
                yield None
                return
            yield int(number) - 1, found, len(told)


def _plain_cells(told: str, number: str) -> list[str | None] | None:
    out: list[str | None] = []
    *cells, end = told.split(_CELL_END)
    if end:
        return None
    if "&" not in told and "_x" not in told:
        # no text has another form if they make the same row again
        texts = [cell.partition(_CELL)[2] for cell in cells]
        if "".join([f'<c r="{_letters(i)}{number}{_CELL}{v}{_CELL_END}' for i, v in enumerate(texts)]) == told and told.count("<") == 6 * len(texts):
            return texts  # type: ignore[return-value]
    for cell in cells:
        place, _, text = cell.partition(_CELL)
        letters = place[6 : -len(number)]
        if not (place.startswith('<c r="') and place.endswith(number) and letters.isascii() and letters.isupper() and letters.isalpha()) or "<" in text or _column(letters) < len(out):
            return None
        out += [None] * (_column(letters) - len(out))
        if "&" in text:
            text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
        out.append(_unescaped(text) if "_x" in text else text)
    return out


def _unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def sheet_rows(part: Any) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers from 0 and cells by their places, null where there is none, from the XML of a sheet."""
    steps = ElementTree.iterparse(part, ("start", "end"))
    holder = None
    for event, element in steps:
        if event == "start" and element.tag == f"{{{_SPREAD}}}sheetData":
            holder = element
        if event == "end" and element.tag == f"{{{_SPREAD}}}row":
            cells: list[str | None] = []
            for c in element:
                column = _column(re.match("[A-Z]+", c.get("r"))[0]) + 1  # type: ignore[index, arg-type]
                text = "".join(t.text or "" for t in c.iter() if t.tag in (f"{{{_SPREAD}}}t", f"{{{_SPREAD}}}v"))
                cells += [None] * (column - 1 - len(cells))
                cells.append(_unescaped(text))
            yield int(element.get("r")) - 1, cells
            if holder is not None:
                holder.clear()


class Workbooks(DataSource):
    """Options: path, and for writing rows_per_sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, overwrite)


def write(rows: DataFrame, folder: str, order: list[str], mode: str = "append", **options: Any) -> None:
    """Write rows (book, sheet, head, cells) as a file for each book, its sheets and rows in the given order; a book is one task's, so cut those that are too large for that."""
    rows.sparkSession.dataSource.register(Workbooks)
    placed = rows.repartition("book").sortWithinPartitions("book", *order).select("book", "sheet", "head", "cells")
    placed.write.format("workbooks").options(**{k: str(v) for k, v in options.items()}).mode(mode).save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbooks").load(folder)
