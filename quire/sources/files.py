"""File sources: folders of documents, upload limits, text and image files, YAML-like schemas, remote listings."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.functions.registry import FILE_TYPES

PAGE_BREAK = "--- PAGE BREAK ---"
MAX_FILES, MAX_BYTES = 100, 50 << 20


def folder(spark: SparkSession, path: str, extensions: Sequence[str] = tuple(FILE_TYPES)) -> DataFrame:
    """path, length, content of the files with one of the extensions, in either case, each path once. Bytes are read only where ``content`` is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("extension", extension(F.col("path"))).filter(F.col("extension").isin(*extensions)).dropDuplicates(["path"])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_type(path: Column) -> Column:
    """pdf or image by extension; null for others, which go to quarantine instead of ending the batch."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair]), extension(path))


def uploads(files: DataFrame, batch: str, order: str, length: str = "length", path: str = "path") -> DataFrame:
    """``files`` with the reason why an upload is refused, or null: unknown type, too large, too many in its batch (by order)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return files.withColumn("reason", F.when(file_type(F.col(path)).isNull(), "type").when(F.col(length) > MAX_BYTES, "size").when(nth > MAX_FILES, "batch"))


def write_files(files: DataFrame, path: str) -> None:
    """One file for each row (name, content) in a folder that executors share; a task that runs again writes the same files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(bytes(content))
            yield batch[["name"]]

    files.select("name", "content").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()


def text_pages(files: DataFrame) -> DataFrame:
    """path, page_no, page of text files, whose pages are parted by form feeds or by the page-break line."""
    text = F.decode("content", "UTF-8")
    return files.select("path", F.posexplode(F.split(text, rf"\f|\s*{PAGE_BREAK}\s*")).alias("pos", "page")).select("path", (F.col("pos") + 1).alias("page_no"), "page")


def schema_rows(spark: SparkSession, client: str, types: dict) -> DataFrame:
    """A client's declared document types, parsed on the driver, as rows of client, doc_type, section, name, type, required, pos."""
    out = [(client, kind, section, f["name"], f.get("type", "string"), bool(f.get("required", False)), i) for kind, parts in types.items() for section in ("fields", "line_items") for i, f in enumerate(parts.get(section, []))]
    return spark.createDataFrame(out, "client_id string, doc_type string, section string, name string, type string, required boolean, pos int")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, and those of ``table`` whose key it does not have."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


class ListingReader(DataSourceReader):
    """Pages of a remote folder's listing, one partition each; the service is a recorded JSON file here."""

    def __init__(self, options: dict[str, str]) -> None:
        self.pages = json.loads(options.get("pages", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(max(1, len(self.pages)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for entry in self.pages[partition.value] if partition.value < len(self.pages) else []:
            yield entry["id"], entry["name"], entry.get("mimeType"), int(entry.get("size", 0))


class Listing(DataSource):
    """``format("remote_listing")``: all pages of a listing, where the first page alone would lose files."""

    @classmethod
    def name(cls) -> str:
        return "remote_listing"

    def schema(self) -> str:
        return "id string, name string, mime_type string, size long"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)
