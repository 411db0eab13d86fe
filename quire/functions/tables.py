"""Table functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.sources.files import PAGE_BREAK


class PagesToLines:
    """``pages_to_lines(text)``: page_no, line_no and line of every line that is not blank, pages parted by the page-break line."""

    def eval(self, text: str | None) -> Iterator[tuple[int, int, str]]:
        for page_no, page in enumerate((text or "").split(PAGE_BREAK), 1):
            for line_no, line in enumerate(page.split("\n"), 1):
                if line.strip():
                    yield page_no, line_no, line


def register(spark: SparkSession) -> None:
    spark.udtf.register("pages_to_lines", udtf(PagesToLines, returnType="page_no int, line_no int, line string"))
