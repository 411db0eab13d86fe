"""Byte-level text primitives over Arrow string columns, vectorised with numpy.

A chunk is a run of whole rows whose UTF-8 bytes lie in one array, with ``bounds[i]:bounds[i+1]``
the bytes of row i. Rows are never cut, so a chunk is as long as its longest row at least.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

CHUNK = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """True for each byte in the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are what lies between blanks: 0x20 and 0x09-0x0D.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are ASCII digits, a-z (after lower-casing) and every non-ASCII character.
NON_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for runs of whole rows of about ``limit`` bytes."""
    data, offsets = column_bytes(column)
    rows, low = len(offsets) - 1, 0
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        high = min(high, rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown when asked for more."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _PRIME)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """The words of a chunk: byte ranges, 64-bit hashes, and the words of each row as ``rows[i]:rows[i+1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, blank: np.ndarray) -> None:
        self.lower = LOWER[data]
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(blank[self.lower], out=inside[1:-1])
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        here, before = inside[1:], inside[:-1]
        self.starts = np.flatnonzero(here[:n] & (~before[:n] | edge[:n]))
        self.ends = np.flatnonzero(before[1:] & (~here[1:] | edge[1:])) + 1
        self.rows = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        up, down = _POWERS.get(len(self.lower) + 1)
        total = np.zeros(len(self.lower) + 1, np.uint64)
        np.cumsum((self.lower.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def word(self, i: int) -> bytes:
        return self.lower[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j, one blank between two."""
        return b" ".join(self.word(k) for k in range(i, j))


def carried(docs: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns that an operator passes on unchanged, renamed so that they clash with none of its own."""
    return [docs[name].alias(f"in_{name}") for name in names]


def with_carried(schema: str, rows: DataFrame, names: Sequence[str]) -> StructType:
    """An operator's own columns and the carried ones."""
    return StructType([*StructType.fromDDL(schema).fields, *(rows.schema[name] for name in names)])


def bounded_batches(spark) -> None:
    """Arrow batches of a few megabytes, unless the session has its own: by default each task's buffers hold 10,000 texts at both ends."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def remove_folder(spark, path: str) -> None:
    """Delete a folder of intermediate tables, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; set here only where it is unset in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder
