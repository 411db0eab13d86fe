"""Media columns: Netpbm and BMP to numpy arrays, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
WIDTH = 24
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


class MediaError(ValueError):
    """Bytes that are no whole image of a known format."""


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """Bytes as the samples of an 8-bit grey image, ``width`` samples to a row."""
    if len(payload) % width:
        raise MediaError(f"{len(payload)} bytes are no whole rows of {width}")
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def decode(media: bytes) -> np.ndarray:
    """Height x width (x 3) samples of a Netpbm image (P1 to P6) or an uncompressed BMP of 8, 24 or 32 bits."""
    if media[:2] == b"BM":
        return _bmp(media)
    if len(media) > 2 and media[:1] == b"P" and media[1:2] in b"123456":
        return _netpbm(media)
    raise MediaError("neither Netpbm nor BMP")


def _netpbm(media: bytes) -> np.ndarray:
    kind, at, head = int(media[1:2]), 2, []
    while len(head) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(media, at)
        if m is None or not m[1].isdigit():
            raise MediaError("Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = *head[:2], head[2] if len(head) > 2 else 1
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = int(np.prod(shape))
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n]*", b"", media[at:])
        flat = np.frombuffer(re.sub(rb"\s", b"", body), np.uint8) - 48 if kind == 1 else np.array(body.split(), np.int64)
    elif kind == 4:
        bits = np.unpackbits(np.frombuffer(media, np.uint8, offset=at + 1))
        stride = -(-width // 8) * 8
        flat = bits[: stride * height].reshape(-1, stride)[:, :width].ravel() if len(bits) >= stride * height else bits[:0]
    else:
        flat = np.frombuffer(media, np.uint8 if top < 256 else ">u2", offset=at + 1)
    if len(flat) < count:
        raise MediaError("Netpbm samples missing")
    flat = flat[:count].reshape(shape)
    if kind in (1, 4):
        return ((1 - flat) * 255).astype(np.uint8)
    return flat.astype(np.uint8 if top < 256 else np.uint16, copy=False)


def _bmp(media: bytes) -> np.ndarray:
    if len(media) < 54:
        raise MediaError("BMP header")
    start, size, width, height, _, depth, packed = struct.unpack_from("<I I i i H H I", media, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or height == 0:
        raise MediaError(f"BMP of {depth} bits, compression {packed}")
    stride, rows = -(-width * depth // 32) * 4, abs(height)
    if len(media) < start + stride * rows:
        raise MediaError("BMP samples missing")
    grid = np.frombuffer(media, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * depth // 8]
    grid = grid[::-1] if height > 0 else grid
    if depth == 8:
        colours = np.frombuffer(media, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        image = colours[grid, 2::-1] if len(colours) else grid
        return image[..., 0] if image.ndim == 3 and (image == image[..., :1]).all() else image
    return grid.reshape(rows, width, depth // 8)[..., 2::-1]


def grey(image: np.ndarray) -> np.ndarray:
    """One channel: the integer luma of red, green and blue."""
    return image if image.ndim == 2 else (image.astype(np.int64) @ np.array([299, 587, 114]) // 1000)


def _edges(total: np.ndarray, cells: int, size: int) -> np.ndarray:
    """An integral ``total`` (rows 0 to size) at the edges of ``cells`` equal cells, times ``cells``, exactly."""
    whole, part = np.divmod(np.arange(cells + 1, dtype=np.int64) * size, cells)
    shape = (-1,) + (1,) * (total.ndim - 1)
    return total[whole] * cells + part.reshape(shape) * (total[np.minimum(whole + 1, size)] - total[whole])


def area_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The sum of a grey image over each cell of a height x width grid, times height * width.

    The integral image is taken at the rows of the cells' edges only, so it is as large as the grid's rows, and all
    arithmetic is in whole numbers: cells that cut samples take their exact share.
    """
    rows, cols = image.shape
    need = np.unique(np.minimum(np.add.outer(np.arange(height + 1) * rows // height, [0, 1]).ravel(), rows))
    start = need[:-1]
    bands = np.add.reduceat(image, start, axis=0, dtype=np.int64)
    down = np.zeros((len(need), cols), np.int64)
    np.cumsum(bands, axis=0, out=down[1:])
    whole, part = np.divmod(np.arange(height + 1, dtype=np.int64) * rows, height)
    at, after = np.searchsorted(need, whole), np.searchsorted(need, np.minimum(whole + 1, rows))
    lines = down[at] * height + part[:, None] * (down[after] - down[at])
    across = np.zeros((height + 1, cols + 1), np.int64)
    np.cumsum(lines, axis=1, out=across[:, 1:])
    corner = _edges(across.T, width, cols).T
    return np.diff(np.diff(corner, axis=0), axis=1)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean samples of the cells, rounded half up."""
    if image.ndim == 3:
        return np.stack([resize(image[..., k], height, width) for k in range(image.shape[2])], axis=-1)
    area = image.shape[0] * image.shape[1]
    return ((2 * area_sums(image, height, width) + area) // (2 * area)).astype(image.dtype)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 mean samples is less than its right neighbour."""
    sums = area_sums(grey(image), 8, 9)
    return np.packbits(sums[:, :-1] < sums[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the UTF-8 bytes of each text, filled with 255 to whole units of 576, as a PGM image.

    Null is as empty: one unit of filling. Rows with equal ids stay apart; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                raw = [(x or "").encode() for x in rows.column(1).to_pylist()]
                media = [encode_pgm(x + b"\xff" * (max(1, -(-len(x) // UNIT)) * UNIT - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiles(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size: int = 32) -> DataFrame:
    """doc_id, height, width, dhash, tile (the NPY file of the size x size thumbnail), error; null or bad media give an error only."""

    def one(raw: bytes | None) -> tuple:
        try:
            image = decode(raw or b"")
            return *image.shape[:2], difference_hash(image), npy(resize(image, size, size)), None
        except (MediaError, ValueError, IndexError) as error:
            return None, None, None, None, str(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                got = list(zip(*map(one, rows.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *(pa.array(x, kind) for x, kind in zip(got, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())))], names=["doc_id", "height", "width", "dhash", "tile", "error"])

    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(run, "doc_id long, height int, width int, dhash string, tile binary, error string")


def read_payloads(stored: DataFrame, size: int = 32) -> DataFrame:
    """Decode what ``store_texts`` stored: digests of the samples and of the media, and the difference hash with a digest of the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(2):
                media = raw.as_py()
                image = decode(media)
                payload = image.tobytes()
                tile = npy(resize(image, size, size))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(image)}:{zlib.crc32(tile):08x}"))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
