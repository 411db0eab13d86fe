"""Page images as columns: size limits, and JPEG where an image library is installed, else PNG; files of other kinds as they are."""

from __future__ import annotations

import base64
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MAX_SIDE, QUALITY = 2048, 85
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class ImageError(ValueError):
    """Bytes that are no image of a known kind."""


def dimensions(raw: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG or JPEG file."""
    if raw[:8] == _SIGNATURE and len(raw) >= 24:
        return struct.unpack_from(">II", raw, 16)
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 <= len(raw) and raw[at] == 0xFF:
        if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return width, height
        at += 2 + struct.unpack_from(">H", raw, at + 2)[0]
    raise ImageError("neither PNG nor JPEG")


def png(image: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 samples of 8 bits."""
    height, width = image.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((height, 1 + width * 3), np.uint8)
    lines[:, 1:] = image.reshape(height, -1)
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """Height x width x 3 samples of a PNG file of 8 bits, grey or colour, not interlaced; opacity is left out."""
    at, data, head = 8, [], None
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += [body] if kind == b"IDAT" else []
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ImageError("PNG of another kind than 8 bits, grey or colour, not interlaced")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as error:
        raise ImageError(str(error)) from error
    if len(flat) != height * (1 + width * n):
        raise ImageError("PNG samples missing")
    lines = flat.reshape(height, -1)
    out = np.zeros((height + 1, width * n + n), np.uint8)
    for y, kind in enumerate(lines[:, 0].tolist()):
        out[y + 1, n:] = _unfiltered(kind, lines[y, 1:], out[y], n)
    image = out[1:, n:].reshape(height, width, n)
    return np.repeat(image[..., :1], 3, axis=2) if n < 3 else image[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line of samples from its differences; ``above`` has the line before, behind n zeros."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above[n:]
    out = [0] * n
    for i, x in enumerate(line.tolist()):
        left, up, corner = out[i], int(above[i + n]), int(above[i])
        if kind == 3:
            guess = (left + up) // 2
        else:
            near = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(near - v))
        out.append((x + guess) & 255)
    return np.array(out[n:], np.uint8)


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """The size within ``most`` on either side whose whole numbers keep the proportions best."""
    if max(width, height) <= most:
        return width, height
    long, short = max(width, height), min(width, height)
    low = most * short // long
    best = min((n for n in (low, low + 1) if n), key=lambda n: abs(long / short - most / n))
    return (most, best) if width >= height else (best, most)


def shrunk(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over equal cells of whole samples."""
    rows, cols = (np.arange(n + 1) * size // n for n, size in ((height, image.shape[0]), (width, image.shape[1])))
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, 3), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    cells = np.diff(np.diff(total[rows][:, cols], axis=0), axis=1)
    return (cells // np.multiply.outer(np.diff(rows), np.diff(cols))[..., None]).astype(np.uint8)


def encode(raw: bytes, max_side: int = MAX_SIDE) -> tuple[str, str]:
    """(base64, kind): RGB within ``max_side``, as JPEG with an image library and as PNG without; a JPEG file stays as it is without one."""
    try:
        from PIL import Image
    except ImportError:
        size = dimensions(raw)
        if raw[:8] != _SIGNATURE:
            return base64.b64encode(raw).decode(), "jpeg"
        image = read_png(raw)
        to = fitted(*size, max_side)
        return base64.b64encode(png(image if to == size else shrunk(image, *to))).decode(), "png"
    image = Image.open(io.BytesIO(raw)).convert("RGB")
    image = image.resize(fitted(*image.size, max_side), Image.Resampling.BOX)
    out = io.BytesIO()
    image.save(out, "JPEG", quality=QUALITY)
    return base64.b64encode(out.getvalue()).decode(), "jpeg"


def page_images(files: DataFrame) -> DataFrame:
    """path, image, kind, width, height, error of image files; bytes that are no image give an error and nothing else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, raw in zip(batch["path"], batch["content"]):
                try:
                    image, kind = encode(bytes(raw))
                    out.append((path, image, kind, *dimensions(base64.b64decode(image)), None))
                except Exception as error:  # noqa: BLE001  any decoder error is the file's
                    out.append((path, None, None, None, None, str(error)))
            frame = pd.DataFrame(out, columns=["path", "image", "kind", "width", "height", "error"])
            yield frame.astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, image string, kind string, width int, height int, error string")
