"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of ranks (base64 token, rank). Each byte has one printable character; tokens are
written in these characters, and every split of a token into two tokens of lower rank is a merge, in order of
the token's rank, so that the library merges what a rank-based encoder would.

Long texts are cut only before a blank, tab or line end that follows something else, where no match of the pattern can
cross, so a text of any length is encoded in pieces of bounded memory with the same ids. (U+001C to U+001F are white
space to Python but not to the pattern, so nothing is cut before them.)
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import carried, with_carried

PIECE_CHARS = 1 << 18
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def byte_table() -> list[str]:
    """The character of each byte: printable Latin-1 bytes as they are, the rest from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBpe:
    """A tokenizer from a rank file, and the reverse table for decoding."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        chars = byte_table()
        spell = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda pair: pair[1]):
            for i in range(1, len(token)):
                left, right = token[:i], token[i:]
                if ranks.get(left, rank) < rank and ranks.get(right, rank) < rank:
                    merges.append((spell[left], spell[right]))
        self.tokenizer = Tokenizer(models.BPE({spell[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(byte_of[c] for c in spell[token])
        self.digits = [str(i) for i in range(size)]

    def encode(self, texts: list[str], offsets: bool = False) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids and, if asked for, the character range of each token; the tokens of a split character share its range."""
        run = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        out: list[tuple[list[int], list[tuple[int, int]]]] = [([], []) for _ in texts]
        held: list[tuple[int, int, str]] = []
        size = 0

        def flush() -> None:
            for (row, at, _), e in zip(held, run([piece for *_, piece in held], add_special_tokens=False)):
                out[row][0].extend(e.ids)
                if offsets:
                    out[row][1].extend((a + at, b + at) for a, b in e.offsets)
            held.clear()

        for row, text in enumerate(texts):
            for at, piece in pieces(text):
                held.append((row, at, piece))
                size += len(piece)
                if size >= PIECE_CHARS:
                    flush()
                    size = 0
        flush()
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; characters that tokens split come together again."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, cut only where white space follows another character."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield at, text[at:]


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, starts and ends array<int> (character ranges). A null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            got = bpe.encode([x or "" for x in batch.column(1).to_pylist()], offsets=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([[a for a, _ in o] for _, o in got], pa.list_(pa.int32())), pa.array([[b for _, b in o] for _, o in got], pa.list_(pa.int32()))], names=["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes, text (bytes that are no UTF-8 become U+FFFD). Null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            got = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in got], pa.string())], names=["doc_id", "bytes", "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for), from encoding and decoding in one pass, and the columns to carry under ``in_`` names.

    Null is as empty: no tokens, the digests of nothing. Rows with equal ids stay apart; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                got = [ids for ids, _ in bpe.encode([x or "" for x in rows.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).cast(pa.int64()), pa.array(map(len, got), pa.int64()), pa.array([hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest() for ids in got], pa.string()), pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in got], pa.string()), *([pa.array(got, pa.list_(pa.int32()))] if with_ids else []), *rows.columns[2:]],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []), *more],
                )

    source = docs.select(F.col(id_col), F.col(text_col), *carried(docs, carry))
    more = source.columns[2:]
    return source.mapInArrow(run, with_carried("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, source, more))
