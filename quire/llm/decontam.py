"""Benchmark decontamination by Wu-Manber search over word sequences.

Test strings are the windows of ``window`` consecutive words of each item (an item of fewer words is one
window). Symbols are words. For every window length there is a searcher with a shift table over blocks of two
words: a block that no test string holds lets the search skip the whole window less one word, and a block at the
end of some test string selects that suffix-hash bucket, whose strings are compared directly, byte by byte.
Many pieces of the text are searched at once, one lane of a numpy array for each.

The items are cut into segments, dealt to blocks of about ``BLOCK_BYTES`` by a hash, and each block's tables are built
in a task of its own and written to the shared folder; items pass neither through the driver nor as a broadcast. A
search task reads one block's tables at a time and lets go of them before the next: a block of 4 MB of words makes
about 32 MB of tables, whatever the number of items. With one block only, a task keeps it.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import NON_ALNUM, Words, carried, chunks, mix, shared_dir, with_carried

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Words of a segment; the segments of an item overlap by a window less one word.
SEGMENT = 1 << 14
_SLOT_BITS = range(12, 22)
_LANE = 96
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


class Searcher:
    """Wu-Manber tables for test strings of one length, in words.

    The strings lie in ``text``, words parted by a blank: string s begins at word ``begin[s]`` and its items are
    ``items[of[s]:of[s + 1]]``. ``at`` has where each word begins, ``hashes`` the words' hashes.
    """

    NAMES = ("text", "at", "hashes", "begin", "of", "items")

    def __init__(self, length: int, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, begin: np.ndarray, of: np.ndarray, items: np.ndarray) -> None:
        self.length, self.text, self.at, self.hashes, self.begin, self.of, self.items = length, text, at, hashes, begin, of, items
        self.span = 2 if length > 1 else 1
        bits = min(max(int(len(begin)).bit_length() + 2, _SLOT_BITS[0]), _SLOT_BITS[-1])
        self.right = np.uint64(64 - bits)
        most = length - self.span + 1
        self.shift = np.full(1 << bits, most, np.int16)
        for j in range(self.span - 1, length):
            np.minimum.at(self.shift, self._slot(hashes, begin + j), np.int16(length - 1 - j))
        last = self._slot(hashes, begin + length - 1).astype(np.int32)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.first = np.searchsorted(last[self.order], np.arange((1 << bits) + 1)).astype(np.int32)

    def _slot(self, h: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The table slot of the block of words that ends at word p."""
        left = h[p - 1] if self.span == 2 else h[p]
        return (mix(left * _A + h[p] * _B) >> self.right).astype(np.int64)

    def string(self, s: int) -> bytes:
        a = int(self.begin[s])
        return self.text[self.at[a] : self.at[a + self.length] - 1].tobytes()

    def find(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, test string) of every occurrence that lies inside one row."""
        low, high = words.rows[:-1] + self.length - 1, words.rows[1:]
        long = high > low
        low, high = low[long], high[long]
        pieces = -(-(high - low) // _LANE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        p = np.repeat(low, pieces) + nth * _LANE
        end = np.minimum(p + _LANE, np.repeat(high, pieces))
        found = []
        while len(p):
            step = self.shift[self._slot(h, p)]
            if (stop := step == 0).any():
                found.append(p[stop])
            p = p + np.maximum(step, 1)
            go = p < end
            p, end = p[go], end[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p = np.concatenate(found)
        slot = self._slot(h, p)
        many = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        at = np.repeat(self.first[slot].astype(np.int64), many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        string, start = self.order[at].astype(np.int64), np.repeat(p, many) - self.length + 1
        for j in range(self.length):
            same = h[start + j] == self.hashes[self.begin[string] + j]
            string, start = string[same], start[same]
        sure = np.fromiter((words.joined(a, a + self.length) == self.string(s) for a, s in zip(start.tolist(), string.tolist())), bool, len(start))
        return start[sure], string[sure]

    def items_of(self, s: int) -> list[int]:
        return self.items[self.of[s] : self.of[s + 1]].tolist()


def segments(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, size (words of a window), words (lower case, parted by blanks): the items in overlapping segments; an item without an id or a word has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, bounds in chunks(batch.column(1)):
                words = Words(data, bounds, NON_ALNUM)
                out: list[tuple[int, int, str]] = []
                for k, (a, b) in enumerate(zip(words.rows[:-1].tolist(), words.rows[1:].tolist())):
                    item = batch.column(0)[low + k].as_py()
                    if item is None or a == b:
                        continue
                    size = min(window, b - a)
                    for at in range(a, b - size + 1, SEGMENT):
                        out.append((item, size, words.joined(at, min(at + SEGMENT + size - 1, b)).decode()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string()))], names=["item", "size", "words"])

    return items.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "item long, size int, words string")


def build(items: Sequence[int], sizes: Sequence[int], texts: pa.Array) -> list[Searcher]:
    """Searchers for the windows of segments; equal windows are one string with all its items."""
    out = []
    sizes, items = np.asarray(sizes, np.int64), np.asarray(items, np.int64)
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        data, bounds = joined(texts.take(pa.array(mine)))
        words = Words(data, bounds, NON_ALNUM)
        many = np.diff(words.rows) - size + 1
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(words.rows[:-1], many) + nth
        item = np.repeat(items[mine], many)
        h = words.hashes()
        whole = np.zeros(len(begin), np.uint64)
        for j in range(size):
            whole = mix(whole * _A + h[begin + j])
        at = np.r_[words.starts, words.ends[-1:] + 1]
        order = np.lexsort((item, whole))
        begin, item, whole = begin[order], item[order], whole[order]
        same = np.r_[False, whole[1:] == whole[:-1]]
        text = lambda i: words.lower[at[begin[i]] : at[begin[i] + size] - 1].tobytes()  # noqa: E731,B023
        for i in np.flatnonzero(same).tolist():
            same[i] = text(i) == text(i - 1)
        head = np.flatnonzero(~same)
        # of the items of one string each counts once
        keep = np.r_[True, (item[1:] != item[:-1]) | ~same[1:]]
        of = np.r_[0, np.cumsum(np.add.reduceat(keep.astype(np.int64), head))]
        out.append(Searcher(size, words.lower, at, h, begin[head].astype(np.int32), of.astype(np.int32), item[keep]))
    return out


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts with a blank behind each, and their bounds; words of two texts never touch."""
    parts = [x.as_buffer() for x in texts.cast(pa.binary())]
    size = np.array([len(p) + 1 for p in parts], np.int64)
    return np.frombuffer(b" ".join([*map(bytes, parts), b""]), np.uint8), np.r_[0, np.cumsum(size)]


def packed(searchers: list[Searcher]) -> bytes:
    out = io.BytesIO()
    np.savez(out, lengths=np.array([s.length for s in searchers]), **{f"{name}{i}": getattr(s, name) for i, s in enumerate(searchers) for name in Searcher.NAMES})
    return out.getvalue()


def unpacked(raw: bytes) -> list[Searcher]:
    with np.load(io.BytesIO(raw)) as z:
        return [Searcher(int(n), *(z[f"{name}{i}"] for name in Searcher.NAMES)) for i, n in enumerate(z["lengths"])]


def write_blocks(items: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> list[str]:
    """Build the tables of all blocks in the shared folder; the URIs of their files."""
    spark = items.sparkSession
    base = f"{shared_dir(spark)}/decontam-{uuid.uuid4().hex}"
    segments(items, id_col, text_col, window).distinct().write.parquet(f"{base}/segments")
    cut = spark.read.schema("item long, size int, words string").parquet(f"{base}/segments")
    total = cut.agg(F.sum(F.octet_length("words").cast("long"))).first()[0]
    if not total:
        return []
    many = -(-total // limit)

    def run(table: pa.Table) -> pa.Table:
        raw = packed(build(table.column("item").to_numpy(), table.column("size").to_numpy(), table.column("words").combine_chunks()))
        return pa.table({"block": table.column("block")[:1], "tables": pa.array([raw], pa.binary())})

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(many)))
    dealt.groupBy("block").applyInArrow(run, "block long, tables binary").write.partitionBy("block").parquet(f"{base}/blocks")
    return sorted(spark.read.parquet(f"{base}/blocks").inputFiles())


def load_block(uri: str) -> list[Searcher]:
    store, path = fs.FileSystem.from_uri(uri)
    return unpacked(pq.read_table(path, filesystem=store, columns=["tables"], partitioning=None).column("tables")[0].as_py())


class Blocks:
    """The blocks' searchers one after the other; only a single one is kept."""

    def __init__(self, uris: list[str]) -> None:
        self.uris, self.held = uris, None

    def __iter__(self) -> Iterator[Searcher]:
        if len(self.uris) == 1:
            self.held = self.held or load_block(self.uris[0])
            yield from self.held
            return
        for uri in self.uris:
            yield from load_block(uri)


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: Sequence[str] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and the columns to carry under ``in_`` names.

    Null and empty texts have no words. Rows with equal ids are judged each by itself; a null id stays null.
    No items, or items without words, hit nothing. Other columns of either table are not read. A text is held whole,
    with some 40 bytes for each of its words; the search reads every block for every Arrow batch.
    """
    uris = write_blocks(items, item_col, item_text, window, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(uris)
        for batch in batches:
            ids, out = batch.column(0), {k: [] for k in ("n_words", "n_hit", "items")}
            for low, high, data, bounds in chunks(batch.column(1), 1 << (20 if len(uris) < 2 else 23)):
                words = Words(data, bounds, NON_ALNUM)
                h = words.hashes()
                inside = np.zeros(len(h) + 1, np.int32)
                hit_items: dict[int, set[int]] = {}
                for s in blocks:
                    start, string = s.find(words, h)
                    np.add.at(inside, start, 1)
                    np.add.at(inside, start + s.length, -1)
                    for row, k in zip((np.searchsorted(words.rows, start, side="right") - 1).tolist(), string.tolist()):
                        hit_items.setdefault(row, set()).update(s.items_of(k))
                hits = np.r_[0, np.cumsum(np.cumsum(inside[:-1]) > 0)]
                out["n_words"] += np.diff(words.rows).tolist()
                out["n_hit"] += (hits[words.rows[1:]] - hits[words.rows[:-1]]).tolist()
                out["items"] += [hit_items.get(i, set()) for i in range(high - low)]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(map(len, out["items"]), pa.int64()), pa.array(map(digest, out["items"]), pa.string()), pa.array([n > 0 for n in out["n_hit"]], pa.bool_()), pa.array(map(sorted, out["items"]), pa.list_(pa.int64())), *batch.columns[2:]],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *more],
            )

    rows = docs.select(F.col(id_col), F.col(text_col), *carried(docs, carry))
    more = rows.columns[2:]
    return rows.mapInArrow(search, with_carried("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>", rows, more))
