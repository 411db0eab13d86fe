"""Removal of repeated passages with a run-length index (r-index).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Every such
string has an anchor, the smallest hash among its substrings of ``GRAM`` bytes, which depends on the string alone:
equal strings have equal anchors, so only texts around equal anchors need to be compared, and they meet in one place
however far apart their documents are.

1. Blocks of whole documents send the sorted hashes of their anchors to buckets; buckets answer with one bit for each
   hash: whether another document has it too.
2. Blocks send the context of each anchor with that bit (the bytes of all strings whose anchor it is) to the buckets,
   once for equal contexts. Buckets keep distinct contexts with their smallest document and, halving by document order,
   build a run-compressed Burrows-Wheeler transform with the suffix-array samples at run ends over the earlier half and
   stream matching statistics of the later half through it; matches of ``LENGTH`` or more are marked.
3. Blocks remove what is marked in their documents.

An anchor that many blocks have in ever different contexts (a short passage in many surroundings) would bring all these
contexts to one bucket. With its hashes each block sends four bits that tell its contexts apart, so step 1 finds such
anchors (``HOT``), and step 2 deals their contexts anew: a string in which the anchor stands at place 3g to 3g + 2 goes
under g and the 48 bytes that all such strings have in common. Strings that are equal still meet, and what is under one
such key differs in two bytes at either end only, however many surroundings there are.

The text is shuffled once; all three steps read the same exchange. A block holds ``BLOCK_BYTES``, one document, or the
repetitions of one row; a bucket's hashes number about ``BUCKET_ANCHORS`` whatever the input's size, besides one entry
for each block that has a passage. Contexts of a block are one if 64 bits of their hashes and their anchors' agree, and
rows are repetitions if their ids and 64 bits of a hash of their texts agree; buckets compare contexts byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.text import _POWERS, carried, chunks, mix, with_carried

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 2 << 20
BUCKET_ANCHORS = 1 << 18
#: An anchor is hot if so many blocks have it, with so many of 16 signs of their contexts, or if so many have over ``DEEP`` contexts each.
HOT = (64, 12, 16)
DEEP = 64
#: Places of the anchor in a string that go under one key.
NEAR = 3
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = (1 << 24) - (1 << 12)
_LOW = np.uint64((1 << 48) - 1)
_BATCH = 1 << 20
_SYMBOLS = 7
_BITS = np.uint64(9)
_PLACES = np.uint64(1) << (np.arange(_SYMBOLS, dtype=np.uint64) * _BITS)


# -- anchors ------------------------------------------------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    flat = np.ascontiguousarray(data)
    word = lambda at: np.ndarray((n,), "<u8", flat, at, (1,)).copy()
    h = word(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word(8)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += word(16)
    return mix(h)


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, last start, row, anchor's place) of the runs of strings with one anchor, in a chunk of rows."""
    n = len(data) - LENGTH + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if n < 1:
        return none
    h = _grams(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, want = 1, LENGTH - GRAM + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n], least[want - span :][: n])
    place = (least & _PLACE).astype(np.int64)
    size = np.diff(bounds)
    long = size >= LENGTH
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(start):
        return none
    place = place[start]
    new = np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
    row = np.searchsorted(bounds, start, side="right") - 1
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    # least hashes are small: mixed again, they spread over the buckets
    return mix(h[place[first]]), start[first], start[last], row[first], place[first]


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for rows of any length: longer ones are read in segments that overlap by a string less one byte."""
    if len(data) <= _SEGMENT:
        return _runs(data, bounds)
    parts = []
    for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for at in range(a, max(b - LENGTH + 1, a + 1), _SEGMENT - LENGTH + 1):
            end = min(at + _SEGMENT, b)
            h, first, last, _, place = _runs(data[at:end], np.array([0, end - at]))
            parts.append((h, first + at, last + at, np.full(len(h), row), place + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


# -- the index ----------------------------------------------------------------------------------------------------


class RunLengthIndex:
    """The run-compressed BWT of strings in groups, with samples at both ends of every run.

    ``text`` has the strings one after the other as symbols 1 to 256, each closed by 0; ``group`` has the group of every
    place. Symbols of different groups are different, so matches stay within a group.
    """

    def __init__(self, text: np.ndarray, group: np.ndarray) -> None:
        self.words = _packed(text, _SYMBOLS)
        closed = np.flatnonzero(text == 0)
        self.left = closed[np.searchsorted(closed, np.arange(len(text)))] - np.arange(len(text)) + 1
        order = _suffixes(text, group, self.left)
        before = np.where(order > 0, text[order - 1], 0).astype(np.int64)
        symbol = group[order] * 257 + before
        head = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        tail = np.r_[head[1:], len(symbol)] - 1
        self.start, self.symbol = head, symbol[head]
        self.head_at, self.tail_at, self.tail = order[head], order[tail], tail
        sort = np.argsort(self.symbol, kind="stable")
        length = tail - head + 1
        target = np.empty(len(head), np.int64)
        target[sort] = np.cumsum(length[sort]) - length[sort]
        self.shift = target - head
        self.by_symbol = self.symbol[sort] * len(head) + sort
        self.run_of = sort
        self.groups, self.group_run = np.unique(group[order][head], return_index=True)

    def runs(self) -> int:
        return len(self.start)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at two places share, counted up to 56."""
        total, live, most = np.full(len(a), 56), np.arange(len(a)), len(self.words) - 1
        for k in range(0, 56, _SYMBOLS):
            diff = self.words[np.minimum(a[live] + k, most)] ^ self.words[np.minimum(b[live] + k, most)]
            stop = diff != 0
            total[live[stop]] = k + _SYMBOLS - np.searchsorted(_PLACES, diff[stop], side="right")
            live = live[~stop]
            if not len(live):
                break
        return np.minimum(total, np.minimum(self.left[a], self.left[b]) - 1)

    def statistics(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each place of the patterns ``text[begin:end]`` (symbols) the longest match from there on, right to left; lengths over 56 may be told as less, but never as under 51."""
        out = np.zeros(len(text), np.int64)
        by_length = np.argsort(begin - end, kind="stable")
        begin, end, group = begin[by_length], end[by_length], group[by_length]
        size = end - begin
        run = self.group_run[np.searchsorted(self.groups, group)]
        row, at, known = self.start[run].copy(), self.head_at[run].copy(), np.zeros(len(begin), np.int64)
        count = len(self.start)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            place = end[:live] - 1 - step
            want = group[:live] * 257 + text[place]
            run = np.searchsorted(self.start, row[:live], side="right") - 1
            miss = np.flatnonzero(self.symbol[run] != want)
            if len(miss):
                key = want[miss] * count + run[miss]
                nth = np.searchsorted(self.by_symbol, key)
                below, above = np.minimum(nth, count - 1), np.maximum(nth - 1, 0)
                down, up = self.run_of[below], self.run_of[above]
                has_down, has_up = (nth < count) & (self.symbol[down] == want[miss]), (nth > 0) & (self.symbol[up] == want[miss])
                here = at[miss]
                far_down = np.where(has_down, self.common(here, self.head_at[down]), -1)
                far_up = np.where(has_up, self.common(here, self.tail_at[up]), -1)
                use_up = far_up > far_down
                best = np.maximum(far_up, far_down)
                to = np.where(use_up, up, down)
                none = best < 0
                run[miss] = np.where(none, run[miss], to)
                row[miss] = np.where(none, row[miss], np.where(use_up, self.tail[up], self.start[down]))
                at[miss] = np.where(none, at[miss], np.where(use_up, self.tail_at[up], self.head_at[down]))
                known[miss] = np.where(none, -1, np.minimum(known[miss], best))
            ok = known[:live] >= 0
            row[:live] = np.where(ok, row[:live] + self.shift[run], row[:live])
            at[:live] = np.where(ok, at[:live] - 1, at[:live])
            known[:live] += 1
            out[place] = known[:live]
        return out


def _packed(text: np.ndarray, many: int) -> np.ndarray:
    """``many`` symbols from each place on, the first one highest; zeros after the end."""
    padded = np.concatenate([text, np.zeros(many, text.dtype)]).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for k in range(many):
        words = (words << _BITS) | padded[k : k + len(text)]
    return words


def _sorted(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Places in the order of (high, low, place); packed into single numbers where they fit."""
    bits = max(1, int(len(high) - 1).bit_length())
    if int(high.max()).bit_length() + width + bits <= 64:
        packed = (((high.astype(np.uint64) << np.uint64(width)) | low.astype(np.uint64)) << np.uint64(bits)) | np.arange(len(high), dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.lexsort((low, high))


def _suffixes(text: np.ndarray, group: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffixes, each up to its closing 0 (``left`` symbols), in the order of group, symbols, place; by doubling from three symbols on."""
    n, span = len(text), 3
    drop = (np.uint64(span) - np.minimum(left, span).astype(np.uint64)) * _BITS
    high, low = group, (_packed(text, span) >> drop) << drop
    order = _sorted(high, low, 9 * span)
    most, width = int(left.max()), int(n).bit_length()
    while True:
        h, l = high[order], low[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (l[1:] != l[:-1])]
        if span >= most or new.all():
            return order
        high = np.empty(n, np.int64)
        high[order] = np.cumsum(new)
        low = np.zeros(n, np.int64)
        far = np.flatnonzero(left > span)
        low[far] = high[far + span]
        order = _sorted(high, low, width)
        span *= 2


def earlier_matches(contexts: list[bytes], anchor: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
    """For distinct contexts, a bit mask of the strings in each that also lie in a context of the same anchor with a smaller document.

    Contexts of an anchor are ranked by document, equal ones alike; on each level the earlier halves of all groups of
    ranks are indexed together and the later halves streamed, so every two ranks meet once.
    """
    mask = np.zeros(len(contexts), np.uint64)
    order = np.lexsort((first_doc, anchor))
    a, d = anchor[order], first_doc[order]
    new_anchor = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    step = np.r_[True, d[1:] != d[:-1]] if len(a) else new_anchor
    nth = np.cumsum(new_anchor | step)
    rank = np.empty(len(contexts), np.int64)
    number = np.empty(len(contexts), np.int64)
    number[order] = np.cumsum(new_anchor) - 1
    rank[order] = nth - nth[np.flatnonzero(new_anchor)][np.cumsum(new_anchor) - 1] if len(a) else nth
    level = 0
    while len(rank) and (rank >> level).max() > 0:
        side = (rank >> level) & 1
        team = (number << np.int64(32)) | (rank >> (level + 1))
        both = np.intersect1d(team[side == 0], team[side == 1])
        inside = np.isin(team, both)
        if inside.any():
            group = np.searchsorted(both, team)
            base, later = np.flatnonzero(inside & (side == 0)), np.flatnonzero(inside & (side == 1))
            text, begin, end = _joined([contexts[i] for i in base])
            index = RunLengthIndex(text, np.repeat(group[base], end - begin + 1))
            text, begin, end = _joined([contexts[i] for i in later])
            far = index.statistics(text, begin, end, group[later])
            long = np.flatnonzero(far >= LENGTH)
            which = np.searchsorted(begin, long, side="right") - 1
            np.bitwise_or.at(mask, later[which], np.uint64(1) << (long - begin[which]).astype(np.uint64))
        level += 1
    return mask


def _joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the strings, each closed by 0, with their begins and ends."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    end = np.cumsum(size + 1) - 1
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    text[end] = 0
    return text, end - size, end


# -- the three steps ----------------------------------------------------------------------------------------------


def _spread(keys: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as the bytes of their differences, highest bytes first, which compress well."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(step.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def _gather(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    whole = np.zeros((len(planes), 8), np.uint8)
    whole[:, 2:] = planes
    return np.cumsum(whole.view(">u8").ravel().astype(np.uint64))


def _nibbles(values: np.ndarray) -> bytes:
    """Numbers under 16, two to a byte."""
    even = np.concatenate([values, np.zeros(len(values) % 2, np.uint8)])
    return (even[::2] << 4 | even[1::2]).tobytes()


def _from_nibbles(raw: bytes, many: int) -> np.ndarray:
    two = np.frombuffer(raw, np.uint8)
    return np.stack([two >> 4, two & 15], axis=1).ravel()[:many]


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as planes of bytes, highest first, which compress well."""
    return np.ascontiguousarray(values.astype(">i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of numbers, and bytes, as one compressed value."""
    parts = [x if isinstance(x, bytes) else _planes(x) for x in arrays]
    head = np.array([-1 - len(x) if isinstance(x, bytes) else len(x) for x in arrays], "<i8")
    raw = b"".join([np.array([len(arrays)], "<i8").tobytes(), head.tobytes(), *parts])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray | bytes]:
    raw = pa.Codec("zstd").decompress(memoryview(packed)[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    many = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 8 * many, []
    for n in np.frombuffer(raw, "<i8", many, 8).tolist():
        if n < 0:
            out.append(raw[at : at - n - 1])
            at += -n - 1
        else:
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(">i8").ravel().astype(np.int64))
            at += 8 * n
    return out


class Block:
    """The documents of a block, in the order of id and text hash, and the runs of strings in them by anchor."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        table = _in_order(table)
        self.id = table.column("doc").to_numpy()
        self.texts = table.column("raw").combine_chunks() if table.num_rows else pa.array([], pa.binary())
        parts, self.data, self.low = [], [], []
        for low, high, data, bounds in chunks(self.texts, 1 << 18):
            h, first, last, row, place = anchors(data, bounds)
            parts.append((h, first - bounds[row], last - bounds[row], row + low, np.full(len(h), len(self.data)), bounds[row], place - bounds[row]))
            self.data.append(data)
        if not parts:
            parts = [tuple(np.zeros(0, np.int64) for _ in range(7))]
        h, self.first, self.last, self.row, self.chunk, self.base, self.place = (np.concatenate(x) for x in zip(*parts))
        h = h.astype(np.uint64)
        self.bucket, self.key = _home(h, buckets)
        self.order = np.lexsort((self.key, self.bucket))
        b, k = self.bucket[self.order], self.key[self.order]
        new = np.r_[True, (b[1:] != b[:-1]) | (k[1:] != k[:-1])] if len(h) else np.zeros(0, bool)
        self.distinct = np.flatnonzero(new)
        self.nth = np.empty(len(h), np.int64)
        self.nth[self.order] = np.cumsum(new) - 1
        # rows are in the order of ids, and the sort is stable: the first and the last of a key have its extreme ids
        last = np.r_[self.distinct[1:], len(h)] - 1
        doc = self.id[self.row[self.order]] if len(h) else h
        self.several = doc[self.distinct] != doc[last] if len(h) else new
        self.cuts = np.flatnonzero(np.r_[True, b[self.distinct][1:] != b[self.distinct][:-1]]) if len(h) else np.zeros(0, np.int64)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of the distinct anchors, which are in the order of bucket and key."""
        ends = [*self.cuts[1:].tolist(), len(self.distinct)]
        for a, b in zip(self.cuts.tolist(), ends):
            yield int(self.bucket[self.order[self.distinct[a]]]), a, b

    def hashes(self, run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of bytes ``start`` to ``end`` of the row of each run, their number included."""
        out = np.zeros(len(run), np.uint64)
        chunk, base = self.chunk[run], self.base[run]
        for c in np.unique(chunk).tolist():
            on = np.flatnonzero(chunk == c)
            data = self.data[c]
            up, down = _POWERS.get(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
            a, b = base[on] + start[on], base[on] + end[on]
            out[on] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        return out

    def contexts(self, use: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """(run, bucket, key, first start, last start) of the contexts of the runs in ``use``; those of hot anchors are dealt by ``NEAR`` places of the anchor."""
        plain, split = use[~hot], use[hot]
        low, high = self.place[split] - self.last[split], self.place[split] - self.first[split]
        many = high // NEAR - low // NEAR + 1
        of = np.repeat(np.arange(len(split)), many)
        g = low[of] // NEAR + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        near, far = NEAR * g, np.minimum(NEAR * g + NEAR - 1, LENGTH - GRAM)
        run, place = split[of], self.place[split][of]
        core = self.hashes(run, place - near, place + LENGTH - far)
        bucket, key = _home(mix(core + (g + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), buckets)
        first, last = place - np.minimum(far, high[of]), place - np.maximum(near, low[of])
        pairs = ((plain, run), (self.bucket[plain], bucket), (self.key[plain], key), (self.first[plain], first), (self.last[plain], last))
        return tuple(np.concatenate(x) for x in pairs)


def _home(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key) of hashes: the high part times the number of buckets, and the low 48 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), h & _LOW


def _in_order(table: pa.Table) -> pa.Table:
    """Rows in an order that every step finds again; rows that are equal in it are equal in id and text."""
    return table.sort_by([("doc", "ascending"), ("uid", "ascending")])


_ASK = "block long, bucket long, keys binary, several binary, signs binary, deep binary"
_BITS_OF = "block long, bucket long, bits binary"
_CONTEXT = "block long, bucket long, packed binary"
_MARKS = "block long, packed binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns)})


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block, number = Block(table, buckets), table.column("block")[0].as_py()
        rows = []
        if not len(block.key):
            return _table(rows, _ASK)
        every = np.arange(len(block.key))
        mark = block.hashes(every, block.first, block.last + LENGTH)
        by = np.lexsort((mark, block.nth))
        nth, mark = block.nth[by], mark[by]
        head = np.flatnonzero(np.r_[True, nth[1:] != nth[:-1]])
        tail = np.r_[head[1:], len(by)] - 1
        # the least and the greatest hash of an anchor's contexts: alike in blocks that have the same single context
        signs = (mix(mark[head] * np.uint64(0xD1342543DE82EF95) + mark[tail]) >> np.uint64(60)).astype(np.uint8)
        differ = np.cumsum(np.r_[True, (mark[1:] != mark[:-1]) | (nth[1:] != nth[:-1])])
        deep = differ[tail] - differ[head] >= DEEP
        for bucket, a, b in block.by_bucket():
            at = block.order[block.distinct[a:b]]
            rows.append((number, bucket, _spread(block.key[at]), np.packbits(block.several[a:b]).tobytes(), _nibbles(signs[a:b]), np.packbits(deep[a:b]).tobytes()))
        return _table(rows, _ASK)

    return run


def _answer(hot_blocks: int, hot_signs: int, deep_blocks: int):
    """Bits of the hashes that more than one block has, or one block in several documents; after them, where there are any, bits of those that are hot."""

    def run(table: pa.Table) -> pa.Table:
        keys = [_gather(x.as_py()) for x in table.column("keys")]
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(k)].astype(bool) for x, k in zip(table.column(name), keys)])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        # a key that is one block's own, and in several documents there
        twice |= bits("several")
        hot = np.zeros(len(flat), bool)
        head = np.flatnonzero(np.r_[True, ~same])
        many = np.diff(np.r_[head, len(flat)])
        nth = np.repeat(np.arange(len(head)), many)
        deep = np.bincount(nth, bits("deep")[order], len(head)) >= deep_blocks
        wide = np.flatnonzero(many >= hot_blocks)
        if len(wide) or deep.any():
            sign = np.concatenate([_from_nibbles(x.as_py(), len(k)) for x, k in zip(table.column("signs"), keys)])[order]
            on = np.flatnonzero(np.isin(nth, wide))
            distinct = np.bincount(np.unique(nth[on] * 16 + sign[on]) // 16, minlength=len(head))
            hot[order] = ((distinct >= hot_signs) | deep)[nth]
        rows, end = [], 0
        for number, bucket, k in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), keys):
            begin, end = end, end + len(k)
            if twice[begin:end].any():
                rows.append((number, bucket, np.packbits(twice[begin:end]).tobytes() + (np.packbits(hot[begin:end]).tobytes() if hot[begin:end].any() else b"")))
        return _table(rows, _BITS_OF)

    return run


def _contexts(buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table([], _CONTEXT)
        block, number = Block(docs, buckets), docs.column("block")[0].as_py()
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        rows, marks = [], []
        repeated, hot = np.zeros(len(block.distinct), bool), np.zeros(len(block.distinct), bool)
        for bucket, a, b in block.by_bucket():
            if bucket in bits:
                raw, size = np.frombuffer(bits[bucket], np.uint8), -(-(b - a) // 8)
                repeated[a:b] = np.unpackbits(raw[:size])[: b - a]
                if len(raw) > size:
                    hot[a:b] = np.unpackbits(raw[size:])[: b - a]
        use = np.flatnonzero(repeated[block.nth])
        use, bucket, key, start, last = block.contexts(use, hot[block.nth[use]], buckets)
        mark = block.hashes(use, start, last + LENGTH)
        order = np.lexsort((block.id[block.row[use]], mark, key, bucket))
        use, bucket, key, start, last, mark = (x[order] for x in (use, bucket, key, start, last, mark))
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]
        head = np.flatnonzero(new)
        context = np.cumsum(new) - 1
        row, end = block.row[use], last + LENGTH
        doc = block.id[row]
        later = doc > doc[head][context]
        bucket_of = bucket[head]
        for k, (a, b) in enumerate(zip(*_pieces(bucket_of))):
            at = head[a:b]
            begins = block.base[use[at]] + start[at]
            text = b"".join(block.data[c][s:e].tobytes() for c, s, e in zip(block.chunk[use[at]].tolist(), begins.tolist(), (begins + (end - start)[at]).tolist()))
            lo, hi = head[a], head[b] if b < len(head) else len(use)
            mine = np.arange(lo, hi)[~later[lo:hi]]
            # what is later in the block itself needs no answer; it goes along with the first piece
            own = later if k == 0 else np.zeros(0, np.int64)
            rows.append((number, int(bucket_of[a]), _pack(np.diff(key[at].astype(np.int64), prepend=0), doc[at], (last - start)[at].astype(np.uint8).tobytes(), text, np.diff(context[mine] - a, prepend=0), row[mine], start[mine], row[own], start[own], end[own] - start[own])))
        return _table(rows, _CONTEXT)

    return run


def _pieces(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of runs of equal values."""
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return cut.tolist(), [*cut[1:].tolist(), len(values)] if len(cut) else []


def _mark(table: pa.Table) -> pa.Table:
    """Match the contexts of a bucket and tell every block what to remove."""
    texts: list[bytes] = []
    keys, docs, owner, of, rows, starts = [], [], [], [], [], []
    marks: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for n, packed in zip(table.column("block").to_pylist(), table.column("packed")):
        key, doc, size, text, context, row, start, m_row, m_from, m_size = _unpack(packed.as_py())
        ends = np.cumsum(np.frombuffer(size, np.uint8).astype(np.int64) + LENGTH).tolist()
        keys.append(np.cumsum(key).astype(np.uint64))
        docs.append(doc)
        of.append(np.cumsum(context) + len(texts))
        rows.append(row)
        starts.append(start)
        owner.append(np.full(len(row), n))
        texts += [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        if len(m_row):
            marks.setdefault(n, []).append((m_row, m_from, m_from + m_size))
    key, doc, of, row, start, owner = map(np.concatenate, (keys, docs, of, rows, starts, owner))
    # equal contexts of all blocks come together, with the smallest document of each
    number: dict[tuple[int, bytes], int] = {}
    same = np.fromiter((number.setdefault(pair, len(number)) for pair in zip(key.tolist(), texts)), np.int64, len(texts))
    first = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(first, same, doc)
    anchor = np.fromiter((k for k, _ in number), np.uint64, len(number))
    distinct = [t for _, t in number]
    mask = np.zeros(len(distinct), np.uint64)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    order = np.argsort(anchor, kind="stable")
    ids, at = np.unique(anchor[order], return_index=True)
    many = np.diff(np.r_[at, len(order)])
    cut = np.cumsum(size[order])
    begin = 0
    while begin < len(ids):
        stop = begin + 1
        floor = cut[at[begin]] - size[order[at[begin]]]
        while stop < len(ids) and cut[(at[stop] + many[stop]) - 1] - floor <= _BATCH:
            stop += 1
        lot = order[at[begin] : at[stop - 1] + many[stop - 1]]
        lot = lot[np.repeat(many[begin:stop] > 1, many[begin:stop])]
        if len(lot):
            mask[lot] = earlier_matches([distinct[i] for i in lot.tolist()], anchor[lot], first[lot])
        begin = stop
    whole = doc[of] > first[same[of]]
    strings = size[same[of]] - LENGTH + 1
    bits = np.where(whole, (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1), mask[same[of]])
    on = np.flatnonzero(bits)
    full = whole[on] | (bits[on] == (np.uint64(1) << strings[on].astype(np.uint64)) - np.uint64(1))
    parts = [(owner[on[full]], row[on[full]], start[on[full]], start[on[full]] + strings[on[full]] - 1 + LENGTH)]
    some, places = on[~full], np.arange(64, dtype=np.uint64)
    if len(some):
        flag = ((bits[some][:, None] >> places) & np.uint64(1)).astype(np.int8)
        edge = np.diff(np.pad(flag, ((0, 0), (1, 1))), axis=1)
        which, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1]
        parts.append((owner[some[which]], row[some[which]], start[some[which]] + a, start[some[which]] + b - 1 + LENGTH))
    n, u, a, b = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(n, kind="stable")
    for lo, hi in zip(*_pieces(n[by])):
        part = by[lo:hi]
        marks.setdefault(int(n[part[0]]), []).append((u[part], a[part], b[part]))
    return _table([(k, _packed_marks(*(np.concatenate(x) for x in zip(*v)))) for k, v in marks.items()], _MARKS)


def _packed_marks(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    order = np.lexsort((begin, row))
    return _pack(np.diff(row[order], prepend=0), begin[order], end[order] - begin[order])


def _remove(as_text: bool, carry: list[str]):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        got = [_unpack(x.as_py()) for x in marks.column("packed")] or [[np.zeros(0, np.int64)] * 3]
        row, a, size = (np.concatenate(x) for x in zip(*((np.cumsum(r), f, n) for r, f, n in got)))
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], (a + size)[order]
        cuts = np.searchsorted(row, np.arange(docs.num_rows + 1)).tolist()
        # equal rows share what was found for the first of them
        ids, uids = docs.column("doc").to_pylist(), docs.column("uid").to_pylist()
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        span = (0, 0)
        for i, raw in enumerate(docs.column("raw")):
            if not i or (ids[i], uids[i]) != (ids[i - 1], uids[i - 1]):
                j = i
                while j < docs.num_rows and (ids[j], uids[j]) == (ids[i], uids[i]):
                    j += 1
                span = (cuts[i], cuts[j])
            text = raw.as_py()
            kept, removed, spans = text, 0, 0
            if span[0] < span[1]:
                at = np.argsort(a[span[0] : span[1]], kind="stable") + span[0]
                begin, end = a[at], np.maximum.accumulate(b[at])
                fresh = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                begin, end = begin[fresh], end[np.r_[fresh[1:], len(at)] - 1]
                kept = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
                removed, spans = int((end - begin).sum()), len(begin)
            for name, value in zip(out, (len(text), removed, spans, kept.decode("utf-8", "ignore") if as_text else kept)):
                out[name].append(value)
        columns = [docs.column("doc_id"), *(pa.array(x, pa.int64()) for x in list(out.values())[:3]), pa.array(out["kept"], pa.string() if as_text else pa.binary()), *(docs.column(c) for c in carry)]
        return pa.table(dict(zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry], columns)))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), as_text: bool = False, block_bytes: int = BLOCK_BYTES, hot: tuple[int, int, int] = HOT) -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that stay), and the columns to carry under ``in_`` names.

    Null is as empty. Rows with equal ids do not count against each other; a null id is greater than all others.
    Kept bytes may begin or end inside a character; as text, such parts of characters go. Other columns are not read.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"), *carried(docs, carry))
    more = rows.columns[2:]
    total = rows.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    buckets = max(1, -(-total // (BUCKET_ANCHORS * (LENGTH - GRAM + 2) // 2)))
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    rows = rows.select("doc_id", doc.alias("doc"), F.xxhash64(doc, "raw").alias("uid"), "raw", *more)
    # by id and text, so that rows without an id, or with one id, are dealt as well as others
    rows = rows.select(F.pmod("uid", F.lit(blocks)).alias("block"), "doc_id", "doc", "uid", "raw", *more).repartition("block")
    asked = rows.groupBy("block").applyInArrow(_ask(buckets), _ASK)
    answers = asked.groupBy("bucket").applyInArrow(_answer(*hot), _BITS_OF)
    contexts = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_contexts(buckets), _CONTEXT)
    marks = contexts.groupBy("bucket").applyInArrow(_mark, _MARKS)
    return rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove(as_text, more), with_carried(_OUT.replace("binary", "string") if as_text else _OUT, rows, more))
