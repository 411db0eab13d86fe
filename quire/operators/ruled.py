"""Tables on printed pages: from ruling lines that cross, else from words that begin at the same place.

rulings(page, x0, y0, x1, y1) and words(page, text, x0, x1, top, bottom), in points from the top left. Rows come out as (tbl, r, line):
tbl is struct(page, n), the n-th table of a page from the top, r counts rows from zero, and line has a text for each column, null
where no cell begins. Spark brings a page's words and lines together in a row; the steps on places are array operations on all pages of
an Arrow batch at once, so a page is what has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAP, THIN, BUCKET, BLANK, ALIGNED = 4, 2, 4, 10, 3
#: Pairs that are compared at once, and the words and lines of pages that are taken together.
PAIRS, PLACES = 1 << 20, 200_000
_LINE = "array<struct<p:double,low:double,high:double>>"


# -- pages in a row -----------------------------------------------------------------------------------------------------------


def _directions(rulings: DataFrame) -> DataFrame:
    """page, v, h: upright and level lines (p, low, high) of the pages that have both."""
    x, y = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))

    def of(a: str, b: str) -> Column:
        return F.collect_list(F.struct(((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias("p"), F.least(f"{b}0", f"{b}1").alias("low"), F.greatest(f"{b}0", f"{b}1").alias("high"))).cast(_LINE)

    return rulings.filter((x <= THIN) & (y > THIN)).groupBy("page").agg(of("x", "y").alias("v")).join(rulings.filter((y <= THIN) & (x > THIN)).groupBy("page").agg(of("y", "x").alias("h")), "page")


def _in_pieces(batches: Iterator[pa.RecordBatch], lists: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches cut into such with some ``PLACES`` entries of the lists; a larger page is one by itself."""
    for batch in batches:
        size = sum(pc.fill_null(pc.list_value_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in lists)
        part = (np.cumsum(size) - size) // PLACES if len(size) else size
        ends = [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip([0, *ends], ends):
            if b > a:
                yield batch.slice(a, b - a)


def _listed(column: pa.ListArray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray], pa.StructArray]:
    """The row and the numbers of every entry of a list column, and the entries."""
    flat = column.flatten()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), size), [pc.struct_field(flat, n).to_numpy(zero_copy_only=False).astype(float) for n in names], flat


# -- places -------------------------------------------------------------------------------------------------------------------


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _reach(group: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest ``high`` before a row in its group (numbers that ascend); -inf for the first."""
    if not len(high):
        return high
    values, rank = np.unique(high, return_inverse=True)
    most = np.maximum.accumulate(group * len(values) + rank) - group * len(values)
    return np.where(_starts(group), -np.inf, np.concatenate([[-np.inf], values[most[:-1].clip(0)]]))


def _pairs(a: np.ndarray, b: np.ndarray, meet) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of equal keys (``b`` ascends) for which ``meet(i, j)`` holds, compared ``PAIRS`` at a time."""
    low, many = np.searchsorted(b, a), np.searchsorted(b, a, "right") - np.searchsorted(b, a)
    end, out = np.cumsum(many), []
    for start in range(0, int(end[-1]) if len(end) else 0, PAIRS):
        at = np.arange(start, min(start + PAIRS, end[-1]))
        i = np.searchsorted(end, at, "right")
        j = low[i] + at - (end[i] - many[i])
        keep = meet(i, j)
        out.append((i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def _segments(page: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """page, at, low, high of lines of one direction, sorted: places within ``SNAP`` are one, and pieces that touch are one line."""
    order = np.lexsort((p, page))
    page, p, low, high = page[order], p[order], low[order], high[order]
    new = _starts(page)
    new[1:] |= p[1:] - p[:-1] > SNAP
    k, first = np.cumsum(new) - 1, np.flatnonzero(new)
    at = (np.add.reduceat(p, first) / np.diff([*first, len(p)]) if len(p) else p)[k]
    order = np.lexsort((high, low, k))
    page, at, low, high, k = page[order], at[order], low[order], high[order], k[order]
    first = np.flatnonzero(low - _reach(k, high) > SNAP)
    out = page[first], at[first], low[first], np.maximum.reduceat(high, first) if len(first) else high
    order = np.lexsort((out[3], out[2], out[1], out[0]))
    return tuple(x[order] for x in out)


def _cells(v: tuple[np.ndarray, ...], h: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """page, x0, y0, x1, y1 by page, from the top and the left: the smallest rectangle below and right of each crossing whose four sides are ruled."""
    (vpage, vat, vlow, vhigh), (hpage, hat, hlow, hhigh) = _segments(*v), _segments(*h)
    top, left = _pairs(hpage, vpage, lambda i, j: (hat[i] >= vlow[j] - SNAP) & (hat[i] <= vhigh[j] + SNAP) & (vat[j] >= hlow[i] - SNAP) & (vat[j] <= hhigh[i] + SNAP))
    if not len(top):
        return tuple(np.zeros(0, int if n == 0 else float) for n in range(5))
    # crossings along a level line and along an upright one; the nearest others to the right and below, -1 without one
    met = np.sort(top * len(vat) + left)
    along = np.lexsort((left, top))
    top, left = top[along], left[along]

    def after(line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of crossings sorted by line and place, where the first of the same line at a later place is."""
        new = np.flatnonzero(_starts(line, at))
        group = np.cumsum(_starts(line, at)) - 1
        following = np.append(new, len(line))[group + 1]
        inside = following < len(line)
        return np.where(inside & (line[following.clip(0, len(line) - 1)] == line), following, -1)

    next_right = after(top, vat[left])
    right = np.where(next_right >= 0, left[next_right], -1)
    down = np.lexsort((top, left))
    next_below = after(left[down], hat[top[down]])
    under = np.empty(len(top), int)
    under[down] = np.where(next_below >= 0, top[down][next_below], -1)
    open_ = np.flatnonzero((right >= 0) & (under >= 0))
    x, y, r, u = left[open_], top[open_], right[open_], under[open_]
    code = u * len(vat) + r
    closed = met[np.searchsorted(met, code).clip(0, len(met) - 1)] == code
    x2, y2 = np.where(closed, vat[r], np.nan), np.where(closed, hat[u], np.nan)
    if not closed.all():  # a side is missing: sides further away are tried
        crossing = set(met.tolist())
        on, by = np.searchsorted(top, [y[~closed], y[~closed] + 1]).T, left[down]
        for n, (a, b) in zip(np.flatnonzero(~closed), on):
            rights = [q for q in left[a:b] if vat[q] > vat[x[n]]]
            belows = [q for q in top[down][np.searchsorted(by, x[n]) : np.searchsorted(by, x[n] + 1)] if hat[q] > hat[y[n]]]
            ruled = next((hat[q] for q in belows if any(q * len(vat) + z in crossing for z in rights)), None)
            if ruled is not None:
                # pieces of one line lie at the same height, so all of the first height are asked for the nearest right side
                x2[n], y2[n] = min(vat[z] for z in rights if any(hat[q] == ruled and q * len(vat) + z in crossing for q in belows)), ruled
    found = ~np.isnan(x2)
    out = [a[found] for a in (vpage[x], vat[x], hat[y], x2, y2)]
    order = np.lexsort((out[3], out[4], out[1], out[2], out[0]))
    out = [a[order] for a in out]
    return tuple(a[_starts(out[0], out[1], out[2])] for a in out)


# -- words --------------------------------------------------------------------------------------------------------------------


def _joined(text: pa.Array, words: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
    """The texts of each group (numbers that ascend) with blanks between them."""
    known = ~pc.is_null(text).to_numpy(zero_copy_only=False)[words]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[known], minlength=groups))])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), text.take(pa.array(words[known]))), " ")


def _rows(table: np.ndarray, r: np.ndarray, c: np.ndarray, width: np.ndarray, text: pa.Array) -> pa.Array:
    """For each table (0, 1, ...) its rows of texts; ``width`` by table, ``r`` and ``c`` by cell."""
    many = np.zeros(len(width), np.int64)
    np.maximum.at(many, table, r + 1)
    base = np.concatenate([[0], np.cumsum(many * width)])
    at = np.full(base[-1], -1)
    at[base[table] + r * width[table] + c] = np.arange(len(table))
    texts = text.take(pa.array(at, mask=at < 0)).cast(pa.string())
    lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.repeat(width, many))]), pa.int32()), texts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), lines)


def _ruled(cells: tuple[np.ndarray, ...], page: np.ndarray, place: list[np.ndarray], text: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """page, n and rows of the tables of ruled cells; a table ends where no cell goes on below."""
    cpage, cx0, cy0, cx1, cy1 = cells
    new = cy0 - _reach(cpage, cy1) > SNAP
    table = np.cumsum(new) - 1
    tpage = cpage[new]
    n = np.arange(len(tpage)) - np.searchsorted(tpage, tpage) + 1

    def dense(order: np.ndarray, value: np.ndarray) -> np.ndarray:
        step = np.cumsum(_starts(table[order], value[order]))
        out = np.empty(len(order), int)
        out[order] = step - step[np.flatnonzero(_starts(table[order]))][table[order]]
        return out

    r, c = dense(np.arange(len(table)), cy0), dense(np.lexsort((cx0, table)), cx0)
    width = np.zeros(len(tpage), np.int64)
    np.maximum.at(width, table, c + 1)
    # words and cells meet by the bands of their page: a band goes from one upper edge of cells to the next
    edge = _starts(cpage, cy0)
    bpage, by = cpage[edge], cy0[edge]
    values = np.unique(np.concatenate([by, cy1]))
    code = lambda p, y, side: p * (len(values) + 1) + np.searchsorted(values, y, side)
    bcode = code(bpage, by, "right")
    x0, x1, top, bottom = place
    x, y = (x0 + x1) / 2, (top + bottom) / 2
    wband = np.searchsorted(bcode, code(page, y, "right"), "right") - 1
    inside = np.flatnonzero((wband >= 0) & (bpage[wband] == page) & ~np.isnan(y))
    first = np.cumsum(edge) - 1
    many = np.searchsorted(bcode, code(cpage, cy1, "left"), "right") - first
    cell = np.repeat(np.arange(len(cpage)), many)
    band = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many)
    order = np.argsort(band, kind="stable")
    cell, band = cell[order], band[order]
    i, j = _pairs(wband[inside], band, lambda i, j: (x[inside[i]] >= cx0[cell[j]]) & (x[inside[i]] < cx1[cell[j]]) & (y[inside[i]] < cy1[cell[j]]))
    word, own = inside[i], cell[j]
    order = np.lexsort((rank[word], x0[word], np.rint(top[word] / BUCKET), own))
    return tpage, n, _rows(table, r, c, width, _joined(text, word[order], own[order], len(cpage)))


def _aligned(page: np.ndarray, place: list[np.ndarray], text: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """One table a page: words that follow each other by a blank are a phrase, and where ``ALIGNED`` phrases begin is a column; each line is a row."""
    x0, x1, top, _ = place
    line = np.rint(top / BUCKET)
    word = np.lexsort((rank, x1, x0, line, page))
    page, line, x0, x1 = page[word], line[word], x0[word], x1[word]
    phrase = x0 - _reach(np.cumsum(_starts(page, line)), x1) > BLANK
    x, own = x0[phrase], np.cumsum(phrase) - 1
    left = np.lexsort((x, page[phrase]))
    fpage, fx = page[phrase][left], x[left]
    new = _starts(fpage)
    new[1:] |= fx[1:] - fx[:-1] > SNAP
    edge, epage = np.cumsum(new) - 1, fpage[new]
    starts = np.bincount(edge, minlength=len(epage)) >= ALIGNED
    before = np.cumsum(starts) - starts
    upto = before + starts - before[np.searchsorted(epage, epage)]
    column = np.empty(len(x), int)
    column[left] = (upto[edge] - 1).clip(0)
    width = np.bincount(epage, starts, minlength=page.max() + 1 if len(page) else 0).astype(int)
    kept = np.flatnonzero(width[page[phrase]] > 0)
    said = _joined(text, word, own, len(x))
    page, line, c = page[phrase][kept], line[phrase][kept], column[kept]
    cell = _starts(page, line, c)
    tpage, table = np.unique(page[cell], return_inverse=True)
    row = np.cumsum(_starts(page, line)[cell])
    r = row - row[_starts(page[cell])][table] if len(row) else row
    return tpage, np.ones(len(tpage), int), _rows(table, r, c[cell], width[tpage], _joined(said, kept, np.cumsum(cell) - 1, int(cell.sum())))


# -- tables -------------------------------------------------------------------------------------------------------------------


def cells(rulings: DataFrame) -> DataFrame:
    """page, x0, y0, x1, y1: the smallest rectangle below and right of each crossing whose four sides are ruled; a cell that spans columns or rows is one."""
    kind = rulings.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_pieces(batches, ["v", "h"]):
            lines = [(page, *numbers) for page, numbers, _ in (_listed(batch[c], ["p", "low", "high"]) for c in ("v", "h"))]
            page, *sides = _cells(*lines)
            yield pa.RecordBatch.from_arrays([batch["page"].take(pa.array(page)), *map(pa.array, sides)], ["page", "x0", "y0", "x1", "y1"])

    return _directions(rulings).mapInArrow(run, f"page {kind}, x0 double, y0 double, x1 double, y1 double")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _in_pieces(batches, ["words", "v", "h"]):
        found = _cells(*[(page, *numbers) for page, numbers, _ in (_listed(batch[c], ["p", "low", "high"]) for c in ("v", "h"))])
        page, place, words = _listed(batch["words"], ["x0", "x1", "top", "bottom"])
        text = pc.struct_field(words, "text")
        coded = text.dictionary_encode()
        rank = np.empty(len(coded.dictionary) + 1, int)
        rank[:-1][pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
        rank[-1] = -1
        rank = rank[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]
        bare = np.flatnonzero(~np.isin(page, found[0]))
        some = np.flatnonzero(np.isin(page, found[0]))
        parts = []
        if len(found[0]):
            parts.append(_ruled(found, page[some], [x[some] for x in place], text.take(pa.array(some)), rank[some]))
        if len(bare):
            parts.append(_aligned(page[bare], [x[bare] for x in place], text.take(pa.array(bare)), rank[bare]))
        for own, n, rows in parts:
            yield pa.RecordBatch.from_arrays([batch["page"].take(pa.array(own)), pa.array(n, pa.int32()), rows], ["page", "n", "rows"])


def page_rows(words: DataFrame, rulings: DataFrame) -> DataFrame:
    """page, n, rows (array of lines): the ruled tables of pages that have any, and the aligned one of the others."""
    kind = words.schema["page"].dataType.simpleString()
    said = words.groupBy("page").agg(F.collect_list(F.struct("text", "x0", "x1", "top", "bottom")).alias("words"))
    return said.join(_directions(rulings), "page", "full").select("page", "words", "v", "h").mapInArrow(_tables, f"page {kind}, n int, rows array<array<string>>")


def page_tables(words: DataFrame, rulings: DataFrame) -> DataFrame:
    return page_rows(words, rulings).select(F.struct("page", "n").alias("tbl"), F.posexplode("rows").alias("r", "line"))
