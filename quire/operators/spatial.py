"""Printed pages to cells: words with their places to lines, columns and labels, and from there to a template's cells.

words(page, text, x0, x1, top), pages(page, template_id, width), cells(template_id, r, c, value), groups(template_id, g, label_col,
value_col), items(template_id, g, r, label): the rows of a group that have an answer; widths(template_id, widths).
Everything of one page is bounded by that page: windows and groups are by page, templates are joined to pages. Columns are windows; the
lines of a page and the cells they give are settled in its row, by a small function in Arrow batches.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Set

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import values as V

GAP, MARGIN, SPANNING, BUCKET = 20, 12, 0.6, 4
ALIKE, HEADING = 0.5, 0.45


def norm(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(x), r"\s+", " "))


def clusters(words: DataFrame, pages: DataFrame) -> DataFrame:
    """page, k (from 1), x0, x1: columns of words, left to right; a gap of over ``GAP`` beyond what came before begins one, words wider than ``SPANNING`` of the page are left out."""
    narrow = words.join(pages.select("page", "width"), "page").filter(F.col("x1") - F.col("x0") <= F.col("width") * SPANNING)
    w = Window.partitionBy("page").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = narrow.withColumn("new", F.when(F.col("x0") - reach <= GAP, 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("page", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def bands(words: DataFrame, pages: DataFrame, cells: DataFrame, groups: DataFrame, widths: DataFrame) -> DataFrame:
    """page, template_id, col, x0, x1, how: where a page has the columns of its template.

    Clusters take the columns by rank if there are as many of both; else a column lies where its width puts it, all widths being
    scaled to the page, and where the template has no width for it, in equal parts of the page.
    """
    columns = groups.select("template_id", F.explode(F.array("label_col", "value_col")).alias("col")).distinct().groupBy("template_id").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    shape = columns.join(widths, "template_id", "left").join(cells.groupBy("template_id").agg((F.max("c") + 1).alias("n")), "template_id", "left").withColumn("widths", F.coalesce("widths", F.array().cast("array<double>")))
    found = clusters(words, pages).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("k", "x0", "x1"))).alias("seen"))
    page = pages.join(shape, "template_id").join(found, "page")
    each = page.select("page", "template_id", "width", "seen", "widths", "n", (F.size("seen") == F.size("cols")).alias("by_rank"), F.posexplode("cols").alias("rank", "col"))
    total = F.aggregate("widths", F.lit(0.0), lambda a, x: a + x)
    upto = lambda k: F.aggregate(F.slice("widths", F.lit(1), k), F.lit(0.0), lambda a, x: a + x) / F.when(total == 0, 1.0).otherwise(total) * F.col("width")
    part = F.col("width") / F.coalesce("n", F.lit(4))
    own = F.get("seen", F.col("rank"))
    low = F.when(F.col("by_rank"), own.x0).when(F.col("col") < F.size("widths"), upto(F.col("col"))).otherwise(F.col("col") * part)
    high = F.when(F.col("by_rank"), own.x1).when(F.col("col") < F.size("widths"), upto(F.col("col") + 1)).otherwise((F.col("col") + 1) * part)
    how = F.when(F.col("by_rank"), "rank").when(F.col("col") < F.size("widths"), "width").otherwise("part")
    return each.select("page", "template_id", "col", low.alias("x0"), high.alias("x1"), how.alias("how"))


def layouts(cells: DataFrame, groups: DataFrame, items: DataFrame) -> DataFrame:
    """Of each group: expected (labels of its items with their rows), total_row, header_row, and spans of blank rows between two labels."""
    filled = cells.select("template_id", F.col("c").alias("label_col"), "r", V.strip(F.coalesce("value", F.lit(""))).alias("v")).filter("v != ''")
    labels = groups.join(filled, ["template_id", "label_col"], "left").groupBy("template_id", "g", "label_col", "value_col").agg(F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "v")))).alias("labels"))
    wanted = items.groupBy("template_id", "g").agg(F.array_sort(F.collect_list(F.struct("r", "label"))).alias("items"))
    both = labels.join(wanted, ["template_id", "g"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<r:int,label:string>>")))
    cell = lambda i: F.coalesce(F.get(F.filter("labels", lambda x: x.r == i.r), F.lit(0)).v, i.label)
    named = F.filter(F.transform("items", lambda i: F.struct(i.r.alias("r"), norm(cell(i)).alias("norm"))), lambda x: x.norm != "")
    last = F.coalesce(F.array_max(F.transform("items", lambda i: i.r)), F.lit(0))
    after = F.get(F.filter("labels", lambda x: x.r > last), F.lit(0))
    before = F.filter("labels", lambda x: x.r < F.array_min(F.transform("items", lambda i: i.r)))
    gaps = F.filter(F.transform("labels", lambda x, i: F.struct(x.r.alias("r"), x.v.alias("v"), F.get("labels", i + 1).alias("next"))), lambda s: (s.next.r - s.r >= 2) & ~F.lower(s.v).contains("total"))
    spans = F.transform(gaps, lambda s: F.struct(s.r.alias("r"), V.words(norm(s.v)).alias("w"), s.next.r.alias("until"), V.words(norm(s.next.v)).alias("next_w")))
    shaped = both.withColumn("named", named)
    # of equal labels the last one counts, in the place of the first
    keep = F.transform(F.array_distinct(F.transform("named", lambda x: x.norm)), lambda n: F.struct(n.alias("norm"), V.words(n).alias("w"), F.array_max(F.transform(F.filter("named", lambda x: x.norm == n), lambda x: x.r)).alias("r")))
    return shaped.select("template_id", "g", "label_col", "value_col", keep.alias("expected"), F.when(F.lower(after.v).contains("total"), after.r).alias("total_row"), F.element_at(F.transform(F.when(F.size(before) > 0, before), lambda x: x.r), -1).alias("header_row"), spans.alias("spans"))


# -- one page ------------------------------------------------------------------------------------------------------------------

_WS = " \t\n\x0b\f\r"
_NUMBER, _BLANKS, _CELLS = re.compile(r"[$\-()]?[0-9,]+(?:\.[0-9]{1,2})?\)?[\n\r\x85\u2028\u2029]?\Z"), re.compile(r"\s+", re.ASCII), "array<struct<ref:string,value:string>>"


def _signed(x: str) -> str:
    """As ``V.signed``."""
    t = x.strip(_WS)
    bare = t.replace(",", "").replace("$", "")
    return "-" + bare.replace("(", "").replace(")", "").strip(_WS) if t[:1] == "(" and t[-1:] == ")" and len(t) > 1 else bare.strip(_WS)


@functools.lru_cache(1 << 14)
def _spoken(label: str) -> tuple[str, frozenset[str]]:
    """A label as ``norm`` makes it, and its words."""
    whole = _BLANKS.sub(" ", label.upper()).strip(" ")
    return whole, frozenset(w for w in _BLANKS.split(whole) if w)


def _alike(a: Set[str], b: Set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def _printed(words: list[tuple], bands: list[tuple]) -> dict[float, dict[int, tuple[str | None, str | None]]]:
    """Of each line from the top its columns: the label, words that are no numbers, and the value, the last number."""
    found: dict[float, dict[int, tuple[list, list]]] = {}
    for text, x0, x1, line in words:
        figure = None
        for col, low, high in bands:
            if x0 >= low and x1 <= high:
                if figure is None:
                    figure = _NUMBER.match(text.replace(" ", "")) is not None
                found.setdefault(line, {}).setdefault(col, ([], []))[figure].append((x0, x1, text))
    return {line: {col: (" ".join([w[2] for w in sorted(said)]) if said else None, _signed(max(figures)[2]) if figures else None) for col, (said, figures) in found[line].items()} for line in sorted(found)}


def _page_cells(lines: dict[float, dict[int, tuple[str | None, str | None]]], groups: list[dict]) -> dict[tuple[int, int], str]:
    """(r, c) and value of the cells that a page's lines give its template; what is written later counts."""
    out: dict[tuple[int, int], str] = {}
    for g in groups:
        label_col, value_col, total_row = g["label_col"], g["value_col"], g.get("total_row")
        told = []
        for line, cols in lines.items():
            label = cols[label_col][0] if label_col in cols else None
            if label is not None:
                told.append((line, label, cols[value_col][1] if value_col in cols else None, *_spoken(label)))
        if "header_row" in g:
            out[g["header_row"], value_col] = ""
        for _, _, value, whole, own in told:
            if value is None:
                continue
            row = total_row if total_row is not None and whole.startswith("TOTAL") else None
            if row is None:
                best = ALIKE
                for e in g["expected"]:
                    score = 2.0 if e["norm"] == whole else _alike(e["w"], own)
                    if score >= ALIKE and (row is None or score > best):
                        best, row = score, e["r"]
            if row is not None:
                out[row, value_col] = value
        for s in g["spans"]:
            out[s["r"], value_col] = ""
            start, end = (min((x[0] for x in told if _alike(w, x[4]) >= HEADING), default=None) for w in (s["w"], s["next_w"]))
            if start is not None:
                inside = [x for x in told if x[0] > start and (end is None or x[0] < end) and x[2] is not None and not x[3].startswith(("TOTAL", "SUBTOTAL"))]
                for r, x in enumerate(inside[: s["until"] - s["r"] - 1], s["r"] + 1):
                    out[r, label_col], out[r, value_col] = x[1], x[2]
    return out


def _layout(text: str) -> list[dict]:
    """The groups of a template in order, words as sets."""
    groups = sorted(json.loads(text), key=lambda g: g["g"])
    for g in groups:
        for x in (*g["expected"], *g["spans"]):
            x |= {k: frozenset(x[k]) for k in ("w", "next_w") if k in x}
    return groups


def _ref(r: int, c: int) -> str:
    return (chr(c + 65) if c < 26 else chr(c // 26 + 64) + chr(c % 26 + 65)) + str(r + 1)


def _cells(words: pa.Array, bands: pa.Array, layouts_: pa.Array) -> pa.Array:
    """The cells of pages, one page after the other; ``words`` and ``bands`` are read as flat columns."""
    coded = layouts_.dictionary_encode()
    known = [_layout(x) for x in coded.dictionary.to_pylist()]
    word, band = words.flatten(), bands.flatten()
    numbers = lambda x, name: pc.struct_field(x, name).to_numpy(zero_copy_only=False).astype(float)
    line = np.nan_to_num(np.rint(numbers(word, "top") / BUCKET) * BUCKET, nan=-np.inf)
    said = list(zip(pc.struct_field(word, "text").to_pylist(), numbers(word, "x0").tolist(), numbers(word, "x1").tolist(), line.tolist()))
    columns = list(zip(pc.struct_field(band, "col").to_pylist(), (numbers(band, "x0") - MARGIN).tolist(), (numbers(band, "x1") + MARGIN).tolist()))
    refs, values, ends, i, j = [], [], [0], 0, 0
    for n, m, which in zip(pc.list_value_length(words).to_pylist(), pc.list_value_length(bands).to_pylist(), coded.indices.to_pylist()):
        found = _page_cells(_printed([w for w in said[i : i + n] if w[0] is not None], columns[j : j + m]), known[which])
        refs.extend([_ref(*at) for at in found])
        values.extend(found.values())
        ends.append(len(refs))
        i, j = i + n, j + m
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(refs, pa.string()), pa.array(values, pa.string())], ["ref", "value"]))


def extract(words: DataFrame, pages: DataFrame, cells: DataFrame, groups: DataFrame, items: DataFrame, widths: DataFrame) -> DataFrame:
    """page, ref, value: what the words of a page say for its template's cells; cleared cells are empty.

    A line with a label and a value in a group's columns goes to the row of its label, which is equal or half alike; a line that begins
    with TOTAL goes to the group's total row, where it has one. Blank rows below a label are filled with the lines between that label
    and the next one on the page. Cells beside headings are cleared. Groups are taken in order, lines from the top; what comes later counts.
    """
    columns = bands(words, pages, cells, groups, widths).groupBy("page", "template_id").agg(F.collect_list(F.struct("col", "x0", "x1")).alias("bands"))
    said = words.groupBy("page").agg(F.collect_list(F.struct("text", "x0", "x1", "top")).alias("words"))
    layout = layouts(cells, groups, items)
    whole = layout.groupBy("template_id").agg(F.to_json(F.collect_list(F.struct(*[c for c in layout.columns if c != "template_id"]))).alias("layout"))
    each = said.join(columns, "page").join(F.broadcast(whole), "template_id")
    return each.select("page", F.explode_outer(F.arrow_udf(_cells, _CELLS)("words", "bands", "layout")).alias("x")).filter("x IS NOT NULL").select("page", "x.ref", "x.value")
