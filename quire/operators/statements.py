"""Statements in running text: their sections and totals, and the blank rows of a template that they fill.

A template is a relation of cells(template_id, r, c, value) with column groups(template_id, g, label_col, value_col). Blank rows of
two or more between two labels of a group are a zone. A statement is one row, and a state (the open zone) goes through its lines:
Python does that in Arrow batches, where a line that recurs is read once. With functions on arrays `e8_section_parse` took some three times the task time.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.registry import STEMS

ZONE = "struct<zone:string,label_col:int,value_col:int,first_row:int,slots:int,header_row:int,next_row:int>"
TOTALS = ["total", "grand total", "subtotal", "final total"]


def norm(x: Column) -> Column:
    """Words in small letters, everything else a blank."""
    return V.strip(F.regexp_replace(F.lower(F.regexp_replace(x, r"(?U)[^\w\s]", " ")), r"\s+", " "))


# -- templates ----------------------------------------------------------------------------------------------------------------


def template_zones(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """template_id, zones (by group, then row) and finals ((r, c) of cells called final or grand total, by row)."""
    filled = cells.select("template_id", "r", "c", V.strip(F.coalesce("value", F.lit(""))).alias("v")).filter("v != ''")
    w = Window.partitionBy("template_id", "g").orderBy("r")
    pairs = groups.join(filled.withColumnRenamed("c", "label_col"), ["template_id", "label_col"]).withColumn("next_row", F.lead("r").over(w)).withColumn("next", F.lead("v").over(w))
    total, next_total = F.lower("v").isin(TOTALS), F.lower("next").isin(TOTALS)
    spans = pairs.filter((F.col("next_row") - F.col("r") >= 3) & ~(total & next_total))
    zone = F.struct(F.when(total, F.col("next")).otherwise(F.col("v")).alias("zone"), "label_col", "value_col", (F.col("r") + 1).alias("first_row"), (F.col("next_row") - F.col("r") - 1).alias("slots"), F.when(total, F.col("next_row")).otherwise(F.col("r")).alias("header_row"), "next_row").cast(ZONE)
    zones = spans.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r", zone.alias("z")))), lambda x: x.z).alias("zones"))
    finals = filled.filter(norm(F.col("v")).isin("final total", "grand total")).groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("finals"))
    return zones.join(finals, "template_id", "left").select("template_id", "zones", F.coalesce("finals", F.array().cast("array<struct<r:int,c:int>>")).alias("finals"))


# -- sections -----------------------------------------------------------------------------------------------------------------


def with_names(rows: DataFrame) -> DataFrame:
    """Rows with zones get what is compared of their names: _zones (each name once, with its words), _known (all their words), _names (as JSON), and by zone
    _norms and _alike, its similarity to each of _zones, null where word counts differ by more than 0.7. Templates are few: it is for them, before documents join."""
    read = lambda names: F.transform(F.transform(names, lambda z: F.struct(z.alias("zone"), norm(z).alias("norm"))), lambda z: F.struct(z.zone.alias("zone"), z.norm.alias("norm"), F.array_distinct(F.split(z.norm, " ")).alias("w")))
    names = F.transform("zones", lambda z: z.zone)
    named = rows.withColumns({"_zones": read(F.array_distinct(names)), "_all": read(names)})
    alike = F.transform("_all", lambda z: F.transform("_zones", lambda s: F.when(V.count_ratio(z.w, s.w) >= 0.7, V.jaccard(z.w, s.w))))
    return named.withColumns({"_known": F.array_distinct(F.flatten(F.transform("_zones", lambda z: z.w))), "_names": F.to_json(F.transform("_zones", lambda z: z.zone)), "_norms": F.transform("_all", lambda z: z.norm), "_alike": alike}).drop("_all")


_WS = " \t\n\x0b\f\r"
_SPACES = frozenset("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
_LINE = re.compile(r"([^\n\r\x85\u2028\u2029]*?)[ \t\n\x0b\f\r]+\(?\$?(-?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{0,2})?)\)?([\x85\u2028\u2029]?)\Z")
_PLAIN, _BLANKS, _IN_BRACKETS = re.compile(r"[^A-Za-z0-9_\s]+", re.ASCII), re.compile(r"\s+", re.ASCII), re.compile(r"\(\$?[0-9,]+(?:\.[0-9]{1,2})?\)")
_NO_CAPITALS, _NO_SMALL = str.maketrans("", "", string.ascii_uppercase), str.maketrans("", "", string.ascii_lowercase)


class _Line(NamedTuple):
    """What a line says by itself: the zone it could open, and what it is inside of one."""

    best: int | None
    spoken: list[int]
    closes: bool
    total: bool
    item: bool
    label: str
    value: str
    grand: str | None
    plain: str


def _of_word(c: str) -> bool:
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Me", "Mc", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9" or "\U0001f130" <= c <= "\U0001f149" or "\U0001f150" <= c <= "\U0001f169" or "\U0001f170" <= c <= "\U0001f189"


def _norm(x: str) -> str:
    """As ``norm``."""
    if x.isascii():
        return " ".join(_PLAIN.sub(" ", x).lower().split())
    return _BLANKS.sub(" ", "".join(c if c in _SPACES or _of_word(c) else " " for c in x).lower()).strip(_WS)


def _share(x: str) -> float:
    """Share of capitals among ASCII letters, 0 without letters."""
    capitals, small = len(x) - len(x.translate(_NO_CAPITALS)), len(x) - len(x.translate(_NO_SMALL))
    return capitals / (capitals + small) if capitals else 0.0


def _stem(small: str) -> str | None:
    for s in STEMS:
        if s in small:
            return s
    return None


def _read(line: str, norms: list[str], zones: list[set[str]], known: set[str]) -> _Line | None:
    """None for a line that says nothing. What few lines need is asked for only where a cheap sign of it is there."""
    m = _LINE.match(line)
    label = m[1].strip(_WS).rstrip(":").strip(_WS) if m else ""
    plain = (m[2] + m[3]).replace(",", "") if m else ""
    low = line.lower()
    # words are pieces of a line in ASCII, so one without a piece of them has neither a zone's word nor a kind of account
    words = _norm(line) if not line.isascii() or any([w in low for w in known]) or _stem(low) else None
    own = set() if words is None else set(words.split(" "))
    best, most = None, 0.0
    if not known.isdisjoint(own):
        for i, z in enumerate(zones):
            both, n, many = len(z & own), len(z), len(own)
            if both and min(n, many) / max(n, many) >= 0.7 and (score := both / (n + many - both)) >= 0.5 and score > most:
                best, most = i, score
    kind = _stem(words.lower()) if words and "&" not in line else None
    loud = (kind is not None or not m) and _share(line) > 0.5
    spoken = [i for i, z in enumerate(norms) if kind in z] if kind and loud else []
    small, counts = label.lower(), label != ""
    summed = _norm(label) if "total" in small or "sum" in small or "aggregate" in small else ""
    total = counts and summed != "" and (summed in ("total", "grand total", "subtotal") or summed.startswith("total ") or "subtotal" in summed)
    value = "-" + plain if "(" in line and m and not plain.startswith("-") and _IN_BRACKETS.search(line) else plain
    less = not total and label[:5].lower() in ("less:", "less ", "less-") and not value.startswith("-")
    grand = _stem(summed.lower()) if summed and counts and _share(label) >= 0.6 and summed not in norms else None
    closes = not m and loud
    if best is None and not (spoken or closes or counts):
        return None
    return _Line(best, spoken, closes, total, counts and not total, label, "-" + value if less else value, grand, plain)


class _Reader:
    """Statements for one list of zones. Headings and totals recur from one statement to the next, so what a line says is kept, for up to ``MOST`` lines."""

    MOST = 50_000

    def __init__(self, names: list[str], compares: bool) -> None:
        self.names, self.norms, self.lines = names, [_norm(n or "") for n in names], {}
        self.zones = [set(n.split(" ")) for n in self.norms]
        self.known = set().union(*self.zones) if compares else set()

    def line(self, text: str) -> _Line | None:
        if len(self.lines) >= self.MOST:
            self.lines.clear()
        stripped = text.strip(_WS)
        self.lines[text] = said = _read(stripped, self.norms, self.zones, self.known) if stripped and not stripped.startswith("---") else None
        return said

    def statement(self, text: str) -> tuple[dict[int, int], dict[int, list[_Line]], dict[int, str], list[_Line]]:
        """Of the zones that open: where, their items and totals; and the grand totals."""
        opened, items, totals, grand, here, known = {}, {}, {}, [], None, self.lines
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        for at, raw in enumerate(text.replace("\x01", " ").split("\n")):
            x = known[raw] if raw in known else self.line(raw)
            if x is None:
                continue
            target, spoken, closes, total, item, _, value, summed, _ = x
            if summed is not None:
                grand.append(x)
            if target is None and spoken:
                target = next((z for z in spoken if z not in items), None)
            if target is not None:
                here = target
                if here not in opened:
                    opened[here] = at
            elif here is None:
                continue
            elif closes or total:
                if total:
                    totals[here] = value
                here = None
            elif item:
                if here in items:
                    items[here].append(x)
                else:
                    items[here] = [x]
        return opened, items, totals, grand


SAID = "struct<sections:array<struct<zone:string,opened:int,items:array<struct<label:string,value:string>>,total:string>>,grand:array<struct<stem:string,value:string>>>"


def _said(texts: pa.Array, zones: pa.Array, speaks: pa.Array) -> pa.Array:
    """What statements say (``SAID``), read one after the other into flat columns; ``zones`` has lists of names as JSON."""
    lists = zones.dictionary_encode()
    names = [json.loads(x) for x in lists.dictionary.to_pylist()]
    readers = [(_Reader(n, False), _Reader(n, True)) for n in names]
    zone, opened, labels, values, total, stems, grands, sections_, entries, sums = [], [], [], [], [], [], [], [0], [0], [0]
    for text, which, near in zip(texts.to_pylist(), lists.indices.to_pylist(), speaks.to_pylist()):
        at, items, totals, grand = readers[which][near].statement(text or "")
        for i, name in enumerate(names[which]):
            zone.append(name)
            opened.append(at.get(i))
            total.append(totals.get(i))
            if i in items:
                labels.extend([x[5] for x in items[i]])
                values.extend([x[6] for x in items[i]])
            entries.append(len(labels))
        for x in grand:
            stems.append(x.grand)
            grands.append(x.plain)
        sections_.append(len(zone))
        sums.append(len(stems))
    text, number, struct, listed = pa.string(), pa.int32(), pa.StructArray.from_arrays, pa.ListArray.from_arrays
    item = listed(pa.array(entries, number), struct([pa.array(labels, text), pa.array(values, text)], ["label", "value"]))
    section = struct([pa.array(zone, text), pa.array(opened, number), item, pa.array(total, text)], ["zone", "opened", "items", "total"])
    grand = struct([pa.array(stems, text), pa.array(grands, text)], ["stem", "value"])
    return struct([listed(pa.array(sections_, number), section), listed(pa.array(sums, number), grand)], ["sections", "grand"])


def sections(docs: DataFrame) -> DataFrame:
    """Documents with text and zones (array<struct<zone, ...>>) get sections, one for each name of a zone in their order, and grand.

    A section is struct(zone, opened (a number that orders the zones by where they first open; null for never), items
    (array of label and value), total). ``grand`` has the lines in capitals that carry a total: their stem and value.

    A line like a zone's name (word sets similar by 0.5, word counts by 0.7) opens it; so does a line in capitals, without
    an ampersand, that speaks of the same kind of account, for the first such zone without items. Both go before amounts. In an open
    zone a total is kept and closes it, and so does a line in capitals without an amount. Amounts in brackets and of labels that begin
    with "less" are negative. Blank lines and those that begin with three dashes are passed over. Documents without a word of a zone's
    name are not compared with zones.
    """
    named = docs if "_alike" in docs.columns else with_names(docs)
    speaks = F.arrays_overlap("_known", F.split(norm(F.coalesce("text", F.lit(""))), " "))
    read = F.arrow_udf(_said, SAID)("text", F.coalesce("_names", F.lit("[]")), F.coalesce(speaks, F.lit(True)))
    return named.withColumn("_said", read).select(*docs.columns, "_said.sections", "_said.grand")


# -- filling a template ---------------------------------------------------------------------------------------------------------


def _chosen(alike: Column, sections_: Column) -> Column:
    """For each zone the place of the section that fills it: the most similar one (0.6) that is opened and not yet used; -1 if none or empty."""

    def step(used: Column, scores: Column) -> Column:
        scored = F.transform(sections_, lambda s, i: F.struct(F.when(s.opened.isNotNull() & ~F.array_contains(used, i), F.get(scores, i)).alias("score"), (-s.opened).alias("first"), F.size(s["items"]).alias("n"), i.alias("at")))
        best = F.array_max(F.filter(scored, lambda s: s.score >= 0.6))
        return F.concat(used, F.array(F.when(best.n > 0, best["at"]).otherwise(F.lit(-1))))

    return F.aggregate(alike, F.array().cast("array<int>"), step)


def fill(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ref, value: the cells that a parsed statement (``sections``, with zones and finals) gives its template.

    A zone's heading has its value cell cleared, its items go to the blank rows in order (what is over is left out), its
    total to the row after them. A grand total goes beside the cell called so in the row that follows all zones of its
    kind, if they agree on one row; the first such line counts. What is written later replaces what was.
    """
    cell = lambda r, c, value: F.struct(V.cell_ref(r, c).alias("ref"), value.alias("value"))
    none = F.array().cast("array<struct<ref:string,value:string>>")
    named = parsed if "_alike" in parsed.columns else with_names(parsed)
    chosen = named.withColumn("_chosen", _chosen(F.col("_alike"), F.col("sections")))

    def zone_cells(z: Column, i: Column) -> Column:
        at = F.get("_chosen", i)
        placed = F.when(at >= 0, F.slice(F.get("sections", at)["items"], 1, z.slots)).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
        slots = F.flatten(F.transform(placed, lambda x, k: F.array(cell(z.first_row + k, z.label_col, x.label), cell(z.first_row + k, z.value_col, x.value))))
        own = F.get(F.filter("sections", lambda s: s.zone == z.zone), F.lit(0))
        total = F.filter(F.array(F.coalesce(own.total, F.when(at >= 0, F.get("sections", at).total))), lambda x: x.isNotNull())
        return F.concat(F.array(cell(z.header_row, z.value_col, F.lit(""))), slots, F.transform(total, lambda x: cell(z.next_row, z.value_col, x)))

    def grand_cells(g: Column) -> Column:
        rows = F.array_distinct(F.filter(F.transform("zones", lambda z, i: F.when(F.get("_norms", i).contains(g.stem), z.next_row)), lambda r: r.isNotNull()))
        finals = F.slice(F.filter("finals", lambda f: f.r == F.get(rows, F.lit(0))), 1, 1)
        return F.when(F.size(rows) == 1, F.transform(finals, lambda f: cell(f.r, f.c + 1, g.value))).otherwise(none)

    # the first grand total of a cell counts, and of all that is written to a cell the last: both are the first from the end
    written = F.concat(F.flatten(F.transform("grand", grand_cells)), F.reverse(F.flatten(F.transform("zones", zone_cells))))
    every = chosen.select(*keys, written.alias("_cells")).withColumn("_refs", F.transform("_cells", lambda x: x.ref))
    first = F.filter("_cells", lambda x, i: F.array_position("_refs", x.ref) == i + 1)
    # outer: else Spark would test the arrays for rows before it makes them, and so make them twice
    return every.select(*keys, F.explode_outer(first).alias("x")).filter("x IS NOT NULL").select(*keys, "x.ref", "x.value")
