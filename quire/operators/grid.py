"""Structure of spreadsheet templates, over cells(template, r, c, value, target, span_rows, span_cols).

Rules are windows and groups within a template and never join cells with cells: cells that are dealt by template, as a
parsed sheet's are, stay where they are. A template is one row in one place only for rules that walk its columns in order.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.functions.registry import GENERIC_COLUMNS, SECTIONED

VALUE_WORDS = ["amount", "amt", "value", "total", "balance", "price", "cost", "qty", "quantity", "debit", "credit", "$", "net", "gross", "sum"]
TOTAL_WORDS = ["total", "sum", "subtotal", "grand", "net", "balance", "amount due", "amount payable"]


def parse_cells(sheets: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Cells of grids in JSON (``{"cells": {"r,c": {...}}}``): keys of two whole numbers only; bad JSON has no cells."""
    kind = "struct<cells:map<string,struct<value:string,extractTarget:boolean,mergeSpan:struct<rows:int,cols:int>,mergeParent:string>>>"
    parsed = sheets.select(F.col(id_col).alias("template"), F.explode(F.from_json(json_col, kind)["cells"]).alias("k", "x"))
    at = lambda i: F.get(F.split("k", ","), F.lit(i)).try_cast("int")
    cells = parsed.filter(F.size(F.split("k", ",")) == 2).select("template", at(0).alias("r"), at(1).alias("c"), V.strip(F.coalesce("x.value", F.lit(""))).alias("value"), F.coalesce("x.extractTarget", F.lit(False)).alias("target"), F.coalesce("x.mergeSpan.rows", F.lit(1)).alias("span_rows"), F.coalesce("x.mergeSpan.cols", F.lit(1)).alias("span_cols"), F.col("x.mergeParent").isNotNull().alias("child"))
    return cells.filter("r is not null and c is not null")


def with_neighbours(cells: DataFrame, offsets: dict[str, tuple[int, int]]) -> DataFrame:
    """The cells with a struct (value, target) for each name: the cell dr rows down or dc columns to the right, null where there is none.

    Offsets go along a row or a column. A place has one cell at most, so one that is k places off is among the next k that
    there are: a window over the row or the column finds it, and every offset of a direction shares one exchange.
    """
    row, col = Window.partitionBy("template", "r").orderBy("c"), Window.partitionBy("template", "c").orderBy("r")
    out = cells
    for name, (dr, dc) in offsets.items():
        way, at, far = (row, "c", dc) if dr == 0 else (col, "r", dr)
        step = F.lead if far > 0 else F.lag
        near = [F.when(step(at, k).over(way) == F.col(at) + far, step(F.struct("value", "target"), k).over(way)) for k in range(1, abs(far) + 1)]
        out = out.withColumn(name, F.coalesce(*near))
    return out


def is_label(cell: str = "") -> Column:
    return (F.col(f"{cell}value") != "") & ~F.col(f"{cell}target")


def open_cell(name: str) -> Column:
    """A neighbour that is there and is a target or blank."""
    return F.coalesce(F.col(f"{name}.target") | (F.col(f"{name}.value") == ""), F.lit(False))


def wide_label() -> Column:
    return is_label() & (F.col("span_cols") >= 2)


def header_rows(cells: DataFrame) -> DataFrame:
    """template, r of rows with a wide merged label that is no target."""
    return cells.filter(wide_label()).select("template", "r").distinct()


LABEL_PLACES = {"l1": (0, -1), "l2": (0, -2), "l3": (0, -3), "up": (-1, 0)}


def target_label() -> Column:
    """Of a cell with the neighbours ``LABEL_PLACES``: the first text of theirs, else a name made of the reference."""
    return F.coalesce(*[F.nullif(F.col(f"{n}.value"), F.lit("")) for n in LABEL_PLACES], F.concat(F.lit("field at "), V.cell_ref(F.col("r"), F.col("c"))))


def targets(cells: DataFrame) -> DataFrame:
    """template, ref, r, c, label of blank target cells outside merged header rows: the first text up to three cells to the left, else above, else a name made of the reference."""
    headed = cells.withColumn("headed", F.bool_or(wide_label()).over(Window.partitionBy("template", "r")))
    blank = with_neighbours(headed, LABEL_PLACES).filter("target and value = '' and not headed")
    return blank.select("template", V.cell_ref(F.col("r"), F.col("c")).alias("ref"), "r", "c", target_label().alias("label"))


def pairs(cells: DataFrame) -> DataFrame:
    """template, r, c, label, value_ref of labels whose right neighbour is a target or blank."""
    found = with_neighbours(cells, {"right": (0, 1)}).filter(is_label() & open_cell("right"))
    return found.select("template", "r", "c", F.col("value").alias("label"), V.cell_ref(F.col("r"), F.col("c") + 1).alias("value_ref"))


def is_double() -> Column:
    """Of a cell with the neighbours mid, v1 and v2."""
    return is_label() & F.coalesce((F.col("mid.value") != "") & ~F.col("mid.target"), F.lit(False)) & open_cell("v1") & open_cell("v2")


def double_pairs(cells: DataFrame) -> DataFrame:
    """Two labels and their two value cells in one row."""
    n = with_neighbours(cells, {"mid": (0, 1), "v1": (0, 2), "v2": (0, 3)})
    ref = lambda d: V.cell_ref(F.col("r"), F.col("c") + d)
    return n.filter(is_double()).select("template", "r", F.col("value").alias("left_label"), F.col("mid.value").alias("right_label"), ref(2).alias("left_ref"), ref(3).alias("right_ref"))


def row_facts(cells: DataFrame, rows_above: int = 0, **more: Column) -> DataFrame:
    """template, r, texts (array of c, value, wide), has_target, merged, filled, form (both rows below hold text), head (a table begins, also a merged one), table and what ``more`` counts.

    ``above``: a head is up to ``rows_above`` below and the row holds no target.
    """
    texts = F.array_sort(F.collect_list(F.when(is_label(), F.struct("c", "value", (F.col("span_cols") >= 2).alias("wide")))))
    facts = cells.groupBy("template", "r").agg(texts.alias("texts"), F.bool_or("target").alias("has_target"), F.bool_or(wide_label()).alias("merged"), F.bool_or(F.col("value") != "").alias("filled"), *[x.alias(name) for name, x in more.items()])
    w = Window.partitionBy("template").orderBy("r")
    out = facts.withColumn("form", F.count_if(F.size("texts") > 0).over(w.rangeBetween(1, 2)) == 2)
    out = out.withColumn("head", ~F.col("has_target") & (F.size("texts") >= 2) & ~F.col("form")).withColumn("table", F.col("head") & ~F.col("merged"))
    return out.withColumn("above", ~F.col("has_target") & F.coalesce(F.bool_or("head").over(w.rangeBetween(1, rows_above)), F.lit(False))) if rows_above else out


def tables(cells: DataFrame) -> DataFrame:
    """template, header_row, start_col, end_col, names, section: rows of two or more texts that are no form rows, no merged headers and do not have text in both rows below.

    The section is the nearest label up to two rows above, the first row not among them, that is merged or directly above; else the table's number.
    """
    w = Window.partitionBy("template").orderBy("r")
    before = lambda k: F.struct(F.lag("r", k).over(w).alias("r"), F.lag("texts", k).over(w).alias("texts"))
    heads = row_facts(cells).withColumns({"one": before(1), "two": before(2)}).filter("table")
    heads = heads.select("template", F.col("r").alias("header_row"), F.col("texts")[0]["c"].alias("start_col"), F.element_at("texts", -1)["c"].alias("end_col"), F.transform("texts", lambda t: t["value"]).alias("names"), "one", "two")
    within = lambda t: t["c"].between(F.col("start_col"), F.col("end_col"))
    # texts are in the order of their columns, so the first one that will do is the nearest
    first = lambda name, d, keep: F.when((F.col(f"{name}.r") == F.col("header_row") - d) & (F.col(f"{name}.r") > 0), F.get(F.filter(f"{name}.texts", keep), F.lit(0))["value"])
    wide = lambda t: within(t) & t["wide"]
    number = F.row_number().over(Window.partitionBy("template").orderBy("header_row")).cast("string")
    label = F.coalesce(first("one", 1, within), first("one", 2, wide), first("two", 2, wide), F.concat(F.lit("Table "), number))
    return heads.select("template", "header_row", "start_col", "end_col", "names", label.alias("section"))


def above_headers(cells: DataFrame, rows_above: int) -> DataFrame:
    """template, r of rows with cells up to ``rows_above`` above a table header that hold no target."""
    return row_facts(cells, rows_above).filter("above").select("template", "r")


def section_label_rows(cells: DataFrame) -> DataFrame:
    """Rows with text up to two above a table header that are neither form rows nor headers."""
    w = Window.partitionBy("template").orderBy("r")
    near = F.coalesce(F.bool_or("table").over(w.rangeBetween(1, 2)), F.lit(False))
    return row_facts(cells).withColumn("near", near).filter("near and filled and not has_target and not table and r >= 0").select("template", "r")


def transposed(cells: DataFrame) -> DataFrame:
    """template, start_row, end_row, data_cols where column A has three labels or more and other columns are filled in half of their rows."""
    first = is_label() & (F.col("c") == 0)
    labelled = cells.withColumn("labelled", F.bool_or(first).over(Window.partitionBy("template", "r"))).filter("labelled")
    cols = labelled.groupBy("template", "c").agg(F.count_if(F.col("value") != "").alias("k"), F.count_if(first).alias("n"), F.min(F.when(first, F.col("r"))).alias("start_row"), F.max(F.when(first, F.col("r"))).alias("end_row"))
    filled = F.collect_list(F.when(F.col("c").between(1, 19) & (F.col("k") > 0), F.struct("c", "k")))
    whole = cols.groupBy("template").agg(F.sum("n").alias("n"), F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row"), filled.alias("cols")).filter("n >= 3")
    found = F.array_sort(F.transform(F.filter("cols", lambda x: x["k"] >= F.col("n") * 0.5), lambda x: x["c"]))
    return whole.select("template", "start_row", "end_row", found.alias("data_cols")).filter(F.size("data_cols") > 0)


def alike_bands(bands: Column) -> Column:
    """Two of the bands (label_col, rows) share 40 % of their rows."""
    return F.exists(bands, lambda a: F.exists(bands, lambda b: (a["label_col"] < b["label_col"]) & (V.jaccard(a["rows"], b["rows"]) >= 0.40)))


def parallel_groups(cells: DataFrame) -> DataFrame:
    """template, group_id, label_col, items, section: label columns with three or more pairs, where any two of them share 40 % of their rows; none with under four pairs or one column."""
    pair = with_neighbours(cells, {"right": (0, 1)}).withColumn("pair", is_label() & open_cell("right"))
    # the last label above the first pair of the column
    seen = F.max("pair").over(Window.partitionBy("template", "c").orderBy("r"))
    head = F.max_by("value", F.when(is_label() & ~F.col("seen"), F.col("r")))
    cols = pair.withColumn("seen", seen).groupBy("template", F.col("c").alias("label_col")).agg(F.collect_set(F.when(F.col("pair"), F.col("r"))).alias("rows"), F.count_if("pair").alias("items"), F.when(F.count_if(is_label() & ~F.col("seen")) > 0, head).alias("head"))
    bands = F.array_sort(F.collect_list(F.when(F.col("items") >= 3, F.struct("label_col", "rows", "items", "head"))))
    whole = cols.groupBy("template").agg(bands.alias("bands"), F.sum("items").alias("n")).filter("n >= 4").filter(F.size("bands") >= 2).filter(alike_bands(F.col("bands")))
    out = whole.select("template", F.posexplode("bands").alias("at", "b")).select("template", (F.col("at") + 1).alias("group_id"), "b.label_col", "b.items", "b.head")
    letters = F.concat(F.lit("Group "), F.col("group_id").cast("string"), F.lit(" (columns "), V.column_letters(F.col("label_col")), F.lit("-"), V.column_letters(F.col("label_col") + 1), F.lit(")"))
    return out.select("template", "group_id", "label_col", "items", F.coalesce("head", letters).alias("section"))


def modes(cells: DataFrame) -> DataFrame:
    """template, mode, and the counts it follows from; parallel groups come before everything else."""
    near = with_neighbours(cells, {"right": (0, 1), "mid": (0, 1), "v1": (0, 2), "v2": (0, 3)})
    pair = is_label() & open_cell("right")
    lines = row_facts(near, 4, targets=F.count_if(F.col("target") & (F.col("value") == "")), doubles=F.count_if(is_double()), cols=F.collect_list(F.when(pair, F.col("c"))))
    sums = {"n_targets": F.when(~F.col("merged"), F.col("targets")), "n_pairs": F.when(~F.col("above"), F.size("cols")), "n_double": F.col("doubles"), "n_tables": F.col("table").cast("int"), "pairs": F.size("cols")}
    whole = lines.groupBy("template").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in sums.items()], F.collect_list(F.when(F.size("cols") > 0, F.struct("r", "cols"))).alias("paired"))
    rows_of = lambda c: F.transform(F.filter("paired", lambda x: F.array_contains(x["cols"], c)), lambda x: x["r"])
    each = F.transform(F.array_distinct(F.flatten(F.transform("paired", lambda x: x["cols"]))), lambda c: F.struct(c.alias("label_col"), rows_of(c).alias("rows")))
    out = whole.withColumn("bands", F.when(F.col("pairs") >= 4, F.filter(each, lambda b: F.size(b["rows"]) >= 3)))
    out = out.withColumn("n_groups", F.when(alike_bands(F.col("bands")), F.size("bands")).otherwise(0))
    t, k, d, tab = (F.col(n) > 0 for n in ("n_targets", "n_pairs", "n_double", "n_tables"))
    mode = F.when(F.col("n_groups") > 0, "parallel_groups").when(tab & (t | k), "mixed").when(~tab & t, "form_with_targets").when(~tab & k, "form_kv").when(tab, "table").when(d, "form_kv").otherwise("unguided")
    return out.select("template", "n_targets", "n_pairs", "n_double", "n_tables", "n_groups", mode.alias("mode"))


def context_risk(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """template, risk: financial types with two generic column names, or three generic labels of pairs and targets."""
    generic = lambda x: F.lower(x).rlike("|".join(GENERIC_COLUMNS))
    near = with_neighbours(cells, LABEL_PLACES | {"right": (0, 1)})
    lines = row_facts(near, 4, asked=F.count_if(F.col("target") & (F.col("value") == "") & generic(target_label())), told=F.count_if(is_label() & open_cell("right") & generic(F.col("value"))), named=F.count_if(is_label() & generic(F.col("value"))))
    labels = F.when(~F.col("merged"), F.col("asked")).otherwise(0) + F.when(~F.col("above"), F.col("told")).otherwise(0)
    found = lines.groupBy("template").agg(F.sum(F.when(F.col("table"), F.col("named"))).alias("gc"), F.sum(labels).alias("gl"))
    # templates are many more than their file's size tells: never sent whole to every task
    out = kinds.join(found.hint("merge"), "template", "left")
    return out.select("template", (F.col("kind").isin(SECTIONED) & ((F.coalesce("gc", F.lit(0)) >= 2) | (F.coalesce("gl", F.lit(0)) >= 3))).alias("risk"))


def _places(cells: DataFrame) -> DataFrame:
    """Every place of each template's box, from its first to its last row and column, with the cell's value, target and span_cols, blank where there is none; and again, as ``cover``, those that a merged cell covers.

    Each cell brings the blank places up to the next one, so that the box is made without a join.
    """
    w, whole = Window.partitionBy("template").orderBy("r", "c"), Window.partitionBy("template")
    near = cells.filter("r >= 0 and c >= 0").withColumns({"next": F.lead(F.struct("r", "c")).over(w), "first": F.row_number().over(w) == 1})
    near = near.withColumns({"mr": F.max("r").over(whole), "wide": F.max("c").over(whole).cast("bigint") + 1})
    place = lambda r, c: F.col(r) * F.col("wide") + F.col(c)
    near = near.withColumns({"p": place("r", "c"), "until": F.coalesce(place("next.r", "next.c"), (F.col("mr") + 1) * F.col("wide")) - 1})
    span = lambda n, most: F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.col(n).cast("bigint") - 1, most)).cast("int"))
    under = F.flatten(F.transform(span("span_rows", F.col("mr") - F.col("r")), lambda dr: F.transform(span("span_cols", F.col("wide") - 1 - F.col("c")), lambda dc: -1 - (F.col("p") + dr * F.col("wide") + dc))))
    covers = F.when((F.col("span_rows") > 1) | (F.col("span_cols") > 1), F.filter(under, lambda q: q != -1 - F.col("p"))).otherwise(F.array().cast("array<bigint>"))
    own = F.sequence(F.when(F.col("first"), F.lit(0).cast("bigint")).otherwise(F.col("p")), F.greatest("p", "until"))
    each = near.select("template", "wide", "p", "value", "target", "span_cols", F.explode(F.concat(own, covers)).alias("q"))
    at, here = F.when(F.col("q") < 0, -1 - F.col("q")).otherwise(F.col("q")), F.col("q") == F.col("p")
    each = each.withColumn("at", at)
    return each.select("template", F.expr("cast(at div wide as int)").alias("r"), F.expr("cast(at % wide as int)").alias("c"), F.when(here, F.col("value")).otherwise("").alias("value"), (here & F.col("target")).alias("target"), F.when(here, F.col("span_cols")).otherwise(1).alias("span_cols"), (F.col("q") < 0).alias("cover"))


def full_grid(cells: DataFrame) -> DataFrame:
    """Every cell of each template's box, with blanks where there is none."""
    return _places(cells).filter("not cover").drop("cover")


def roles(cells: DataFrame) -> DataFrame:
    """template, r, c, value, role, head_row, head_text of every cell in the box, one of nine roles; below is the value below it.

    First by columns, then by rows: both are sorts within a task.
    """
    col, row, whole = Window.partitionBy("template", "c").orderBy("r"), Window.partitionBy("template", "r").orderBy("c"), Window.partitionBy("template", "c")
    text = F.col("value") != ""
    g = _places(cells).withColumn("child", F.max("cover").over(Window.partitionBy("template", "c", "r"))).filter("not cover")
    # the topmost text of a column heads it if the cell below is blank or a target
    g = g.withColumns({"below": F.coalesce(F.lead("value").over(col), F.lit("")), "below_target": F.coalesce(F.lead("target").over(col), F.lit(False)), "up": F.coalesce(F.lag("value").over(col), F.lit("")), "before": F.coalesce(F.max(text).over(col.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    blank_below = (F.col("below") == "") | F.col("below_target")
    g = g.withColumns({"heads": text & ~F.col("before") & blank_below, "tall": text | (F.col("up") != "") | (F.col("below") != "")})
    g = g.withColumns({"head_row": F.max(F.when(F.col("heads"), F.col("r"))).over(whole), "head_text": F.max(F.when(F.col("heads"), F.col("value"))).over(whole)})
    g = g.withColumns({"right": F.coalesce(F.lead("value").over(row), F.lit("")), "right_target": F.coalesce(F.lead("target").over(row), F.lit(False)), "left": F.coalesce(F.lag("value").over(row), F.lit("")), "left_heads": F.coalesce(F.lag("heads").over(row), F.lit(False)), "crowd": F.max("tall").over(row.rowsBetween(-1, 1))})
    blank_right = (F.col("right") == "") | F.col("right_target")
    this_row = F.coalesce(F.col("head_row") == F.col("r"), F.lit(False))
    role = (
        F.when(F.col("child"), "merged_child")
        .when(text & (F.col("span_cols") >= 2), "section_header")
        .when(text & this_row, "column_header")
        .when(text & (blank_right | blank_below), "label")
        .when(text, "static_text")
        .when((F.col("left") != "") & ~F.col("left_heads") & ~this_row, "value_target")
        .when((F.col("up") != "") & F.col("head_row").isNull(), "value_target")
        .when(F.coalesce(F.col("head_row") < F.col("r"), F.lit(False)), "table_data")
        .when(~F.col("crowd"), "section_spacer")
        .otherwise("unknown")
    )
    return g.select("template", "r", "c", "value", role.alias("role"), "head_row", "head_text", "below")


def row_sections(cells: DataFrame) -> DataFrame:
    """template, r, section: the text of column A goes on down the rows, where it heads blanks or follows a blank row."""
    first = F.col("c") == 0
    filled = cells.filter("r >= 0 and c >= 0").groupBy("template", "r").agg(F.coalesce(F.max(F.when(first, F.col("value"))), F.lit("")).alias("c0"), F.bool_or((F.col("value") != "") | F.col("target")).alias("content"), F.bool_or(first & F.col("target")).alias("t0"))
    w = Window.partitionBy("template").orderBy("r")
    # each row brings the blank ones up to the next
    span = filled.withColumns({"start": F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("r")), "until": F.coalesce(F.lead("r").over(w) - 1, F.col("r"))})
    every = span.select("template", "c0", "content", "t0", F.col("r").alias("own"), F.explode(F.sequence("start", "until")).alias("r"))
    here = F.col("r") == F.col("own")
    rows_ = every.select("template", "r", F.when(here, F.col("c0")).otherwise("").alias("c0"), (here & F.col("content")).alias("content"), (here & F.col("t0")).alias("t0"))
    opens = (F.coalesce(F.lead("c0").over(w), F.lit("")) == "") | F.coalesce(F.lead("t0").over(w), F.lit(False)) | ~F.coalesce(F.lag("content").over(w), F.lit(False))
    named = rows_.withColumn("named", F.when((F.col("c0") != "") & opens, F.col("c0")))
    return named.select("template", "r", F.coalesce(F.nullif(V.slug(F.last("named", ignorenulls=True).over(w)), F.lit("")), F.lit("section")).alias("section"))


def paired_columns(cells: DataFrame) -> DataFrame:
    """template, vt, td (cells that are value targets and table data), columns (array of c, what stands in it) and pairs (l, v).

    Columns of table data are paired in one fold for each template: a value column with the nearest free one to its
    left, the rest with the next free one.
    """
    has = lambda x, words: reduce(or_, [F.lower(x).contains(w) for w in words])
    data = F.col("role") == "table_data"
    # header rows: a text that is no total and no number, with a blank below
    numeric = F.regexp_replace("value", "[,.$%-]", "").rlike("^[0-9]+$")
    header = (F.col("value") != "") & (F.col("below") == "") & ~has(F.col("value"), TOTAL_WORDS) & ~numeric
    in_col = {"valued": F.coalesce(F.bool_or(data & has(F.col("head_text"), VALUE_WORDS)), F.lit(False)), "rows": F.collect_list(F.when(data, F.col("r"))), "heads": F.collect_list(F.when(header, F.struct(F.col("r").alias("h"), F.col("value").alias("section")))), "totals": F.collect_list(F.when(F.col("role") == "value_target", F.col("r"))), "lh": F.max(F.when(data, F.col("head_text")))}
    cols = roles(cells).groupBy("template", "c").agg(*[x.alias(name) for name, x in in_col.items()])
    whole = cols.groupBy("template").agg(F.sum(F.size("totals")).alias("vt"), F.sum(F.size("rows")).alias("td"), F.array_sort(F.collect_list(F.struct("c", *in_col))).alias("columns"))
    whole = whole.withColumn("cols", F.transform(F.filter("columns", lambda x: F.size(x["rows"]) > 0), lambda x: F.struct(x["c"].alias("c"), x["valued"].alias("valued"))))
    kind = "array<struct<l:int,v:int>>"
    used = lambda acc, c: F.exists(acc, lambda p: p["l"].eqNullSafe(c) | p["v"].eqNullSafe(c))

    def pair_left(acc: Column, x: Column) -> Column:
        free = F.filter("cols", lambda y: (y["c"] < x["c"]) & ~used(acc, y["c"]))
        # null for a value column without a free column to its left: it is used up and makes no group
        return F.when(~x["valued"] | used(acc, x["c"]), acc).otherwise(F.concat(acc, F.array(F.struct(F.array_max(F.transform(free, lambda y: y["c"])).alias("l"), x["c"].alias("v")))))

    def pair_rest(acc: Column, x: Column) -> Column:
        free = F.filter("cols", lambda y: (y["c"] > x["c"]) & ~used(acc, y["c"]))
        return F.when(used(acc, x["c"]), acc).otherwise(F.concat(acc, F.array(F.struct(x["c"].alias("l"), F.array_min(F.transform(free, lambda y: y["c"])).alias("v")))))

    first = whole.withColumn("p", F.aggregate("cols", F.array().cast(kind), pair_left))
    both = first.withColumn("p", F.aggregate("cols", F.col("p").cast(kind), pair_rest))
    return both.select("template", "vt", "td", "columns", F.filter("p", lambda p: p["l"].isNotNull() & p["v"].isNotNull()).alias("pairs"))


def column_groups(cells: DataFrame) -> DataFrame:
    """template, label_col, value_col, start_row, end_row, section, total_row, parallel_id: header rows of a pair's label column cut its rows into sections."""
    pairs_ = paired_columns(cells).select("template", "columns", F.inline("pairs"))
    column = lambda c: F.get(F.filter("columns", lambda x: x["c"] == F.col(c)), F.lit(0))
    both = pairs_.select("template", "l", "v", column("l").alias("left"), column("v").alias("right"))
    # of one row, data come before the header that begins below it
    mark = lambda r, kind, section: F.struct(r.alias("r"), F.lit(kind).alias("kind"), section.cast("string").alias("section"))
    marks = F.concat(F.transform("right.rows", lambda r: mark(r, 0, F.lit(None))), F.transform("right.totals", lambda r: mark(r, 1, F.lit(None))), F.transform("left.heads", lambda x: mark(x["h"], 2, x["section"])))
    each = both.select("template", "l", "v", F.col("left.lh").alias("lh"), F.inline(marks))
    side = Window.partitionBy("template", "l", "v")
    each = each.withColumn("head", F.last(F.when(F.col("kind") == 2, F.struct("r", "section")), ignorenulls=True).over(side.orderBy("r", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    each = each.withColumn("total", F.min(F.when(F.col("kind") == 1, F.col("r"))).over(side.orderBy("r").rangeBetween(1, 3)))
    groups = each.filter("kind = 0").groupBy("template", "l", "v", F.coalesce("head.r", F.lit(-1)).alias("h")).agg(F.min("r").alias("start_row"), F.max("r").alias("end_row"), F.max(F.coalesce("head.section", "lh", F.lit(""))).alias("section"), F.max_by("total", "r").alias("total_row"))
    # a group without a heading is named by its number: pairs in the order of their columns, then from the top
    number = F.row_number().over(Window.partitionBy("template").orderBy("l", "v", "h"))
    groups = groups.withColumn("n", number).withColumn("section", F.when(F.col("section") == "", F.concat(F.lit("section_"), F.col("n").cast("string"))).otherwise(F.col("section")))
    band = Window.partitionBy("template", "start_row", "end_row")
    out = groups.withColumns({"k": F.count("*").over(band), "nth": F.row_number().over(band.orderBy("n"))})
    bands = F.count_if((F.col("k") >= 2) & (F.col("nth") == 1)).over(Window.partitionBy("template").orderBy("start_row", "end_row"))
    return out.withColumn("bands", bands.cast("int")).select("template", F.col("l").alias("label_col"), F.col("v").alias("value_col"), "start_row", "end_row", "section", "total_row", F.when(F.col("k") >= 2, F.col("bands")).alias("parallel_id"))


def open_targets(cells: DataFrame) -> DataFrame:
    """template, r, c of value targets outside the column groups' bands and totals."""
    open_ = roles(cells).filter("role = 'value_target'").select("template", "c", "r", F.lit(0).alias("step"), F.lit(True).alias("asked"))
    # a band adds one from its first row on and takes it back below its last
    step = lambda c, r, by: F.struct(F.col(c).alias("c"), r.alias("r"), F.lit(by).alias("step"))
    band = lambda c, first, last: [step(c, F.col(first), 1), step(c, F.col(last) + 1, -1)]
    steps = F.array(*band("label_col", "start_row", "end_row"), *band("value_col", "start_row", "end_row"), *band("value_col", "total_row", "total_row"))
    bands = column_groups(cells).select("template", F.inline(steps)).filter("r is not null").withColumn("asked", F.lit(False))
    over = F.sum("step").over(Window.partitionBy("template", "c").orderBy("r"))
    return open_.unionByName(bands).withColumn("over", over).filter("asked and over = 0").select("template", "r", "c")


def template_types(cells: DataFrame) -> DataFrame:
    """template, type: labeled without table data, structural without value targets, else by which of both there are more."""
    kind = F.when(F.col("td") == 0, "labeled").when(F.col("vt") == 0, "structural").when((F.size("pairs") > 0) & (F.col("vt") <= F.col("td") * 0.5), "structural").otherwise("mixed")
    return paired_columns(cells).select("template", kind.alias("type"), "vt", "td")
