"""Ruled and aligned tables, and columns and cells of pages, by hand-made cases."""

import pytest

from quire.operators import ruled, spatial

RULINGS = "page int, x0 double, y0 double, x1 double, y1 double"
WORDS = "page int, text string, x0 double, x1 double, top double, bottom double"


def box(page, xs, ys, without=()):
    """All lines of a grid in pieces; ``without`` has pieces (way, i, j) that are not drawn."""
    level = [(page, xs[i], y, xs[i + 1], y) for j, y in enumerate(ys) for i in range(len(xs) - 1) if ("level", i, j) not in without]
    every = level + [(page, x, ys[j], x, ys[j + 1]) for i, x in enumerate(xs) for j in range(len(ys) - 1) if ("upright", i, j) not in without]
    return [(p, *map(float, rest)) for p, *rest in every]


def at(page, text, x, y):
    return (page, text, float(x), float(x) + 8 * len(text), float(y) - 4, float(y) + 4)


@pytest.fixture(scope="module")
def pages(spark):
    lines = box(1, [10, 60, 110], [10, 30, 50]) + box(2, [10, 60, 110], [10, 30, 50], [("upright", 1, 0)]) + box(3, [10, 60, 110], [10, 30, 50], [("level", 0, 1)]) + box(4, [10, 60], [10, 30]) + [r for y in (100,) for r in box(4, [10, 60], [y, y + 20, y + 40])] + [(5, 0.0, 5.0, 100.0, 5.0), (6, 3.0, 3.0, 3.0, 3.0)]
    words = [at(p, t, x, y) for p in (1, 2, 3) for t, x, y in [("a", 12, 20), ("b", 70, 20), ("c", 12, 40), ("d", 70, 40), ("e", 30, 41), ("out", 300, 20)]] + [at(4, "u", 20, 20), at(4, "v", 20, 110)] + [at(5, t, x, y) for y in (20, 40, 60) for t, x in [("k", 10), ("l", 21), ("m", 90)]] + [at(5, "z", 50, 80), at(7, "one", 5, 5)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(lines, RULINGS)


def tables(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.tbl.page, r.tbl.n), {})[r.r] = r.line
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_ruled_cells_that_span_and_tables_below_each_other(pages):
    got = tables(ruled.page_tables(*pages))
    assert got[1, 1] == [["a", "b"], ["c e", "d"]]
    assert got[2, 1] == [["a b", None], ["c e", "d"]]
    assert got[3, 1] == [["a c e", "b"], [None, "d"]]
    assert got[4, 1] == [["u"]] and got[4, 2] == [["v"], [""]]


def test_words_without_cells_are_aligned(pages):
    got = tables(ruled.page_tables(*pages))
    assert got[5, 1] == [["k l", "m"]] * 3 + [["z", None]]
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (4, 2), (5, 1)}, "one phrase is no column"


def test_no_pages(spark, pages):
    words, rulings = pages
    assert ruled.page_tables(words.limit(0), rulings.limit(0)).count() == 0
    assert tables(ruled.page_tables(words.limit(0), rulings.filter("page = 1"))) == {(1, 1): [["", ""], ["", ""]]}


CELLS = [(1, 0, 0, "Assets"), (1, 1, 0, "Cash"), (1, 2, 0, "Cash"), (1, 3, 0, " "), (1, 4, 0, "Total"), (1, 0, 1, "Amount")]


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_lines_of_a_page_to_cells(spark):
    words = [("ASSETS", 10, 100), ("cash", 10, 120), ("(1,200)", 210, 120), ("7", 180, 120), ("Stocks", 10, 140), ("$5", 210, 140), ("nothing", 210, 160), ("Sub", 10, 170), ("Total", 10, 180), ("9", 210, 180)]
    w = frame(spark, "page int, text string, x0 double, x1 double, top double", [(p, t, float(x), x + 20.0, float(y)) for p in (1, 2) for t, x, y in words] + [(2, "far", 900.0, 920.0, 50.0)])
    pages = frame(spark, "page int, template_id int, width double", [(1, 1, 400.0), (2, 1, 400.0), (3, 1, 400.0)])
    cells = frame(spark, "template_id int, r int, c int, value string", CELLS)
    groups = frame(spark, "template_id int, g int, label_col int, value_col int", [(1, 0, 0, 1)])
    items = frame(spark, "template_id int, g int, r int, label string", [(1, 0, 1, None), (1, 0, 2, None)])
    widths = frame(spark, "template_id int, widths array<double>", [])
    got = {}
    for r in spatial.extract(w, pages, cells, groups, items, widths).collect():
        got.setdefault(r.page, {})[r.ref] = r.value
    # both rows are called Cash: the last takes the value, but has a blank row below it, so it is cleared as a heading
    want = {"B1": "", "B3": "", "B5": "9", "A4": "Stocks", "B4": "5"}
    assert got == {1: want, 2: want}
    how = {(r.page, r.col): (r.how, r.x0, r.x1) for r in spatial.bands(w, pages, cells, groups, widths).collect()}
    assert how == {(1, 0): ("rank", 10.0, 30.0), (1, 1): ("rank", 180.0, 230.0), (2, 0): ("part", 0.0, 200.0), (2, 1): ("part", 200.0, 400.0)}
