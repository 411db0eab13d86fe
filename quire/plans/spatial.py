"""Printed pages made from orders, in three templates of two to six columns, and what their words say for cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows
from quire.operators import spatial
from quire.session import dealt, table

_CELLS = [
    *[(0, r, 0, v) for r, v in enumerate(["Assets", "Cash at bank", "Trade debtors", "Total assets"])], (0, 0, 1, "Amount"),
    (1, 0, 0, "Income"), (1, 4, 0, "Total"), *[(1, r, 2, v) for r, v in [(0, "Costs"), (1, "Rent paid"), (2, "Wages"), (4, "Total")]], (1, 0, 3, "Amount"),
    *[(2, 0, c, v) for c, v in [(0, "Alpha"), (2, "Beta"), (4, "Gamma")]], (2, 0, 5, "x"),
]
_GROUPS = [(0, 0, 0, 1), (1, 0, 0, 1), (1, 1, 2, 3), (2, 0, 0, 1), (2, 1, 2, 3), (2, 2, 4, 5)]
_ITEMS = [(0, 0, 1), (0, 0, 2), (1, 1, 1), (1, 1, 2), (2, 0, 0), (2, 1, 0), (2, 2, 0)]
_WIDTHS = [(1, [150.0, 50.0, 150.0, 50.0])]
_WIDE = {0: 600.0, 1: 800.0, 2: 900.0}
LINES = 40_000  # of one task


def _sheets(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """cells, groups, items and widths of the three templates."""
    items = rows(spark, "template_id int, g int, r int", _ITEMS).withColumn("label", F.lit(None).cast("string"))
    widths = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("template_id"), F.array(*map(F.lit, w)).alias("widths")) for t, w in _WIDTHS])))
    return rows(spark, "template_id int, r int, c int, value string", _CELLS), rows(spark, "template_id int, g int, label_col int, value_col int", _GROUPS), items, widths


def order_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """words and pages: an order's lines on a page of its template, with a banner across it; every other page has a mark in a column of its own."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    items = dealt(spark, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_orderkey", LINES)
    lines = items.select(F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("i"), F.col("l_partkey").cast("string").alias("part"), F.format_number("l_extendedprice", 2).alias("price"))
    listed = lines.groupBy("page").agg(F.collect_list(F.struct("i", "part", "price")).alias("all"), F.count("*").cast("int").alias("n"))
    t, odd = F.col("page") % 3, F.floor(F.col("page") / 3) % 2 == 1
    i, price, end = F.col("i"), F.col("price"), F.col("n") + 1
    signed = F.when(i % 3 == 1, price).when(i % 3 == 2, F.concat(F.lit("("), price, F.lit(")"))).otherwise(F.concat(F.lit("$"), price))
    top = lambda i: (i * 20 + 100).cast("double") + F.when(i % 3 == 0, 0.5).when(i % 3 == 1, -0.5).otherwise(0.25)
    word = lambda text, x0, x1, at: F.struct(text.alias("text"), x0.alias("x0"), x1.alias("x1"), at.alias("top"))

    def label(text: str, base: float, i: Column, *more: Column) -> Column:
        return F.array(*[word(w, F.lit(k * 40 + base), F.lit(k * 40 + base + 30), top(i)) for k, w in enumerate([*map(F.lit, text.split(" ")), *more])])

    def value(text: Column, base: float, i: Column) -> Column:
        return F.array(word(text, F.lit(base), (F.length(text) * 6 + base).cast("double"), top(i)))

    none = F.array().cast("array<struct<text:string,x0:double,x1:double,top:double>>")
    one = F.concat(F.when(i % 4 == 1, label("CASH AT BANK", 10.0, i)).when(i % 4 == 2, label("Debtors trade net", 10.0, i)).when(i % 4 == 3, label("Unknown thing", 10.0, i)).otherwise(label("Total 2024 assets", 10.0, i)), value(signed, 320.0, i))
    two = F.concat(label("Part", 10.0, i, F.concat(F.lit("P"), F.col("part"))), value(signed, 310.0, i), F.when(i % 3 == 1, label("Rent paid", 410.0, i)).when(i % 3 == 2, label("Wages bill", 410.0, i)).otherwise(label("Other cost", 410.0, i)), value(price, 700.0, i))
    three = F.concat(label("BETA", 310.0, i), F.when(i % 2 == 1, F.concat(label("alpha", 10.0, i), value(price, 160.0, i), value(signed, 460.0, i), label("Gamma", 610.0, i), value(price, 760.0, i))).otherwise(none))
    around = F.concat(label("INCOME", 10.0, F.lit(0)), label("Costs", 410.0, F.lit(0)), label("Total", 10.0, end), value(F.lit("1,000"), 310.0, end), label("total costs", 410.0, end), value(F.lit("(2,000)"), 700.0, end))
    width = F.when(t == 0, _WIDE[0]).when(t == 1, _WIDE[1]).otherwise(_WIDE[2])
    banner = F.array(word(F.lit("banner"), F.lit(5.0), width * 0.7, F.lit(10.0)))
    mark = F.when(odd & (t == 0), F.array(word(F.lit("y"), F.lit(450.0), F.lit(458.0), F.lit(50.0)))).when(odd & (t == 1), F.array(word(F.lit("x"), F.lit(795.0), F.lit(799.0), F.lit(50.0)))).otherwise(none)
    # a line without a number has what stands around the others
    # outer: else Spark would test the arrays for entries before it makes them, and so make them twice
    each = listed.select("page", "n", F.inline_outer(F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("part"), F.lit("").alias("price"))), "all")))
    words = each.select("page", F.inline_outer(F.when(i == 0, F.concat(F.when(t == 1, around).otherwise(none), banner, mark)).when(t == 0, one).when(t == 1, two).otherwise(three)))
    return words, listed.select("page", t.cast("int").alias("template_id"), width.alias("width"))


_K = "k AS (SELECT l_orderkey AS page, l_orderkey % 3 AS t, l_orderkey // 3 % 2 = 1 AS odd, 'Part P' || l_partkey AS part, printf('%.2f', l_extendedprice) AS price, length(format('{:,.2f}', l_extendedprice)) AS wide, 'P' || l_partkey AS code, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
_SIGNED = "v AS (SELECT *, CASE WHEN i % 3 = 2 THEN '-' || price ELSE price END AS signed, wide + CASE i % 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS printed FROM k)"


@query(
    "e10_spatial_cells",
    f"""
WITH {_K}, {_SIGNED}, p AS (SELECT DISTINCT page, t, n FROM k),
w AS (
  SELECT page, 'B1' AS ref, '' AS value FROM p WHERE t = 0
  UNION ALL SELECT page, CASE i % 4 WHEN 1 THEN 'B2' WHEN 2 THEN 'B3' ELSE 'B4' END, arg_max(signed, i) FROM v WHERE t = 0 AND i % 4 <> 3 GROUP BY page, i % 4
  UNION ALL SELECT page, unnest(['B1', 'B5', 'D1', 'D5', 'D3']), unnest(['', '1000', '', '-2000', '']) FROM p WHERE t = 1
  UNION ALL SELECT page, 'A' || (i + 1), part FROM v WHERE t = 1 AND i <= 3 UNION ALL SELECT page, 'B' || (i + 1), signed FROM v WHERE t = 1 AND i <= 3
  UNION ALL SELECT page, 'D2', arg_max(price, i) FROM v WHERE t = 1 AND i % 3 = 1 GROUP BY page
  UNION ALL SELECT page, unnest(['C4', 'D4']), unnest(['Other cost', price]) FROM v WHERE t = 1 AND i = 3
  UNION ALL SELECT page, unnest(['B1', 'D1', 'F1']), unnest([arg_max(price, i), arg_max(signed, i), arg_max(price, i)]) FROM v WHERE t = 2 AND i % 2 = 1 GROUP BY page)
SELECT * FROM w""",
)
def e10_spatial_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages with two, four and six columns to the cells of their templates."""
    words, pages = order_pages(spark, sf_dir)
    return spatial.extract(words, pages, *_sheets(spark))


@query(
    "j13_column_bands",
    f"""
WITH {_K}, {_SIGNED}, p AS (SELECT page, t, odd, n, max(printed) AS printed, max(wide) AS wide, max(CASE WHEN i % 2 = 1 THEN printed END) AS odd_printed, max(CASE WHEN i % 2 = 1 THEN wide END) AS odd_wide, max(CASE WHEN i % 4 = 3 THEN 1 ELSE 2 END) AS steps FROM v GROUP BY ALL),
b AS (
  SELECT page, unnest([0, 1]) AS col, unnest(['rank', 'rank']) AS how, unnest([10.0, 320.0]) AS x0, unnest([40.0 * steps + 40, 320.0 + 6 * printed]) AS x1 FROM p WHERE t = 0 AND NOT odd
  UNION ALL SELECT page, unnest([0, 1]), 'part', unnest([0.0, 300.0]), unnest([300.0, 600.0]) FROM p WHERE t = 0 AND odd
  UNION ALL SELECT page, unnest([0, 1, 2, 3]), 'rank', unnest([10.0, 310.0, 410.0, 700.0]), unnest([80.0, 310.0 + 6 * printed, 480.0, 700.0 + 6 * greatest(wide, 7)]) FROM p WHERE t = 1 AND NOT odd
  UNION ALL SELECT page, unnest([0, 1, 2, 3]), 'width', unnest([0.0, 300.0, 400.0, 700.0]), unnest([300.0, 400.0, 700.0, 800.0]) FROM p WHERE t = 1 AND odd
  UNION ALL SELECT page, unnest([0, 1, 2, 3, 4, 5]), 'rank', unnest([10.0, 160.0, 310.0, 460.0, 610.0, 760.0]), unnest([40.0, 160.0 + 6 * odd_wide, 340.0, 460.0 + 6 * odd_printed, 640.0, 760.0 + 6 * odd_wide]) FROM p WHERE t = 2)
SELECT page, col, how, round(x0, 3) AS x0, round(x1, 3) AS x1 FROM b""",
)
def j13_column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages have their template's columns: clusters by rank where counts agree, else scaled widths, else equal parts."""
    words, pages = order_pages(spark, sf_dir)
    cells, groups, _, widths = _sheets(spark)
    return spatial.bands(words, pages, cells, groups, widths).select("page", "col", "how", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))
