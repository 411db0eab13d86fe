"""Where results go in a sheet: every writer is a relation of output cells (job, row, col, text, num), rows and columns from zero.

Several documents of a job share a sheet, so their places need an order within the job only: windows are by job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows, values_sql
from quire.functions import values as V
from quire.operators.ruled import page_rows
from quire.operators.statements import fill, sections, template_zones, with_names
from quire.operators.writers import cell_map_cells, cell_value, layout_cells, mixed_cells
from quire.plans.matching import column_places
from quire.session import dealt, table


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the documents of a customer's job, numbered within it, with two form fields."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("doc"), (F.row_number().over(w) - 1).alias("block"), F.format_number("o_totalprice", 2).alias("total"), "o_orderpriority")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items of the documents, numbered within each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).alias("i"), F.col("l_partkey").cast("string").alias("item"), F.concat(F.lit("("), F.format_number("l_extendedprice", 2), F.lit(")")).alias("amount"))


#: Line items of a task where they are dealt by document.
LINES_A_TASK = 400_000


def with_lines(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Documents with their line items as an array, in the order of ``lines``: dealt by document once, while they are narrow."""
    narrow = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", F.col("l_partkey").alias("item"), F.col("l_extendedprice").alias("price"))
    listed = dealt(spark, narrow, "doc", LINES_A_TASK).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item", "price"))).alias("lines"))
    # merged, not sent to all: the lines are the larger side, and stay where they were dealt
    return docs.join(listed.hint("merge"), "doc", "left").withColumn("lines", F.coalesce("lines", F.array().cast(listed.schema["lines"].dataType)))


_BLOCKS = "d AS (SELECT o_custkey AS job, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS block, o_totalprice, o_orderpriority FROM orders)"
_LINES = "i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i, CAST(l_partkey AS VARCHAR) AS item, l_extendedprice AS price FROM lineitem)"


@query(
    "x1_writer_routes",
    """
WITH t AS (SELECT p_partkey AS id, p_partkey % 5 = 0 AS cell_map, ['structural', 'labeled', 'mixed', NULL][1 + p_partkey % 4] AS type, p_size % 2 = 0 AS sections, ['form_kv', 'table', 'mixed', 'parallel_groups', NULL][1 + p_size % 5] AS mode FROM part)
SELECT id, CASE WHEN cell_map THEN 'form' WHEN type = 'structural' OR (type IS NULL AND sections) THEN 'layout' WHEN mode = 'table' THEN 'table' WHEN mode = 'mixed' THEN 'mixed' ELSE 'form' END AS writer FROM t""",
)
def x1_writer_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-map tables go to the form writer, structural templates and untyped ones with sections to the layout writer, the rest by mode."""
    pick = lambda k, *values: F.get(F.array(*map(F.lit, values)), k)
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5 == 0).alias("cell_map"), pick((F.col("p_partkey") % 4).cast("int"), "structural", "labeled", "mixed", None).alias("type"), (F.col("p_size") % 2 == 0).alias("sections"), pick(F.col("p_size") % 5, "form_kv", "table", "mixed", "parallel_groups", None).alias("mode"))
    by_mode = F.when(F.col("mode").isin("table", "mixed"), F.col("mode")).otherwise("form")
    writer = F.when(F.col("cell_map"), "form").when(F.col("type") == "structural", "layout").when(F.col("type").isNull() & F.col("sections"), "layout").otherwise(by_mode)
    return t.select("id", writer.alias("writer"))


FORM_ROWS, FORM_GAP = 4, 5


@query(
    "x2_form_placement",
    f"""
WITH {_BLOCKS}, c AS (SELECT job, block * 6 + block * 5 AS off, * EXCLUDE (job) FROM d)
SELECT job, CAST(off AS BIGINT) AS row, 0 AS col, 'Order' AS text, CAST(NULL AS DOUBLE) AS num FROM c UNION ALL SELECT job, off, 1, NULL, CAST(doc AS DOUBLE) FROM c
UNION ALL SELECT job, off + 2, 0, 'Priority', NULL FROM c UNION ALL SELECT job, off + 2, 1, o_orderpriority, NULL FROM c
UNION ALL SELECT job, off + 4, 0, 'Total', NULL FROM c UNION ALL SELECT job, off + 4, 1, NULL, round(o_totalprice, 2) FROM c""",
)
def x2_form_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled block for each document: the i-th is i * (last row + 2) + 5 * i rows down."""
    offset = F.col("block") * (FORM_ROWS + 2) + FORM_GAP * F.col("block")
    part = lambda r, c, raw: F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), raw.alias("raw"))
    cells = [part(0, 0, F.lit("Order")), part(0, 1, F.col("doc").cast("string")), part(2, 0, F.lit("Priority")), part(2, 1, F.col("o_orderpriority")), part(4, 0, F.lit("Total")), part(4, 1, F.col("total"))]
    placed = jobs(spark, sf_dir).select("job", offset.alias("offset"), F.inline(F.array(*cells)))
    return placed.select("job", (F.col("offset") + F.col("r")).cast("long").alias("row"), F.col("c").alias("col"), *cell_value(F.col("raw")))


@query(
    "x3_table_placement",
    f"""
WITH {_BLOCKS}, {_LINES}, n AS (SELECT job, item, price, 1 + row_number() OVER (PARTITION BY job ORDER BY block, i) AS row FROM d JOIN i USING (doc))
SELECT job, row, 0 AS col, CAST(NULL AS VARCHAR) AS text, CAST(item AS DOUBLE) AS num FROM n UNION ALL SELECT job, row, 1, NULL, -round(price, 2) FROM n""",
)
def x3_table_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below the header, those of a job's documents one after the other."""
    w = Window.partitionBy("job").orderBy("block", "i")
    placed = lines(spark, sf_dir).join(jobs(spark, sf_dir).select("job", "doc", "block"), "doc").withColumn("row", 1 + F.row_number().over(w))
    spread = placed.select("job", "row", F.posexplode(F.array("item", "amount")).alias("col", "raw"))
    return spread.select("job", "row", "col", *cell_value(F.col("raw")))


_MIXED_CELLS = [
    *[(0, r, c, v, t) for r, c, v, t in [(0, 0, "Order no", False), (0, 1, "", True), (1, 0, "Total", False), (1, 1, "Total amount", True), (2, 3, " ", False), (3, 0, "Lines", False), (4, 0, "Item", False), (4, 1, "Amount", False), (6, 0, "Extras!", False), (7, 0, "Note", False), (7, 1, "Qty", False), (8, 0, "Sum", False), (8, 1, "=SUM(B5:B6)", False), (9, 0, "Priority", False), (9, 1, "", False)]],
    *[(1, r, c, v, False) for r, c, v in [(0, 0, "Head"), (1, 1, "Item"), (1, 2, "Amount")]],
]
_MIXED_TABLES = [(0, 5, 7, 0, "Note|Qty", "Extras!"), (0, 9, 4, 0, "Item|Amount", "Lines"), (1, 1, 1, 1, "Item|Amount", "All")]


@query(
    "x4_mixed_placement",
    f"""
WITH {_BLOCKS}, {_LINES}, k AS (SELECT doc, count(*) FILTER (WHERE i % 3 = 0) AS n0, count(*) FILTER (WHERE i % 3 = 1) AS n1, count(*) AS n FROM i GROUP BY doc),
b AS (SELECT d.job, d.doc, block, doc % 2 AS t, o_totalprice AS price, o_orderpriority AS p, greatest(coalesce(n0, 0), 1) AS h0, greatest(coalesce(n1, 0), 1) AS h1, greatest(coalesce(n, 0), 1) AS h FROM d LEFT JOIN k USING (doc)),
g AS (SELECT *, CASE t WHEN 0 THEN 10 + h0 + h1 ELSE 2 + h END + CASE WHEN block > 0 THEN 5 ELSE 0 END AS high FROM b),
o AS (SELECT *, coalesce(sum(high) OVER (PARTITION BY job ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM g), s AS (SELECT *, begin + CASE WHEN block > 0 THEN 5 ELSE 0 END AS s FROM o),
m AS (SELECT s.* EXCLUDE (price), i, item, i.price AS each FROM s JOIN i USING (doc)),
w AS (
  SELECT job, s + unnest([0, 0, 1, 1, 3, 4, 4, 6 + h0, 7 + h0, 7 + h0, 8 + h0 + h1, 8 + h0 + h1, 9 + h0 + h1, 9 + h0 + h1]) AS row, unnest([0, 1, 0, 1, 0, 0, 1, 0, 0, 1, 0, 1, 0, 1]) AS col,
    unnest(['Order no', CAST(doc AS VARCHAR), 'Total', NULL, 'Lines', 'Item', 'Amount', 'Extras!', 'Note', 'Qty', 'Sum', '=SUM(B5:B6)', 'Priority', p]) AS text, unnest([NULL, NULL, NULL, round(price, 2), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) AS num FROM s WHERE t = 0
  UNION ALL SELECT job, s + 5 + i // 3, unnest([0, 1]), unnest([item, '(' || format('{{:,.2f}}', each) || ')']), NULL FROM m WHERE t = 0 AND i % 3 = 0
  UNION ALL SELECT job, s + 8 + h0 + i // 3, unnest([0, 1]), unnest([item, NULL]), unnest([NULL, round(each, 2)]) FROM m WHERE t = 0 AND i % 3 = 1
  UNION ALL SELECT job, s + unnest([0, 1, 1]), unnest([0, 1, 2]), unnest(['Head', 'Item', 'Amount']), NULL FROM s WHERE t = 1
  UNION ALL SELECT job, s + 2 + i, unnest([1, 2]), unnest([item, '(' || format('{{:,.2f}}', each) || ')']), NULL FROM m WHERE t = 1
  UNION ALL SELECT job, s + 2, 4, NULL, round(price, 2) FROM s WHERE t = 1
  UNION ALL SELECT job, begin + 3, 0, 'Document: ' || doc || '.pdf', NULL FROM s WHERE block > 0
  UNION ALL SELECT job, begin, CASE t WHEN 0 THEN 4 ELSE 3 END, '! 2 low-confidence', NULL FROM s WHERE doc % 3 = 0)
SELECT job, CAST(row AS BIGINT) AS row, col, text, num FROM w""",
)
def x4_mixed_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a job in a template of form rows and two tables, every other one in a template of one table: fields, answers, formulas and records."""
    key = F.col("doc")
    docs = with_lines(spark, sf_dir, jobs(spark, sf_dir)).withColumns({"template_id": (key % 2).cast("int"), "file": F.concat(key.cast("string"), F.lit(".pdf")), "flagged": F.when(key % 3 == 0, 2).otherwise(0)})
    two = F.col("template_id") == 0
    pairs = lambda a, x, b, y: F.create_map(F.lit(a), x, F.lit(b), y)
    record = lambda source, values: F.struct(source.alias("source"), values.alias("values"))

    def listed(x: Column, i: Column) -> Column:
        item, price, side = x["item"].cast("string"), F.format_number(x.price, 2), i % 3
        source = F.when(two & (side == 0), "lines").when(two & (side == 1), "extras")
        return record(source, F.when(two & (side == 1), pairs("Note", item, "Qty", F.concat(F.lit("$"), price))).otherwise(pairs("Item", item, "Amount", F.concat(F.lit("("), price, F.lit(")")))))

    head = record(F.when(two, "lines"), pairs("Item", F.lit("Item"), "Amount", F.lit(" Amount ")))
    field = lambda ref, value: F.struct(F.lit(ref).alias("ref"), value.alias("value"))
    fields = F.when(two, F.array(field("B1", key.cast("string")), field("b10", F.col("o_orderpriority")), field("A1", F.lit("kept")))).otherwise(F.array(field("E3", F.concat(F.lit("$"), "total"))))
    answers = F.array(F.struct(F.lit("Total amount").alias("label"), F.col("total").alias("value")))
    docs = docs.select("job", "doc", "block", "template_id", "file", "flagged", fields.alias("fields"), answers.alias("answers"), F.concat(F.array(head), F.transform("lines", listed)).alias("records"))
    tables = rows(spark, "template_id int, table_no int, header_row int, start_col int, names string, section string", _MIXED_TABLES).withColumn("names", F.split("names", "[|]"))
    labels = rows(spark, "template_id int, r int", [(0, 3), (0, 6)])
    return mixed_cells(docs, rows(spark, "template_id int, r int, c int, value string, target boolean", _MIXED_CELLS), tables, labels)


#: A template with two sections side by side, one below them, and a total; one whose group takes nothing; one without groups.
_LAYOUT_CELLS = [(0, 0, 0, "Report"), (0, 1, 0, " Current assets"), (0, 1, 2, "Liabilities"), (0, 2, 0, "x"), (0, 2, 4, "  "), (0, 3, 0, "Total"), (0, 4, 0, "Equity"), (0, 6, 0, "End"), (1, 0, 0, "Head"), (1, 2, 0, "Foot"), (2, 0, 0, "Plain")]
_LAYOUT_GROUPS = [(0, 0, "Current assets", 2, 2, 0, 1), (0, 1, "Liabilities", 2, 2, 2, 3), (0, 2, "Equity", 5, 5, 0, 1), (1, 0, "Lines", 1, 2, 0, 1)]


@query(
    "x5_layout_placement",
    f"""
WITH {_BLOCKS}, {_LINES}, k AS (SELECT doc, count(*) FILTER (WHERE i % 3 = 0) AS n0, count(*) FILTER (WHERE i % 3 = 1) AS n1, count(*) FILTER (WHERE i % 3 = 2) AS n2, count(*) AS n FROM i GROUP BY doc),
b AS (SELECT d.job, d.doc, block, doc % 3 AS t, o_totalprice AS price, o_orderpriority AS p, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n, 0) AS n FROM d LEFT JOIN k USING (doc)),
c AS (SELECT *, CASE WHEN t = 0 THEN greatest(n0, n1, 1) - 1 ELSE 0 END AS o1, CASE WHEN t = 0 THEN greatest(n2, 1) - 1 ELSE 0 END AS o2 FROM b),
h AS (SELECT *, CASE t WHEN 0 THEN 7 + o1 + o2 + CASE WHEN doc % 2 = 0 THEN 4 ELSE 0 END WHEN 1 THEN 3 + CASE WHEN n > 0 THEN n + 2 ELSE 0 END ELSE 1 + CASE WHEN n > 0 THEN n + 2 ELSE 0 END END AS high FROM c),
o AS (SELECT *, coalesce(sum(high + 2) OVER (PARTITION BY job ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM h),
m AS (SELECT job, off, o1, o2, t, i, (i + 1) || '-' || item AS label, -round(price, 2) AS num FROM (SELECT o.* EXCLUDE (price), i, item, i.price FROM o JOIN i USING (doc))),
w AS (
  SELECT job, off + unnest([0, 1, 1, 3 + o1, 4 + o1, 6 + o1 + o2]) AS row, unnest([0, 0, 2, 0, 0, 0]) AS col, unnest(['Report', 'Current assets', 'Liabilities', 'Total', 'Equity', 'End']) AS text, CAST(NULL AS DOUBLE) AS num FROM o WHERE t = 0
  UNION ALL SELECT job, off + 2, 0, 'x', NULL FROM o WHERE t = 0 AND n0 = 0
  UNION ALL SELECT job, off + unnest([0, 2]), 0, unnest(['Head', 'Foot']), NULL FROM o WHERE t = 1 UNION ALL SELECT job, off, 0, 'Plain', NULL FROM o WHERE t = 2
  UNION ALL SELECT job, off + CASE WHEN i % 3 = 2 THEN 5 + o1 ELSE 2 END + i // 3, CASE WHEN i % 3 = 1 THEN 2 ELSE 0 END, label, NULL FROM m WHERE t = 0
  UNION ALL SELECT job, off + CASE WHEN i % 3 = 2 THEN 5 + o1 ELSE 2 END + i // 3, CASE WHEN i % 3 = 1 THEN 3 ELSE 1 END, NULL, num FROM m WHERE t = 0
  UNION ALL SELECT job, off + unnest([0, 3 + o1]), 1, unnest([p, NULL]), unnest([NULL, round(price, 2)]) FROM o WHERE t = 0
  UNION ALL SELECT job, off + 8 + o1 + o2 + unnest([0, 0, 1]), unnest([0, 1, 0]), unnest(['Note', p, 'Memo']), NULL FROM o WHERE t = 0 AND doc % 2 = 0
  UNION ALL SELECT job, off + CASE t WHEN 1 THEN 4 ELSE 2 END + i, unnest([0, 1]), unnest([label, NULL]), unnest([NULL, num]) FROM m WHERE t > 0
  UNION ALL SELECT job, off + 2 + i, unnest([2, 3]), unnest([label, NULL]), unnest([NULL, num]) FROM m WHERE t = 2 AND i % 2 = 1
  UNION ALL SELECT job, off + 2 + i, 3, NULL, num FROM m WHERE t = 2 AND i % 2 = 0)
SELECT job, CAST(row AS BIGINT) AS row, col, text, num FROM w""",
)
def x5_layout_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a job in three layouts: sections of their own names and of longer ones, one that repeats another, one that has no place, and fixed cells."""
    docs = with_lines(spark, sf_dir, jobs(spark, sf_dir)).withColumn("template_id", (F.col("doc") % 3).cast("int"))
    t, none = F.col("template_id"), F.lit(None).cast("string")
    row = lambda i, label, value, at, label_at, value_at: F.struct(i.alias("i"), label.alias("label"), value.alias("value"), at.alias("at_row"), label_at.alias("label_at"), value_at.alias("value_at"))

    def line(x: Column, i: Column) -> Column:
        odd = (t == 2) & (i % 2 == 0)  # the answer's label letter is no column
        label, value = F.concat((i + 1).cast("string"), F.lit("-"), x["item"].cast("string")), F.concat(F.lit("("), F.format_number(x.price, 2), F.lit(")"))
        return row(i, label, value, i + 3, F.when(odd, none).otherwise("c"), F.lit("D"))

    found = docs.withColumn("found", F.transform("lines", line))
    side = lambda n: F.filter("found", lambda r: r.i % 3 == n)
    total = F.transform(F.slice("found", 1, 1), lambda r: row(r.i, F.lit("Total"), r.value, r.at_row, r.label_at, r.value_at))
    notes = F.when(F.col("doc") % 6 == 0, F.array(*[row(F.lit(i), F.lit(label), value, F.lit(None).cast("int"), none, none) for i, label, value in [(0, "Note", F.col("o_orderpriority")), (1, "Memo", F.lit(""))]])).otherwise(F.array().cast(found.schema["found"].dataType))
    section = lambda key, rows_: F.struct(F.lit(key).alias("key"), rows_.alias("rows"))
    three = F.array(section("CURRENT ASSETS", side(0)), section("Total current assets", F.concat(side(0), total)), section("Liabilities (short)", side(1)), section("Shareholders' equity", side(2)), section("Notes", notes))
    sections_ = F.filter(F.when(t == 0, three).otherwise(F.array(section("Goods", F.col("found")))), lambda s: F.size(s.rows) > 0)
    fields = F.when(t == 0, F.array(*[F.struct(F.lit(r).alias("ref"), v.alias("value")) for r, v in [("B4", F.col("total")), ("b1", F.col("o_orderpriority")), ("C9", F.lit("")), ("?", F.lit("7"))]]))
    sheet = rows(spark, "template_id int, r int, c int, value string", _LAYOUT_CELLS), rows(spark, "template_id int, grp int, section_label string, start_row int, end_row int, label_col int, value_col int", _LAYOUT_GROUPS)
    return layout_cells(found.select("job", "doc", "block", "template_id", sections_.alias("sections"), fields.alias("fields")), *sheet)


#: template, table, name, first row, column letter, column name.
_TABLES = [(0, 0, "Lines", 7, "A", "item"), (0, 0, "Lines", 7, "C", "amount"), (0, 0, "Lines", 7, "?", "qty"), (0, 1, "Other Table", 20, "B", "item"), (0, 1, "Other Table", 20, "AA", "price"), (1, 0, "Only", 3, "B", "amount"), (1, 0, "Only", 3, "D", "item")]


@query(
    "x6_cell_map_placement",
    f"""
WITH {_LINES}, r AS (SELECT doc, i, doc % 2 AS t, i % 5 AS k, CASE WHEN i % 5 IN (0, 1) THEN CAST(item AS DOUBLE) END AS item, CASE WHEN i % 5 IN (0, 2) THEN '(' || format('{{:,.2f}}', price) || ')' END AS amount, CASE WHEN i % 5 = 4 THEN round(price, 2) END AS price FROM i),
m AS (SELECT *, 0 AS table_no FROM r WHERE t = 1 OR k <= 2 UNION ALL SELECT *, 1 FROM r WHERE t = 0 AND k IN (0, 1, 4)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, table_no ORDER BY i) - 1 AS pos FROM m),
w AS (SELECT doc, table_no, 7 + pos AS row, unnest(['A', 'C']) AS letter, unnest([NULL, amount]) AS text, unnest([item, NULL]) AS num FROM n WHERE t = 0 AND table_no = 0
  UNION ALL SELECT doc, table_no, 20 + pos, unnest(['B', 'AA']), NULL, unnest([item, price]) FROM n WHERE t = 0 AND table_no = 1
  UNION ALL SELECT doc, table_no, 3 + pos, unnest(['B', 'D']), unnest([amount, NULL]), unnest([NULL, item]) FROM n WHERE t = 1)
SELECT doc, table_no, row, letter, CASE WHEN num IS NULL THEN coalesce(text, '') END AS text, num FROM w""",
)
def x6_cell_map_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of five kinds by name or columns into one table, two or none; every other document's template has one table for all."""
    k = F.col("i") % 5
    found = lines(spark, sf_dir)
    price = F.concat(F.lit("$"), F.regexp_replace("amount", "[()]", ""))
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.when(on, v).alias("value")) for n, on, v in [("item", k.isin(0, 1), F.col("item")), ("amount", k.isin(0, 2), F.col("amount")), ("note", k.isin(3, 4), F.lit("n")), ("price", k == 4, price)]]), lambda e: e.value.isNotNull())
    source = F.when(k == 0, "lines").when(k == 2, None).when(k == 4, " OTHER-table!").otherwise("none")
    records = found.select("doc", (F.col("doc") % 2).cast("int").alias("template_id"), "i", source.alias("source"), F.map_from_entries(entries).alias("values"))
    return cell_map_cells(records, rows(spark, "template_id int, table_no int, table_id string, start int, letter string, name string", _TABLES))


@query("x7_fallback_placement", f"WITH {_LINES} SELECT doc, i AS row, 0 AS col, item AS value FROM i UNION ALL SELECT doc, i, 1, '(' || format('{{:,.2f}}', price) || ')' FROM i")
def x7_fallback_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values one after the other in columns A, B, C, private keys left out."""
    m = F.create_map(F.lit("_table_source"), F.lit("t"), F.lit("Item"), F.col("item"), F.lit("Amount"), F.col("amount"))
    return lines(spark, sf_dir).select("doc", F.col("i").alias("row"), F.posexplode(F.map_values(F.map_filter(m, lambda k, _: ~k.startswith("_")))).alias("col", "value"))


def evaluate(formulas: DataFrame, cells: DataFrame) -> DataFrame:
    """``formulas`` (sheet, id, formula) with the value of ``=SUM(A1:A9)`` (its first column) or ``=SUM(A1,B2)`` over cells (sheet, ref, num), rounded to cents; null for other formulas and where no cell is there.

    A range is joined by its sheet and column with the cells whose row lies in it, so its length makes no rows.
    """
    area = r"(?i)^=SUM\(([A-Z]+)(\d+):([A-Z]+)(\d+)\)$"
    f = F.trim("formula")
    part = lambda i: F.regexp_extract(f, area, i)
    low = part(2).try_cast("int")
    span = lambda col, a, b: F.struct(F.upper(col).alias("letters"), a.alias("low"), b.alias("high"))
    ranged = F.when(f.rlike(area), F.array(span(part(1), low, F.greatest(low, part(4).try_cast("int")))))
    single = lambda x: span(F.regexp_extract(x, r"^([A-Za-z]+)\d+$", 1), F.regexp_extract(x, r"^[A-Za-z]+(\d+)$", 1).try_cast("int"), F.regexp_extract(x, r"^[A-Za-z]+(\d+)$", 1).try_cast("int"))
    listed = F.when(f.rlike(r"(?i)^=SUM\([^):]+\)$"), F.transform(F.split(F.regexp_extract(f, r"(?i)^=SUM\(([^)]+)\)$", 1), ","), lambda x: single(F.trim(x))))
    asked = formulas.select("*", F.inline_outer(F.coalesce(ranged, listed)))
    placed = cells.select(F.col("sheet").alias("s"), F.regexp_extract("ref", r"^([A-Z]+)\d+$", 1).alias("letters"), F.regexp_extract("ref", r"^[A-Z]+(\d+)$", 1).try_cast("int").alias("r"), F.col("num").cast("decimal(18,4)").alias("num"))
    inside = (F.col("sheet") == F.col("s")) & (asked.letters == placed.letters) & placed.r.between(asked.low, asked.high)
    joined = asked.join(placed, inside, "left")
    total = joined.groupBy("sheet", "id", "formula").agg(F.sum("num").alias("total"))
    return total.select("sheet", "id", "formula", F.round("total", 2).cast("double").alias("value"))


_FORMULAS = [(1, "=SUM(B1:B4)"), (2, "=sum(B1, B3 ,C9)"), (3, "=SUM(C1:D2)"), (4, "=SUM(Z1:Z9)"), (5, "=B1+B2"), (6, "text")]


@query(
    "x8_sum_formula",
    """
WITH c AS (SELECT l_orderkey AS sheet, 'B' || l_linenumber AS ref, sum(CAST(l_extendedprice AS DECIMAL(18, 4))) AS num FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT sheet FROM c)
SELECT sheet, 1 AS id, CAST(round((SELECT sum(num) FROM c WHERE c.sheet = s.sheet AND ref IN ('B1', 'B2', 'B3', 'B4')), 2) AS DOUBLE) AS value FROM s
UNION ALL SELECT sheet, 2, CAST(round((SELECT sum(num) FROM c WHERE c.sheet = s.sheet AND ref IN ('B1', 'B3')), 2) AS DOUBLE) FROM s UNION ALL SELECT sheet, unnest([3, 4, 5, 6]), NULL FROM s""",
)
def x8_sum_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.concat(F.lit("B"), F.col("l_linenumber").cast("string")).alias("ref")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).alias("num"))
    texts = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("formula")) for i, t in _FORMULAS])
    formulas = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet")).distinct().select("sheet", F.inline(texts))
    return evaluate(formulas, cells).select("sheet", "id", "value")


def shift_formula(formula: Column, offset: Column) -> Column:
    """Row numbers of references moved down: the text is cut before each reference and put together again, without a callback."""
    parts = F.split(F.regexp_replace(formula, r"([A-Z]+)(\d+)", "\u0001$1\u0002$2\u0003"), "\u0001")
    moved = F.transform(parts, lambda p: F.when(p.contains("\u0002"), F.concat(F.substring_index(p, "\u0002", 1), (F.regexp_extract(p, "\u0002(\\d+)\u0003", 1).try_cast("long") + offset).cast("string"), F.substring_index(p, "\u0003", -1))).otherwise(p))
    return F.array_join(moved, "")


@query("x9_formula_shift", "SELECT p_partkey, '=SUM(B' || (9 + p_size) || ':AB' || (11 + p_size) || ')+C' || (1 + p_size) || '*2' AS formula FROM part")
def x9_formula_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", shift_formula(F.lit("=SUM(B9:AB11)+C1*2"), F.col("p_size")).alias("formula"))


@query(
    "x10_cell_values",
    """
WITH p AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, round(o_totalprice, 2) AS price FROM orders)
SELECT id, CASE k WHEN 3 THEN id || 'a' WHEN 4 THEN '' WHEN 6 THEN '1.2.3' END AS text, CASE k WHEN 0 THEN price WHEN 1 THEN -price WHEN 2 THEN 12 WHEN 7 THEN -7 WHEN 8 THEN -price END AS num FROM p""",
)
def x10_cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they come from documents: numbers with signs of currency, brackets and commas, and what is no number."""
    k, price = F.col("o_orderkey") % 9, F.format_number(F.round("o_totalprice", 2), 2)
    raw = F.when(k == 0, F.concat(F.lit("$"), price)).when(k == 1, F.concat(F.lit("("), F.replace(price, F.lit(","), F.lit("")), F.lit(")"))).when(k == 2, " ₹ 12 ").when(k == 3, F.concat(F.col("o_orderkey").cast("string"), F.lit("a"))).when(k == 4, "").when(k == 6, "1.2.3").when(k == 7, "-7.").when(k == 8, F.concat(F.lit("€("), price, F.lit(")")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *cell_value(raw))


# -- text sections to zones, words to cells -----------------------------------------------------------------------------------------------


#: Two templates of a balance sheet; in the second one, zones of assets end in different rows, slots are few, and one
#: section has blank rows before and after its name: the first ones take its items, its total goes below the others.
_SHEETS = [
    *[(0, r, c, v) for r, c, v in [(0, 0, "Current assets"), (0, 1, "Amount"), (0, 2, "Non current assets"), (0, 3, "Amount"), (9, 0, "Total"), (9, 2, "Total"), (9, 4, "Final Total"), (10, 0, "Current liabilities"), (10, 2, "Non current liabilities"), (20, 0, "Total"), (20, 2, "Total"), (20, 4, "Final Total")]],
    *[(1, r, c, v) for r, c, v in [(0, 0, "Non current assets"), (3, 0, "Total"), (3, 6, "Grand total"), (4, 0, "Non current liabilities"), (7, 0, "Total"), (7, 6, "Grand  Total:"), (0, 3, "Current assets"), (4, 3, "Total"), (5, 3, " "), (7, 3, "Current liabilities"), (7, 9, "Final total"), (11, 3, "Total")]],
]
_GROUPS = [(0, 0, 0, 1), (0, 1, 2, 3), (1, 0, 0, 1), (1, 1, 3, 5)]
#: template, zone, order, label and value column, first row, slots, header row, total row (from zero), as the templates have them.
_ZONES = [(0, "Current assets", 1, "A", "B", 2, 8, 1, 10), (0, "Current liabilities", 2, "A", "B", 12, 9, 11, 21), (0, "Non current assets", 3, "C", "D", 2, 8, 1, 10), (0, "Non current liabilities", 4, "C", "D", 12, 9, 11, 21), (1, "Non current assets", 1, "A", "B", 2, 2, 1, 4), (1, "Non current liabilities", 2, "A", "B", 6, 2, 5, 8), (1, "Current assets", 3, "D", "F", 2, 3, 1, 5), (1, "Current liabilities", 4, "D", "F", 6, 2, 8, 12)]
#: What the statements of ``order_statements`` hold, told from how they are made: items by zone, totals, and the line after the end.
_STATEMENTS = """
k AS (SELECT l_orderkey AS doc_id, l_orderkey % 5 AS v, l_orderkey // 5 % 2 AS t, l_partkey AS part, l_extendedprice AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
f AS (SELECT *, i % 4 AS s, (i + part) % 6 AS f, min(i) OVER (PARTITION BY doc_id, i % 4) AS first FROM k),
g AS (SELECT doc_id, v, t, s, i, CASE f WHEN 2 THEN 'Less: Item ' WHEN 4 THEN 'Totally item ' ELSE 'Item ' END || part AS label, CASE WHEN f IN (1, 2, 3) THEN '-' ELSE '' END || printf('%.2f', price) AS value
  FROM f WHERE (f <> 5 OR price < 999.995) AND NOT (v = 3 AND s = 2) AND NOT (v = 4 AND s = 0 AND i > first)),
d AS (SELECT DISTINCT doc_id, v, t FROM k),
c AS (SELECT d.doc_id, d.v, d.t, count(*) FILTER (WHERE s = 0) AS n0, count(*) FILTER (WHERE s = 2) AS n2 FROM d LEFT JOIN g USING (doc_id) GROUP BY ALL),
z AS (SELECT doc_id, v, t, n0, n2, v = 2 OR (v = 1 AND t = 0 AND n0 = 0) AS a, v = 1 AND t = 0 AND n2 = 0 AS b FROM c),
y AS (SELECT g.doc_id, g.t, CASE WHEN s = 0 OR (s = 1 AND a) THEN 'Current assets' WHEN s = 1 THEN 'Non current assets' WHEN s = 2 OR b THEN 'Current liabilities' ELSE 'Non current liabilities' END AS zone, s, i, label, value FROM g JOIN z USING (doc_id)),
e AS (SELECT z.doc_id, z.t, count(*) FILTER (WHERE zone = 'Current liabilities') AS cl, count(*) FILTER (WHERE zone = 'Non current liabilities') AS nl FROM z LEFT JOIN y USING (doc_id) GROUP BY ALL),
x AS (SELECT * FROM y UNION ALL SELECT doc_id, t, CASE WHEN t = 0 AND cl = 0 OR nl > 0 THEN 'Current liabilities' ELSE 'Non current liabilities' END, 4, 0, 'Stray', '7' FROM e WHERE cl = 0 OR nl = 0),
items AS (SELECT doc_id, t, zone, row_number() OVER (PARTITION BY doc_id, zone ORDER BY s, i) AS pos, label, value FROM x),
totals AS (SELECT doc_id, t, 'Current assets' AS zone, CASE WHEN a THEN '1006' WHEN v = 4 THEN '10' ELSE '5' END AS value FROM z
  UNION ALL SELECT doc_id, t, 'Non current assets', '1006' FROM z WHERE NOT a
  UNION ALL SELECT doc_id, t, 'Current liabilities', CASE WHEN b THEN '8.50' ELSE '-7' END FROM z WHERE v <> 3 OR b
  UNION ALL SELECT doc_id, t, 'Non current liabilities', '8.50' FROM z WHERE NOT b)"""


def order_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, template_id, text: a statement for each order, in five shapes by key, with items in six forms and in four sections.

    Headings come in other cases, with colons and dashes, by another name in capitals, or not at all; sections end with
    totals of several kinds, with a subtotal in their midst, or by a line for two kinds of account; two grand totals and a line
    after them follow. Items have signs, brackets, colons, "Less:", words like "Totally", and amounts that are none.
    """
    price = F.format_number("price", 2)
    named = lambda label, value: F.concat(F.lit(label), F.col("part"), F.lit(" "), value)
    form = (F.col("i") + F.col("part").cast("int")) % 6
    item = F.when(form == 0, named("Item ", F.concat(F.lit(" $"), price))).when(form == 1, named("Item ", F.concat(F.lit("("), price, F.lit(")")))).when(form == 2, named("Less: Item ", price)).when(form == 3, F.concat(F.lit("Item "), F.col("part"), F.lit(":\t($"), price, F.lit(")"))).when(form == 4, named("Totally item ", price)).otherwise(named("Item ", F.replace(price, F.lit(","), F.lit(""))))
    docs = ranked_lines(spark, sf_dir).withColumn("line", item).groupBy(F.col("page").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("all"))
    v = F.col("doc_id") % 5
    side = lambda n: F.transform(F.filter("all", lambda x: x.i % 4 == n), lambda x: x.line)
    said = lambda *x: F.array(*map(F.lit, x))
    none = F.array().cast("array<string>")
    current = F.when(v == 4, F.concat(F.slice(side(0), 1, 1), said("Subtotal 10"), F.slice(side(0), 2, 1 << 20))).otherwise(side(0))
    parts = [
        said("ACME LTD", "BALANCE SHEET", ""),
        F.when(v == 0, said("Current assets:")).otherwise(said("CURRENT  ASSETS")),
        current,
        F.when(v == 2, none).otherwise(said("Total current assets $5", "--- page")),
        F.when(v == 0, said("Non-current assets")).when(v == 1, said("FIXED ASSETS")).when(v == 2, said("Intangibles and such")).when(v == 3, said("NON CURRENT ASSETS")).otherwise(said("  Non current  assets ")),
        side(1),
        said("Total 1,006"),
        F.when(v == 3, said("Current Liabilities", "LIABILITIES & EQUITY")).otherwise(said("Current Liabilities")),
        side(2),
        said("TOTAL (7)"),
        F.when(v == 0, said("NON-CURRENT LIABILITIES:")).when(v == 1, said("LONG-TERM LIABILITIES")).otherwise(said("Non-current liabilities")),
        side(3),
        said("Grand total 8.50", "Total liabilities 9", "TOTAL ASSETS $1,608,600", "OTHER NOTES", "TOTAL LIABILITIES 557,400", "TOTAL LIABILITIES 1", "Stray 7"),
    ]
    return docs.select("doc_id", (F.floor(F.col("doc_id") / 5) % 2).cast("int").alias("template_id"), F.array_join(F.concat(*parts), "\n").alias("text"))


def read_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = template_zones(rows(spark, "template_id int, r int, c int, value string", _SHEETS), rows(spark, "template_id int, g int, label_col int, value_col int", _GROUPS))
    return sections(order_statements(spark, sf_dir).join(F.broadcast(with_names(zones)), "template_id"))


@query("e8_section_parse", f"WITH {_STATEMENTS} SELECT doc_id, zone, 'item' AS kind, pos, label, value FROM items UNION ALL SELECT doc_id, zone, 'total', 0, '', value FROM totals")
def e8_section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read_statements(spark, sf_dir).select("doc_id", F.explode_outer("sections").alias("s"))
    items = F.transform("s.items", lambda x, i: F.struct(F.lit("item").alias("kind"), (i + 1).cast("long").alias("pos"), x.label.alias("label"), x.value.alias("value")))
    total = F.filter(F.array(F.struct(F.lit("total").alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("label"), F.col("s.total").alias("value"))), lambda x: x.value.isNotNull())
    return each.select("doc_id", "s.zone", F.inline_outer(F.concat(items, total))).filter("kind IS NOT NULL")


@query(
    "e9_dynamic_fill",
    f"""
WITH {_STATEMENTS}, o AS (SELECT * FROM {values_sql("t, zone, k, label_col, value_col, first_row, slots, header_row, total_row", _ZONES)}),
p AS (SELECT i.doc_id, label, value, label_col || (first_row + pos - 1) AS label_ref, value_col || (first_row + pos - 1) AS value_ref FROM items i JOIN o ON o.t = i.t AND o.zone = i.zone AND pos <= slots),
w AS (SELECT doc_id, label_ref AS ref, label AS value FROM p UNION ALL SELECT doc_id, value_ref, value FROM p
  UNION ALL SELECT doc_id, value_col || total_row, value FROM totals JOIN o USING (t, zone)
  UNION ALL SELECT doc_id, value_col || header_row, '' FROM d JOIN o USING (t)
  UNION ALL SELECT doc_id, 'F10', '1608600' FROM d WHERE t = 0 UNION ALL SELECT doc_id, 'F21', '557400' FROM d WHERE t = 0)
SELECT * FROM w""",
)
def e9_dynamic_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements into templates: items to blank rows, totals below them, grand totals beside their names where the template is clear."""
    return fill(read_statements(spark, sf_dir), ["doc_id"])


_RANKED = "k AS (SELECT l_orderkey AS page, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem)"


LINES = 40_000  # of one task


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, i, part, qty, price: the lines of each order by number."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    items = dealt(spark, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), "l_orderkey", LINES)
    return items.select(F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("i"), F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").cast("int").cast("string").alias("qty"), F.col("l_extendedprice").alias("price"))


SKIPPED = ["subtotal", "grand total", "shipping", "discount", "charges", "refund", "paid", "free", "balance due"]


def table_rows(printed: DataFrame, names: list[str]) -> DataFrame:
    """tbl, r, cells (map of name to text) from printed(tbl, r, line array), by ``named_rows``."""
    return named_rows(printed.groupBy("tbl").agg(F.collect_list(F.struct("r", "line")).alias("rows")), names)


def named_rows(tables: DataFrame, names: list[str]) -> DataFrame:
    """tbl, r, cells (map of name to text) from tables(tbl, rows (r, line array)): rows below the header that name something.

    The header is the first of the first eight rows that names most columns, half of them (and one) at least; tables
    without one give no rows. Rows without a first cell, of summaries, or that begin with a number of up to four figures
    are left out; amounts lose a leading ``$`` and their commas.
    """
    hit = lambda x, n: F.exists(x, lambda c: (c != "") & (c.contains(n.lower()) | F.lit(n.lower()).contains(c))).cast("int")
    small = F.transform(F.filter("rows", lambda x: x.r < 8), lambda x: F.struct(x.r.alias("r"), F.transform(x.line, lambda c: F.lower(V.collapse(c))).alias("v")))
    head = F.array_max(F.transform(small, lambda x: F.struct(sum((hit(x.v, n) for n in names), F.lit(0)).alias("score"), (-x.r).alias("first"), x.v.alias("v"))))
    headed = tables.withColumn("b", head).filter(F.col("b.score") >= max(1, len(names) // 2)).select("tbl", "rows", (-F.col("b.first")).alias("header_row"), column_places(names)("b.v").alias("at"))
    below = headed.select("tbl", "header_row", "at", F.inline("rows")).filter("r > header_row")
    cell = lambda i: V.collapse(F.get("line", i))
    first = F.col("first")
    kept = below.withColumn("first", cell(F.lit(0))).filter((first != "") & ~F.lower(first).rlike("|".join(SKIPPED)) & ~first.rlike("^[0-9]{1,4}$"))
    amount = lambda x: F.replace(F.when(x.startswith("$"), F.substring(x, 2, 1 << 30)).otherwise(x), F.lit(","), F.lit(""))
    texts = kept.select("tbl", "r", *[amount(cell(F.get("at", F.lit(k)))).alias(f"c{k}") for k in range(len(names))])
    named = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.col(f"c{k}"))])
    return texts.filter(F.concat(*[f"c{k}" for k in range(len(names))]) != "").select("tbl", "r", named.alias("cells"))


@query(
    "e11_header_row",
    f"""
WITH {_RANKED.replace("l_partkey, l_extendedprice, row", "l_partkey, l_quantity, l_extendedprice, row")}
SELECT page AS tbl, CAST(i + 1 AS INTEGER) AS r, 'Part ' || l_partkey AS item, CASE WHEN page % 3 = 1 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty, printf('%.2f', l_extendedprice) AS price
FROM k WHERE page % 3 <> 2""",
)
def e11_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a printed table for each order: with a title, one of three headers (the last names no column), a subtotal, a gift, a page number and a row without a first cell.

    Tables come from the page: every other one is ruled, with lines a little off their places and, on some, a title across all columns;
    the others have words only. Both ways give the same rows.
    """
    cell = lambda *x: F.array(*[F.lit(c) if isinstance(c, str) else c for c in x])
    row = lambda r, line: F.struct(r.cast("int").alias("r"), line.alias("line"))
    header = F.when(F.col("page") % 3 == 0, cell("Item", "Qty", "Unit price")).when(F.col("page") % 3 == 1, cell("Name of item", "Quantity", "Pricing")).otherwise(cell("Product", "Rate", "Sum"))
    items = ranked_lines(spark, sf_dir)
    line = cell(F.concat(F.lit("Part  "), F.col("part")), F.col("qty"), F.concat(F.lit("$"), F.format_number("price", 2)))
    listed = items.groupBy("page").agg(F.collect_list(row(F.col("i") + 1, line)).alias("all"), F.count("*").alias("n"))
    after = [cell("Subtotal", "", "$7"), cell("Free gift", "1", "0"), cell("12", "1", "2"), cell("", "1", "2")]
    whole = F.concat(F.array(row(F.lit(0), cell("ACME", " ", "")), row(F.lit(1), header)), "all", F.array(*[row(F.col("n") + 2 + k, x) for k, x in enumerate(after)]))
    left = F.array(*[F.lit(x) for x in (50.0, 200.0, 300.0, 400.0)])
    r, c, k = F.col("r"), F.col("c"), F.col("k")
    # outer: else Spark would test the arrays for entries before it makes them, and so make them twice
    cells_ = listed.select("page", F.inline_outer(whole)).select("page", "r", F.posexplode("line").alias("c", "cell"))
    each = cells_.select("page", "r", "c", F.posexplode_outer(F.array_remove(F.split("cell", " "), "")).alias("k", "text")).filter("text IS NOT NULL")
    words = each.select("page", "text", (left[c] + 5 + k * 36).alias("x0"), (left[c] + 35 + k * 36).alias("x1"), (r * 20 + 103).cast("double").alias("top"), (r * 20 + 113).cast("double").alias("bottom"))
    # k is -1 for a level line, else the place of an upright one, which is drawn row by row
    n = items.filter("page % 2 = 0").groupBy("page").agg((F.count("*") + 2 + len(after)).cast("int").alias("n"))
    lines_ = n.select("page", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("r")).select("page", "n", "r", F.explode(F.sequence(F.lit(-1), F.lit(3))).alias("k"))
    drawn = lines_.filter((k < 0) | (r < F.col("n")) & ~((F.col("page") % 4 == 0) & (r == 0) & k.isin(1, 2)))
    level, x, y = k < 0, left[k] + r % 2, (r * 20 + 100).cast("double")
    rulings = drawn.select("page", F.when(level, 50.0).otherwise(x).alias("x0"), F.when(level, y + r % 2).otherwise(y).alias("y0"), F.when(level, 400.0).otherwise(x).alias("x1"), F.when(level, y + r % 2).otherwise(y + 19).alias("y1"))
    tables = page_rows(words, rulings).select(F.struct("page", "n").alias("tbl"), F.transform("rows", lambda x, i: F.struct(i.alias("r"), x.alias("line"))).alias("rows"))
    found = named_rows(tables, ["item", "qty", "price"])
    return found.select(F.col("tbl.page").alias("tbl"), "r", *[F.col("cells")[n].alias(n) for n in ("item", "qty", "price")])


@query(
    "e15_e20_layout_sections",
    f"""WITH {_LINES}, m AS (SELECT doc, i, item, price, CASE WHEN i < 3 THEN 'Lines' ELSE 'Rest' END AS section FROM i)
SELECT doc, section, count(*) AS n, string_agg(item, ',' ORDER BY i) AS labels, min(i) + 2 AS first_row FROM m GROUP BY doc, section""",
)
def e15_layout_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat fields by cell reference, paired by row into the rows of sections: labels in A, values in B."""
    section = F.when(F.col("i") < 3, "Lines").otherwise("Rest")
    ref = lambda c: V.cell_ref(F.col("i") + 1, F.lit(c))
    flat = lines(spark, sf_dir).select("doc", section.alias("section"), F.inline(F.array(F.struct(ref(0).alias("ref"), F.col("item").alias("v")), F.struct(ref(1).alias("ref"), F.col("amount").alias("v")))))
    parsed = flat.select("doc", "section", V.ref_row(F.col("ref")).alias("r"), F.regexp_extract("ref", "^([A-Z]+)", 1).alias("letter"), "v")
    paired = parsed.groupBy("doc", "section", "r").agg(F.max(F.when(F.col("letter") == "A", F.col("v"))).alias("label"), F.max(F.when(F.col("letter") == "B", F.col("v"))).alias("value"))
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), ",")
    return paired.groupBy("doc", "section").agg(F.count("*").alias("n"), labels.alias("labels"), (F.min("r") + 1).cast("long").alias("first_row"))


@query(
    "a17_coverage",
    f"""WITH {_LINES}, c AS (SELECT doc, count(*) AS filled, bool_or(price > 50000) AS dynamic FROM i GROUP BY doc) SELECT doc, CAST(filled AS DOUBLE) / 8 AS coverage, CAST(filled AS DOUBLE) / 8 >= 0.5 OR dynamic AS text_path FROM c""",
)
def a17_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of a template's fields filled from text, or any value in a free row, makes the model unnecessary."""
    amount = F.abs(cell_value(F.col("amount"))[1])
    c = lines(spark, sf_dir).withColumn("x", amount).groupBy("doc").agg(F.count("*").alias("filled"), F.bool_or(F.col("x") > 50000).alias("dynamic"))
    return c.select("doc", F.try_divide("filled", F.lit(8)).alias("coverage"), (F.coalesce(F.try_divide("filled", F.lit(8)) >= 0.5, F.lit(False)) | F.col("dynamic")).alias("text_path"))
