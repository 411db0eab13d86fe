"""Window-shaped rules: carry forward, gaps and islands, slots, push-down, repairs of neighbours, top N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows, values_sql
from quire.session import table


def carry_forward(df: DataFrame, value: str, by: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order))


@query(
    "w1_carry_forward",
    """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM conversations""",
)
def w1_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("own"))
    return turns.select("conv_id", "turn", carry_forward(turns, "own", ["conv_id"], ["turn"]).alias("user_turn"))


def islands(position: Column, end: Column, gap: float, by: list[str], order: list) -> Column:
    """Number of the island of each row: one begins where the position lies over ``gap`` beyond all ends before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when(reach.isNull() | (position - reach > gap), 1).otherwise(0)


@query(
    "w2_gap_islands",
    """
WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > 7200 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS events, min(event_id) AS first_id FROM b GROUP BY ALL""",
)
def w2_gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 1e6").alias("t"))
    marked = events.withColumn("new", islands(F.col("t"), F.col("t"), 7200, ["user_id"], ["ts", "event_id"]))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("user_id", "island").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


@query(
    "w3_x_clusters",
    """
WITH w AS (SELECT l_orderkey AS page, l_partkey, l_extendedprice % 500 AS x0, l_extendedprice % 500 + l_quantity AS x1, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity <= 45),
a AS (SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1, l_partkey, l_suppkey) AS cluster FROM a)
SELECT page, CAST(cluster AS BIGINT) AS cluster, count(*) AS words, round(min(x0), 4) AS lo, round(max(x1), 4) AS hi FROM b GROUP BY ALL""",
)
def w3_x_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of words on a page: words wider than 45 points are dropped, a gap of over 20 beyond the right edge so far begins a column."""
    x0 = F.col("l_extendedprice") % 500
    words = table(spark, sf_dir, "lineitem").filter("l_quantity <= 45").select(F.col("l_orderkey").alias("page"), "l_partkey", "l_suppkey", x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"))
    order = ["x0", "x1", "l_partkey", "l_suppkey"]
    marked = words.withColumn("new", islands(F.col("x0"), F.col("x1"), 20, ["page"], order))
    w = Window.partitionBy("page").orderBy(*order)
    return marked.withColumn("cluster", F.sum("new").over(w)).groupBy("page", "cluster").agg(F.count("*").alias("words"), F.round(F.min("x0"), 4).alias("lo"), F.round(F.max("x1"), 4).alias("hi"))


@query("w4_row_buckets", "SELECT event_id, CAST(round_even(value / 4, 0) * 4 AS BIGINT) AS bucket FROM events")
def w4_row_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows by multiples of four points, halves to the even multiple."""
    return table(spark, sf_dir, "events").select("event_id", (F.bround(F.col("value") / 4, 0) * 4).cast("long").alias("bucket"))


@query(
    "w5_empty_spans",
    """
WITH a AS (SELECT DISTINCT o_custkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS r FROM orders), b AS (SELECT *, lead(r) OVER (PARTITION BY o_custkey ORDER BY r) - r - 1 AS free FROM a)
SELECT o_custkey, r + 1 AS first_free, free FROM b WHERE free >= 2""",
)
def w5_empty_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two or more free rows between neighbouring labels (order days stand for rows)."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    a = table(spark, sf_dir, "orders").select("o_custkey", day.alias("r")).distinct()
    free = F.lead("r").over(Window.partitionBy("o_custkey").orderBy("r")) - F.col("r") - 1
    return a.select("o_custkey", (F.col("r") + 1).alias("first_free"), free.alias("free")).filter("free >= 2")


@query(
    "w6_slot_fill",
    """
WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem)
SELECT l_orderkey, CAST(10 + 2 * n AS BIGINT) AS slot_row, l_partkey, CAST(n AS INTEGER) AS row_no FROM i WHERE n <= 3""",
)
def w6_slot_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th item goes into the i-th of three free rows; what is over is left out."""
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))).filter("n <= 3")
    slots = rows(spark, "n int, slot_row bigint", [(1, 12), (2, 14), (3, 16)])
    return items.join(F.broadcast(slots), "n").select("l_orderkey", "slot_row", "l_partkey", F.col("n").alias("row_no"))


def layout(sections: DataFrame) -> DataFrame:
    """Where each section goes when those above have more rows than their place: bands of one start share their overflow.

    Input: template, section, header_row, start_row, end_row, extracted. Adds overflow, shift, data_start, data_end.
    """
    band = Window.partitionBy("template", "start_row")
    b = sections.withColumns({"band_end": F.max("end_row").over(band), "band_header": F.min("header_row").over(band), "most": F.max("extracted").over(band), "lead": F.row_number().over(band.orderBy("section"))})
    b = b.withColumn("overflow", F.greatest(F.lit(0), F.col("most") - F.greatest(F.lit(1), F.col("band_end") - F.col("start_row") + 1)))
    above = Window.partitionBy("template").orderBy("start_row").rangeBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("shift", F.coalesce(F.sum(F.when(F.col("lead") == 1, F.col("overflow"))).over(above), F.lit(0)))
    return b.select("template", "section", "overflow", "shift", (F.col("band_header") + F.col("shift")).alias("header_at"), (F.col("start_row") + F.col("shift")).alias("data_start"), (F.col("start_row") + F.col("shift") + F.col("extracted") - 1).alias("data_end"))


@query(
    "w8_x5_pushdown",
    """
WITH s AS (SELECT l_orderkey AS template, l_linenumber % 4 AS start_row, l_returnflag AS section, count(*) AS extracted FROM lineitem GROUP BY ALL),
a AS (SELECT template, section, start_row * 3 AS start_row, start_row * 3 + (length(section) + ascii(section)) % 2 AS end_row, extracted FROM s),
b AS (SELECT *, max(end_row) OVER w AS band_end, max(extracted) OVER w AS most FROM a WINDOW w AS (PARTITION BY template, start_row)),
c AS (SELECT DISTINCT template, start_row, greatest(0, most - greatest(1, band_end - start_row + 1)) AS overflow FROM b),
d AS (SELECT *, coalesce(sum(overflow) OVER (PARTITION BY template ORDER BY start_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM c)
SELECT template, section, CAST(overflow AS BIGINT) AS overflow, CAST(shift AS BIGINT) AS shift, CAST(a.start_row - 1 + shift AS BIGINT) AS header_at, CAST(a.start_row + shift AS BIGINT) AS data_start, CAST(a.start_row + shift + extracted - 1 AS BIGINT) AS data_end FROM a JOIN d USING (template, start_row)""",
)
def w8_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("template"), (F.col("l_linenumber") % 4).alias("k"), F.col("l_returnflag").alias("section")).agg(F.count("*").alias("extracted"))
    start = (F.col("k") * 3).cast("long")
    return layout(s.select("template", "section", (start - 1).alias("header_row"), start.alias("start_row"), (start + (F.length("section") + F.ascii("section")) % 2).alias("end_row"), "extracted"))


@query(
    "w7_w9_header_above",
    """
WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber AS header FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT a.l_orderkey, l_linenumber, max(header) AS header, row_number() OVER (PARTITION BY a.l_orderkey, max(header) ORDER BY l_linenumber) AS row_no
FROM a LEFT JOIN h ON a.l_orderkey = h.l_orderkey AND header < l_linenumber GROUP BY a.l_orderkey, l_linenumber""",
)
def w9_header_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest header row strictly above each row, and the row's number below it."""
    flagged = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "R").alias("is_header"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    header = F.last(F.when(F.col("is_header"), F.col("l_linenumber")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = flagged.select("l_orderkey", "l_linenumber", header.alias("header"))
    return out.withColumn("row_no", F.row_number().over(Window.partitionBy("l_orderkey", "header").orderBy("l_linenumber")))


def join_split_decimals(pairs: Column) -> Column:
    """Fields as an ordered array<struct<k, v>>: a number with less than two decimals takes the one or two figures that follow as the next field's value, which goes; a field that was taken takes nothing."""
    plain = lambda v: F.replace(F.trim(v), F.lit(","), F.lit(""))
    size = F.size(pairs)
    indexed = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.when(i + 1 < size, F.trim(F.get(pairs, i + 1)["v"])).alias("n")))
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<struct<k:string,v:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        takes = F.coalesce(p["n"].rlike(r"^\d{1,2}$") & plain(p["v"]).rlike(r"^\d+\.\d?$"), F.lit(False))
        value = F.when(takes, F.concat(plain(p["v"]), p["n"])).otherwise(p["v"])
        return F.when(acc["skip"], F.struct(F.lit(False).alias("skip"), acc["out"].alias("out"))).otherwise(F.struct(takes.alias("skip"), F.concat(acc["out"], F.array(F.struct(p["k"].alias("k"), value.alias("v")))).alias("out")))

    return F.aggregate(indexed, start, step)["out"]


@query(
    "w10_split_decimals",
    """
WITH n AS (SELECT l_orderkey AS doc_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem),
f AS (SELECT doc_id, n, 'k' || n AS k, CASE n % 3 WHEN 1 THEN l_partkey || '.' || l_partkey % 10 WHEN 2 THEN CAST(l_partkey % 10 AS VARCHAR) ELSE '12' END AS v FROM n),
j AS (SELECT a.doc_id, a.n, a.k, a.v || coalesce(b.v, '') AS v FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id AND b.n = a.n + 1 AND a.n % 3 = 1 WHERE a.n % 3 <> 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS pos, k, v FROM j""",
)
def w10_split_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An amount that breaks off after one figure takes the single figure in the next field; what follows stays."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    part, third = F.col("l_partkey"), F.col("n") % 3
    numbered = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", F.row_number().over(w).alias("n"))
    value = F.when(third == 1, F.concat(part.cast("string"), F.lit("."), (part % 10).cast("string"))).when(third == 2, (part % 10).cast("string")).otherwise("12")
    fields = numbered.select("doc_id", F.struct("n", F.concat(F.lit("k"), F.col("n").cast("string")).alias("k"), value.alias("v")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("f"))
    pairs = F.transform("f", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    return fields.select("doc_id", join_split_decimals(pairs).alias("out")).select("doc_id", F.posexplode("out").alias("pos", "p")).select("doc_id", "pos", "p.k", "p.v")


@query(
    "w11_leading_rows",
    """
WITH a AS (SELECT event_type, event_id, CASE WHEN event_id >= 20 AND event_id % 3 = 0 THEN value END AS v FROM events), b AS (SELECT *, bool_or(v IS NOT NULL) OVER (PARTITION BY event_type ORDER BY event_id) AS begun FROM a)
SELECT event_type, count(*) AS rows_kept, min(event_id) AS first_id FROM b WHERE begun GROUP BY event_type""",
)
def w11_leading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before the first with a value in a sparse column go."""
    v = F.when((F.col("event_id") >= 20) & (F.col("event_id") % 3 == 0), F.col("value"))
    a = table(spark, sf_dir, "events").select("event_type", "event_id", v.alias("v"))
    begun = F.max(F.col("v").isNotNull()).over(Window.partitionBy("event_type").orderBy("event_id"))
    return a.withColumn("begun", begun).filter("begun").groupBy("event_type").agg(F.count("*").alias("rows_kept"), F.min("event_id").alias("first_id"))


@query("w13_first_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 30")
def w13_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("event_type", "event_id", n.alias("n")).filter("n <= 30").drop("n")
