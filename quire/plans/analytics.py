"""Aggregates, rankings, filters and set operations: dashboards, counters, pages of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows
from quire.functions import values as V
from quire.session import table
from quire.sources.sinks import average_confidence

NOW = "2024-01-30"


@query(
    "a1_system_stats",
    f"""
SELECT (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM documents) AS docs, (SELECT count_if(c_acctbal > 0) FROM customer) AS active_users, (SELECT count_if(toxic = 1) FROM labels) AS reviewed,
  (SELECT count_if(quality = 0 AND toxic = 0) FROM labels) AS pending, (SELECT count_if(quality = 1) FROM labels) AS high_confidence, (SELECT count_if(ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) FROM events) AS recent""",
)
def a1_system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven counters, one pass over each table."""
    t = lambda name: table(spark, sf_dir, name)
    parts = [
        t("orders").agg(F.count("*").alias("jobs")),
        t("documents").agg(F.count("*").alias("docs")),
        t("customer").agg(F.count_if(F.col("c_acctbal") > 0).alias("active_users")),
        t("labels").agg(F.count_if(F.col("toxic") == 1).alias("reviewed"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("pending"), F.count_if(F.col("quality") == 1).alias("high_confidence")),
        t("events").agg(F.count_if(F.col("ts") >= F.expr(f"timestamp_ntz'{NOW}' - interval 7 days")).alias("recent")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)  # one row each
    return out


@query(
    "a2_job_counters",
    """
SELECT o_custkey, count(*) AS total, count_if(o_orderstatus <> 'F') AS successful, count_if(o_orderstatus = 'F') AS failed, count_if(o_orderstatus <> 'F' AND o_orderpriority LIKE '1%') AS needs_review,
  coalesce(CAST(count_if(o_orderstatus <> 'F') AS DOUBLE) / count(*), 0) AS success_rate FROM orders GROUP BY o_custkey""",
)
def a2_job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderstatus") != "F"
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("o_orderpriority").startswith("1")).alias("needs_review"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide("successful", "total"), F.lit(0.0)))


@query(
    "a3_average_confidence",
    """
WITH a AS (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 3 WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 1 END AS rank FROM documents LEFT JOIN labels USING (doc_id))
SELECT source, CASE WHEN avg(rank) IS NULL THEN 'N/A' WHEN avg(rank) >= 2.5 THEN 'High' WHEN avg(rank) >= 1.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM a GROUP BY source""",
)
def a3_average_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when(F.col("quality") == 1, "odd").when(F.col("quality") == 0, "low")
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(average_confidence(level).alias("confidence"))


@query(
    "a4_a5_dashboard",
    """
WITH t AS (SELECT count(*) AS docs, count_if(o_orderstatus = 'O') AS ok, count_if(o_orderstatus = 'F') AS failures, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (o_orderstatus = 'O') AS tokens FROM orders)
SELECT docs, ok, failures, CAST(floor(100.0 * ok / docs + 0.5) AS BIGINT) AS success_percent, CAST(tokens AS DOUBLE) AS tokens, round(CAST(tokens AS DOUBLE) / ok, 6) AS mean_tokens, round(CAST(tokens AS DOUBLE) / 1000 * 0.00015, 6) AS cost, round(CAST(tokens AS DOUBLE) / 1000 * 0.00015 / ok * 1000, 6) AS cost_per_thousand FROM t""",
)
def a4_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over completed jobs, failures over all; tokens are summed as decimals."""
    done = F.col("o_orderstatus") == "O"
    t = table(spark, sf_dir, "orders").agg(F.count("*").alias("docs"), F.count_if(done).alias("ok"), F.count_if(F.col("o_orderstatus") == "F").alias("failures"), F.sum(F.when(done, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("tokens"))
    cost = F.col("tokens") / 1000 * 0.00015
    return t.select("docs", "ok", "failures", V.round_half_up(F.lit(100.0) * F.col("ok") / F.col("docs")).cast("long").alias("success_percent"), "tokens", F.round(F.col("tokens") / F.col("ok"), 6).alias("mean_tokens"), F.round(cost, 6).alias("cost"), F.round(cost / F.col("ok") * 1000, 6).alias("cost_per_thousand"))


@query("a6_group_counts", "SELECT coalesce(CASE WHEN lang = 'es' THEN NULL ELSE lang END, 'unknown') AS model, source, count(*) AS n FROM documents GROUP BY ALL")
def a6_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("lang") != "es", F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(model, F.lit("unknown")).alias("model"), "source").agg(F.count("*").alias("n"))


@query(
    "a7_activity_14_days",
    """
WITH m AS (SELECT CAST(max(ts) AS DATE) AS today FROM events), d AS (SELECT CAST(today - CAST(i AS INTEGER) AS DATE) AS day FROM m, range(14) r(i)),
e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18, 4))) AS v FROM events GROUP BY 1)
SELECT day, coalesce(n, 0) AS n, CAST(coalesce(v, 0) AS DOUBLE) AS total FROM d LEFT JOIN e USING (day)""",
)
def a7_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return activity(events, events)


def activity(events: DataFrame, counted: DataFrame) -> DataFrame:
    """The last fourteen days up to the newest event, days without counted events as zero."""
    days = events.agg(F.max("ts").cast("date").alias("today")).select(F.explode(F.sequence(F.date_sub("today", 13), "today")).alias("day"))
    counts = counted.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("v"))
    return F.broadcast(days).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).cast("double").alias("total"))


@query(
    "a8_category_amounts",
    """
SELECT l_returnflag AS category, count(*) AS n, CAST(sum(CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice WHEN l_linenumber % 3 = 1 THEN l_tax ELSE 0 END AS DECIMAL(18, 4))) AS DOUBLE) AS amount FROM lineitem GROUP BY ALL""",
)
def a8_category_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and amount by category: the first of Amount, Debit, Credit that is there, 0 where it is no number."""
    k = F.col("l_linenumber") % 3
    amount = F.when(k == 0, F.format_number("l_extendedprice", 2))
    debit = F.when(k == 1, F.col("l_tax").cast("string"))
    first = F.coalesce(amount, debit, F.lit("n/a"))
    value = F.coalesce(F.regexp_replace(first, "[^0-9.-]", "").try_cast("decimal(18,4)"), F.lit(0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("amount"))


@query("a9_j22_job_totals", "SELECT o_orderkey, count(l_orderkey) AS line_count, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS fields, coalesce(count_if(l_returnflag = 'R'), 0) AS review FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def a9_job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("line_count"), F.sum("l_quantity").cast("long").alias("fields"), F.count_if(F.col("l_returnflag") == "R").alias("review"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("line_count", "fields", "review")]
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", *zero)


@query(
    "a10_users_by_company",
    """
WITH c AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, '(no company)') AS company FROM customer)
SELECT company, c_custkey, count(*) OVER (PARTITION BY company) AS users FROM c""",
)
def a10_users_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with the company and how many users it has; a company may have most of them, so they stay rows and are counted before the join."""
    company = F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit("(no company)"))
    users = table(spark, sf_dir, "customer").select(company.alias("company"), "c_custkey")
    return users.join(users.groupBy("company").agg(F.count("*").alias("users")), "company")


@query(
    "a19_distinct_unions",
    """SELECT l_returnflag, string_agg(l_linestatus, ',' ORDER BY first, l_linestatus) AS statuses FROM (SELECT l_returnflag, l_linestatus, min(l_orderkey) AS first FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""",
)
def a19_distinct_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order in which they are first seen."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min("l_orderkey").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "l_linestatus"))), lambda x: x["l_linestatus"])
    return seen.groupBy("l_returnflag").agg(F.array_join(ordered, ",").alias("statuses"))


@query("a20_extent", "SELECT CAST(p_partkey % 5 AS INTEGER) AS template, max(p_size) AS max_row, CAST(max(p_partkey % 26) AS INTEGER) AS max_col FROM part GROUP BY 1")
def a20_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 5).cast("int").alias("template")).agg(F.max("p_size").alias("max_row"), F.max(F.col("p_partkey") % 26).cast("int").alias("max_col"))


@query("a21_label_multiplicity", "SELECT p_partkey, p_brand || ' ' || p_size AS label, count(*) OVER (PARTITION BY p_brand, p_size) > 1 AS ambiguous FROM part")
def a21_label_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("ambiguous", F.count("*").over(Window.partitionBy("label")) > 1)


@query("a22_next_name", "SELECT coalesce(max(try_cast(regexp_extract('Template-' || c_custkey, '^Template-(\\d+)$', 1) AS BIGINT)), 0) + 1 AS next FROM customer WHERE c_acctbal > 0")
def a22_next_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract(F.concat(F.lit("Template-"), F.col("c_custkey").cast("string")), r"^Template-(\d+)$", 1).try_cast("bigint")
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))


# -- pages, top k, visibility -----------------------------------------------------------------------------------------------------------


@query("t1_f5_jobs_page", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def t1_jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(100).limit(50)


@query("t2_top_types", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 6")
def t2_top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(6)


@query("t3_recent_jobs", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15")
def t3_recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey").limit(15)


@query("t5_dedupe", "SELECT l_returnflag, l_linestatus, l_linenumber, min(l_orderkey) AS first FROM lineitem GROUP BY ALL")
def t5_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by order, by an aggregate instead of a sort."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.min("l_orderkey").alias("first"))


def visible_jobs(jobs: DataFrame, role: str, user: int, client: int, owner: str, company: str) -> DataFrame:
    """All for the super admin, the company's for its admins, else one's own."""
    if role == "super_admin":
        return jobs
    return jobs.filter(F.col(company) == client) if role in ("admin", "company_admin") else jobs.filter(F.col(owner) == user)


@query(
    "f1_job_visibility",
    """
WITH j AS (SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'super_admin' AS role, count(*) AS n FROM j UNION ALL SELECT 'company_admin', count(*) FROM j WHERE c_nationkey = 3 UNION ALL SELECT 'client', count(*) FROM j WHERE o_custkey = 7""",
)
def f1_job_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    parts = [visible_jobs(jobs, role, 7, 3, "o_custkey", "c_nationkey").agg(F.lit(role).alias("role"), F.count("*").alias("n")) for role in ("super_admin", "company_admin", "client")]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "f2_f3_template_visibility",
    """SELECT p_partkey, p_name FROM part WHERE (p_partkey % 10 = 3 OR p_partkey % 97 = 0 OR (p_size > 40 AND p_brand = 'Brand#12')) AND lower(p_name) LIKE '%a%' ORDER BY p_partkey DESC""",
)
def f2_template_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own, default, or shared within the company; then by name, newest first."""
    own, default, shared = F.col("p_partkey") % 10 == 3, F.col("p_partkey") % 97 == 0, (F.col("p_size") > 40) & (F.col("p_brand") == "Brand#12")
    return table(spark, sf_dir, "part").filter((own | default | shared) & F.lower("p_name").contains("a")).select("p_partkey", "p_name").orderBy(F.desc("p_partkey"))


@query(
    "f4_f6_f7_result_filters",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('P') AND o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def f4_result_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a type that may be exported, for a list of ids that comes as a table."""
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").filter(~F.col("o_orderstatus").isin("P") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_orderstatus").join(wanted, "o_orderkey", "left_semi")


@query(
    "f8_f9_client_search",
    """SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (contains(lower(c_name), '99') OR contains(lower(c_mktsegment), 'auto') OR contains(CAST(c_custkey AS VARCHAR), '77') OR contains(CAST(c_nationkey AS VARCHAR), '24'))""",
)
def f8_client_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.lower("c_name").contains("99") | F.lower("c_mktsegment").contains("auto") | F.col("c_custkey").cast("string").contains("77") | F.col("c_nationkey").cast("string").contains("24")
    return table(spark, sf_dir, "customer").filter((F.col("c_acctbal") > 0) & hit).select("c_custkey")


@query(
    "f10_f11_f12_ghost_rows",
    """
WITH a AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'Subtotal' WHEN 1 THEN '' WHEN 2 THEN CAST(l_partkey AS VARCHAR) WHEN 3 THEN 'Shipping fee ' || l_partkey WHEN 4 THEN '1,2-3' WHEN 5 THEN 'Amount Due' ELSE 'Part ' || l_partkey END AS first FROM lineitem),
k AS (SELECT ['subtotal', 'grand total', 'shipping', 'discount', 'charges', 'refund', 'balance due', 'amount due'] AS words)
SELECT count_if(trim(first) <> '' AND NOT list_contains(words, lower(first)) AND NOT regexp_matches(first, '^\\d{1,3}$')) AS result_filter,
  count_if(trim(first) <> '' AND len(list_filter(list_concat(words, ['paid', 'free']), lambda w: contains(lower(first), w))) = 0 AND NOT regexp_matches(first, '^\\d{1,4}$')) AS table_filter,
  count_if(trim(first) <> '' AND NOT regexp_matches(first, '^[\\d,.\\-\\s]{1,6}$') AND NOT list_contains(words, lower(first))) AS loose_filter FROM a, k""",
)
def f10_ghost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules for rows that are no items, kept apart."""
    from quire.functions.registry import SUMMARY_ROWS

    k, part = F.col("l_linenumber") % 7, F.col("l_partkey").cast("string")
    first = F.when(k == 0, "Subtotal").when(k == 1, "").when(k == 2, part).when(k == 3, F.concat(F.lit("Shipping fee "), part)).when(k == 4, "1,2-3").when(k == 5, "Amount Due").otherwise(F.concat(F.lit("Part "), part))
    filled, summary = F.trim(first) != "", F.lower(first).isin(SUMMARY_ROWS)
    inside = F.lit(False)
    for word in [*SUMMARY_ROWS, "paid", "free"]:
        inside = inside | F.lower(first).contains(word)
    return table(spark, sf_dir, "lineitem").agg(F.count_if(filled & ~summary & ~first.rlike(r"^\d{1,3}$")).alias("result_filter"), F.count_if(filled & ~inside & ~first.rlike(r"^\d{1,4}$")).alias("table_filter"), F.count_if(filled & ~first.rlike(r"^[\d,.\-\s]{1,6}$") & ~summary).alias("loose_filter"))


@query("f13_private_keys", "SELECT p_partkey, 2 AS kept FROM part")
def f13_private_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("_label_A1"), F.lit("x"), F.lit("Name"), F.col("p_name"), F.lit("_table_source"), F.lit("t"), F.lit("Brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.map_filter(m, lambda k, _: ~k.startswith("_"))).alias("kept"))


@query("f14_chart_fields", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS n FROM lineitem WHERE l_extendedprice > 0 AND l_extendedprice < 20000 AND l_linenumber % 5 <> 0")
def f14_chart_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that a chart can show: labels of numbers or dates are out, as are amounts out of range."""
    label = F.when(F.col("l_linenumber") % 5 == 0, "Invoice Number").otherwise("Line total")
    value = F.format_number("l_extendedprice", 2)
    n = F.regexp_replace(value, "[^0-9.-]", "").try_cast("double")
    return table(spark, sf_dir, "lineitem").filter(~F.lower(label).rlike("number|date|phone|code|id$") & ~value.rlike(r"^\d{4}-\d{2}-\d{2}")).select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n")).filter("n > 0 and n < 20000")


@query("f15_ordered_projection", "SELECT p_brand AS c1, p_name AS c2, p_size AS c3 FROM part")
def f15_ordered_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a template in its order, the rest left in the file."""
    order = rows(spark, "pos int, name string", [(2, "p_name"), (1, "p_brand"), (3, "p_size")]).orderBy("pos").collect()  # a template's columns
    return table(spark, sf_dir, "part").select(*[F.col(r["name"]).alias(f"c{i + 1}") for i, r in enumerate(order)])


# -- set operations ---------------------------------------------------------------------------------------------------------------------


@query("u1_column_union", "SELECT name, min(pos) AS first FROM (SELECT l_returnflag || l_linestatus AS name, l_orderkey AS pos FROM lineitem) GROUP BY name")
def u1_column_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.min("l_orderkey").alias("first"))


@query("u2_u3_row_union", "SELECT 'customer' AS _table_source, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def u2_row_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda t, p: table(spark, sf_dir, t).select(F.lit(t).alias("_table_source"), F.col(f"{p}key").alias("id"), F.col(f"{p[0]}_name").alias("name"))
    return tag("customer", "c_cust").unionByName(tag("supplier", "s_supp"))


@query("u4_set_operations", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def u4_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id")
    return o.filter("o_orderstatus = 'O'").select("id").intersect(o.filter("o_orderstatus = 'F'").select("id")).subtract(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey"))


@query("u6_map_merge", "SELECT p_partkey, p_name AS name, p_brand AS brand, p_size > 25 AS replaced FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'new', p_brand, true FROM part WHERE p_size > 25")
def u6_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps merged so that the right one wins, without a session setting."""
    a = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    b = F.when(F.col("p_size") > 25, F.create_map(F.lit("name"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    return table(spark, sf_dir, "part").select("p_partkey", merged["name"].alias("name"), merged["brand"].alias("brand"), F.map_contains_key(b, F.lit("name")).alias("replaced"))
