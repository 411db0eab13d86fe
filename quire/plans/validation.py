"""Confidence, review and rule checks."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import query, rows, values_sql
from quire.functions import values as V
from quire.functions.registry import CRITICAL, CROSS_CHECKED
from quire.session import table

CUSTOMER_FIELDS = [("c_name", True, "string"), ("c_mktsegment", True, "string"), ("c_acctbal", False, "number"), ("c_phone", True, "string"), ("c_fax", False, "string"), ("c_since", False, "date")]


def validate_schema(values: DataFrame, schema: DataFrame) -> DataFrame:
    """doc_id, n_errors, warnings, low_confidence, completeness, is_valid, needs_review.

    ``values``: doc_id, name, value, confidence; ``schema``: name, required, type. Every document is held against every
    declared field by one aggregate over its values: the schema is a constant map, so no pairs are made.
    """
    declared = schema.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("required", "type")))).alias("declared"))
    there = values.filter("value is not null").join(F.broadcast(declared)).filter(F.expr("map_contains_key(declared, name)"))
    kind, low = F.element_at("declared", F.col("name"))["type"], F.col("confidence") == "low"
    number = F.regexp_replace("value", "[,$€£]", "").try_cast("double").isNull()
    odd = ((kind == "number") & number) | ((kind == "date") & ~F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}"))
    found = there.groupBy("doc_id").agg(F.collect_set("name").alias("names"), F.array_sort(F.collect_set(F.when(low, F.col("name")))).alias("low_confidence"), F.count_if(low).alias("n_low"), F.count_if(odd).alias("n_odd"))
    docs = values.select("doc_id").distinct().join(found, "doc_id", "left").join(F.broadcast(declared))
    entries = F.map_entries("declared")
    names = F.coalesce("names", F.array().cast("array<string>"))
    missing = F.filter(entries, lambda e: ~F.array_contains(names, e["key"]))
    errors = F.size(F.filter(missing, lambda e: e["value"]["required"]))
    warnings = F.size(missing) - errors + F.coalesce("n_low", F.lit(0)) + F.coalesce("n_odd", F.lit(0))
    out = docs.select("doc_id", errors.alias("n_errors"), warnings.alias("warnings"), F.array_join(F.coalesce("low_confidence", F.array().cast("array<string>")), ",").alias("low_confidence"), F.coalesce(F.try_divide(F.size(names), F.size(entries)), F.lit(0.0)).alias("completeness"))
    return out.withColumn("is_valid", F.col("n_errors") == 0).withColumn("needs_review", ~F.col("is_valid") | (F.col("warnings") > 0))


def customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as extracted fields, with gaps, odd numbers and low confidence by key."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    cell = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"), F.when((k + len(name)) % 11 == 0, "low").otherwise("high").alias("confidence"))
    cells = [cell("c_name", F.when(k % 13 != 0, F.col("c_name"))), cell("c_mktsegment", F.col("c_mktsegment")), cell("c_acctbal", F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.format_number("c_acctbal", 2))), cell("c_phone", F.when(k % 3 == 0, F.lit("555"))), cell("c_since", F.when(k % 7 == 0, F.lit("2024-01-05 late")).when(k % 7 == 1, F.lit("05/01/2024"))), cell("undeclared", F.lit("x"))]
    return c.select(k.alias("doc_id"), F.inline(F.array(*cells)))


_CUSTOMER = """
v AS (SELECT c_custkey AS doc_id, n.name, CASE n.name WHEN 'c_name' THEN CASE WHEN c_custkey % 13 <> 0 THEN c_name END WHEN 'c_mktsegment' THEN c_mktsegment WHEN 'c_acctbal' THEN CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE format('{:,.2f}', c_acctbal) END
  WHEN 'c_phone' THEN CASE WHEN c_custkey % 3 = 0 THEN '555' END WHEN 'c_since' THEN CASE WHEN c_custkey % 7 = 0 THEN '2024-01-05 late' WHEN c_custkey % 7 = 1 THEN '05/01/2024' END ELSE 'x' END AS value,
  CASE WHEN (c_custkey + length(n.name)) % 11 = 0 THEN 'low' ELSE 'high' END AS confidence FROM customer, (VALUES ('c_name'), ('c_mktsegment'), ('c_acctbal'), ('c_phone'), ('c_since'), ('undeclared')) n(name))"""


@query(
    "v1_v2_a11_schema_validation",
    f"""
WITH {_CUSTOMER}, s AS (SELECT * FROM {values_sql("name, required, type", CUSTOMER_FIELDS)}),
j AS (SELECT d.doc_id, s.name, s.required, s.type, v.value, v.confidence FROM (SELECT DISTINCT doc_id FROM v) d CROSS JOIN s LEFT JOIN v ON v.doc_id = d.doc_id AND v.name = s.name),
a AS (SELECT doc_id, count_if(value IS NULL AND required) AS n_errors, count_if(value IS NULL AND NOT required) + count_if(value IS NOT NULL AND confidence = 'low') + count_if(value IS NOT NULL AND type = 'number' AND try_cast(regexp_replace(value, '[,$€£]', '', 'g') AS DOUBLE) IS NULL) + count_if(value IS NOT NULL AND type = 'date' AND NOT regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS warnings,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (value IS NOT NULL AND confidence = 'low'), '') AS low_confidence, CAST(count(value) AS DOUBLE) / count(*) AS completeness FROM j GROUP BY doc_id)
SELECT *, n_errors = 0 AS is_valid, n_errors > 0 OR warnings > 0 AS needs_review FROM a""",
)
def v1_schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_schema(customer_values(spark, sf_dir), rows(spark, "name string, required boolean, type string", CUSTOMER_FIELDS))


@query(
    "j3_required_missing",
    f"WITH {_CUSTOMER}, s AS (SELECT * FROM {values_sql('name, required, type', CUSTOMER_FIELDS)}) SELECT d.doc_id, s.name FROM (SELECT DISTINCT doc_id FROM v) d CROSS JOIN s WHERE required AND NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = d.doc_id AND v.name = s.name AND value IS NOT NULL)",
)
def j3_required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required fields that a document lacks: the declared names less its own, an array difference per document."""
    required = [n for n, need, _ in CUSTOMER_FIELDS if need]
    own = customer_values(spark, sf_dir).groupBy("doc_id").agg(F.collect_set(F.when(F.col("value").isNotNull(), F.col("name"))).alias("own"))
    return own.select("doc_id", F.explode(F.array_except(F.array(*map(F.lit, required)), "own")).alias("name"))


@query(
    "v3_line_item_confidence",
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem)
SELECT l_orderkey AS doc_id, 'line_items[' || i || '].' || f AS field FROM i, (VALUES ('l_tax'), ('l_discount')) t(f) WHERE (l_partkey + length(f)) % 10 = 0""",
)
def v3_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w) - 1)
    fields = items.select("l_orderkey", "l_partkey", "i", F.explode(F.array(F.lit("l_tax"), F.lit("l_discount"))).alias("f"))
    return fields.filter((F.col("l_partkey") + F.length("f")) % 10 == 0).select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("line_items["), F.col("i").cast("string"), F.lit("]."), F.col("f")).alias("field"))


_SNIPPETS = """SELECT item_id, d.doc_id, CASE item_id % 8 WHEN 0 THEN b.text[11:40] WHEN 1 THEN translate(d.text[5:30], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN 'a' WHEN 3 THEN '90210' || item_id WHEN 4 THEN '2024-01-05' WHEN 5 THEN '8410.00' WHEN 6 THEN '2024-13-05' ELSE ' ' END AS value,
  d.text || CASE d.doc_id % 5 WHEN 0 THEN ' dated 05/01/2024, sum $8,410' WHEN 1 THEN ' on JAN 5, $8,410.00 due' WHEN 2 THEN ' the 5 January' WHEN 3 THEN ' 05-01-2024' ELSE '' END AS text
FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id"""


@query(
    "v4_value_in_text",
    f"""
WITH s AS ({_SNIPPETS}), t AS (SELECT *, trim(value) AS v, lower(text) AS low FROM s),
f AS (SELECT *, length(v) < 2 OR contains(low, lower(v)) OR (length(regexp_replace(v, '[^0-9.]', '', 'g')) >= 4 AND contains(regexp_replace(text, '[^0-9.]', '', 'g'), regexp_replace(v, '[^0-9.]', '', 'g'))) AS found,
  CASE item_id % 8 WHEN 4 THEN regexp_matches(low, '05/01/2024|01/05/2024|05-01-2024|january 5|5 january|jan 5|5 jan') WHEN 5 THEN contains(replace(text, ',', ''), '8410') ELSE false END AS variant FROM t)
SELECT item_id, doc_id, CASE WHEN v = '' OR found THEN 'high' WHEN variant THEN 'medium' ELSE 'low' END AS level, CASE WHEN v = '' THEN 'empty' WHEN found THEN 'text' WHEN variant THEN 'variant' ELSE 'none' END AS confirmed FROM f""",
)
def v4_value_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is asked for a value of one item, of eight kinds: parts of texts, dates and amounts in other writings, figures, blanks."""
    return _snippets(spark, sf_dir).select("item_id", "doc_id", V.text_check(F.col("value"), F.col("text")).alias("c")).select("item_id", "doc_id", "c.level", "c.confirmed")


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    many = b.agg((F.max("item_id") + 1).alias("many"))  # one row
    docs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(many)).withColumn("item_id", F.col("doc_id") % F.col("many"))
    k, d = F.col("item_id") % 8, F.col("doc_id") % 5
    value = F.when(k == 0, F.substring("item", 11, 30)).when(k == 1, F.translate(F.substring("text", 5, 26), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(k == 2, "a").when(k == 3, F.concat(F.lit("90210"), F.col("item_id").cast("string"))).when(k == 4, "2024-01-05").when(k == 5, "8410.00").when(k == 6, "2024-13-05").otherwise(" ")
    text = F.concat("text", F.when(d == 0, " dated 05/01/2024, sum $8,410").when(d == 1, " on JAN 5, $8,410.00 due").when(d == 2, " the 5 January").when(d == 3, " 05-01-2024").otherwise(""))
    return docs.join(b, "item_id").select("item_id", "doc_id", value.alias("value"), text.alias("text"))


@query(
    "v7_v9_presence",
    f"""WITH s AS ({_SNIPPETS}), q AS (SELECT *, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS v, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM s),
c AS (SELECT item_id, doc_id, CASE WHEN v = '' OR contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), v) THEN 'high' WHEN d <> '' AND contains(regexp_replace(text, '[^0-9]', '', 'g'), d) THEN 'medium' ELSE 'low' END AS level FROM q)
SELECT item_id, doc_id, level, CASE WHEN level = 'high' THEN 'medium' ELSE level END AS scanned FROM c""",
)
def v7_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = V.presence(F.col("value"), F.col("text"))
    return _snippets(spark, sf_dir).select("item_id", "doc_id", level.alias("level")).withColumn("scanned", F.when(F.col("level") == "high", "medium").otherwise(F.col("level")))


def overall(levels: DataFrame, by: str = "doc_id") -> DataFrame:
    """The worst level of each document; scanned ones are medium and always reviewed."""
    worst = F.min_by("level", V.confidence_rank(F.col("level")))
    return levels.groupBy(by).agg(F.when(F.bool_or("scanned"), "medium").otherwise(worst).alias("overall"), (F.bool_or("scanned") | (F.count_if(F.col("level") == "low") > 0)).alias("needs_review"))


@query(
    "v9_v12_overall",
    """
WITH l AS (SELECT l_orderkey AS doc_id, CASE WHEN l_tax > 0.07 THEN 'low' WHEN l_tax > 0.03 THEN 'medium' ELSE 'high' END AS level, l_orderkey % 9 = 0 AS scanned FROM lineitem)
SELECT doc_id, CASE WHEN bool_or(scanned) THEN 'medium' WHEN count_if(level = 'low') > 0 THEN 'low' WHEN count_if(level = 'medium') > 0 THEN 'medium' ELSE 'high' END AS overall, bool_or(scanned) OR count_if(level = 'low') > 0 AS needs_review FROM l GROUP BY doc_id""",
)
def v9_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("l_tax") > 0.07, "low").when(F.col("l_tax") > 0.03, "medium").otherwise("high")
    return overall(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), level.alias("level"), (F.col("l_orderkey") % 9 == 0).alias("scanned")))


@query(
    "v5_a13_a14_section_totals",
    """
WITH s AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS declared, sum(abs(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_orderkey, CAST(declared AS DOUBLE) AS declared, CAST(coalesce(total, 0) AS DOUBLE) AS total FROM s WHERE declared > 0 AND abs(CAST(coalesce(total, 0) AS DOUBLE) - CAST(declared AS DOUBLE)) / CAST(declared AS DOUBLE) > 0.01""",
)
def v5_section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared totals that the sum of the items misses by more than one per cent."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.abs(F.col("l_extendedprice").cast("decimal(18,2)"))).alias("sum"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("declared")).join(sums, "o_orderkey", "left")
    total = F.coalesce("sum", F.lit(0)).cast("double")
    return joined.select("o_orderkey", "declared", total.alias("total")).filter((F.col("declared") > 0) & (F.abs(F.col("total") - F.col("declared")) / F.col("declared") > 0.01))


def table_rules(lines: DataFrame, by: str, minimum: int, filled: list[str], numeric: list[str], positive: list[str], keywords: list[tuple[str, list[str]]]) -> DataFrame:
    """by, check, ok of the rules of a table's rows, by one aggregate: enough rows, columns filled in four rows of five, figures where there should be, and rows that must occur."""
    value = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    figure = lambda c: F.regexp_replace(value(c), "[,$€£ ]", "").try_cast("double")
    share = lambda c: F.count_if(value(c) != "") / F.count("*")
    checks = {"table:rows": F.count("*") >= minimum}
    checks |= {f"filled:{c}": share(c) >= 0.8 for c in filled}
    checks |= {f"numeric:{c}": F.count_if((value(c) != "") & figure(c).isNull()) == 0 for c in numeric}
    checks |= {f"positive:{c}": F.count_if((value(c) != "") & ~F.coalesce(figure(c) > 0, F.lit(False))) == 0 for c in positive}
    speaks = lambda c, words: functools.reduce(Column.__or__, [F.lower(value(c)).contains(w) for w in words])
    checks |= {f"row:{words[0]}": F.bool_or(speaks(c, words)) for c, words in keywords}
    done = lines.groupBy(by).agg(*[x.alias(f"c{i}") for i, x in enumerate(checks.values())])
    return done.select(by, F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("ok")) for i, name in enumerate(checks)])))


@query(
    "v14_table_rules",
    """
WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN ' ' ELSE 'part ' || l_partkey END AS name, CASE WHEN l_partkey % 50 = 0 THEN 'n/a' WHEN l_partkey % 9 = 0 THEN '' ELSE printf('%.0f', l_quantity) END AS qty, CASE WHEN l_linenumber % 5 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS price, l_shipdate FROM lineitem),
a AS (SELECT l_orderkey, count(*) >= 3 AS r, count_if(name <> ' ') / count(*) >= 0.8 AS f, count_if(qty = 'n/a') = 0 AS q, count_if(price <= 0) = 0 AS p, bool_or(name LIKE '%t 1%' OR name LIKE '%99%') AS k FROM l GROUP BY 1)
SELECT l_orderkey, unnest(['table:rows', 'filled:name', 'numeric:qty', 'positive:price', 'row:t 1']) AS "check", unnest([r, f, q, p, k]) AS ok FROM a""",
)
def v14_table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(part % 4 == 0, " ").otherwise(F.concat(F.lit("Part "), part.cast("string"))).alias("name"), F.when(part % 50 == 0, "n/a").when(part % 9 == 0, "").otherwise(F.format_string("%.0f", "l_quantity")).alias("qty"),
        F.concat(F.lit("$"), F.when(F.col("l_linenumber") % 5 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)").cast("string")).alias("price"),
    )
    return table_rules(lines, "l_orderkey", 3, ["name"], ["qty"], ["price"], [("name", ["t 1", "99"])])


def against_truth(values: DataFrame, truth: DataFrame) -> DataFrame:
    """doc_id, name, status of every expected value: MISSING without one, PASS where the two are equal but for blanks around them, else FAIL."""
    got = F.trim("value")
    joined = truth.join(values.select("doc_id", "name", "value"), ["doc_id", "name"], "left")
    return joined.select("doc_id", "name", F.when(F.coalesce(got, F.lit("")) == "", "MISSING").when(got == F.trim("expected"), "PASS").otherwise("FAIL").alias("status"))


@query(
    "v14_ground_truth",
    """
SELECT o_orderkey AS doc_id, 'status' AS name, CASE o_orderkey % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'FAIL' WHEN 3 THEN 'MISSING' ELSE 'PASS' END AS status FROM orders""",
)
def v14_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit("status").alias("name"), "o_orderstatus")
    found = F.when(F.col("doc_id") % 5 == 1, "?").when(F.col("doc_id") % 5 == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus")))
    values = orders.filter("doc_id % 5 != 0").select("doc_id", "name", found.alias("value"))
    return against_truth(values, orders.select("doc_id", "name", F.concat("o_orderstatus", F.lit(" ")).alias("expected")))


@query("v14_row_product", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice <> 0 AND abs(l_quantity * p_retailprice - l_extendedprice) / abs(l_extendedprice) <= 0.02")
def v14_row_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose quantity times price is within two per cent of the subtotal."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    joined = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    close = F.try_divide(F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")), F.abs("l_extendedprice")) <= 0.02
    return joined.filter(close).select("l_orderkey", "l_linenumber", "l_partkey")


@query("v14_mutually_exclusive", "SELECT l_returnflag, l_linestatus, count(*) AS n, count_if(l_discount > 0.05 AND l_tax > 0.05) AS both, count_if(l_discount <= 0.05 AND l_tax <= 0.05) AS neither FROM lineitem GROUP BY ALL")
def v14_mutually_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    debit, credit = F.col("l_discount") > 0.05, F.col("l_tax") > 0.05
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(debit & credit).alias("both"), F.count_if(~debit & ~credit).alias("neither"))


Rule = tuple[str, Column]
EVENT_RULES = "required numeric date pattern prohibited positive".split()


@query(
    "v14_a18_rule_set",
    """
WITH e AS (SELECT event_type AS doc_type, event_id, CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'N/A' WHEN event_id % 23 = 0 THEN '-3.5' ELSE printf('%.2f', value) END AS v, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events),
c AS (SELECT doc_type, event_id, unnest([{'rule': 'required', 'ok': v <> ''}, {'rule': 'numeric', 'ok': try_cast(v AS DOUBLE) IS NOT NULL}, {'rule': 'date', 'ok': regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$')}, {'rule': 'pattern', 'ok': regexp_matches(v, '^\\d+(\\.\\d{1,2})?$')}, {'rule': 'prohibited', 'ok': v NOT IN ('N/A', 'null', 'None', 'n/a')}, {'rule': 'positive', 'ok': coalesce(try_cast(v AS DOUBLE) > 0, false)}]) AS r FROM e),
p AS (SELECT doc_type, event_id, count_if(r.ok) AS ok, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_type, count(*) AS docs, count_if(ok >= 0.75 * n) AS passed, CAST(sum(ok) AS BIGINT) AS checks_ok, CAST(sum(n) AS BIGINT) AS checks FROM p GROUP BY doc_type""",
)
def v14_rule_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against a rule set, passed at three quarters of its checks, by type."""
    k = F.col("event_id")
    v = F.when(k % 17 == 0, "").when(k % 19 == 0, "N/A").when(k % 23 == 0, "-3.5").otherwise(F.format_string("%.2f", "value"))
    number = F.col("v").try_cast("double")
    rules: list[Rule] = [("required", F.col("v") != ""), ("numeric", number.isNotNull()), ("date", F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}$")), ("pattern", F.col("v").rlike(r"^\d+(\.\d{1,2})?$")), ("prohibited", ~F.col("v").isin("N/A", "null", "None", "n/a")), ("positive", F.coalesce(number > 0, F.lit(False)))]
    ok = sum((c.cast("int") for _, c in rules), F.lit(0))
    checked = table(spark, sf_dir, "events").select(F.col("event_type").alias("doc_type"), v.alias("v"), F.col("ts").cast("date").cast("string").alias("d")).withColumn("ok", ok)
    return checked.groupBy("doc_type").agg(F.count("*").alias("docs"), F.count_if(F.col("ok") >= 0.75 * len(rules)).alias("passed"), F.sum("ok").alias("checks_ok"), (F.count("*") * len(rules)).alias("checks"))


def fill_rates(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Fill counts of columns by group, and whether they differ by over a quarter; groups under three rows are let pass."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if((F.col(c) != "") & F.col(c).isNotNull()).alias(c) for c in columns])
    high, low = F.greatest(*columns), F.least(*columns)
    sparse = F.array_compact(F.array(*[F.when(F.col(c) < 0.75 * high, F.lit(c)) for c in columns]))
    bad = (F.col("n") >= 3) & F.coalesce(F.try_divide(high - low, high) > 0.25, F.lit(False))
    return counts.select(by, "n", high.alias("max_fill"), low.alias("min_fill"), bad.alias("misaligned"), F.when(bad, F.array_join(sparse, ",")).otherwise("").alias("sparse"))


@query(
    "v6_a12_row_alignment",
    """
WITH e AS (SELECT event_type, CASE WHEN event_type = 'click' AND event_id % 3 <> 0 THEN '' ELSE 'x' END AS a, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'y' END AS b, 'z' AS c FROM events),
f AS (SELECT event_type, count(*) AS n, count_if(a <> '') AS fa, count_if(b <> '') AS fb, count_if(c <> '') AS fc FROM e GROUP BY ALL), g AS (SELECT *, greatest(fa, fb, fc) AS hi, least(fa, fb, fc) AS lo FROM f)
SELECT event_type, n, hi AS max_fill, lo AS min_fill, CAST(hi - lo AS DOUBLE) / hi > 0.25 AS misaligned, CASE WHEN CAST(hi - lo AS DOUBLE) / hi > 0.25 THEN array_to_string(list_filter([CASE WHEN fa < 0.75 * hi THEN 'a' END, CASE WHEN fb < 0.75 * hi THEN 'b' END, CASE WHEN fc < 0.75 * hi THEN 'c' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS sparse FROM g""",
)
def v6_row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.when((F.col("event_type") == "click") & (k % 3 != 0), "").otherwise("x").alias("a"), F.when(k % 10 != 0, "y").alias("b"), F.lit("z").alias("c"))
    return fill_rates(e, "event_type", ["a", "b", "c"])


@query(
    "v8_completeness",
    """
WITH a AS (SELECT o_orderkey, count(l_orderkey) AS actual, o_orderkey % 7 AS expected FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT o_orderkey, actual, expected FROM a WHERE expected > 0 AND actual < 0.8 * expected""",
)
def v8_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("actual"))
    a = table(spark, sf_dir, "orders").select("o_orderkey").join(actual, "o_orderkey", "left").select("o_orderkey", F.coalesce("actual", F.lit(0)).alias("actual"), (F.col("o_orderkey") % 7).alias("expected"))
    return a.filter("expected > 0 and actual < 0.8 * expected")


@query(
    "v10_v11_review_escalation",
    f"""
WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'payslip' WHEN 1 THEN 'cheque' ELSE 'sales_invoice' END AS kind, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, coalesce(toxic, 0) > 0 OR (kind IN ({", ".join(f"'{x}'" for x in CRITICAL)}) AND quality = 0) IS TRUE OR doc_id % 29 = 0 AS needs_review, CASE WHEN length(text) < 80 THEN 'medium' WHEN quality = 0 THEN 'low' ELSE 'high' END AS level, kind IN ({", ".join(f"'{x}'" for x in CROSS_CHECKED)}) AS cross_checked FROM a""",
)
def v11_review_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, low confidence of a critical type or misalignment send a document to review; short texts are not judged by presence."""
    k = F.col("doc_id") % 3
    joined = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), F.when(k == 0, "payslip").when(k == 1, "cheque").otherwise("sales_invoice").alias("kind")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flagged, low, crooked = F.coalesce("toxic", F.lit(0)) > 0, F.col("kind").isin(CRITICAL) & F.coalesce(F.col("quality") == 0, F.lit(False)), F.col("doc_id") % 29 == 0
    return joined.select("doc_id", (flagged | low | crooked).alias("needs_review"), F.when(F.col("size") < 80, "medium").when(F.col("quality") == 0, "low").otherwise("high").alias("level"), F.col("kind").isin(CROSS_CHECKED).alias("cross_checked"))


@query(
    "v13_review_actions",
    """SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS last_action, arg_max(event_type IN ('click', 'purchase'), (ts, event_id)) AS reviewed FROM events GROUP BY user_id""",
)
def v13_review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the last of a log of actions leaves."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_action")).withColumn("reviewed", F.col("last_action").isin("click", "purchase"))
