"""Scalar functions over rendered amounts, dates, names and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query, rows, values_sql
from quire.functions import values as V
from quire.functions.registry import CURRENCIES, FIELDS, PREFIXES
from quire.session import table

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def rendered_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as documents print them: with signs, commas, brackets, K and M, blanks or nothing."""
    x, k = F.col("o_totalprice"), F.pmod(F.col("o_orderkey"), F.lit(8))
    comma = F.format_number(x, 2)
    raw = F.when(k == 0, F.concat(F.lit("$"), comma)).when(k == 1, F.concat(F.lit("("), comma, F.lit(")"))).when(k == 2, F.concat(F.floor(x / 1000).cast("string"), F.lit("K"))).when(k == 3, F.concat(F.lit("  £ "), comma, F.lit(" "))).when(k == 4, F.lit("N/A")).when(k == 5, F.col("o_orderkey").cast("string")).when(k == 6, comma).otherwise(F.concat(F.lit("€"), F.floor(x / 1000000 + 1).cast("string"), F.lit(".5MM")))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


_AMOUNTS = r"""
SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN '(' || format('{:,.2f}', o_totalprice) || ')'
  WHEN 2 THEN CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || 'K' WHEN 3 THEN '  £ ' || format('{:,.2f}', o_totalprice) || ' '
  WHEN 4 THEN 'N/A' WHEN 5 THEN CAST(o_orderkey AS VARCHAR) WHEN 6 THEN format('{:,.2f}', o_totalprice)
  ELSE '€' || CAST(CAST(floor(o_totalprice / 1000000 + 1) AS BIGINT) AS VARCHAR) || '.5MM' END AS raw FROM orders"""


@query(
    "n1_normalize_amounts",
    rf"""
WITH a AS ({_AMOUNTS}), b AS (SELECT o_orderkey, raw, {_STRIP.format("raw")} AS s FROM a),
c AS (SELECT *, replace(regexp_replace(s, '^([$£€₹¥]\s*)+', ''), ',', '') AS n FROM b)
SELECT o_orderkey, raw,
  CASE WHEN lower(s) IN ('', 'null', 'n/a', 'none', 'not found', '–', '-') THEN 'empty' WHEN regexp_matches(s, '^\([0-9,]+\.?[0-9]*\)$') THEN 'negative'
    WHEN regexp_matches(n, '^-?[0-9.]+([Kk]|[Mm][Mm]?)$') THEN 'scaled' WHEN regexp_matches(n, '^-?[0-9]+\.?[0-9]*$') AND (regexp_matches(s, '^[$£€₹¥]') OR contains(s, ',') OR contains(n, '.')) THEN 'amount' ELSE 'text' END AS kind,
  CASE WHEN lower(s) IN ('', 'null', 'n/a', 'none', 'not found', '–', '-') THEN '' WHEN regexp_matches(s, '^\([0-9,]+\.?[0-9]*\)$') THEN '-' || replace(regexp_extract(s, '^\(([0-9,]+\.?[0-9]*)\)$', 1), ',', '')
    WHEN regexp_matches(n, '^-?[0-9.]+([Kk]|[Mm][Mm]?)$') OR (regexp_matches(n, '^-?[0-9]+\.?[0-9]*$') AND (regexp_matches(s, '^[$£€₹¥]') OR contains(s, ',') OR contains(n, '.'))) THEN n ELSE s END AS text,
  CASE WHEN regexp_matches(s, '^\([0-9,]+\.?[0-9]*\)$') THEN -try_cast(replace(regexp_extract(s, '^\(([0-9,]+\.?[0-9]*)\)$', 1), ',', '') AS DOUBLE)
    WHEN regexp_matches(n, '^-?[0-9.]+[Kk]$') THEN try_cast(regexp_replace(n, '[Kk]$', '') AS DOUBLE) * 1000 WHEN regexp_matches(n, '^-?[0-9.]+[Mm][Mm]?$') THEN try_cast(regexp_replace(n, '[Mm]+$', '') AS DOUBLE) * 1000000
    WHEN regexp_matches(n, '^-?[0-9]+\.?[0-9]*$') AND (regexp_matches(s, '^[$£€₹¥]') OR contains(s, ',') OR contains(n, '.')) THEN try_cast(n AS DOUBLE) END AS num
FROM c""",
)
def normalize_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_amounts(spark, sf_dir).withColumn("v", V.normalize(F.col("raw"))).select("o_orderkey", "raw", "v.kind", "v.text", "v.num")


@query(
    "n1_normalize_dates",
    r"""
WITH a AS (SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m-%d-%Y')
  WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y') WHEN 3 THEN strftime(o_orderdate, '%b. %d, %Y') ELSE '13/45/2024' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 = 4 THEN '2024-13-45' ELSE strftime(d, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 5 <> 4 THEN CAST(d AS DATE) END AS typed FROM a""",
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(5))
    raw = F.when(k == 0, F.date_format(d, "MM/dd/yyyy")).when(k == 1, F.date_format(d, "MM-dd-yyyy")).when(k == 2, F.date_format(d, "d MMMM yyyy")).when(k == 3, F.date_format(d, "MMM. dd, yyyy")).otherwise("13/45/2024")
    out = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("iso", V.iso_date(F.col("raw")))
    return out.withColumn("typed", F.expr("cast(try_to_timestamp(iso, 'yyyy-MM-dd') as date)"))


@query(
    "n2_clean_by_field",
    rf"""
WITH a AS ({_AMOUNTS}), b AS (SELECT o_orderkey, raw, CASE WHEN o_orderkey % 3 = 0 THEN 'Total Amount' WHEN o_orderkey % 3 = 1 THEN 'Net Unit Price' ELSE 'Note' END AS key FROM a)
SELECT o_orderkey, key, CASE WHEN o_orderkey % 3 < 2 THEN regexp_replace(regexp_replace({_STRIP.format("raw")}, '[£€$¥₹,\s]', '', 'g'), '^\((.+)\)$', '-\1') ELSE {_STRIP.format("raw")} END AS value FROM b""",
)
def clean_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod(F.col("o_orderkey"), F.lit(3))
    key = F.when(k == 0, "Total Amount").when(k == 1, "Net Unit Price").otherwise("Note")
    return rendered_amounts(spark, sf_dir).withColumn("key", key).select("o_orderkey", "key", V.clean_numeric(F.col("raw"), F.col("key"), FIELDS["sales_invoice"]["numeric"]).alias("value"))


@query(
    "n3_money",
    rf"""
WITH a AS ({_AMOUNTS}), b AS (SELECT *, regexp_replace({_STRIP.format("raw")}, '[,$£€]', '', 'g') AS t FROM a)
SELECT o_orderkey, try_cast(regexp_replace(t, '^\((.*)\)$', '-\1') AS DOUBLE) AS amount FROM b""",
)
def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_amounts(spark, sf_dir).select("o_orderkey", V.money(F.col("raw")).alias("amount"))


@query(
    "n4_n5_n9_squeeze_slug_collapse",
    r"""
WITH a AS (SELECT p_partkey, '  ' || p_name || '   /  ' || p_brand || chr(9) || p_type || ' ' AS raw FROM part)
SELECT p_partkey, regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') AS squeezed, regexp_replace(raw, '[^0-9]', '', 'g') AS figures,
  regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS collapsed FROM a""",
)
def squeeze_slug_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit("   /  "), F.col("p_brand"), F.lit("\t"), F.col("p_type"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", V.squeeze(raw).alias("squeezed"), V.digits(raw).alias("figures"), V.slug(raw).alias("slug"), V.collapse(raw).alias("collapsed"))


@query(
    "n6_cell_references",
    """
WITH a AS (SELECT p_partkey, CAST(p_partkey % 702 AS INTEGER) AS c, CAST(p_partkey // 7 AS INTEGER) AS r FROM part)
SELECT p_partkey, r, c, CASE WHEN c < 26 THEN chr(65 + c) ELSE chr(64 + c // 26) || chr(65 + c % 26) END || CAST(r + 1 AS VARCHAR) AS ref, c AS back_c, r AS back_r FROM a""",
)
def cell_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", F.expr("cast(p_partkey div 7 as int)").alias("r"), (F.col("p_partkey") % 702).cast("int").alias("c")).withColumn("ref", V.cell_ref(F.col("r"), F.col("c")))
    return a.select("*", V.column_number(F.regexp_extract("ref", "^([A-Z]+)", 1)).alias("back_c"), V.ref_row(F.col("ref")).alias("back_r"))


@query(
    "n7_word_jaccard",
    r"""
WITH a AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(string_split(lower(p_type), ' ')) AS t, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS y FROM part)
SELECT p_partkey, CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) AS score, CAST(least(len(x), len(t)) AS DOUBLE) / greatest(len(x), len(t)) AS ratio FROM a""",
)
def word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, t, y = V.words(F.col("p_name")), V.words(F.lower("p_type")), V.words(F.concat_ws(" ", "p_name", F.lower("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", V.jaccard(x, y).alias("score"), V.count_ratio(x, t).alias("ratio"))


@query(
    "n8_signed_numbers",
    rf"""
WITH a AS ({_AMOUNTS}), b AS (SELECT *, {_STRIP.format("raw")} AS t FROM a)
SELECT o_orderkey, regexp_matches(replace(raw, ' ', ''), '^[\$\-\(\)]?[\d,]+(?:\.\d{{1,2}})?[\)]?$') AS numeric_look,
  CASE WHEN regexp_matches(t, '^\(.*\)$') THEN '-' || {_STRIP.format("regexp_replace(t, '[(),$]', '', 'g')")} ELSE {_STRIP.format("regexp_replace(t, '[,$]', '', 'g')")} END AS signed FROM b""",
)
def signed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_amounts(spark, sf_dir).select("o_orderkey", V.looks_numeric(F.col("raw")).alias("numeric_look"), V.signed(F.col("raw")).alias("signed"))


_SIGNS = [s for s in CURRENCIES]


@query(
    "n10_currency_codes",
    f"""
WITH signs AS (SELECT *, row_number() OVER () AS pos FROM {values_sql("sign, code", list(CURRENCIES.items()))}), a AS (
  SELECT o_orderkey, (SELECT sign FROM signs WHERE pos = o_orderkey % 12 + 1) AS s, format('{{:,.2f}}', o_totalprice) AS n FROM orders)
SELECT o_orderkey, coalesce(code, '') AS code, replace(n, ',', '') AS number_text FROM (SELECT o_orderkey, s, CASE WHEN s IS NULL THEN replace(n, ',', '') ELSE n END AS n FROM a) LEFT JOIN signs ON sign = s""",
)
def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 12 + 1).cast("int")
    n = F.format_number("o_totalprice", 2)
    raw = F.when(k <= len(_SIGNS), F.concat(F.try_element_at(F.array(*map(F.lit, _SIGNS)), k), n)).otherwise(F.replace(n, F.lit(","), F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", V.currency_code(F.col("raw")).alias("code"), V.currency_number(F.col("raw")).alias("number_text"))


@query(
    "n11_type_keys",
    r"""
SELECT DISTINCT p_type, replace(replace(replace(lower(trim(p_type)), ' ', '_'), '-', '_'), '/', '_') AS key,
  array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""",
)
def type_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_type").distinct().withColumn("key", V.type_key(F.col("p_type"))).withColumn("title", V.title(F.col("key")))


@query(
    "n12_upper_share",
    r"""
SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) END AS share,
  coalesce(CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 THEN CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) END > 0.5, false) AS heading FROM documents""",
)
def upper_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.upper_share(F.col("text")).alias("share")).withColumn("heading", F.coalesce(F.col("share") > 0.5, F.lit(False)))


@query(
    "n13_label_stems",
    """WITH p AS (SELECT p_partkey, p_name || ['', ' ASSETS', ' LIABILITIES', ' Stockholders equity', ' shareholder funds', ' Stockholder notes'][1 + p_partkey % 6] AS label FROM part)
SELECT p_partkey, label, CASE p_partkey % 6 WHEN 1 THEN 'asset' WHEN 2 THEN 'liabilit' WHEN 3 THEN 'equity' WHEN 4 THEN 'shareholder' WHEN 5 THEN 'stockholder' END AS stem FROM p""",
)
def label_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ["", " ASSETS", " LIABILITIES", " Stockholders equity", " shareholder funds", " Stockholder notes"]))
    labels = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.get(ends, (F.col("p_partkey") % 6).cast("int"))).alias("label"))
    return labels.withColumn("stem", V.stem(F.col("label")))


@query(
    "n14_n15_file_names",
    f"""
WITH p AS (SELECT prefix, kind, row_number() OVER () AS pos FROM {values_sql("prefix, kind", list(PREFIXES.items()))}),
a AS (SELECT p_partkey, 'in/box & co/' || coalesce((SELECT lower(prefix) FROM p WHERE pos = p_partkey % 16 + 1), 'zzz') || '-' || p_name || '#' || p_size || '.pdf' AS path FROM part),
b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM a)
SELECT p_partkey, regexp_replace(name, '[ &?#%+=<>|"'']', '_', 'g') AS safe, kind FROM b LEFT JOIN p ON prefix = upper(string_split(name, '-')[1])""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.coalesce(F.lower(F.try_element_at(F.array(*map(F.lit, PREFIXES)), (F.col("p_partkey") % 16 + 1).cast("int"))), F.lit("zzz"))
    path = F.concat(F.lit("in/box & co/"), prefix, F.lit("-"), F.col("p_name"), F.lit("#"), F.col("p_size").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", V.safe_file_name(path).alias("safe"), V.prefix_type(F.regexp_extract(path, "([^/]*)$", 1)).alias("kind"))


@query(
    "n16_cost_and_percent",
    """
SELECT o_orderkey, CAST(round(o_totalprice / 1000 * 0.00015, 6) AS DOUBLE) AS cost, CAST(floor(100.0 * least(o_totalprice, 300000) / 300000 + 0.5) AS BIGINT) AS percent FROM orders""",
)
def cost_and_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(x / 1000 * 0.00015, 6).alias("cost"), V.round_half_up(F.lit(100.0) * F.least(x, F.lit(300000.0)) / 300000).cast("long").alias("percent"))


@query(
    "n17_n18_rank_and_age",
    """
SELECT event_id, CASE WHEN value > 50 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS rank, ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AS recent FROM events""",
)
def rank_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "medium").otherwise("low")
    return table(spark, sf_dir, "events").select("event_id", V.confidence_rank(level).alias("rank"), (F.col("ts") >= F.expr("timestamp_ntz'2024-01-30' - interval 7 days")).alias("recent"))
