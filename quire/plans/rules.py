"""Documents of twelve types against the rules of their types, which are rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.functions.rule_sets import RULE_SETS, rule_rows, rule_table
from quire.operators import rules
from quire.operators.rules import NUMBER
from quire.session import table

_TYPES = [*RULE_SETS, "memo"]
_FIELDS = ["Cheque_Number", "_label_Date", "Date:", "Bank Name", "drawer name", "Payee", "Amount", "Amount in words", "Routing Number", "Employee  Name", "Pay Period", "Total", "Net Pay", "Audit Opinion", "Report Date"]
_COLUMNS = ["Item", "SKU", "Qty", "Price", "Item Subtotal", "Description", "Quantity", "Unit Price", "Amount", "Current Period", "Debit", "Credit"]
_LINES = ["Total Assets", "Net sales", "Cash", "TOTAL LIABILITIES", "net income (loss)", "Total equity and more", " ", "Revenue", "Fees"]


def _list_sql(values: list[str]) -> str:
    return "CAST([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "] AS VARCHAR[])"


_RULES = "(VALUES " + ", ".join(f"('{t}', {no}, '{kind}', {_list_sql(columns)}, {_list_sql(args)})" for t, no, kind, columns, args in rule_rows()) + ") t(doc_type, no, kind, cols, args)"
_FIGURE = f"CASE WHEN regexp_matches(trim(replace({{0}}, ',', '')), '{NUMBER}') THEN CAST(trim(replace({{0}}, ',', '')) AS DOUBLE) END"
_AMOUNT = "CASE WHEN {0} = '' THEN 0.0 ELSE " + _FIGURE + " END"
_CHECKED = rf"""
rules AS (SELECT * FROM {_RULES}),
d AS (SELECT c_custkey AS doc_id, {_list_sql(_TYPES)}[1 + c_custkey % 13] AS doc_type, c_custkey % 3 <> 0 AS tm FROM customer),
f0 AS (SELECT c_custkey AS doc_id, c_custkey AS k, unnest(range(15)) AS pos, unnest({_list_sql(_FIELDS)}) AS name, unnest([
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END, 'never', ['1998-02-30', '2024-1-5', '05.01.2024', ' 2024-12-31 '][1 + c_custkey % 4], c_mktsegment, c_name,
  CASE WHEN c_custkey % 11 = 0 THEN 'N/A ' ELSE c_name END, CASE WHEN c_custkey % 17 = 0 THEN '0.00' WHEN c_custkey % 6 = 0 THEN '1,200.50' ELSE CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END, 'many',
  CASE WHEN c_custkey % 2 = 0 THEN 'A123456789' ELSE '12345' END, c_name, '2024-05-01', CASE WHEN c_custkey % 2 = 0 THEN '12.5e1' ELSE 'much' END, CASE WHEN c_custkey % 9 = 0 THEN 'null' ELSE '$5' END,
  CASE WHEN c_custkey % 3 = 1 THEN 'Unqualified' ELSE 'none' END, CASE WHEN c_custkey % 3 <> 0 THEN '2024-06-30' END]) AS value FROM customer),
f AS (SELECT doc_id, pos, name, trim(replace(replace(lower(name), '_', ' '), ':', '')) AS key, trim(coalesce(value, '')) AS value FROM f0 WHERE pos <> k % 15 AND NOT starts_with(name, '_label_')),
fr AS (SELECT doc_id, no, kind, cols[1] AS col, args, lower(cols[1]) AS w FROM d JOIN rules USING (doc_type) WHERE kind IN ('required', 'numeric', 'date', 'pattern')),
hit AS (SELECT fr.doc_id, no, any_value(kind) AS kind, any_value(col) AS col, any_value(args) AS args, coalesce(arg_min(f.value, CASE WHEN key = w THEN pos ELSE 100 + pos END), '') AS v FROM fr LEFT JOIN f ON f.doc_id = fr.doc_id AND (contains(key, w) OR contains(w, key)) GROUP BY fr.doc_id, no),
fc AS (SELECT doc_id, CASE kind WHEN 'required' THEN 'req:' WHEN 'numeric' THEN 'num:' WHEN 'date' THEN 'date:' ELSE 'pat:' END || col AS "check", CASE
  WHEN kind = 'required' THEN CASE WHEN v <> '' THEN 'PASS' ELSE 'MISSING' END
  WHEN CASE kind WHEN 'numeric' THEN ({_FIGURE.format("v")}) IS NOT NULL WHEN 'date' THEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') AND try_cast(v AS DATE) IS NOT NULL ELSE regexp_matches(v, args[1]) END THEN 'PASS' ELSE 'FAIL' END AS status FROM hit WHERE kind = 'required' OR v <> ''
  UNION ALL SELECT d.doc_id, 'prohib:' || name, 'FAIL' FROM d JOIN rules ON rules.doc_type = d.doc_type AND kind = 'prohibited' JOIN f ON f.doc_id = d.doc_id AND list_contains(args, f.value)
  UNION ALL SELECT doc_id, 'schema', 'SKIP' FROM d WHERE doc_type = 'memo'),
o0 AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderkey % 9 AS q FROM orders),
o AS (SELECT doc_id, [CASE WHEN k % 4 = 0 THEN '' ELSE 'item ' || k END, CASE WHEN k % 6 = 0 THEN ' ' ELSE 'S' || k END, CASE WHEN k % 50 = 0 THEN 'two' ELSE CAST(q AS VARCHAR) END, CASE WHEN k % 30 = 0 THEN '-5' WHEN k % 8 = 0 THEN '1,000.50' ELSE CAST(p AS VARCHAR) END,
  CAST(CASE WHEN k % 20 = 1 THEN p + 7 ELSE p * q END AS VARCHAR), {_list_sql(_LINES)}[1 + k % 9], CAST(q AS VARCHAR), CAST(p AS VARCHAR), CASE WHEN k % 40 = 0 THEN 'n.a.' WHEN k % 3 = 0 THEN '' ELSE CAST(p AS VARCHAR) END, CASE WHEN k % 35 = 0 THEN '(5)' ELSE '' END, CASE WHEN k % 2 = 0 THEN CAST(p AS VARCHAR) ELSE ' ' END, CASE WHEN k % 2 = 1 OR k % 200 = 0 THEN CAST(p AS VARCHAR) END] AS cells FROM o0),
tr AS (SELECT doc_id, no, kind, cols, args FROM d JOIN rules USING (doc_type) WHERE tm AND kind IN ('least_rows', 'filled', 'cells_numeric', 'cells_positive', 'product', 'keywords', 'exclusive')),
tc AS (SELECT tr.doc_id, no, kind, cols, args, cells IS NOT NULL AS there, trim(coalesce(cells[list_position({_list_sql(_COLUMNS)}, cols[1])], '')) AS a, trim(coalesce(cells[list_position({_list_sql(_COLUMNS)}, cols[2])], '')) AS b, trim(coalesce(cells[list_position({_list_sql(_COLUMNS)}, cols[3])], '')) AS c FROM tr LEFT JOIN o ON o.doc_id = tr.doc_id),
tb AS (SELECT *, CASE kind WHEN 'filled' THEN a = '' WHEN 'cells_numeric' THEN a <> '' AND ({_FIGURE.format("a")}) IS NULL WHEN 'cells_positive' THEN a <> '' AND NOT coalesce(({_FIGURE.format("a")}) > 0, false)
  WHEN 'product' THEN ({_AMOUNT.format("a")}) * ({_AMOUNT.format("b")}) > 0 AND abs(({_AMOUNT.format("c")}) - ({_AMOUNT.format("a")}) * ({_AMOUNT.format("b")})) / (({_AMOUNT.format("a")}) * ({_AMOUNT.format("b")})) > 0.02
  WHEN 'keywords' THEN len(list_filter(args, lambda w: contains(lower(a), w))) > 0 WHEN 'exclusive' THEN a <> '' AND b <> '' END AS bad FROM tc),
tg AS (SELECT doc_id, no, any_value(kind) AS kind, any_value(cols) AS cols, any_value(args) AS args, count_if(there) AS n, count_if(there AND coalesce(bad, false)) AS hits FROM tb GROUP BY doc_id, no),
checked AS (SELECT * FROM fc UNION ALL SELECT doc_id, CASE kind WHEN 'least_rows' THEN 'table:rows' WHEN 'product' THEN 'cons:' || cols[1] || 'x' || cols[2] || '=' || cols[3] WHEN 'keywords' THEN 'cons:row:' || args[1] WHEN 'exclusive' THEN 'cons:' || cols[1] || '_xor_' || cols[2] ELSE 'col:' || cols[1] END,
  CASE kind WHEN 'least_rows' THEN CASE WHEN n >= CAST(args[1] AS BIGINT) THEN 'PASS' ELSE 'FAIL' END WHEN 'filled' THEN CASE WHEN n > 0 AND (n - hits) * 10 >= n * 8 THEN 'PASS' ELSE 'FAIL' END WHEN 'keywords' THEN CASE WHEN hits > 0 THEN 'PASS' ELSE 'FAIL' END WHEN 'product' THEN CASE WHEN hits = 0 THEN 'PASS' ELSE 'WARN' END WHEN 'exclusive' THEN CASE WHEN hits = 0 THEN 'PASS' ELSE 'WARN' END ELSE CASE WHEN hits = 0 THEN 'PASS' ELSE 'FAIL' END END
  FROM tg WHERE n > 0 OR kind NOT IN ('product', 'keywords', 'exclusive'))"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents of twelve types and one without rules, with fields by key and their orders as rows."""
    customers, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    docs = customers.select(k.alias("doc_id"), F.get(F.array(*map(F.lit, _TYPES)), (k % 13).cast("int")).alias("doc_type"), (k % 3 != 0).alias("table_mode"))
    dates = F.get(F.array(*map(F.lit, ["1998-02-30", "2024-1-5", "05.01.2024", " 2024-12-31 "])), (k % 4).cast("int"))
    balance = F.when(k % 17 == 0, "0.00").when(k % 6 == 0, "1,200.50").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    told: list[Column] = [
        F.when(k % 5 == 0, "").otherwise(k.cast("string")), F.lit("never"), dates, F.col("c_mktsegment"), F.col("c_name"), F.when(k % 11 == 0, "N/A ").otherwise(F.col("c_name")), balance, F.lit("many"),
        F.when(k % 2 == 0, "A123456789").otherwise("12345"), F.col("c_name"), F.lit("2024-05-01"), F.when(k % 2 == 0, "12.5e1").otherwise("much"), F.when(k % 9 == 0, "null").otherwise("$5"),
        F.when(k % 3 == 1, "Unqualified").otherwise("none"), F.when(k % 3 != 0, "2024-06-30"),
    ]
    fields = customers.select(k.alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(zip(_FIELDS, told))]))).filter("pos != doc_id % 15")

    o, price, count = F.col("o_orderkey"), F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 9
    text = lambda c: c.cast("string")
    cells = [
        F.when(o % 4 == 0, "").otherwise(F.concat(F.lit("item "), text(o))), F.when(o % 6 == 0, " ").otherwise(F.concat(F.lit("S"), text(o))), F.when(o % 50 == 0, "two").otherwise(text(count)), F.when(o % 30 == 0, "-5").when(o % 8 == 0, "1,000.50").otherwise(text(price)),
        text(F.when(o % 20 == 1, price + 7).otherwise(price * count)), F.get(F.array(*map(F.lit, _LINES)), count.cast("int")), text(count), text(price), F.when(o % 40 == 0, "n.a.").when(o % 3 == 0, "").otherwise(text(price)), F.when(o % 35 == 0, "(5)").otherwise(""),
        F.when(o % 2 == 0, text(price)).otherwise(" "), F.when((o % 2 == 1) | (o % 200 == 0), text(price)),
    ]
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.create_map(*[x for n, v in zip(_COLUMNS, cells) for x in (F.lit(n), v)]).alias("cells"))
    return rules.checks(docs, fields, rows, rule_table(spark))


@query("v14_rules_by_type", f"WITH {_CHECKED} SELECT * FROM checked")
def v14_rules_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check of every document, by rules that are rows of a table."""
    return _checked(spark, sf_dir)


@query(
    "a18_rule_verdicts",
    f"""WITH {_CHECKED}, v AS (SELECT doc_id, count_if(status = 'PASS') AS passed, count_if(status <> 'SKIP') AS checks FROM checked GROUP BY doc_id)
SELECT doc_type, count(*) AS docs, count(checks) AS checked, count_if(checks > 0 AND passed * 100.0 / checks >= 75) AS ok, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(checks) AS BIGINT) AS checks FROM d LEFT JOIN v USING (doc_id) GROUP BY doc_type""",
)
def a18_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each type, with how many pass at three quarters of their checks."""
    k = F.col("c_custkey")
    types = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.get(F.array(*map(F.lit, _TYPES)), (k % 13).cast("int")).alias("doc_type"))
    held = types.join(rules.verdicts(_checked(spark, sf_dir)), "doc_id", "left")
    return held.groupBy("doc_type").agg(F.count("*").alias("docs"), F.count("checks").alias("checked"), F.count_if("ok").alias("ok"), F.sum("passed").alias("passed"), F.sum("checks").alias("checks"))
