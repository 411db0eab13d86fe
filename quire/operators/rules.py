"""An interpreter of rules that are rows of a table: documents of any type are held against those of their type in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values as V

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Above so many types the rules are joined by a shuffle instead of being sent to all executors.
MOST_TYPES = 10_000


def _name(x: Column) -> Column:
    """Names are compared in small letters, with blanks for underscores and without colons."""
    return V.strip(F.translate(F.lower(x), "_:", " "))


def _figure(x: Column) -> Column:
    bare = V.strip(F.replace(x, F.lit(","), F.lit("")))
    return F.when(bare.rlike(NUMBER), bare.cast("double"))


def by_type(rules: DataFrame) -> DataFrame:
    """doc_type, rules: the rules (doc_type, no, kind, columns, args) of each type in one row, for at most ``MOST_TYPES`` types as a broadcast."""
    listed = rules.groupBy("doc_type").agg(F.array_sort(F.collect_list(F.struct("no", "kind", "columns", "args"))).alias("rules"))
    return F.broadcast(listed) if rules.select("doc_type").distinct().limit(MOST_TYPES + 1).count() <= MOST_TYPES else listed


def _of_fields(r: Column) -> Column:
    """The checks that a rule makes of a document's fields (pos, name, value): one, or for prohibited values one for each that occurs."""
    check = lambda name, ok, bad="FAIL": F.array(F.struct(name.alias("check"), F.when(ok, "PASS").otherwise(bad).alias("status")))
    column = F.get(r["columns"], 0)
    wanted = _name(column)
    exact = F.filter("fields", lambda f: f["key"] == wanted)
    near = F.filter("fields", lambda f: f["key"].contains(wanted) | wanted.contains(f["key"]))
    value = F.coalesce(F.when(F.size(exact) > 0, F.get(exact, 0)["value"]).otherwise(F.get(near, 0)["value"]), F.lit(""))
    none = F.array().cast("array<struct<check:string,status:string>>")
    told = lambda prefix, ok: F.when(value != "", check(F.concat(F.lit(prefix), column), F.coalesce(ok, F.lit(False)))).otherwise(none)
    bad = F.filter("fields", lambda f: F.array_contains(r["args"], f["value"]))
    return (
        F.when(r["kind"] == "required", check(F.concat(F.lit("req:"), column), value != "", "MISSING"))
        .when(r["kind"] == "numeric", told("num:", _figure(value).isNotNull()))
        .when(r["kind"] == "date", told("date:", value.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & value.try_cast("date").isNotNull()))
        .when(r["kind"] == "pattern", told("pat:", F.rlike(value, F.get(r["args"], 0))))
        .when(r["kind"] == "prohibited", F.transform(bad, lambda f: F.struct(F.concat(F.lit("prohib:"), f["name"]).alias("check"), F.lit("FAIL").alias("status"))))
        .otherwise(none)
    )


#: Kinds of rules on rows and, of these, the ones that say nothing of a table without rows.
OF_ROWS = ["least_rows", "filled", "cells_numeric", "cells_positive", "product", "keywords", "exclusive"]
OF_SOME_ROWS = ["product", "keywords", "exclusive"]


def checks(docs: DataFrame, fields: DataFrame, rows: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, check, status (PASS, FAIL, WARN, MISSING, SKIP) of every rule that applies to a document.

    ``docs`` has doc_id, doc_type and table_mode; ``fields`` doc_id, pos, name, value; ``rows`` doc_id, cells (map of a
    column's name to its value), a row each for the rows of its table, which count in table mode only. A field is found by its name, else by the
    first name that holds it or lies in it; empty and null values are missing, and only a required field says so. A type
    without rules is skipped. Numbers may have commas and an exponent, not names as ``nan``. Fields of a document are
    collected; rows never are: they are counted by document and rule, partly before the shuffle.
    """
    typed = docs.select("doc_id", "doc_type", F.coalesce("table_mode", F.lit(False)).alias("table_mode")).join(by_type(rules), "doc_type", "left")
    own = fields.filter(~F.coalesce(F.col("name").startswith("_label_"), F.lit(True))).select("doc_id", F.struct("pos", "name", _name(F.col("name")).alias("key"), V.strip(F.coalesce("value", F.lit(""))).alias("value")).alias("f"))
    listed = own.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    joined = typed.join(listed, "doc_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast(listed.schema["fields"].dataType)))
    skipped = F.array(F.struct(F.lit("schema").alias("check"), F.lit("SKIP").alias("status")))
    said = joined.select("doc_id", F.inline(F.when(F.col("rules").isNull(), skipped).otherwise(F.flatten(F.transform("rules", _of_fields)))))

    tables = typed.filter("table_mode").select("doc_id", F.filter("rules", lambda r: r["kind"].isin(OF_ROWS)).alias("rules"))
    cell = lambda i: V.strip(F.coalesce(F.try_element_at("cells", F.coalesce(F.get("r.columns", F.lit(i)), F.lit(""))), F.lit("")))
    a, b, c = cell(0), cell(1), cell(2)
    amount = lambda x: F.when(x == "", 0.0).otherwise(_figure(x))
    wanted = amount(F.col("a")) * amount(F.col("b"))
    kind = F.col("r.kind")
    bad = (
        F.when(kind == "filled", F.col("a") == "")
        .when(kind == "cells_numeric", (F.col("a") != "") & _figure(F.col("a")).isNull())
        .when(kind == "cells_positive", (F.col("a") != "") & ~F.coalesce(_figure(F.col("a")) > 0, F.lit(False)))
        .when(kind == "product", (wanted > 0) & (F.try_divide(F.abs(amount(F.col("c")) - wanted), wanted) > F.get("r.args", F.lit(0)).cast("double") / 100))
        .when(kind == "keywords", F.exists("r.args", lambda k: F.lower("a").contains(k)))
        .when(kind == "exclusive", (F.col("a") != "") & (F.col("b") != ""))
    )
    each = rows.select("doc_id", "cells").join(tables, "doc_id").select("doc_id", "cells", F.explode("rules").alias("r")).select("doc_id", "r", a.alias("a"), b.alias("b"), c.alias("c"))
    counted = each.groupBy("doc_id", F.col("r.no").alias("no")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(bad, F.lit(False))).alias("hits"))
    held = tables.select("doc_id", F.explode("rules").alias("r")).withColumn("no", F.col("r.no")).join(counted, ["doc_id", "no"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    first, second = F.get("r.columns", F.lit(0)), F.get("r.columns", F.lit(1))
    name = (
        F.when(kind == "least_rows", "table:rows")
        .when(kind == "product", F.concat(F.lit("cons:"), first, F.lit("x"), second, F.lit("="), F.get("r.columns", F.lit(2))))
        .when(kind == "keywords", F.concat(F.lit("cons:row:"), F.get("r.args", F.lit(0))))
        .when(kind == "exclusive", F.concat(F.lit("cons:"), first, F.lit("_xor_"), second))
        .otherwise(F.concat(F.lit("col:"), first))
    )
    ok = (
        F.when(kind == "least_rows", F.col("n") >= F.get("r.args", F.lit(0)).cast("long"))
        .when(kind == "filled", (F.col("n") > 0) & ((F.col("n") - F.col("hits")) * 10 >= F.col("n") * 8))
        .when(kind == "keywords", F.col("hits") > 0)
        .otherwise(F.col("hits") == 0)
    )
    of_rows = held.filter((F.col("n") > 0) | ~kind.isin(OF_SOME_ROWS)).select("doc_id", name.alias("check"), F.when(ok, "PASS").when(kind.isin("product", "exclusive"), "WARN").otherwise("FAIL").alias("status"))
    return said.unionByName(of_rows)


def verdicts(checked: DataFrame, threshold: float = 75) -> DataFrame:
    """doc_id, passed, checks (without skipped ones), score (per cent that passed, 0 for none) and ok (at least the threshold) of each document."""
    counts = checked.groupBy("doc_id").agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") != "SKIP").alias("checks"))
    score = F.coalesce(F.try_divide(F.col("passed") * 100.0, F.col("checks")), F.lit(0.0))
    return counts.select("doc_id", "passed", "checks", score.alias("score"), (score >= threshold).alias("ok"))
