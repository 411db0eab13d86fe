"""Rows are numbered within large groups by many tasks."""

from pyspark.sql import functions as F

from quire.sources import sinks


def test_numbers_run_over_a_group_that_many_tasks_hold(spark, monkeypatch):
    monkeypatch.setattr(sinks, "NUMBERED_AT_ONCE", 300)
    id = F.col("id")
    df = spark.range(5000).select(F.when(id % 50 == 0, None).when(id % 7 == 0, "b").otherwise("a").alias("g"), ((id * 7919) % 5003).alias("x"), (id % 3).alias("y"))
    rows = sinks.numbered(df, "g", "x", "y").collect()
    want = []
    for g in (None, "a", "b"):
        mine = sorted((r.x, r.y) for r in df.collect() if r.g == g)
        want += [(g, *xy, n) for n, xy in enumerate(mine, 1)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_no_window_holds_the_rows_of_a_type(spark):
    docs = spark.range(10).select(F.col("id").alias("doc"), F.lit("t").alias("doc_type"), F.lit("f").alias("file"), F.lit("high").alias("confidence"), F.lit(False).alias("needs_review"), F.lit("").alias("notes"), F.array().cast("array<string>").alias("errors"))
    out = sinks.typed_sheets(docs, {}, spark.range(20).select((F.col("id") % 10).alias("doc"), F.col("id").alias("line")), ["line"])
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.sheet, r.row) for r in out.collect()} == {("t", n) for n in range(11)} | {("t_lines", n) for n in range(21)}
