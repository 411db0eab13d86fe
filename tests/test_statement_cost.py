"""What reading a statement may cost: lines that speak of no zone are not compared with zones."""

from pyspark.sql import functions as F

from quire.operators.statements import sections


def test_lines_without_a_zone_word_are_not_compared(spark):
    docs = spark.createDataFrame([(1, "CURRENT ASSETS\nCash 5\nTotal 5")], "doc_id int, text string").withColumn("zones", F.array(F.struct(F.lit("Current assets").alias("zone"))))
    read = sections(docs)
    assert "arrays_overlap" in read._jdf.queryExecution().optimizedPlan().toString()
    (row,) = read.collect()
    assert [tuple(i) for i in row.sections[0]["items"]] == [("Cash", "5")] and row.sections[0].total == "5"
