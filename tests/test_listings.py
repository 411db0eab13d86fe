"""Listings taken by a stream: what is new, across batches and restarts, with few calls."""

from pyspark.sql import functions as F

from quire.streaming import watch


def _go(spark, path, rows):
    spark.createDataFrame(rows, "folder long, listing long, id long, ok boolean").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("folder long, listing long, id long, ok boolean").parquet(f"{path}/in")
    watch.take_new(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_ids_are_taken_once_and_again_after_absence_or_failure(spark, tmp_path):
    path, big = f"file://{tmp_path}", (1 << 53) + 1
    _go(spark, path, [(1, 1, big, True), (1, 2, big, True), (1, 1, None, True), (1, 2, 5, False), (2, 1, 5, True), (2, 1, 5, False), (None, 3, 7, True)])
    _go(spark, path, [(1, 3, big, True), (1, 4, None, True), (1, 3, 5, True), (1, 4, 5, True), (2, 3, 5, True), (2, 4, 5, True), (None, 4, 7, True)])
    got = sorted((str(r.folder), r.listing, str(r.id)) for r in spark.read.schema("folder long, listing long, id long").parquet(f"{path}/out").collect())
    assert got == sorted([("1", 1, str(big)), ("1", 1, "None"), ("1", 2, "5"), ("2", 1, "5"), ("None", 3, "7"), ("1", 4, "None"), ("1", 3, "5"), ("2", 3, "5")])


def test_calls_do_not_grow_with_ids(spark, tmp_path):
    path = f"file://{tmp_path}"
    listed = spark.range(20_000).select(F.col("id").alias("folder"), F.lit(1).cast("long").alias("listing"), F.col("id").cast("string").alias("id"), F.lit(True).alias("ok"))
    listed.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(listed.schema).parquet(f"{path}/in")
    query = watch.take_new(stream, buckets=16).writeStream.format("memory").queryName("taken").option("checkpointLocation", f"{path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("taken").count() == 20_000
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 16
