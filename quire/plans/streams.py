"""Streaming queries: a replay of tables as streams, run until everything that is there is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.catalog import query
from quire.plans.sources import scratch
from quire.session import table
from quire.streaming import watch


def _parts(spark: SparkSession, df: DataFrame, n: int) -> str:
    """A table as several files in a new folder."""
    path = scratch(spark)
    df.repartition(n).write.parquet(path)
    return path


@query("r1_r2_watch_increment", "SELECT event_type, count(*) AS done, (SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND event_id % 7 = 0) AS failed FROM events t WHERE event_id % 7 <> 0 GROUP BY event_type")
def r1_watch_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder taken in two goes; the second takes only what is new, failures are kept apart."""
    events = table(spark, sf_dir, "events")
    folder, out, dead, checkpoint = _parts(spark, events.filter("event_id % 2 = 0"), 3), scratch(spark), scratch(spark), scratch(spark)
    handle = watch.split_failures(out, dead, F.col("event_id") % 7 != 0)
    watch.watch(spark, folder, events.schema, handle, checkpoint).awaitTermination()
    events.filter("event_id % 2 = 1").repartition(2).write.mode("append").parquet(folder)
    watch.watch(spark, folder, events.schema, handle, checkpoint).awaitTermination()
    done = spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("done"))
    return done.join(spark.read.parquet(dead).groupBy("event_type").agg(F.count("*").alias("failed")), "event_type", "left")


@query(
    "r3_state_trim",
    """
WITH l AS (SELECT DISTINCT o_custkey AS folder, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS listing, o_orderpriority AS id FROM orders),
f AS (SELECT *, id LIKE '5%' AND listing % 4 = 0 AS failed FROM l)
SELECT a.folder, a.listing, a.id FROM f a LEFT JOIN f b ON b.folder = a.folder AND b.id = a.id AND b.listing = a.listing - 1 LEFT JOIN f c ON c.folder = a.folder AND c.id = a.id AND c.listing = a.listing - 2
WHERE b.id IS NULL OR (b.failed AND c.id IS NULL)""",
)
def r3_state_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's monthly listings of priorities bring anew, in two goes with a restart between them; some takings fail.

    What is listed for the second month running was taken in the first, unless that failed; what comes back after a month's absence is taken again.
    """
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder"), month.cast("long").alias("listing"), F.col("o_orderpriority").alias("id"))
    listed = listed.withColumn("ok", ~(F.col("id").startswith("5") & (F.col("listing") % 4 == 0)))
    middle = 1995 * 12 + 6
    folder, out, checkpoint = _parts(spark, listed.filter(F.col("listing") < middle), 2), scratch(spark), scratch(spark)

    def go() -> None:
        stream = spark.readStream.schema(listed.schema).parquet(folder)
        watch.take_new(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    go()
    listed.filter(F.col("listing") >= middle).repartition(2).write.mode("append").parquet(folder)
    go()
    return spark.read.schema("folder long, listing long, id string").parquet(out)


_LOG = "l AS (SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, epoch(ts) AS moment FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job states."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), status.alias("status"), at.alias("at"))


@query("r4_progress", f"WITH {_LOG} SELECT job, count(*) AS steps, (SELECT max(moment) FROM l) - max(moment) > 30 AS stale FROM l GROUP BY job")
def r4_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.progress(_log(spark, sf_dir))


@query("r5_job_states", f"WITH {_LOG} SELECT job, coalesce(arg_min(status, seq) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, seq)) AS status FROM l GROUP BY job")
def r5_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.job_states(_log(spark, sf_dir))


@query("r6_throttle")
def r6_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt of every user, by a stream with state; no SQL follows such a chain, so a test does by hand."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "purchase").alias("failed"))
    folder, out = _parts(spark, log, 2), scratch(spark)
    stream = spark.readStream.schema(log.schema).parquet(folder)
    watch.throttle(stream.withColumn("seen", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("seen", "30 days")).writeStream.format("parquet").option("checkpointLocation", scratch(spark)).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user long, id long, allowed boolean").parquet(out)


@query("extra_event_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS begins, event_type, count(*) AS n FROM events GROUP BY ALL")
def extra_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: events counted in tumbling windows of six hours by a stream; each batch adds to the counts of its windows, and the newest count of a window is its last."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder, out = _parts(spark, events, 4), scratch(spark)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "2").parquet(folder)
    counted = stream.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("begins"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(out).groupBy("begins", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return newest.select(F.col("begins").cast("timestamp_ntz").alias("begins"), "event_type", "n")
