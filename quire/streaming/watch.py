"""Incremental work: new files, job states and a throttle, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ATTEMPTS, LOCK_MINUTES, KEEP_DAYS, BUCKETS = 5, 15, 30, 1024
TERMINAL = ["completed", "failed", "cancelled"]


def watch(spark: SparkSession, path: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Hand every new Parquet file in a folder to ``handle`` once; the checkpoint is the list of files that are done.

    Without an interval all that is there is taken and the query ends. A batch that is run again after a failure has the
    same number, so ``handle`` can write under it and replace what an earlier try left.
    """
    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def split_failures(out: str, dead: str, ok) -> Callable[[DataFrame, int], None]:
    """A handler that writes good rows and, apart, the rows that failed; both count as done, as only their arrival matters."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.filter(ok).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.filter(~F.coalesce(ok, F.lit(False))).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return handle


def take_new(listings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """folder, listing, id of a stream of listings (folder, listing, id, ok): what has to be taken at each listing.

    Listings of a folder are numbered without gaps. An id is taken if it was not taken yet, or was absent from the listing before, as
    what is listed no more is forgotten; one whose taking failed (``ok`` is false) counts as not taken. State is one number for each
    folder and id, the last listing that had it as taken, and lives in the query's checkpoint, so a restart takes nothing
    twice. Listings of a batch are taken in order. With a watermark on a column ``seen``, ids that are in no listing for ``KEEP_DAYS``
    beyond it leave the state, which changes no result.

    A call of ``step`` costs milliseconds and a row in it microseconds, so folders share ``buckets`` by their hash. A batch reads and writes
    the state of the buckets that it has rows of; their number belongs to a checkpoint.
    """
    timed = "seen" in listings.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {(folder, i): (last, until) for folder, i, last, until in zip(*state.get)} if state.exists else {}
        found: dict[tuple, dict[int, bool | None]] = {}
        seen: dict[tuple, int] = {}
        for batch in [] if state.hasTimedOut else batches:
            for folder, i, number, ok in zip(*(batch[c].tolist() for c in ("folder", "id", "listing", "ok"))):
                listed = found.setdefault((folder, i), {})
                listed[number] = ok if listed.get(number) is None else listed[number] or bool(ok)
            if timed:
                for folder, i, at in zip(*(batch[c].tolist() for c in ("folder", "id", "seen"))):
                    seen[folder, i] = max(seen.get((folder, i), 0), int(at.timestamp() * 1000))
        now = state.getCurrentWatermarkMs() if timed else 0
        taken = []
        for x, listed in found.items():
            last = known[x][0] if x in known else -1
            for number in sorted(listed):
                new = last < 0 or last != number - 1
                if new:
                    taken.append((x[0], number, x[1]))
                last = -1 if new and listed[number] is False else number
            known[x] = last, max(seen[x], now) + KEEP_DAYS * 86_400_000 if timed else 0
        if timed:
            known = {x: k for x, k in known.items() if k[1] > now}
        if known:
            state.update(([x[0] for x in known], [x[1] for x in known], [k[0] for k in known.values()], [k[1] for k in known.values()]))
            if timed:
                state.setTimeoutTimestamp(min(k[1] for k in known.values()))
        elif state.exists:
            state.remove()
        if taken:
            yield pd.DataFrame(taken, columns=["folder", "listing", "id"])

    kinds = dict(listings.dtypes)
    # as texts, folders and ids stay exact beside missing ones
    told = listings.filter("listing IS NOT NULL").withColumns({"folder": F.col("folder").cast("string"), "id": F.col("id").cast("string"), "listing": F.col("listing").cast("long")})
    kept = "folders array<string>, ids array<string>, lasts array<long>, untils array<long>"
    out = told.withColumn("bucket", F.pmod(F.hash("folder"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(step, "folder string, listing long, id string", kept, "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)
    return out.select(F.col("folder").cast(kinds["folder"]), "listing", F.col("id").cast(kinds["id"]))


def job_states(log: DataFrame) -> DataFrame:
    """job, status of a log (job, seq, status): the last status, but the first of those that end a job is final."""
    ended = F.min(F.when(F.col("status").isin(TERMINAL), F.struct("seq", "status")))
    return log.groupBy("job").agg(F.coalesce(ended["status"], F.max_by("status", "seq")).alias("status"))


def progress(log: DataFrame) -> DataFrame:
    """job, steps, stale: how far each job is, and whether it has been silent for over thirty seconds at the log's end."""
    last = log.groupBy("job").agg(F.count("*").alias("steps"), F.max("at").alias("last"))
    end = log.agg(F.max("at").alias("now"))
    return last.join(F.broadcast(end)).select("job", "steps", (F.col("now") - F.col("last") > 30).alias("stale"))


def throttle(attempts: DataFrame, attempts_allowed: int = ATTEMPTS, minutes: int = LOCK_MINUTES) -> DataFrame:
    """user, id, allowed of a stream of attempts (user, id, at in seconds, failed): after five failures a user is locked out for fifteen minutes.

    A success clears the count. Attempts while locked out are refused and count for nothing. State is two numbers a user;
    within a batch a user's attempts are taken in order of time. With a watermark on a column of the stream, a user that
    is silent for ``KEEP_DAYS`` of event time beyond it is forgotten, with the failures counted so far.
    """
    timed = any(m == "seen" for m in attempts.columns)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails, until = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        allowed = []
        for at, failed in zip(rows["at"], rows["failed"]):
            if until and at < until:
                allowed.append(False)
                continue
            if until:
                fails, until = 0, 0.0
            allowed.append(True)
            if not failed:
                fails, until = 0, 0.0
            else:
                fails += 1
                if fails >= attempts_allowed:
                    until = float(at) + 60 * minutes
        state.update((int(fails), float(until)))
        if timed:
            state.setTimeoutTimestamp(max(int(rows["at"].max() * 1000), state.getCurrentWatermarkMs()) + KEEP_DAYS * 86_400_000)
        yield pd.DataFrame({"user": rows["user"], "id": rows["id"], "allowed": allowed})

    return attempts.groupBy("user").applyInPandasWithState(step, "user long, id long, allowed boolean", "fails int, until double", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def latest(log: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each key, by a window that Spark cuts to one row before it shuffles."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return log.withColumn("n", n).filter("n = 1").drop("n")
