"""The one place where an outside model would be asked: recorded answers, by document and task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import values as V


def read_answers(asked: DataFrame, recorded: DataFrame, providers: Sequence[str]) -> DataFrame:
    """``respond`` with json, the text that was parsed.

    Answers are dealt as they were recorded; only then is each read, once, and the first usable one of a question kept.
    """
    rank = F.array_position(F.array(*map(F.lit, providers)), F.col("provider"))
    dealt = recorded.select("doc_id", "task", "provider", "raw", rank.alias("rank")).filter("rank > 0").repartition("doc_id", "task")
    read = dealt.withColumn("json", V.response_json(F.col("raw"))).withColumn("parsed", F.try_parse_json("json"))
    w = Window.partitionBy("doc_id", "task").orderBy(F.col("parsed").isNull(), "rank", "provider", "raw")
    best = read.withColumn("n", F.row_number().over(w)).filter("n = 1 AND parsed IS NOT NULL").select("doc_id", "task", "provider", "raw", "json", "parsed")
    return asked.join(best, ["doc_id", "task"], "left").select(*asked.columns, "provider", "raw", "json", "parsed")


def respond(asked: DataFrame, recorded: DataFrame, providers: Sequence[str]) -> DataFrame:
    """``asked`` (doc_id, task, ...) with provider, raw and parsed (variant) of the first provider whose recorded answer is JSON.

    A live model would write its answers to the recorded table first: they are read from there, so a task that runs
    twice asks nobody twice.
    """
    return read_answers(asked, recorded, providers).drop("json")
