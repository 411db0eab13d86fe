"""Greedy assignment: candidates in order, each left and each right side used once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy(candidates: DataFrame, by: list[str], left: str, right: str, order: list[str | Column]) -> DataFrame:
    """The candidates taken when they are tried in order within each group: a left or right side that is taken blocks the rest.

    A group's candidates are folded in one array, as for the few sections of one template or document.
    """
    names = [f"o{i}" for i in range(len(order))]
    ranked = candidates.select(*by, F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names)], F.col(left).alias("l"), F.col(right).alias("r")).alias("_candidate"))
    listed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list("_candidate")).alias("_all"))
    kind = listed.schema["_all"].dataType
    taken = F.aggregate("_all", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: (y["l"] == x["l"]) | (y["r"] == x["r"])), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(*by, F.explode(taken).alias("_taken")).select(*by, F.col("_taken.l").alias(left), F.col("_taken.r").alias(right))
