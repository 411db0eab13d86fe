"""Session set-up and the table reader that every query shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quire").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one where none is set in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.gettempdir()
    return f"{base}/quire-{uuid.uuid4().hex}"


def dealt(spark: SparkSession, narrow: DataFrame, key: str, most: int) -> DataFrame:
    """Rows dealt once by key, while they are narrow, to a fixed number of tasks with some ``most`` rows each: what is made of them is wide or long work."""
    return narrow.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow.count() // most + 1), key)
