"""Reading recordings, and writing and reading the tables that stages hand on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(events: DataFrame, *also: str) -> DataFrame:
    """user_id, event_id, us, value, and columns asked for: measurements in microseconds since 1970, whatever the session's time zone."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return events.select("user_id", "event_id", us.alias("us"), "value", *also).where("user_id IS NOT NULL AND us IS NOT NULL AND value IS NOT NULL")


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Fixed assignments, one folder per run and subset."""
    manifests.write.mode("overwrite").partitionBy("run", "subset").parquet(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id BIGINT, fold INT, run INT, subset STRING").parquet(path)
