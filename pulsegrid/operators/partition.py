"""Patient-level folds and manifests, fixed by ids alone before anything is cut into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settings import Settings


def slice_of(user: Column, start: int) -> Column:
    """Eight hexadecimal digits of the id's MD5 as a number."""
    return F.conv(F.substring(F.md5(user.cast("string").cast("binary")), start, 8), 16, 10).cast("bigint")


def folds(recordings: DataFrame, s: Settings) -> DataFrame:
    user = F.col("user_id")
    return recordings.select("user_id").distinct().withColumn("fold", (slice_of(user, 1) % s.folds).cast("int"))


def manifests(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, fold, run, subset: in each run one fold is held out, and parted into validation and test."""
    held = F.when(slice_of(F.col("user_id"), 9) % 2 == 0, "validation").otherwise("test")
    runs = folds(recordings, s).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(s.folds - 1))))
    return runs.withColumn("subset", F.when(F.col("fold") == F.col("run"), held).otherwise("train"))


def audit(manifest: DataFrame) -> DataFrame:
    """Users per run and subset, and how many of the run's users are in more than one subset."""
    twice = manifest.groupBy("run", "user_id").agg(F.countDistinct("subset").alias("n")).groupBy("run").agg(F.sum((F.col("n") > 1).cast("bigint")).alias("overlap"))
    return manifest.groupBy("run", "subset").agg(F.countDistinct("user_id").alias("users")).join(F.broadcast(twice), "run")  # a row per run
