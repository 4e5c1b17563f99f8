"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast at most (8 bytes each); above, the join shuffles.
BROADCAST_IDS = 1_000_000


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a session whose executors all run on this machine takes
    a folder here; on a cluster there is no such folder, and that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by checkpoint() in ``spark.checkpoint.dir``."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, partitioned by the columns ``by``."""
    path = path or place(df.sparkSession)
    spark, schema = df.sparkSession, df.schema
    with freeing(spark):
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def freeing(spark: SparkSession):
    """While a table is written, Spark deletes the write's own shuffle files at its end, as nothing reads them again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def bucketed(df: DataFrame, buckets: int, key: str, path: str, by: str) -> DataFrame:
    """``df`` as a Parquet table in ``path``, partitioned by ``by`` and bucketed by ``key``, so that grouping by the key
    needs no shuffle of it. The catalogue forgets the table at once; its folders, not the catalogue, tell its partitions."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.hive.manageFilesourcePartitions", "false"):
        df.write.partitionBy(by).bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
        found = spark.table(name)
        found.schema  # resolved, so that the entry isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    return found


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, and 64 for each row."""
    return docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 64)).first()[0] or 0


def once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``keep`` and the named ``columns``, these as a generated row. A filter on them stays above the generator; below
    a projection the optimiser would spell their definitions out in it, inside lambdas for every element."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
