"""Tables that stages hand on: written once to the shared folder, read with their partitions pruned."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def put(rows: DataFrame, path: str, by: list[str]) -> DataFrame:
    """``rows`` as stored in folders by the values of ``by``, which are few (runs, subsets, horizons, buckets). Rows are
    dealt by them first, and large folders in parts, so that a folder doesn't get a file from every task."""
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def replace(rows: DataFrame, path: str, by: list[str]) -> DataFrame:
    """As ``put``, but only the folders that ``rows`` has rows for are replaced: a run that is repeated replaces what it
    stored before, and other runs' rows stay. Returns the whole table."""
    rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


#: Where this session has stored what queries share: by application, name, and state of the input.
_kept: dict[tuple, str] = {}


def kept(spark: SparkSession, name: str, source: str, by: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, computed and stored once for this session and this state of the files in ``source``, and read
    back by all who ask for it. It is made anew if the input has changed or the stored table is gone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(at)
    key = (spark.sparkContext.applicationId, name, source, size.getLength(), size.getFileCount(), files.getFileStatus(at).getModificationTime())
    path = _kept.get(key)
    if path:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return spark.read.parquet(path)
    _kept[key] = path = folder(spark)
    return put(make(), path, by)


def put_recordings(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """Parts of recordings in a fixed number of folders by user, so that a recording is read from one folder, and
    millions of them don't make millions of folders."""
    return put(rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")), path, ["bucket"])


def put_bucketed(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """``rows`` bucketed and sorted by ``keys``, a file a bucket, as many as the session's shuffles have partitions: tables
    that are bucketed alike are joined by these keys without an exchange. The catalogue forgets the table at once."""
    spark, name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    found = spark.table(name)
    found.schema  # resolved, so that the entry isn't needed any more
    spark.sql(f"DROP TABLE {name}")
    return found
