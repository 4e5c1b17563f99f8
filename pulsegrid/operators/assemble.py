"""Training-only scaling, segments with their parts joined, and array operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import HOUR, Settings


def scaling(rows: DataFrame, manifest: DataFrame, column: str) -> DataFrame:
    """run, user_id, t, subset, z: standardised by the training subset of each run alone; missing values take its
    mean, and a constant column becomes 0."""
    joined = rows.select("user_id", "t", column).join(manifest, "user_id")
    fitted = joined.where("subset = 'train'").groupBy("run").agg(F.avg(column).alias("centre"), F.stddev_pop(column).alias("scale"))
    z = F.coalesce(F.try_divide(F.coalesce(F.col(column), F.col("centre")) - F.col("centre"), F.when(F.col("scale") > 1e-9, F.col("scale"))), F.lit(0.0))
    return joined.join(F.broadcast(fitted), "run").select("run", "user_id", "t", "subset", z.alias("z"))  # a row per run


def scaled(rows: DataFrame, manifest: DataFrame, columns: list[str]) -> DataFrame:
    """run, user_id, t, subset and z_<column> for each of ``columns``: as ``scaling``, with the statistics of all
    columns from one aggregation over the training subset."""
    joined = rows.select("user_id", "t", *columns).join(manifest.select("user_id", "run", "subset"), "user_id")
    fitted = joined.where("subset = 'train'").groupBy("run").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("centre", F.avg), ("scale", F.stddev_pop))))
    z = lambda c: F.try_divide(F.col(c) - F.col(f"centre_{c}"), F.when(F.col(f"scale_{c}") > 1e-9, F.col(f"scale_{c}")))
    return joined.join(F.broadcast(fitted), "run").select("run", "user_id", "t", "subset", *(F.coalesce(z(c), F.lit(0.0)).alias(f"z_{c}") for c in columns))  # a row per run


def stacked(events: DataFrame, channels: list[str], slots: int, s: Settings) -> DataFrame:
    """user_id, segment, wf: a channel per event type and a mean per slot of the window, null where a slot is empty.
    ``events`` has user_id, us, event_type, value; segments without any of the channels are left out."""
    width = s.window_h * HOUR
    cell = F.floor(F.pmod(F.col("us"), F.lit(width)) * slots / width).cast("int")
    rows = events.where(F.col("event_type").isin(channels)).select("user_id", F.floor(F.col("us") / width).cast("bigint").alias("segment"), "event_type", cell.alias("slot"), "value")
    at = lambda c, k: F.avg(F.when((F.col("event_type") == c) & (F.col("slot") == k), F.col("value")))
    return rows.groupBy("user_id", "segment").agg(F.array(*(F.array(*(at(c, k) for k in range(slots))) for c in channels)).alias("wf"))


def segments(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, segment, n, mean_value, valid: tumbling windows; the clean ones are valid."""
    return cleaned(recordings, s).select("user_id", "segment", "n", "mean_value", F.col("clean").alias("valid"))


def cleaned(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, segment, n, mean_value, plausible, longest_gap_h, flat, clean: tumbling windows judged by artefacts, gaps between
    neighbouring values, and values that never change."""
    own = F.floor(F.col("us") / (s.window_h * HOUR)).cast("bigint")
    order = Window.partitionBy("user_id", "segment").orderBy("us", "event_id")
    rows = recordings.withColumn("segment", own).withColumn("gap", F.col("us") - F.lag("us").over(order))
    rows = rows.groupBy("user_id", "segment").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.count_if(F.col("value").between(*s.plausible)).alias("plausible"),
        (F.max("gap").cast("double") / float(HOUR)).alias("longest_gap_h"), (F.min("value") == F.max("value")).alias("flat"),
    )
    return rows.withColumn("clean", (F.col("n") >= 2) & ~F.col("flat") & (F.col("plausible") >= s.min_plausible * F.col("n")) & (F.coalesce("longest_gap_h", F.lit(0.0)) <= s.max_gap_h))


def labelled(found: DataFrame, s: Settings) -> DataFrame:
    """user_id, segment, label: 1 for segments in which an episode begins."""
    return found.select("user_id", F.floor(F.col("onset") / (s.window_h * HOUR)).cast("bigint").alias("segment")).distinct().withColumn("label", F.lit(1))


def tensors(waves: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """Waveform, features and label of each segment that has the first two; a row for each (user_id, segment). Tables that are
    bucketed by both are joined where they lie."""
    key = ["user_id", "segment"]
    return waves.join(features.hint("merge"), key).join(labels.hint("merge"), key, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def assembled(cut: DataFrame, manifest: DataFrame, found: DataFrame, static: DataFrame, s: Settings) -> DataFrame:
    """Eligible segments with their run's subset, label (an episode begins in them) and static feature."""
    rows = cut.where("valid").drop("valid").join(labelled(found, s), ["user_id", "segment"], "left").join(manifest.select("user_id", "run", "subset"), "user_id")
    rows = rows.join(static, rows["user_id"] == static["c_custkey"], "left").withColumn("static", F.col("c_acctbal"))
    return rows.select("run", "subset", "user_id", "segment", "n", "mean_value", F.coalesce("label", F.lit(0)).alias("label"), "static")


def haar(values: str) -> tuple[Column, Column]:
    """Approximation and detail of one Haar level."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(values) / 2).cast("int") - 1)
    at = lambda i, k: F.get(F.col(values), 2 * i + k).cast("double")
    root = F.sqrt(F.lit(2.0))
    return F.transform(pairs, lambda i: (at(i, 0) + at(i, 1)) / root), F.transform(pairs, lambda i: (at(i, 0) - at(i, 1)) / root)


def energy(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)


def patches(vectors: DataFrame, values: str, size: int) -> DataFrame:
    """vec_id, patch, mean of consecutive patches of ``size`` values."""
    last = F.floor(F.size(values) / size).cast("int") - 1
    rows = vectors.where(F.size(values) >= size).select("vec_id", values, F.explode(F.sequence(F.lit(0), last)).alias("patch"))
    total = F.aggregate(F.slice(values, F.col("patch") * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", "patch", (total / size).alias("mean"))
