"""Episodes, the decision grid, and what is known at a decision: inputs look back, targets look ahead."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import HOUR, ORIGIN, Settings


def episodes(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, event, onset, end, n: maximal runs of low values, and their number among the user's, from 1 in order of time."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    low = F.col("value") < s.low
    runs = recordings.withColumn("low", low).withColumn("opens", (F.col("low") & ~F.coalesce(F.lag("low").over(order), F.lit(False))).cast("bigint"))
    runs = runs.withColumn("run", F.sum("opens").over(order)).where("low")
    found = runs.groupBy("user_id", "run").agg(F.min("us").alias("onset"), F.max("us").alias("end"), F.count("*").alias("n")).where(F.col("n") >= s.min_run)
    return found.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("run")).cast("long").alias("event"), "onset", "end", "n")


def grid(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, t, first, last: epoch-aligned decision times inside each recording."""
    step = s.grid_h * HOUR
    span = recordings.groupBy("user_id").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    lo, hi = F.ceil(F.col("first") / F.lit(step)).cast("bigint"), F.floor(F.col("last") / F.lit(step)).cast("bigint")
    return span.where(lo <= hi).withColumn("t", F.explode(F.sequence(lo, hi))).withColumn("t", F.col("t") * step)


def pane_us(s: Settings) -> int:
    """Width of a pane: the longest stretch that grid steps and windows are both made of."""
    return math.gcd(s.grid_h, s.window_h) * HOUR


def paned(recordings: DataFrame, s: Settings, *summaries: Column) -> DataFrame:
    """user_id, pane and ``summaries`` of the values in (pane - 1, pane] pane widths. Each value falls in one pane; what
    overlapping windows share is summed up once, and before it is shuffled where the summary allows."""
    past = F.pmod("us", F.lit(pane_us(s)))
    pane = ((F.col("us") - past) / pane_us(s)).cast("bigint") + (past > 0).cast("bigint")
    x = (F.col("us") - ORIGIN).cast("double") / float(HOUR)
    return recordings.select("user_id", "us", "event_id", "value", x.alias("x"), pane.alias("pane")).groupBy("user_id", "pane").agg(*summaries)


def at_decisions(panes: DataFrame, recordings: DataFrame, s: Settings, *merged: Column) -> DataFrame:
    """user_id, t, first, last and ``merged`` summaries of the panes in (t - window, t]. The frame runs over panes and
    decisions, so its length doesn't depend on how dense values are; nothing after t is in it."""
    places = grid(recordings, s).withColumn("pane", (F.col("t") / pane_us(s)).cast("bigint"))
    w = Window.partitionBy("user_id").orderBy("pane").rangeBetween(1 - s.window_h * HOUR // pane_us(s), 0)
    rows = panes.unionByName(places, allowMissingColumns=True)
    return rows.select("user_id", "t", "first", "last", *(m.over(w).alias(n) for m, n in zip(merged, panes.columns[2:], strict=True))).where("t IS NOT NULL")


def observed(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, t, first, last, n, mean_value, trend over (t - window, t]. Sums are taken in order of time, as equal scores are
    ranked as ties and sums of panes differ from them in the last place. A value is copied to each window that it lies in, and
    a window's running sums are read at its decision, which comes last: no window is held whole."""
    step, window = s.grid_h * HOUR, s.window_h * HOUR
    until = F.col("us") + (window - 1)  # the last decision that still sees the value is at or before this
    since = F.col("us") + F.pmod(-F.col("us"), F.lit(step))
    seen = recordings.select("user_id", "us", "event_id", "value", since.alias("_from"), (until - F.pmod(until, F.lit(step))).alias("_to")).where("_from <= _to")
    copies = seen.select("user_id", F.explode(F.sequence("_from", "_to", F.lit(step))).alias("t"), "us", "event_id", "value")
    rows = copies.unionByName(grid(recordings, s).select("user_id", "t", F.struct("first", "last").alias("span")), allowMissingColumns=True)
    order = [F.asc_nulls_last("us"), F.asc("event_id")]
    rows = rows.repartition("user_id", "t").sortWithinPartitions("user_id", "t", *order)  # before the products, so that narrow rows are sorted
    w = Window.partitionBy("user_id", "t").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = (F.col("us") - ORIGIN).cast("double") / float(HOUR), F.col("value")
    sums = {"n": F.count(y), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x)}
    rows = rows.select("user_id", "t", "span", *(e.over(w).alias(k) for k, e in sums.items())).where("span IS NOT NULL")
    rows = rows.select("user_id", "t", "span.*", *sums)
    across = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    trend = F.when((F.col("n") >= 2) & (across > 1e-6), F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), across))
    return rows.select("user_id", "t", "first", "last", "n", F.try_divide("sy", F.col("n").cast("double")).alias("mean_value"), trend.alias("trend"))


def resampled(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, t, value, age_h: at each decision time the latest value and its age, carried no farther than the
    look-back window; null where the window is empty. Of values at one time the one with the largest event_id counts."""
    rows = at_decisions(paned(recordings, s, F.max(F.struct("us", "event_id", "value")).alias("at")), recordings, s, F.max("at"))
    return rows.select("user_id", "t", "at.value", ((F.col("t") - F.col("at.us")).cast("double") / float(HOUR)).alias("age_h"))


def in_order(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, t, w: the window's (us, event_id, value) in order, joined from panes that are sorted once."""
    rows = at_decisions(paned(recordings, s, F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))).alias("w")), recordings, s, F.collect_list("w"))
    return rows.select("user_id", "t", F.flatten("w").alias("w"))


def once(rows: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``keep`` and the named ``columns``, these as a generated row. Below a projection the optimiser would spell out a
    column's definition where it is used, even inside a lambda, and so compute a mean anew for every element."""
    return rows.select(*keep, F.inline(F.array(F.struct(*columns))))


def features(recordings: DataFrame, s: Settings) -> DataFrame:
    """Window features of each decision, from the window's values in order of time."""
    rows = once(in_order(recordings, s), ["user_id", "t"], F.transform("w", lambda p: p["value"]).alias("v"))
    v, n = F.col("v"), F.size("v").cast("double")
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = once(rows, ["user_id", "t", "v"], F.try_divide(add(v), n).alias("mean"), F.array_sort("v").alias("ordered"))
    moment = lambda k: F.try_divide(add(F.transform(v, lambda x: F.pow(x - F.col("mean"), k))), n)
    steps = F.when(F.size("v") >= 2, F.zip_with(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))), F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(1))), lambda a, b: (a - b) * (a - b)))
    ordered, half = F.col("ordered"), F.floor(F.size("v") / 2).cast("int")
    middle = F.when(F.size("v") % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half) + F.get(ordered, half - 1)) / 2)
    rows = once(rows, ["user_id", "t", "mean"], F.size("v").cast("bigint").alias("n"), F.array_min("v").alias("low"), F.array_max("v").alias("high"), F.when(F.size("v") > 0, middle).alias("median"), *(moment(k).alias(f"m{k}") for k in (2, 3, 4)), F.sqrt(F.try_divide(add(steps), n - 1)).alias("rmssd"))
    flat = F.col("m2") <= 1e-9
    return rows.select(
        "user_id", "t", "n", "mean", F.sqrt("m2").alias("sd"), "low", "high", "median", (F.col("high") - F.col("low")).alias("spread"),
        F.when(~flat, F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"), F.when(~flat, F.col("m4") / (F.col("m2") * F.col("m2")) - 3.0).alias("kurtosis"), "rmssd",
    )


FAMILIES = ["slope", "q25", "q75", "iqr", "rms", "change", "mean_step", "max_step", "crossings", "share_low", "depth_low", "lag1", "age_h"]


def families(recordings: DataFrame, s: Settings) -> DataFrame:
    """user_id, t and ``FAMILIES``: trend, quartiles, energy, steps between neighbours, crossings of the mean, time below
    the limit, lag-one autocorrelation, and the last value's age, of each decision's window in order of time."""
    rows = in_order(recordings, s)
    hours = F.transform("w", lambda p: (p["us"] - ORIGIN).cast("double") / float(HOUR))
    rows = once(rows, ["user_id", "t"], F.transform("w", lambda p: p["value"]).alias("v"), hours.alias("x"), F.size("w").alias("n"), F.array_max(F.transform("w", lambda p: p["us"])).alias("us"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda c, y: c + y)
    mean = lambda a: F.try_divide(add(a), F.col("n").cast("double"))
    rows = once(rows, rows.columns, mean("v").alias("mv"), mean("x").alias("mx"), F.array_sort("v").alias("o"))
    rows = once(rows, rows.columns, F.transform("v", lambda y: y - F.col("mv")).alias("dv"), F.transform("x", lambda y: y - F.col("mx")).alias("dx"))
    pairs = lambda a, f: F.zip_with(F.slice(a, 2, F.greatest(F.col("n") - 1, F.lit(1))), F.slice(a, 1, F.greatest(F.col("n") - 1, F.lit(0))), f)
    many, square = F.col("n") >= 2, lambda y: y * y
    steps = pairs("v", lambda b, a: F.abs(b - a))
    across = add(F.transform("dx", square))

    def quantile(p: float) -> Column:
        place = (F.col("n") - 1) * p
        low = F.floor(place).cast("int")
        below, above = F.get("o", low), F.coalesce(F.get("o", low + 1), F.get("o", low))
        return F.when(F.col("n") > 0, below + (place - low) * (above - below))

    out = {
        "slope": F.when(many & (F.col("n") * across > 1e-6), add(F.zip_with("dx", "dv", lambda a, b: a * b)) / across),
        "q25": quantile(0.25), "q75": quantile(0.75), "iqr": quantile(0.75) - quantile(0.25), "rms": F.sqrt(mean(F.transform("v", square))),
        "change": F.get("v", F.col("n") - 1) - F.get("v", F.lit(0)), "mean_step": F.when(many, add(steps) / (F.col("n") - 1)), "max_step": F.when(many, F.array_max(steps)),
        "crossings": F.when(many, F.size(F.filter(pairs("dv", lambda b, a: (b > 1e-9) != (a > 1e-9)), lambda c: c)).cast("bigint")),
        "share_low": mean(F.transform("v", lambda y: (y < s.low).cast("double"))), "depth_low": mean(F.transform("v", lambda y: F.greatest(F.lit(0.0), s.low - y))),
        "lag1": F.when(many & (add(F.transform("dv", square)) > 1e-6), add(pairs("dv", lambda b, a: a * b)) / add(F.transform("dv", square))),
        "age_h": (F.col("t") - F.col("us")).cast("double") / float(HOUR),
    }
    return rows.select("user_id", "t", *(out[c].alias(c) for c in FAMILIES))


def with_outlook(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """``decisions`` with ``ongoing``, ``next_onset`` and ``next_event``: targets only. One pass along each recording
    instead of an interval join."""
    names = decisions.columns
    marks = found.select("user_id", F.col("onset").alias("t"), F.col("end").alias("_end"), F.struct("onset", "event").alias("_next"))
    rows = decisions.withColumn("_is", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    past = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("user_id").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)  # from the end on, so that the frame only grows
    rows = rows.withColumn("_last", F.max("_end").over(past)).withColumn("_next", F.min("_next").over(ahead))
    return rows.where("_is").select(*names, F.coalesce(F.col("_last") >= F.col("t"), F.lit(False)).alias("ongoing"), F.col("_next.onset").alias("next_onset"), F.col("_next.event").alias("next_event"))


def per_horizon(decisions: DataFrame, s: Settings) -> DataFrame:
    """A row per decision and horizon, with the hard label."""
    rows = decisions.withColumn("horizon_h", F.explode(F.array(*map(F.lit, s.horizons_h))))
    ahead = F.coalesce(F.col("next_onset") - F.col("t") <= F.col("horizon_h").cast("bigint") * HOUR, F.lit(False))
    return rows.withColumn("pre_onset", ~F.col("ongoing") & ahead).withColumn("hard", (F.col("ongoing") | ahead).cast("int"))


def eligible(decisions: DataFrame, s: Settings) -> DataFrame:
    """Chronological decisions: no ongoing episode, a full look-back, and a full horizon."""
    back = F.col("t") - s.window_h * HOUR >= F.col("first")
    ahead: Column = F.col("t") + F.col("horizon_h").cast("bigint") * HOUR <= F.col("last")
    return decisions.where(~F.col("ongoing") & back & ahead)
