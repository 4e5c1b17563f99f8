"""Segment metrics, alarms and their evaluation, score dynamics, and the paired bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import HOUR, Settings
from ..sources import stages

#: Slots of bootstrap draws that one task makes.
SLOTS = 2_000_000


def auroc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Rank-sum AUROC with ties counted half. Scores are dealt to 4096 stretches of [0, 1]; ranks run inside a
    stretch, and the stretches' totals are added, so no group is ranked in one task."""
    each = rows.where(f"{score} IS NOT NULL").groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    each = each.withColumn("stretch", F.floor(F.col(score) * 4096))
    totals = each.groupBy(*by, "stretch").agg(F.sum("q").alias("sq"))
    below = totals.select(*by, "stretch", (F.sum("sq").over(Window.partitionBy(*by).orderBy("stretch")) - F.col("sq")).alias("base"))
    inner = F.sum("q").over(Window.partitionBy(*by, "stretch").orderBy(score)) - F.col("q")
    won = each.withColumn("inner", inner).join(below, [*by, "stretch"])
    value = F.try_divide(F.sum(F.col("p") * (F.col("base") + F.col("inner") + F.col("q").cast("double") / 2)), F.sum("p").cast("double") * F.sum("q").cast("double"))
    return won.groupBy(*by).agg(value.alias("auroc"))


def recall_f1(rows: DataFrame, by: list[str], score: str, label: str, cutoff: float) -> DataFrame:
    hit, yes = F.col(score) >= cutoff, F.col(label) == 1
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    tp, fp, fn = n(hit & yes), n(hit & ~yes), n(~hit & yes)
    return rows.where(f"{score} IS NOT NULL").groupBy(*by).agg(F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def alarms(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Marks the first decision of each run of alarms. ``decisions`` has user_id, t, alarm."""
    before = F.coalesce(F.lag("alarm").over(Window.partitionBy(*by, "user_id").orderBy("t")), F.lit(False))
    return decisions.withColumn("alarm_onset", F.col("alarm") & ~before)


def warning_metrics(decisions: DataFrame, by: list[str], s: Settings) -> DataFrame:
    """Per group: events, warned events, decisions, false alarm onsets, sensitivity, false alarms per hour, median
    lead time, coverage. An event counts if an eligible decision lies in the horizon before it."""
    per = per_event(decisions, by)
    return summarised(per, by, s)


def per_event(decisions: DataFrame, by: list[str]) -> DataFrame:
    """For each group, user and event (its number; null: decisions before none): whether and when first it was warned of,
    its onset, its decisions, those in alarm, and false alarms."""
    rows = alarms(decisions, by)
    event = F.when(F.col("pre_onset"), F.col("next_event"))
    return rows.withColumn("event", event).groupBy(*by, "user_id", "event").agg(
        F.max(F.when(F.col("pre_onset"), F.col("next_onset"))).alias("onset"),
        F.max("alarm").alias("warned"), F.min(F.when(F.col("alarm"), F.col("t"))).alias("at"), F.count("*").alias("n"),
        F.sum(F.col("alarm").cast("bigint")).alias("in_alarm"), F.sum((F.col("alarm_onset") & ~F.col("pre_onset")).cast("bigint")).alias("false_alarms"),
    )


def summarised(per: DataFrame, by: list[str], s: Settings) -> DataFrame:
    real = F.col("event").isNotNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("bigint"))
    lead = F.when(real & F.col("warned"), (F.col("onset") - F.col("at")).cast("double") / float(HOUR))
    out = per.groupBy(*by).agg(
        count(real).alias("events"), count(real & F.col("warned")).alias("warned"), F.sum("n").alias("decisions"), F.sum("false_alarms").alias("false_alarms"),
        F.percentile(lead, 0.5).alias("lead_h"), F.sum(F.when(real, F.col("in_alarm"))).alias("covered"), F.sum(F.when(real, F.col("n"))).alias("before"),
    )
    return out.select(
        *by, "events", "warned", "decisions", "false_alarms", F.try_divide(F.col("warned").cast("double"), F.col("events").cast("double")).alias("sensitivity"),
        F.try_divide(F.col("false_alarms").cast("double"), F.col("decisions").cast("double") * s.grid_h).alias("false_alarms_per_h"), "lead_h",
        F.try_divide(F.col("covered").cast("double"), F.col("before").cast("double")).alias("coverage"),
    )


def sweep(decisions: DataFrame, candidates: list[float] | None = None) -> DataFrame:
    """run, threshold, decisions, events, warned, false_alarms at every distinct score, or at the ``candidates``.

    A decision begins an alarm exactly at the thresholds above the score before it and up to its own, and an event is
    warned of up to its highest score. So each decision adds one at its score and takes one at the score before, and
    what holds at a threshold is the sum from it upwards: no decision is copied for each threshold. Sums run inside
    4096 stretches of [0, 1], whose totals are added, so that no run is summed in one task. Null scores never alarm."""
    own = Window.partitionBy("run", "user_id").orderBy("t")
    rows = decisions.select("run", "user_id", "t", "score", "pre_onset", F.when(F.col("pre_onset"), F.col("next_onset")).alias("event"), F.lag("score").over(own).alias("prev"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    begins = rows.where(~F.col("pre_onset") & F.col("score").isNotNull() & (F.col("prev").isNull() | (F.col("prev") < F.col("score"))))
    point = lambda value, alarm, warned: F.struct(value.alias("value"), alarm.alias("alarms"), warned.alias("warned"))
    ends = begins.select("run", F.inline(F.array(point(F.col("score"), one, none), point(F.col("prev"), -one, none)))).where("value IS NOT NULL")
    warned = rows.where("pre_onset").groupBy("run", "user_id", "event").agg(F.max("score").alias("value"))
    wanted = rows.where("score IS NOT NULL").select("run", "score") if candidates is None else rows.select("run").distinct().withColumn("score", F.explode(F.array(*map(F.lit, candidates))))
    points = ends.unionByName(warned.where("value IS NOT NULL").select("run", "value", none.alias("alarms"), one.alias("warned"))).withColumn("asked", F.lit(False))
    points = points.unionByName(wanted.select("run", F.col("score").alias("value"), none.alias("alarms"), none.alias("warned"), F.lit(True).alias("asked")))
    each = points.groupBy("run", "value").agg(F.sum("alarms").alias("alarms"), F.sum("warned").alias("warned"), F.max("asked").alias("asked"))
    each = each.withColumn("stretch", F.least(F.greatest(F.floor(F.col("value") * 4096), F.lit(0)), F.lit(4095)))
    down = Window.partitionBy("run").orderBy(F.desc("stretch"))
    above = each.groupBy("run", "stretch").agg(F.sum("alarms").alias("a"), F.sum("warned").alias("w")).select("run", "stretch", (F.sum("a").over(down) - F.col("a")).alias("a"), (F.sum("w").over(down) - F.col("w")).alias("w"))
    inner = Window.partitionBy("run", "stretch").orderBy(F.desc("value"))
    found = each.select("run", "stretch", "value", "asked", F.sum("alarms").over(inner).alias("alarms"), F.sum("warned").over(inner).alias("warned")).where("asked").join(above, ["run", "stretch"])
    totals = rows.groupBy("run").agg(F.count("*").alias("decisions")).join(warned.groupBy("run").agg(F.count("*").alias("events")), "run", "left")
    return found.join(totals, "run").select("run", F.col("value").alias("threshold"), "decisions", F.coalesce("events", none).alias("events"), (F.col("w") + F.col("warned")).alias("warned"), (F.col("a") + F.col("alarms")).alias("false_alarms"))


def threshold(validation: DataFrame, s: Settings, exact: bool = False) -> DataFrame:
    """run, threshold: the most sensitive candidate within the alarm budget; of equals the larger; the largest if none.
    Candidates are ``s.thresholds`` even steps, or if ``exact`` all scores."""
    step = 1.0 / (s.thresholds + 1)
    found = sweep(validation, None if exact else [round(i * step, 6) for i in range(1, s.thresholds + 1)])
    fits = F.try_divide(F.col("false_alarms").cast("double"), F.col("decisions").cast("double") * s.grid_h) <= s.alarm_budget
    sensitivity = F.coalesce(F.try_divide(F.col("warned").cast("double"), F.col("events").cast("double")), F.lit(0.0))
    return found.groupBy("run").agg(F.max_by("threshold", F.struct(fits.alias("a"), F.when(fits, sensitivity).otherwise(F.lit(-1.0)).alias("b"), F.col("threshold").alias("c"))).alias("threshold"))


def dynamics(decisions: DataFrame, s: Settings) -> DataFrame:
    """Per user: mean rolling SD of the score in stable periods, its rise before onsets, and its correlation with time.
    ``decisions`` has user_id, t, score, ongoing, next_onset; stable: no episode now or within the longest horizon."""
    longest = max(s.horizons_h) * HOUR
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-(s.rolling_h * HOUR - 1), 0)
    away = F.col("next_onset") - F.col("t")
    stable = ~F.col("ongoing") & F.coalesce(away > longest, F.lit(True))
    before = ~F.col("ongoing") & F.coalesce(away <= longest, F.lit(False))
    rows = decisions.where("score IS NOT NULL").withColumn("n", F.count("score").over(w)).withColumn("rolling", F.when(F.col("n") >= 2, F.stddev_samp("score").over(w)))
    late = before & (away <= longest / 3)
    x, y = F.when(before, -away.cast("double") / float(HOUR)), F.when(before, F.col("score"))
    rows = rows.select("user_id", F.when(stable, F.col("rolling")).alias("rolling"), F.when(late, F.col("score")).alias("late"), F.when(before & ~late, F.col("score")).alias("early"), x.alias("x"), y.alias("y"))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return rows.groupBy("user_id").agg(
        F.avg("rolling").alias("rolling_sd"), (F.avg("late") - F.avg("early")).alias("rise"), F.when(spread > 1e-9, F.try_divide(F.covar_pop("x", "y"), spread)).alias("time_correlation")
    )


def rank_correlation(decisions: DataFrame, s: Settings) -> DataFrame:
    """user_id, n, rank_correlation: Spearman's, of score and time in the longest horizon before onsets; ties share their
    mean rank, and users whose ranks don't vary get null. ``decisions`` as in ``dynamics``."""
    away = F.col("next_onset") - F.col("t")
    rows = decisions.where("score IS NOT NULL AND NOT ongoing").where(away <= max(s.horizons_h) * HOUR).select("user_id", (-away).alias("x"), F.round("score", 9).alias("y"))
    rank = lambda c: F.rank().over(Window.partitionBy("user_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("user_id", c)) - 1) / 2
    rows = rows.select("user_id", rank("x").alias("x"), rank("y").alias("y"))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.when(spread > 1e-9, F.try_divide(F.covar_pop("x", "y"), spread)).alias("rank_correlation"))


def paired_bootstrap(arms: DataFrame, s: Settings) -> DataFrame:
    """delta, lower, upper: the difference of sensitivities of two arms, from resampled patients. ``arms`` has user_id,
    events, warned_a, warned_b. Both arms see the same draw, which is fixed by MD5s of draw and place."""
    arms = stages.put(arms.select("user_id", "events", "warned_a", "warned_b"), stages.folder(arms.sparkSession), [])  # read four times
    n = arms.count()
    # places of patients: their rank by id, counted between sampled bounds, so that stretches are alike in size however ids lie
    bounds = sorted({int(b) for b in arms.approxQuantile("user_id", [i / 256 for i in range(1, 256)], 0.001)})  # 255 at most
    part = F.size(F.filter(F.array(*map(F.lit, bounds or [0])), lambda b: b <= F.col("user_id")))
    ranked = arms.withColumn("part", part)
    base = ranked.groupBy("part").agg(F.count("*").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"))  # 256 rows at most
    ranked = ranked.join(F.broadcast(base), "part").withColumn("place", F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("user_id")) - 1)
    # a draw has as many slots as there are patients; a task makes SLOTS of them at most, and those who were drawn are looked
    # up slot by slot: draws are counted nowhere, and what a task holds is its share of the patients
    slots = arms.sparkSession.range(0, n * s.draws, 1, 1 + n * s.draws // SLOTS).select((F.col("id") % s.draws).alias("draw"), F.expr(f"id div {s.draws}").alias("slot"))
    hit = F.conv(F.substring(F.md5(F.concat_ws("-", "draw", "slot").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(n)
    drawn = slots.select(F.col("draw").cast("int").alias("draw"), hit.alias("place")).join(ranked.select("place", "events", "warned_a", "warned_b").hint("shuffle_hash"), "place")
    each = drawn.groupBy("draw").agg(*(F.sum(c).cast("double").alias(c) for c in ("events", "warned_a", "warned_b")))
    deltas = each.select(F.try_divide(F.col("warned_b") - F.col("warned_a"), "events").alias("delta"))
    tail = (1 - s.level) / 2
    whole = arms.agg(F.try_divide((F.sum("warned_b") - F.sum("warned_a")).cast("double"), F.sum("events").cast("double")).alias("delta"))
    return deltas.agg(F.percentile("delta", round(tail, 6)).alias("lower"), F.percentile("delta", round(1 - tail, 6)).alias("upper")).crossJoin(whole)  # one row each
