"""The queries of the evaluation pipeline over the driver's tables, and their SQL.

Users of ``events`` stand in for patients, their values for a monitored signal. All definitions are in ``settings``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import assemble, evaluate, partition, references, scoring, timeline, waveforms
from ..sources import stages
from ..sources import waveforms as raw
from ..sources.tables import read, recordings
from .settings import DEFAULT as S
from .settings import HOUR, ORIGIN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to some decimals, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[name] = f"WITH {BASE} {sql}"
        return f

    return add


W, STEP = S.window_h * HOUR, S.grid_h * HOUR
BASE = f"""
ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
fd AS (SELECT user_id, (CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 5)::INTEGER AS fold, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 9, 8) AS BIGINT) % 2 AS half FROM (SELECT DISTINCT user_id FROM ev)),
mf AS (SELECT user_id, fold, run::INTEGER AS run, CASE WHEN fold <> run THEN 'train' WHEN half = 0 THEN 'validation' ELSE 'test' END AS subset FROM fd, range(5) t(run)),
lo AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - row_number() OVER (PARTITION BY user_id, value < {S.low} ORDER BY us, event_id) AS g FROM ev),
ep AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g) AS event FROM (SELECT user_id, g, min(us) AS onset, max(us) AS "end", count(*) AS n FROM lo WHERE value < {S.low} GROUP BY user_id, g HAVING count(*) >= {S.min_run})),
gr AS (SELECT user_id, a AS "first", b AS "last", k * {STEP} AS t FROM (SELECT user_id, a, b, unnest(range(ceil(a / {STEP}.0)::BIGINT, floor(b / {STEP}.0)::BIGINT + 1)) AS k FROM (SELECT user_id, min(us) AS a, max(us) AS b FROM ev GROUP BY user_id))),
xs AS (SELECT gr.*, value, us, event_id, (us - {ORIGIN})::DOUBLE / {HOUR}.0 AS x FROM gr LEFT JOIN ev ON ev.user_id = gr.user_id AND us > t - {W} AND us <= t),
ob AS (SELECT user_id, t, "first", "last", count(value) AS n, avg(value) AS mean_value, CASE WHEN count(value) >= 2 AND count(value) * sum(x * x) - sum(x) * sum(x) > 1e-6
  THEN (count(value) * sum(x * value) - sum(x) * sum(value)) / (count(value) * sum(x * x) - sum(x) * sum(x)) END AS trend FROM xs GROUP BY ALL),
ou AS (SELECT ob.*, EXISTS (SELECT 1 FROM ep WHERE ep.user_id = ob.user_id AND onset <= t AND "end" >= t) AS ongoing, (SELECT min(onset) FROM ep WHERE ep.user_id = ob.user_id AND onset > t) AS next_onset, (SELECT min(event) FROM ep WHERE ep.user_id = ob.user_id AND onset > t) AS next_event FROM ob),
ph AS (SELECT *, NOT ongoing AND ahead AS pre_onset, (ongoing OR ahead)::INTEGER AS hard, 1 / (1 + exp(-(({S.low} - mean_value) / {S.score_scale}))) AS score, 1 / (1 + exp(-(({S.low} - mean_value) / {S.score_scale} - coalesce(trend, 0)))) AS score_b FROM
  (SELECT ou.*, h::INTEGER AS horizon_h, coalesce(next_onset - t <= h::BIGINT * {HOUR}, false) AS ahead FROM ou, (VALUES (24), (48), (72)) v(h))),
el AS (SELECT * FROM ph WHERE NOT ongoing AND t - {W} >= "first" AND t + horizon_h::BIGINT * {HOUR} <= "last"),
sg AS (SELECT user_id, us // {W} AS segment, value, us - lag(us) OVER (PARTITION BY user_id, us // {W} ORDER BY us, event_id) AS gap FROM ev),
cl AS (SELECT user_id, segment, n, mean_value, plausible, longest_gap_h, flat, n >= 2 AND NOT flat AND plausible >= {S.min_plausible} * n AND coalesce(longest_gap_h, 0) <= {S.max_gap_h} AS clean FROM (SELECT user_id, segment, count(*) AS n, avg(value) AS mean_value,
  count(*) FILTER (value BETWEEN {S.plausible[0]} AND {S.plausible[1]}) AS plausible, max(gap)::DOUBLE / {HOUR}.0 AS longest_gap_h, min(value) = max(value) AS flat FROM sg GROUP BY ALL)),
so AS (SELECT *, CASE WHEN ongoing THEN 1.0::DOUBLE WHEN next_onset IS NULL THEN 0 ELSE greatest(0, 1 - (next_onset - t)::DOUBLE / (horizon_h::DOUBLE * {HOUR})) END AS c_time,
  CASE WHEN mean_value IS NULL THEN 0 ELSE greatest(0, least(1, ({S.severity_at}::DOUBLE - mean_value) / {S.severity_at}::DOUBLE)) END AS c_map, CASE WHEN trend IS NULL THEN 0 ELSE greatest(0, least(1, -trend / {S.trend_scale}::DOUBLE)) END AS c_trend FROM ph)"""


def rec(spark: SparkSession, d: str) -> DataFrame:
    return recordings(read(spark, d, "events"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """The fixed assignment of patients to subsets, stored once a session for all comparisons."""
    return stages.kept(spark, "manifest", f"{d}/events.parquet", ["run", "subset"], lambda: partition.manifests(rec(spark, d), S)).select("user_id", "fold", "run", "subset")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """A row per decision and horizon: inputs, outlook, labels and the two scores. Stored once a session for all
    comparisons, in a folder for each horizon."""

    def make() -> DataFrame:
        r = rec(spark, d)
        rows = timeline.per_horizon(timeline.with_outlook(timeline.observed(r, S), timeline.episodes(r, S)), S)
        return rows.withColumn("score", sc.value_score(F.col("mean_value"), S)).withColumn("score_b", sc.both_score(F.col("mean_value"), F.col("trend"), S))

    return stages.kept(spark, "decisions", f"{d}/events.parquet", ["horizon_h"], make)


def eligible(spark: SparkSession, d: str, horizon: int = S.alarm_horizon_h) -> DataFrame:
    return timeline.eligible(decisions(spark, d).where(F.col("horizon_h") == horizon), S)


def soft(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("horizon_h").cast("bigint")
    return decisions(spark, d).withColumns({"c_time": sc.proximity(F.col("t"), F.col("next_onset"), F.col("ongoing"), h), "c_map": sc.severity(F.col("mean_value"), S), "c_trend": sc.falling(F.col("trend"), S)})


def target():
    return sum((w * F.col(c) for w, c in zip(S.weights[1:], ("c_map", "c_trend"), strict=True)), S.weights[0] * F.col("c_time"))


@query("q01_fold_assign", "SELECT user_id, fold FROM fd")
def q01(spark, d):
    return partition.folds(rec(spark, d), S)


@query("q02_fold_rotate", "SELECT user_id, fold, run, subset FROM mf")
def q02(spark, d):
    return manifest(spark, d)


@query(
    "q03_fold_audit",
    """, o AS (SELECT run, sum((n > 1)::BIGINT)::BIGINT AS overlap FROM (SELECT run, user_id, count(DISTINCT subset) AS n FROM mf GROUP BY ALL) GROUP BY run)
SELECT run, subset, count(DISTINCT user_id) AS users, any_value(overlap) AS overlap FROM mf JOIN o USING (run) GROUP BY run, subset""",
)
def q03(spark, d):
    return partition.audit(manifest(spark, d))


@query("q04_episodes", 'SELECT user_id, event, onset, "end", n FROM ep')
def q04(spark, d):
    return timeline.episodes(rec(spark, d), S)


@query("q05_decision_grid", "SELECT user_id, t, n, round(mean_value, 6) + 0.0 AS mean_value FROM ob")
def q05(spark, d):
    return timeline.observed(rec(spark, d), S).select("user_id", "t", "n", "mean_value")


@query("q06_hard_label", "SELECT user_id, t, horizon_h, hard FROM ph")
def q06(spark, d):
    return decisions(spark, d).select("user_id", "t", "horizon_h", "hard")


@query("q07_soft_time", "SELECT user_id, t, horizon_h, round(c_time, 9) + 0.0 AS c_time FROM so", 9)
def q07(spark, d):
    return soft(spark, d).select("user_id", "t", "horizon_h", "c_time")


@query("q08_soft_map_trend", "SELECT user_id, t, round(c_map, 9) + 0.0 AS c_map, round(c_trend, 9) + 0.0 AS c_trend FROM so WHERE horizon_h = 24", 9)
def q08(spark, d):
    return soft(spark, d).where("horizon_h = 24").select("user_id", "t", "c_map", "c_trend")


@query("q09_soft_target", "SELECT user_id, t, horizon_h, round(0.5::DOUBLE * c_time + 0.3::DOUBLE * c_map + 0.2::DOUBLE * c_trend, 9) + 0.0 AS soft FROM so", 9)
def q09(spark, d):
    return soft(spark, d).select("user_id", "t", "horizon_h", target().alias("soft"))


@query("q10_trend", "SELECT user_id, t, round(trend, 6) + 0.0 AS trend FROM ob")
def q10(spark, d):
    return timeline.observed(rec(spark, d), S).select("user_id", "t", "trend")


@query(
    "q11_window_features",
    """, a AS (SELECT user_id, t, count(value) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high, median(value) AS median FROM xs GROUP BY ALL),
m AS (SELECT xs.user_id, xs.t, avg((value - mean) ** 2) AS m2, avg((value - mean) ** 3) AS m3, avg((value - mean) ** 4) AS m4 FROM xs JOIN a USING (user_id, t) GROUP BY ALL),
s AS (SELECT user_id, t, sqrt(avg(d * d)) AS rmssd FROM (SELECT user_id, t, value - lag(value) OVER (PARTITION BY user_id, t ORDER BY us, event_id) AS d FROM xs) GROUP BY ALL)
SELECT user_id, t, n, round(mean, 6) + 0.0 AS mean, round(sqrt(m2), 6) + 0.0 AS sd, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(median, 6) + 0.0 AS median, round(high - low, 6) + 0.0 AS spread,
  round(CASE WHEN m2 > 1e-9 THEN m3 / m2 ** 1.5 END, 6) + 0.0 AS skewness, round(CASE WHEN m2 > 1e-9 THEN m4 / (m2 * m2) - 3 END, 6) + 0.0 AS kurtosis, round(rmssd, 6) + 0.0 AS rmssd
FROM a JOIN m USING (user_id, t) JOIN s USING (user_id, t)""",
)
def q11(spark, d):
    return timeline.features(rec(spark, d), S)


@query(
    "q12_train_scaling",
    """, j AS (SELECT run, user_id, t, subset, mean_value FROM ob JOIN mf USING (user_id)), f AS (SELECT run, avg(mean_value) AS c, stddev_pop(mean_value) AS s FROM j WHERE subset = 'train' GROUP BY run)
SELECT run, user_id, t, subset, round(coalesce((coalesce(mean_value, c) - c) / CASE WHEN s > 1e-9 THEN s END, 0), 6) + 0.0 AS z FROM j JOIN f USING (run)""",
)
def q12(spark, d):
    return assemble.scaling(timeline.observed(rec(spark, d), S), manifest(spark, d), "mean_value")


def auroc_sql(source: str, by: str) -> str:
    return f"""(SELECT {by}, sum(CASE WHEN hard = 1 THEN r END) AS rs, count(*) FILTER (hard = 1) AS p, count(*) FILTER (hard = 0) AS q FROM
  (SELECT {by}, hard, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS r FROM {source} WHERE score IS NOT NULL) GROUP BY {by})"""


@query("q13_auroc", f"SELECT horizon_h, round((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q), 6) + 0.0 AS auroc FROM {auroc_sql('ph', 'horizon_h')}")
def q13(spark, d):
    return evaluate.auroc(decisions(spark, d), ["horizon_h"], "score", "hard")


@query(
    "q14_recall_f1",
    f"""SELECT horizon_h, round(tp / (tp + fn), 6) + 0.0 AS recall, round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1 FROM (SELECT horizon_h, sum((score >= {S.cutoff} AND hard = 1)::INTEGER)::DOUBLE AS tp,
  sum((score >= {S.cutoff} AND hard = 0)::INTEGER)::DOUBLE AS fp, sum((score < {S.cutoff} AND hard = 1)::INTEGER)::DOUBLE AS fn FROM ph WHERE score IS NOT NULL GROUP BY horizon_h)""",
)
def q14(spark, d):
    return evaluate.recall_f1(decisions(spark, d), ["horizon_h"], "score", "hard", S.cutoff)


@query(
    "q15_bernoulli_kl",
    f""", k AS (SELECT horizon_h, 0.5::DOUBLE * c_time + 0.3::DOUBLE * c_map + 0.2::DOUBLE * c_trend AS p, greatest({S.epsilon}, least(1 - {S.epsilon}, score)) AS q FROM so WHERE score IS NOT NULL)
SELECT horizon_h, round(avg(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * ln((1 - p) / (1 - q)) ELSE 0 END), 6) + 0.0 AS kl FROM k GROUP BY horizon_h""",
)
def q15(spark, d):
    return soft(spark, d).where("score IS NOT NULL").groupBy("horizon_h").agg(F.avg(sc.bernoulli_kl(target(), F.col("score"), S.epsilon)).alias("kl"))


@query("q16_eligible_grid", "SELECT user_id, t, horizon_h, pre_onset FROM el")
def q16(spark, d):
    return timeline.eligible(decisions(spark, d), S).select("user_id", "t", "horizon_h", "pre_onset")


def warning_sql(source: str, by: str, out: str) -> str:
    return f"""{out}_a AS (SELECT *, alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY {by}, user_id ORDER BY t), false) AS alarm_onset FROM {source}),
{out}_p AS (SELECT {by}, user_id, CASE WHEN pre_onset THEN next_onset END AS event, bool_or(alarm) AS warned, min(CASE WHEN alarm THEN t END) AS alarmed, count(*) AS n, sum(alarm::INTEGER) AS in_alarm,
  sum((alarm_onset AND NOT pre_onset)::INTEGER) AS fa FROM {out}_a GROUP BY ALL),
{out} AS (SELECT {by}, count(event) AS events, count(*) FILTER (event IS NOT NULL AND warned) AS warned, sum(n) AS decisions, sum(fa) AS false_alarms,
  quantile_cont(CASE WHEN event IS NOT NULL AND warned THEN (event - alarmed)::DOUBLE / {HOUR} END, 0.5) AS lead_h, sum(in_alarm) FILTER (event IS NOT NULL) AS covered, sum(n) FILTER (event IS NOT NULL) AS before FROM {out}_p GROUP BY {by})"""


CANDIDATES = ", ".join(f"({round(i / (S.thresholds + 1), 6)}::DOUBLE)" for i in range(1, S.thresholds + 1))
THRESHOLD_SQL = f"""v AS (SELECT el.*, run, threshold, coalesce(score >= threshold, false) AS alarm FROM el JOIN mf USING (user_id), (VALUES {CANDIDATES}) c(threshold) WHERE horizon_h = {S.alarm_horizon_h} AND subset = 'validation'),
{warning_sql("v", "run, threshold", "vw")},
vf AS (SELECT run, threshold, false_alarms::DOUBLE / (decisions::DOUBLE * {S.grid_h}) <= {S.alarm_budget} AS fits, warned::DOUBLE / nullif(events, 0) AS sens FROM vw),
th AS (SELECT run, threshold FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fits DESC, CASE WHEN fits THEN coalesce(sens, 0) ELSE -1 END DESC, threshold DESC) AS k FROM vf) WHERE k = 1),
te AS (SELECT el.*, run, coalesce(score >= threshold, false) AS alarm FROM el JOIN mf USING (user_id) JOIN th USING (run) WHERE horizon_h = {S.alarm_horizon_h} AND subset = 'test'),
{warning_sql("te", "run", "tw")}"""


def tested(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The runs' thresholds, and test decisions with their alarms."""
    rows = eligible(spark, d).join(manifest(spark, d).where("subset <> 'train'").select("user_id", "run", "subset"), "user_id")
    chosen = evaluate.threshold(rows.where("subset = 'validation'"), S)
    return chosen, rows.where("subset = 'test'").join(F.broadcast(chosen), "run").withColumn("alarm", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))  # a row per run


def monitored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chosen, test = tested(spark, d)
    return chosen, evaluate.warning_metrics(test, ["run"], S)


@query("q17_val_threshold", f", {THRESHOLD_SQL} SELECT run, round(threshold, 6) + 0.0 AS threshold FROM th")
def q17(spark, d):
    return monitored(spark, d)[0]


@query("q18_event_sensitivity", f", {THRESHOLD_SQL} SELECT run, events, warned, round(warned::DOUBLE / nullif(events, 0), 6) + 0.0 AS sensitivity FROM tw")
def q18(spark, d):
    return monitored(spark, d)[1].select("run", "events", "warned", "sensitivity")


@query("q19_false_alarm_rate", f", {THRESHOLD_SQL} SELECT run, decisions::BIGINT AS decisions, false_alarms::BIGINT AS false_alarms, round(false_alarms::DOUBLE / (decisions::DOUBLE * {S.grid_h}), 6) + 0.0 AS false_alarms_per_h FROM tw")
def q19(spark, d):
    return monitored(spark, d)[1].select("run", "decisions", "false_alarms", "false_alarms_per_h")


@query("q20_lead_time", f", {THRESHOLD_SQL} SELECT run, round(lead_h, 6) + 0.0 AS lead_h FROM tw")
def q20(spark, d):
    return monitored(spark, d)[1].select("run", "lead_h")


@query("q21_coverage", f", {THRESHOLD_SQL} SELECT run, round(covered::DOUBLE / nullif(before, 0), 6) + 0.0 AS coverage FROM tw")
def q21(spark, d):
    return monitored(spark, d)[1].select("run", "coverage")


LONGEST = max(S.horizons_h) * HOUR


@query(
    "q22_score_dynamics",
    f""", r AS (SELECT user_id, t, score, ongoing, next_onset - t AS away, count(score) OVER w AS n, stddev_samp(score) OVER w AS sd FROM ph WHERE horizon_h = 24 AND score IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {S.rolling_h * HOUR - 1} PRECEDING AND CURRENT ROW)),
b AS (SELECT user_id, CASE WHEN NOT ongoing AND coalesce(away > {LONGEST}, true) AND n >= 2 THEN sd END AS rolling, NOT ongoing AND coalesce(away <= {LONGEST}, false) AS before, away, score FROM r),
c AS (SELECT user_id, rolling, CASE WHEN before AND away <= {LONGEST} / 3.0 THEN score END AS late, CASE WHEN before AND away > {LONGEST} / 3.0 THEN score END AS early, CASE WHEN before THEN -away::DOUBLE / {HOUR} END AS x, CASE WHEN before THEN score END AS y FROM b)
SELECT user_id, round(avg(rolling), 6) + 0.0 AS rolling_sd, round(avg(late) - avg(early), 6) + 0.0 AS rise,
  round(CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) + 0.0 AS time_correlation FROM c GROUP BY user_id""",
)
def q22(spark, d):
    return evaluate.dynamics(decisions(spark, d).where("horizon_h = 24"), S)


@query(
    "q23_cluster_bootstrap",
    f""", p AS (SELECT user_id, next_onset, bool_or(coalesce(score >= {S.cutoff}, false)) AS a, bool_or(coalesce(score_b >= {S.cutoff}, false)) AS b FROM el WHERE horizon_h = {S.alarm_horizon_h} AND pre_onset GROUP BY ALL),
u AS (SELECT user_id, count(*) AS events, sum(a::INTEGER) AS a, sum(b::INTEGER) AS b, row_number() OVER (ORDER BY user_id) - 1 AS place FROM p GROUP BY user_id),
n AS (SELECT count(*) AS n FROM u),
w AS (SELECT draw, CAST('0x' || substr(md5(draw || '-' || k.place), 1, 8) AS BIGINT) % n AS place FROM u k, n, range({S.draws}) t(draw)),
e AS (SELECT draw, (sum(b) - sum(a))::DOUBLE / sum(events) AS delta FROM w JOIN u USING (place) GROUP BY draw)
SELECT round((SELECT (sum(b) - sum(a))::DOUBLE / sum(events) FROM u), 6) + 0.0 AS delta, round(quantile_cont(delta, 0.025), 6) + 0.0 AS lower, round(quantile_cont(delta, 0.975), 6) + 0.0 AS upper FROM e""",
)
def q23(spark, d):
    events = eligible(spark, d).where("pre_onset").groupBy("user_id", "next_onset").agg(*(F.max(F.coalesce(F.col(c) >= S.cutoff, F.lit(False))).alias(a) for c, a in (("score", "a"), ("score_b", "b"))))
    arms = events.groupBy("user_id").agg(F.count("*").alias("events"), F.sum(F.col("a").cast("bigint")).alias("warned_a"), F.sum(F.col("b").cast("bigint")).alias("warned_b"))
    return evaluate.paired_bootstrap(arms, S).select("delta", "lower", "upper")


def references_auroc(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    arms = F.array(*(F.struct(F.lit(n).alias("model"), c.alias("score")) for n, c in (("value", F.col("score")), ("trend", sc.trend_score(F.col("trend"))), ("both", F.col("score_b")))))
    return evaluate.auroc(rows.select(*by, "hard", F.inline(arms)), [*by, "model"], "score", "hard")


@query(
    "q24_simple_refs",
    f""", m AS (SELECT 'value' AS model, hard, score FROM el WHERE horizon_h = {S.alarm_horizon_h} UNION ALL SELECT 'trend', hard, 1 / (1 + exp(trend)) FROM el WHERE horizon_h = {S.alarm_horizon_h}
  UNION ALL SELECT 'both', hard, score_b FROM el WHERE horizon_h = {S.alarm_horizon_h})
SELECT model, round((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q), 6) + 0.0 AS auroc FROM {auroc_sql('m', 'model')}""",
)
def q24(spark, d):
    return references_auroc(eligible(spark, d))


def newton_sql(source: str, steps: int = 14) -> str:
    """n<steps>: run, model and weights b0, b1, b2 after unrolled Newton steps from 0, solved by Cramer's rule. The source
    has run, model, hard and inputs x1, x2 (0 where the model has none)."""
    r, out = references.RIDGE, [f"n0 AS MATERIALIZED (SELECT DISTINCT run, model, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {source})"]
    for k in range(steps):
        sums = f"""SELECT run, model, b0, b1, b2, avg(p - hard) AS g0, avg((p - hard) * x1) + {r} * b1 AS g1, avg((p - hard) * x2) + {r} * b2 AS g2, avg(q) AS a, avg(q * x1) AS b, avg(q * x2) AS c, avg(q * x1 * x1) + {r} AS d, avg(q * x1 * x2) AS e, avg(q * x2 * x2) + {r} AS f
  FROM (SELECT *, p * (1 - p) AS q FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {source} JOIN n{k} USING (run, model))) GROUP BY run, model, b0, b1, b2"""
        out.append(f"""n{k + 1} AS MATERIALIZED (SELECT run, model, b0 - (g0 * (d * f - e * e) - b * (g1 * f - e * g2) + c * (g1 * e - d * g2)) / det AS b0, b1 - (a * (g1 * f - e * g2) - g0 * (b * f - c * e) + c * (b * g2 - c * g1)) / det AS b1,
  b2 - (a * (d * g2 - g1 * e) - b * (b * g2 - g1 * c) + g0 * (b * e - c * d)) / det AS b2 FROM (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM ({sums})))""")
    return ",\n".join(out)


FITTED_SQL = f"""fj AS MATERIALIZED (SELECT el.*, run, subset FROM el JOIN mf USING (user_id) WHERE horizon_h = {S.alarm_horizon_h} AND subset <> 'validation'),
fs AS (SELECT run, avg(mean_value) AS c1, sqrt(var_pop(mean_value) * count(mean_value) / (count(*) - 1)) AS s1, avg(trend) AS c2, sqrt(var_pop(trend) * count(trend) / (count(*) - 1)) AS s2 FROM fj WHERE subset = 'train' GROUP BY run),
fz AS (SELECT run, subset, user_id, t, hard, coalesce((mean_value - c1) / CASE WHEN s1 > 1e-9 THEN s1 END, 0) AS z1, coalesce((trend - c2) / CASE WHEN s2 > 1e-9 THEN s2 END, 0) AS z2 FROM fj JOIN fs USING (run)),
fm AS MATERIALIZED (SELECT run, subset, user_id, t, hard, model, z1 * u AS x1, z2 * v AS x2 FROM fz, (VALUES ('value', 1, 0), ('trend', 0, 1), ('both', 1, 1)) m(model, u, v)),
ft AS MATERIALIZED (SELECT * FROM fm WHERE subset = 'train'),
{newton_sql("ft")}"""


@query("q24_simple_refs_fitted", f", {FITTED_SQL} SELECT model, run, user_id, t, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 6) + 0.0 AS score FROM fm JOIN n14 USING (run, model) WHERE subset = 'test'")
def q24_fitted(spark, d):
    return references.fitted(eligible(spark, d), manifest(spark, d)).drop("hard")


@query(
    "q25_haar_dwt",
    """, i AS (SELECT vec_id, unnest(range(len(embedding) // 2)) AS i, embedding FROM embeddings)
SELECT vec_id, round(sum(((embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / sqrt(2)) ** 2), 6) + 0.0 AS approximation, round(sum(((embedding[2 * i + 1]::DOUBLE - embedding[2 * i + 2]::DOUBLE) / sqrt(2)) ** 2), 6) + 0.0 AS detail FROM i GROUP BY vec_id""",
)
def q25(spark, d):
    a, b = assemble.haar("embedding")
    return read(spark, d, "embeddings").where("size(embedding) >= 2").select("vec_id", assemble.energy(a).alias("approximation"), assemble.energy(b).alias("detail"))


@query(
    "q26_patches",
    """, i AS (SELECT vec_id, unnest(range(len(embedding) // 16)) AS patch, embedding FROM embeddings)
SELECT vec_id, patch::INTEGER AS patch, round(list_sum(list_transform(embedding[16 * patch + 1 : 16 * patch + 16], lambda x: x::DOUBLE)) / 16, 6) + 0.0 AS mean FROM i""",
)
def q26(spark, d):
    return assemble.patches(read(spark, d, "embeddings"), "embedding", 16)


@query("q27_run_summary", f", {THRESHOLD_SQL} SELECT count(*) AS runs, round(avg(warned::DOUBLE / events), 6) + 0.0 AS mean, round(stddev_samp(warned::DOUBLE / events), 6) + 0.0 AS sd FROM tw")
def q27(spark, d):
    return monitored(spark, d)[1].agg(F.count("*").alias("runs"), F.avg("sensitivity").alias("mean"), F.stddev_samp("sensitivity").alias("sd"))


@query(
    "q28_segment_assembly",
    f""", s AS (SELECT * FROM cl WHERE clean), l AS (SELECT DISTINCT user_id, onset // {W} AS segment FROM ep)
SELECT run, subset, s.user_id, s.segment, n, round(mean_value, 6) + 0.0 AS mean_value, CASE WHEN l.user_id IS NULL THEN 0 ELSE 1 END AS label, round(c_acctbal, 6) + 0.0 AS static
FROM s JOIN mf USING (user_id) LEFT JOIN l ON l.user_id = s.user_id AND l.segment = s.segment LEFT JOIN customer ON c_custkey = s.user_id""",
)
def q28(spark, d):
    r = rec(spark, d)
    return assemble.assembled(assemble.segments(r, S), manifest(spark, d), timeline.episodes(r, S), read(spark, d, "customer").select("c_custkey", "c_acctbal"), S)


@query(
    "q29_resample",
    f"""SELECT user_id, t, round(value, 6) + 0.0 AS value, round((t - us)::DOUBLE / {HOUR}.0, 6) + 0.0 AS age_h
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY us DESC NULLS LAST, event_id DESC) AS k FROM xs) WHERE k = 1""",
)
def q29(spark, d):
    return timeline.resampled(rec(spark, d), S)


@query(
    "q30_segment_cleaning",
    "SELECT user_id, segment, n, plausible, round(longest_gap_h, 6) + 0.0 AS longest_gap_h, flat, clean FROM cl",
)
def q30(spark, d):
    return assemble.cleaned(rec(spark, d), S).drop("mean_value")


FAMILY_SQL = f""", a AS (SELECT user_id, t, count(value) AS n, avg(value) AS mean, avg(x) AS mx, sqrt(avg(value * value)) AS rms, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, arg_max(value, us) - arg_min(value, us) AS change,
  avg(CASE WHEN value < {S.low} THEN 1.0::DOUBLE WHEN value IS NOT NULL THEN 0 END) AS share_low, avg(CASE WHEN value < {S.low} THEN {S.low}::DOUBLE - value WHEN value IS NOT NULL THEN 0 END) AS depth_low, (t - max(us))::DOUBLE / {HOUR}.0 AS age_h FROM xs GROUP BY user_id, t),
d AS (SELECT xs.user_id, xs.t, value, mean, x - mx AS dx, lag(value) OVER (PARTITION BY xs.user_id, xs.t ORDER BY us, event_id) AS prev FROM xs JOIN a USING (user_id, t)),
s AS (SELECT user_id, t, avg(abs(value - prev)) AS mean_step, max(abs(value - prev)) AS max_step, sum(CASE WHEN prev IS NOT NULL THEN ((value - mean > 1e-9) <> (prev - mean > 1e-9))::INTEGER END)::BIGINT AS crossings,
  CASE WHEN count(value) >= 2 AND sum((value - mean) ** 2) > 1e-6 THEN sum((value - mean) * (prev - mean)) / sum((value - mean) ** 2) END AS lag1,
  CASE WHEN count(value) >= 2 AND count(value) * sum(dx * dx) > 1e-6 THEN sum(dx * (value - mean)) / sum(dx * dx) END AS slope FROM d GROUP BY ALL),
fm AS (SELECT user_id, t, slope, q25, q75, q75 - q25 AS iqr, rms, change, mean_step, max_step, crossings, share_low, depth_low, lag1, age_h FROM a JOIN s USING (user_id, t))"""


@query("q31_feature_families", f"{FAMILY_SQL} SELECT user_id, t, crossings, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in timeline.FAMILIES if c != 'crossings')} FROM fm")
def q31(spark, d):
    return timeline.families(rec(spark, d), S)


@query(
    "q32_train_scaling_all",
    f"""{FAMILY_SQL}, j AS (SELECT run, subset, fm.* FROM fm JOIN mf USING (user_id)),
f AS (SELECT run, {", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in timeline.FAMILIES)} FROM j WHERE subset = 'train' GROUP BY run)
SELECT run, user_id, t, subset, {", ".join(f"round(coalesce(({c} - c_{c}) / CASE WHEN s_{c} > 1e-9 THEN s_{c} END, 0), 6) + 0.0 AS z_{c}" for c in timeline.FAMILIES)} FROM j JOIN f USING (run)""",
)
def q32(spark, d):
    return assemble.scaled(timeline.families(rec(spark, d), S), manifest(spark, d), timeline.FAMILIES)


@query(
    "q33_stored_subsets",
    f""", s AS (SELECT * FROM cl WHERE clean), l AS (SELECT DISTINCT user_id, onset // {W} AS segment FROM ep)
SELECT run, subset, count(*) AS n, count(l.user_id) AS positive, round(avg(mean_value), 6) + 0.0 AS mean_value FROM s JOIN mf USING (user_id) LEFT JOIN l ON l.user_id = s.user_id AND l.segment = s.segment GROUP BY run, subset""",
)
def q33(spark, d):
    """Manifests, segments and subsets are stored one after the other; each is read back by the next."""
    base, r = stages.folder(spark), rec(spark, d)
    fixed = stages.put(manifest(spark, d), f"{base}/manifests", ["run", "subset"])
    cut = stages.put_recordings(assemble.segments(r, S), f"{base}/segments", S.buckets).drop("bucket")
    rows = assemble.assembled(cut, fixed, timeline.episodes(r, S), read(spark, d, "customer").select("c_custkey", "c_acctbal"), S)
    subsets = stages.put(rows, f"{base}/subsets", ["run", "subset"])
    return subsets.groupBy("run", "subset").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("positive"), F.avg("mean_value").alias("mean_value"))


READOUT = np.array([(i * 5 % 7 - 3) / 10 for i in range(64)]).reshape(4, 16)


@query(
    "q34_batch_scores",
    """, i AS (SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-sum(embedding[i + 1]::DOUBLE * ((i * 5 % 7 - 3)::DOUBLE / 10)))), 6) + 0.0 AS score FROM i GROUP BY vec_id""",
)
def q34(spark, d):
    return scoring.score_batches(read(spark, d, "embeddings"), ["vec_id"], "embedding", READOUT.shape, scoring.LinearReadout(READOUT))


CELLS = ", ".join(f"({c}, '{name}', {k})" for c, name in enumerate(S.channels) for k in range(S.slots))


@query(
    "q35_stacked_channels",
    f""", e AS (SELECT user_id, epoch_us(ts) // {W} AS segment, event_type, (epoch_us(ts) % {W}) * {S.slots} // {W} AS slot, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND event_type IN ({", ".join(f"'{c}'" for c in S.channels)})),
k AS (SELECT DISTINCT user_id, segment FROM e), m AS (SELECT user_id, segment, event_type, slot, avg(value) AS value FROM e GROUP BY ALL)
SELECT k.user_id, k.segment, c.channel::INTEGER AS channel, c.slot::INTEGER AS slot, round(value, 6) + 0.0 AS value FROM k, (VALUES {CELLS}) c(channel, name, slot)
LEFT JOIN m ON m.user_id = k.user_id AND m.segment = k.segment AND m.event_type = c.name AND m.slot = c.slot""",
)
def q35(spark, d):
    wf = assemble.stacked(recordings(read(spark, d, "events"), "event_type"), list(S.channels), S.slots, S)
    return wf.select("user_id", "segment", F.posexplode("wf").alias("channel", "row")).select("user_id", "segment", "channel", F.posexplode("row").alias("slot", "value"))


@query(
    "q36_references_on_stored_scores",
    f""", t AS (SELECT el.*, run FROM el JOIN mf USING (user_id) WHERE subset = 'test' AND horizon_h = {S.alarm_horizon_h} AND score IS NOT NULL),
m AS (SELECT run, 'value' AS model, hard, score FROM t UNION ALL SELECT run, 'trend', hard, 1 / (1 + exp(trend)) FROM t UNION ALL SELECT run, 'both', hard, score_b FROM t)
SELECT run, model, round((rs - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q), 6) + 0.0 AS auroc FROM {auroc_sql("m", "run, model")}""",
)
def q36(spark, d):
    """References are scored on the test decisions of every run in a score table that was stored before, whatever made it."""
    held = eligible(spark, d).where("score IS NOT NULL").join(manifest(spark, d).where("subset = 'test'").select("user_id", "run", "subset"), "user_id")
    scores = stages.replace(held.select("run", "subset", "user_id", "t", "horizon_h", "score"), f"{stages.folder(spark)}/scores", ["run", "subset", "horizon_h"])
    return references_auroc(eligible(spark, d).join(scores.select("run", "user_id", "t", "horizon_h"), ["user_id", "t", "horizon_h"]), ["run"])


@query(
    "q37_rank_correlation",
    f""", b AS (SELECT user_id, t - next_onset AS x, round(score, 9) AS y FROM ph WHERE horizon_h = 24 AND score IS NOT NULL AND NOT ongoing AND next_onset - t <= {LONGEST}),
r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2.0::DOUBLE AS y FROM b)
SELECT user_id, count(*) AS n, round(CASE WHEN stddev_pop(x) * stddev_pop(y) > 1e-9 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) + 0.0 AS rank_correlation FROM r GROUP BY user_id""",
)
def q37(spark, d):
    return evaluate.rank_correlation(decisions(spark, d).where("horizon_h = 24"), S)


@query(
    "q43_stored_features",
    f"""{FAMILY_SQL}, j AS (SELECT run, subset, fm.* FROM fm JOIN mf USING (user_id)),
f AS (SELECT run, {", ".join(f"avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}" for c in timeline.FAMILIES)} FROM j WHERE subset = 'train' GROUP BY run)
SELECT run, subset, count(*) AS n, {", ".join(f"round(avg(coalesce(({c} - c_{c}) / CASE WHEN s_{c} > 1e-9 THEN s_{c} END, 0)), 6) + 0.0 AS z_{c}" for c in timeline.FAMILIES)} FROM j JOIN f USING (run) GROUP BY run, subset""",
)
def q43(spark, d):
    """Scaled features are stored by run and subset, the folders of a repeated run are replaced, and all are read back."""
    path = stages.folder(spark)
    rows = stages.put(assemble.scaled(timeline.families(rec(spark, d), S), manifest(spark, d), timeline.FAMILIES), stages.folder(spark), ["run", "subset"])
    stages.replace(rows, path, ["run", "subset"])
    back = stages.replace(rows.where("run = 1"), path, ["run", "subset"])
    return back.groupBy("run", "subset").agg(F.count("*").alias("n"), *(F.avg(f"z_{c}").alias(f"z_{c}") for c in timeline.FAMILIES))


@query(
    "q44_event_annotations",
    f""", {THRESHOLD_SQL}, a AS (SELECT *, alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY run, user_id ORDER BY t), false) AS begins FROM te)
SELECT run, user_id, next_event AS event, any_value(next_onset) AS onset, bool_or(alarm) AS warned, min(CASE WHEN alarm THEN t END) AS alarmed, count(*) AS decisions, sum(alarm::INTEGER)::BIGINT AS in_alarm FROM a WHERE pre_onset GROUP BY run, user_id, next_event""",
)
def q44(spark, d):
    """What became of each test event, stored by run and read back."""
    test = tested(spark, d)[1]
    rows = evaluate.per_event(test, ["run"]).where("event IS NOT NULL")
    back = stages.replace(rows.select("run", "user_id", "event", "onset", "warned", F.col("at").alias("alarmed"), F.col("n").alias("decisions"), "in_alarm"), stages.folder(spark), ["run"])
    return back


@query(
    "q45_segment_tensors",
    f""", e AS (SELECT user_id, epoch_us(ts) // {W} AS segment, event_type, (epoch_us(ts) % {W}) * {S.slots} // {W} AS slot, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND event_type IN ({", ".join(f"'{c}'" for c in S.channels)})),
m AS (SELECT user_id, segment, count(*) AS filled, avg(value) AS wave FROM (SELECT user_id, segment, event_type, slot, avg(value) AS value FROM e GROUP BY ALL) GROUP BY ALL), l AS (SELECT DISTINCT user_id, onset // {W} AS segment FROM ep)
SELECT m.user_id, m.segment, filled, round(wave, 6) + 0.0 AS wave, n, round(mean_value, 6) + 0.0 AS mean_value, (l.user_id IS NOT NULL)::INTEGER AS label FROM m JOIN cl ON cl.user_id = m.user_id AND cl.segment = m.segment AND clean LEFT JOIN l ON l.user_id = m.user_id AND l.segment = m.segment""",
)
def q45(spark, d):
    """Waveforms, features and labels of clean segments, stored in buckets by recording and segment and joined there."""
    r, key = rec(spark, d), ["user_id", "segment"]
    waves = assemble.stacked(recordings(read(spark, d, "events"), "event_type"), list(S.channels), S.slots, S)
    features = assemble.segments(r, S).where("valid").drop("valid")
    parts = [stages.put_bucketed(x, stages.folder(spark), key) for x in (waves, features, assemble.labelled(timeline.episodes(r, S), S))]
    filled = F.filter(F.flatten("wf"), lambda x: x.isNotNull())
    wave = F.aggregate(filled, F.lit(0.0), lambda a, x: a + x) / F.size(filled)
    return assemble.tensors(*parts).select(*key, F.size(filled).cast("bigint").alias("filled"), wave.alias("wave"), "n", "mean_value", "label")


EXACT_SQL = f"""xv AS MATERIALIZED (SELECT run, user_id, t, pre_onset, CASE WHEN pre_onset THEN next_onset END AS event, score, lag(score) OVER (PARTITION BY run, user_id ORDER BY t) AS prev FROM (SELECT user_id, run, t, pre_onset, next_onset, round(score, 9) AS score FROM el JOIN mf USING (user_id) WHERE horizon_h = {S.alarm_horizon_h} AND subset = 'validation')),
xe AS (SELECT run, user_id, event, max(score) AS score FROM xv WHERE pre_onset GROUP BY ALL),
xt AS (SELECT c.run, threshold, (SELECT count(*) FROM xv WHERE xv.run = c.run) AS decisions, (SELECT count(*) FROM xe WHERE xe.run = c.run) AS events, (SELECT count(*) FROM xe WHERE xe.run = c.run AND xe.score >= threshold) AS warned,
  (SELECT count(*) FROM xv WHERE xv.run = c.run AND NOT pre_onset AND xv.score >= threshold AND NOT coalesce(prev >= threshold, false)) AS false_alarms FROM (SELECT DISTINCT run, score AS threshold FROM xv WHERE score IS NOT NULL) c)"""


def validation(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of validation patients, with scores of nine decimals, so that equal ones are equal everywhere."""
    rows = eligible(spark, d).join(manifest(spark, d).where("subset = 'validation'").select("user_id", "run"), "user_id")
    return rows.withColumn("score", F.round("score", 9))


@query("q41_threshold_sweep", f", {EXACT_SQL} SELECT run, round(threshold, 9) + 0.0 AS threshold, decisions, events, warned, false_alarms FROM xt", 9)
def q41(spark, d):
    return evaluate.sweep(validation(spark, d))


@query(
    "q42_exact_threshold",
    f""", {EXACT_SQL}, xf AS (SELECT *, false_alarms::DOUBLE / (decisions::DOUBLE * {S.grid_h}) <= {S.alarm_budget} AS fits FROM xt)
SELECT run, round(threshold, 9) + 0.0 AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fits DESC, CASE WHEN fits THEN coalesce(warned::DOUBLE / nullif(events, 0), 0) ELSE -1 END DESC, threshold DESC) AS k FROM xf) WHERE k = 1""",
    9,
)
def q42(spark, d):
    return evaluate.threshold(validation(spark, d), S, exact=True)


@query(
    "q38_raw_recordings",
    f""", e AS (SELECT user_id, epoch_us(ts) // {W} AS segment, event_type, (epoch_us(ts) % {W}) * {S.slots} // {W} AS slot, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND event_type IN ({", ".join(f"'{c}'" for c in S.channels)})),
k AS (SELECT DISTINCT user_id, segment FROM e), m AS (SELECT user_id, segment, event_type, slot, floor(round(avg(value), 6) * {S.gain}::DOUBLE + 0.5::DOUBLE) / {S.gain}::DOUBLE AS value FROM e GROUP BY ALL)
SELECT k.user_id, c.name AS channel, count(*) AS samples, count(*) - count(value) AS missing, round(avg(value), 6) + 0.0 AS mean FROM k, (VALUES {CELLS}) c(channel, name, slot)
LEFT JOIN m ON m.user_id = k.user_id AND m.segment = k.segment AND m.event_type = c.name AND m.slot = c.slot GROUP BY ALL""",
)
def q38(spark, d):
    """Stacked channels are written as raw recordings, a file for each user, and read back in parallel."""
    wf = assemble.stacked(recordings(read(spark, d, "events"), "event_type"), list(S.channels), S.slots, S)
    names = F.array(*map(F.lit, S.channels))
    rows = wf.select(F.col("user_id").cast("string").alias("recording"), "segment", F.posexplode("wf").alias("at", "values"))
    rows = rows.select("recording", F.get(names, F.col("at")).alias("channel"), "segment", (F.col("segment") * W).alias("start_us"), F.lit(S.slots / S.window_h / 3600).alias("rate"), F.transform("values", lambda v: F.round(v, 6)).alias("values"))
    path = stages.folder(spark)
    raw.write_recordings(rows, path, list(S.channels), S.gain, folders=True)
    back = raw.read_recordings(spark, path, S.window_h * 3600).select(F.col("recording").cast("long").alias("user_id"), "channel", F.explode("values").alias("value"))
    return back.groupBy("user_id", "channel").agg(F.count("*").alias("samples"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"))


SAMPLES = """i AS (SELECT vec_id, unnest(range(64))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS y FROM i)"""


@query(
    "q39_spectra",
    f""", {SAMPLES}, f AS (SELECT vec_id, k, sum(y * cos(2 * pi() * k * i / 64)) AS re, sum(y * sin(2 * pi() * k * i / 64)) AS im FROM c, range(1, 33) t(k) GROUP BY ALL),
p AS (SELECT vec_id, k * {S.sampled_hz}::DOUBLE / 64 AS hz, (re * re + im * im) * CASE WHEN k = 32 THEN 1 ELSE 2 END / 4096 AS p FROM f),
s AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS share, sum(p) OVER (PARTITION BY vec_id ORDER BY hz) / sum(p) OVER (PARTITION BY vec_id) AS reached FROM p)
SELECT vec_id, round(sum(p), 6) + 0.0 AS power, round(coalesce(sum(share) FILTER (hz < {S.bands_hz[0]}), 0), 6) + 0.0 AS low_share, round(coalesce(sum(share) FILTER (hz >= {S.bands_hz[0]} AND hz < {S.bands_hz[1]}), 0), 6) + 0.0 AS mid_share,
  round(coalesce(sum(share) FILTER (hz >= {S.bands_hz[1]}), 0), 6) + 0.0 AS high_share, arg_min(hz, (-round(share, 9), hz)) AS peak_hz, round(sum(share * hz), 6) + 0.0 AS centroid_hz, min(hz) FILTER (reached >= 0.95 - 1e-9) AS edge_hz, round(-sum(share * ln(share)), 6) + 0.0 AS entropy
FROM s GROUP BY vec_id""",
)
def q39(spark, d):
    return waveforms.spectra(read(spark, d, "embeddings"), ["vec_id"], "embedding", 64, S.sampled_hz, S)


REFRACTORY = round(S.refractory_s * S.sampled_hz)


@query(
    "q40_beats",
    f""", {SAMPLES}, p AS (SELECT vec_id, i, x, y > 0 AND x > coalesce(max(x) OVER (w ROWS BETWEEN {REFRACTORY} PRECEDING AND 1 PRECEDING), -1e300) AND x >= coalesce(max(x) OVER (w ROWS BETWEEN 1 FOLLOWING AND {REFRACTORY} FOLLOWING), -1e300) AS peak FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
b AS (SELECT vec_id, i AS a, lead(i) OVER (PARTITION BY vec_id ORDER BY i) AS b, x AS high FROM p WHERE peak),
m AS (SELECT b.vec_id, a, (b - a) / {S.sampled_hz}::DOUBLE AS gap, high, min(x) AS low, avg(x) AS mean FROM b JOIN i ON i.vec_id = b.vec_id AND i >= a AND i < b GROUP BY b.vec_id, a, b, high),
g AS (SELECT *, gap - lag(gap) OVER (PARTITION BY vec_id ORDER BY a) AS step FROM m),
o AS (SELECT vec_id, count(*) AS n_beats, 60 / avg(gap) AS rate_min, avg(gap) AS interval_s, stddev_samp(gap) AS interval_sd_s, sqrt(avg(step * step)) AS interval_rmssd_s, avg(high) AS systolic, avg(low) AS diastolic, avg(high - low) AS pulse, avg(mean) AS map FROM g GROUP BY vec_id)
SELECT e.vec_id, coalesce(n_beats, 0) AS n_beats, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in waveforms.BEATS[1:])} FROM embeddings e LEFT JOIN o ON o.vec_id = e.vec_id""",
)
def q40(spark, d):
    return waveforms.beats(read(spark, d, "embeddings"), ["vec_id"], "embedding", 64, S.sampled_hz, S)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and positive labels per fold and horizon."""
    rows = decisions(spark, d).join(partition.folds(rec(spark, d), S), "user_id")
    return rows.groupBy("fold", "horizon_h").agg(F.count("*").alias("decisions"), F.sum("hard").alias("positive"))
