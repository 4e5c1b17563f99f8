"""What must hold whatever the definitions are."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scores as sc
from pulsegrid.operators import assemble, evaluate, partition, references, scoring, timeline
from pulsegrid.plans import catalog
from pulsegrid.plans.settings import DEFAULT as S
from pulsegrid.plans.settings import HOUR, ORIGIN
from pulsegrid.sources import stages
from pulsegrid.sources.tables import read_manifests, write_manifests

RECORD = "user_id long, event_id long, us long, value double"


def series(spark, *users):
    rows = [(u, 1000 * u + i, ORIGIN + int(h * HOUR), float(v)) for u, points in enumerate(users) for i, (h, v) in enumerate(points)]
    return spark.createDataFrame(rows, RECORD)


@pytest.fixture(scope="module")
def many(spark):
    return series(spark, *([(i * 7, (i * 13 + u * 5) % 90) for i in range(60)] for u in range(30)))


def test_patients_stay_apart(spark, many):
    m = partition.manifests(many, S)
    assert m.groupBy("run", "user_id").agg(F.countDistinct("subset").alias("n")).where("n > 1").count() == 0
    train = {r.user_id: r.n for r in m.where("subset = 'train'").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    assert set(train.values()) == {S.folds - 1}


def test_manifests_survive_writing(spark, many, tmp_path):
    m = partition.manifests(many, S)
    write_manifests(m, str(tmp_path / "m"))
    assert sorted(read_manifests(spark, str(tmp_path / "m")).select(*m.columns).collect()) == sorted(m.collect())


def test_episodes_by_hand(spark):
    found = timeline.episodes(series(spark, [(0, 50), (1, 10), (2, 10), (3, 50), (4, 10), (5, 50), (6, 1), (7, 1), (8, 1)]), S).orderBy("onset").collect()
    assert [(r.event, (r.onset - ORIGIN) // HOUR, (r.end - ORIGIN) // HOUR, r.n) for r in found] == [(1, 1, 2, 2), (2, 6, 8, 3)]


def test_no_future_in_inputs(spark, many):
    cut = ORIGIN + 250 * HOUR
    names = ["user_id", "t", "n", "mean_value", "trend"]
    full = timeline.observed(many, S).where(F.col("t") <= cut).select(*names)
    past = many.where(F.col("us") <= cut)
    part = timeline.observed(past, S).select(*names)  # its grid ends with the last value before the cut
    ends = past.groupBy("user_id").agg(F.max("us").alias("ends"))
    want = full.join(ends, "user_id").where("t <= ends").select(*names)
    assert sorted(map(str, part.collect())) == sorted(map(str, want.collect())) and part.count() > 0
    features = [timeline.families(x, S).where(F.col("t") <= ORIGIN + 240 * HOUR) for x in (many, past)]
    assert sorted(map(str, features[0].collect())) == sorted(map(str, features[1].collect()))


def test_threshold_by_hand(spark):
    """Of 40 decisions 16 are false alarms if they alarm; validation patients alone choose."""
    rows = [(u, u * 100 + k, k >= 5, 1000 + u if k >= 5 else None, 0.8 if k >= 5 else 0.1 * k) for u in range(4) for k in range(10)]
    schema = "user_id long, t long, pre_onset boolean, next_onset long, score double"
    v = spark.createDataFrame(rows, schema).withColumn("run", F.lit(0))
    assert evaluate.threshold(v, S).first().threshold == pytest.approx(0.8)  # all warned, no false alarm up to 0.8
    calm = v.withColumn("score", F.when(F.col("pre_onset"), F.lit(0.33)).otherwise(F.lit(0.0)))
    assert evaluate.threshold(calm, S).first().threshold == pytest.approx(0.3)


def test_threshold_ignores_test_scores(spark):
    """The chosen threshold is the same, however test patients score."""
    data = "/root/testdata/sf0.001"
    rows = catalog.eligible(spark, data).join(catalog.manifest(spark, data).select("user_id", "run", "subset"), "user_id")
    other = rows.withColumn("score", F.when(F.col("subset") == "test", 1.0 - F.col("score")).otherwise(F.col("score")))
    a, b = (sorted(evaluate.threshold(x.where("subset = 'validation'"), S).collect()) for x in (rows, other))
    assert a == b == sorted(catalog.QUERIES["q17_val_threshold"](spark, data).collect()) and a


def test_train_only_statistics(spark, many):
    m, rows = partition.manifests(many, S).where("run = 0"), timeline.observed(many, S)
    held = m.where("subset <> 'train'").select("user_id")
    changed = rows.join(held.withColumn("h", F.lit(1)), "user_id", "left").withColumn("mean_value", F.when(F.col("h") == 1, F.col("mean_value") + 1000).otherwise(F.col("mean_value")))
    a, b = (assemble.scaling(x, m, "mean_value").where("subset = 'train'") for x in (rows, changed))
    assert sorted(a.collect()) == sorted(b.collect())


def test_kl(spark):
    rows = spark.createDataFrame([(0.3, 0.3), (0.0, 0.5), (1.0, 0.5), (0.7, 0.2)], "p double, q double")
    got = [r.k for r in rows.select(sc.bernoulli_kl(F.col("p"), F.col("q"), S.epsilon).alias("k")).collect()]
    assert got == pytest.approx([0.0, math.log(2), math.log(2), 0.7 * math.log(3.5) + 0.3 * math.log(0.3 / 0.8)])


def test_auroc_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, hard int").withColumn("g", F.lit(1))
    assert evaluate.auroc(rows, ["g"], "score", "hard").first().auroc == pytest.approx(3.5 / 4)
    assert evaluate.auroc(rows.where("hard = 1"), ["g"], "score", "hard").first().auroc is None


def test_warnings_by_hand(spark):
    h = HOUR
    rows = [(0, 0, True, 48 * h, 1, True), (0, 16 * h, True, 48 * h, 1, True), (0, 64 * h, False, None, None, True), (1, 0, True, 40 * h, 1, False)]
    got = evaluate.warning_metrics(spark.createDataFrame(rows, "user_id long, t long, pre_onset boolean, next_onset long, next_event long, alarm boolean").withColumn("run", F.lit(0)), ["run"], S).first()
    assert (got.events, got.warned, got.decisions, got.false_alarms) == (2, 1, 4, 0)
    assert got.lead_h == 48 and got.coverage == pytest.approx(2 / 3)


def decided(many):
    return timeline.eligible(timeline.per_horizon(timeline.with_outlook(timeline.observed(many, S), timeline.episodes(many, S)), S).where("horizon_h = 24"), S)


def test_references_fit(spark, many):
    """All models of all runs, on the same decisions, against Newton's method run by run."""
    rows, m = decided(many), partition.manifests(many, S)
    trend = F.when(F.col("t") / (S.grid_h * HOUR) % 5 != 0, F.col("trend"))  # some are missing
    rows = rows.withColumn("trend", trend)
    seen = rows.join(m.select("user_id", "run", "subset"), "user_id").select("run", "user_id", "t", "subset", "mean_value", "trend", "hard").toPandas()
    got = {(r.model, r.run, r.user_id, r.t): r.score for r in references.fitted(rows, m).collect()}
    want = {}
    for run in range(S.folds):
        train, test = (seen[(seen.run == run) & (seen.subset == x)] for x in ("train", "test"))
        centre = {c: train[c].mean() for c in references.NAMES}
        scale = {c: train[c].fillna(centre[c]).std() for c in references.NAMES}
        for arm, columns in references.ARMS.items():
            z = lambda f: np.column_stack([np.ones(len(f)), *((f[c].fillna(centre[c]) - centre[c]) / scale[c] for c in columns)])  # noqa: E731, B023
            x, y, w, ridge = z(train), train.hard.to_numpy(float), np.zeros(len(columns) + 1), np.diag([0.0, *[references.RIDGE] * len(columns)])
            for _ in range(50):
                p = 1 / (1 + np.exp(-x @ w))
                w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + ridge, x.T @ (p - y) / len(y) + ridge @ w)
            want |= {(arm, run, u, t): v for u, t, v in zip(test.user_id, test.t, 1 / (1 + np.exp(-z(test) @ w)), strict=True)}
    assert got == pytest.approx(want, abs=1e-8) and len(got) == 3 * (seen.subset == "test").sum() > 0


def test_references_without_values(spark):
    """An input without any training value counts as 0; labels that one side determines still give finite weights."""
    rows = spark.createDataFrame([(0, i % 2, float(i % 2), None) for i in range(40)], "run int, hard int, mean_value double, trend double")
    ready = references.standardised(rows, rows).cache()
    found = {r.model: r for r in references.fit(ready, steps=40).collect()}
    assert found["trend"].trend == found["both"].trend == 0 and found["value"].mean_value == pytest.approx(found["both"].mean_value)
    assert 1 < found["value"].mean_value < 20 and references.fit(ready.where("run = 9")).count() == 0


def test_sweep_against_loops(spark):
    """Every threshold's metrics, by deciding all alarms anew; scores tie, are missing, and lie at the ends."""
    rng = np.random.default_rng(6)
    rows = [(int(run), int(u), int(t), [None, *np.linspace(0, 1, 9)][rng.integers(0, 10)], bool(t % 7 > 3), int(t // 7)) for run in range(2) for u in range(6) for t in range(40)]
    rows = [(run, u, t, None if x is None else float(x), pre, e if pre else None) for run, u, t, x, pre, e in rows]
    frame = spark.createDataFrame(rows, "run int, user_id long, t long, score double, pre_onset boolean, next_onset long")
    got = {(r.run, r.threshold): tuple(r)[2:] for r in evaluate.sweep(frame).collect()}
    some = {(r.run, r.threshold): tuple(r)[2:] for r in evaluate.sweep(frame, [0.3, 0.5, 2.0]).collect()}
    scores = {(r[0], r[3]) for r in rows if r[3] is not None}
    assert {*got} == scores and {*some} == {(run, x) for run in range(2) for x in (0.3, 0.5, 2.0)}
    for (run, at), seen in {**got, **some}.items():
        own = [r for r in rows if r[0] == run]
        alarm = {(r[1], r[2]): r[3] is not None and r[3] >= at for r in own}
        events = {(r[1], r[5]) for r in own if r[4]}
        warned = {(r[1], r[5]) for r in own if r[4] and alarm[r[1], r[2]]}
        false = sum(alarm[r[1], r[2]] and not alarm.get((r[1], r[2] - 1), False) and not r[4] for r in own)
        assert seen == (len(own), len(events), len(warned), false)


def test_decisions_are_computed_once(spark, monkeypatch, tmp_path):
    """Queries of one session share a stored table of decisions; a changed input makes a new one."""
    import shutil

    shutil.copytree("/root/testdata/sf0.001", tmp_path / "d", ignore=lambda _, names: [n for n in names if n not in ("events.parquet",)])
    calls, real = [], timeline.observed
    monkeypatch.setattr(timeline, "observed", lambda *a: calls.append(1) or real(*a))
    data = str(tmp_path / "d")
    first = [catalog.QUERIES[q](spark, data).collect() for q in ("q06_hard_label", "q13_auroc", "q17_val_threshold", "q18_event_sensitivity", "q23_cluster_bootstrap", "q36_references_on_stored_scores")]
    assert len(calls) == 1 and all(first)
    plan = catalog.QUERIES["q18_event_sensitivity"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan
    (tmp_path / "d" / "events.parquet").chmod(0o644)
    shutil.copy("/root/testdata/sf0.01/events.parquet", tmp_path / "d" / "events.parquet")
    assert len(catalog.QUERIES["q06_hard_label"](spark, data).collect()) > len(first[0]) and len(calls) == 2


def test_a_repeated_run_replaces(spark, tmp_path):
    rows = spark.createDataFrame([(run, s, i) for run in range(3) for s in ("test", "train") for i in range(5)], "run int, subset string, i int")
    path = str(tmp_path / "sink")
    assert stages.replace(rows, path, ["run", "subset"]).count() == 30
    back = stages.replace(rows.where("run = 1 AND i < 2").withColumn("i", F.col("i") + 100), path, ["run", "subset"])
    assert sorted(r.i for r in back.where("run = 1").collect()) == [100, 100, 101, 101] and back.where("run <> 1").count() == 20


def test_bucketed_tables_join_where_they_lie(spark, many):
    """No exchange on any side, a row for each segment, and no entry left in the catalogue."""
    from pulsegrid.operators.assemble import tensors

    cut = assemble.segments(many, S).where("valid").drop("valid")
    waves = cut.select("user_id", "segment", F.array("mean_value").alias("wf"))
    labels = assemble.labelled(timeline.episodes(many, S), S)
    joined = tensors(*(stages.put_bucketed(x, stages.folder(spark), ["user_id", "segment"]) for x in (waves, cut, labels)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan
    rows = joined.collect()
    assert len(rows) == cut.count() == len({(r.user_id, r.segment) for r in rows}) and sum(r.label for r in rows) > 0
    assert all(r.wf == [r.mean_value] for r in rows) and not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_audit_counts_overlap(spark):
    m = spark.createDataFrame([(1, 0, 0, "train"), (1, 0, 0, "test"), (2, 0, 0, "train"), (2, 0, 1, "test")], "user_id long, fold int, run int, subset string")
    assert {(r.run, r.subset): (r.users, r.overlap) for r in partition.audit(m).collect()} == {(0, "train"): (2, 1), (0, "test"): (1, 1), (1, "test"): (1, 0)}


def test_only_clean_segments_are_assembled(spark):
    r = series(spark, [(0, 50), (1, 60)], [(0, 7), (1, 7)], [(0, 900), (1, 10)])
    static = spark.createDataFrame([(0, 1.5)], "c_custkey long, c_acctbal double")
    found = assemble.assembled(assemble.segments(r, S), partition.manifests(r, S), timeline.episodes(r, S), static, S)
    assert {(x.user_id, x.static) for x in found.collect()} == {(0, 1.5)}


def test_bootstrap_places_sparse_ids(spark):
    """Ids far apart, negative or alone give the places of their ranks: relabelled patients change nothing."""
    rows = [(i, 3, i % 3, (i * 7) % 4) for i in range(50)]
    wide = [((i - 25) * 2**55 + i, *rest) for i, *rest in rows]
    schema = "user_id long, events long, warned_a long, warned_b long"
    a, b = (evaluate.paired_bootstrap(spark.createDataFrame(x, schema), S).collect() for x in (rows, wide))
    assert a == b and evaluate.paired_bootstrap(spark.createDataFrame(rows[:1], schema), S).first().delta is not None


def test_stored_stages(spark, many, tmp_path):
    cut = assemble.segments(many, S)
    back = stages.put_recordings(cut, str(tmp_path / "s"), 4)
    assert sorted(back.drop("bucket").collect()) == sorted(cut.collect())
    assert back.groupBy("user_id").agg(F.countDistinct("bucket").alias("n")).where("n > 1").count() == 0


def test_batch_scores(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0])], "k long, v array<double>")
    got = {r.k: r.score for r in scoring.score_batches(rows, ["k"], "v", (2,), scoring.LinearReadout(np.array([1.0, -1.0]))).collect()}
    assert got == {1: pytest.approx(1 / (1 + math.e)), 2: None, 3: None, 4: None, 5: None, 6: 0.5}
    assert scoring.score_batches(rows.where("k > 9"), ["k"], "v", (2,), scoring.LinearReadout(np.ones(2))).count() == 0


def test_resampled_and_cleaned_by_hand(spark):
    r = series(spark, [(0, 50), (16, 60), (17, 70), (90, 5)], [(0, 7), (1, 7)], [(0, 900), (1, 10)])
    got = {(x.user_id, (x.t - ORIGIN) // HOUR): (x.value, x.age_h) for x in timeline.resampled(r, S).collect()}
    assert got[0, 8] == (50, 8) and got[0, 24] == (70, 7) and got[0, 56] == (70, 39) and got[0, 72] == (None, None)  # decisions lie 8 hours after ORIGIN, and every 16
    start = ORIGIN // (S.window_h * HOUR)
    seen = {(x.user_id, x.segment - start): (x.n, x.plausible, x.flat, x.clean) for x in assemble.cleaned(r, S).collect()}
    assert seen[1, 0] == (2, 2, True, False) and seen[2, 0] == (2, 1, False, False)
    assert sum(v[3] for (u, _), v in seen.items() if u == 0) == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], RECORD)
    assert timeline.episodes(none, S).count() == timeline.observed(none, S).count() == partition.manifests(none, S).count() == 0


def test_bootstrap_draws_are_not_held(spark, monkeypatch):
    """Draws by hand; they are dealt to tasks by their number, and no table of (draw, place) is aggregated."""
    import dataclasses
    import hashlib

    n, own = 300, dataclasses.replace(S, draws=20)
    rows = [(u, 1 + u % 3, u % 2, min(1 + u % 3, 1 + u % 2)) for u in range(n)]
    e, a, b = np.array(rows)[:, 1:].T
    monkeypatch.setattr(evaluate, "SLOTS", 1000, raising=False)
    found = evaluate.paired_bootstrap(spark.createDataFrame(rows, "user_id long, events long, warned_a long, warned_b long"), own)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[draw#\w+, place", plan) and "Range (0, 6000, step=1, splits=7)" in plan
    at = [np.array([int(hashlib.md5(f"{d}-{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]) for d in range(own.draws)]
    deltas = [(b[x].sum() - a[x].sum()) / e[x].sum() for x in at]
    assert [found.first()[c] for c in ("lower", "upper")] == pytest.approx(np.quantile(deltas, [0.025, 0.975]).tolist())
