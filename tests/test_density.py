"""One long recording, dense in values and in decisions: the time axis is linear in both."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import timeline
from pulsegrid.plans.settings import DEFAULT as S
from pulsegrid.plans.settings import HOUR, ORIGIN


@pytest.fixture(scope="module")
def dense(spark):
    """144,000 values of one recording, 6,000 a window: as many as 24 minutes at 100 Hz in windows of a minute."""
    gap = S.window_h * HOUR // 6000
    value = 60 + 50 * F.sin(F.col("id") / 500) + F.pmod(F.col("id") * 7919, F.lit(13))
    return spark.range(144_000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), (ORIGIN + F.col("id") * gap + 1).alias("us"), value.alias("value")).cache()


def windows(dense):
    """t and its window's values, by numpy."""
    rows = dense.orderBy("us").toPandas()
    us, v = rows.us.to_numpy(), rows.value.to_numpy()
    step, span = S.grid_h * HOUR, S.window_h * HOUR
    for t in range(-(-us[0] // step) * step, us[-1] + 1, step):
        yield t, v[np.searchsorted(us, t - span, side="right") : np.searchsorted(us, t, side="right")]


def test_dense_values(spark, dense):
    want, began = dict(windows(dense)), time.time()
    seen = {r.t: r for r in timeline.observed(dense, S).collect()}
    last = {r.t: r.value for r in timeline.resampled(dense, S).collect()}
    own = {r.t: r for r in timeline.features(dense, S).collect()}
    more = {r.t: r for r in timeline.families(dense, S).collect()}
    assert time.time() - began < 60
    assert {*seen} == {*last} == {*own} == {*more} == {*want} and len(want) == 72
    for t, v in want.items():
        assert seen[t].n == own[t].n == len(v) and last[t] == v[-1]
        assert [seen[t].mean_value, own[t].median, own[t].sd, more[t].q25, more[t].mean_step] == pytest.approx([v.mean(), np.median(v), v.std(), np.quantile(v, 0.25), np.abs(np.diff(v)).mean()])


def test_dense_decisions(spark):
    """32,000 decisions of one recording and 1,000 episodes."""
    step = S.grid_h * HOUR
    decisions = spark.range(32_000).select(F.lit(1).cast("long").alias("user_id"), (F.col("id") * step).alias("t"))
    found = spark.range(1000).select(F.lit(1).cast("long").alias("user_id"), (F.col("id") + 1).alias("event"), (F.col("id") * 32 * step + 7).alias("onset"), (F.col("id") * 32 * step + 3 * step).alias("end"), F.lit(2).alias("n"))
    began = time.time()
    rows = {r.t // step: r for r in timeline.with_outlook(decisions, found).collect()}
    assert time.time() - began < 20 and len(rows) == 32_000
    for k, r in rows.items():
        ahead = -(-k // 32) if k % 32 else k // 32  # the episode of this stretch begins after its first decision
        assert r.next_onset == (ahead * 32 * step + 7 if ahead < 1000 else None) and r.ongoing == (1 <= k % 32 <= 3)
        assert r.next_event == (ahead + 1 if ahead < 1000 else None)
