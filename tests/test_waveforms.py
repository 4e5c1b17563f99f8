"""Raw recordings read in parallel, and measures of waveforms against plain loops."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import timeline, waveforms
from pulsegrid.plans.settings import DEFAULT
from pulsegrid.sources import waveforms as source

RATE, SECONDS = 100.0, 6
S = dataclasses.replace(DEFAULT, bands_hz=(4.0, 15.0), refractory_s=0.3)


def pressure(t, low, high, hz=1.2):
    """A pulse that falls slowly after each sharp peak."""
    phase = (t * hz) % 1.0
    return low + (high - low) * np.exp(-4 * phase) * (phase > 0) + 0.0 * t


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "records")
    t = np.arange(int(RATE * 60)) / RATE
    rows = []
    for r in range(5):
        low = np.where(t < 30, 60.0, 12.0 if r == 2 else 60.0)
        abp, ecg = pressure(t, low, low + 40), np.sin(2 * np.pi * 7 * t) * (r + 1)
        for k in range(10):
            own = slice(int(k * RATE * SECONDS), int((k + 1) * RATE * SECONDS))
            rows.append((str(r), "ABP", k, k * SECONDS * 10**6, RATE, [None if r == 4 and i == 3 else float(v) for i, v in enumerate(abp[own])]))
            if r != 3 or k != 1:
                rows.append((str(r), "ECG", k, k * SECONDS * 10**6, RATE, ecg[own].tolist()))
    source.write_recordings(spark.createDataFrame(rows, source.SCHEMA).repartition(4), path, ["ABP", "ECG"], gain=100)
    return path, rows


def test_recordings_survive(spark, folder):
    """All samples come back to half a step; a missing sample is null, a channel that a segment lacks is nulls."""
    path, rows = folder
    got = {(r.recording, r.channel, r.segment): r for r in source.read_recordings(spark, path, SECONDS).collect()}
    assert len(got) == 100 and {(r.start_us, r.rate) for r in got.values() if r.segment == 2} == {(12_000_000, RATE)}
    for name, channel, k, _, _, values in rows:
        assert got[name, channel, k].values == pytest.approx([v if v is None else math.floor(v * 100 + 0.5) / 100 for v in values])
    assert set(got["3", "ECG", 1].values) == {None}


def test_only_named_files_are_opened(spark, folder):
    """Every other recording's files are broken here, so reading them would end the query."""
    path, _ = folder
    from pathlib import Path

    broken = Path(path).parent / "broken"
    broken.mkdir()
    for f in Path(path).iterdir():
        (broken / f.name).write_bytes(f.read_bytes() if f.name.startswith("1.") else b"not a header")
    one = source.read_recordings(spark, str(broken), SECONDS, recordings=["1"], channels=["ABP"])
    assert one.rdd.getNumPartitions() == 1 and one.count() == 10 and {r.channel for r in one.collect()} == {"ABP"}
    assert source.read_recordings(spark, str(broken), SECONDS, recordings=["1", "none"]).count() == 20
    assert source.read_recordings(spark, str(broken), SECONDS, recordings=["none"]).count() == 0
    with pytest.raises(Exception, match="invalid literal"):
        source.read_recordings(spark, str(broken), SECONDS).count()


def test_filters_stay_apart(spark, folder):
    """Filters of several plans over one read don't touch one another; partitions are recordings."""
    rows = source.read_recordings(spark, folder[0], SECONDS)
    assert rows.rdd.getNumPartitions() == 5
    a, b = (rows.where(F.col("recording") == r) for r in "12")
    assert {r.recording for r in a.union(b).collect()} == {"1", "2"} and a.where("segment > 6").count() == 6 and rows.count() == 100


def test_many_recordings_share_folders_and_partitions(spark, tmp_path, monkeypatch):
    """Partitions don't grow with recordings; renames are the folders'; named recordings and channels are found in folders too."""
    rows = [(str(r), c, k, k * 4 * 10**6, 1.0, [float(r + k), None, 2.0, 1.0][: 4 if k < 2 else 3]) for r in range(60) for k in range(3) for c in ("A", "B")]
    path = str(tmp_path / "many")
    source.write_recordings(spark.createDataFrame(rows, source.SCHEMA), path, ["A", "B"], folders=True)
    assert all(x.is_dir() and x.name.startswith("part-") for x in (tmp_path / "many").iterdir())
    back = source.read_recordings(spark, path, 4)
    assert back.rdd.getNumPartitions() == len([*(tmp_path / "many").iterdir()]) <= 4
    assert sorted(map(str, back.collect())) == sorted(map(str, spark.createDataFrame(rows, source.SCHEMA).collect()))
    one = source.read_recordings(spark, path, 4, recordings=["7"], channels=["B"]).collect()
    assert sorted((r.recording, r.channel, r.segment) for r in one) == [("7", "B", k) for k in range(3)]
    flat = tmp_path / "flat"
    flat.mkdir()
    for f in (tmp_path / "many").glob("part-*/*"):
        (flat / f.name).write_bytes(f.read_bytes())
    monkeypatch.setattr(source, "MOST", 7)
    shares = source.Reader({"path": str(flat)}).partitions()
    assert len(shares) == 7 and len({p for s in shares for p in s.paths}) == 60


def test_headers():
    text = "# a comment\nr7/2 2 125/62.5 5000 10:00:00\nr7.dat 16 200(-3)/mmHg 16 0 0 0 0 ABP mean\nr7.dat 16 50 12 4\n"
    h = source.Header.parsed(text)
    assert (h.record, h.rate, h.samples) == ("r7", 125.0, 5000)
    assert [(s.name, s.gain, s.baseline) for s in h.signals] == [("ABP mean", 200.0, -3), ("1", 50.0, 4)]
    assert source.Header.parsed(h.text()) == h
    with pytest.raises(ValueError, match="format 212"):
        source.Header.parsed("r 1 100 5\nr.dat 212 200\n")


def test_pressures_feed_episodes(spark, folder):
    """Recording 2 falls after half a minute, and that is its one episode; a segment with a missing sample has no beats."""
    path, _ = folder
    values = waveforms.pressures(source.read_recordings(spark, path, SECONDS), "ABP", int(RATE * SECONDS), RATE, S)
    seen = {(r.user_id, r.event_id): (r.us, r.value) for r in values.collect()}
    assert {u for u, _ in seen} == {0, 1, 2, 3}
    found = timeline.episodes(values, dataclasses.replace(S, low=40.0)).collect()
    assert [(r.user_id, r.onset, r.end, r.n) for r in found] == [(2, 36_000_000, 60_000_000, 5)]
    assert seen[0, 0][0] == 6_000_000 and 60 < seen[0, 0][1] < 80


def test_a_wave_by_hand():
    """Two whole beats: 10 4 2 and 8 6 1, between the third peak and what lies around them."""
    x = np.array([[0, 10, 4, 2, 8, 6, 1, 9, 0, 0.0]])
    got = {k: float(v[0]) for k, v in waveforms.pulse(x, 1.0, 1.0).items()}
    assert got["n_beats"] == 2 and got["interval_s"] == 3 and got["rate_min"] == 20 and got["interval_sd_s"] == got["interval_rmssd_s"] == 0
    assert (got["systolic"], got["diastolic"], got["pulse"]) == (9, 1.5, 7.5) and got["map"] == pytest.approx((16 / 3 + 5) / 2)


def slow_peaks(x, r):
    return [i for i in range(len(x)) if x[i] > x.mean() and all(x[j] < x[i] for j in range(max(0, i - r), i)) and all(x[j] <= x[i] for j in range(i + 1, min(len(x), i + r + 1)))]


def test_against_loops():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (20, 64)).round(1), np.sin(np.arange(64) / 3)[None], np.zeros((1, 64)), np.full((1, 64), 7.0)])
    rate, r = 32.0, 3
    got, power = waveforms.pulse(x, rate, r / rate), waveforms.spectrum(x, rate, (4.0, 10.0))
    for i, row in enumerate(x):
        at = slow_peaks(row, r)
        assert np.flatnonzero(waveforms.peaks(row[None], r)[0]).tolist() == at and all(b - a > r for a, b in zip(at, at[1:], strict=False))
        spans = [row[a:b] for a, b in zip(at, at[1:], strict=False)]
        gaps = np.diff(at) / rate
        assert got["n_beats"][i] == len(spans)
        if spans:
            assert got["map"][i] == pytest.approx(np.mean([s.mean() for s in spans])) and got["diastolic"][i] == pytest.approx(np.mean([s.min() for s in spans]))
            assert got["systolic"][i] == pytest.approx(np.mean([s[0] for s in spans])) and got["rate_min"][i] == pytest.approx(60 / gaps.mean())
        if len(spans) > 1:
            assert got["interval_sd_s"][i] == pytest.approx(gaps.std(ddof=1)) and got["interval_rmssd_s"][i] == pytest.approx(np.sqrt((np.diff(gaps) ** 2).mean()))
        assert power["power"][i] == pytest.approx(row.var())
        if row.var() > 0:
            k, n = np.arange(1, 33), np.arange(64)
            p = np.array([((row - row.mean()) * np.exp(-2j * np.pi * f * n / 64)).sum() for f in k])
            p = np.abs(p) ** 2 * np.where(k == 32, 1, 2)
            p, hz = p / p.sum(), k * rate / 64
            assert power["low_share"][i] == pytest.approx(p[hz < 4].sum()) and power["mid_share"][i] == pytest.approx(p[(hz >= 4) & (hz < 10)].sum()) and power["peak_hz"][i] == hz[p.argmax()]
            assert power["centroid_hz"][i] == pytest.approx((p * hz).sum()) and power["edge_hz"][i] == hz[np.searchsorted(np.cumsum(p), 0.95)] and power["entropy"][i] == pytest.approx(-(p * np.log(p)).sum())
        else:
            assert math.isnan(power["low_share"][i]) and got["n_beats"][i] == 0


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [0.0, 5.0, 0.0])], "k long, v array<double>")
    assert {r.k: r.n_beats for r in waveforms.beats(rows, ["k"], "v", 3, 1.0, S).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 0}
    assert waveforms.spectra(rows.where("k = 5"), ["k"], "v", 3, 1.0, S).first().power == pytest.approx(50 / 9)
    assert waveforms.spectra(rows.where(F.lit(False)), ["k"], "v", 3, 1.0, S).count() == 0
