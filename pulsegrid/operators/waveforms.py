"""Measures of waveforms of a fixed size: spectra, beats, and pressures from beats, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settings import Settings
from .scoring import tensors

SPECTRAL = ["power", "low_share", "mid_share", "high_share", "peak_hz", "centroid_hz", "edge_hz", "entropy"]
BEATS = ["n_beats", "rate_min", "interval_s", "interval_sd_s", "interval_rmssd_s", "systolic", "diastolic", "pulse", "map"]


def measured(rows: DataFrame, keys: list[str], values: str, size: int, names: list[str], measure: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """``keys`` and the doubles ``names`` that ``measure`` makes of (n, size) waveforms, without a shuffle; not-a-number
    is null. Rows whose values are null, of another size, or hold nulls or non-finite values have null measures."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column("_fits").to_numpy(zero_copy_only=False)
            out = np.full((len(names), len(fits)), np.nan)
            if fits.any():
                found = measure(tensors(batch.column("_values").filter(pa.array(fits)), (size,)))
                out[:, fits] = [found[n] for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x, mask=np.isnan(x)) for x in out)], names=[*keys, *names])

    v = F.col(values).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ready = rows.select(*keys, v.alias("_values"), F.coalesce((F.size(v) == size) & ~odd, F.lit(False)).alias("_fits"))
    fields = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} double" for n in names)])
    return ready.mapInArrow(step, fields)


def spectrum(x: np.ndarray, rate: float, bands: tuple[float, float]) -> dict[str, np.ndarray]:
    """Power of the centred waveform, its shares below, between and above ``bands``, the strongest frequency (of equals
    the lowest), mean frequency, the frequency below which 95 % of the power lies, and the entropy of the shares."""
    size = x.shape[1]
    z = np.fft.rfft(x - x.mean(1, keepdims=True))[:, 1:]
    twice = np.where(np.arange(1, z.shape[1] + 1) * 2 == size, 1.0, 2.0)  # the last frequency of an even size stands alone
    p, hz = twice * (z.real**2 + z.imag**2) / size**2, np.arange(1, z.shape[1] + 1) * rate / size
    total = p.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(total[:, None] > 1e-12, p / total[:, None], np.nan)
        log = np.where(share > 1e-12, np.log(np.where(share > 1e-12, share, 1.0)), 0.0)
        flat = np.isnan(share[:, :1]).any(1) if share.shape[1] else np.ones(len(x), bool)
        reached = np.cumsum(share, axis=1) >= 0.95 - 1e-9
    at = lambda hit: np.where(flat, np.nan, hz[hit.argmax(1)]) if len(hz) else np.full(len(x), np.nan)
    in_band = lambda b: np.where(flat, np.nan, share[:, b].sum(1))
    return {
        "power": total, "low_share": in_band(hz < bands[0]), "mid_share": in_band((hz >= bands[0]) & (hz < bands[1])), "high_share": in_band(hz >= bands[1]),
        "peak_hz": at(np.round(share, 9) == np.round(share, 9).max(1, keepdims=True, initial=0)), "centroid_hz": (share * hz).sum(1), "edge_hz": at(reached), "entropy": np.where(flat, np.nan, -(share * log).sum(1)),
    }


def peaks(x: np.ndarray, refractory: int) -> np.ndarray:
    """Where a value is above its row's mean, above all of the ``refractory`` values before it, and not below those
    after it: of two peaks less than that apart only the higher stays, of equals the first."""
    hit = x > x.mean(1, keepdims=True)
    for k in range(1, min(refractory, x.shape[1] - 1) + 1):
        hit[:, k:] &= x[:, k:] > x[:, :-k]
        hit[:, :-k] &= x[:, :-k] >= x[:, k:]
    return hit


def squares(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each row the sum of squared differences from its mean, updated value by value (Welford) as ``stddev_samp`` does:
    SDs of gaps, which are whole samples, often lie halfway between two decimals, where the last bit decides. ``v``
    has the rows' values one row after the other, ``size`` their numbers."""
    start = np.cumsum(size) - size
    mean, total = np.zeros(len(size)), np.zeros(len(size))
    for k in range(size.max(initial=0)):
        rows = np.flatnonzero(size > k)
        y = v[start[rows] + k]
        before = mean[rows]
        mean[rows] = before + (y - before) / (k + 1)
        total[rows] += (y - mean[rows]) * (y - before)
    return total


def pulse(x: np.ndarray, rate: float, refractory_s: float) -> dict[str, np.ndarray]:
    """A beat lasts from a peak to the next: systole is its first value, diastole its least. Pressures, and the mean
    of each beat's mean, weigh beats alike. Rows with less than two peaks have no beats, with less than three no SD."""
    n, size = x.shape
    row, at = np.nonzero(peaks(x, max(1, round(refractory_s * rate))))
    whole = np.append(row[1:] == row[:-1], False)[: len(row)]  # another peak of the row follows
    flat, starts = x.ravel(), row * size + at
    low, total = (f.reduceat(flat, starts)[whole] if len(starts) else np.zeros(0) for f in (np.minimum, np.add))
    samples, own = np.diff(starts, append=0)[whole], row[whole]
    gap, high = samples / rate, flat[starts[whole]]
    beats = np.bincount(own, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = lambda v: np.bincount(own, v, n) / beats
        interval = mean(gap)
        sd = np.where(beats > 1, np.sqrt(squares(gap, beats) / (beats - 1)), np.nan)
        next_to = own[1:] == own[:-1]
        step = np.where(beats > 1, np.sqrt(np.bincount(own[1:][next_to], np.diff(gap)[next_to] ** 2, n) / (beats - 1)), np.nan)
        return {"n_beats": beats.astype(float), "rate_min": 60.0 / interval, "interval_s": interval, "interval_sd_s": sd, "interval_rmssd_s": step, "systolic": mean(high), "diastolic": mean(low), "pulse": mean(high - low), "map": mean(total / samples)}


def spectra(rows: DataFrame, keys: list[str], values: str, size: int, rate: float, s: Settings) -> DataFrame:
    """``keys`` and ``SPECTRAL``."""
    return measured(rows, keys, values, size, SPECTRAL, lambda x: spectrum(x, rate, s.bands_hz))


def beats(rows: DataFrame, keys: list[str], values: str, size: int, rate: float, s: Settings) -> DataFrame:
    """``keys`` and ``BEATS``."""
    return measured(rows, keys, values, size, BEATS, lambda x: pulse(x, rate, s.refractory_s)).withColumn("n_beats", F.col("n_beats").cast("long"))


def pressures(segments: DataFrame, channel: str, size: int, rate: float, s: Settings) -> DataFrame:
    """user_id, event_id, us, value: the mean pressure of each segment of ``channel`` that has beats, at the segment's
    end, as a recording that episodes and decisions are made of. ``segments`` has recording (a patient's number), channel,
    segment, start_us, values."""
    own = segments.where(F.col("channel") == channel).select(F.col("recording").cast("long").alias("user_id"), "segment", "start_us", "values")
    found = beats(own, ["user_id", "segment", "start_us"], "values", size, rate, s)
    end = (F.col("start_us") + round(size / rate * 1e6)).cast("long")
    return found.where("user_id IS NOT NULL AND map IS NOT NULL").select("user_id", F.col("segment").alias("event_id"), end.alias("us"), F.col("map").alias("value"))
