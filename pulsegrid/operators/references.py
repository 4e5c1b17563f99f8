"""Simple logistic reference models, fitted together on the training patients of each run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import stages
from .timeline import once

ARMS = {"value": ["mean_value"], "trend": ["trend"], "both": ["mean_value", "trend"]}
NAMES = ["mean_value", "trend"]
#: Weight of the squared coefficients (of standardised inputs, without the intercept).
RIDGE = 1e-3
COEFFICIENTS = "run int, model string, intercept double, mean_value double, trend double"


def standardised(rows: DataFrame, train: DataFrame) -> DataFrame:
    """``rows`` with z_<input>: centred and scaled by the training rows of their run, 0 where missing. An input that never
    varies in training, or has no value there, is 0 throughout."""
    n = F.count("*")
    own = {f"c_{c}": F.avg(c) for c in NAMES} | {f"s_{c}": F.sqrt(F.var_pop(c) * F.count(c) / (n - 1)) for c in NAMES}  # missing ones lie at the mean
    fitted = train.groupBy("run").agg(*(v.alias(k) for k, v in own.items()))
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"c_{c}"), F.when(F.col(f"s_{c}") > 1e-9, F.col(f"s_{c}"))), F.lit(0.0))
    return rows.join(F.broadcast(fitted), "run").select(*rows.columns, *(z(c).alias(f"z_{c}") for c in NAMES))  # a row per run


def design(arm: str) -> list[Column]:
    return [F.lit(1.0), *(F.col(f"z_{c}") if c in ARMS[arm] else F.lit(0.0) for c in NAMES)]


def stable(x: Column) -> tuple[Column, Column]:
    """Logistic of x, and ln(1 + exp(x)), without overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small)), F.greatest(x, F.lit(0.0)) + F.log1p(small)


def fit(train: DataFrame, steps: int = 18) -> DataFrame:
    """run, model, intercept and coefficients of all runs and models. ``train`` has run, hard and z_<input>.

    Each Newton step is one aggregation by run, whose sums are the gradients, Hessians and losses of all models; the
    driver solves 3 x 3 equations. A step that doesn't lower a model's loss is halved for it."""
    spark, size = train.sparkSession, 1 + len(NAMES)
    at = [(i, j) for i in range(size) for j in range(i, size)]
    weights: dict[tuple[int, str], np.ndarray] = {}
    last: dict[tuple[int, str], tuple[float, np.ndarray, np.ndarray]] = {}
    runs = sorted(r.run for r in train.select("run").distinct().collect())  # a row per run
    for run in runs:
        weights |= {(run, arm): np.zeros(size) for arm in ARMS}
    for _ in range(steps):
        told = spark.createDataFrame([(run, *(float(w) for arm in ARMS for w in weights[run, arm])) for run in runs], ", ".join(["run int", *(f"{arm}_{i} double" for arm in ARMS for i in range(size))])) if runs else None
        if told is None:
            break
        lines = [sum((F.col(f"{arm}_{i}") * x for i, x in enumerate(design(arm)[1:], 1)), F.col(f"{arm}_0")).alias(f"line_{arm}") for arm in ARMS]
        inputs = ["run", "hard", *(f"z_{c}" for c in NAMES)]
        rows = once(train.join(F.broadcast(told), "run"), inputs, *lines)
        rows = once(rows, [*inputs, *(f"line_{arm}" for arm in ARMS)], *(v.alias(f"{k}_{arm}") for arm in ARMS for k, v in zip(("p", "soft"), stable(F.col(f"line_{arm}")), strict=True)))
        sums, y = [], F.col("hard").cast("double")
        for arm in ARMS:
            x, p = design(arm), F.col(f"p_{arm}")
            sums += [F.avg(F.col(f"soft_{arm}") - y * F.col(f"line_{arm}")), *(F.avg((p - y) * c) for c in x), *(F.avg(p * (1.0 - p) * x[i] * x[j]) for i, j in at)]
        names = [f"{arm}_{k}" for arm in ARMS for k in range(1 + size + len(at))]
        grown = rows.groupBy("run").agg(*(v.alias(f"sum_{k}") for k, v in zip(names, sums, strict=True)))
        moved = 0.0
        for r in grown.collect():  # a row per run
            for arm in ARMS:
                v = np.array([r[f"sum_{arm}_{k}"] for k in range(1 + size + len(at))], float)
                w, ridge = weights[r.run, arm], np.diag([0.0, *[RIDGE] * len(NAMES)])
                loss = v[0] + w @ ridge @ w / 2
                if (r.run, arm) in last and loss > last[r.run, arm][0] + 1e-12:
                    _, before, step = last[r.run, arm]
                    last[r.run, arm] = (last[r.run, arm][0], before, step / 2)
                    weights[r.run, arm] = before - step / 2
                    moved = max(moved, float(np.abs(step).max()))
                    continue
                h = np.zeros((size, size))
                for (i, j), u in zip(at, v[1 + size :], strict=True):
                    h[i, j] = h[j, i] = u
                step = np.linalg.solve(h + ridge + 1e-12 * np.eye(size), v[1 : 1 + size] + ridge @ w)
                last[r.run, arm] = (loss, w, step)
                weights[r.run, arm] = w - step
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:  # the next would be its square
            break
    return spark.createDataFrame([(run, arm, *map(float, w)) for (run, arm), w in weights.items()], COEFFICIENTS)


def scored(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """model, run, user_id, t, hard, score of each row under each model of its run. ``rows`` has z_<input>."""
    told = coefficients.select("run", "model", "intercept", *(F.col(c).alias(f"w_{c}") for c in NAMES))
    line = sum((F.col(f"w_{c}") * F.col(f"z_{c}") for c in NAMES), F.col("intercept"))
    return rows.join(F.broadcast(told), "run").select("model", "run", "user_id", "t", "hard", stable(line)[0].alias("score"))  # a row per run and model


def fitted(decisions: DataFrame, manifest: DataFrame) -> DataFrame:
    """model, run, user_id, t, hard, score on test patients. Every model scores the same eligible decisions; missing
    inputs take the training mean of their run. Decisions and coefficients are stored."""
    spark = decisions.sparkSession
    rows = decisions.select("user_id", "t", "hard", *NAMES).join(manifest.select("user_id", "run", "subset"), "user_id").where("subset <> 'validation'")
    kept = stages.put(rows, stages.folder(spark), ["run", "subset"])
    ready = stages.put(standardised(kept, kept.where("subset = 'train'")).drop(*NAMES), stages.folder(spark), ["run", "subset"])
    found = stages.put(fit(ready.where("subset = 'train'")), stages.folder(spark), ["run"])
    return scored(ready.where("subset = 'test'"), found)
