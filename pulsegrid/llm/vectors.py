"""Embeddings as integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components stay below this magnitude, so that sums of products and squares stay exact in 64 bits.
LARGEST = 2**23


def integers(embeddings: DataFrame, scale: int, *also: str) -> DataFrame:
    """vec_id, the columns ``also`` and ``v``: floor(scale * x) of each component x. Rows whose vector is null or holds
    null or non-finite components are left out; a scaled component of ``LARGEST`` or more in magnitude is an error."""
    whole = F.col("embedding").cast("array<double>")
    odd = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.floor(x * float(scale))
    told = F.lit(f"a component times {scale} is {LARGEST} or more in magnitude")
    fits = F.transform(whole, lambda x: F.when(F.abs(x) * scale < LARGEST, scaled(x).cast("int")).otherwise(F.raise_error(told).cast("int")))
    return embeddings.where(whole.isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), *also, fits.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of one array; shorter ones end with zeros."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out
