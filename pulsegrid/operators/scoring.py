"""Fixed-size tensors in Arrow batches, and scoring them with any function of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tensors(column: pa.ListArray, shape: tuple[int, ...]) -> np.ndarray:
    """A batch of lists as one array (n, *shape). All lists must have the shape's size and no nulls in them."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), *shape)


def score_batches(rows: DataFrame, keys: list[str], values: str, shape: tuple[int, ...], model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keys`` and ``score``: ``model`` maps (n, *shape) to n scores, a batch of rows at a time, with no shuffle. Rows
    whose values are null, of another size or hold nulls score null."""
    size = int(np.prod(shape))

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch.column("_fits").to_numpy(zero_copy_only=False)
            scores = np.zeros(len(fits))
            if fits.any():
                scores[fits] = model(tensors(batch.column("_values").filter(pa.array(fits)), shape))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(scores, mask=~fits)], names=[*keys, "score"])

    v = F.col(values)
    ready = rows.select(*keys, v.alias("_values"), F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull()), F.lit(False)).alias("_fits"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return ready.mapInArrow(step, f"{fields}, score double")


class LinearReadout:
    """Logistic score of a weighted sum of all elements."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.tensordot(x, self.weights, axes=self.weights.ndim)))
