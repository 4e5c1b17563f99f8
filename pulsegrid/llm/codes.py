"""Product codes of vectors: four parts, 256 entries a part, exact integer distances.

Components become integers, and vectors are cut into four equal consecutive parts. Codebooks begin with the parts of the
256 smallest ids. In each round every part goes to its nearest entry, and entries become the floored means of their
parts; the sums are made in Spark, and the driver sees one row for each part and entry.

Which entry is nearest is found from coarse to fine. A part and an entry are cut into blocks of equal size: the squared
distance is the sum over blocks of (difference of block sums)^2 / size, and the squared distance of what is left when block
means are taken away, which is at least the squared difference of the residuals' norms. Blocks of 16, 4 and 2
components rule out entries whose bound is beyond a distance already reached; the others get their exact integer
distance, and ties go to the lower index. Bounds lose ``SLACK`` for their rounding, so that they stay bounds.

Rows whose vector is null or holds null or non-finite components are left out; the longest vector, made a multiple of
four, sets the width, and shorter vectors end with zeros. Repeated ids count each, ordered by their vectors; null ids
come last. With fewer than 256 vectors the codebooks are smaller. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .vectors import integers, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a block, from coarse to fine.
BLOCKS = (16, 4, 2)
#: What a bound loses, of its size and at all.
SLACK = 1e-9


class Sketch:
    """Block sums and residual norms of vectors, as points whose squared distances are lower bounds of theirs."""

    def __init__(self, x: np.ndarray):
        self.x = x
        d = max(x.shape[1], 1)
        square = (x if x.shape[1] else np.zeros((len(x), 1), np.int64)) ** 2
        self.points = []
        for size in BLOCKS:
            if size < d or size == BLOCKS[0]:
                edges = np.arange(0, d, size)
                width = np.minimum(edges + size, d) - edges
                sums = np.add.reduceat(x, edges, axis=1) if x.shape[1] else np.zeros((len(x), 1), np.int64)
                left = (width * np.add.reduceat(square, edges, axis=1) - sums * sums) / width  # of integers, so nothing cancels
                self.points.append(np.column_stack([sums / np.sqrt(width), np.sqrt(left.sum(1))]))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, never above the true ones."""
    p, q = (a * a).sum(1)[:, None], (b * b).sum(1)
    return p + q - 2.0 * (a @ b.T) - SLACK * (p + q + 1.0)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def nearest(x: np.ndarray, book: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest entry (of equals the first), and its squared distance."""
    own, n = Sketch(x), len(x)
    bound = distances(own.points[0], book.points[0])
    best = exact(x, book.x[bound.argmin(1)])
    live = bound <= best[:, None]
    for k in range(1, len(own.points)):
        bound = distances(own.points[k], book.points[k])
        best = np.minimum(best, exact(x, book.x[np.where(live, bound, np.inf).argmin(1)]))
        live &= bound <= best[:, None]
    row, entry = np.nonzero(live)  # by row, then by entry
    reached = exact(x[row], book.x[entry])
    first = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(reached, first)
    hit = np.flatnonzero(reached == least[row])
    hit = hit[np.append(True, row[hit[1:]] != row[hit[:-1]])]
    return entry[hit], least


def assigned(batch: pa.RecordBatch, books: list[Sketch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, its components, entries and distances of a batch."""
    size = books[0].x.shape[1]
    x = matrix(batch.column("v"), PARTS * size)
    for part, book in enumerate(books):
        own = x[:, part * size : (part + 1) * size]
        yield part, own, *nearest(own, book)


def few(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), most):
            yield batch.slice(at, most)


def summed(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """part, entry, n and sums: how many parts have the entry as their nearest, and their componentwise sums. A task adds
    up what it reads before anything is shuffled."""
    size = codebooks[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [*map(Sketch, codebooks)]
        count = np.zeros((PARTS, len(codebooks[0])), np.int64)
        total = np.zeros((*count.shape, size), np.int64)
        for batch in few(batches):
            for part, x, entry, _ in assigned(batch, books):
                count[part] += np.bincount(entry, minlength=len(codebooks[0]))
                np.add.at(total[part], entry, x)
        part, entry = np.nonzero(count)
        sums = pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])

    found = vectors.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(size))).alias("sums"))


def start(vectors: DataFrame, width: int) -> list[np.ndarray]:
    """The codebooks of the smallest ids: ``ENTRIES`` rows at most come to the driver."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    first = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        first[i, : len(r.v)] = r.v
    return np.split(first, PARTS, axis=1)


def improved(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of their parts; entries of none stay."""
    out = [book.copy() for book in codebooks]
    for r in summed(vectors, codebooks).collect():  # a row for each part and entry at most
        out[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def coded(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each of ``vectors(vec_id, label, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [*map(Sketch, codebooks)]
        for batch in few(batches):
            entries, errors = zip(*((e, d) for _, _, e, d in assigned(batch, books)), strict=True)
            code = np.column_stack(entries).astype(np.uint8).tobytes().hex()
            codes = pa.array([code[i : i + 2 * PARTS] for i in range(0, len(code), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(np.sum(errors, axis=0))], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long")


def fit(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    codebooks = start(vectors, width)
    for _ in range(rounds if len(codebooks[0]) else 0):
        codebooks = improved(vectors, codebooks)
    return codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def compressed(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of ``embeddings(vec_id, embedding, label)``."""
    vectors = stored(integers(embeddings, SCALE, "label"))
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    codebooks = fit(vectors, width)
    found = stored(coded(vectors, codebooks)) if len(codebooks[0]) else vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    labels = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    rows = found.join(labels.hint("merge"), F.col("label").eqNullSafe(F.col("own")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def sql() -> str:
    """The same for DuckDB, by exact distances to all entries. Vectors have 64 components there."""
    size = 64 // PARTS
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, part::INTEGER AS part, v[part * {size} + 1 : part * {size} + {size}] AS p FROM k, range({PARTS}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::INTEGER AS entry, p AS e FROM x QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        distance = "list_distance(p::DOUBLE[], e::DOUBLE[])"
        steps.append(f"n{r} AS MATERIALIZED (SELECT vec_id, part, any_value(p) AS p, min(round({distance} ** 2)::BIGINT) AS d, arg_min(entry, (round({distance} ** 2)::BIGINT, entry)) AS entry FROM x JOIN b{r} USING (part) GROUP BY vec_id, part)")
        if r < ROUNDS:
            means = f"(SELECT part, entry, list(m ORDER BY i) AS e FROM (SELECT part, entry, i, floor(sum(p[i])::DOUBLE / count(*))::BIGINT AS m FROM n{r}, range(1, {size + 1}) t(i) GROUP BY ALL) GROUP BY ALL)"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.e, b{r}.e) AS e FROM b{r} LEFT JOIN {means} u USING (part, entry))")
    return f"""WITH {", ".join(steps)}, c AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM n{ROUNDS} GROUP BY vec_id),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN k USING (vec_id) GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h"""
