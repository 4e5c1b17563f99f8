"""Exact best inner products by an impact-ordered index, read score at a time.

Vectors of integers are dealt evenly to blocks. A block's index holds, for each dimension, its vectors' numbers in segments by
quantised component, from the highest down: the postings. A query meets a block in rounds. Each round reads the
segments whose impact (query component times the segment's bound) lies above the round's threshold and below the last
one's, and adds impacts to the accumulators of their vectors. What a vector's unread postings can add is at most the
threshold, or the dimension's highest impact, for each; so every vector has an upper bound. The exact scores of
the vectors with the highest bounds give a score that the wanted number of rows reach, and whoever's bound is below it
is proven out. Reading ends when few possible members are left, or all segments are read; these are scored
exactly by their components. Nothing is left out without that proof.

Blocks and queries are cogrouped in bounded groups: a block with a slab of queries. Blocks' best rows are merged by query.

Vectors null or holding null or non-finite components take no part; shorter vectors count as if zeros followed. Rows that
share the query's id are the query's own. Ties go to the smaller id, null ids last; a query row that repeats another is
answered like it, with rows of its own. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .vectors import integers, matrix

SCALE = 256
#: Vectors of a block and queries of a slab: what meets in one task is bounded by them.
BLOCK, SLAB = 16_384, 4096
#: Bits of a component that its segment leaves out.
COARSE = 3
#: Thresholds of the rounds, as parts of the highest impact; the last round reads the rest.
ROUNDS = (1 / 4, 1 / 16, 0, -1 / 16, -1 / 4)
#: Reading ends when one in so many vectors of a block is left.
FEW = 8

INDEX = "block int, ids array<long>, width int, components binary, postings binary, dims binary, levels binary, starts binary"


class Index:
    """Postings of a block: ``postings[starts[s]:starts[s + 1]]`` are the vectors of segment s, which belongs to
    dimension ``dims[s]`` and to components from ``levels[s] << COARSE`` up. Dimensions ascend, levels descend."""

    def __init__(self, x: np.ndarray, postings: np.ndarray, dims: np.ndarray, levels: np.ndarray, starts: np.ndarray):
        self.x, self.postings, self.dims, self.starts = x, postings, dims, starts
        self.sizes = np.diff(starts)
        self.low, self.high = levels << COARSE, (levels << COARSE) + (1 << COARSE) - 1

    @staticmethod
    def of(x: np.ndarray) -> Index:
        n, width = x.shape
        level = (x >> COARSE).T.copy()
        order = np.argsort(-level, axis=1, kind="stable")
        flat = np.take_along_axis(level, order, 1).ravel()
        dim = np.repeat(np.arange(width), n)
        opens = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (dim[1:] != dim[:-1]))[: len(flat)])
        return Index(x, order.ravel().astype(np.int32), dim[opens], flat[opens], np.append(opens, len(flat)))

    def candidates(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and exact scores of a superset of the k best vectors outside ``own`` (a mask); among the others none
        reaches the k-th best score."""
        n = len(self.x)
        if not len(self.dims):  # vectors without components
            return np.flatnonzero(~own), np.zeros(int((~own).sum()), np.int64)
        impact = q[self.dims] * np.where(q[self.dims] > 0, self.high, self.low)
        first = np.flatnonzero(np.append(True, self.dims[1:] != self.dims[:-1]))
        tops = np.maximum.reduceat(impact, first)
        top, total, count = int(np.abs(tops).max()), np.zeros(n), np.zeros(n)
        floor, above, left = -np.inf, np.inf, ~own
        for part in (*ROUNDS, -np.inf):
            at = np.floor(part * top) if np.isfinite(part) else impact.min()
            if at >= above:
                continue
            read = np.flatnonzero((impact >= at) & (impact < above))
            above = at
            if len(read):
                runs = np.flatnonzero(np.append(True, np.diff(read) != 1))
                ends = np.append(read[runs[1:] - 1], read[-1])
                seen = np.concatenate([self.postings[a:b] for a, b in zip(self.starts[read[runs]], self.starts[ends + 1], strict=True)])
                total += np.bincount(seen, np.repeat(impact[read], self.sizes[read]), n)
                count += np.bincount(seen, minlength=n)
            bound = np.minimum(at, tops).sum() + total - at * count
            bound[own] = -np.inf
            tried = np.argpartition(bound, max(n - 4 * k, 0))[max(n - 4 * k, 0) :]
            tried = tried[~own[tried]]
            if len(tried) >= k:
                floor = max(floor, np.sort(self.x[tried] @ q)[-k])
            left = (bound >= floor) & ~own
            if left.sum() * FEW <= n:
                break
        found = np.flatnonzero(left)
        return found, self.x[found] @ q


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index of the rows of a partition."""
    from pyspark import TaskContext

    held = [b for b in batches if len(b)]
    if held:
        rows = pa.Table.from_batches(held)
        v = rows.column("v").combine_chunks()
        width = int(np.asarray(v.value_lengths()).max())
        index = Index.of(matrix(v, width))
        ids = pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64()))
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (index.x.astype(np.int32), index.postings, index.dims.astype(np.int32), (index.low >> COARSE).astype(np.int32), index.starts.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), ids, pa.array([width], pa.int32()), *parts], names=["block", "ids", "width", "components", "postings", "dims", "levels", "starts"])


def answered(k: int):
    """The task in which a slab of queries meets a block."""

    def run(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(queries) and len(blocks):
            row = blocks.to_pylist()[0]
            x, postings, dims, levels, starts = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("components", "postings", "dims", "levels", "starts"))
            ids = np.array([2**63 - 1 if i is None else i for i in row["ids"]], np.int64)
            known = np.array([i is not None for i in row["ids"]])
            v = queries.column("v").combine_chunks()
            width = max(row["width"], int(np.asarray(v.value_lengths()).max()))
            index = Index(x.reshape(len(ids), row["width"]), postings, dims, levels, starts)
            for place, own, q in zip(queries.column("query").to_pylist(), queries.column("query_id").to_pylist(), matrix(v, width)[:, : row["width"]], strict=True):
                at, score = index.candidates(q, known & (ids == own), k)
                best = np.lexsort((ids[at], ~known[at], -score))[:k]
                out += [(place, own, row["ids"][i], s) for i, s in zip(at[best].tolist(), score[best].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return run


def best(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose vec_id is divisible by ``every``."""
    vectors = integers(embeddings, SCALE)
    rows = vectors.count()
    blocks = max(1, -(-rows // BLOCK))
    index = stored(vectors.repartition(blocks).mapInArrow(build, INDEX))
    asked = stored(vectors.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "v"))
    slabs = max(1, -(-asked.count() // SLAB))
    asked = asked.withColumn("slab", F.pmod(F.xxhash64("query"), F.lit(slabs)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    index = index.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    found = asked.groupBy("block", "slab").cogroup(index.groupBy("block", "slab")).applyInArrow(answered(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(every: int = 50, k: int = 5) -> str:
    """The same for DuckDB, by all products of the queries."""
    return f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM x q JOIN x ON q.vec_id % {every} = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""
