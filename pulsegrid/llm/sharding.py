"""Consistent hashing with virtual nodes and bounded loads.

A row's key (its doc_id and text) falls on a ring; the ring's arcs belong to virtual nodes of the shards. The ring is
planned in 2 ** CELL_BITS equal stretches, whose bytes and rows are summed before anything is placed.
Cells are walked by magnitude, then in an order that depends on their place alone. Each goes to the shard of its own
arc, or clockwise to the next shard whose bytes stay within (1 + slack) times the mean. A cell that nobody can
take so goes to the shard with fewest bytes, which has the mean at most. So no shard gets more than (1 + slack) times the
mean, or the mean and the largest cell, whichever is greater; and only overflow leaves its home arc.

Nulls count as empty texts (size 1), and a null doc_id is an id of its own. Rows that share a doc_id are parted by their
texts; equal rows fall in the same cell, get a slot each, and are numbered in parts. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: The ring's bits that name a cell: what the driver plans is bounded by 2 ** CELL_BITS rows.
CELL_BITS = 16
#: Parts in which a cell's rows are numbered.
PARTS = 16


def ring(shards: int, virtual: int) -> tuple[list[int], list[int]]:
    """Cells at which arcs end, ascending, and the shard of each."""
    at = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> (64 - CELL_BITS), s, v) for s in range(shards) for v in range(virtual))
    return [c for c, _, _ in at], [s for _, s, _ in at]


def place(cells: dict[int, tuple[int, int]], shards: int, virtual: int, slack: float) -> dict[int, int]:
    """The shard of each cell, given its bytes and rows."""
    ends, owner = ring(shards, virtual)
    total = sum(b for b, _ in cells.values())
    most, load, out = -(-total // shards) * (1 + slack), [0] * shards, {}
    for cell in sorted(cells, key=lambda c: (-cells[c][0].bit_length(), xxhash.xxh64_intdigest(str(c)), c)):
        size, start = cells[cell][0], bisect.bisect_left(ends, cell) % len(ends)
        for k in range(len(ends)):
            shard = owner[(start + k) % len(ends)]
            if load[shard] + size <= most:
                break
        else:
            shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += size
        out[cell] = shard
    return out


def shard(docs: DataFrame, shards: int = 16, virtual: int = 256, slack: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and home_shard of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 64 - CELL_BITS).cast("int").alias("cell"),
            F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"),
        )
    )
    parts = rows.groupBy("cell", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    cells = {r.cell: (r.bytes, r.n) for r in parts.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()}  # at most 2 ** CELL_BITS rows
    ends, owner = ring(shards, virtual)
    base, planned = [0] * shards, []
    for cell, own in sorted(place(cells, shards, virtual, slack).items()):
        planned.append((cell, own, owner[bisect.bisect_left(ends, cell) % len(ends)], base[own]))
        base[own] += cells[cell][1]
    table = spark.createDataFrame(planned, "cell int, shard int, home_shard int, base long")
    before = parts.select("cell", "part", (F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("own", slot.cast("long"))
        .join(before, ["cell", "part"])
        .join(F.broadcast(table), "cell")  # bounded by the number of cells
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("before") + F.col("own")).alias("slot"), "home_shard")
    )
