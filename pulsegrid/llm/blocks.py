"""Documents in blocks of a few megabytes, and packed messages between blocks and buckets of keys.

What a block has to say about a key is said once, however many of its documents hold the key. So a
key that a third of all documents hold makes one entry per block, not one per document. A block
is shuffled once; later stages of the same plan read the same exchange again.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import width

BLOCK_BYTES = 6 << 20


def count(docs: DataFrame) -> int:
    """Blocks for these documents."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 64)).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES))


def block_of(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int")


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """block, doc_id, text: the rows of a block lie in one partition. Null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(block_of(F.col("doc_id"), blocks).alias("block"), "doc_id", "text").repartition(width(docs.sparkSession), "block")


def ordered(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Texts and ids of a block by ascending doc_id (null first, as the smallest), equal ids by text."""
    ids = rows.column("doc_id").fill_null(-(2**63))
    rows = rows.set_column(rows.schema.get_field_index("doc_id"), "doc_id", ids).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return rows.column("text").combine_chunks(), rows.column("doc_id").to_numpy()


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which the keys of a bucket stand together, and the buckets' bounds in it."""
    own = ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short ones are sorted by digits
    order = np.argsort(own, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=buckets))))


def ascending(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys (integers from 0) in ascending order, equal ones in theirs, and the keys in this order. Where both fit
    in one number, these numbers are sorted, which is several times faster than sorting places by keys."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    return both & ((1 << bits) - 1), (both >> bits).astype(keys.dtype)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, where each is first, and the number of each key among them, as ``np.unique`` has it."""
    order, run = ascending(keys)
    fresh = np.append(True, run[1:] != run[:-1])[: len(run)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return run[fresh], order[fresh], number


def enc(x: np.ndarray) -> bytes:
    """An array as bytes: its bytes by significance, compressed."""
    x = x.astype(np.min_scalar_type(x.max(initial=0))) if x.dtype.kind == "u" else x
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return x.dtype.str.encode().ljust(4) + len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def dec(data: bytes) -> np.ndarray:
    if len(data) == 12:
        return np.zeros(0, data[:4].decode().strip())
    kind, size = np.dtype(data[:4].decode().strip()), int.from_bytes(data[4:12], "little")
    planes = np.frombuffer(pa.decompress(data[12:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def packed(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    """Rows with numpy arrays in them as a table; arrays become binary values."""
    rows = [tuple(enc(x) if isinstance(x, np.ndarray) else x for x in r) for r in rows]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The arrays of a binary column."""
    return [dec(x) for x in column.to_pylist()]


def joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays).astype(kind, copy=False) if arrays else np.zeros(0, kind)
