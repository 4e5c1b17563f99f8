"""Near-duplicates by MinHash and a multi-index Hamming join.

A document is its set of word shingles. Documents with equal sets form a class, and one node stands for
it. A node's signature has ``bands`` * ``rows`` MinHash values of b = 8 bits each; two signatures
differ in so many of them. Up to a distance of 2 * bands - 1, some band differs in one value at
most (pigeonhole). So a node is put under every band with each one value left out, and any two nodes
within that distance meet under a key; farther ones meet if any band allows. At a similarity of 0.8 a pair
of independent values differs with probability 0.2; with 16 bands of 5, more than 31 of 80 differ with
probability 3.2e-5, and a pair meets under no key with probability 5e-10.

What meets is compared in two rounds, as a group of n copies needs n links, not n * n. First each
node is checked against the key-mate it shares most keys with among the least nodes of its keys; what
this round passes over is left to the next. Then, under every key that still holds different components, all pairs of nodes from different
components are compared: by size, beyond the guaranteed distance by a finer signature, and at last by their full sets. This is done twice, as most
components join at once: first under the keys of a few bands only, and only each node's nearest by the finer signature
goes on to the full sets; then under all keys, with every pair whose components still differ. Keys with many nodes are parted into tiles. Nothing is capped or sampled.

Nulls and texts without words have empty sets and link with nothing. A text with fewer words than a
shingle is one shingle. Rows that share a doc_id are one document. A null doc_id is a node that
comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_IDS, cut, stored, width
from .words import M2, M3, hashes, mix, owners, slices, windows, words

NULL_ID = -(2**63)
TILE = 2048
#: One-bit values of the signature that sifts pairs beyond the guaranteed distance before their full sets are compared.
FINE = 1024
#: Bands whose keys give each node its nearest; what these miss is left to the round over all bands.
NEAR_BANDS = 2
#: Similar pairs that may meet under no key, at most, for a scheme to be taken.
MISSED = 1e-5


@dataclass(frozen=True)
class Scheme:
    words: int = 5
    similarity: int = 80  # of 100
    bands: int = 16
    rows: int = 5

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def distance(self) -> int:
        return 2 * self.bands - 1

    @property
    def fine_distance(self) -> int:
        """Fine values that may differ: (1 - similarity) / 2 of them, and six standard deviations more (lost at 0.8: 8e-9)."""
        p = (100 - self.similarity) / 200
        return int(FINE * p + 6 * (FINE * p * (1 - p)) ** 0.5)

    def __post_init__(self):
        s = self.similarity / 100
        if (1 - s**self.rows - self.rows * (1 - s) * s ** (self.rows - 1)) ** self.bands > MISSED:
            raise ValueError(f"{self.bands} bands of {self.rows} miss too many pairs at similarity {s}")


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and each text's offsets."""
    buf, starts, ends, off = words(texts, lower=True)
    word, doc = hashes(buf, starts, ends), owners(off)
    n = max(0, len(word) - k + 1)
    inside = np.flatnonzero(doc[:n] == doc[k - 1 :][:n]) if n else np.zeros(0, np.int64)
    value, own = windows(word, k)[inside], doc[inside]
    for size in range(1, k):  # short texts: the whole sequence
        short = np.flatnonzero(np.diff(off) == size)
        if len(short):
            value = np.concatenate((value, mix(windows(word, size)[off[short]] + np.uint64(size))))
            own = np.concatenate((own, short))
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))[: len(value)]
    value, own = value[fresh], own[fresh]
    return value, np.searchsorted(own, np.arange(len(off)))


def signatures(value: np.ndarray, off: np.ndarray, size: int, seed: int = 20240229) -> np.ndarray:
    """b-bit MinHash signatures of sets (none empty), one row each."""
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**63, size, np.uint64)
    turns = rng.integers(0, 2**62, size, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(off) - 1, size), np.uint8)
    for j in range(size):
        out[:, j] = mix(np.minimum.reduceat((value ^ keys[j]) * turns[j], off[:-1])) >> np.uint64(56)
    return out


def fine_signatures(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signatures of FINE values of one bit each, packed."""
    return np.packbits(signatures(value, off, FINE, 20240301) & 1, axis=1)


def sketches(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            value, off = shingle_sets(batch.column("text"), scheme.words)
            n = np.diff(off)
            full = np.flatnonzero(n)
            bounds = np.append(off[full], off[-1])
            digest: list[bytes | None] = [None] * len(n)
            signature: list[bytes | None] = [None] * len(n)
            if len(full):
                parts = np.column_stack((np.add.reduceat(mix(value * M3), bounds[:-1]), np.bitwise_xor.reduceat(mix(value + M2), bounds[:-1])))
                for i, d, s in zip(full.tolist(), parts, signatures(value, bounds, scheme.size), strict=True):
                    digest[i], signature[i] = d.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def keyed(nodes: DataFrame, scheme: Scheme, also: list[str], bands: int | None = None) -> DataFrame:
    """key, node and the columns ``also``: each node under each band (or the first ``bands``) with each one value left
    out. A key spells the band, the place left out, and the other values."""
    bands = bands or scheme.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, scheme.bands, scheme.rows)[:, :bands].astype(np.int64)
                keys = np.empty((len(sig), bands, scheme.rows), np.int64)
                for out in range(scheme.rows):
                    key = np.arange(bands)[None, :] * scheme.rows + out
                    for r in range(scheme.rows):
                        key = key if r == out else key << 8 | sig[:, :, r]
                    keys[:, :, out] = key
                back = pa.array(np.repeat(np.arange(len(sig)), bands * scheme.rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(batch.column(c).take(back) for c in ["node", *also])], names=["key", "node", *also])

    return nodes.select("node", "signature", *also).mapInArrow(run, "key long, node long" + "".join(f", {c} long" for c in also))


def close(pairs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the similarity."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("signature").alias(f"s{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, scheme.size) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((sa != sb).sum(axis=1) <= scheme.distance))

    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * scheme.similarity
    return pairs.where(fits).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the documents with these ids. The ids are broadcast only if they are few."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("node"), F.col("text").cast("string").alias("text")).join(ids, "node", "left_semi")


def full_sets(ids: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """node and hashes, the sorted shingles, of these nodes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            value, off = shingle_sets(batch.column("text"), scheme.words)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([value[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["node", "hashes"])

    return stored(texts_of(ids, docs).mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node", "hashes"]))


def similar(x: np.ndarray, y: np.ndarray, scheme: Scheme) -> bool:
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
    return both > 0 and 100 * both >= scheme.similarity * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    pairs = stored(pairs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(*(np.frombuffer(v.as_buffer(), "<u8") for v in xy), scheme) for xy in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    held = full_sets(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"), docs, scheme)
    joined = pairs.join(held.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(held.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def joining(pairs: list[tuple[int, int]], ok) -> list[tuple[int, int]]:
    """Of the pairs those that are ``ok`` and join what wasn't joined before; pairs inside a component aren't asked."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    out = []
    for x, y in pairs:
        a, b = find(x), find(y)
        if a != b and ok(x, y):
            root[a] = b
            out.append((x, y))
    return out


def confirmed_groups(found: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) that join what the similar pairs of the groups join. A node's set goes once to each of its groups,
    not to each pair."""
    found = stored(found)
    members = found.select("gid", F.explode("nodes").alias("node"))
    held = full_sets(members.select("node").distinct(), docs, scheme)
    rows = members.join(held, "node").select(F.col("gid").alias("of"), "node", "hashes")

    def compare(groups: pa.Table, rows: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for n, h in zip(rows.column("node").to_pylist(), rows.column("hashes").to_pylist(), strict=True):
            sets.setdefault(n, []).append(np.frombuffer(h, "<u8"))
        links = []
        for g in groups.to_pylist():
            nodes = g["nodes"]
            ok = lambda x, y, nodes=nodes: any(similar(p, q, scheme) for p in sets[nodes[x]] for q in sets[nodes[y]])
            links += [(nodes[x], nodes[y]) for x, y in joining(list(zip(g["x"], g["y"], strict=True)), ok)]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return found.groupBy("gid").cogroup(rows.groupBy("of")).applyInArrow(compare, "a long, b long").distinct()


def first_pairs(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """For each node, the hub (least node of a key) that it shares most keys with."""
    keys = keyed(nodes, scheme, [])
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = keys.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    return shared.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("b")).select(F.col("node").alias("a"), "b")


def nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's pair with the least distance, the node first."""
    x, y, z = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((far, far))
    order = np.lexsort((y, z, x))
    x, y, z = x[order], y[order], z[order]
    first = np.append(True, x[1:] != x[:-1])[: len(x)]
    return x[first], y[first], z[first]


def sifted(rows: pa.Table, scheme: Scheme, one: bool = False) -> pa.Table:
    """Of rows dealt to groups (key, i, j, m): the pairs of a left and a right row, or of any two where a tile meets
    itself, that differ in component and that sizes and fine signatures allow. A pair that meets
    under several keys counts under the first of them only. Pairs of a group make one row: its nodes, and the
    places of the pairs in them. ``one``: only each node's nearest, as rows; ``far`` is the distance."""
    key, i, j, m, right, node, n, comp = (rows.column(c).to_numpy() for c in ("key", "i", "j", "m", "right", "node", "n", "component"))
    order = np.lexsort((right, m, j, i, key))
    key, i, j, m, right, node, n, comp = (x[order] for x in (key, i, j, m, right, node, n, comp))
    sig, fine = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(len(order), -1)[order] for c in ("signature", "fine"))
    cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (m[1:] != m[:-1])))
    size = np.diff(np.append(cuts, len(key)))
    end = np.repeat(cuts + size, size)
    split = np.repeat(cuts + size - np.add.reduceat(right.astype(np.int64), cuts), size)  # the first right row
    within = ~m & (i == j)
    at = np.flatnonzero(within | ~right)
    first = np.where(within, np.arange(len(key)) + 1, split)[at]
    many = np.maximum(end[at] - first, 0)
    a, b, far, done = [], [], [], np.concatenate(([0], np.cumsum(many)))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + (1 << 17), side="right")) - 1)
        x = np.repeat(at[lo:hi], many[lo:hi])
        y = np.arange(done[hi] - done[lo]) + np.repeat(first[lo:hi] - (done[lo:hi] - done[lo]), many[lo:hi])
        ok = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * scheme.similarity)
        x, y = x[ok], y[ok]
        apart = np.bitwise_count(fine[x] ^ fine[y]).sum(axis=1)
        ok = apart <= scheme.fine_distance
        if not one:  # within the guaranteed distance, only full sets decide
            ok |= (sig[x] != sig[y]).sum(axis=1) <= scheme.distance
        x, y, apart = x[ok], y[ok], apart[ok]
        off = (sig[x] != sig[y]).reshape(-1, scheme.bands, scheme.rows)
        errors = off.sum(axis=2)
        band = np.argmax(errors <= 1, axis=1)
        each = np.arange(len(x))
        place = band * scheme.rows + np.argmax(off[each, band], axis=1)
        ok = key[x] >> (8 * (scheme.rows - 1)) == place
        found = x[ok], y[ok], apart[ok].astype(np.int64)
        for into, v in zip((a, b, far), nearest(node[found[0]], node[found[1]], found[2]) if one else found, strict=True):
            into.append(v)
        lo = hi
    a, b, far = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, far))
    if one:
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "far"), nearest(a, b, far), strict=True)})
    group = np.searchsorted(cuts, a, side="right") - 1
    order = np.argsort(group, kind="stable")
    a, b, group = a[order], b[order], group[order]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    out: dict[str, list] = {"gid": [], "nodes": [], "x": [], "y": []}
    for lo, hi in zip(heads.tolist(), np.append(heads, len(group))[1:].tolist(), strict=True):
        at = a[lo]
        nodes, place = np.unique(np.concatenate((node[a[lo:hi]], node[b[lo:hi]])), return_inverse=True)
        out["gid"].append(f"{key[at]}-{i[at]}-{j[at]}-{m[at]}")
        out["nodes"].append(nodes)
        out["x"].append(place[: hi - lo].astype(np.int32))
        out["y"].append(place[hi - lo :].astype(np.int32))
    kinds = {"gid": pa.string(), "nodes": pa.list_(pa.int64()), "x": pa.list_(pa.int32()), "y": pa.list_(pa.int32())}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})


def mixed_keys(nodes: DataFrame, scheme: Scheme, bands: int | None = None) -> DataFrame:
    """The keys under which nodes of different components stand, with these nodes. ``nodes`` has the component."""
    keys = keyed(nodes, scheme, ["n", "component"], bands)
    mixed = keys.groupBy("key").agg(F.min("component").alias("major"), F.max("component").alias("top"), F.count("*").alias("n_all")).where("major <> top").drop("top")
    return stored(keys.join(mixed, "key").select("key", "node", "n", "component", (F.col("component") != F.col("major")).alias("minor"), F.ceil(F.col("n_all") / TILE).cast("int").alias("tiles")))


def fine(nodes: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The finer signature of these nodes."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            value, off = shingle_sets(batch.column("text"), scheme.words)
            full = np.flatnonzero(np.diff(off))
            if len(full):
                bits = fine_signatures(value, np.append(off[full], off[-1]))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(full)), pa.array([x.tobytes() for x in bits], pa.binary())], names=["node", "fine"])

    return texts_of(nodes, docs).mapInArrow(refine, "node long, fine binary").dropDuplicates(["node"])


def other_pairs(mates: DataFrame, nodes: DataFrame, scheme: Scheme, one: bool) -> DataFrame:
    """Pairs of nodes of different components under one key that sizes and finer signatures allow, as groups (gid, nodes,
    x, y); with ``one`` only each node's nearest, as pairs (a, b). ``nodes`` has the signatures. Under a key, the nodes of its least component
    need no comparison among themselves: they form tiles of their own, and meet only the tiles of the others."""
    mates = mates.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # a minor tile i meets minor tiles j and major tiles j; group (i, j, major or not)
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    own = F.transform(every, lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j"), F.lit(False).alias("m"), (F.col("tile") > j).alias("right")))
    out = F.transform(every, lambda j: F.struct(F.col("tile").alias("i"), j.alias("j"), F.lit(True).alias("m"), F.lit(False).alias("right")))
    meets = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("tile").alias("j"), F.lit(True).alias("m"), F.lit(True).alias("right")))
    dealt = mates.join(nodes, "node").select("key", "node", "n", "component", "signature", "fine", F.explode(F.when(F.col("minor"), F.concat(own, out)).otherwise(meets)).alias("g")).select("*", "g.*").drop("g")

    def compare(rows: pa.Table) -> pa.Table:
        return sifted(rows, scheme, one)

    share = F.pmod(F.xxhash64("key", "i", "j", "m"), F.lit(8 * width(mates.sparkSession))).cast("int")
    found = dealt.withColumn("share", share).groupBy("share").applyInArrow(compare, "a long, b long, far long" if one else "gid string, nodes array<long>, x array<int>, y array<int>")
    return found.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b")) if one else found


def groups(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text)``."""
    rows = cut(sketches(docs, scheme))
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x"))
    classes = cut(classes.select("digest", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), F.col("x.signature").alias("signature")))
    nodes = classes.drop("digest")
    links = confirmed(close(first_pairs(nodes, scheme), nodes, scheme), docs, scheme)
    found = cut(components(links))
    named = lambda: nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = lambda more: components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    def others(one: bool) -> DataFrame:
        mates = mixed_keys(named(), scheme, NEAR_BANDS if one else None)
        known = nodes.select("node", "signature").join(fine(mates.select("node").distinct(), docs, scheme), "node")
        return other_pairs(mates, known, scheme, one)

    near = others(one=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = cut(joined(confirmed(near, docs, scheme)))
    final = joined(confirmed_groups(others(one=False), docs, scheme))
    of_class = classes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").withColumn("component", F.coalesce("component", "doc_id"))
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """One document of each group, with the columns of ``docs``. Of rows equal in doc_id and text, one stays; rows that
    share a doc_id, but not the text, stay or go together."""
    text = F.coalesce(F.col("own.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")).select("own", F.coalesce(F.col("own.doc_id").cast("long"), F.lit(NULL_ID)).alias("node"), F.xxhash64(text).alias("mark"))
    ids = groups(docs, scheme).where("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("node")).distinct()
    rows = rows.join(ids, "node", "left_semi")
    again = cut(rows.groupBy("node", "mark").agg(F.count("*").alias("n")).where("n > 1").select("node", "mark"))
    many = again.count()
    if many:
        again = F.broadcast(again) if many <= BROADCAST_IDS else again
        own = rows.join(again, ["node", "mark"], "left_semi").dropDuplicates(["node", "mark"])
        rows = rows.join(again, ["node", "mark"], "left_anti").unionByName(own)
    return rows.select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns))
