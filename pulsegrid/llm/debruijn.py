"""Removal of repeated passages by a compacted De Bruijn graph of token k-mers.

A window of ``k`` words is an edge of the graph. Edges that can repeat are found first: of every
window, the part of ``part`` words with the least hash is its anchor, equal windows have equal
anchors, and only windows whose anchor occurs at two places go on. Each such edge meets its copies in a
bucket of the hash, where its source is decided: the occurrence with the smallest (doc_id, start).
Neighbouring edges whose sources are neighbours, too, form a path that doesn't branch; it compacts
into a span (document, start, words, source). A span's words are digested at both coordinates,
joined, and only where the digests agree are its words removed. Where they don't, a hash stands for
different windows: all windows of the span's hashes are looked up again, told apart by their words' digests,
and of each all but the smallest coordinate are removed.

Windows are judged on the input. Nulls and texts of fewer than ``k`` words have no windows. Rows
that repeat a doc_id count as documents of their own, ordered by text. A null doc_id sorts first.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as bl
from .shared import BROADCAST_IDS, cut, width
from .words import hashes, owners, windows, words

CLAIM = ["source_doc", "source_copy", "source_start", "n_words", "digest"]
BLANK = b" \t\n\x0b\f\r"
#: Never null, so that joins filter nothing below the exchange that the spans' readers share.
SPANS = ", ".join(f"{c} NOT NULL" for c in ("block int", "doc_id long", "copy int", "start int", "n_words int", "source_doc long", "source_copy int", "source_start int", "digest binary"))


def sliding(best, values: np.ndarray, size: int) -> np.ndarray:
    """The least or greatest of every ``size`` consecutive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


class Block:
    """The words of a block's documents, and its windows by place."""

    def __init__(self, rows: pa.Table, k: int, part: int, bits: int = 64):
        texts, self.ids = bl.ordered(rows)
        self.buf, self.starts, self.ends, self.off = words(texts)
        self.text_off = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))))
        self.word = hashes(self.buf, self.starts, self.ends)
        self.k, self.part, self.unused = k, part, np.uint64(64 - bits)
        doc = owners(self.off)
        n = max(0, len(self.word) - k + 1)
        self.at = np.flatnonzero(doc[:n] == doc[k - 1 :][:n]) if n else np.zeros(0, np.int64)  # windows inside one document
        self.doc = doc
        # documents that share an id are told apart by their place among them
        first = np.searchsorted(self.ids, self.ids, side="left")
        self.copy = (np.arange(len(self.ids)) - first).astype(np.int32)

    def edges(self, at: np.ndarray) -> np.ndarray:
        return windows(self.word, self.k)[at] >> self.unused << self.unused if len(at) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the least hash among its parts; and the hashes of all parts that are the least of some
        window, one for each place."""
        parts, span = windows(self.word, self.part), self.k - self.part + 1
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        least = sliding(np.minimum, parts, span)[self.at]
        around = np.zeros(len(parts) + span - 1, np.uint64)
        around[self.at + span - 1] = least
        return least, parts[sliding(np.maximum, around, span) == parts]

    def digest(self, doc: int, start: int, n: int) -> bytes:
        """Of the words of a document from ``start`` on, joined by one space."""
        a = int(self.off[doc]) + start
        return xxhash.xxh3_128_digest(b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.starts[a : a + n].tolist(), self.ends[a : a + n].tolist(), strict=True)))

    def without(self, i: int, kept: np.ndarray) -> str:
        """The text of document ``i`` with only the ``kept`` words, each with the white space before it; where words are
        missing in between, the longest white space in the gap stays."""
        a, b = int(self.off[i]), int(self.off[i + 1])
        to = int(self.text_off[i + 1])
        out, gap, at = [], b"", int(self.text_off[i])
        data = self.buf
        for k in np.flatnonzero(np.diff(kept[a:b].astype(np.int8), prepend=2)).tolist() + [b - a]:
            # a run of kept or of removed words ends before word a + k
            stop = int(self.starts[a + k]) if a + k < b else to
            if at < stop and k:
                run = data[at:stop].tobytes()
                if kept[a + k - 1]:
                    body = run.rstrip(BLANK)
                    out += [gap, body]
                    gap = run[len(body) :]
                else:
                    gap = max((gap, *re.findall(rb"[ \t-\r]+", run)), key=len)
            elif k == 0:
                gap = data[at:stop].tobytes()
            at = stop
        return b"".join([*out, gap]).decode() if out else ""

    def find(self, doc_id: int, copy: int) -> int:
        i = int(np.searchsorted(self.ids, doc_id)) + copy
        return i if i < len(self.ids) and self.ids[i] == doc_id else -1


def spans_of(block: Block, replies: pa.Table) -> list[tuple]:
    """The compacted paths of a block: runs of edges whose sources run along."""
    place = bl.joined([np.cumsum(x.astype(np.int64)) for x in bl.unpacked(replies.column("places"))], np.int64)
    if not len(place):
        return []
    edge = block.edges(place)
    order = np.argsort(edge, kind="stable")
    edge = edge[order]
    source = [bl.joined(bl.unpacked(replies.column(c)), np.int64) for c in ("docs", "copies", "shifts")]
    source[2] = source[2] + place - block.off[block.doc[place]]
    source = [x[order] for x in source]
    own = block.edges(block.at)
    hit = np.minimum(np.searchsorted(edge, own), len(edge) - 1)
    yes = np.flatnonzero(edge[hit] == own)
    at, hit = block.at[yes], hit[yes]
    doc = block.doc[at]
    start = at - block.off[doc]
    s_doc, s_copy, s_start = (x[hit] for x in source)
    other = (s_doc != block.ids[doc]) | (s_copy != block.copy[doc]) | (s_start != start)  # not the source itself
    doc, start, s_doc, s_copy, s_start = (x[other] for x in (doc, start, s_doc, s_copy, s_start))
    if not len(doc):
        return []
    along = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (s_doc[1:] == s_doc[:-1]) & (s_copy[1:] == s_copy[:-1]) & (s_start[1:] == s_start[:-1] + 1)
    first = np.flatnonzero(np.append(True, ~along))
    size = np.diff(np.append(first, len(doc))) + block.k - 1
    return [
        (int(block.ids[d]), int(block.copy[d]), int(s), int(n), int(sd), int(sc), int(ss), block.digest(int(d), int(s), int(n)))
        for d, s, n, sd, sc, ss in zip(doc[first], start[first], size, s_doc[first], s_copy[first], s_start[first], strict=True)
    ]


def spans(dealt: DataFrame, buckets: int, k: int, part: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The repeated spans of ``dealt`` blocks, each with its source, before they are verified; and the edges that were
    asked about, by bucket and block."""

    def offer(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        values, n = np.unique(Block(rows, k, part).anchors()[1], return_counts=True)
        order, bounds = bl.by_bucket(values, buckets)
        values, n = values[order], np.minimum(n[order], 2).astype(np.uint8)
        return bl.packed(((b, key[0].as_py(), values[x:y], n[x:y]) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x), ["bucket", "block", "keys", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def repeated(rows: pa.Table) -> pa.Table:
        keys = bl.unpacked(rows.column("keys"))
        at = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
        values, inverse = np.unique(bl.joined(keys, np.uint64), return_inverse=True)
        twice = (np.bincount(inverse, bl.joined(bl.unpacked(rows.column("n")), np.uint8), len(values)) >= 2)[inverse]
        return bl.packed(((b, own[twice[x:y]]) for b, own, x, y in zip(rows.column("block").to_pylist(), keys, at[:-1], at[1:], strict=True)), ["block", "keys"], [pa.int32(), pa.binary()])

    def candidates(key: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "block", "edges", "docs", "copies", "bases", "places", "more"], [pa.int32(), pa.int32(), *[pa.binary()] * 6]
        known = np.sort(bl.joined(bl.unpacked(replies.column("keys")), np.uint64))
        if not len(known) or not rows.num_rows:
            return bl.packed((), names, kinds)
        block = Block(rows, k, part, bits)
        anchor = block.anchors()[0]
        at = block.at[known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor]
        edge, first, n = np.unique(block.edges(at), return_index=True, return_counts=True)  # the first in a block by (doc_id, start)
        by_place = np.argsort(first)
        edge, first, n = edge[by_place], at[first[by_place]], n[by_place]
        order, bounds = bl.by_bucket(edge, buckets)
        edge, first, more = edge[order], first[order], (n[order] > 1).astype(np.uint8)
        doc = block.doc[first]
        values = edge, block.ids[doc], block.copy[doc], block.off[doc], first, more
        # places ascend within a bucket, and are sent as their steps
        return bl.packed(((b, key[0].as_py(), *(np.diff(v[x:y], prepend=0).astype(np.uint64) if v is first else v[x:y] for v in values)) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x), names, kinds)

    def sources(rows: pa.Table) -> pa.Table:
        edges = bl.unpacked(rows.column("edges"))
        at = np.concatenate(([0], np.cumsum([len(x) for x in edges])))
        edge = bl.joined(edges, np.uint64)
        doc, copy, base = (bl.joined(bl.unpacked(rows.column(c)), np.int64) for c in ("docs", "copies", "bases"))
        place = bl.joined([np.cumsum(x.astype(np.int64)) for x in bl.unpacked(rows.column("places"))], np.int64)
        start = place - base
        order = np.lexsort((start, copy, doc, edge))
        head = np.append(True, edge[order][1:] != edge[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(head) - 1
        tell = (np.bincount(group)[group] > 1) | (bl.joined(bl.unpacked(rows.column("more")), np.uint8) > 0)
        least = order[head][group]
        out = []
        for b, x, y in zip(rows.column("block").to_pylist(), at[:-1], at[1:], strict=True):
            mine = np.flatnonzero(tell[x:y]) + x
            to = least[mine]
            out.append((b, np.diff(place[mine], prepend=0).astype(np.uint64), doc[to], copy[to], start[to] - start[mine]))
        return bl.packed(out, ["block", "places", "docs", "copies", "shifts"], [pa.int32(), *[pa.binary()] * 4])

    def compacted(key: tuple[pa.Scalar, ...], rows: pa.Table, replies: pa.Table) -> pa.Table:
        found = spans_of(Block(rows, k, part, bits), replies) if rows.num_rows and replies.num_rows else []
        return bl.packed(((key[0].as_py(), *r) for r in found), ["block", "doc_id", "copy", "start", "n_words", *CLAIM[:3], "digest"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    anchors = dealt.groupBy("block").applyInArrow(offer, "bucket int, block int, keys binary, n binary")
    known = anchors.groupBy("bucket").applyInArrow(repeated, "block int, keys binary")
    edges = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(candidates, "bucket int, block int, edges binary, docs binary, copies binary, bases binary, places binary, more binary")
    decided = edges.groupBy("bucket").applyInArrow(sources, "block int, places binary, docs binary, copies binary, shifts binary")
    found = dealt.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(compacted, SPANS)
    return found.repartition(buckets, "block"), edges  # an exchange that all readers of the spans share


def verified(dealt: DataFrame, found: DataFrame, blocks: int, k: int, part: int) -> DataFrame:
    """The claims of spans whose words are those at the source. Each distinct claim on a source is checked once."""

    def check(key: tuple[pa.Scalar, ...], rows: pa.Table, claims: pa.Table) -> pa.Table:
        asked = claims.select(CLAIM).to_pylist()
        block = Block(rows, k, part) if asked and rows.num_rows else None
        good = [c for c in asked if block and (d := block.find(c["source_doc"], c["source_copy"])) >= 0 and block.digest(d, c["source_start"], c["n_words"]) == c["digest"]]
        return pa.table({c: pa.array([g[c] for g in good], claims.schema.field(c).type) for c in CLAIM})

    # one of the owners goes along, so that this reads the columns, and the exchange, that the spans' other readers do
    asked = found.groupBy(CLAIM).agg(F.min(F.struct("block", "doc_id", "copy", "start")).alias("owner")).withColumn("block", bl.block_of(F.nullif(F.col("source_doc"), F.lit(-(2**63))), blocks))
    return dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(check, "source_doc long, source_copy int, source_start int, n_words int, digest binary")


def decided_again(dealt: DataFrame, edges: DataFrame, failed: DataFrame, buckets: int, k: int, part: int, bits: int) -> DataFrame:
    """block, doc_id, copy, start, n_words: the windows with a hash of the ``failed`` spans that repeat by their words."""
    asks, keys = ["bucket", "edges"], ["block", "edges"]

    def unsure(key: tuple[pa.Scalar, ...], rows: pa.Table, own: pa.Table) -> pa.Table:
        if not (rows.num_rows and own.num_rows):
            return bl.packed((), asks, [pa.int32(), pa.binary()])
        block = Block(rows, k, part, bits)
        found = zip(*(own.column(c).to_pylist() for c in ("doc_id", "copy", "start", "n_words")), strict=True)
        at = np.concatenate([np.arange(n - k + 1) + block.off[block.find(doc, copy)] + start for doc, copy, start, n in found])
        edge = np.unique(block.edges(at))
        order, bounds = bl.by_bucket(edge, buckets)
        edge = edge[order]
        return bl.packed(((b, edge[x:y]) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x), asks, [pa.int32(), pa.binary()])

    def holders(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = np.unique(bl.joined(bl.unpacked(asked.column("edges")), np.uint64))
        held = zip(rows.column("block").to_pylist(), bl.unpacked(rows.column("edges")), strict=True) if len(wanted) else ()
        return bl.packed(((b, mine) for b, own in held if len(mine := own[np.isin(own, wanted)])), keys, [pa.int32(), pa.binary()])

    def occurrences(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        out, seen = [], set()
        if rows.num_rows and asked.num_rows:
            block = Block(rows, k, part, bits)
            for at in block.at[np.isin(block.edges(block.at), bl.joined(bl.unpacked(asked.column("edges")), np.uint64))].tolist():
                doc = int(block.doc[at])
                start = at - int(block.off[doc])
                digest = block.digest(doc, start, k)
                out.append((key[0].as_py(), int(block.ids[doc]), int(block.copy[doc]), start, digest, digest not in seen))
                seen.add(digest)
        return bl.packed(out, ["block", "doc_id", "copy", "start", "digest", "first"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()])

    asked = dealt.groupBy("block").cogroup(failed.groupBy("block")).applyInArrow(unsure, "bucket int, edges binary")
    held = edges.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(holders, "block int, edges binary")
    rows = dealt.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(occurrences, "block int, doc_id long, copy int, start int, digest binary, first boolean")
    # what isn't the first in its block needs no comparison, and is spread over tasks
    spread = F.when(F.col("first"), F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id", "copy", "start"))
    order = Window.partitionBy("digest", "first", spread).orderBy("doc_id", "copy", "start")
    return rows.withColumn("rank", F.row_number().over(order)).where("NOT first OR rank > 1").select("block", "doc_id", "copy", "start", F.lit(k).alias("n_words"))


def removed(docs: DataFrame, k: int = 20, part: int = 10, bits: int = 64) -> DataFrame:
    """doc_id, copy, n_words, n_removed, kept_text and kept_sha256 of every document. The digest is of the kept words
    joined by one space; kept_text (null where nothing is removed) has the white space of the text. ``bits`` of an edge's
    hash are used: with fewer, more windows share a hash and are decided twice."""
    blocks, buckets = bl.count(docs), width(docs.sparkSession)
    dealt = bl.dealt(docs, blocks)
    found, edges = spans(dealt, buckets, k, part, bits)
    good = verified(dealt, found, blocks, k, part)
    place = ["block", "doc_id", "copy", "start", "n_words"]
    # not semi and anti joins, which are pushed below the exchange of the spans and have them computed anew
    judged = found.join(good.withColumn("good", F.lit(True)), CLAIM, "left")
    again = decided_again(dealt, edges, judged.where("good IS NULL").select(place), buckets, k, part, bits)
    checked = judged.where("good").select(place).unionByName(again)

    def strike(key: tuple[pa.Scalar, ...], rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return bl.packed((), ["doc_id", "copy", "n_words", "n_removed", "kept_text", "kept_sha256"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()])
        block = Block(rows, k, part)
        gone = np.zeros(len(block.starts) + 1, np.int32)
        doc = np.searchsorted(block.ids, own.column("doc_id").to_numpy()) + own.column("copy").to_numpy()
        begin = block.off[doc] + own.column("start").to_numpy()
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + own.column("n_words").to_numpy(), -1)
        kept = np.cumsum(gone[:-1]) == 0
        out = []
        for i, (a, b) in enumerate(zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)):
            live = np.flatnonzero(kept[a:b]) + a
            text = b" ".join([block.buf[s:e].tobytes() for s, e in zip(block.starts[live].tolist(), block.ends[live].tolist(), strict=True)])
            doc_id = int(block.ids[i])
            out.append((None if doc_id == -(2**63) else doc_id, int(block.copy[i]), b - a, b - a - len(live), None if len(live) == b - a else block.without(i, kept), hashlib.sha256(text).hexdigest()))
        return bl.packed(out, ["doc_id", "copy", "n_words", "n_removed", "kept_text", "kept_sha256"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return dealt.groupBy("block").cogroup(checked.groupBy("block")).applyInArrow(strike, "doc_id long, copy int, n_words long, n_removed long, kept_text string, kept_sha256 string")


def sql(k: int = 20) -> str:
    """What is removed, in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
x AS (SELECT doc_id, i, array_to_string(words[i : i + {k - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {k - 2})) AS i FROM d WHERE len(words) >= {k})),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM x),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range({k}) t(j) WHERE r > 1),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""


def strip(docs: DataFrame, k: int = 20, part: int = 10) -> DataFrame:
    """``docs`` with its columns and rows; texts that lost words keep the white space around the others. Only rows that
    share a doc_id are numbered; of the others, texts are shuffled once to meet what is kept of them."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    again = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    many = again.count()
    own = rows.withColumn("copy", F.lit(0))
    if many:
        again = F.broadcast(again) if many <= BROADCAST_IDS else again
        order = Window.partitionBy("key").orderBy("own_text")
        shared = rows.join(again, "key", "left_semi").withColumn("own_text", F.coalesce(F.col("own.text").cast("string"), F.lit("")))
        own = own.join(again, "key", "left_anti").unionByName(shared.withColumn("copy", F.row_number().over(order) - 1).drop("own_text"))
    gone = removed(docs, k, part).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), "copy", "kept_text")
    joined = own.join(gone, ["key", "copy"], "left")
    fresh = {"text": F.coalesce("kept_text", "own.text"), "n_chars": F.when(F.col("kept_text").isNull(), F.col("own.n_chars")).otherwise(F.char_length("kept_text")).cast("long") if "n_chars" in docs.columns else None}
    return joined.select(*(fresh.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))
