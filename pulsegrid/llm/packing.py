"""Best-fit packing planned over a histogram of lengths.

Texts become token ids with an end id; only those longer than a sequence are cut. The plan never
sees documents: it walks the histogram (at most ``capacity`` rows) from long to short, and places
each length into the open sequences with the least room that suffices. Sequences that are alike
form one group, so the plan is small at any input size. Documents then take the planned slots by
a join on their rank within their length.

Nulls count as empty texts; an empty text is its end id alone; repeated rows get a slot each.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .words import DIGIT_C, LOWER, OTHER_C, classes, flat_ids, owners, pieces, ragged, raw, slices, words

#: Bytes of text that become ids at once; a task's arrays take 17 times that (prose) to 70 times (digits), measured with 2 MB.
SLICE = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class PairMerges:
    """BPE over many words at once: each step applies, in every word that has one, the leftmost pair of lowest rank."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        self.size = size
        keys = np.array([a * size + b for a, b, _ in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]
        self.merged = np.array([c for _, _, c in merges], np.int64)
        low = np.arange(512)
        self.low = self.ranks(np.repeat(low, 512), np.tile(low, 512))  # pairs of single bytes

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def __call__(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as symbols (none empty); returns ids and offsets."""
        n = len(offsets) - 1
        word, sym = owners(offsets), symbols.astype(np.int64)
        rank = np.full(len(sym), self.NONE, np.int32)  # of the pair that starts here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.low[sym[inner] * 512 + sym[inner + 1]] if symbols.max(initial=0) < 512 else self.ranks(sym[inner], sym[inner + 1])
        done_word, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            if (best == self.NONE).any():
                live = np.repeat(best != self.NONE, size)
                done_word.append(word[~live])
                done_sym.append(sym[~live])
                word, sym, rank = word[live], sym[live], rank[live]
                size, best = size[best != self.NONE], best[best != self.NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            word, sym, rank = word[keep], sym[keep], rank[keep]
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(sym))
                ok[ok] = word[left[ok]] == word[left[ok] + 1]
                rank[left[ok]] = self.ranks(sym[left[ok]], sym[left[ok] + 1])
                if left is at:
                    rank[left[~ok]] = self.NONE
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint32), np.searchsorted(word[order], np.arange(n + 1))


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: a byte's own character, or the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The split that ``WordIds`` follows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def checked(spec: dict) -> dict:
    """The file of a tokenizer that ``WordIds`` can follow; any other is a ValueError."""
    model, normal, before = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    split, level = (before.get("pretokenizers") or []) if len(before.get("pretokenizers") or []) == 2 else ({}, {})
    wrong = {
        "a BPE model with an end of word, and without dropout or prefixes": model["type"] != "BPE" or not model.get("end_of_word_suffix") or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")),
        "NFC, white space folded, lower case": [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])] != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)],
        "a split into words": (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) != ("Split", {"Regex": SPLIT}, "Removed", True),
        "bytes as letters": (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) != ("ByteLevel", False, False),
        "no truncation and no padding": bool(spec.get("truncation") or spec.get("padding")),
        "special tokens of two bytes or more": any(len(t["content"].encode()) < 2 for t in spec["added_tokens"]),
    }
    if any(wrong.values()):
        raise ValueError("the tokenizer must have " + "; ".join(k for k, v in wrong.items() if v))
    return spec


class WordIds:
    """Token ids of texts under a BPE tokenizer that lower-cases, drops white space and ends words with a mark.

    Its normalisation, split and merges never look across white space, so a text's ids are its
    words' ids in a row. Words of ASCII characters and Latin letters only are parted where the
    tokenizer parts them (letter runs, single digits, symbol runs), and the distinct parts merged by
    its table, all together; any other word goes through the library.
    """

    def __init__(self, path: str):
        import json

        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        self.library = tokenizers.Tokenizer.from_file(path)
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.merge = PairMerges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], len(vocab))
        stand = byte_letters()
        self.inside, self.last = (np.array([vocab[stand[b] + end] for b in range(256)]) for end in ("", mark))
        self.special = [t["content"].encode() for t in spec["added_tokens"]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's offsets."""
        buf, starts, ends, off = words(texts)
        kind = classes(buf)
        n = len(buf) - 8
        if n == 0:  # only nulls and empty texts
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        odd = kind[:n] == OTHER_C
        for mark in self.special:  # only their first two characters are looked for
            odd[:-1] |= (buf[: n - 1] == mark[0]) & (buf[1:n] == mark[1])
        seen = np.zeros(n + 1, np.int32)
        np.cumsum(odd, out=seen[1:])
        whole = seen[ends] > seen[starts]
        del seen, odd  # the largest arrays
        # parts of the other words
        inside = np.zeros(n + 1, np.int8)
        inside[starts[~whole]] = 1
        inside[ends[~whole]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        opens = np.zeros(n, bool)
        opens[1:] = inside[1:] & ((kind[1:n] != kind[: n - 1]) | (kind[1:n] == DIGIT_C))
        opens[starts] = True
        part = np.flatnonzero(opens)
        to = np.append(part[1:], n)
        word_end = ends[np.searchsorted(starts, part, side="right") - 1]
        to = np.minimum(to, word_end)
        del kind, inside, opens, word_end
        coded = pieces(buf, part, to).dictionary_encode()
        flat, bounds = self._distinct(coded.dictionary)
        at, placed = ragged(np.asarray(coded.indices), bounds)
        return flat[at], placed[np.searchsorted(part, np.append(starts, n)[off])]

    def _distinct(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = raw(values)
        kind = classes(buf)[:-8]
        odd = np.concatenate(([0], np.cumsum((kind == OTHER_C) | (kind != np.repeat(kind[off[:-1]], np.diff(off))))))
        for mark in self.special:
            hit = (buf[:-9] == mark[0]) & (buf[1:-8] == mark[1])
            odd[1:] += np.cumsum(np.append(hit, False)) if len(buf) > 8 else 0
        plain = odd[off[1:]] == odd[off[:-1]]
        low = LOWER[buf[:-8]]
        wide = np.flatnonzero((buf[:-9] == 0xC3) & (buf[1:-8] >= 0x80) & (buf[1:-8] <= 0x9E)) + 1
        low[wide] += 32
        taken = np.repeat(plain, np.diff(off))
        sizes = np.diff(off)[plain]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        symbols = self.inside[low[taken]]
        symbols[bounds[1:] - 1] = self.last[low[taken][bounds[1:] - 1]]
        flat, got = self.merge(symbols, bounds)
        rest = np.flatnonzero(~plain)
        texts = values.take(pa.array(rest)).to_pylist()
        more, also = flat_ids([e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        size = np.zeros(len(plain), np.int64)
        size[plain], size[rest] = np.diff(got), np.diff(also)
        begin = np.zeros(len(plain), np.int64)
        begin[plain], begin[rest] = got[:-1], also[:-1] + len(flat)
        to = np.concatenate(([0], np.cumsum(size)))
        return np.concatenate((flat, more))[np.arange(to[-1]) + np.repeat(begin - to[:-1], size)], to


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def cut_pieces(path: str, end_id: int, capacity: int):
    """The Arrow task that turns texts into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ids = encoder(path)
        for batch in slices(batches, "text", SLICE):
            ids, off = words_ids.ids(batch.column("text"))
            out: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    out.append((doc, k, s, len(part), zlib.crc32(part.tobytes())))
            doc, k, s, n, crc = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, decreasing, over counts. Rows (length, first rank, ranks, first sequence, each, offset):
    a document of that length and rank r takes sequence first + (r - first rank) // each, at
    offset + length * ((r - first rank) % each).

    Best fit would give a sequence with room r, once chosen, further documents of the same length
    while they fit, as no other that suffices has less room; so r // length go in at once.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    fresh = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first = capacity, fresh
                many = -(-left // (capacity // length))
                fresh += many
            each = room // length
            full = min(many, left // each)
            if full:
                slots.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                left, rank, first, many = left - full * each, rank + full * each, first + full, many - full
            if left and many and left < each:
                slots.append((length, rank, left, first, each, capacity - room))
                put(room - left * length, first, 1)
                left, rank, first, many = 0, rank + left, first + 1, many - 1
            put(room, first, many)
    return slots


def ranked(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within each ``key``. A key is dealt to salts, each with its own
    offset, so that a key with most rows still spreads over many tasks."""
    salts = 64
    df = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    base = (
        df.groupBy(key, "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.sum("n").over(Window.partitionBy(key).orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    own = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    return df.withColumn("own", own.cast("long")).join(base, [key, "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("own", "base", "salt")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_pieces(tokenizer, end_id, capacity), PIECES))
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, first_rank long, ranks long, first_sequence long, each long, at long")
    r = F.col("rank") - F.col("first_rank")
    return (
        ranked(found, "length", ["doc_id", "piece"])
        .join(F.broadcast(slots), ["length"])  # its rows are bounded by the capacity, not by the documents
        .where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(r / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.col("length") * (r % F.col("each"))).cast("long").alias("offset"),
        )
    )
