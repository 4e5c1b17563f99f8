"""Two tokenizers aligned: which of their tokens stand for the same bytes, and which pairs of ids the corpus prefers.

The space and text of a document are tokenized by a byte-level BPE (A) and by a sentencepiece BPE (B). Byte offsets at
which tokens of both end cut them into groups, and all A and B tokens of a group are linked. Every document then sends
its distinct id pairs with their multiplicities, as postings. Two sorted streams meet: postings, and the counts of
documents for each pair with the maximum for each A id; contributions to a document are added by document.

Both streams are Spark's: counts are summed before they are shuffled, the A ids' maxima come from the counts alone (an A
id has at most as many as B's vocabulary), and the streams are merged by a sort-merge join, which spills. A pair that
holds at least 1 / ``SHARES`` of all postings is hot: there are ``SHARES`` of those at most, so they are broadcast, and
their postings are never shuffled.

Null and empty texts, and texts whose tokens don't spell space and text (such as those with U+2581), have no tokens:
zeros and an empty digest. Each row is a document of its own, whatever its doc_id; repeated rows count each. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import byte_letters
from .shared import stored
from .words import owners, pieces, ragged, raw, slices

#: Pairs that make up a larger part of all postings than one of so many are hot.
SHARES = 4096
#: Links of a group beyond which its distinct pairs are counted, not listed.
LARGE = 4096
#: Bytes of text that a task aligns at once (one document at least); its arrays take some hundred times as much.
SLICE = 2 << 20
#: How byte-level BPE parts texts before it merges: a fixed value of A's format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>"


def stretches(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where to cut texts (each begins with a space) so that both tokenizers do the same in parts as in one: before a
    space that follows a visible ASCII character, or one that stands between another character and a visible ASCII one.

    A never joins what comes before such a space to it, as its splitting pattern leaves a run of white space only after
    its last character; B has no piece with a space after another character.
    """
    n = len(buf) - 8
    seen = (buf[:n] > 0x20) & (buf[:n] < 0x7F)
    cut = np.zeros(n, bool)
    if n > 1:
        after = np.append(seen[1:], False)
        cut[1:] = (buf[1:n] == 0x20) & (seen[:-1] | ((buf[: n - 1] >= 0x80) & after[1:]))
    cut[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(cut)


def letters(path: str) -> tuple[list[bytes], bool]:
    """The bytes of each id of a byte-level BPE vocabulary, and whether its ids are the ranks of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    own = {c: b for b, c in byte_letters().items()}
    out = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        if all(c in own for c in token):  # an added token may be none of these
            out[i] = bytes(own[c] for c in token)
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    return out, all(a < b for a, b in pairwise(made))


def spelt(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    names = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]


def flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and offsets."""
    off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))))
    return np.fromiter(chain.from_iterable(each), np.int64, int(off[-1])), off


@dataclass
class Aligned:
    """Of some stretches of text: counts of each, whether its tokens spell it, its groups as text, and its linked pairs
    (``pair`` and ``times`` from ``bounds`` to ``bounds``, a pair perhaps in several entries)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    spelt: np.ndarray
    shown: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    bounds: np.ndarray


class Aligner:
    """Both tokenizers, and the alignment of many stretches at once. Every stretch begins with a space."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        self.a_bytes, ranked = letters(a_path)
        if not ranked:
            raise ValueError("the ids of A's vocabulary are not in the order of its merges")
        own = {t: i for i, t in enumerate(self.a_bytes) if t}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=own, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = spelt(self.b)
        late = [p for p in map(self.b.id_to_piece, range(self.b.get_piece_size())) if "▁" in p.lstrip("▁")]
        if late:
            raise ValueError(f"pieces with a space after another character, such as {late[0]!r}: texts can't be cut at spaces")
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        # each id as text, with the sign after it: inside a group, and at the end of its part of one
        self.a_shown, self.b_shown = (np.array([[f"{i}{end}" for i in range(len(x))] for end in ends], object) for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))

    def tokens(self, values: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and offsets under A and under B."""
        y = self.b.encode([s[1:] for s in values], num_threads=1)  # B puts the first space itself, unless nothing follows it
        for i in [i for i, s in enumerate(values) if len(s) == 1]:
            y[i] = [self.blank]
        return [flat([*map(self.a.encode_ordinary, values)]), flat(y)]

    def __call__(self, values: list[str], sizes: np.ndarray) -> Aligned:
        """``sizes``: bytes of each value."""
        n, (a, b) = len(values), self.tokens(values)
        fits = np.ones(n, bool)
        for (ids, off), size, names in ((a, self.a_size, self.a_bytes), (b, self.b_size, self.b_bytes)):
            reach = np.concatenate(([0], np.cumsum(size[ids])))
            fits &= np.diff(reach[off]) == sizes
            if not fits.all() or b"".join(map(names.__getitem__, ids.tolist())) != "".join(values).encode():
                fits &= [b"".join(map(names.__getitem__, ids[s:e].tolist())) == v.encode() for v, s, e in zip(values, off[:-1], off[1:], strict=True)]
        if not fits.all():  # without the tokens of stretches that are not spelt
            a, b = ((ids[np.repeat(fits, np.diff(off))], np.concatenate(([0], np.cumsum(np.diff(off) * fits)))) for ids, off in (a, b))
        (x, off_a), (y, off_b) = a, b
        to_a, to_b = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        ends = np.zeros((2, int(to_a[-1]) + 1 if len(x) else 1), bool)
        ends[0, to_a], ends[1, to_b] = True, True
        last_a, last_b = ends[1, to_a], ends[0, to_b]  # tokens that end a group
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        many = int(last_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        first_b, past_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        of_a = owners(off_a)
        of_group = of_a[last_a]
        # groups as text: the tokens of A and then of B, group by group
        order = np.empty(len(x) + len(y), object)
        order[np.arange(len(x)) + first_b[group_a]] = self.a_shown[last_a.astype(int), x]
        order[np.arange(len(y)) + past_a[group_b]] = self.b_shown[last_b.astype(int), y]
        order, at = order.tolist(), (off_a + off_b).tolist()
        shown = np.array(["".join(order[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], object)
        # links: all pairs of a small group, the distinct ones of a large group
        large = size_a * size_b > LARGE
        own = np.flatnonzero(~large[group_a])
        into, to = ragged(group_a[own], np.concatenate(([0], np.cumsum(size_b))))
        pair, of = (np.repeat(x[own], np.diff(to)) << 32) + y[into], np.repeat(of_a[own], np.diff(to))
        times = np.ones(len(pair), np.int64)
        for g in np.flatnonzero(large):
            (p, s), (q, t) = np.unique(x[group_a == g], return_counts=True), np.unique(y[group_b == g], return_counts=True)
            pair, times = np.append(pair, ((p << 32)[:, None] + q).ravel()), np.append(times, np.outer(s, t).ravel())
            of = np.append(of, np.full(len(p) * len(q), of_group[g]))
        if large.any():
            by = np.argsort(of, kind="stable")
            pair, times, of = pair[by], times[by], of[by]
        links = np.bincount(of_group, size_a * size_b, n).astype(np.int64)
        return Aligned(np.diff(off_a), np.diff(off_b), np.bincount(of_group, minlength=n), links, fits, shown, pair, times, np.searchsorted(of, np.arange(n + 1)))


_aligners: dict[tuple[str, str], Aligner] = {}


def postings_of(a_path: str, b_path: str):
    """The Arrow task that tokenizes and groups documents. Texts begin with a space, or are null. The distinct stretches
    of a few megabytes of text are aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        align = _aligners[a_path, b_path]
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text")
            docs = len(texts)
            buf, off = raw(texts)
            starts = stretches(buf, off)
            coded = pieces(buf, starts, np.append(starts[1:], len(buf) - 8)).dictionary_encode()
            which, bounds = np.asarray(coded.indices).astype(np.int64), np.searchsorted(starts, off)
            found = align(coded.dictionary.to_pylist(), np.asarray(pc.binary_length(coded.dictionary)).astype(np.int64))
            doc = owners(bounds)
            fits = np.bincount(doc, ~found.spelt[which], docs) == 0
            total = lambda x: pa.array(np.where(fits, np.bincount(doc, x[which], docs), 0).astype(np.int64))  # noqa: E731, B023
            # each document's distinct stretches, then their pairs, added up
            one, often = np.unique(doc * max(len(found.spelt), 1) + which, return_counts=True)
            one_doc, one_which = np.divmod(one, max(len(found.spelt), 1))
            names, number = np.unique(found.pair, return_inverse=True)
            at, to = ragged(one_which, found.bounds)
            own = owners(to)
            key, place = np.unique(one_doc[own] * max(len(names), 1) + number[at], return_inverse=True)
            times = np.bincount(place, found.times[at] * often[own], len(key)).astype(np.int64)
            key_doc, key_pair = np.divmod(key, max(len(names), 1))
            keep = fits[key_doc]
            key_doc, key_pair, times = key_doc[keep], key_pair[keep], times[keep]
            shown, at = found.shown[which].tolist(), bounds.tolist()
            digests = [hashlib.sha256("".join(shown[s:e])[:-1].encode()).hexdigest() if ok and e > s else "" for s, e, ok in zip(at[:-1], at[1:], fits.tolist(), strict=True)]
            ends = pa.array(np.searchsorted(key_doc, np.arange(docs + 1)).astype(np.int32))
            links = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(names[key_pair]), pa.array(times)], names=["pair", "times"]))
            columns = [batch.column("doc_id"), *map(total, (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(digests, pa.string()), links]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return run


def documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``: its counts, the digest of its groups, and its links as pairs (A id in
    the upper 32 bits, B id in the lower) with multiplicities."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).alias("text"))
    return rows.mapInArrow(postings_of(a_path, b_path), SCHEMA)


def counted(postings: DataFrame) -> DataFrame:
    """pair, n, best: how many documents hold the pair, and whether no other pair of its A id is held by more."""
    n = postings.groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", 32))
    return n.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    found = stored(documents(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    postings = found.select("row", F.inline("links"))
    counts = stored(counted(postings))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * SHARES > total
    often = counts.where(hot)  # fewer than SHARES rows, as each has more than a part of SHARES of the total
    near = postings.join(F.broadcast(often), "pair")
    far = postings.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(counts.where(~hot).hint("merge"), "pair")
    times = F.col("times")
    given = [r.select("row", (times * F.col("n")).alias("s"), F.when(F.col("best"), times).otherwise(F.lit(0)).alias("b")) for r in (near, far)]
    sums = given[0].unionByName(given[1]).groupBy("row").agg(F.sum("s").alias("count_sum"), F.sum("b").alias("n_best"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
