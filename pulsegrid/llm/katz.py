"""A Katz backoff model of word n-grams with Good-Turing discounts, learnt and applied by Spark.

    P(w | h) = d[c] * c(h, w) / c(h)   where the n-gram was seen,   a(h) * P(w | h')   else

h' is h without its first word; where h itself was never seen, a(h) is 1. At the end of the recursion,
P(w) = d[c] * c(w) / N, and any new word takes what is left of 1. Counts up to five are discounted by
Good-Turing estimates, an order at a time. a(h) makes every history's probabilities sum to 1 exactly, a
new word among them. A history whose counts are all above five has nothing discounted; it counts one more
occurrence, which goes to what follows it unseen. A text starts from a history of start marks, and
ends with an end token.

Tokens are 64-bit hashes of words. Texts become blocks of codes, one Arrow slice each, in a table bucketed by
block; what a block has to say to a bucket of n-grams is one packed message, in which each n-gram occurs once. Buckets
count, order after order, and leave the model as tables, partitioned by order: ``grams(h1, ..., word, n)``,
one row for each n-gram seen in training. The number of buckets grows with the texts. A
history with more than HOT occurrences is parted among buckets by the words that follow it, and its totals are added
up afterwards.

Nulls count as empty texts, which are one end token. Rows that share a doc_id each get a row. Without
training rows every token is new, and all probabilities are 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ascending, by_bucket, dec, distinct, enc
from .shared import bucketed, discard, place, stored, text_bytes, width
from .words import M1, M2, M3, hashes, mix, slices, words

END = M1
START = np.uint64(2**62)
TOP = 5
#: Occurrences in training of a history that one bucket takes whole.
HOT = 500_000
#: Bytes of text to a bucket of n-grams, and to a bucket of the table of blocks.
BUCKET_BYTES, BLOCK_BYTES = 4 << 20, 6 << 20
CODES, ASKED, ANSWERED, GRAMS, TOLD, PARTS, ASKERS, ADDED = range(8)
NULL_ID = -(2**63)


#: The arrays of a message: those of the words', of those that ask, and of the answers. The answers are stored with the
#: n-grams, each of whose rows pays for a column that it leaves null.
CODED, ASKING, TELLING = "abcd", "abcdef", "abc"


def schema(order: int, arrays: str) -> str:
    flat = "".join(f", h{i} long" for i in range(1, order))
    return f"kind int, bucket int, block long{flat}, word long, n long" + "".join(f", {c} binary" for c in arrays)


def wide(data: bytes) -> np.ndarray:
    return dec(data).astype(np.uint64)


def table_of(order: int, arrays: str, rows: list[tuple], flat: dict[str, np.ndarray] | None = None, bucket: int = -1, parts: list[tuple] = ()) -> pa.Table:
    """Packed messages (kind, bucket, block, arrays ...), rows of n-grams as columns, and parted histories
    (words, totals, blocks), as one table. A parted history has a row for each total, whose place is its word, and one
    for each block that asked."""
    heads = [f"h{i}" for i in range(1, order)]
    names = ["kind", "bucket", "block", *heads, "word", "n", *arrays]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * (len(heads) + 3), *[pa.binary()] * len(arrays)]
    own = pa.schema(list(zip(names, kinds, strict=True)))
    out = []
    if rows:
        columns: dict[str, list] = {n: [None] * len(rows) for n in names}
        for i, r in enumerate(rows):
            columns["kind"][i], columns["bucket"][i], columns["block"][i] = r[:3]
            for c, x in zip(arrays, r[3:], strict=False):
                columns[c][i] = enc(x)
        out.append(pa.table([pa.array(columns[n], k) for n, k in zip(names, kinds, strict=True)], schema=own))
    found = [(GRAMS, flat)] if flat is not None else []
    if parts:
        words_of = np.array([w for w, _, _ in parts], np.int64)
        for kind, name, of in ((PARTS, "n", 1), (ASKERS, "block", 2)):
            size = [len(p[of]) for p in parts]
            found.append((kind, {h: np.repeat(words_of[:, i], size) for i, h in enumerate(heads)} | {"word": np.concatenate([np.arange(x) for x in size]), name: np.concatenate([p[of] for p in parts])}))
    for kind, columns in found:
        size = len(columns["word"])
        fixed = {"kind": np.full(size, kind, np.int32), "bucket": np.full(size, bucket, np.int32)} | {n: x.astype(np.int64) for n, x in columns.items()}
        out.append(pa.table([pa.array(fixed[n], k) if n in fixed else pa.nulls(size, k) for n, k in zip(names, kinds, strict=True)], schema=own))
    # short batches, so that no task of Spark holds a bucket's rows at once
    return pa.Table.from_batches([b for x in out for b in x.to_batches(max_chunksize=1 << 15)], own)


def block_rows(ids: np.ndarray, held: np.ndarray, texts: pa.Array, block: int, buckets: int) -> list[tuple]:
    """A block's codes, and its messages to the buckets of words."""
    buf, starts, ends, off = words(texts, lower=True)
    size = np.diff(off) + 1
    to = np.concatenate(([0], np.cumsum(size)))
    token = np.full(to[-1] + 1, END, np.uint64)
    inner = np.ones(to[-1] + 1, bool)
    inner[to[1:] - 1] = False
    inner[-1] = False
    token[inner] = hashes(buf, starts, ends)
    token[-1] = START  # not a token: its count is that of the texts
    distinct, code = np.unique(token, return_inverse=True)
    order, bounds = by_bucket(distinct, buckets)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    taught = np.bincount(code[:-1][~np.repeat(held, size)], minlength=len(distinct)).astype(np.uint64)
    taught[code[-1]] = np.count_nonzero(~held)
    taught, distinct = taught[order], distinct[order]
    out = [(CODES, -1, block, ids, size.astype(np.uint64), at[code].astype(np.uint64), held.astype(np.uint8))]
    return out + [(ASKED, b, block, distinct[x:y], taught[x:y]) for b, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if y > x]


def count_words(rows: pa.Table, buckets: int) -> tuple[list[tuple], dict[str, np.ndarray], int]:
    """Counts and numbers of a bucket's words: a row of the model for each, and an answer to each block that asked."""
    bucket = rows.column("bucket")[0].as_py()
    asked = [wide(x) for x in rows.column("a").to_pylist()]
    key, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([wide(x) for x in rows.column("b").to_pylist()]), len(key)).astype(np.uint64)
    order = np.lexsort((key, ~n))  # frequent words first, so their numbers are small
    number = np.empty(len(key), np.uint64)
    number[order] = np.arange(len(key), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
    at = np.concatenate(([0], np.cumsum([len(x) for x in asked])))
    own = order[(n[order] > 0) & (key[order] != START)]
    out = [(ANSWERED, bucket, b, number[inverse[x:y]], n[inverse[x:y]]) for b, x, y in zip(rows.column("block").to_pylist(), at[:-1], at[1:], strict=True)]
    return out, {"word": number[own], "n": n[own]}, bucket


def steps(lines: np.ndarray) -> np.ndarray:
    """Ascending columns as differences: of the first line, and of the second where the first stays."""
    out = lines.copy()
    out[0] = np.diff(lines[0], prepend=np.uint64(0))
    if len(lines) > 1:
        same = np.append(False, lines[0][1:] == lines[0][:-1])
        out[1][same] -= lines[1][np.flatnonzero(same) - 1]
    return out


def unstepped(lines: np.ndarray) -> np.ndarray:
    out = lines.copy()
    out[0] = np.cumsum(lines[0])
    if len(lines) > 1 and lines.shape[1]:
        head = np.flatnonzero(np.append(True, out[0][1:] != out[0][:-1]))
        run = np.cumsum(lines[1])
        out[1] = run - np.repeat(run[head] - lines[1][head], np.diff(np.append(head, lines.shape[1])))
    return out


@dataclass
class Level:
    """The distinct n-grams of one order in a block, ascending, and what is told of them and of their histories."""

    words: np.ndarray  # local words of each, one line a place
    history: np.ndarray  # of each, as an n-gram of the order below
    low: np.ndarray  # each without its first word, likewise
    real: np.ndarray  # not made of start marks only
    of: np.ndarray  # of each place of the padded tokens
    n: np.ndarray
    key: np.ndarray  # of each, as history * distinct words + last word
    whole: np.ndarray  # of each history: its count, one more where nothing is spared
    backing: np.ndarray  # the histories that back off here
    stats: np.ndarray  # and their statistics, one column each
    bounds: np.ndarray | None = None  # the real ones' order by bucket, and its bounds
    order: np.ndarray | None = None
    salts: np.ndarray | None = None


class Tokens:
    """A block with the answers about its n-grams of the orders told, and its n-grams of ``order``."""

    def __init__(self, codes: pa.Table, told: pa.Table, order: int, most: int, buckets: int):
        row = codes.to_pylist()[0]
        answers = sorted(told.to_pylist(), key=lambda r: (r["kind"], r["level"] or 0, r["bucket"]))
        self.ids, self.size, self.held = dec(row["a"]).view(np.int64), dec(row["b"]).astype(np.int64), dec(row["d"]).astype(bool)
        code, self.buckets = dec(row["c"]).astype(np.int64), buckets
        number, n = (np.concatenate([wide(r[c]) for r in answers if r["kind"] == ANSWERED]) for c in "ab")
        by = ascending(number)[0]
        place_of = np.empty(len(by), np.int64)
        place_of[by] = np.arange(len(by))
        self.number, n = number[by], n[by]
        self.start = place_of[code[-1]]
        pad = most - 1
        self.at = np.arange(len(code) - 1) + pad * (np.repeat(np.arange(len(self.size)), self.size) + 1)  # places of real tokens
        padded = np.full(len(code) - 1 + pad * len(self.size), self.start, np.int64)
        padded[self.at] = place_of[code[:-1]]
        within = np.arange(len(padded)) - np.repeat(np.cumsum(self.size + pad) - self.size - pad, self.size + pad)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        none = np.zeros(0, np.int64)
        self.levels = [Level(np.arange(len(by))[None], none, none, np.ones(len(by), bool), padded, n, none, none, none, none)]
        for k in range(2, order + 1):
            self._add(within, k, [r for r in answers if r["kind"] == TOLD and r["level"] == k], [r for r in answers if r["kind"] == ADDED and r["level"] == k])

    def _add(self, within: np.ndarray, k: int, told: list[dict], added: list[dict]) -> None:
        below, first = self.levels[-1], self.levels[0]
        v = len(first.n)
        at = np.flatnonzero(within >= k - 1)
        key, index, of = distinct(below.of[at - 1] * v + first.of[at])
        history = key // v
        last = key - history * v
        full = np.zeros(len(within), np.int64)
        full[at] = of
        real = np.zeros(len(key), bool)
        real[full[self.at]] = True
        low = below.of[at[index]]
        cols = np.concatenate((below.words[:, history], last[None]))
        # the bucket of each real one: by the history's last word, and where that is frequent by the others too
        lines = [below.words[-1], *below.words[:-1]]
        name = mix(self.number[lines[0]] * M3 + np.uint64(k))
        if k > 2:
            frequent = np.flatnonzero((first.n >= HOT)[lines[0]])
            rest = np.full(len(frequent), M2, np.uint64)
            for line in lines[1:]:
                rest = mix(rest * M3 + self.number[line[frequent]])
            many = 1 + (first.n[lines[0][frequent]] // HOT).astype(np.uint64)
            name[frequent] = mix(name[frequent] + rest % many)
        seen = below.n if k == 2 else np.where(below.real, below.n, first.n[self.start])
        salts = 1 + (seen // HOT).astype(np.uint64)
        own = name[history]
        parted = salts[history] > 1
        own[parted] = mix(own[parted] + mix(self.number[last[parted]]) % salts[history[parted]])
        mine = np.flatnonzero(real)
        if k > 2:
            by = np.lexsort(lines[::-1]) if k > 3 else ascending(lines[0] * v + lines[1])[0]
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            mine = mine[ascending(rank[history[mine]])[0]]
        order, bounds = by_bucket(own[mine], self.buckets)
        level = Level(cols, history, low, real, full, np.zeros(len(key), np.uint64), key, np.zeros(len(below.n)), np.zeros(0, np.int64), np.zeros((2 * TOP + 2, 0)), bounds, mine[order], salts)
        if told:
            level.n[level.order] = np.concatenate([wide(r["a"]) for r in told])
            if told[0]["b"] is not None:
                self._backing(level, told, added)
        self.levels.append(level)

    def _backing(self, level: Level, told: list[dict], added: list[dict]) -> None:
        """Histories' counts, and statistics of those that back off. A parted history's are those added up."""
        own, stats = [], []
        for r in told:
            g = level.order[level.bounds[r["bucket"]] : level.bounds[r["bucket"] + 1]]
            head = np.append(True, level.history[g][1:] != level.history[g][:-1])
            heads = level.history[g][head]
            level.whole[heads] = dec(r["b"])
            own.append(heads[np.bincount(np.cumsum(head) - 1, level.n[g] == 0) > 0])
            stats.append(wide(r["c"]).reshape(2 * TOP + 2, -1))
        own, stats = np.concatenate(own), np.concatenate(stats, axis=1)
        if added:
            mine = np.array([self.find(r["names"]) for r in added])
            full = np.array([r["stats"] for r in added], np.uint64).T
            level.whole[mine] = whole(full)
            single = ~np.isin(own, mine)
            own, stats = np.concatenate((own[single], mine)), np.concatenate((stats[:, single], full), axis=1)
        level.backing, level.stats = own, stats

    def find(self, numbers: list[int]) -> int:
        """The n-gram of these words in its level."""
        v, at = len(self.number), 0
        for i, w in enumerate(np.searchsorted(self.number, np.array(numbers, np.uint64)).tolist()):
            at = int(np.searchsorted(self.levels[i].key, at * v + w)) if i else w
        return at

    def asks(self, block: int) -> list[tuple]:
        """Messages about the n-grams of the highest order to the buckets."""
        level, below = self.levels[-1], self.levels[-2]
        taught = np.bincount(level.of[self.at][~self.held[self.doc]], minlength=len(level.n)).astype(np.uint64)
        out = []
        for b in np.flatnonzero(np.diff(level.bounds)):
            g = level.order[level.bounds[b] : level.bounds[b + 1]]
            history = level.history[g]
            head = np.flatnonzero(np.append(True, history[1:] != history[:-1]))
            own = history[head]
            lines = steps(self.number[np.roll(below.words[:, own], 1, axis=0)])
            size = np.diff(np.append(head, len(g))).astype(np.uint64)
            out.append((ASKED, int(b), block, lines.reshape(-1), size, self.number[level.words[-1][g]], taught[g], below.n[level.low[g]].astype(np.uint64), level.salts[own] - np.uint64(1)))
        return out


def whole(stats: np.ndarray) -> np.ndarray:
    """c(h) of histories with these statistics, one more where nothing is spared."""
    return stats[0] + ((stats[0] > 0) & (stats[1 : TOP + 1].sum(axis=0) == 0)).astype(stats.dtype)


def in_order(names: list[np.ndarray], sizes: list[np.ndarray], word: np.ndarray) -> np.ndarray:
    """Places of n-grams by their history's words, then the last one. Histories, which stand once for each block, are
    numbered by rank first."""
    rank = np.zeros(sum(x.shape[1] for x in names), np.uint64)
    for line in np.concatenate(names, axis=1):
        most = int(line.max(initial=0)).bit_length()
        rank = distinct(rank << np.uint64(most) | line)[2].astype(np.uint64)
    most = int(word.max(initial=0)).bit_length()
    return ascending(np.repeat(rank, np.concatenate(sizes)) << np.uint64(most) | word)[0]


def count_grams(rows: pa.Table, order: int) -> tuple[list[tuple], dict[str, np.ndarray], int, list[tuple]]:
    """Counts of a bucket's n-grams: a row of the model for each, and for each block the counts that it asked for, its
    histories' counts, and statistics of those histories under which it has a new n-gram, as nothing else backs off: the
    count, the followers by count (1 to TOP), the counts of the followers without the history's first word, and these by
    count."""
    bucket = rows.column("bucket")[0].as_py()
    names, sizes = [wide(x).reshape(order - 1, -1) for x in rows.column("a").to_pylist()], [dec(x).astype(np.int64) for x in rows.column("b").to_pylist()]
    names = list(map(unstepped, names))
    history = np.concatenate([np.repeat(h, s, axis=1) for h, s in zip(names, sizes, strict=True)], axis=1)
    word, n, low = (np.concatenate([wide(x) for x in rows.column(c).to_pylist()]) for c in "cde")
    salts = np.concatenate([np.repeat(wide(x), s) for x, s in zip(rows.column("f").to_pylist(), sizes, strict=True)])
    by = in_order(names, sizes, word)
    h, w = history[:, by], word[by]
    turn = np.append(True, (h[:, 1:] != h[:, :-1]).any(axis=0))
    fresh = turn | np.append(True, w[1:] != w[:-1])
    gram, group = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    gram[by], group[by] = np.cumsum(fresh) - 1, np.cumsum(turn) - 1
    total = np.bincount(gram, n).astype(np.uint64)
    h, w, low, salts = h[:, fresh], w[fresh], low[by][fresh], salts[by][fresh]
    of = (np.cumsum(turn) - 1)[fresh]
    size, seen = int(turn.sum()), total > 0
    tally = lambda v, yes: np.bincount(of[yes], v[yes], size).astype(np.uint64)
    one = np.ones(len(total), np.uint64)
    stats = np.array([tally(total, seen), *(tally(one, total == r) for r in range(1, TOP + 1)), tally(low, seen), *(tally(one, seen & (low == r)) for r in range(1, TOP + 1))])
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    blocks = rows.column("block").to_pylist()
    split = np.flatnonzero(salts[heads] > 0)
    out, at, askers = [], 0, {i: [] for i in split.tolist()}
    for b, s in zip(blocks, sizes, strict=True):
        to = at + int(s.sum())
        own, n = group[at + np.cumsum(s) - s], total[gram[at:to]]
        for i in own[np.isin(own, split)].tolist():
            askers[i].append(b)
        new = np.bincount(np.repeat(np.arange(len(own)), s)[n == 0], minlength=len(own)) > 0
        out.append((TOLD, bucket, b, n, whole(stats[:, own]), stats[:, own[new]].reshape(-1)))
        at = to
    parts = [(np.roll(h[:, heads[i]], -1).astype(np.int64).tolist(), stats[:, i].astype(np.int64).tolist(), askers[i]) for i in split.tolist()]
    flat = {f"h{i + 1}": line[seen] for i, line in enumerate(np.roll(h, -1, axis=0))} | {"word": w[seen], "n": total[seen]}
    return out, flat, bucket, parts


def discounts(kinds: list[int]) -> np.ndarray:
    """d[0..TOP] from the numbers of types that occur 1 .. TOP + 1 times. Where Good-Turing estimates don't lie
    strictly between 0 and 1, an absolute discount takes their place."""
    n = np.array([0, *kinds], float)
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
    r = np.arange(1, TOP + 1)
    with np.errstate(all="ignore"):
        spare = (TOP + 1) * n[TOP + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - spare) / (1 - spare)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        d = (r - plain) / r
    return np.concatenate(([0.0], d))


@dataclass(frozen=True)
class Totals:
    """What all tasks need to know of the corpus: tokens, types, and the discounts of each order."""

    n: int
    types: int
    d: tuple[np.ndarray, ...]
    spared: float  # of the words' counts

    @property
    def whole(self) -> int:
        """The words' denominator; one more where nothing is spared."""
        return self.n + (self.spared == 0)

    def discounted(self, n: np.ndarray, order: int) -> np.ndarray:
        return np.where(n <= TOP, self.d[order - 1][np.minimum(n, TOP).astype(np.int64)], 1.0) * n

    def word(self, n: np.ndarray) -> np.ndarray:
        """P(w) of words by their counts."""
        return np.where(n > 0, self.discounted(n, 1), self.spared or 1.0) / self.whole


def totals(kinds: list[list[int]], n: int, types: int) -> Totals:
    """``kinds``: of each order, the numbers of types that occur 1 .. TOP + 1 times."""
    d = tuple(map(discounts, kinds))
    return Totals(n, types, d, float(((1 - d[0][1:]) * np.arange(1, TOP + 1) * np.array(kinds[0][:TOP], float)).sum()))


def spare(stats: np.ndarray, t: Totals, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of histories with these statistics: the share that is spared, and the discounted counts of their followers without
    the history's first word."""
    s = stats.astype(float)
    r = np.arange(1, TOP + 1)[:, None]
    spared = ((1 - t.d[order - 1][1:, None]) * r * s[1 : TOP + 1]).sum(axis=0)
    below = s[TOP + 1] - ((1 - t.d[order - 2][1:, None]) * r * s[TOP + 2 :]).sum(axis=0)
    return np.where(spared == 0, 1.0, spared) / np.maximum(whole(stats), 1), below


def probability(tokens: Tokens, t: Totals, order: int) -> np.ndarray:
    """P of each distinct n-gram's last word after the others, backing off recursively."""
    level = tokens.levels[order - 1]
    if order == 1:
        return t.word(level.n.astype(float))
    lower, below = probability(tokens, t, order - 1)[level.low], tokens.levels[order - 2]
    spared, less = spare(level.stats, t, order)
    shorter = t.whole if order == 2 else below.whole[below.low[level.backing]]
    weight = np.ones(len(level.whole))
    with np.errstate(all="ignore"):
        weight[level.backing] = np.where(level.whole[level.backing] > 0, spared / (1 - less / shorter), 1.0)
        seen = t.discounted(level.n.astype(float), order) / level.whole[level.history]
    return np.where(level.n > 0, seen, weight[level.history] * lower)


def scores(tokens: Tokens, t: Totals, order: int) -> pa.Table:
    docs = len(tokens.size)
    total = lambda x: np.bincount(tokens.doc, x, docs)
    n = tokens.levels[0].n[tokens.levels[0].of[tokens.at]].astype(float)
    base = np.log10((n + 0.1) / (t.n + 0.1 * (t.types + 1)))
    logs = np.log10(np.maximum(probability(tokens, t, order)[tokens.levels[order - 1].of[tokens.at]], np.finfo(float).tiny))
    return pa.table({
        "doc_id": pa.array(tokens.ids, pa.int64()), "held_out": pa.array(tokens.held), "n_tokens": pa.array(tokens.size),
        "n_known": pa.array(total(n > 0).astype(np.int64)), "train_tokens": pa.array(np.full(docs, t.n)), "base_score": pa.array(total(base)), "score": pa.array(total(logs)),
    })


@dataclass(frozen=True)
class Model:
    """The stored tables of a corpus and its blocks. ``grams``: of each order the table (h1, ..., word, n) of its n-grams;
    words are numbers, which ``vocabulary(word, n)``, the table of order 1, has too."""

    totals: Totals
    grams: list[DataFrame]
    codes: DataFrame
    answered: DataFrame
    told: list[DataFrame]  # of the orders above 1: with the n-grams, what blocks are told of them
    buckets: int

    def discounted(self, order: int) -> DataFrame:
        """The n-grams of an order with their discounted counts."""
        d = F.array(*map(F.lit, self.totals.d[order - 1].tolist()))
        return self.grams[order - 1].withColumn("discounted", F.when(F.col("n") <= TOP, F.get(d, F.col("n").cast("int"))).otherwise(F.lit(1.0)) * F.col("n"))

    def weights(self, order: int) -> DataFrame:
        """h1, ..., n, weight: the histories of an order (2 or more) with their counts and backoff weights."""
        history, short = [f"h{i}" for i in range(1, order)], [f"h{i}" for i in range(2, order)]
        low = self.discounted(order - 1).select(*(F.col(f"h{i}").alias(f"h{i + 1}") for i in range(1, order - 1)), "word", F.col("discounted").alias("low"))
        whole = self.grams[order - 2].groupBy(*(F.col(f"h{i}").alias(f"h{i + 1}") for i in range(1, order - 1))).agg(F.sum("n").alias("_n"), F.min("n").alias("_least"))
        denominator = F.lit(self.totals.whole) if order == 2 else F.first(F.col("_n") + (F.col("_least") > TOP).cast("int"))
        rows = self.discounted(order).join(low, [*short, "word"])
        rows = rows if order == 2 else rows.join(whole, short)
        rows = rows.groupBy(*history).agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("discounted")).alias("spared"), F.sum("low").alias("low"), F.min("n").alias("least"), denominator.alias("denominator"))
        none = F.col("least") > TOP
        return rows.select(*history, "n", (F.when(none, 1 / (F.col("n") + 1)).otherwise(F.col("spared") / F.col("n")) / (1 - F.col("low") / F.col("denominator"))).alias("weight"))


def fit(docs: DataFrame, order: int = 3) -> Model:
    """Counts the n-grams of the rows of ``docs(doc_id, text)`` that aren't held out, and stores the tables."""
    spark = docs.sparkSession
    size = text_bytes(docs)
    buckets, path = 1 + size // BUCKET_BYTES, place(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches, "text", BLOCK_BYTES)):
            ids, own = batch.column("doc_id").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False)
            yield from table_of(1, CODED, block_rows(ids, own, batch.column("text"), part << 24 | k, buckets)).to_batches()

    def words_counted(asked: pa.Table) -> pa.Table:
        return table_of(1, TELLING, *count_words(asked, buckets))

    blocks = bucketed(rows.mapInArrow(coded, schema(1, CODED)), max(width(spark), 1 + size // (2 * BLOCK_BYTES)), "block", f"{path}/blocks", "kind")
    codes = blocks.where(F.col("kind") == CODES).select("block", "a", "b", "c", "d")
    first = stored(blocks.where(F.col("kind") == ASKED).groupBy("bucket").applyInArrow(words_counted, schema(1, TELLING)), path=f"{path}/order=1")
    discard(spark, f"{path}/blocks/kind={ASKED}")
    grams, told = [first.where(F.col("kind") == GRAMS).select("word", "n")], []
    answered = message(first.where(F.col("kind") == ANSWERED), 0, a=F.col("a"), b=F.col("b"))
    for k in range(2, order + 1):
        found = stored(_pass(codes, [answered, *(message(x.where(F.col("kind") == TOLD), i + 2, a=F.col("a")) for i, x in enumerate(told))], k, order, buckets), path=f"{path}/order={k}")
        grams.append(found.where(F.col("kind") == GRAMS).select(*(f"h{i}" for i in range(1, k)), "word", "n"))
        told.append(found)
    kinds = []
    for table in grams:  # TOP + 1 rows each
        tally = {r.n: r.m for r in table.where(F.col("n") <= TOP + 1).groupBy("n").agg(F.count("*").alias("m")).collect()}
        kinds.append([tally.get(r, 0) for r in range(1, TOP + 2)])
    n, types = grams[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Model(totals(kinds, n, types), grams, codes, answered, told, buckets)


NONE = {"a": "binary", "b": "binary", "c": "binary", "names": "array<long>", "stats": "array<long>"}


def message(rows: DataFrame, level: int, **given: Column) -> DataFrame:
    """Rows of one kind for the blocks, with the columns ``given``."""
    return rows.select("block", "kind", F.lit(level).alias("level"), "bucket", *(given.get(c, F.lit(None).cast(t)).alias(c) for c, t in NONE.items()))


def _pass(codes: DataFrame, known: list[DataFrame], k: int, most: int, buckets: int) -> DataFrame:
    """The n-grams of order ``k`` asked by the blocks and counted by the buckets."""

    def asks(codes: pa.Table, told: pa.Table) -> pa.Table:
        return table_of(1, ASKING, Tokens(codes, told, k, most, buckets).asks(codes.column("block")[0].as_py()) if codes.num_rows else [])

    def counted(rows: pa.Table) -> pa.Table:
        return table_of(k, TELLING, *count_grams(rows, k))

    asked = codes.groupBy("block").cogroup(reduce(DataFrame.unionByName, known).groupBy("block")).applyInArrow(asks, schema(1, ASKING))
    return asked.groupBy("bucket").applyInArrow(counted, schema(k, TELLING))


def added(found: DataFrame, k: int) -> DataFrame:
    """The totals of parted histories, added up, for the blocks that asked. These are few: HOT occurrences to a part at
    least."""
    history = [f"h{i}" for i in range(1, k)]
    parts = found.where(F.col("kind") == PARTS)
    sums = parts.groupBy(*history).agg(F.array(*(F.sum(F.when(F.col("word") == i, F.col("n"))) for i in range(2 * TOP + 2))).alias("sums"))
    asked = found.where(F.col("kind") == ASKERS).select(*history, "block").distinct().join(sums, history)
    rows = asked.select("block", F.lit(ADDED).alias("kind"), F.lit(-1).alias("bucket"), F.array(*history).alias("names"), "sums")
    return message(rows, k, names=F.col("names"), stats=F.col("sums"))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs(doc_id, text)``.
    Rows whose crc32(doc_id as text) mod 10 is 0 are held out of training; a null doc_id teaches."""
    model = fit(docs, order)
    t, buckets = model.totals, model.buckets
    known = [model.answered]
    for k, found in enumerate(model.told, 2):
        known += [message(found.where(F.col("kind") == TOLD), k, **{c: F.col(c) for c in "abc"}), added(found, k)]

    def scored(codes: pa.Table, told: pa.Table) -> pa.Table:
        return scores(Tokens(codes, told, order, order, buckets), t, order)

    out = model.codes.groupBy("block").cogroup(reduce(DataFrame.unionByName, known).groupBy("block")).applyInArrow(scored, OUT)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
