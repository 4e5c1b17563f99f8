"""Token counts by a finite-state transducer compiled from a sentencepiece BPE vocabulary.

A BPE tokenisation is right exactly if each two neighbours in it are: encoded together, they give
themselves back. That is so unless, at some time, the last symbol of the one and the first symbol of the other make
an entry of higher score than those they go into next on their own sides. Which symbols these are, and until which
merge, is compiled from the vocabulary for every entry before any text is read. So the last token of a prefix is the one vocabulary entry that ends there and may
follow the last token of what precedes it. The transducer reads characters through the vocabulary's
matching automaton; its state is the last token at each recent position (no further back than the
longest entry), and a transition that completes token t at position i emits
count(i) = count(i - len(t)) + 1. The library takes no part in it.

A character that no entry of two or more characters holds resets the state, as does the start of
a run of spaces: no entry has a space after another character. In long runs the state is reset, too, between two
characters that stand side by side in no entry.

Texts of one chunk are counted where they are read, without a shuffle. Longer texts are cut into chunks anywhere, which are
dealt to tasks. A chunk's state map is (reset, head, count, tail): what precedes its first reset, the tokens
between resets, and what follows the last. Heads and tails are short, unless in a long run any two neighbours stand
side by side in some entry. Maps compose associatively, since only a tail and the heads after it must be read
together; a prefix scan joins FAN neighbours at a time, as a grouping for each level.

Nulls and empty texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import width
from .words import M1, pieces, raw, slices

SPACE = "▁"
#: Slots for the pairs that a Python worker keeps compiled (a power of two); a pair takes its slot from the one there.
PAIRS = 1 << 21
#: Characters of a segment above which it is parted where it can be, and else read alone.
LONG = 1024
#: Maps that one step of the scan composes.
FAN = 256


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("the transducer is defined for BPE models")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that leave characters and white space as they are")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are matched before merging")
        self.fallback = proto.trainer_spec.byte_fallback
        normal = [p.piece for p in proto.pieces if p.type == kinds.NORMAL]
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("an entry has a space after another character")
        score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        order = {x: i for i, x in enumerate(sorted({score[p] for p in normal if len(p) > 1}, reverse=True))}
        self.rank = {p: order[score[p]] for p in normal if len(p) > 1}  # of merges: the least goes first, of equals the leftmost
        self.never = len(order)
        spines = [self._spines(p) for p in normal]
        self.tokens = [p for p, s in zip(normal, spines, strict=True) if s]  # its own merges reach an entry, or it is never emitted
        self.sizes = np.array([len(t) for t in self.tokens])
        self._cross([s for s in spines if s])
        self.inner = {c for p in normal if len(p) > 1 for c in p}
        self.single = {p for p in normal if len(p) == 1}
        self.joining = re.compile(f"[{''.join(map(re.escape, sorted(self.inner)))}]+")
        self._compile()
        beside = {(p[i], p[i + 1]) for p in normal for i in range(len(p) - 1)}
        self.beside = np.sort(np.array([int(self.char[ord(a)]) << 32 | int(self.char[ord(b)]) for a, b in beside], np.int64))
        self.pairs, self.right = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.known: dict[int, bool] = {}

    def _compile(self) -> None:
        """The matching automaton as a table: state and character class give the next state; ``ends`` names
        the entry that a state spells, ``link`` the state of the next shorter entry that ends there."""
        letters = sorted(self.inner)
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in letters]] = np.arange(len(letters))
        children: list[dict[int, int]] = [{}]
        spelt = [-1]
        for t, token in enumerate(self.tokens):
            if all(c in self.inner for c in token):
                at = 0
                for c in token:
                    k = int(self.char[ord(c)])
                    if k not in children[at]:
                        children[at][k] = len(children)
                        children.append({})
                        spelt.append(-1)
                    at = children[at][k]
                spelt[at] = t
        self.step = np.zeros((len(children), len(letters)), np.int32)
        self.ends, self.link = np.array(spelt), np.zeros(len(children), np.int32)
        fail, queue = [0] * len(children), [0]
        for at in queue:
            up = fail[at]
            self.link[at] = up if self.ends[up] >= 0 else self.link[up]
            if at:
                self.step[at] = self.step[up]
            for k, to in children[at].items():
                fail[to] = int(self.step[up][k]) if at else 0
                self.step[at][k] = to
                queue.append(to)

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """The last and the first symbols of an entry while it is merged: each with the times at which it comes and goes,
        and the greatest rank of the merges from then on until it goes. A time is the greatest rank merged so far, as a
        merge may open one of lower rank, which follows at once. None if the merges end elsewhere."""
        symbols, now, never = list(piece), -1, self.never
        out: tuple[list, list] = ([], [])
        born, most = [-1, -1], [-1, -1]
        while len(symbols) > 1:
            rank, i = min((self.rank.get(a + b, never), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == never:
                return None
            now, most = max(now, rank), [max(m, rank) for m in most]
            for side, touched, symbol in ((0, i == len(symbols) - 2, symbols[-1]), (1, i == 0, symbols[0])):
                if touched:
                    out[side].append((symbol, born[side], now, most[side]))
                    born[side], most[side] = now, -1
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return tuple(out[side] + [(piece, born[side], never, never)] for side in (0, 1))

    def _cross(self, spines: list[tuple[list, list]]) -> None:
        """Tables of the spines, and of the entries that a symbol at an end and one at a start make."""
        names: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.spines = spines
        self.spine = []
        for side in (0, 1):
            table = np.full((4, len(spines), max((len(s[side]) for s in spines), default=1)), -1, np.int64)
            for t, s in enumerate(spines):
                for k, (symbol, *times) in enumerate(s[side]):
                    table[:, t, k] = names[side].setdefault(symbol, len(names[side])), *times
            self.spine.append(table)
        made = sorted((names[0][p[:i]] * len(names[1]) + names[1][p[i:]], rank) for p, rank in self.rank.items() for i in range(1, len(p)) if p[:i] in names[0] and p[i:] in names[1])
        self.width = len(names[1])
        self.made, self.made_rank = (np.array([m[i] for m in made], np.int64) for i in (0, 1))

    def compiled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether entry b may follow entry a, from the spines: no two symbols that meet at their border are merged. They
        meet if the one that comes first is still there when the other comes; they are merged if what would take either up
        has a higher rank, or waits behind one that has. Of equal ranks the left goes first."""
        out = np.ones(len(a), bool)
        last, first = self.spine
        for i in range(last.shape[2] if len(self.made) else 0):
            at = np.flatnonzero(out & (last[0, a, i] >= 0))  # spines are filled from their beginnings
            for j in range(first.shape[2]):
                at = at[out[at] & (first[0, b[at], j] >= 0)]
                if not len(at):
                    break
                key = last[0, a[at], i] * self.width + first[0, b[at], j]
                made = np.minimum(np.searchsorted(self.made, key), len(self.made) - 1)
                met = self.made[made] == key
                pair, rank = at[met], self.made_rank[made[met]]
                (_, x_born, x_gone, x_most), (_, y_born, y_gone, y_most) = last[:, a[pair], i], first[:, b[pair], j]
                live = np.where(x_born > y_born, y_gone >= x_born, x_gone > y_born)
                out[pair[live & (rank < x_most) & (rank <= y_most)]] = False
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compiled``, kept for pairs that were met before."""
        key = a.astype(np.int64) * len(self.tokens) + b
        slot = (key.astype(np.uint64) * M1 >> np.uint64(32)) & np.uint64(len(self.pairs) - 1)
        out = self.right[slot]
        new = np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            fresh, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            ok = self.compiled(fresh // len(self.tokens), fresh % len(self.tokens))
            out[new] = ok[inverse]
            at, one = np.unique(slot[new[first]], return_index=True)
            self.pairs[at], self.right[at] = fresh[one], ok[one]
        return out

    def follows(self, a: int, b: int) -> bool:
        """``compiled`` for one pair."""
        key = a * len(self.tokens) + b
        if key not in self.known:
            if len(self.known) > PAIRS:
                self.known.clear()
            self.known[key] = not any(
                self.rank.get(x + y, self.never) < min(x_most, y_most + 1) and (y_gone >= x_born if x_born > y_born else x_gone > y_born)
                for x, x_born, x_gone, x_most in self.spines[a][0] for y, y_born, y_gone, y_most in self.spines[b][1]
            )
        return self.known[key]

    def borders(self, segment: str) -> np.ndarray:
        """The places in a segment that no merge crosses: the characters around them stand side by side in no entry."""
        codes = self.codes(segment).astype(np.int64)
        pair = codes[:-1] << 32 | codes[1:]
        pair[(codes[:-1] < 0) | (codes[1:] < 0)] = -1
        return np.flatnonzero(~np.isin(pair, self.beside)) + 1

    def parted(self, segment: str) -> list[str]:
        """A long segment in parts that are read apart."""
        if len(segment) <= LONG:
            return [segment]
        at = [0, *self.borders(segment).tolist(), len(segment)]
        return [segment[a:b] for a, b in zip(at, at[1:], strict=False)]

    def run_long(self, codes: np.ndarray) -> int:
        """Emitted tokens of one long segment, a character at a time."""
        ends, link, sizes, step = self.ends.tolist(), self.link.tolist(), self.sizes.tolist(), self.step
        last, emitted, state = [-2] + [-1] * len(codes), [0] * (len(codes) + 1), 0
        for i, c in enumerate(codes.tolist(), 1):
            state = int(step[state, c])
            at = state if ends[state] >= 0 else link[state]
            while at > 0:
                t = ends[at]
                before = last[i - sizes[t]]
                if before == -2 or (before >= 0 and self.follows(before, t)):
                    last[i], emitted[i] = t, emitted[i - sizes[t]] + 1
                    break
                at = link[at]
        if last[-1] == -1:
            raise AssertionError("no right token ends a segment")
        return emitted[-1]

    def run(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Emitted tokens of segments of at most len(codes[0]) characters, longest first, all read together."""
        n, longest = codes.shape
        last = np.full((n, longest + 1), -1, np.int32)
        emitted = np.zeros((n, longest + 1), np.int32)
        last[:, 0] = -2
        state = np.zeros(n, np.int32)
        live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        for i in range(1, longest + 1):
            m = int(live[i - 1])
            state = self.step[state[:m], codes[:m, i - 1]]
            at, who = np.where(self.ends[state] >= 0, state, self.link[state]), np.arange(m)
            while len(who := who[at > 0]):
                at = at[at > 0]
                token = self.ends[at]
                back = i - self.sizes[token]
                before = last[who, back]
                ok = before == -2
                ask = np.flatnonzero(before >= 0)
                ok[ask] = self.may_follow(before[ask], token[ask])
                last[who[ok], i] = token[ok]
                emitted[who[ok], i] = emitted[who[ok], back[ok]] + 1
                who, at = who[~ok], self.link[at[~ok]]
        if (last[np.arange(n), sizes] == -1).any():
            raise AssertionError("no right token ends a segment")
        return emitted[np.arange(n), sizes]

    def codes(self, text: str) -> np.ndarray:
        """The character classes of a text; -1 where a character joins no other."""
        return self.char[np.frombuffer(text.replace(" ", SPACE).encode("utf-32-le"), "<u4")]

    def read(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of segments in which every character joins others, from the reset state."""
        out = np.zeros(len(sizes), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for i in order[sizes[order] > LONG].tolist():
            out[i] = self.run_long(codes[starts[i] : starts[i] + sizes[i]])
        edges = [0, 16, 24, 48, 256, LONG]
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = order[(sizes[order] > lo) & (sizes[order] <= hi)]
            step = max(1, (1 << 21) // hi)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                size = sizes[part]
                place = np.arange(int(size[0]))
                inside = place < size[:, None]
                grid = np.zeros(inside.shape, np.int32)
                grid[inside] = codes[(starts[part][:, None] + place)[inside]]
                out[part] = self.run(grid, size)
        return out

    def lone(self, c: str) -> int:
        """Tokens of a character that joins no other."""
        return 1 if c in self.single or not self.fallback else len(c.encode())

    def of(self, segments: pa.StringArray) -> np.ndarray:
        """Tokens of segments, which may hold characters that join no other."""
        sizes = np.asarray(pc.utf8_length(segments)).astype(np.int64)
        buf, _ = raw(segments)
        codes = self.codes(buf[:-8].tobytes().decode())
        ends = np.cumsum(sizes)
        apart = np.concatenate(([0], np.cumsum(codes < 0)))
        plain = (sizes <= LONG) & (apart[ends] == apart[ends - sizes])
        out = np.zeros(len(segments), np.int64)
        out[plain] = self.read(codes, (ends - sizes)[plain], sizes[plain])
        of, ready = [], []
        for k in np.flatnonzero(~plain).tolist():
            s = segments[k].as_py().replace(" ", SPACE)
            out[k] = sum(map(self.lone, self.joining.sub("", s)))
            parts = [p for run in self.joining.findall(s) for p in self.parted(run)]
            of += [k] * len(parts)
            ready += parts
        sizes = np.fromiter(map(len, ready), np.int64, len(ready))
        np.add.at(out, of, self.read(self.codes("".join(ready)), np.cumsum(sizes) - sizes, sizes))
        return out

    def one(self, segment: str) -> int:
        return int(self.of(pa.array([segment]))[0]) if segment else 0


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


Map = tuple[bool, str, int, str]  # has a reset, head, tokens of what is closed, tail


def compose(a: Map, b: Map, read) -> Map:
    """The state map of two neighbouring pieces of text; associative, so pieces may be joined in any grouping."""
    if not b[0]:
        return (True, a[1], a[2], a[3] + b[1]) if a[0] else (False, a[1] + b[1], 0, "")
    if not a[0]:
        return (True, a[1] + b[1], b[2], b[3])
    return (True, a[1], a[2] + read(a[3] + b[1]) + b[2], b[3])


def scan(maps: list[Map], read) -> Map:
    """All maps of a text composed, neighbours first."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2], read) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def shortened(own: Transducer, m: Map) -> Map:
    """The map with what is long of its open ends cut at the first and the last border in them."""
    reset, head, n, tail = m
    if len(head) > LONG and len(at := own.borders(head)):
        first, last = int(at[0]), int(at[-1])
        if not reset:
            return True, head[:first], n + own.one(head[first:last]), head[last:]
        head, n = head[:first], n + own.one(head[first:])
    if len(tail) > LONG and len(at := own.borders(tail)):
        n, tail = n + own.one(tail[: int(at[-1])]), tail[int(at[-1]) :]
    return reset, head, n, tail


def state_maps(own: Transducer, texts: pa.Array, is_first: np.ndarray, is_last: np.ndarray) -> list[Map]:
    """A state map for each of the chunks ``texts``; the start of a text's first chunk counts as a reset,
    and its last chunk leaves no tail."""
    feeds = [c for c in "\n\t" if c not in own.inner]  # one byte each, and they join no other character
    buf, off = raw(texts)
    n = len(buf) - 8
    apart = np.isin(buf[:n], [ord(c) for c in feeds])
    each = np.zeros(256, np.int64)
    for c in feeds:
        each[ord(c)] = own.lone(c)
    space = buf[:n] == 32
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    reset = space & ~edge[:n]  # a space at a chunk's start may go on a run
    reset[1:] &= ~space[:-1]
    reset |= apart
    opens = edge[:n] | reset
    opens[1:] |= apart[:-1]
    starts = np.flatnonzero(opens & ~apart)
    stops = np.append(np.flatnonzero(opens), n)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    coded = pieces(buf, starts, ends).dictionary_encode()
    values, codes = coded.dictionary, np.asarray(coded.indices)
    seg, resets = np.searchsorted(starts, off), np.concatenate(([0], np.cumsum(reset)))
    has = is_first | (resets[off[1:]] > resets[off[:-1]])
    lo, hi, some = seg[:-1], seg[1:] - 1, seg[1:] > seg[:-1]
    head, tail = some & ~is_first, some & ~is_last & has
    head[some] &= starts[lo[some]] == off[:-1][some]
    tail[some] &= ends[hi[some]] == off[1:][some]
    closed = np.ones(len(starts), bool)
    closed[lo[head]] = closed[hi[tail]] = False
    used = np.flatnonzero(np.bincount(codes[closed], minlength=len(values)))
    found = np.zeros(len(values), np.int64)
    found[used] = own.of(values.take(pa.array(used)))
    tokens = np.where(closed, found[codes], 0)
    inside = np.concatenate(([0], np.cumsum(tokens)))
    fed = np.concatenate(([0], np.cumsum(each[buf[:n]])))
    count = inside[seg[1:]] - inside[seg[:-1]] + fed[off[1:]] - fed[off[:-1]]

    def text(at: np.ndarray, yes: np.ndarray) -> list[str]:
        return [values[int(codes[i])].as_py() if y else "" for i, y in zip(at.tolist(), yes.tolist(), strict=True)]

    return [shortened(own, m) for m in zip(has.tolist(), text(lo, head), count.tolist(), text(hi, tail), strict=True)]


MAP = "reset boolean, head string, n long, tail string"


def token_counts(docs: DataFrame, path: str, chunk: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of ``docs(doc_id, text)``; ``chunk``: characters."""

    def table_of(batch: pa.RecordBatch, keys: list[str], maps: list[Map]) -> pa.RecordBatch:
        columns = list(zip(*maps, strict=True)) or [()] * 4
        kinds = pa.bool_(), pa.string(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([*map(batch.column, keys), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*keys, "reset", "head", "n", "tail"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in slices(batches, "whole", 8 << 20):
            yes = np.ones(batch.num_rows, bool)
            n = [m[2] for m in state_maps(own, batch.column("whole"), yes, yes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in slices(batches, "chunk", 8 << 20):
            yield table_of(batch, ["doc_id", "row", "n_bytes", "k"], state_maps(own, batch.column("chunk"), *(np.asarray(batch.column(c)) for c in ("first", "last"))))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            each = [sorted((m["at"], (m["reset"], m["head"], m["n"], m["tail"])) for m in maps) for maps in batch.column("maps").to_pylist()]
            yield table_of(batch, ["doc_id", "row", "n_bytes", "k"], [shortened(own, scan([m for _, m in maps], own.one)) for maps in each])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            n = [n + own.one(head) + own.one(tail) for n, head, tail in zip(*(batch.column(c).to_pylist() for c in ("n", "head", "tail")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    out, keyed = "doc_id long, n_bytes long, n_tokens long", f"doc_id long, row long, n_bytes long, k int, {MAP}"
    spaced = F.concat(F.lit(" " if transducer(path).prefix else ""), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.when(F.col("text") == "", "").otherwise(spaced).alias("whole"))
    small = F.char_length("whole") <= chunk
    short = rows.where(small).mapInArrow(counted, out)
    chunks = (
        # repeated rows stay apart by a number; it only names rows, and is the same when a task runs again
        rows.where(~small).select("doc_id", F.monotonically_increasing_id().alias("row"), "n_bytes", F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("cut"))
        .select("doc_id", "row", "n_bytes", F.size("cut").alias("size"), F.posexplode("cut").alias("k", "chunk"))
        .select("doc_id", "row", "n_bytes", "k", (F.col("k") == 0).alias("first"), (F.col("k") == F.col("size") - 1).alias("last"), "chunk")
        .repartition(width(docs.sparkSession), "doc_id", "row", "k")
    )
    maps, span = chunks.mapInArrow(mapped, keyed), chunk
    while span < 2**31:  # no text is longer
        by = F.floor(F.col("k") / FAN).cast("int").alias("k")
        maps = maps.groupBy("doc_id", "row", by).agg(F.max("n_bytes").alias("n_bytes"), F.collect_list(F.struct(F.col("k").alias("at"), "reset", "head", "n", "tail")).alias("maps")).mapInArrow(joined, keyed)
        span *= FAN
    return short.unionByName(maps.mapInArrow(finished, out))
