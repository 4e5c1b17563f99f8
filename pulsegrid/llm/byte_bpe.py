"""Byte-level BPE through a sentencepiece model serialised from a rank file.

Byte b stands for the character 256 + b. Each vocabulary entry becomes a piece whose score is its
negative rank, so that sentencepiece merges in rank order; normalisation is the identity. Texts
are parted by the splitting pattern, each match is encoded on its own, and ids are decoded by
the inverse of the byte mapping.

Nulls count as empty texts, which have no ids; rows are independent of one another.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import DIGIT_C, LETTER_C, OTHER_C, SPACE_C, SYMBOL_C, WHITE, classes, owners, pieces, ragged, raw, slices

MAPPED = {b: chr(256 + b) for b in range(256)}
APART = chr(256 + 256)


def ranks_of(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    assert sorted(ranks) == list(range(len(ranks)))
    return [ranks[i] for i in range(len(ranks))]


def serialised(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model in which piece i is vocabulary[i]. A separator that is part of no other piece
    follows, and the unknown piece that the library demands."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for i, token in enumerate(vocabulary):
        model.pieces.add(piece="".join(map(MAPPED.__getitem__, token)), score=-float(i), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece=APART, score=-float(len(vocabulary)), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(len(vocabulary)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(vocabulary) + 1
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    spec = model.normalizer_spec
    spec.name = "identity"
    spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = ranks_of(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.vocabulary))
        self.inverse = [bytes(ord(c) - 256 for c in self.model.id_to_piece(i)) for i in range(len(self.vocabulary))]
        self.apart = self.model.piece_to_id(APART)
        self.matches = regex.compile(pattern).findall

    def merged(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens. They are mapped byte by byte, and many are read as one text with a piece
        between them that joins no other."""
        buf, off = raw(values)
        n = len(values)
        data = buf[:-8]
        place = np.arange(len(data)) + owners(off)  # a gap before the first byte of each but the first
        chars = np.full(len(data) + max(n - 1, 0), ord(APART), np.uint16)
        chars[place] = data.astype(np.uint16) + 256
        text, step, ids = chars.astype("<u2").tobytes().decode("utf-16-le"), 4096, []
        bounds = np.append(off[::step], off[-1]) if n % step else off[::step]
        bounds = bounds + np.minimum(np.arange(len(bounds)) * step, n)
        ids = self.model.encode([text[a : b - (b != len(text) + 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], num_threads=1)
        flat = np.fromiter((i for x in ids for i in (*x, self.apart)), np.uint32, sum(map(len, ids)) + len(ids))
        cuts = np.flatnonzero(flat == self.apart)
        to = np.concatenate(([0], cuts - np.arange(len(cuts))))
        return flat[flat != self.apart], to

    def ids(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments: most are one match of the pattern, the others are parted by it."""
        buf, off = raw(values)
        kind = classes(buf)[:-8]
        begin = off[:-1] + ((buf[off[:-1]] == 32) & (np.diff(off) > 1))
        odd = (kind == OTHER_C) | (kind == SPACE_C) | (kind != np.repeat(kind[np.minimum(begin, max(len(kind) - 1, 0))], np.diff(off)))
        odd[off[:-1][begin > off[:-1]]] = False
        seen = np.concatenate(([0], np.cumsum(odd)))
        one = seen[off[1:]] == seen[off[:-1]]
        rest = np.flatnonzero(~one)
        parts = [self.matches(x) for x in values.take(pa.array(rest)).to_pylist()]
        count = np.ones(len(values), np.int64)
        count[rest] = np.fromiter(map(len, parts), np.int64, len(parts))
        singles = values.filter(pa.array(one))
        more = pa.array([p for x in parts for p in x], pa.string())
        flat, to = self.merged(pa.concat_arrays([singles, more]))
        first = np.zeros(len(values), np.int64)
        first[one] = np.arange(len(singles))
        first[rest] = len(singles) + np.concatenate(([0], np.cumsum(count[rest])))[:-1]
        size = to[first + count] - to[first]
        bounds = np.concatenate(([0], np.cumsum(size)))
        return flat[np.arange(bounds[-1]) + np.repeat(to[first] - bounds[:-1], size)], bounds

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.inverse.__getitem__, ids.tolist()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's offsets."""
        buf, starts, ends, off = segments(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), off
        coded = pieces(buf, starts, ends).dictionary_encode()
        flat, bounds = self.ids(coded.dictionary)
        at, to = ragged(np.asarray(coded.indices), bounds)
        return flat[at], to[off]


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each text where no match of the pattern can cross: before a lone space between two other
    characters (it opens the next match), around a lone line feed (a match of its own), and where a digit or
    symbol follows a letter."""
    buf, off = raw(texts)
    n = len(buf) - 8
    white = WHITE[buf[:n]]
    lone = np.zeros(n, bool)
    if n > 2:
        lone[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
    inner = np.zeros(n + 1, bool)
    inner[off] = True
    lone &= ~inner[:n] & ~inner[1:]  # neither first nor last of its text
    line = lone & (buf[:n] == 10)
    first = inner[:n] | (lone & (buf[:n] == 32)) | line
    first[1:] |= line[:-1]
    kind = classes(buf)[:n]
    first[1:] |= (kind[:-1] == LETTER_C) & ((kind[1:] == DIGIT_C) | (kind[1:] == SYMBOL_C))  # a letter run ends
    starts = np.flatnonzero(first)
    return buf, starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, off)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, "text", 8 << 20):
            ids, off = own.encode(batch.column("text"))
            back = [own.decode(ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return _columns(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes, digested where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches, "text", 8 << 20):
            ids, off = own.encode(batch.column("text"))
            ids = ids.astype("<u4")
            rows = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows]),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in rows]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
