"""Top-k search, vector codes and alignment of tokenizers against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from pulsegrid.llm import alignment, codes, topk, vectors

VECTORS = "vec_id long, embedding array<float>, label int, v string, entry int, block int"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def floors(vector, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in vector]


def kept(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


@pytest.fixture(scope="module")
def rows():
    """Clusters, a vector of a third of all rows, nulls, odd components, short vectors, repeated and null ids."""
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 0.3, (12, 16))
    out = [(i, (centre[i % 12] + rng.normal(0, 0.05, 16)).tolist(), [None, 1, 2][i % 3]) for i in range(700)]
    out += [(1000 + i, centre[0].tolist(), 7) for i in range(300)]
    inf, nan = float("inf"), float("nan")
    out += [(2000, None, 1), (2001, [], 2), (2002, [1.0, None], 1), (2003, [nan] * 16, 1), (2004, [inf] * 16, None), (2050, [0.5] * 5, 1), (2100, [0.0] * 16, 2), (None, centre[1].tolist(), 1), (None, centre[2].tolist(), 1), (50, centre[3].tolist(), 2), (50, centre[3].tolist(), 2)]
    return out


@pytest.fixture(scope="module")
def embeddings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(5)


def best_by_hand(rows, every, k):
    x = [(i, floors(v, 256)) for i, v, _ in kept(rows)]
    out = []
    for q, a in x:
        if q is not None and q % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(a, b, strict=False)), i is None, i or 0) for i, b in x if i is None or i != q)[:k]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scored, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("block", "slab"), [(topk.BLOCK, topk.SLAB), (90, 7)])
def test_top_k(embeddings, rows, monkeypatch, block, slab):
    """One block, and many blocks and slabs; blocks whose vectors are all alike too."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLAB", slab)
    got = topk.best(embeddings, every=50, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == best_by_hand(rows, 50, 5)


def test_top_k_leaves_members_in():
    """Candidates hold the best whatever the signs, ties and sizes; on clusters reading stops before the end."""
    rng = np.random.default_rng(8)
    for n, width, high in ((1, 3, 5), (4, 1, 9), (200, 6, 3), (500, 16, 400), (900, 16, 1)):
        x = rng.integers(-high, high + 1, (n, width))
        index = topk.Index.of(x)
        assert sorted(index.postings[: index.starts[np.searchsorted(index.dims, 1)]].tolist()) == list(range(n))
        for q in (*x[:5], np.zeros(width, int), -x[0]):
            own = np.arange(n) == 0
            at, score = index.candidates(q, own, 3)
            want = sorted((x @ q)[~own].tolist(), reverse=True)[:3]
            assert sorted(score.tolist(), reverse=True)[:3] == want and not own[at].any() and (score == x[at] @ q).all()
            assert {*np.flatnonzero(~own & (x @ q >= (want or [0])[-1])).tolist()} <= {*at.tolist()}
    x = (rng.normal(0, 1, (40, 32))[rng.integers(0, 40, 4000)] * 100 + rng.normal(0, 3, (4000, 32))).astype(int)
    assert len(topk.Index.of(x).candidates(x[0], np.arange(4000) == 0, 5)[0]) <= 4000 // topk.FEW


def test_top_k_of_few(spark, embeddings):
    assert topk.best(embeddings.where("vec_id > 9999")).count() == 0
    assert topk.best(embeddings.where("vec_id IN (1, 2)")).count() == 0
    assert [tuple(r) for r in topk.best(embeddings.where("vec_id IN (2050, 2100)")).orderBy("query_id").collect()] == [(2050, 1, 2100, 0), (2100, 1, 2050, 0)]
    huge = spark.createDataFrame([(50, [1e6], 1, "x", 1, 2)], VECTORS)
    with pytest.raises(Exception, match="in magnitude"):
        topk.best(huge).collect()


def codes_by_hand(rows):
    own = [(i, floors(v, 1024), label) for i, v, label in kept(rows)]
    width = -(-max((len(v) for _, v, _ in own), default=0) // 4) * 4
    own = [(i, v, np.array(v + [0] * (width - len(v)), np.int64).reshape(4, -1), label) for i, v, label in own]
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [np.array([r[2][p] for r in first]) for p in range(4)]
    for turn in range(5):
        near = [[int(((book - r[2][p]) ** 2).sum(1).argmin()) for r in own] for p, book in enumerate(books)]
        if turn < 4:
            for p, book in enumerate(books):
                for e in set(near[p]):
                    book[e] = sum(r[2][p] for r, n in zip(own, near[p], strict=True) if n == e) // near[p].count(e)
    error = [sum(int(((books[p][near[p][i]] - r[2][p]) ** 2).sum()) for p in range(4)) for i, r in enumerate(own)]
    labels = collections.Counter()
    for r, e in zip(own, error, strict=True):
        labels[r[3]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return collections.Counter((r[0], "".join(f"{near[p][i]:02x}" for p in range(4)), error[i], labels[r[3]], sha) for i, r in enumerate(own))


def test_codes(embeddings, rows):
    got = codes.compressed(embeddings)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == codes_by_hand(rows)


def test_codes_of_few(embeddings, rows):
    for low, high in ((0, 20), (2001, 2001), (2050, 2050)):
        own = [r for r in rows if r[0] is not None and low <= r[0] <= high]
        got = codes.compressed(embeddings.where(f"vec_id BETWEEN {low} AND {high}"))
        assert collections.Counter(map(tuple, got.collect())) == codes_by_hand(own) and got.count() == len(kept(own))
    assert codes.compressed(embeddings.where("vec_id > 9999")).count() == 0


def test_bounds_are_bounds():
    """Every level's points are no farther apart than the vectors; the nearest entry is exact, ties to the first."""
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 16, 20):
        for spread in (1, 3, 2**20):
            x, book = (rng.integers(-spread, spread + 1, (n, width)) for n in (60, 40))
            book[7] = book[3]
            x[0], x[1] = book[3], spread
            true = ((x[:, None, :] - book) ** 2).sum(2)
            a, b = codes.Sketch(x), codes.Sketch(book)
            assert all((codes.distances(p, q) <= true).all() for p, q in zip(a.points, b.points, strict=True))
            entry, least = codes.nearest(x, b)
            assert (entry == true.argmin(1)).all() and (least == true.min(1)).all()


def test_integers(embeddings, rows):
    got = vectors.integers(embeddings, 256, "label").collect()
    assert sorted((r.vec_id or -1, r.v) for r in got) == sorted((i or -1, floors(v, 256)) for i, v, _ in kept(rows))


ALPHABET = ["a", "b", "foo", "the", "ing", " ", "  ", "   ", "\n", "\t", " ", "　", "\x85", "\x1c", ".", ",", "!?", "é", "日本", "語", "😀", "x́", "'s", "<|endoftext|>", "<s>", "12", "3", "<0x41>", "\r\n", "{", "\x00", "​", "İ", "ß", "▁"]


def tokens_by_hand(text):
    """Ids and bytes of a whole text, from the libraries themselves."""
    import sentencepiece
    import tokenizers

    if "a" not in LIBRARIES:
        LIBRARIES["a"] = tokenizers.Tokenizer.from_file(A)
        LIBRARIES["a"].encode_special_tokens = True
        LIBRARIES["b"] = sentencepiece.SentencePieceProcessor(model_file=B)
        LIBRARIES["names"] = alignment.letters(A)[0], alignment.spelt(LIBRARIES["b"])
    a, b = LIBRARIES["a"].encode(" " + text, add_special_tokens=False).ids, LIBRARIES["b"].encode(text)
    whole = (" " + text).encode()
    x, y = ([names[i] for i in ids] for ids, names in zip((a, b), LIBRARIES["names"], strict=True))
    return ([*zip(a, map(len, x), strict=True)], [*zip(b, map(len, y), strict=True)]) if text and b"".join(x) == whole == b"".join(y) else ([], [])


LIBRARIES = {}


def aligned_by_hand(texts):
    held, docs = collections.Counter(), []
    for text in texts:
        sides = tokens_by_hand(text or "")
        reach = [list(np.cumsum([n for _, n in s])) for s in sides]
        ends = sorted({*reach[0]} & {*reach[1]})
        parts = [[[i for (i, _), e in zip(s, r, strict=True) if low < e <= high] for low, high in zip([0, *ends], ends, strict=False)] for s, r in zip(sides, reach, strict=True)]
        links = [(p, q) for g, h in zip(*parts, strict=True) for p in g for q in h]
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in zip(*parts, strict=True))
        docs.append((len(sides[0]), len(sides[1]), len(ends), links, hashlib.sha256(shown.encode()).hexdigest() if links else ""))
        held.update(set(links))
    most = {}
    for (p, _), n in held.items():
        most[p] = max(most.get(p, 0), n)
    return [(a, b, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha) for a, b, g, links, sha in docs]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    out += [None, "", " ", "  ", "a ", "▁x", "the cat sat. " * 40, "x" * 4000, "日本語テスト" * 200, "the cat sat. " * 40, "\n\n the\n  end"]
    return out + ["the the, cat sat on a mat"] * 150


@pytest.mark.parametrize(("shares", "large"), [(alignment.SHARES, alignment.LARGE), (10**9, 1), (3, 2)])
def test_alignment(spark, texts, monkeypatch, shares, large):
    """All pairs hot, none hot, and some hot; groups counted or listed. Ids repeat and are null."""
    monkeypatch.setattr(alignment, "SHARES", shares)
    schema = "doc_id long, text string, pair long, row long, links int, n int, n_a int"
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in zip(ids, texts, strict=True)], schema).repartition(3)
    got = alignment.align(docs, A, B)
    want = collections.Counter((i, *r) for i, r in zip(ids, aligned_by_hand(texts), strict=True))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert alignment.align(docs.where("doc_id < -1"), A, B).count() == 0


def test_large_groups_are_counted(texts, monkeypatch):
    """The tokens of a group are multiplied by hand, whether listed or counted."""
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([f" {t}" if t else None for t in texts])], names=["doc_id", "text"])
    out = []
    for large in (alignment.LARGE, 1):
        monkeypatch.setattr(alignment, "LARGE", large)
        out.append([r for b in alignment.postings_of(A, B)(iter([batch])) for r in b.to_pylist()])
    assert out[0] == out[1] and sum(len(r["links"]) for r in out[0]) > 1000


def test_vocabulary_must_be_ranked(tmp_path):
    import json

    with open(A, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "a.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order of its merges"):
        alignment.Aligner(str(tmp_path / "a.json"), B)
