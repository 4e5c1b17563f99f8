"""The ten operators against brute force, on hand-made tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import byte_bpe, components, debruijn, fingerprints, katz, line_rules, near_duplicates, packing, queries, rule_ensemble, sharding, transducer, words

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own string, key long, copy int, words string, block int"

ODD = [
    None, "", " ", "a", "  a b ", "a\n\nb", "\tx", "İstanbul ẞ ΑΣ. σ", "it's they'll 12 3a4 don'T", "é x́ ﬁ①", "<|endoftext|> hi<|startoftext|>x<s>", "日本語 テスト 😀😀", "a▁b ▁c", "\r\nab\r\n",
    "x" * 3000, "aaaa" * 30 + " bbbb", "a\x1cb\x85c  d", "a,b. c., d..", "a  b   c ", "\n", "trail \n", " lead",
]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 5000)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 250, 60)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(10)]
    base = prose(rng, 200).split(" ")
    for k in range(15):
        own = list(base)
        for at in rng.integers(0, len(own), k):
            own[at] = f"edit{k}-{at}"
        texts.append(" ".join(own))
    texts += [texts[5]] * 6 + ["up down " * 200, "Home | News | Sport | Mail\n" * 30, prose(rng, 9000)] + ODD
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 2, "y", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_windows_and_hashes():
    buf, starts, ends, off = words.words(pa.array(["ab cd  ab", None, "x"]))
    h = words.hashes(buf, starts, ends)
    assert off.tolist() == [0, 3, 3, 4] and h[0] == h[2] != h[1]
    h = np.arange(100, dtype=np.uint64) % np.uint64(7)
    for k in (1, 2, 3, 5, 13, 20):
        got = words.windows(words.mix(h), k)
        same = {}
        for i in range(len(got)):
            same.setdefault(tuple(h[i : i + k]), set()).add(int(got[i]))
        assert len(got) == 101 - k and all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def katz_by_hand(texts, order):
    """The counts of all orders, and P(w | h) by the definition, summing over all words."""
    tokens = {k: [w.translate(LOW) for w in split(t)] + ["</s>"] for k, t in texts.items()}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 10 == 0}
    counts = [collections.Counter() for _ in range(order + 1)]
    for k, x in tokens.items():
        padded = ["<s>"] * (order - 1) + x
        if k not in held:
            for i in range(order - 1, len(padded)):
                for m in range(1, order + 1):
                    counts[m][tuple(padded[i - m + 1 : i + 1])] += 1
    d = [None, *(katz.discounts([sum(1 for x in counts[m].values() if x == r) for r in range(1, 7)]) for m in range(1, order + 1))]
    follow = collections.defaultdict(dict)
    for m in range(2, order + 1):
        for g, c in counts[m].items():
            follow[g[:-1]][g[-1]] = c
    cut = lambda c, m: (d[m][c] if c <= 5 else 1.0) * c
    n = sum(counts[1].values())
    spared = n - sum(cut(c, 1) for c in counts[1].values())
    cache = {}

    def p(h, w):
        if (h, w) not in cache:
            m = len(h) + 1
            if m == 1:
                whole = n + (spared < 1e-12)
                cache[h, w] = cut(counts[1][w,], 1) / whole if (w,) in counts[1] else (spared if spared > 1e-12 else 1.0) / whole
            elif h not in follow:
                cache[h, w] = p(h[1:], w)
            else:
                whole = sum(follow[h].values()) + all(c > 5 for c in follow[h].values())
                cache[h, w] = cut(follow[h][w], m) / whole if w in follow[h] else weight(h) * p(h[1:], w)
        return cache[h, w]

    def weight(h):
        if ("weight", h) not in cache:
            cache["weight", h] = (1 - sum(p(h, w) for w in follow[h])) / (1 - sum(p(h[1:], w) for w in follow[h]))
        return cache["weight", h]

    return tokens, held, counts, follow, p, weight, n


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("hot", [500_000, 20])
def test_op1_katz(docs, texts, none, monkeypatch, order, hot):
    if hot == 20 and order in (1, 4):
        return
    monkeypatch.setattr(katz, "HOT", hot)  # small: many histories are parted
    monkeypatch.setattr(katz, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(katz, "BLOCK_BYTES", 30_000)
    tokens, held, counts, follow, p, _, n = katz_by_hand(texts, order)
    for h in [(), *list(follow)[:10], *list(follow)[-10:]]:  # probabilities sum to 1, a new word among them
        assert sum(p(h, w) for (w,) in counts[1]) + p(h, "never seen") == pytest.approx(1)
    got = {r.doc_id: r for r in katz.score(docs, order).collect()}
    assert len(got) == len(texts)
    for k, x in tokens.items():
        r, padded = got[k], ["<s>"] * (order - 1) + x
        assert r.held_out == (k in held) and r.train_tokens == n and r.n_tokens == len(x) and r.n_known == sum((w,) in counts[1] for w in x)
        assert r.base_score == pytest.approx(sum(math.log10((counts[1][w,] + 0.1) / (n + 0.1 * (len(counts[1]) + 1))) for w in x))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(x)), rel=1e-9)
    assert katz.score(none, order).count() == 0


def test_op1_tables(docs, texts):
    _, _, counts, follow, _, weight, _ = katz_by_hand(texts, 3)
    model = katz.fit(docs)
    for m in (1, 2, 3):
        got = collections.Counter(r.n for r in model.grams[m - 1].select("n").collect())
        assert got == collections.Counter(counts[m].values())
    for m in (2, 3):
        got = np.array(sorted((r.n, round(r.weight, 9)) for r in model.weights(m).collect()))
        assert np.allclose(got, np.array(sorted((sum(f.values()), round(weight(h), 9)) for h, f in follow.items() if len(h) == m - 1)))


def test_op1_rows_of_grams_leave_few_columns_null(docs):
    """Every n-gram has a row, and pays for each column of it."""
    for m, table in enumerate(katz.fit(docs).told, 2):
        heads = [f"h{i}" for i in range(1, m)]
        assert set(table.columns) == {"kind", "bucket", "block", *heads, "word", "n", "a", "b", "c"}
        row = table.where(F.col("kind") == katz.GRAMS).first().asDict()
        assert {c for c, x in row.items() if x is None} == {"block", "a", "b", "c"}


def test_op1_leaves_no_table_in_the_catalogue(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    got = katz.score(docs)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert got.count() == docs.count() and "Bucketed: true" in got._jdf.queryExecution().executedPlan().toString()


def test_op2_lines(spark, docs, texts, none):
    got = {r.doc_id: r for r in line_rules.verdicts(docs).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        w, r = split(t), got[k]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    kept = line_rules.clean(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert line_rules.clean(none).count() == 0
    plan = line_rules.clean(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op2_lines_by_hand(spark):
    bad = ["Mentions légales de la page", "alle Rechte vorbehalten.", "Haga clic aquí ahora mismo.", "Read More about us here.", "un café", "Ωμέγα  ", "Меню", "a | b | c", "# % $ & oh", "wow!!!! what", "x" * 201 + " copyright | x"]
    good = ["", " \t ", "A plain line that ends in letters", "Le café.", "日本語の行", "(a)", "x" * 201 + " copyright. It is long, so it stays", "one two three four \r", "No way! No!"]
    lines = spark.createDataFrame([(x,) for x in bad + good], "line string")
    got = {r.line: r.bad for r in lines.select("line", line_rules.bad_line(F.col("line")).alias("bad")).collect()}
    assert [x for x in bad if not got[x]] == [] and [x for x in good if got[x]] == []


#: Prose that mentions what site furniture says, in four languages, and furniture itself.
PROSE = [
    "The catalog in the great hall was old and rarely used by anyone at all.", "She spoke of copyright law for an hour, and nobody asked a question.", "They read more slowly than before, and share this habit with others.",
    "Das Impressum der Zeitung wurde 1890 zum ersten Mal gedruckt, wie man sagt.", "Wir wollten weiterlesen, doch das Licht ging aus.", "Il faut lire la suite de ce roman pour comprendre la fin de l'histoire.", "Quiero leer más libros este año, dijo ella mientras cerraba la puerta.",
    "You must log in to see the list of members who voted last year.", "« Bonjour » dit-il, « et bonne nuit ».", "He or she / it or they, as the case may be.", "Either 5 / 6 or more of them came.", "The road ran north – and then it ended.", "The bridge, licensed under the old law, fell in 1921.", "The company copyright notices of 1950 were long and full of words.",
]
FURNITURE = [
    "Home » News » Sport » Mail", "• Home • About • Contact •", "Start / Über uns / Kontakt / Impressum", "Inicio › Noticias › Deportes › Correo", "Accueil → Actualités → Sport", "Log in · Sign up · Privacy policy", "log in sign up", "Click here to read more!",
    "Impressum - Datenschutzerklärung.", "Politique de confidentialité, mentions légales.", "Leer más / iniciar sesión.", "Copyright 2021 Example Ltd, London.", "© 2020 by the authors.", "Copyright (c) 1999 A. Nobody.", "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person.", "Example Ltd. All rights reserved.",
]


def test_op2_furniture_and_prose(spark):
    """Phrases inside words and in prose don't fail a line; lines that are made of them, or of items between signs, do.
    DuckDB's SQL says the same of each."""
    import duckdb

    found = spark.createDataFrame([(x,) for x in PROSE + FURNITURE], "line string").select("line", line_rules.bad_line(F.col("line")).alias("bad")).collect()
    got = {r.line: r.bad for r in found}
    assert [x for x in PROSE if got[x]] == [] and [x for x in FURNITURE if not got[x]] == []
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(PROSE + FURNITURE)))
    lost = {PROSE[i] if i < len(PROSE) else FURNITURE[i - len(PROSE)]: n > 0 for i, n in con.execute(f"SELECT doc_id, lost_chars FROM ({line_rules.sql()})").fetchall()}
    assert lost == got


def test_op3_rules(spark, docs, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = rule_ensemble.fit(d, labels, trees=4)
    assert 0 < len(model.weights) < 80
    rows = rule_ensemble.scored(d, model).select("own.doc_id", "score").join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.93
    every = rule_ensemble.scored(docs, model).select("score").collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    kept = rule_ensemble.keep(docs, model)
    assert kept.columns == docs.columns and rule_ensemble.keep(none, model).count() == 0
    assert rule_ensemble.fit(d, labels.where("quality = 7")).weights == ()


def test_op3_scores_by_hand(spark, docs):
    """Every score from the fitted rules and weights, evaluated row by row in Python."""
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, labels, trees=3)
    assert model.weights
    stats = rule_ensemble.statistics(docs).select("own.doc_id", *rule_ensemble.FEATURES).collect()
    got = {r.doc_id: r.score for r in rule_ensemble.scored(docs, model).select("own.doc_id", "score").collect()}
    assert len(got) == len(stats)
    for r in stats:
        holds = [all((lo is None or r[n] > lo) and (hi is None or r[n] <= hi) for n, lo, hi in rule.bounds) for rule, _ in model.weights]
        total = model.intercept + sum(w for (_, w), yes in zip(model.weights, holds) if yes)
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in stats:
        w, dense, lines = split(texts[r.doc_id]), "".join(split(texts[r.doc_id])), [x for x in texts[r.doc_id].split("\n") if split(x)]
        share = lambda a, b: a / b if b else 0.0
        assert (r.n_words, r.word_length, r.line_words) == pytest.approx((len(w), share(len(dense), len(w)), share(len(w), len(lines))))
        assert (r.distinct_words, r.distinct_lines, r.digits) == pytest.approx((share(len(set(w)), len(w)), share(len(set(lines)), len(lines)), share(sum(c in "0123456789" for c in dense), len(dense))))


def test_op3_sample_is_read_in_all_tasks(spark, docs, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(rule_ensemble, "cut", seen)
    rule_ensemble.fit(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert len(plans) == 1 and "Coalesce" not in plans[0] and "RoundRobinPartitioning(4)" in plans[0]


def brute_spans(texts, k):
    seen, out = set(), {}
    w = {d: split(t) for d, t in texts.items()}
    for d in sorted(w):
        for i in range(len(w[d]) - k + 1):
            g = tuple(w[d][i : i + k])
            if g in seen:
                out.setdefault(d, set()).update(range(i, i + k))
            seen.add(g)
    return w, out


def test_op4_debruijn(docs, texts, none):
    w, gone = brute_spans(texts, 20)
    got = {r.doc_id: r for r in debruijn.removed(docs).collect()}
    assert len(got) == len(texts) and sum(map(len, gone.values())) > 500
    for d, x in w.items():
        kept = " ".join(y for i, y in enumerate(x) if i not in gone.get(d, ()))
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(x), len(gone.get(d, ())), hashlib.sha256(kept.encode()).hexdigest())
    out = debruijn.strip(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: split(r.text) for r in out.collect()} == {d: [y for i, y in enumerate(x) if i not in gone.get(d, ())] for d, x in w.items()}
    assert debruijn.removed(none).count() == 0 == debruijn.strip(none).count()


@pytest.mark.parametrize("bits", [2, 8])
def test_op4_shared_hashes(docs, texts, bits):
    w, gone = brute_spans(texts, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.removed(docs, bits=bits).collect()}
    kept = {d: " ".join(y for i, y in enumerate(x) if i not in gone.get(d, ())) for d, x in w.items()}
    assert got == {d: (len(x), len(gone.get(d, ())), hashlib.sha256(kept[d].encode()).hexdigest()) for d, x in w.items()}


def test_op4_repeated_ids(spark):
    text = " ".join(map(str, range(30)))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (0, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in debruijn.removed(rows).collect())
    assert got == [(False, 0), (False, 30), (False, 30), (True, 0)]


def test_op4_keeps_line_breaks(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [f"one two\n{passage}\nthree", f"  para one\n\n{passage}\npara  two\n", passage, f"{passage} end", f"start\t{passage}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in debruijn.strip(rows).collect()}
    assert got == {0: texts[0], 1: "  para one\n\npara  two\n", 2: "", 3: " end", 4: "start\t"}


def test_op5_packing(docs, texts, none):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(packing.pack(docs, P.path("word_bpe_49k.json")).collect(), key=lambda r: (r.doc_id, r.piece))
    want, total = [], 0
    for d in sorted(texts):
        ids = np.array([*t.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want += [(d, i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for i, s in enumerate(range(0, len(ids), 4096))]
    assert [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got] == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-total // 4096) + 1
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0


def test_op5_other_tokenizers_are_refused(tmp_path):
    import json

    spec = json.loads(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert packing.checked(spec) is spec
    level = spec["pre_tokenizer"]["pretokenizers"][1]
    for change in (
        {"model": spec["model"] | {"end_of_word_suffix": None}}, {"model": spec["model"] | {"dropout": 0.1}}, {"normalizer": None}, {"normalizer": spec["normalizer"] | {"normalizers": spec["normalizer"]["normalizers"][:2]}},
        {"pre_tokenizer": None}, {"pre_tokenizer": level}, {"truncation": {"max_length": 4}}, {"added_tokens": [spec["added_tokens"][0] | {"content": "x"}]},
    ):
        with pytest.raises(ValueError, match="must have"):
            packing.checked(spec | change)
    with pytest.raises(ValueError, match="must have"):
        packing.WordIds(P.path("byte_bpe_50k.json"))


def test_op5_slices_without_text(spark):
    import tokenizers

    path = P.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    for texts in ([None, "", None], [" \n", "", None], ["ab cd " * 1_400_000, ""]):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack(rows, path).select("doc_id", "piece", "length", "ids_crc32").collect())
        each = [np.array([*(t.encode(x[:6], add_special_tokens=False).ids * (len(x) // 6) if x and x.strip() else []), 1], "<u4") for x in texts]
        assert got == [(d, i, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for d, ids in enumerate(each) for i, s in enumerate(range(0, len(ids), 4096))]


def test_op5_memory_of_a_task(texts):
    """A batch of 16 MB becomes ids in slices whose arrays stay below 250 MB, with the ids of each text alone."""
    import tracemalloc

    path, few = P.path("word_bpe_49k.json"), [t for t in texts.values() if len(t) < 3000]
    many = 1 + (16 << 20) // sum(len(t.encode()) for t in few)
    rows = pa.record_batch([pa.array(range(many * len(few)), pa.int64()), pa.array(few * many)], ["doc_id", "text"])
    want = next(packing.cut_pieces(path, 1, 4096)(iter([rows.slice(0, len(few))]))).column("ids_crc32").to_pylist()
    tracemalloc.start()
    got = [x for b in packing.cut_pieces(path, 1, 4096)(iter([rows])) for x in b.column("ids_crc32").to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want * many and most < 250e6, most


@pytest.mark.parametrize("seed", range(5))
def test_op5_plan_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100, 400).tolist()
    rooms = []
    for x in sorted(lengths, reverse=True):  # best fit, one by one
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(100 - x)
    slots = packing.plan(dict(collections.Counter(lengths)), 100)
    used = collections.defaultdict(list)
    for length, rank, n, first, each, at in slots:
        for r in range(n):
            used[first + r // each].append((at + length * (r % each), length))
    assert len(used) == len(rooms) and sum(map(len, used.values())) == len(lengths)
    for rows in used.values():
        rows.sort()
        assert [a for a, _ in rows] == [sum(y for _, y in rows[:i]) for i in range(len(rows))]


def brute_ring(sizes, cells_of, shards, virtual, slack):
    """Each cell in turn, shard by shard clockwise, by the definition."""
    import xxhash

    arcs = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> (64 - sharding.CELL_BITS), s) for s in range(shards) for v in range(virtual))
    bytes_of = collections.Counter()
    for d, c in cells_of.items():
        bytes_of[c] += sizes[d]
    load, out = [0] * shards, {}
    most = -(-sum(sizes.values()) // shards) * (1 + slack)
    for c in sorted(bytes_of, key=lambda c: (-bytes_of[c].bit_length(), xxhash.xxh64_intdigest(str(c)), c)):
        turn = [s for at, s in arcs if at >= c] + [s for at, s in arcs if at < c]
        fit = [s for s in turn if load[s] + bytes_of[c] <= most]
        out[c] = fit[0] if fit else load.index(min(load))
        load[out[c]] += bytes_of[c]
    assert max(load) <= max(most, sum(sizes.values()) / shards + max(bytes_of.values()))
    return {d: out[c] for d, c in cells_of.items()}


def test_op6_sharding(docs, texts, none):
    got = sharding.shard(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    for s in range(16):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    text = F.coalesce("text", F.lit(""))
    cells = {r.doc_id: r.c >> (64 - sharding.CELL_BITS) for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), text).cast("decimal(38,0)").alias("h")).selectExpr("doc_id", "h + if(h < 0, 18446744073709551616BD, 0BD) AS c").collect() for r in [type(r)(doc_id=r.doc_id, c=int(r.c))]}
    want = brute_ring({d: len(t.encode()) + 1 for d, t in texts.items()}, cells, 16, 256, 0.001)
    assert {r.doc_id: r.shard for r in got} == want
    assert sharding.shard(none).count() == 0


def test_op6_one_id(spark):
    rows = spark.createDataFrame([(7, f"text {i % 2000}") for i in range(6000)] + [(None, None)] * 3000, "doc_id long, text string").repartition(8)
    got = sharding.shard(rows).collect()
    assert len(got) == 9000
    load = collections.Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) <= sum(load.values()) / 16 + 3000
    for s in range(16):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


@pytest.mark.parametrize(("n", "most"), [(1_000, 0.15), (40_000, 0.1)])
def test_op6_balance_and_movement(n, most):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << sharding.CELL_BITS, n)
    cells = {}
    for k, x in zip(keys.tolist(), np.exp(rng.normal(7, 1, n)).astype(int).tolist()):
        cells[k] = (cells.get(k, (0, 0))[0] + x, 1)
    spread = []
    for shards in (16, 17):
        at, load = sharding.place(cells, shards, 256, 0.001), collections.Counter()
        for c, s in at.items():
            load[s] += cells[c][0]
        mean = sum(load.values()) / shards
        assert max(load.values()) <= max(mean * 1.001 + 1, mean + max(b for b, _ in cells.values()))
        spread.append(at)
    moved = sum(cells[c][0] for c in cells if spread[0][c] != spread[1][c]) / sum(b for b, _ in cells.values())
    assert 1 / 17 * 0.9 < moved < most


def test_op7_bpe(docs, texts, none):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.digests(docs, path, P.PATTERN).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    for r in byte_bpe.encoded(docs.where("doc_id % 7 = 0"), path, P.PATTERN).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()
    assert byte_bpe.digests(none, path, P.PATTERN).count() == 0


def brute_components(texts, k):
    w = {d: split(t.translate(LOW)) for d, t in texts.items()}
    sets = {d: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if len(x) >= k else {tuple(x)} if x else set() for d, x in w.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sets, {d: find(d) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_op8_near_duplicates(docs, texts, none, k):
    sets, want = brute_components(texts, k)
    got = {r.doc_id: r for r in near_duplicates.groups(docs, near_duplicates.Scheme(words=k)).collect()}
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}
    if k == 5:
        kept = near_duplicates.keep(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d in want if want[d] == d}
        assert near_duplicates.groups(none).count() == 0


def test_op8_pairs_beyond_the_signature_distance():
    sig, fine = np.zeros((2, 80), np.uint8), np.zeros((2, 128), np.uint8)
    sig[1, 5:45] = 1  # 40 of 80 differ, the first band agrees
    fine[1, :19] = 255  # 152 of 1024 differ
    rows = pa.table({
        "key": [0, 0], "i": [0, 0], "j": [0, 0], "m": [False, False], "right": [False, False], "node": [7, 9], "n": [100, 90], "component": [7, 9],
        "signature": [x.tobytes() for x in sig], "fine": [x.tobytes() for x in fine],
    })
    assert near_duplicates.sifted(rows, near_duplicates.Scheme()).to_pylist() == [{"gid": "0-0-0-False", "nodes": [7, 9], "x": [0], "y": [1]}]
    assert near_duplicates.sifted(rows, near_duplicates.Scheme(), one=True).to_pylist() == [{"a": 7, "b": 9, "far": 152}, {"a": 9, "b": 7, "far": 152}]
    assert near_duplicates.Scheme(similarity=70).fine_distance > 1024 * 0.15 + 5 * (1024 * 0.15 * 0.85) ** 0.5
    with pytest.raises(ValueError):
        near_duplicates.Scheme(similarity=50)


def test_op8_no_sift_within_the_signature_distance():
    for n, found in ((31, 1), (32, 0)):
        sig, fine = np.zeros((2, 80), np.uint8), np.zeros((2, 128), np.uint8)
        sig[1, 80 - n :] = 1  # the first band agrees
        fine[1, :60] = 255  # 480 of 1024 differ: the finer signature alone would drop the pair
        rows = pa.table({
            "key": [0, 0], "i": [0, 0], "j": [0, 0], "m": [False, False], "right": [False, False], "node": [7, 9], "n": [100, 90], "component": [7, 9],
            "signature": [x.tobytes() for x in sig], "fine": [x.tobytes() for x in fine],
        })
        assert near_duplicates.sifted(rows, near_duplicates.Scheme()).num_rows == found


def test_op8_groups_are_joined_once():
    asked = []
    links = near_duplicates.joining([(0, 1), (1, 2), (0, 2), (3, 4), (2, 3)], lambda x, y: asked.append((x, y)) or (x, y) != (3, 4))
    assert links == [(0, 1), (1, 2), (2, 3)] and asked == [(0, 1), (1, 2), (3, 4), (2, 3)]


def test_op8_keep_repeated_rows(spark):
    rng = np.random.default_rng(5)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = spark.createDataFrame([(1, one, 0, 0), (1, one, 0, 0), (None, two, 0, 0), (None, two, 0, 0), (3, one + " more", 0, 0), (4, None, 0, 0)], "doc_id long, text string, kept_id long, `a.b` int")
    got = near_duplicates.keep(rows)
    assert got.columns == rows.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 4]


@pytest.mark.parametrize("k", [4, 5])
def test_op8_recall_on_generated_documents(spark, k):
    """Against an exact join: all pairs that share a shingle, and their similarity, on real documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: r.text or "" for r in docs.collect()}
    w = {d: split(t.translate(LOW)) for d, t in own.items()}
    sets = {d: frozenset(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) if len(x) >= k else frozenset([tuple(x)] if x else []) for d, x in w.items()}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    shared = collections.Counter((a, b) for ds in holders.values() if len(ds) > 1 for i, a in enumerate(ds) for b in ds[i + 1 :])
    links = {(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    got = {r.doc_id: r.component_id for r in near_duplicates.groups(docs, near_duplicates.Scheme(words=k)).collect()}
    assert links and all(got[a] == got[b] for a, b in links)
    root = {d: d for d in own}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in sorted(links):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {d: find(d) for d in own}


def test_op8_components(spark):
    rng = np.random.default_rng(0)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))} | {(i, i + 1) for i in range(1000, 1060)}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_op9_fingerprints(spark, docs, texts, none):
    import regex
    import xxhash

    canon = lambda s: regex.sub(r"[\t-\r\p{Z}]+", " ", unicodedata.normalize("NFKC", s).lower()).strip(" ")
    seeds = [r.h % 2**64 for r in spark.sql("SELECT xxhash64(x) AS h FROM VALUES (1), (2) AS t(x)").collect()]
    digest = lambda s: "".join(f"{xxhash.xxh64_intdigest(canon(s).encode(), seed=x):016x}" for x in seeds)
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(texts)
    for i, d in enumerate(order):
        t, after = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(t), digest(edited)), (t[:40], edited[:40])
        assert (r.near_edited, r.near_next) == (float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
    assert fingerprints.fingerprints(none).count() == 0
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op9_equal_digests_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lpad(F.length(c).cast("string"), 32, "0"))  # a weak one
    rows = spark.createDataFrame([(1, "ab"), (2, "AB "), (3, "cd"), (4, "xyz"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprints(rows).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    # 4 is edited to "xyc", which collides with "xyz"
    assert got[4].fingerprint != got[4].edited_fingerprint and len(got[5].fingerprint) == 32


@pytest.mark.parametrize("many", [10_000])
def test_op9_many_rows_of_one_id(spark, many):
    rows = spark.range(many).select(F.lit(3).cast("long").alias("doc_id"), F.lit("Same Text").alias("text"))
    got = fingerprints.fingerprints(rows).groupBy("fingerprint", "near_next").count().collect()
    assert [(r["count"], r.near_next) for r in got] == [(many, 1.0)]


def test_op10_transducer(docs, texts, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for chunk in (65_536, 7):
        for r in transducer.token_counts(docs, P.path("piece_bpe_32k.model"), chunk).collect():
            t = texts[r.doc_id]
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t))), t[:60]
    assert transducer.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0


def test_op10_compiled_pairs_are_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    own = transducer.transducer(P.path("piece_bpe_32k.model"))
    proto = pb.ModelProto()
    proto.ParseFromString(open(P.path("piece_bpe_32k.model"), "rb").read())
    proto.normalizer_spec.add_dummy_prefix = False
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, len(own.tokens), (2, 60_000))
    short = np.flatnonzero(own.sizes <= 3)
    a, b = (np.concatenate((x, rng.choice(short, 60_000))) for x in (a, b))
    spaces = np.array([set(t) == {transducer.SPACE} for t in own.tokens])
    opens = np.array([t.startswith(transducer.SPACE) for t in own.tokens])
    x, y = np.meshgrid(np.flatnonzero(spaces), np.flatnonzero(opens)[::7])
    a, b = np.concatenate((a, x.ravel())), np.concatenate((b, y.ravel()))
    asked = ~opens[b] | spaces[a]
    a, b = a[asked], b[asked]
    got = sp.encode([own.tokens[i] + own.tokens[j] for i, j in zip(a, b)], out_type=str)
    want = np.array([x == [own.tokens[i], own.tokens[j]] for x, i, j in zip(got, a, b)])
    assert (own.compiled(a, b) == want).all() and 0 < want.sum() < len(want)
    assert [own.follows(int(i), int(j)) for i, j in zip(a[::20], b[::20])] == want[::20].tolist()


def test_op10_a_run_of_letters():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = transducer.transducer(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    run = "".join(rng.choice(list("abcdeéilnorstu"), 200_000))
    assert own.one(transducer.SPACE + run) == len(sp.encode(run))


def test_op10_closed_chunks_part_their_neighbours(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["abcwor\nline1\nds", "abcwor\tline1\tds", "abcwor\n\n\n\n\n\n\nds", "abcwor\nline1\n\nline2\nds and", "\nline1\n\nline1\nds"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in transducer.token_counts(rows, P.path("piece_bpe_32k.model"), 7).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_op10_maps_compose_in_any_grouping():
    read = len
    maps = [(True, "a", 2, "b"), (False, "cd", 0, ""), (True, "", 1, "e"), (False, "f", 0, ""), (True, "g", 0, "")]
    left = maps[0]
    for m in maps[1:]:
        left = transducer.compose(left, m, read)
    assert transducer.scan(list(maps), read) == left


def test_op10_real_maps_compose_in_any_grouping(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(transducer, "LONG", 6)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = transducer.transducer(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(8)
    letters = list("abeinorst    \n\tzQX7_é日😀") + ["tion", "www", "   "]
    for _ in range(150):
        text = "".join(rng.choice(letters, 60))
        whole = " " + text
        at = [0, *sorted(set(rng.integers(1, len(whole), 7).tolist())), len(whole)]
        cuts = [whole[x:y] for x, y in zip(at, at[1:])]
        ends = np.arange(len(cuts))
        maps = transducer.state_maps(own, pa.array(cuts), ends == 0, ends == len(cuts) - 1)
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = transducer.shortened(own, transducer.compose(left, m, own.one))
        for m in maps[-2::-1]:
            right = transducer.compose(m, right, own.one)
        totals = {n + own.one(head) + own.one(tail) for _, head, n, tail in (left, right, transducer.scan(list(maps), own.one))}
        assert totals == {len(sp.encode(text))}, text


def test_op10_borders_bound_the_open_ends(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = transducer.transducer(path)
    rng = np.random.default_rng(9)
    run = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 30_000))
    at = own.borders(run)
    assert len(at) > 100 and max(np.diff(at)) < transducer.LONG
    no = np.zeros(1, bool)
    (reset, head, _, tail) = transducer.state_maps(own, pa.array([run]), no, no)[0]
    assert reset and len(head) < transducer.LONG and len(tail) < transducer.LONG
    texts = [run, "a" * 20_000, f"{run[:5000]} b", None, ""]
    rows = spark.createDataFrame([(None if i == 2 else i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    got = sorted(r.n_tokens for r in transducer.token_counts(rows, path, 2_000).collect())
    assert got == sorted([len(sp.encode(t or "")) for t in texts] * 2)


def test_op10_only_texts_of_several_chunks_are_shuffled(spark):
    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = transducer.token_counts(rows, P.path("piece_bpe_32k.model"))._jdf.queryExecution().optimizedPlan().toString()
    first, rest = plan.split("MapInArrow", 1)[1].split("MapInArrow", 1)  # of the union, the texts of one chunk come first
    assert "Aggregate" not in first and "Repartition" not in first and "Aggregate" in rest


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    got, want = (x.sort_values(sorted(x.columns)).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0 and sorted(got.columns) == sorted(want.columns)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c


def test_keys_in_ascending_order():
    """As numpy's sorts, whether or not keys and places fit in one number; n-grams by history, then word."""
    from pulsegrid.llm import blocks

    rng = np.random.default_rng(4)
    for keys in (rng.integers(0, 50, 1000), rng.integers(0, 2**40, 1000), rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.zeros(0, np.int64), np.array([7])):
        order, run = blocks.ascending(keys)
        assert order.tolist() == np.argsort(keys, kind="stable").tolist() and (run == keys[order]).all() and run.dtype == keys.dtype
        assert all((a == b).all() for a, b in zip(blocks.distinct(keys), np.unique(keys, return_index=True, return_inverse=True), strict=True))
        own, bounds = blocks.by_bucket(keys.astype(np.uint64) << np.uint64(33), 7)
        assert np.diff(bounds).sum() == len(keys) and bounds[0] == 0
    names = [rng.integers(0, 9, (2, 40)).astype(np.uint64) for _ in range(3)]
    sizes = [rng.integers(1, 4, 40) for _ in range(3)]
    word = rng.integers(0, 5, sum(int(s.sum()) for s in sizes)).astype(np.uint64)
    history = np.concatenate([np.repeat(h, s, axis=1) for h, s in zip(names, sizes, strict=True)], axis=1)
    assert katz.in_order(names, sizes, word).tolist() == np.lexsort((word, *history[::-1])).tolist()
