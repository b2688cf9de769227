"""Periodic runs, lexical search and language identification against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import re
import zlib
from pyspark.sql import functions as F

from sparkprep.llm import language_id, lexical_search, periodic_runs, queries

DOCS = "doc_id long, text string, lang string, source string, runs string, terms string, word long, score string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "src1", "r", "t", 1, "s") for i, t, lang in rows], DOCS)


ODD = [(1, None, "en"), (2, "", "de"), (None, " \t\n", None), (4, "x " * 40_000, None), (4, "x " * 40_000, None), (5, "y" * 100_000, ""), (6, "日本 語 🎉", "ja"), (7, "12 34 --", "en"), (8, "\x00 a\x0bb", "en")]

# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    texts = []
    for _ in range(400):
        kinds = rng.choice([1, 2, 3, 5, 50])
        words = [str(rng.randrange(kinds)) for _ in range(rng.randint(0, rng.choice([15, 60, 150])))]
        for _ in range(rng.randint(0, 3)):
            if len(words) > 6:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 2))
                for i in range(a, rng.randint(a, len(words))):
                    words[i] = words[a + (i - a) % p]
        texts.append(words)
    got = periodic_runs.find([rng.choice([" ", "\n\t", "  "]).join(w) for w in texts], least)
    for words, (n, runs, rest) in zip(texts, got):
        want = brute_runs(words, least)
        assert n == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in runs] == want
        assert rest == collapsed(words, want)


def test_every_symbol_derives_its_words():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 500)
    stretch = np.repeat(np.arange(5), 100)
    g = periodic_runs.Grammar(ids, stretch)
    derive = lambda x: [x] if x < g.words else derive(g.left[x - g.words]) + derive(g.right[x - g.words])
    assert [w for x in g.symbols.tolist() for w in derive(x)] == ids.tolist()
    for k, begin in enumerate(g.first.tolist()):
        words = derive(g.words + k)
        assert words == ids[begin : begin + len(words)].tolist() and len(words) == g.size[g.words + k]
    pairs = Counter(p for p in zip(g.symbols[:-1].tolist(), g.symbols[1:].tolist(), g.stretch[:-1].tolist(), g.stretch[1:].tolist()) if p[2] == p[3] and p[0] != p[1])
    assert max(Counter((a, b) for a, b, _, _ in pairs.elements()).values()) == 1  # no pair is left twice


def test_long_repetitive_texts_stay_cheap():
    x, y = "a", "ab"
    while len(y) < 30_000:
        x, y = y, y + x
    (n, runs, _), (m, one, rest) = periodic_runs.find([" ".join(y), "a " * 100_000])
    assert n == len(y) and len(runs) > 1_000
    assert m == 100_000 and one == [{"start": 0, "length": 100_000, "period": 1}] and rest == "a"


def test_runs_of_odd_rows(spark):
    rows = periodic_runs.find_runs(frame(spark, ODD)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["runs"]), r["collapsed"]) for r in rows) == sorted(
        [(1, 0, 0, ""), (2, 0, 0, ""), (0, 0, 0, ""), (4, 40_000, 1, "x"), (4, 40_000, 1, "x"), (5, 1, 0, "y" * 100_000), (6, 3, 0, "日本 語 🎉"), (7, 3, 0, "12 34 --"), (8, 3, 0, "\x00 a b")]
    )
    assert periodic_runs.find_runs(frame(spark, ODD).limit(0)).count() == 0


def test_planted_tails(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 90)), "en") for i in range(300)] + [(None, "a b", "en")], "doc_id long, text string, lang string")
    for r in queries.repeat_tails(docs).collect():
        if r["doc_id"] is None:
            assert r["text"] == "a b"
            continue
        words, h = [f"w{j}" for j in range(r["doc_id"] % 90)], zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        assert r["text"].split() == words


# ---------------------------------------------------------------- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            if c:
                m = 25 + 75 * sum(c.values()) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_equals_brute_force(spark, k, monkeypatch):
    rng = random.Random(k)
    monkeypatch.setattr(lexical_search, "SLICE", 3_000)  # many slices
    words = [f"{a}{b}" for a in "ABcé9" for b in "xyZ1"]
    weights = [1 / (r + 1) for r in range(len(words))]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=n))
    docs = [(i // 2, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(250)] + [(None, "ax by"), (None, None), (3, "Ax"), (3, "Ax")]
    items = [(i, text(rng.choice([0, 1, 2, 8, 30]))) for i in range(30)] + [(None, "ax"), (7, None), (8, "nowhere"), (9, "ax ax"), (9, "ax ax")]
    found = lexical_search.index(frame(spark, [(i, t, "en") for i, t in docs]).repartition(3))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical_search.search(found, asked, k).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1, r[3])
    assert sorted(got, key=key) == sorted(brute_search(docs, items, k), key=key)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 200)  # many blocks of items
    again = [tuple(r) for r in lexical_search.search(found, asked, k).collect()]
    assert sorted(again, key=key) == sorted(got, key=key)


def test_accumulators_stop_early():
    """A document that holds a frequent term only gets no accumulator once it cannot rank."""
    docs, impacts = np.array([0, 1, *range(50)]), np.array([900, 800, *[10] * 50])
    work = lexical_search.Accumulators([{"terms": np.array([0, 1]), "factors": np.array([100, 1])}], 2, 2)
    work.add(np.arange(50), np.zeros(50, bool), np.array([0, 2]), np.array([2, 52]), docs, impacts)
    assert work.best[0] == [(-90_010, False, 0), (-80_010, False, 1)]
    seen = []
    work._query = lambda query, best, *rest: seen.append(len(best))
    work.add(np.arange(1), np.zeros(1, bool), np.array([0, 0]), np.array([0, 1]), np.array([0]), np.array([10]))
    assert seen == [2]


def test_search_of_odd_rows(spark):
    docs = frame(spark, ODD)
    asked = spark.createDataFrame([(1, "X 日本"), (2, "a")], "item_id long, text string")
    rows = [tuple(r)[:3] for r in lexical_search.search(lexical_search.index(docs), asked).orderBy("item_id", "rank").collect()]
    assert rows[:1] == [(1, 1, 6)] and {r[2] for r in rows if r[0] == 1} == {4, 6} and [r for r in rows if r[0] == 2] == [(2, 1, 8)]
    for given, items in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.where("doc_id = 1"), asked)):
        empty = lexical_search.search(lexical_search.index(given), items)
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


# ---------------------------------------------------------------- language identification


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.score(docs)
    right = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.99 and found.count() == docs.count()


def test_mixed_texts_have_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    pure = {}
    for r in docs.where(language_id.held_out(F.col("doc_id")) & (F.length("text") > 1500)).orderBy("doc_id").collect():
        words = [w for w in r["text"].split() if any(c.isalpha() for c in w)][:180]
        if len(words) == 180 and language_id.identify(model, [" ".join(words)]).max() == 1:  # some given texts are mixed
            pure.setdefault(r["lang"], words)
    assert len(pure) == 4
    for (a, x), (b, y) in itertools.permutations(pure.items(), 2):
        share = dict(zip(model.languages, language_id.identify(model, [" ".join(x[:120] + y[-60:])])[0]))
        assert share[a] == pytest.approx(2 / 3, abs=0.12) and share[b] == pytest.approx(1 / 3, abs=0.12), (a, b, share)
        assert sum(share.values()) == pytest.approx(1)


def test_shares_maximise_the_likelihood():
    rng = np.random.default_rng(2)
    odds = np.maximum(rng.random((60, 2)) ** 4, 1e-3)
    odds /= odds.max(axis=1, keepdims=True)
    times, heads = rng.integers(1, 5, 60).astype(float), np.array([0, 25])
    shares, reached = language_id.fit_shares(odds, times, heads, np.full((2, 2), 0.5))
    for d, (a, b) in enumerate(((0, 25), (25, 60))):
        grid = [(times[a:b] * np.log(odds[a:b] @ [s, 1 - s])).sum() for s in np.linspace(1e-4, 1 - 1e-4, 4001)]
        assert reached[d] == pytest.approx(max(grid), abs=1e-2)
    picked = language_id.choose(odds, times, heads)
    alone = [(times[a:b, None] * np.log(odds[a:b])).sum(axis=0) for a, b in ((0, 25), (25, 60))]
    for d, n in ((0, times[:25].sum()), (1, times[25:].sum())):
        assert ((picked[d] > 0).sum() == 2) == (reached[d] - alone[d].max() > language_id.PENALTY * np.log1p(n))


def test_triples_equal_a_plain_loop():
    import pyarrow as pa

    kinds = language_id.byte_kinds()
    words = ["", "a", "Ab", "é!", "--", "日本", "x9y"]
    want = []
    for i, w in enumerate(words):
        k = [0, 0, *kinds[list(w.encode())].tolist(), 0]
        want += [(i, c) for c in ((k[j] * 160 + k[j + 1]) * 160 + k[j + 2] for j in range(len(k) - 2)) if c]
    owner, codes = language_id.triples(pa.array(words))
    assert list(zip(owner.tolist(), codes.tolist())) == want


def test_languages_of_odd_rows(spark):
    rows = language_id.score(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["doc_id"] in (1, 2, None, 7):
            assert (r["lang_pred"], r["score"], r["langs"]) == ("und", 0.0, [])
        else:
            assert r["lang_pred"] in ("en", "de", "ja", "") and 0 < r["score"] <= 1 and r["langs"][0] == r["lang_pred"]
    assert language_id.score(frame(spark, ODD).limit(0)).count() == 0
    unlabelled = frame(spark, [(i, t, None) for i, t, _ in ODD])
    assert {r["lang_pred"] for r in language_id.score(unlabelled).collect()} == {"und"}
