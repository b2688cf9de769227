"""Operators that work row by row or on sums: tokens, lattice, network, URLs, mixing, fingerprints, passages."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import bpe, fingerprints, lattice, mixing, substring_dedup, toxicity, urls
from sparkprep.llm.queries import TARGETS, URL_RULES, byte_bpe, pieces

DOCS = "doc_id long, text string, lang string, source string, key string, kept boolean, word string, held string, part int, weight int"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src1", "k", True, "w", "h", 1, 2) for i, t in rows], DOCS)


ODD = ["", None, "a", "  \n\n x", "a" * 5_000, "é" * 777, "日本語テキスト🎉🎉", "\x00\x01", "abc" * 3_000 + "d", "it's we'll 12 34", "<|endoftext|>", " \t "]

# ---------------------------------------------------------------- byte-level BPE


def test_ids_equal_the_library(spark):
    import tiktoken

    random.seed(1)
    texts = ODD + ["".join(random.choice("ab é\n1'中.") for _ in range(random.randint(0, 200))) for _ in range(60)]
    settings = byte_bpe()
    ranks = bpe.Merges.of(settings["ranks"]).ranks
    library = tiktoken.Encoding("own", pat_str=settings["pattern"], mergeable_ranks=ranks, special_tokens={})
    docs = frame(spark, list(enumerate(texts)))
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(docs, **settings).collect()}
    assert ids == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: bytes(r["text"]) for r in bpe.decode(bpe.encode(docs, **settings), settings["ranks"]).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip(docs, **settings).collect():
        text = (texts[r["doc_id"]] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256(text).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<u4").tobytes()).hexdigest()
        assert r["n_tokens"] == len(ids[r["doc_id"]])
    assert bpe.round_trip(docs.limit(0), **settings).count() == 0


def test_every_tree_width_merges_alike():
    merges = bpe.Merges.of(byte_bpe()["ranks"])
    random.seed(2)
    words = [bytes(random.choice(b"theinga ") for _ in range(random.randint(2, 16))) for _ in range(300)]
    assert merges.merge(words, 16) == merges.merge(words, 64)


# ---------------------------------------------------------------- lattice


def small_model():
    weights = {"▁": 0.1, "a": 0.1, "b": 0.1, "▁a": 0.2, "ab": 0.15, "aab": 0.05, "▁ab": 0.05} | {f" {i:02X}": 0.001 for i in range(256)}
    return lattice.Pieces({p: math.log(w) for p, w in weights.items()})


def all_segmentations(model, text):
    if not text:
        return [[]]
    cuts = [(text[:i], rest) for i in range(1, len(text) + 1) for rest in all_segmentations(model, text[i:]) if text[:i] in model.log]
    return [[model.log[p], *rest] for p, rest in cuts]


@pytest.mark.parametrize("word", ["a", "ab", "aab", "abab", "baab"])
def test_marginal_is_the_sum_over_segmentations(word):
    model = small_model()
    want = math.log(sum(math.exp(sum(s)) for s in all_segmentations(model, "▁" + word)))
    assert model.forward(word) == pytest.approx(want)
    assert lattice.Lattices(model).forward([word])[0] == pytest.approx(want)


def test_expected_counts_are_the_gradient():
    """The expected number of a piece is the derivative of the log-probability by its log-weight."""
    model = small_model()
    words, counts = ["aab", "abab", "é", "b"], np.array([1.0, 2.0, 3.0, 1.0])
    table = lattice.Lattices(model)
    got = dict(zip(table.names, table.expected(words, counts)))
    for piece in ("a", "ab", "▁ab", " C3"):
        total = []
        for step in (1e-5, -1e-5):
            moved = lattice.Pieces(model.log | {piece: model.log[piece] + step})
            total.append(sum(c * moved.forward(w) for w, c in zip(words, counts)))
        assert got[piece] == pytest.approx((total[0] - total[1]) / 2e-5, rel=1e-4)


def test_whole_vocabulary_by_rows_and_one_by_one():
    logs, end = lattice.Pieces.vocabulary(pieces())
    assert sum(map(math.exp, logs.values())) + math.exp(end) == pytest.approx(1)
    model = lattice.Pieces(logs, end)
    words = ["hello", "straße", "日本語", "🎉", "x" * 63, "x" * 64, "y" * 3_000, "\x00", "naïve.", "<0x41>"]
    assert lattice.Lattices(model).forward(words) == pytest.approx([model.forward(w) for w in words])


def test_long_words_count_like_short_ones(monkeypatch):
    logs, end = lattice.Pieces.vocabulary(pieces())
    table = lattice.Lattices(lattice.Pieces(lattice.Pieces.pieces_only(logs, end)))
    words = ["hello", "straße🎉", "x" * 40, "日本語", "abababab" * 5]
    rows = table.expected(words, np.arange(1.0, 6.0))
    monkeypatch.setattr(lattice.Lattices, "WIDEST", 1)
    assert table.expected(words, np.arange(1.0, 6.0)) == pytest.approx(rows)
    assert math.isfinite(table.forward(["y" * 100_000])[0])


def test_probabilities_of_all_words_stay_below_one(spark):
    """Known words by their arcs, all others by their pieces: what is left for a word list is at most one."""
    docs = frame(spark, [(i, "ab ba ab aab" if i % 3 else "ab b") for i in range(30)])
    listed = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    asked = docs.union(frame(spark, [(None, w) for w in [*listed, ""]]))
    scores = [10 ** r["score"] for r in lattice.score(asked.where("doc_id is not null or text = ''"), pieces()).where("doc_id is null").collect()]
    assert 0 < scores[0] < 1  # the end alone
    found = lattice.score(asked, pieces(), folds=1, fold=1).where("doc_id is null and n_tokens = 2").collect()
    assert len(found) == len(listed) and sum(10 ** r["score"] for r in found) < 1


def test_frequent_words_beat_their_pieces(spark):
    docs = frame(spark, [(i, "straightforward " * 5 + f"unseen{i}") for i in range(50)])
    rows = lattice.score(docs, pieces()).where("held_out").collect()
    assert rows and all(r["score"] > -5 * 1.0 - 25 for r in rows)


def test_base_score_by_plain_counting(spark):
    from zlib import crc32

    random.seed(4)
    rows = [(i, " ".join(random.choice(["The", "cat", "sat", "É", "mat."]) for _ in range(random.randint(0, 9)))) for i in range(40)] + [(41, None), (42, ""), (None, "the the"), (5, "twice"), (5, "twice")]
    token = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    held = lambda i: crc32(str("" if i is None else i).encode()) % 5 == 1
    counts = {}
    for i, t in rows:
        for w in token(t) if not held(i) else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(token(t)), sum(w in counts for w in token(t)), n, round(sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in token(t)), 8)) for i, t in rows)
    found = lattice.score(frame(spark, rows), pieces()).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in found) == want
    assert all(r["score"] < 0 for r in found)
    assert lattice.score(frame(spark, []), pieces()).count() == 0


def test_learning_raises_the_held_out_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by_rounds = [lattice.score(docs, pieces(), rounds=k).where("held_out").agg(F.sum("score")).first()[0] for k in (0, 1, 2)]
    assert by_rounds == sorted(by_rounds)


# ---------------------------------------------------------------- toxicity


def test_network_gradients():
    net = toxicity.Network.fresh([b"a"], 1)
    net.p = {k: v if k in ("words", "grams") else v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, lengths, y, w = rng.standard_normal((5, 7, 16)), np.array([7, 3, 1, 5, 0]), np.array([0, 1, 1, 0, 1.0]), np.ones(5)
    _, grads, dx = toxicity.gradients(net, x, lengths, y, w)
    for name in ("Wf", "Ub", "Wa", "va", "wo", "bb", "bo"):
        v, i = net.p[name], tuple(s // 2 for s in net.p[name].shape)
        loss = []
        for step in (1e-4, -2e-4):
            v[i] += step
            loss.append(toxicity.gradients(net, x, lengths, y, w)[0])
        assert grads[name][i] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=1e-2, abs=1e-6)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 200])
def test_every_word_is_in_a_window(n):
    spans = toxicity.window_spans(n)
    assert set().union(*(range(a, b) for a, b in spans)) == set(range(n))
    assert len(spans) == max(1, -(-(n - 32) // 16) + 1)


def test_scores_are_those_of_the_worst_window():
    net = toxicity.Network.fresh([b"bad", b"good"], 3)
    net.p["words"][:] = np.random.default_rng(1).standard_normal(net.p["words"].shape)
    words = [random.Random(5).choice([b"bad", b"good", b"other"]) for _ in range(100)]
    windows = [words[a:b] for a, b in toxicity.window_spans(len(words))]
    alone = [net.scores([b" ".join(w)])[0] for w in windows]
    assert net.scores([b" ".join(words), b"", None]) == pytest.approx([max(alone), *net.scores([b"", None])], abs=1e-6)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}{c}" for a in "blmnrst" for b in "aeiou" for c in ("lo", "mi", "ran", "tep", "sul")]
    rows, marks = [], []
    for i in range(4_000):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        for _ in range(2 if i % 3 == 0 else 0):
            words[rng.randrange(len(words))] = rng.choice(["zxcurse", "zxvile", "zxhate"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.score(docs, labels)
    assert found.count() == docs.count()
    held = found.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in held}
    assert n.get((1, 1), 0) >= 0.95 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.01 * (n.get((0, 1), 0) + n.get((0, 0), 0))
    odd = frame(spark, [(1, None), (2, ""), (None, "x"), (4, "word " * 40_000), (4, "word " * 40_000), (5, "y" * 100_000)])
    few = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for marks in (few, few.limit(0)):
        rows = toxicity.score(odd, marks).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.drop_toxic(odd, few.limit(0)).columns == odd.columns
    assert toxicity.score(odd.limit(0), few).count() == 0


def test_a_rare_toxic_vocabulary_is_learned(spark):
    """One toxic document in fifty uses words of its own."""
    rng = random.Random(11)
    plain = [f"{a}{b}{c}" for a in "blmnrst" for b in "aeiou" for c in ("lo", "mi", "ran", "tep", "sul")]
    common, rare = ["zxcurse", "zxvile", "zxhate"], ["qwgrim", "qwfoul", "qwspite"]
    rows, marks = [], []
    for i in range(6_000):
        ws = [rng.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            at = rng.randrange(36)
            ws[at : at + 3] = rng.sample(rare if i % 150 == 0 else common, 3)
        rows.append((i, " ".join(ws)))
        marks.append((i, int(i % 3 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = toxicity.score(frame(spark, rows), labels).where("held_out").collect()
    caught = lambda chosen: [r["predicted"] for r in found if chosen(r["doc_id"])]
    second = caught(lambda i: i % 150 == 0)
    assert len(second) >= 5 and np.mean(second) >= 0.9
    assert np.mean(caught(lambda i: i % 3 == 0)) >= 0.95
    assert np.mean(caught(lambda i: i % 3)) <= 0.01


# ---------------------------------------------------------------- URLs


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
        host, slash, path = rest[:end].partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


@pytest.mark.parametrize("sample", [20_000, 7])
def test_rules_against_trying_all(spark, monkeypatch, sample):
    monkeypatch.setattr(urls, "SAMPLE", sample)
    monkeypatch.setattr(urls, "PAGES_PER_TASK", 20)
    random.seed(6)
    rules = [*URL_RULES, ("block", "b.com", "/"), ("allow", "a.b.com", "/x/"), ("block", "c.a.b.com", "/x/y/"), ("block", "om", "/"), ("allow", "xb.com", "/")]
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "x.net", "b.com", "xb.com", "a.b.com", "c.a.b.com", "d.c.a.b.com", "org", "", "com.", "b.com:80", "é.net"]
    made = [f"{random.choice(['http', 'https'])}://{random.choice(hosts)}{random.choice(['', '/', '/en/', '/es/1', '/fr/?q=/x/', '/x/y/z', '/x/#y', '?a/en/', '#/en/'])}" for _ in range(300)]
    made += [None, "", "no scheme", "://", "a://b://com/en/", "http://b.com/" + "x" * 50_000]
    rows = list(enumerate(made)) + [(None, "http://b.com/"), (3, "http://x.net/es/"), (3, "http://x.net/es/")]
    pages = spark.createDataFrame([(i, u, "html", "k", 1) for i, u in rows], "page_id long, url string, html string, key string, part int")
    got = sorted((tuple(r) for r in urls.judge(pages, rules).collect()), key=str)
    assert got == sorted(((i, *plain_verdict(u, rules)) for i, u in rows), key=str)
    assert urls.judge(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, [("allow", "a", "/"), ("block", "a", "/")])
    with pytest.raises(ValueError):
        urls.judge(pages, [("allow", "a", "/"), ("block", None, "/")])
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_least_characters_in_hosts(spark):
    rules = [("block", "a", ""), ("block", "x\x01.a", "/"), ("allow", "b\x00c", "/")]
    made = ["http://a\x00b/", "http://a\x01/", "http://x\x01.a/", "http://y.b\x00c/", "http://c/", "http://b.a/", "http://x\x00.a/"]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    got = sorted(tuple(r) for r in urls.judge(pages, rules).collect())
    assert got == [(i, *plain_verdict(u, rules)) for i, u in enumerate(made)]


@pytest.mark.parametrize("sample", [20_000, 2_000])
def test_very_many_rules_on_one_host(spark, monkeypatch, sample):
    """Rules as a table, most of them on the host that also holds most pages: the parts inside it take only rules of their paths."""
    monkeypatch.setattr(urls, "SAMPLE", sample)
    monkeypatch.setattr(urls, "PAGES_PER_TASK", 1_000)
    rng = random.Random(8)
    rules = {("hot.com", f"/{a}/{b}/"): rng.choice(["allow", "block"]) for a in range(400) for b in range(250)}
    rules |= {("hot.com", f"/{a}/"): "block" for a in range(0, 400, 3)} | {("com", "/7/"): "allow", ("www.hot.com", "/7/7/"): "block", ("z.org", ""): "block"}
    made = [(rng.choice(["hot.com"] * 8 + ["www.hot.com", "other.com", "a.z.org"]), f"/{rng.randrange(420)}/{rng.randrange(260)}/{rng.choice(['', 'x'])}") for _ in range(12_000)]
    made += [("hot.com", "/5/5/same")] * 4_000  # one url on a quarter of the rows
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(made)], "page_id long, url string")
    table = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()], "verdict string, host string, path string").repartition(4)

    def plain(host, path):
        labels = host.split(".")
        fits = [(len(h) + n, len(h), h + path[:n], rules[h, path[:n]]) for i in range(len(labels)) for h in [".".join(labels[i:])] for n in range(len(path) + 1) if (h, path[:n]) in rules]
        return max(fits)[2:] if fits else (None, "allow")

    judged = urls.judge(pages, table)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    assert got == {i: plain(h, p) for i, (h, p) in enumerate(made)}
    sizes = [r["count"] for r in judged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2_000


def test_parts_of_a_rule_against_trying_all():
    rng = random.Random(9)
    text = lambda: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))
    for _ in range(300):
        hosts = [".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 4))]
        pages = sorted((urls.host_key(rng.choice(hosts)).encode(), text().encode(), rng.randrange(9)) for _ in range(40))
        bounds = sorted(rng.sample(pages, 12))
        key, path = urls.host_key(rng.choice(hosts)), text()
        where = list(urls.parts_of(key, path, bounds))
        assert where == sorted(set(where))
        for page in pages:
            if page[0].startswith(key.encode()) and page[1].startswith(path.encode()):
                assert urls.bisect_right(bounds, page) in where


# ---------------------------------------------------------------- mixing


def test_raking_meets_all_margins():
    rng = np.random.default_rng(1)
    cells = {c: int(rng.integers(1, 1_000)) for c in itertools.product("ab", "xyz", "12")}
    targets = {"s": {"a": 0.2, "b": 0.8}, "l": {"x": 0.5, "y": 0.3, "z": 0.2}, "t": {"1": 0.4, "2": 0.6}}
    weights = mixing.rake(cells, targets)
    total = sum(cells.values())
    for axis, shares in enumerate(targets.values()):
        for name, share in shares.items():
            assert sum(w * cells[c] for c, w in weights.items() if c[axis] == name) / total == pytest.approx(share)


def test_sample_meets_targets_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mix(docs, TARGETS).where("kept").groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(r["n"] for r in mixed)
    for r in mixed:
        assert r["n"] / total == pytest.approx(TARGETS["lang"][r["lang"]], abs=0.03)
    odd = frame(spark, [(1, None), (2, ""), (None, "a b c"), (4, "x " * 50_000), (4, "x " * 50_000)]).withColumn("lang", F.expr("if(doc_id = 2, null, lang)"))
    rows = mixing.mix(odd, TARGETS).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 3, 50_000, 50_000]
    assert all(0 <= r["probability"] <= 1 for r in rows) and set(rows[0]["row"].asDict()) == set(odd.columns)
    assert mixing.mix(odd.limit(0), TARGETS).count() == 0
    with pytest.raises(ValueError):
        mixing.full_targets({"s": {"a": 0.8, "b": 0.8}})


def test_null_and_unlisted_languages_can_be_kept(spark):
    langs = ["en", "de", "fr", "es", None, "it"]
    rows = [(i, "some plain words", langs[i % 6], "src1", "k", True, "w", "h", 1, 2) for i in range(1_200)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs, TARGETS).where("kept").groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()
    n = {r["lang"]: r["n"] for r in mixed}
    total = sum(n.values())
    assert n[None] > 0 and n["it"] > 0
    assert (n[None] + n["it"]) / total == pytest.approx(1 / 3, abs=0.08)
    assert n["en"] / total == pytest.approx(0.6 * 2 / 3, abs=0.08)
    assert mixing.mix(docs.where("lang = 'it'"), TARGETS).where("not kept").isEmpty()
    refused = TARGETS | {"lang": TARGETS["lang"] | {mixing.REST: 0.0}}
    assert mixing.mix(docs, refused).where("kept and (lang is null or lang = 'it')").isEmpty()


def test_copies_meet_targets_and_budget_on_skewed_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("source != 'src19' or crc32(cast(doc_id as string)) % 20 = 0")
    total = docs.agg(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    for budget in (None, total // 2):
        rows = mixing.mix(docs, TARGETS, budget=budget)
        n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()}
        assert sum(n.values()) == pytest.approx(budget or total, rel=0.05)
        for lang, share in TARGETS["lang"].items():
            assert n[lang] / sum(n.values()) == pytest.approx(share, abs=0.03)
    empty = [(i, "one two", "en", "src1", "k", True, "w", "h", 1, 2) for i in range(50)] + [(99, "", "de", "src2", "k", True, "w", "h", 1, 2)]
    rows = mixing.mix(spark.createDataFrame(empty, DOCS), TARGETS).collect()
    assert all(r["probability"] == 1 and r["copies"] == 1 for r in rows if r["n_tokens"])
    assert all(r["copies"] <= 1 and r["probability"] <= 1 for r in rows)


# ---------------------------------------------------------------- fingerprints


def plain_fingerprint(paragraphs):
    """The hash part, by whole numbers."""
    lanes = [0] * fingerprints.LANES
    for p in paragraphs:
        digits = [hashlib.sha256((mark + p).encode()).hexdigest() for mark in "ab"]
        for k in range(8):
            word = int(digits[k // 4][15 * (k % 4) : 15 * (k % 4) + 15], 16)
            for half in (0, 1):
                lanes[2 * k + half] = (lanes[2 * k + half] + (word >> 30 * half) % (1 << 30)) % (1 << 30)
    return lanes


def test_fingerprints_add_and_ignore_order(spark):
    docs = spark.createDataFrame([(1, "a line\nb line. Next\n\nc"), (2, "c\nb line. Next\na line"), (3, "a line\nc"), (4, "b line. Next"), (5, None), (6, ""), (7, "c\nNext\na line\nb line.")], "doc_id long, text string")
    v = {r["doc_id"]: r["vector"] for r in fingerprints.fingerprint(docs).collect()}
    assert v[1] == v[2] and len({str(v[i]) for i in (1, 3, 4, 7)}) == 4 and v[5] == v[6] and not any(v[5])
    assert v[1][: fingerprints.LANES] == plain_fingerprint(["a line", "b line. Next", "c"])
    assert v[1][fingerprints.LANES :] == v[7][fingerprints.LANES :]  # the same sentences
    both = spark.createDataFrame([(v[1], v[3], v[4])], "a array<long>, b array<long>, c array<long>")
    assert both.select(fingerprints.insert(F.col("b"), F.col("c")) == F.col("a"), fingerprints.delete(F.col("a"), F.col("c")) == F.col("b")).first() == (True, True)


def test_sums_wrap_at_the_modulus(spark):
    """Over 2^20 equal units, and lanes that pass their modulus, inserted and deleted one after the other."""
    n = 1_200_000
    found = fingerprints.fingerprint(spark.createDataFrame([(1, "zeta\n" * n)], "doc_id long, text string")).first()
    one = plain_fingerprint(["zeta"])
    assert found["n_units"] == n and found["vector"][: fingerprints.LANES] == [x * n % (1 << 30) for x in one]
    bits = int(hashlib.md5(b"zeta").hexdigest()[:15], 16)
    assert found["vector"][fingerprints.LANES] == ((bits >> 30) & 1) * n << 30 | (bits & 1) * n
    rng = random.Random(3)
    parts = [[f"line {rng.randrange(50)}" for _ in range(rng.randint(0, 40))] for _ in range(12)]
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(parts)] + [(99, "\n".join(sum(parts, [])))], "doc_id long, text string")
    v = {r["doc_id"]: r["vector"] for r in fingerprints.fingerprint(docs).collect()}
    rows = spark.createDataFrame([([v[i] for i in range(12)], v[99])], "parts array<array<long>>, whole array<long>")
    zero = F.lit([0] * len(v[99])).cast("array<long>")
    added = F.aggregate("parts", zero, lambda s, x: fingerprints.insert(s, x))
    left = F.aggregate("parts", F.col("whole"), lambda s, x: fingerprints.delete(s, x))
    assert rows.select(added == F.col("whole"), left == zero).first() == (True, True)
    # lanes that are about to pass the modulus
    top = spark.createDataFrame([([(1 << 30) - 1] * 16 + [(1 << 60) - 1] * 60 + [5], [1] * 77)], "a array<long>, b array<long>")
    moved = top.select(fingerprints.insert(F.col("a"), F.col("b")).alias("c"), "a", "b").select("c", (fingerprints.delete(F.col("c"), F.col("b")) == F.col("a")).alias("back")).first()
    assert moved["c"] == [0] * 16 + [((1 << 30) - 1) << 30] * 60 + [6] and moved["back"]


def test_likeness_follows_the_share_of_common_units(spark):
    line = lambda k: f"line number {k} of the text"
    docs = spark.createDataFrame([(n, "\n".join(line(k) for k in [*range(n), *range(1_000 + n * 100, 1_000 + n * 100 + 40 - n)])) for n in range(0, 41, 10)], "doc_id long, text string")
    v = {r["doc_id"]: r["vector"] for r in fingerprints.fingerprint(docs).collect()}
    for n in range(0, 41, 10):
        df = spark.createDataFrame([(v[40], v[n])], "a array<long>, b array<long>")
        near = df.select(fingerprints.likeness(fingerprints.signed_lanes(F.col("a")), fingerprints.signed_lanes(F.col("b")), F.col("a") == F.col("b"))).first()[0]
        assert near == pytest.approx(n / 40, abs=0.3)


@pytest.mark.parametrize("per_range", [512, 2])
def test_next_document_over_range_borders(spark, monkeypatch, per_range):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", per_range)
    rows = [(i * i - 40, f"text {i}" * (i % 4)) for i in range(30)] + [(None, None), (-40, "z"), (9, "long " * 20_000), *((77, f"same id {i}") for i in range(12)), *((77, "same id 3") for i in range(3))]
    found = fingerprints.edit_report(frame(spark, rows)).collect()
    hashes = {r["text"]: r["h"] for r in frame(spark, [(0, t or "") for _, t in rows]).select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows), key=lambda r: (r[0], hashes[r[1]]))
    want = []
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((-(1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    assert fingerprints.edit_report(frame(spark, [])).count() == 0
    alone = fingerprints.edit_report(frame(spark, [(1, "ab")])).first()
    assert (alone["near_next"], alone["edited_sha256"]) == (1.0, hashlib.sha256(b"aa").hexdigest())


# ---------------------------------------------------------------- passages

PASSAGE = "The first of many words stands here today. Then comes a second sentence with some more words. It ends."


def test_passages_keep_their_earliest_occurrence(spark):
    rows = [(7, f"own start of seven. {PASSAGE}\nand its end"), (3, f"other words before. {PASSAGE}"), (None, "no id and nothing shared"), (8, None), (9, ""), (10, "short. short. short."), (11, PASSAGE.upper().replace(" ", "  "))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got[3]["text"] == rows[1][1] and got[None]["n_spans"] == 0 and got[10]["text"] == rows[5][1]
    assert got[8]["text"] == got[9]["text"] == "" and got[11]["text"] == ""
    start = rows[0][1].index("The first")
    assert got[7]["spans"].startswith(f"{start}-") and "Then comes" not in got[7]["text"]
    for i, t in rows:
        edges = [int(x) for s in got[i]["spans"].split(",") if s for x in s.split("-")]
        cut = [0, *edges, len(t or "")]
        assert got[i]["text"] == "".join((t or "")[a:b] for a, b in zip(cut[::2], cut[1::2]))
        assert got[i]["removed_chars"] == len(t or "") - len(got[i]["text"])


def test_passage_edge_cases(spark):
    twice = frame(spark, [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE + "\n" + PASSAGE), (3, "x" * 60_000), (4, "é. " * 30_000)])
    got = sorted((r["doc_id"], r["text"] == "") for r in substring_dedup.remove_repeats(twice).collect())
    assert got[:3] == [(1, False), (1, False), (2, True)]
    assert substring_dedup.remove_repeats(twice.limit(0)).count() == 0


@pytest.mark.parametrize("end", [" ", "! ", "? "])
def test_fine_units_find_passages_without_a_whole_sentence(spark, end):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(20):
        passage = words(50)
        passage[20] += end.strip()
        for k in (2 * i, 2 * i + 1):
            rows.append((k, " ".join(words(rng.randrange(5, 30)) + passage + words(15))))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, rows), fine=True).collect()}
    for k, text in rows:
        assert (got[k]["n_spans"] > 0) == (k % 2 == 1) and got[k]["n_chars"] == len(text)
        assert "".join(substring_dedup.split_long(text)) == text
