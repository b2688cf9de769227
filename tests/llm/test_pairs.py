"""Near-duplicate operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import embeddings, line_dedup, simhash
from sparkprep.llm.common import components

DOCS = "doc_id long, text string, source string, fp long, row string, key string, h1 string, line string, root string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", 1, "r", "k", "h", "l", "o") for i, t in rows], DOCS)


def lowest(n, pairs, ids):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), 1 << 64), ids[i])
    return [least[find(i)] for i in range(n)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_simhash(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["The quick brown Fox", "the QUICK brown fox", "a b", "A  b\n", "", None, " \t\n", "Élan ÉLAN élan x", "one", "x " * 70_000 + "y"]


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    random.seed(5)
    texts = [*TEXTS, *(" ".join(random.choice("abcdefg") for _ in range(random.randint(0, 30))) for _ in range(40))]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(frame(spark, enumerate(texts))).collect()}
    assert got == {i: f"{plain_simhash(t):016x}" for i, t in enumerate(texts)}
    spark_hash = spark.sql("select hex(xxhash64('one')) as h").first()["h"]
    assert got[8] == spark_hash.lower().rjust(16, "0")  # a single shingle's own hash


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_join_what_brute_force_joins(spark, bits):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12)
    prints = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)} | {0, -1})
    close = [(i, j) for i in range(len(prints)) for j in range(i) if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= bits]
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints * 3], "fp long"), bits)
    assert edges.where(F.bit_count(F.expr("a ^ b")) > bits).isEmpty()
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert [found.get(p, p) for p in prints] == lowest(len(prints), close, prints)
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).select(F.col("id").alias("fp")), 3)


def test_simhash_edge_cases(spark):
    docs = frame(spark, [(5, "same words here now"), (3, "same words here now"), (3, "same words here now"), (None, "same words here now"), (None, None), (9, ""), (8, None)])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, 8), (9, 8), (8, 8)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.keep_one(docs.limit(0)).count() == 0
    alone = simhash.near_duplicates(frame(spark, [(None, "z"), (None, "z")])).collect()
    assert [r["component_id"] for r in alone] == [None, None]
    assert simhash.keep_one(frame(spark, [(None, "z"), (None, "z")])).count() == 1


# ---------------------------------------------------------------- lines


def plain_lines(docs, min_chars=10, edits=1):
    lines = sorted(((i, p, t) for i, text in docs for p, t in enumerate((text or "").split("\n"))), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    out = {}
    for n, (i, p, t) in enumerate(lines):
        near = lambda u: t == u or (edits and min(len(t), len(u)) >= min_chars and abs(len(t) - len(u)) <= edits and distance(t, u) <= edits)  # noqa: B023, E731
        gone = bool(t.strip()) and any(near(u) for _, _, u in lines[:n])
        out.setdefault(i, []).append((t, gone))
    return {i: (len(v), sum(g for _, g in v), "\n".join(t for t, g in v if not g)) for i, v in out.items()}


def varied_docs(n, lines):
    random.seed(11)
    base = ["the quick brown fox jumps", "abcdefghijkl", "0123456789", "é" * 12, "short", "", " "]
    for i in range(n):
        text = []
        for _ in range(lines):
            line = list(random.choice(base))
            for _ in range(random.randint(0, 2)):
                at = random.randint(0, len(line))
                how = random.random()
                line[at : at + (how < 0.7)] = random.choice("xyé") if how > 0.3 else ""
            text.append("".join(line))
        yield i, "\n".join(text)


@pytest.mark.parametrize("group", [32, 2, 1])
@pytest.mark.parametrize("edits", [0, 1])
def test_lines_against_brute_force(spark, monkeypatch, group, edits):
    """Keys with many members are refined, however small "many" is, without losing a pair."""
    monkeypatch.setattr(line_dedup, "GROUP", group)
    docs = list(varied_docs(40, 4))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, docs), max_edits=edits).collect()}
    assert got == plain_lines(docs, edits=edits)


def long_docs(n, lines, most):
    """Lines up to ``most`` edits and one more from a few texts, of like characters too."""
    random.seed(12)
    base = ["the quick brown fox jumps over the lazy dog", "ab" * 18, "z" * 33, "é日本" * 11, "0123456789" * 3 + "01", "shorter than the others", ""]
    for i in range(n):
        text = []
        for _ in range(lines):
            line = list(random.choice(base))
            for _ in range(random.randint(0, most + 1)):
                at = random.randint(0, len(line))
                how = random.random()
                line[at : at + (how < 0.7)] = random.choice("abxyzé") if how > 0.3 else ""
            text.append("".join(line))
        yield i, "\n".join(text)


@pytest.mark.parametrize("group", [32, 1])
@pytest.mark.parametrize("edits", [2, 3])
def test_lines_of_more_edits_against_brute_force(spark, monkeypatch, group, edits):
    """One segment more than edits, looked up wherever the edits can shift it."""
    monkeypatch.setattr(line_dedup, "GROUP", group)
    docs = list(long_docs(40, 4, edits))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, docs), max_edits=edits, min_chars=10 * edits).collect()}
    assert got == plain_lines(docs, min_chars=10 * edits, edits=edits)


@pytest.mark.parametrize("edits", [2, 3])
def test_edits_spread_so_that_one_segment_is_left(spark, edits):
    """Each segment but one is edited; the one left is the first, one in the middle or the last, moved or not."""
    random.seed(edits)
    size, rows = 48 // (edits + 1), []
    for spared in range(edits + 1):
        for new, skip in (("#", 1), ("", 1), ("#", 0)):
            line = "".join(random.choices("abcdefghijklmnop", k=48))
            parts = [line[j : j + size] for j in range(0, 48, size)]
            rows += [line, "".join(part if i == spared else part[: size // 2] + new + part[size // 2 + skip :] for i, part in enumerate(parts))]
    assert all(distance(a, b) == edits for a, b in zip(rows[::2], rows[1::2]))
    got = line_dedup.dedup_lines(frame(spark, list(enumerate(rows))), max_edits=edits, min_chars=10 * edits).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: i % 2 for i in range(len(rows))}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(frame(spark, []), max_edits=4, min_chars=100)


def test_the_band_judges_the_pairs(spark, monkeypatch):
    """Pairs come to the band with all that follows their first difference, none is decided before it."""
    text = "one of many lines of this table"
    others = [text[:i] + x + text[i + cut :] for i in (0, 9, 20) for x, cut in (("#", 1), ("", 1), ("#", 0), ("##", 2), ("#", 3))]
    pairs = spark.createDataFrame([(i, i, text, o) for i, o in enumerate(others)], "h1 long, h2 long, line string, other string")
    near = {r["h1"] for r in line_dedup.verified(pairs, 1).collect()}
    assert near == {i for i, o in enumerate(others) if distance(text, o) <= 1}
    seen = []
    monkeypatch.setattr(line_dedup, "within", lambda a, b, k: seen.append(k) or F.least(F.size(a), F.size(b)) > k)
    assert {r["h1"] for r in line_dedup.verified(pairs, 1).collect()} == set(range(len(others))) and seen == [1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    random.seed(k)
    word = lambda: "".join(random.choice("ab") for _ in range(random.randint(0, 9)))
    pairs = [sorted((word(), word()), key=len, reverse=True) for _ in range(800)]
    df = spark.createDataFrame([(list(a), list(b), distance(a, b)) for a, b in pairs], "a array<string>, b array<string>, d int")
    assert df.where(line_dedup.within("a", "b", k) != (F.col("d") <= k)).isEmpty()


def test_many_variants_make_few_pairs(spark):
    """Thousands of lines that share a half are not paired with each other."""
    n = 3_000
    docs = frame(spark, [(i, f"a line with the same beginning {i * 7919 % 100_000:05d}{i * 104729 % 100_000:05d}") for i in range(n)])
    keyed = docs.select(F.col("doc_id").alias("h1"), F.col("doc_id").alias("h2"), F.struct("doc_id", F.lit(0).alias("pos")).alias("at"), F.col("text").alias("line"))
    keyed = keyed.select("*", F.explode(line_dedup.segment_keys(F.col("line"), F.length("line"), 1)).alias("k")).select("h1", "h2", "at", "line", "k.*")
    few, many = line_dedup.crowded(keyed)
    assert many.select("h1").distinct().count() == n
    assert line_dedup.pair(few).count() < n
    assert line_dedup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] < 30


def test_line_edge_cases(spark):
    docs = frame(spark, [(1, "alpha beta gamma\n\nalpha beta gamma"), (2, None), (2, ""), (None, "alpha beta gammx"), (4, "one"), (4, "one"), (5, "one\n"), (6, "z" * 50_000 + "\n" + "z" * 50_001)])
    got = sorted((str(r["doc_id"]), r["n_removed"], r["text"][:20]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([("None", 0, "alpha beta gammx"), ("1", 2, ""), ("2", 0, ""), ("2", 0, ""), ("4", 0, "one"), ("4", 0, "one"), ("5", 1, ""), ("6", 1, "z" * 20)])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, max_edits=2)


@pytest.mark.parametrize("edits", [0, 1])
def test_documents_without_an_id_of_their_own(spark, edits):
    """Null and repeated ids: a line stays once over all different texts; equal rows keep the same."""
    shared = "the same long line here"
    rows = [(None, f"{shared}\nfirst of no name"), (None, f"{shared}\nsecond of no name"), (7, f"third, of seven\n{shared}"), (7, f"fourth, of seven too\n{shared}"), (9, "a line of nine, twice"), (9, "a line of nine, twice")]
    rows += [(None, f"{shared}\nnumber {i} {'abcdefghij'[i % 10] * 9}{i}") for i in range(40)]
    got = line_dedup.dedup_lines(frame(spark, rows), max_edits=edits).collect()
    assert len(got) == len(rows)
    assert sum(shared in r["text"] for r in got) == 1 and next(r["doc_id"] for r in got if shared in r["text"]) is None
    assert [r["text"] for r in got if r["doc_id"] == 9] == ["a line of nine, twice"] * 2
    for own in ("first of no name", "third, of seven", "number 39 jjjjjjjjj39"):
        assert sum(own in r["text"] for r in got) == 1


# ---------------------------------------------------------------- embeddings


def plain_vectors(ids, vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    scaled = [np.array(v, float) / max(map(abs, v)) if g else None for v, g in zip(vectors, good)]  # tiny squares vanish
    units = [v if v is None else v / np.linalg.norm(v) for v in scaled]
    n = len(ids)
    pairs = [(i, j) for i in range(n) for j in range(i) if good[i] and good[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    count = [sum(i in p for p in pairs) for i in range(n)]
    return [(ids[i], count[i], low, ids[i] == low) for i, low in enumerate(lowest(n, pairs, ids))]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_vectors_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    near = [b + s * rng.standard_normal(16) / 4 for b in rng.standard_normal((12, 16)) for s in (0, 0.2, 0.3, 0.4, 0.5, 0.6)]
    vectors = [v.tolist() for v in near] + [near[0].tolist()] * 30 + [[0.0] * 16, None, [], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 0.0], [3.0, 0.0], [1e-200, 0.0]]
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, ["u"] * len(ids), [0] * len(ids))), "vec_id long, embedding array<double>, uid string, n int")
    got = [tuple(r) for r in embeddings.near_duplicates(df).collect()]
    assert sorted(got) == sorted(plain_vectors(ids, vectors))


def test_vector_edge_cases(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [0.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (7, 0, 7, True), (None, 0, None, False)], key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    d, n = 64, 400
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z  # cosine 0.95 exactly
    turn = embeddings.rotations(d, 1)[0]
    rx, ry = x @ turn, y @ turn
    codes = np.where(rx > 0, 1, -1)
    factor = np.abs(rx).sum(axis=1) / np.sqrt(d)
    guess = (codes * ry).sum(axis=1) / np.sqrt(d) / factor
    assert abs(guess.mean() - 0.95) < 0.01
    both = np.vstack([codes, np.where(ry > 0, 1, -1)]).astype(np.int8)
    factors = np.concatenate([factor, np.abs(ry).sum(axis=1) / np.sqrt(d)])
    i, j = embeddings.estimate_links(np.zeros((2 * n, 1), np.int32), both, factors, np.vstack([rx, ry]).astype(np.float32), 0.95, 0)
    assert {(a, a + n) for a in range(n)} <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 2 * n  # of 320,000 pairs


def test_lines_are_read_at_the_places_wanted(spark, monkeypatch):
    """No text moves line by line to find the few lines that share a key."""
    plans, kept = [], line_dedup.kept
    monkeypatch.setattr(line_dedup, "kept", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    docs = frame(spark, [(1, "first of all these lines\n\nsecond of all these lines"), (1, "second of all these linez\nother"), (None, "first of all these lines!"), (None, "first of all these lines!"), (3, "third, unlike the others")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    # null ids first; of the two texts with id 1 the one whose hash is lower
    first = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).first()["text"]
    keep = ["second of all these linez\nother", ""] if first.endswith("other") else ["\nsecond of all these lines", "other"]
    assert got == sorted([("None", "first of all these lines!")] * 2 + [("3", "third, unlike the others")] + [("1", t) for t in keep])
    assert [i for i, p in enumerate(plans) if "posexplode" in p] == [0]  # the lines of all documents, hashed


def test_places_of_texts_with_equal_hashes(spark):
    """A place whose line has other hashes is of another text."""
    docs = spark.createDataFrame([(None, 5, "one\ntwo"), (None, 5, "six\nten"), (None, 5, "six"), (2, 5, "two\none")], "doc_id long, body long, text string")
    hashed = spark.createDataFrame([("two", (line_dedup.FIRST, 5, 1)), ("six", (line_dedup.FIRST, 5, 0)), ("one", (2, 5, 1))], "line string, at struct<doc_id: long, body: long, pos: int>")
    got = line_dedup.lines_at(hashed.select("at", *line_dedup.hashes(F.col("line"))), docs).select("at.doc_id", "at.pos", "line").collect()
    assert sorted(map(tuple, got)) == sorted([(line_dedup.FIRST, 1, "two"), (line_dedup.FIRST, 0, "six"), (line_dedup.FIRST, 0, "six"), (2, 1, "one")])
