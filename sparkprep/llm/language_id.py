"""Language identification: each document is a mixture of languages.

Byte n-grams inside words, up to three bytes long, give the likelihood of a word
under each language.  Expectation-maximisation finds the proportions of a set of
languages under which a document's words are most likely.  Languages join the set
one by one, as long as the likelihood gains more than a penalty for the new one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col, slices

UNKNOWN = "und"
SLICE = 4 << 20  # bytes of text worked on at a time, over all languages
KINDS = 160  # classes of bytes: a-z, bytes beyond ASCII, all others as one edge
TRIPLES = 200_000  # the model holds the three-byte sequences with the highest counts, summed over languages
SUPPORT = 5.0  # occurrences by which a shorter context counts
LEAST_RATIO = 1e-3  # a word is at most a thousand times likelier in one language than in the document's
PENALTY = 2.0  # log-likelihood a language must gain, times the log of the number of words
ROUNDS = 40
STEADY = 1e-4  # proportions that move less are final


def byte_kinds():
    """0 for what ends a word, 1-26 letters, the rest bytes of characters beyond ASCII."""
    import numpy as np

    kinds = np.zeros(256, np.int64)
    kinds[97:123] = kinds[65:91] = np.arange(1, 27)
    kinds[128:] = np.arange(27, 155)
    return kinds


def triples(words):
    """``(word, code)`` of every three neighbouring bytes of an Arrow array of words, an edge before and behind each; sequences of edges only are left out."""
    import numpy as np
    import pyarrow as pa

    data = words.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    lengths = np.diff(offsets)
    spread = np.zeros(int(lengths.sum()) + 3 * len(data), np.int64)  # two edges before, one behind
    owner = np.repeat(np.arange(len(data)), lengths)
    if len(owner):
        raw = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        spread[np.arange(len(owner)) + 3 * owner + 2] = byte_kinds()[raw]
    owner = np.repeat(np.arange(len(data)), lengths + 3)[2:]
    codes = (spread[:-2] * KINDS + spread[1:-1]) * KINDS + spread[2:]
    ends = np.cumsum(lengths + 3)[:-1]
    inside = np.ones(len(codes), bool)
    for k in (1, 2):
        inside[ends - k] = False  # sequences that reach into the next word
    inside &= codes > 0
    return owner[inside], codes[inside]


class Model:
    """Log-probability of a byte after two others, per language: triples by their counts, shorter contexts below them."""

    def __init__(self, languages: list[str], rows: list[tuple[int, int, int]]):
        import numpy as np

        self.languages = languages
        codes, lang, counts = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        self.codes, which = np.unique(codes, return_inverse=True)
        n = len(languages)
        three = np.zeros((len(self.codes), n))
        three[which, lang] = counts
        context, pair, single = np.zeros((KINDS**2, n)), np.zeros((KINDS**2, n)), np.zeros((KINDS, n))
        np.add.at(context, codes // KINDS, np.eye(n)[lang] * counts[:, None])
        np.add.at(pair, codes % KINDS**2, np.eye(n)[lang] * counts[:, None])
        np.add.at(single, codes % KINDS, np.eye(n)[lang] * counts[:, None])
        one = (single + 1) / (single + 1).sum(axis=0)
        heads = pair.reshape(KINDS, KINDS, n).sum(axis=1)
        two = (pair.reshape(KINDS, KINDS, n) + SUPPORT * one) / (heads + SUPPORT)[:, None]
        two = two.reshape(KINDS**2, n)
        self.seen = np.log((three + SUPPORT * two[self.codes % KINDS**2]) / (context[self.codes // KINDS] + SUPPORT))
        self.two, self.missed = np.log(two), np.log(SUPPORT / (context + SUPPORT))

    def words(self, words):
        """Log-likelihood of each word per language, and whether it has a letter or a character beyond ASCII."""
        import numpy as np

        owner, codes = triples(words)
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        steps = np.empty((len(codes), len(self.languages)))
        steps[known] = self.seen[at[known]]
        other = codes[~known]
        steps[~known] = self.two[other % KINDS**2] + self.missed[other // KINDS]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        likely = np.zeros((len(words), len(self.languages)))
        lettered = np.zeros(len(words), bool)
        if len(heads):
            likely[owner[heads]] = np.add.reduceat(steps, heads, axis=0)
            lettered[owner[heads]] = True
        return likely, lettered


def fit_shares(odds, times, heads, start):
    """Expectation-maximisation of every document at once: ``(shares, log-likelihood)``.

    ``odds`` and ``times`` are the rows of all documents' words, ``heads`` where
    each document's rows begin; a share that is 0 in ``start`` stays 0.
    """
    import numpy as np

    lengths = np.diff(np.append(heads, len(odds)))
    doc, total = np.repeat(np.arange(len(heads)), lengths), np.add.reduceat(times, heads)
    shares, moving = start.copy(), np.arange(len(heads))
    rows = np.arange(len(odds))
    for _ in range(ROUNDS):
        local = np.concatenate([[0], np.cumsum(lengths[moving])[:-1]])
        parts = odds[rows] * shares[doc[rows]]
        parts *= (times[rows] / parts.sum(axis=1))[:, None]
        new = np.add.reduceat(parts, local, axis=0) / total[moving][:, None]
        still = np.abs(new - shares[moving]).max(axis=1) > STEADY
        shares[moving] = new
        if not still.any():
            break
        rows = rows[np.repeat(still, lengths[moving])]
        moving = moving[still]
    return shares, np.add.reduceat(times * np.log((odds * shares[doc]).sum(axis=1)), heads)


def choose(odds, times, heads):
    """Shares of the languages chosen for each document.

    The first language is the likeliest alone.  The next is the one that lifts the
    likelihood most steeply; it stays if the gain exceeds the penalty.
    """
    import numpy as np

    n = len(heads)
    lengths = np.diff(np.append(heads, len(odds)))
    doc, total = np.repeat(np.arange(n), lengths), np.add.reduceat(times, heads)
    alone = np.add.reduceat(times[:, None] * np.log(odds), heads, axis=0)
    shares = np.zeros((n, odds.shape[1]))
    shares[np.arange(n), alone.argmax(axis=1)] = 1.0
    best, todo = alone.max(axis=1), np.arange(n)
    price = PENALTY * np.log1p(total)
    while len(todo) and odds.shape[1] > 1:
        rows = np.flatnonzero(np.isin(doc, todo))
        local = np.concatenate([[0], np.cumsum(lengths[todo])[:-1]])
        mixed = (odds[rows] * shares[doc[rows]]).sum(axis=1)
        slope = np.add.reduceat(odds[rows] * (times[rows] / mixed)[:, None], local, axis=0) - total[todo][:, None]
        slope[shares[todo] > 0] = -1
        rising = slope.max(axis=1) > 0  # the likelihood is concave in the shares: no slope, no gain
        todo, slope = todo[rising], slope[rising]
        if not len(todo):
            break
        rows = np.flatnonzero(np.isin(doc, todo))
        local = np.concatenate([[0], np.cumsum(lengths[todo])[:-1]])
        start = shares[todo] * 0.9
        start[np.arange(len(todo)), slope.argmax(axis=1)] = 0.1
        tried, reached = fit_shares(odds[rows], times[rows], local, start)
        better = reached - best[todo] > price[todo]
        shares[todo[better]], best[todo[better]] = tried[better], reached[better]
        todo = todo[better & ((shares[todo] > 0).sum(axis=1) < odds.shape[1])]
    return shares


def identify(model: Model, texts: list[str]):
    """Per text the shares of the chosen languages; all 0 where nothing has a letter."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    shares = np.zeros((len(texts), len(model.languages)))
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    likely, lettered = model.words(coded.dictionary)
    if not lettered.any() or not model.languages:
        return shares
    odds = np.maximum(np.exp(likely - likely.max(axis=1, keepdims=True)), LEAST_RATIO)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    used = lettered[word]
    codes, times = np.unique(doc[used] * len(lettered) + word[used], return_counts=True)
    doc, word = codes // len(lettered), codes % len(lettered)
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    shares[doc[heads]] = choose(odds[word], times.astype(float), heads)
    return shares


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts of all rows with a text and a language, summed on Spark.

    ``TRIPLES`` bounds the sequences of three bytes the model holds; the number of
    languages is that of the column's values.  Both together go to all tasks.
    """
    known = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for langs, texts in slices(batch, SLICE, "lang", "text"):
                names, which = np.unique(np.array(langs, object), return_inverse=True)
                lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
                coded = lists.flatten().dictionary_encode()
                of = np.repeat(which, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                pairs, times = np.unique(of * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                owner, codes = triples(coded.dictionary)
                starts = np.searchsorted(owner, np.arange(len(coded.dictionary) + 1))
                out = [(n, 0, 0) for n in names]  # a language without a letter is one too
                for k, name in enumerate(names):
                    mine = pairs // max(len(coded.dictionary), 1) == k
                    weight = np.zeros(len(coded.dictionary))
                    weight[pairs[mine] % max(len(coded.dictionary), 1)] = times[mine]
                    found, at = np.unique(codes, return_inverse=True)
                    sums = np.bincount(at, np.repeat(weight, np.diff(starts)), len(found))
                    out += [(name, c, s) for c, s in zip(found.tolist(), sums.astype(np.int64).tolist()) if s]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], ["lang", "code", "n"])

    sums = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).persist()
    try:
        languages = sorted(r["lang"] for r in sums.select("lang").distinct().collect())
        wide = sums.where("code > 0").groupBy("code").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("by"))
        number = {name: i for i, name in enumerate(languages)}
        rows = [(r["code"], number[x["lang"]], x["n"]) for r in wide.orderBy(F.desc("n"), "code").limit(TRIPLES).collect() for x in r["by"]]
    finally:
        sums.unpersist()
    return Model(languages, rows)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from learning; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, langs, shares)`` of every whole text; other columns are not read.

    ``langs`` lists the chosen languages by falling ``shares`` (ties by name), the
    first is ``lang_pred`` and its share the ``score``.  A text that is null, empty
    or has no letter, and any text under a model without languages, is ``und``
    with score 0 and no languages.  Repeated rows come back as often as given.
    Rows are independent: nothing is shuffled.  Words are counted per slice of
    text, a long text takes memory in proportion to its words.
    """
    step = max(SLICE * 4 // max(len(model.languages), 4), 1 << 16)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for keys, texts in slices(batch, step, "doc_id", "text"):
                shares = identify(model, texts)
                letters = pc.match_substring_regex(pa.array(texts, pa.large_string()), r"\pL").to_pylist()
                out = []
                for key, row, lettered in zip(keys, shares, letters):
                    order = [i for i in np.argsort(-row, kind="stable") if row[i] > 0] if lettered else []
                    langs, parts = [model.languages[i] for i in order], [min(float(row[i]), 1.0) for i in order]
                    out.append((key, langs[0] if langs else UNKNOWN, parts[0] if parts else 0.0, langs, parts))
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "lang_pred", "score", "langs", "shares"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for all rows by a model of those that are not held out, plus ``held_out``."""
    model = learn(docs.where(~held_out(col(id_col))), text_col, lang_col)
    found = predict(docs, model, id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs", "shares")
