"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col, kept, slices

WINDOW, STRIDE = 32, 16  # words
SLICE = 1 << 20
GRAM = 4  # bytes of a character gram of ^word$
BUCKETS = 1 << 18
HIDDEN, WORD, CHAR, ATTEND = 8, 6, 10, 8
VOCABULARY = 4000
STEPS = 300  # updates at least
SURE = 0.8  # of a toxic document's strongest cue, what its second window must hold
CLEAR = 0.2  # of the strongest cue, from which a cue is clear without more evidence
CHANCE = 0.01  # that any cue of a sample with labels by chance passes for a clear one
DECAY = 0.02  # of embeddings in an update, so that chance words of few windows weigh little
CUES = 3000

#: Bounds of the training sample: labelled documents of either class, and windows of one document.
TOXIC_DOCS, OTHER_DOCS, DOC_WINDOWS = 4000, 8000, 2
#: Longest word and window the sample takes in, in bytes; longer ones are scored all the same.
SAMPLE_BYTES = 4096


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def gram_ids(words: list[bytes]):
    """Hashed character grams of all words, flat, and how many each word has."""
    import numpy as np

    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(b"^" + b"$^".join(words) + b"$" * GRAM, np.uint8).astype(np.uint64)
    code = np.zeros(len(flat) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        code = (code << np.uint64(8)) | flat[i : len(flat) - GRAM + 1 + i]
    counts = np.maximum(1, lengths - GRAM + 1)
    starts = np.cumsum(lengths) - lengths
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)
    mixed = code[at] * np.uint64(0x9E3779B97F4A7C15)  # golden-ratio hashing of the gram's bytes
    return (mixed >> np.uint64(64 - 18)).astype(np.int64), counts


def window_spans(n: int) -> list[tuple[int, int]]:
    """All overlapping windows of ``n`` words; one empty window for none."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def sigmoid(x):
    import numpy as np

    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; ``words`` numbers the words with an embedding of their own (0: any other)."""

    words: dict[bytes, int]
    p: dict = field(default_factory=dict)

    @staticmethod
    def fresh(words: list[bytes], seed: int) -> "Network":
        import numpy as np

        random = np.random.default_rng(seed)
        d, h = WORD + CHAR, HIDDEN
        scaled = lambda *shape: random.standard_normal(shape) / np.sqrt(shape[0])
        p = {"words": np.zeros((len(words) + 1, WORD)), "grams": np.zeros((BUCKETS, CHAR))}
        for way in "fb":
            p |= {f"W{way}": scaled(d, 3 * h), f"U{way}": scaled(h, 3 * h), f"b{way}": np.zeros(3 * h)}
        p |= {"Wa": scaled(2 * h, ATTEND), "ba": np.zeros(ATTEND), "va": scaled(ATTEND), "wo": scaled(2 * h), "bo": np.zeros(1)}
        return Network({w: i + 1 for i, w in enumerate(words)}, {k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: list[bytes]):
        """One row per word: its own embedding beside the mean of its grams'."""
        import numpy as np

        if not words:
            return np.zeros((0, WORD + CHAR), np.float32)
        own = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        grams, counts = gram_ids(words)
        sums = np.add.reduceat(self.p["grams"][grams], np.cumsum(counts) - counts, axis=0)
        return np.concatenate([self.p["words"][own], sums / counts[:, None].astype(np.float32)], axis=1)

    def states(self, gates, place, lengths, way: str, trace: list | None = None):
        """Hidden states (time, window, unit) of one direction; ``gates`` are the words' input parts."""
        import numpy as np

        u, h = self.p[f"U{way}"], HIDDEN
        n, steps = place.shape
        state = np.zeros((n, h), np.float32)
        out = np.zeros((steps, n, h), np.float32)
        full = int(lengths.min()) if n else 0
        for t in range(steps) if way == "f" else reversed(range(steps)):
            g = gates[place[:, t]]
            s = state @ u
            rz = sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            new = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
            after = new + z * (state - new)
            if t >= full:
                after = np.where((t < lengths)[:, None], after, state)
            if trace is not None:
                trace.append((t, state, s[:, 2 * h :], r, z, new))
            state = out[t] = after
        return out

    def pool(self, states, lengths):
        """Attention weights over time, the pooled state and the logit."""
        import numpy as np

        u = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        e = np.exp(u @ self.p["va"]) * (np.arange(len(states))[:, None] < lengths)
        a = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * states).sum(axis=0)
        return u, a, pooled, pooled @ self.p["wo"] + self.p["bo"][0]

    def logits(self, words: list[bytes], place, lengths):
        """Logit of every window; ``place`` numbers its words in ``words``."""
        import numpy as np

        x = self.inputs(words) if words else np.zeros((1, WORD + CHAR), np.float32)
        both = np.concatenate([self.states(x @ self.p[f"W{w}"] + self.p[f"b{w}"], place, lengths, w) for w in "fb"], axis=2)
        return self.pool(both, lengths)[3]

    def scores(self, texts: list[bytes | None]) -> list[float]:
        """Probability of the worst window of each text."""
        import numpy as np

        cut = [tokens(t) for t in texts]
        number = dict.fromkeys(w for ws in cut for w in ws)
        for i, w in enumerate(number):
            number[w] = i
        flat = np.fromiter((i for ws in cut for i in map(number.__getitem__, ws)), np.int64, sum(map(len, cut)))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        windows = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
        first = np.cumsum(windows) - windows
        own = np.arange(windows.sum()) - np.repeat(first, windows)
        start = own * STRIDE
        lengths = np.minimum(WINDOW, np.repeat(sizes, windows) - start)
        begin = np.repeat(np.cumsum(sizes) - sizes, windows) + start
        logits = np.empty(len(begin), np.float32)
        words = list(number)
        x = self.inputs(words) if words else np.zeros((1, WORD + CHAR), np.float32)
        gates = {w: x @ self.p[f"W{w}"] + self.p[f"b{w}"] for w in "fb"}
        step = 4096
        for k in range(0, len(begin), step):
            at, long = begin[k : k + step], lengths[k : k + step]
            width = max(1, int(long.max()))
            spread = np.minimum(at[:, None] + np.arange(width), max(0, len(flat) - 1))
            place = flat[spread] if len(flat) else np.zeros(spread.shape, np.int64)
            both = np.concatenate([self.states(gates[w], place, long, w) for w in "fb"], axis=2)
            logits[k : k + step] = self.pool(both, long)[3]
        return sigmoid(np.maximum.reduceat(logits, first).astype(np.float64)).tolist() if len(first) else []


def gradients(net: Network, x, lengths, y, weight):
    """Weighted cross-entropy of windows ``x`` (window, time, input) and its gradients, those of ``x`` included."""
    import numpy as np

    p, h = net.p, HIDDEN
    n, steps, d = x.shape
    place = np.arange(n * steps).reshape(n, steps)
    flat = x.reshape(n * steps, d)
    traces: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([net.states(flat @ p[f"W{w}"] + p[f"b{w}"], place, lengths, w, traces[w]) for w in "fb"], axis=2)
    u, a, pooled, logit = net.pool(both, lengths)
    guess = sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).mean())
    g: dict = {}
    dlogit = (weight * (guess - y) / n).astype(np.float32)
    g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
    dpool = dlogit[:, None] * p["wo"]
    da = (both * dpool).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    dpre = de[:, :, None] * p["va"] * (1 - u * u)
    g["va"], g["ba"] = np.einsum("tna,tn->a", u, de), dpre.sum(axis=(0, 1))
    g["Wa"] = np.einsum("tnk,tna->ka", both, dpre)
    dboth = a[:, :, None] * dpool + dpre @ p["Wa"].T
    dx = np.zeros_like(x)
    for i, w in enumerate("fb"):
        dout, du = dboth[:, :, i * h : (i + 1) * h], np.zeros_like(p[f"U{w}"])
        dw, db = np.zeros_like(p[f"W{w}"]), np.zeros_like(p[f"b{w}"])
        carry = np.zeros((n, h), np.float32)
        for t, before, sn, r, z, new in reversed(traces[w]):
            dh = carry + dout[t]
            live = (t < lengths)[:, None]
            dn = np.where(live, dh, 0)
            dan = dn * (1 - z) * (1 - new * new)
            dar, daz = dan * sn * r * (1 - r), dn * (before - new) * z * (1 - z)
            ds = np.concatenate([dar, daz, dan * r], axis=1)
            dg = np.concatenate([dar, daz, dan], axis=1)
            du += before.T @ ds
            dw += x[:, t].T @ dg
            db += dg.sum(axis=0)
            dx[:, t] += dg @ p[f"W{w}"].T
            carry = np.where(live, dn * z + ds @ p[f"U{w}"].T, dh)
        g |= {f"U{w}": du, f"W{w}": dw, f"b{w}": db}
    return loss, g, dx


def fit(windows: list[tuple[list[bytes], int]], vocabulary: list[bytes], epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """Trains on windows of words with 0/1 labels by Adam, classes weighted alike but for a lean to 0.

    Half of the words have their own embedding masked in every step, so that
    characters alone can tell a word, seen or not.
    """
    import numpy as np

    net = Network.fresh(vocabulary, seed)
    random = np.random.default_rng(seed)
    if not windows:
        net.p["bo"][0] = -3.0
        return net
    words = list(dict.fromkeys(w for ws, _ in windows for w in ws))
    number = {w: i for i, w in enumerate(words)}
    own = np.array([net.words.get(w, 0) for w in words] or [0])
    grams, counts = gram_ids(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    used, grams = np.unique(grams, return_inverse=True)  # only grams of the sample have weights
    table = {"words": net.p["words"], "grams": np.zeros((max(1, len(used)), CHAR), np.float32)}
    offsets = np.cumsum(counts) - counts
    place = np.zeros((len(windows), WINDOW), np.int64)
    lengths = np.array([len(ws) for ws, _ in windows])
    for i, (ws, _) in enumerate(windows):
        place[i, : len(ws)] = [number[w] for w in ws]
    y = np.array([v for _, v in windows], np.float32)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 1.0 / max(1 - share, 1e-3)).astype(np.float32)
    params = net.p | table
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items() if k != "grams" or len(v)}
    epochs = max(epochs, -(-STEPS * batch // len(windows)))  # few windows are seen more often
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(windows))
        pace = rate * (1 - epoch / epochs) + rate / 20
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            seen, at = np.unique(place[rows], return_inverse=True)
            at = at.reshape(len(rows), WINDOW)
            spans = [np.arange(offsets[s], offsets[s] + counts[s]) for s in seen.tolist()] if len(counts) else [np.zeros(1, np.int64)]
            gram = grams[np.concatenate(spans)] if len(counts) else np.zeros(1, np.int64)
            size = np.array([len(s) for s in spans])
            cuts = np.cumsum(size) - size
            chars = np.add.reduceat(params["grams"][gram], cuts, axis=0) / size[:, None]
            shown = random.random(len(seen)) < 0.5
            rows_in = np.concatenate([params["words"][own[seen]] * shown[:, None], chars], axis=1).astype(np.float32)
            net.p = params
            _, g, dx = gradients(net, rows_in[at], lengths[rows], y[rows], weight[rows])
            dflat = dx.reshape(-1, dx.shape[2])
            dwords = np.stack([np.bincount(at.reshape(-1), dflat[:, c], len(seen)) for c in range(dflat.shape[1])], axis=1)
            g["words"], g["grams"] = np.zeros_like(params["words"]), np.zeros_like(params["grams"])
            np.add.at(g["words"], own[seen], dwords[:, :WORD] * shown[:, None])
            dchar = np.repeat(dwords[:, WORD:] / size[:, None], size, axis=0)
            for c in range(CHAR):
                g["grams"][:, c] = np.bincount(gram, dchar[:, c], len(params["grams"]))
            g["words"][0] = 0  # any other word: no embedding
            step += 1
            for name, grad in g.items():
                first, second = moment[name]
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                if name in ("words", "grams"):
                    params[name] *= 1 - pace * DECAY
                params[name] -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    every = np.zeros((BUCKETS, CHAR), np.float32)
    if len(used):
        every[used] = params["grams"]
    net.p = params | {"grams": every}
    return net


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """True for rows whose labels are never used; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, toxic)`` of at most TOXIC_DOCS + OTHER_DOCS labelled training documents, near copies once.

    Documents are taken by the hash of their id; of those that share the least
    hash of their five-word shingles one stays, as a text copied a thousand
    times would pass for a thousand observations.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [marks.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in (("toxic = 1", TOXIC_DOCS), ("toxic = 0", OTHER_DOCS))]
    bounded = some[0].union(some[1])  # 12,000 rows of two numbers

    def least(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for ids, toxic, texts in slices(batch, SLICE, "doc_id", "toxic", "text"):
                found = []
                for t in texts:
                    ws = tokens(t)
                    found.append(min(xxhash.xxh3_64_intdigest(b" ".join(ws[i : i + 5])) for i in range(max(1, len(ws) - 4))) - (1 << 63))
                arrays = [pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(texts, pa.binary()), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "text", "least"])

    taken = docs.join(F.broadcast(bounded), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    hashed = kept(taken.mapInArrow(least, "doc_id long, toxic int, text binary, least long"))
    return hashed.orderBy("doc_id").dropDuplicates(["least", "toxic"]).select("doc_id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """A network fitted on the bounded sample.

    Cues (words and character grams) are counted by class over the sample's
    documents.  A cue is clear if labels by chance would hardly give its counts
    (Chernoff's bound for its documents, over all cues counted), however common
    others are, or if it is among the strongest.  A toxic document gives the windows where the strongest clear
    cues stand, if it has any, any other its hardest window and one by hash; these windows, a few MB
    at most, are all of the texts that reaches the driver.
    """
    import math

    found = kept(sample(docs, labels))

    def cues_of(words: set[bytes]) -> set[bytes]:
        grams = {w[i : i + GRAM] for x in words if len(x) <= SAMPLE_BYTES for w in [b"^" + x + b"$"] for i in range(len(w) - GRAM + 1)}
        return {b"w" + w for w in words if len(w) <= 64} | {b"g" + g for g in grams}

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            for toxic, texts in slices(batch, SLICE, "toxic", "text"):
                for y, t in zip(toxic, texts):
                    for cue in cues_of(set(tokens(t))):
                        seen.setdefault(cue, [0, 0])[1 if y else 0] += 1
                if len(seen) > 500_000:
                    yield _counted(pa, seen)
                    seen = {}
        yield _counted(pa, seen)

    counts = kept(found.select("toxic", "text").mapInArrow(count, "cue binary, others long, toxic long").groupBy("cue").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic")))
    total = found.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("y"), F.count(F.when(F.col("toxic") <= 0, 1)).alias("n")).first()
    odds = F.log((F.col("toxic") + 0.5) / F.lit(total["y"] + 1.0)) - F.log((F.col("others") + 0.5) / F.lit(total["n"] + 1.0))
    base = total["y"] / max(1, total["y"] + total["n"])
    n = F.col("toxic") + F.col("others")
    part = lambda k, share: F.when(k > 0, k * F.log(k / n / F.lit(max(share, 1e-9)))).otherwise(0.0)
    evidence = part(F.col("toxic"), base) + part(F.col("others"), 1 - base)
    strong = counts.withColumns({"gain": odds * F.sqrt("toxic"), "evidence": evidence}).where((F.col("toxic") >= 3) & (odds > math.log(3)))
    rows = strong.orderBy(F.desc("gain"), "cue").limit(CUES).collect()
    cues = {bytes(r["cue"]): r["gain"] for r in rows}
    need = math.log(max(1, counts.count()) / CHANCE)
    floor = CLEAR * max(cues.values(), default=0.0)
    clear = {bytes(r["cue"]): r["gain"] for r in rows if r["evidence"] >= need or r["gain"] >= floor}  # other labels are taken for noise
    common = counts.where("substring(cue, 1, 1) = x'77' and toxic + others >= 3").orderBy(F.desc(F.expr("toxic + others")), "cue").limit(VOCABULARY)
    vocabulary = sorted({bytes(r["cue"])[1:] for r in common.collect()} | {c[1:] for c in cues if c[:1] == b"w"})

    def choose(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for ids, toxic, texts in slices(batch, SLICE, "doc_id", "toxic", "text"):
                label, text = [], []
                for i, y, t in zip(ids, toxic, texts):
                    ws = tokens(t)
                    known = clear if y else cues
                    gain = {w: max((known.get(c, 0.0) for c in cues_of({w})), default=0.0) for w in set(ws)}
                    spans = window_spans(len(ws))
                    rated = sorted(((-max((gain[w] for w in ws[a:b]), default=0.0), a, b) for a, b in spans))
                    taken = rated[:DOC_WINDOWS] if y else [rated[0], (0.0, *spans[xxhash.xxh64_intdigest(str(i)) % len(spans)])]
                    for g, a, b in taken:
                        if not y or ((g < 0 or not clear) and (g <= SURE * rated[0][0] or (a, b) == rated[0][1:])):
                            joined = b" ".join(ws[a:b])
                            if len(joined) <= SAMPLE_BYTES:
                                label.append(1 if y else 0)
                                text.append(joined)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(text, pa.binary())], ["toxic", "text"])

    rows = found.mapInArrow(choose, "toxic int, text binary").collect()
    windows = sorted({(bytes(r["text"]), r["toxic"]) for r in rows})
    return fit([(t.split(), y) for t, y in windows], vocabulary)


def _counted(pa, seen: dict[bytes, list[int]]):
    arrays = [pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["cue", "others", "toxic"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Every text is cut into windows of 32 words, a new one every 16 words, all of
    which are scored; the score is that of the worst.  ``predicted`` is 1 from
    ``threshold`` on.  Null and empty texts are one empty window and get the
    network's score without input.  Labels of held-out rows are never read;
    without any label everything scores low.  Equal texts score alike, repeated
    rows come back as often as given; other columns are not read.  Nothing of
    the scoring is shuffled.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text"))
    scored = rows.select("doc_id", scorer(rows, labels)("text").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scorer(rows: DataFrame, labels: DataFrame):
    """A function of a binary text column that gives its score; trained on ``rows (doc_id, text binary)``."""
    net = rows.sparkSession.sparkContext.broadcast(train(rows, labels.select("doc_id", "toxic")))  # a fixed size, about 11 MB

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        out: list[float] = []
        some: list = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t or b"")
            if size >= SLICE:
                out += net.value.scores(some)
                some, size = [], 0
        return pd.Series(out + (net.value.scores(some) if some else []), dtype="float64")

    return toxicity


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with all columns whose score is below ``threshold``; see ``score``."""
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text"), F.struct("*").alias("row"))
    mark = scorer(rows.select("doc_id", "text"), labels)
    return rows.where(mark("text") < threshold).select("row.*")
