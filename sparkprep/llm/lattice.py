"""Language-model scoring by a subword lattice: every segmentation of a word counts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col, kept, slices

SLICE = 16 << 20  # bytes of text whose words are counted together
OUT = 8192  # rows of a batch handed over
TOGETHER = 1 << 19  # bytes of words learnt from together
CELLS = 1 << 18  # word positions of a table
MARK = "▁"
PRIOR = 1000.0  # rank at which the prior weight of a piece has halved
SMOOTH = 1e-3
LEAST_GAIN = 1e-3  # learning ends when held-out words get likelier by less, relatively
CHECKED = 10  # one training word in so many checks the learning
LN10 = math.log(10)
END = ""  # the end of a text, counted as a token: no word is empty


class Pieces:
    """A word's log-probability under a unigram model of its pieces.

    The vocabulary is an existing one.  Its scores are negative ranks (most
    useful piece first); they become prior weights 1 / (rank + 1000), and after
    learning the pieces' expected counts take their place.  A character without
    a piece is spelled in byte pieces, so every word has a probability.  Only a
    piece at the start of a word carries the word mark, hence a sequence of
    pieces gives back its words, and the probabilities of all words add up to at
    most one.
    """

    def __init__(self, log_weights: dict[str, float], log_end: float = 0.0):
        self.log = log_weights
        self.log_end = log_end
        self.longest = max((len(p) for p in log_weights), default=0)

    @staticmethod
    def vocabulary(path: str) -> tuple[dict[str, float], float]:
        """Prior log-weights of the pieces and of the end symbol, normalised."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                weights[" " + piece[3:5]] = 1.0 / (len(weights) + 30 * PRIOR)  # a space: no word has one
            elif MARK not in piece[1:]:
                weights[piece] = 1.0 / (-model.get_score(i) + PRIOR)
        weights[END] = sum(weights.values()) / 8
        total = math.log(sum(weights.values()))
        logs = {p: math.log(w) - total for p, w in weights.items()}
        return logs, logs.pop(END)

    @staticmethod
    def pieces_only(logs: dict[str, float], log_end: float) -> dict[str, float]:
        """The pieces' log-weights without the end's share."""
        rest = math.log1p(-math.exp(log_end))
        return {p: w - rest for p, w in logs.items()}

    def arcs(self, text: str, i: int) -> list[tuple[int, str | None, float]]:
        """``(end, piece, weight)`` of the arcs from position ``i``; piece None: the character in byte pieces."""
        found = []
        for j in range(i + 1, min(len(text), i + self.longest) + 1):
            weight = self.log.get(text[i:j])
            if weight is not None:
                found.append((j, text[i:j], weight))
        if text[i] not in self.log:
            found.append((i + 1, None, self.spelled(text[i])))
        return found

    def forwards(self, text: str) -> list[float]:
        """Log sum over the ways to each position; sums for positions not yet reached are kept, arcs are not."""
        sums = [-math.inf] * (len(text) + 1)
        sums[0] = 0.0
        for i in range(len(text)):
            if sums[i] > -math.inf:
                for j, _, weight in self.arcs(text, i):
                    sums[j] = _add(sums[j], sums[i] + weight)
        return sums

    def forward(self, word: str) -> float:
        """Natural log of the marginal probability: a recursion over positions in log space."""
        return self.forwards(MARK + word)[-1]

    def expect(self, word: str, times: float, into: dict[str, float]) -> None:
        """Add the expected number of each piece; memory in proportion to the word."""
        text = MARK + word
        before = self.forwards(text)
        after = [-math.inf] * len(text) + [0.0]
        for i in reversed(range(len(text))):
            if before[i] > -math.inf:
                for j, piece, weight in self.arcs(text, i):
                    after[i] = _add(after[i], weight + after[j])
                    share = times * math.exp(before[i] + weight + after[j] - before[-1])
                    for p in (piece,) if piece is not None else _bytes(text[i]):
                        into[p] = into.get(p, 0.0) + share

    def spelled(self, character: str) -> float:
        return sum(self.log[b] for b in _bytes(character))


def _bytes(character: str) -> list[str]:
    return [f" {b:02X}" for b in character.encode("utf-8", "surrogatepass")]


class Lattices:
    """The same recursion over many words at a time, one row of a table each."""

    WIDEST = 64  # longer words go one by one
    DENSE = 128  # characters with a column of their own in the table of the piece tree

    def __init__(self, model: Pieces):
        import numpy as np

        self.model = model
        self.names = sorted(model.log)
        self.weight = np.array([model.log[p] for p in self.names])
        seen: dict[str, int] = {}
        tree: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for number, piece in enumerate(self.names):
            node = 0
            for ch in piece:
                seen[ch] = seen.get(ch, 0) + 1
                if (node, ch) not in tree:
                    tree[node, ch] = nodes
                    nodes += 1
                node = tree[node, ch]
            ends[node] = number
        common = sorted(seen, key=lambda ch: -seen[ch])[: self.DENSE]
        self.column = np.full(0x110000, -1, np.int32)
        self.column[[ord(ch) for ch in common]] = np.arange(len(common))
        self.dense = np.full((nodes, self.DENSE), -1, np.int32)
        rare = {}
        for (node, ch), child in tree.items():
            if (at := self.column[ord(ch)]) >= 0:
                self.dense[node, at] = child
            else:
                rare[node * 0x110000 + ord(ch)] = child
        self.rare = np.array(sorted(rare) or [-1], np.int64)
        self.rare_child = np.array([rare[k] for k in sorted(rare)] or [-1], np.int32)
        self.piece = np.full(nodes, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.names if len(p) == 1]] = True

    def child(self, node, character):
        import numpy as np

        at = self.column[character]
        out = np.where(at >= 0, self.dense[node, at], -1)
        if (other := at < 0).any():
            key = node[other].astype(np.int64) * 0x110000 + character[other]
            i = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[other] = np.where(self.rare[i] == key, self.rare_child[i], -1)
        return out

    def _table(self, words: list[str]):
        """Characters (0 beyond the end) and lengths of the marked words."""
        import numpy as np

        lengths = np.array([len(w) + 1 for w in words])
        width = int(lengths.max())
        flat = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        table = np.zeros((len(words), width), np.int64)
        table[np.arange(width) < lengths[:, None]] = flat
        return table, lengths, width

    def _run(self, words: list[str]):
        """Forward log sums by position, and the arcs used: start, length, rows, pieces (or -1 and the spelled weight)."""
        import numpy as np

        table, lengths, width = self._table(words)
        alpha = np.full((len(words), width + 1), -np.inf)
        alpha[:, 0] = 0.0
        arcs = []
        for i in range(width):
            rows = np.nonzero(lengths > i)[0]
            lone = rows[~self.single[table[rows, i]]]
            if len(lone):
                found, back = np.unique(table[lone, i], return_inverse=True)
                weight = np.array([self.model.spelled(chr(c)) for c in found.tolist()])[back]
                alpha[lone, i + 1] = np.logaddexp(alpha[lone, i + 1], alpha[lone, i] + weight)
                arcs.append((i, 1, lone, None, weight))
            node = np.zeros(len(rows), np.int32)
            for step in range(1, min(self.model.longest, width - i) + 1):
                node = self.child(node, table[rows, i + step - 1])
                go = (node >= 0) & (lengths[rows] >= i + step)
                rows, node = rows[go], node[go]
                if not len(rows):
                    break
                piece = self.piece[node]
                hit = piece >= 0
                r, q = rows[hit], piece[hit]
                weight = self.weight[q]
                alpha[r, i + step] = np.logaddexp(alpha[r, i + step], alpha[r, i] + weight)
                arcs.append((i, step, r, q, weight))
        return alpha, lengths, arcs, table

    def _groups(self, words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            sizes.setdefault(max(3, len(w).bit_length()), []).append(i)
        for bits, group in sizes.items():
            step = max(1, CELLS >> bits)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                yield part, [words[i] for i in part]

    def forward(self, words: list[str]):
        """Natural log of the marginal probability of each word."""
        import numpy as np

        out = np.empty(len(words))
        for at, group in self._groups(words):
            if len(group[0]) >= self.WIDEST:
                out[at] = [self.model.forward(w) for w in group]
            else:
                alpha, lengths, _, _ = self._run(group)
                out[at] = alpha[np.arange(len(group)), lengths]
        return out

    def expected(self, words: list[str], counts):
        """Expected number of each piece (in the order of ``names``), words weighted by ``counts``."""
        import numpy as np

        out = np.zeros(len(self.names))
        number = {p: i for i, p in enumerate(self.names)}
        for at, group in self._groups(words):
            if len(group[0]) >= self.WIDEST:
                long: dict[str, float] = {}
                for i, w in zip(at, group):
                    self.model.expect(w, float(counts[i]), long)
                out[[number[p] for p in long]] += list(long.values())
                continue
            part, times = group, counts[at]
            alpha, lengths, arcs, table = self._run(part)
            beta = np.full(alpha.shape, -np.inf)
            beta[np.arange(len(part)), lengths] = 0.0
            total = alpha[np.arange(len(part)), lengths]
            for i, n, r, q, weight in reversed(arcs):
                beta[r, i] = np.logaddexp(beta[r, i], beta[r, i + n] + weight)
            found = []
            for i, n, r, q, weight in arcs:
                share = times[r] * np.exp(alpha[r, i] + weight + beta[r, i + n] - total[r])
                if q is not None:
                    found.append((q, share))
                else:
                    for ch, x in zip(table[r, i].tolist(), share.tolist()):
                        for b in _bytes(chr(ch)):
                            out[number[b]] += x
            if found:
                out += np.bincount(*map(np.concatenate, zip(*found)), len(out))
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b)); a can be minus infinity."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """True for rows the model does not learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, rounds: int = 8) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at white space and closed by one
    end token.  ``base_score`` is the log10 probability under smoothed counts of
    whole tokens in the training rows, ``score`` that of the lattice model: the
    product over the words of their marginal probability over all ways through
    the lattice, times the end's.  A training word is an arc of its own with its
    discounted count; what the discounts leave goes to the segmentations into
    pieces.  The discount comes from the words seen once and twice.  Piece weights
    start from the vocabulary's and are learnt from the distinct training words,
    in at most ``rounds`` rounds, until held-out words gain nothing more.  The
    probabilities of all texts add up to one at most; the base's do not, as every
    unseen word has the share of half an occurrence.  A null text is empty and holds the end
    alone.  Repeated rows count and come back as often as given; an empty table
    gives an empty one.  Other columns are not read.

    Each slice of documents (about 16 MB of text) writes its distinct words with
    their training counts, and its documents as numbers of these words.  Words
    are summed over all slices with map-side combine, get their probability
    once, and are joined back to the slices that hold them; a word has one row
    per slice, however frequent it is.  Piece weights (one number per piece of the given
    vocabulary) are all that reaches the driver.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(col(id_col), folds, fold), F.lit(False)).alias("held"), col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        names = ["slice", "word", "place", "trained", "doc_id", "held", "places", "counts"]
        for batch in batches:
            for ids, held, texts in slices(batch, SLICE, "doc_id", "held", "text"):
                name = (part << 32) | place
                place += 1
                number: dict[bytes, int] = {}
                learn, docs_out = [], []
                for i, h, t in zip(ids, held, texts):
                    own = Counter((t or b"").lower().split())
                    own[b""] = 1
                    new = [w for w in own if w not in number]
                    number.update(zip(new, range(len(number), len(number) + len(new))))
                    places = np.fromiter(map(number.__getitem__, own), "<i4", len(own))
                    counts = np.fromiter(own.values(), "<i4", len(own))
                    if not h:
                        learn.append((places, counts))
                    docs_out.append((i, h, places.tobytes(), counts.tobytes()))
                trained = np.zeros(len(number), np.int64)
                if learn:
                    at, times = (np.concatenate(x) for x in zip(*learn))
                    trained += np.bincount(at, times, len(number)).astype(np.int64)
                keys = list(number)
                del number, learn
                for k in range(0, len(keys), OUT):  # small batches: the receiving side holds them whole
                    own = keys[k : k + OUT]
                    known = [pa.array(own, pa.binary()), pa.array(np.arange(k, k + len(own)), pa.int32()), pa.array(trained[k : k + OUT])]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.int64()), *known, *(pa.nulls(len(own), t) for t in kinds[4:])], names)
                for k in range(0, len(docs_out), OUT):
                    own = docs_out[k : k + OUT]
                    known = [pa.array(x, t) for x, t in zip(zip(*own), kinds[4:])]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.int64()), *(pa.nulls(len(own), t) for t in kinds[1:4]), *known], names)

    counted = kept(rows.mapInArrow(count, "slice long, word binary, place int, trained long, doc_id long, held boolean, places binary, counts binary"))
    words = counted.where("word is not null").select("slice", "word", "place", "trained")
    documents = counted.where("word is null").select("slice", "doc_id", "held", "places", "counts")
    corpus = kept(words.groupBy("word").agg(F.sum("trained").alias("c")))
    times = lambda k: F.count(F.when((F.col("c") == k) & (F.length("word") > 0), 1))
    n, v, ends, once, twice = corpus.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)), times(1), times(2)).first()
    discount = once / (once + 2 * twice) if once else 0.5
    log_all = math.log(n + 2)
    log_end, log_pieces = math.log(ends + 0.5) - log_all, math.log(discount * max(v - 1, 0) + 1.5) - log_all

    logs, reached = Pieces.pieces_only(*Pieces.vocabulary(vocabulary)), -math.inf
    for _ in range(rounds):
        learnt, likely = _learn(corpus, logs)
        if learnt is None or likely - reached < LEAST_GAIN * abs(likely):
            break
        logs, reached = learnt, likely

    def weigh(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = Lattices(Pieces(logs))
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = model.forward([w.decode("utf-8", "replace") for w in words]) + log_pieces
            c = batch.column(1).to_numpy()
            found[c > 0] = np.logaddexp(found[c > 0], np.log(c[c > 0] - discount) - log_all)
            found[[i for i, w in enumerate(words) if not w]] = log_end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found / LN10)], ["word", "c", "lattice"])

    weighed = corpus.select("word", "c").mapInArrow(weigh, "word binary, c long, lattice double")
    weighed = words.select("slice", "word", "place").join(weighed, "word").select(F.col("slice").alias("part"), "place", "c", "lattice")

    def add(key: tuple, left, right):
        import numpy as np
        import pandas as pd

        size = int(right["place"].max()) + 1 if len(right) else 0
        table = np.zeros((3, size))
        c = right["c"].to_numpy()
        table[:, right["place"].to_numpy()] = c > 0, np.log10((c + 0.5) / (n + 0.5 * (v + 1))), right["lattice"].to_numpy()
        out = []
        for i, h, p, c in zip(left["doc_id"], left["held"], left["places"], left["counts"]):
            at, k = np.frombuffer(p, "<i4"), np.frombuffer(c, "<i4")
            known, base, lattice = (table[:, at] * k).sum(axis=1)
            out.append((i, h, int(k.sum()), int(known), n, base, lattice))
        return pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    parts = max(documents.select("slice").distinct().count() // 2, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = documents.withColumn("doc_id", F.col("doc_id").cast("string")).repartition(parts, "slice")
    scored = named.groupBy("slice").cogroup(weighed.repartition(parts, "part").groupBy("part")).applyInPandas(add, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def _joined(batches: Iterator, size: int) -> Iterator[list[tuple]]:
    """Rows of the batches, at least ``size`` bytes of the first column at a time but for the last: many words share each step."""
    rows, held = [], 0
    for batch in batches:
        rows += zip(*(x.to_pylist() for x in batch.columns))
        held += batch.column(0).nbytes
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _learn(corpus: DataFrame, logs: dict[str, float]) -> tuple[dict[str, float] | None, float]:
    """One round of expectation-maximisation over the distinct training words, each
    counting once, as an unseen word resembles the rare ones.  Returns the new
    weights and the mean log-probability, under the old ones, of the words kept aside."""

    def expect(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = Lattices(Pieces(logs))
        into, likely, aside = np.zeros(len(model.names)), 0.0, 0
        for rows in _joined(batches, TOGETHER):
            words, checks = ([w.decode("utf-8", "replace") for w, c in rows if c == want] for want in (False, True))
            into += model.expected(words, np.ones(len(words)))
            likely, aside = likely + float(model.forward(checks).sum()), aside + len(checks)
        used = np.flatnonzero(into)
        names = [None, *(model.names[i] for i in used)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([likely, *into[used]]), pa.array([aside] + [0] * len(used), pa.int64())], ["piece", "n", "aside"])

    check = F.pmod(F.xxhash64("word"), F.lit(CHECKED)) == 0
    rows = corpus.where("c > 0 and length(word) > 0").select("word", check.alias("check")).mapInArrow(expect, "piece string, n double, aside long")
    got = rows.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("aside").alias("aside")).collect()
    counts = {r["piece"]: r["n"] for r in got if r["piece"] is not None}
    if not counts:
        return None, -math.inf
    likely, aside = next((r["n"], r["aside"]) for r in got if r["piece"] is None)
    weights = {p: counts.get(p, 0.0) + SMOOTH for p in logs}
    total = math.log(sum(weights.values()))
    return {p: math.log(w) - total for p, w in weights.items()}, likely / max(aside, 1)
