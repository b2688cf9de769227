"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of consecutive words with smallest period ``q``, at least
``2 * q`` words long, that no neighbouring word extends.  The words of a slice of
documents become one Re-Pair grammar.  A run lies whole in some symbol of the
derivation and crosses the boundary of the lowest such symbol, so the runs across
a symbol's boundary are computed once per symbol, moved to every place where the
symbol is derived, and pieces of one run are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col, slices

LEAST = 12  # words of the shortest run
SLICE = 4 << 20  # bytes of text whose words share a grammar
BUCKETS = 22  # bits of the table that sorts out sequences that cannot repeat
MIX = 0x9E3779B97F4A7C15

RUNS = "array<struct<start: long, length: long, period: long>>"


def split_words(texts: list[str]):
    """Words of all texts in one Arrow array, and where the words of each text end."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), seen[np.cumsum(counts, dtype=np.int64)]


def repeating(ids, ends, size: int):
    """Per word whether it stands in a sequence of ``size`` words that its text holds twice; a few more may be marked."""
    import numpy as np

    n = len(ids)
    marked = np.zeros(n + 1, np.int64)
    if n < size:
        return marked[:-1] > 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        keys = keys * np.uint64(0xD1B54A32D192ED03) + mixed[k : n - size + 1 + k]
    text = np.searchsorted(ends, np.arange(n - size + 1), "right")
    inside = np.flatnonzero(np.arange(size, n + 1) <= ends[text])
    keys = (keys[inside] ^ (text[inside].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))) * np.uint64(MIX)
    spots = (keys >> np.uint64(64 - BUCKETS)).astype(np.int64)
    some = np.bincount(spots, minlength=1 << BUCKETS)[spots] > 1
    keys, inside = keys[some], inside[some]
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    starts = inside[twice]
    marked += np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(marked[:-1]) > 0


class Grammar:
    """Re-Pair: pairs of neighbouring symbols that occur twice become symbols, the most frequent first.

    Pairs that do not overlap a more frequent one do not disturb each other and
    are replaced in one round.  Frequencies that tie are ordered by a hash, which
    keeps derivations of long repeats shallow.  ``stretch`` numbers the parts
    that no pair may cross.
    """

    def __init__(self, ids, stretch):
        import numpy as np

        symbols, place = ids.astype(np.int64), np.arange(len(ids))
        self.words = top = int(symbols.max()) + 1 if len(ids) else 0
        left, right, first = [], [], []
        fresh = np.ones(len(ids), bool)  # the pair from here on may still occur twice
        while len(symbols) > 1:
            pairs = np.flatnonzero(fresh[:-1] & (stretch[1:] == stretch[:-1]))
            same = symbols[1:] == symbols[:-1]
            same &= stretch[1:] == stretch[:-1]
            before = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
            pairs = pairs[~same[pairs] | ((pairs - before[pairs]) % 2 == 1)]  # of overlapping pairs every other
            codes, which, counts = np.unique(symbols[pairs] * top + symbols[pairs + 1], return_inverse=True, return_counts=True)
            often = counts > 1
            fresh[pairs[~often[which]]] = False
            if not often.any():
                break
            rank = np.empty(len(codes), np.int64)
            rank[np.lexsort((codes.astype(np.uint64) * np.uint64(MIX), counts))] = np.arange(1, len(codes) + 1)
            weight = np.zeros(len(symbols) + 1, np.int64)
            weight[pairs] = np.where(often, rank, 0)[which]
            wins = (weight[pairs] > weight[pairs - 1]) & (weight[pairs] > weight[pairs + 1])
            won = np.bincount(which[wins], minlength=len(codes)) > 1
            wins &= won[which]
            at, made = pairs[wins], np.cumsum(won)[which[wins]] - 1
            chosen = np.flatnonzero(won)
            earliest = np.full(len(chosen), len(ids))
            np.minimum.at(earliest, made, place[at])
            left.append(codes[chosen] // top)
            right.append(codes[chosen] % top)
            first.append(earliest)
            symbols[at] = top + made
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, place, stretch, fresh = symbols[stays], place[stays], stretch[stays], fresh[stays]
            top += len(chosen)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.left, self.right, self.first = join(left), join(right), join(first)
        self.symbols, self.place, self.stretch = symbols, place, stretch
        self.size = np.ones(top, np.int64)
        for x, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist()), self.words):
            self.size[x] = self.size[a] + self.size[b]

    def joints(self, least: int) -> Iterator[tuple[int, int, int]]:
        """``(begin, boundary, end)`` of the start rule, cut in halves down to its symbols; each holds ``least`` words."""
        import numpy as np

        stops = self.place + self.size[self.symbols]
        edges = np.flatnonzero(np.diff(self.stretch, prepend=-1, append=-1)) if len(self.symbols) else []
        open_ = list(zip(edges[:-1], edges[1:]))
        while open_:
            a, b = open_.pop()
            begin, end = int(self.place[a]), int(stops[b - 1])
            if b - a > 1 and end - begin >= least:
                middle = (a + b) // 2
                yield begin, int(self.place[middle]), end
                open_ += [(a, middle), (middle, b)]


class Words:
    """The word numbers, forwards and backwards, with the runs across one boundary."""

    def __init__(self, ids):
        self.ids, self.back = ids, ids[::-1].copy()

    @staticmethod
    def _equal(t, i: int, j: int, most: int) -> int:
        """How many words from ``i`` and ``j`` on are equal."""
        done, step = 0, 32
        while done < most:
            k = min(step, most - done)
            differ = t[i + done : i + done + k] != t[j + done : j + done + k]
            at = int(differ.argmax())
            if differ[at]:
                return done + at
            done, step = done + k, step * 4
        return most

    def across(self, begin: int, middle: int, end: int, least: int) -> list[tuple[int, int, int]]:
        """``(start, stop, period)`` of the runs inside ``begin`` to ``end`` with words on both sides of ``middle``.

        Such a run holds a whole period after the boundary or before it.  So the
        last word before it comes again one period later, or the first after it
        came one period earlier; from that pair the equal words are counted both
        ways.  Few periods pass a look at the places half a period away.
        """
        import numpy as np

        t, n, widest = self.ids, len(self.ids), (end - begin) // 2
        later = np.flatnonzero(t[middle : min(end, middle + widest)] == t[middle - 1]) + 1
        earlier = np.flatnonzero(t[max(begin, middle - widest) : middle] == t[middle]) + max(begin, middle - widest)
        if not len(later) + len(earlier):
            return []
        p = np.concatenate([later, middle - earlier])
        i = np.concatenate([np.full(len(later), middle - 1), earlier])
        half = (np.maximum(p, least - p) + 1) // 2
        ahead, behind = i + p + half <= end, i - half >= begin
        for k in (half // 2, half - 1):
            x, y = np.where(ahead, i + k, 0), np.where(behind, i - 1 - k, 0)
            ahead &= t[x] == t[np.where(ahead, x + p, 0)]
            behind &= t[y] == t[np.where(behind, y + p, 0)]
        some = ahead | behind
        p, i = p[some], i[some]
        order = np.argsort(p, kind="stable")
        p, i = p[order], i[order]
        found = []
        while len(p):
            q, a = int(p[0]), int(i[0])
            p, i = p[1:], i[1:]
            stop = a + q + self._equal(t, a, a + q, end - a - q)
            start = a - self._equal(self.back, n - a, n - a - q, a - begin)
            if stop - start >= max(least, 2 * q):
                found.append((start, stop, q))
                again = (p % q == 0) & (i >= start) & (i + p < stop)  # multiples of the period give the same run
                p, i = p[~again], i[~again]
        return list(dict.fromkeys(found))


def runs_of(ids, stretch, least: int):
    """``(start, stop, period)`` arrays of all runs; none crosses a change of ``stretch``."""
    import numpy as np

    grammar, words = Grammar(ids, stretch), Words(ids)
    first, left, right, size = grammar.first, grammar.left, grammar.right, grammar.size
    found = [r for joint in grammar.joints(least) for r in words.across(*joint, least)]
    moved = [np.array(found, np.int64).reshape(-1, 3)]
    own: dict[int, list] = {}
    useful = np.zeros(len(size), bool)
    for x in range(grammar.words, len(size)):
        k = x - grammar.words
        if size[x] >= least:
            begin = int(first[k])
            own[x] = words.across(begin, begin + int(size[left[k]]), begin + int(size[x]), least)
        useful[x] = bool(own.get(x)) or useful[left[k]] or useful[right[k]]
    places: dict[int, list] = {}
    top = np.flatnonzero(useful[grammar.symbols])
    top = top[np.argsort(grammar.symbols[top], kind="stable")]
    kinds, starts = np.unique(grammar.symbols[top], return_index=True)
    for x, where in zip(kinds.tolist(), np.split(grammar.place[top], starts[1:])):
        places[x] = [where]
    for x in range(len(size) - 1, grammar.words - 1, -1):
        if x not in places:
            continue
        k, at = x - grammar.words, np.concatenate(places.pop(x))
        for start, stop, period in own.get(x, ()):
            shift = at - first[k]
            moved.append(np.stack([start + shift, stop + shift, np.full(len(at), period)], axis=1))
        for child, offset in ((int(left[k]), 0), (int(right[k]), int(size[left[k]]))):
            if useful[child]:
                places.setdefault(child, []).append(at + offset)
    start, stop, period = np.concatenate(moved).T
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    if not len(start):
        return start, stop, period
    level = np.cumsum(np.diff(period, prepend=period[0]) > 0) * (len(ids) + 1)  # reach never passes to another period
    reach = np.maximum.accumulate(stop + level) - level
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
    heads = np.flatnonzero(new)
    return start[heads], np.maximum.reduceat(stop, heads), period[heads]


def find(texts: list[str], least: int = LEAST) -> list[tuple[int, list[dict], str]]:
    """Number of words, runs and collapsed text of each text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words, ends = split_words(texts)
    begins = np.concatenate([[0], ends[:-1]])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)
    covered = np.flatnonzero(repeating(ids, ends, (least + 1) // 2))
    text = np.searchsorted(ends, covered, "right")
    gap = np.ones(len(covered), bool)
    gap[1:] = (np.diff(covered) > 1) | (np.diff(text) > 0)
    stretch = np.cumsum(gap) - 1
    long = (np.bincount(stretch, minlength=1) >= least)[stretch]
    covered, text, stretch = covered[long], text[long], stretch[long]
    start, stop, period = runs_of(ids[covered], stretch, least)
    runs: list[list[dict]] = [[] for _ in texts]
    gone = np.zeros(len(ids) + 1, np.int64)
    owner = text[start]
    at = covered[start]
    np.add.at(gone, at + period, 1)
    np.add.at(gone, at + stop - start, -1)
    first = at - begins[owner] if len(at) else at
    for d, s, n, p in sorted(zip(owner.tolist(), first.tolist(), (stop - start).tolist(), period.tolist()), key=lambda r: (r[0], r[1], r[3])):
        runs[d].append({"start": s, "length": n, "period": p})
    stays = np.cumsum(gone[:-1]) == 0
    seen = np.concatenate([[0], np.cumsum(stays, dtype=np.int64)])
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], seen[ends]])), words.filter(pa.array(stays)))
    collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()
    return list(zip((ends - begins).tolist(), runs, collapsed))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every whole text, other columns unread.

    Words are separated by ASCII white space.  ``runs`` holds ``start`` (word
    number from 0), ``length`` and ``period`` of every run of ``least`` words or
    more, by start, then period.  ``collapsed`` joins by single spaces the words
    that no run contains after its first period.  Null, empty and blank texts
    have no words, no runs and the empty text; repeated rows come back as often
    as given, null ids stay null.

    Rows are independent and nothing is shuffled.  A run of ``least`` words holds
    a sequence of half as many that comes twice in its text, at every place; words
    in no such sequence take no part in the grammar.  Memory follows the longest
    text or ``SLICE`` bytes.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for keys, texts in slices(batch, SLICE, "doc_id", "text"):
                counts, runs, collapsed = zip(*find(texts, least))
                arrays = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
