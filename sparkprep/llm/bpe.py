"""Byte-level BPE: merges chosen by a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from sparkprep.llm.common import col, slices
from pyspark.sql import functions as F

SLICE = 2 << 20
KNOWN = 400_000  # pieces a Python worker remembers
LONG = 64  # bytes from which a piece is not remembered
NONE = 1 << 62

_loaded: dict[str, "Merges"] = {}


class Merges:
    """The ranks of one vocabulary, and batches of pieces encoded with them."""

    def __init__(self, path: str):
        import numpy as np

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = len(self.tokens)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # every pair of tokens that joins to a token, with the rank of the result
        pairs = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "Merges":
        if path not in _loaded:
            _loaded[path] = Merges(path)
        return _loaded[path]

    def keys(self, left, right, at):
        """What a leaf of the tree holds: the rank of the pair, then its position, so that the least is leftmost."""
        import numpy as np

        pair = left * self.size + right
        i = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[i] == pair, (self.joined[i] << 40) | at, NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Token ids (little-endian, 32 bits) of pieces of at most ``width`` bytes, a power of two.

        One segment tree per piece, one row each.  A leaf holds the pair that
        starts at its byte; an inner node holds the least of its leaves, that
        is the leftmost pair of minimum rank.  Each merge changes the leaf of
        the merged token, that of its live left neighbour and that of the token
        that vanished, and walks their paths to the root.
        """
        import numpy as np

        n, w = len(pieces), width
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        where = np.arange(w)
        live = where < lengths[:, None]
        token = np.zeros((n, w), np.int64)
        token[live] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        right = np.broadcast_to(where + 1, (n, w)).copy()  # next live position; the piece's length and beyond: none
        left = right - 2
        tree = np.full((n, 2 * w), NONE, np.int64)
        row, at = np.nonzero(live[:, 1:])
        tree[row, w + at] = self.keys(token[row, at], token[row, at + 1], at)
        level = w
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        rows = np.arange(n)
        while True:
            best = tree[rows, 1]
            go = best < NONE
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            at, made = best & ((1 << 40) - 1), best >> 40
            gone = right[rows, at]
            then = right[rows, gone]
            before = left[rows, at]
            token[rows, at], right[rows, at] = made, then
            live[rows, gone] = False
            inside = then < lengths[rows]
            left[rows[inside], then[inside]] = at[inside]
            new = np.full(len(rows), NONE, np.int64)
            new[inside] = self.keys(made[inside], token[rows[inside], then[inside]], at[inside])
            old = before >= 0
            changed = [(rows, w + gone, np.full(len(rows), NONE, np.int64)), (rows, w + at, new)]
            changed.append((rows[old], w + before[old], self.keys(token[rows[old], before[old]], made[old], before[old])))
            for r, node, value in changed:
                tree[r, node] = value
            for r, node, _ in changed:
                while w > 1 and len(node) and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        ids = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: its own rank if the vocabulary has it whole, else by merges."""
        out: list = [None] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                sizes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, group in sizes.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                for i, ids in zip(part, self.merge([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str], pattern) -> list[bytes]:
        """Ids of each text, little-endian 32-bit; each match of ``pattern`` is encoded separately."""
        if len(self.known) > KNOWN:
            self.known.clear()
        cut = [pattern.findall(t) for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        found = dict(zip(new, self.encode_pieces([p.encode() for p in new])))
        local = self.known
        long = {p: v for p, v in found.items() if len(p) > LONG}
        local.update((p, v) for p, v in found.items() if len(p) <= LONG)
        if long:
            return [b"".join([long[p] if p in long else local[p] for p in pieces]) for pieces in cut]
        return [b"".join(map(local.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids binary)``: every whole text as token ids, little-endian unsigned 32-bit.

    ``ranks`` is the path of a rank file every executor can read, ``pattern``
    cuts a text into pieces that are encoded separately; special tokens are
    ordinary text.  A null or empty text has no ids.  Repeated rows come back as
    often as given; other columns are not read.  Rows are independent: nothing
    is shuffled, and a very long text is one row of work, with a piece of n
    bytes taking n log n steps.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        merges, cut = Merges.of(ranks), regex.compile(pattern)
        for batch in batches:
            for keys, texts in slices(batch, SLICE, "doc_id", "text"):
                ids = merges.encode(texts, cut)
                arrays = [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text binary)``: the bytes of the ids; null or empty ids give no bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        merges = Merges.of(ranks)
        for batch in batches:
            for keys, ids in slices(batch, SLICE, "doc_id", "ids"):
                arrays = [pa.array(keys, pa.int64()), pa.array([merges.decode(x or b"") for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text"])

    rows = encoded.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of the bytes they decode to.

    The same as ``encode`` then ``decode`` joined by row, in one pass and so also right for repeated ids.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        merges, cut = Merges.of(ranks), regex.compile(pattern)
        sha = hashlib.sha256
        for batch in batches:
            for keys, texts in slices(batch, SLICE, "doc_id", "text"):
                ids = merges.encode(texts, cut)
                arrays = [
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha(x).hexdigest() for x in ids]),
                    pa.array([sha(merges.decode(x)).hexdigest() for x in ids]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
