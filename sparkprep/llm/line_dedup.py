"""Near-duplicate lines by a segment-partition edit join, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col, kept, union_all

#: Lines of fewer code points match exactly or not at all: one edit is too much of them.
MIN_CHARS = 10
MOST_EDITS = 3
#: Members of a key from which the key is refined before pairs are formed.
GROUP = 32
PIECES = 16
FIRST = -(1 << 63)
#: Where a line stands: id, hash of the whole text, line number.
PLACE = ["doc_id", "body", "pos"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def hashes(line: Column) -> list[Column]:
    """A 128-bit hash of the line."""
    return [F.xxhash64(F.lit(k), line).alias(f"h{k}") for k in (1, 2)]


def left(s: Column, n: Column) -> Column:
    return F.substring(s, F.lit(1), n)


def right(s: Column, n: Column) -> Column:
    """The last ``n`` characters."""
    return F.substring(s, F.length(s) - n + F.lit(1), n)


def probes(max_edits: int) -> list[tuple[int, int, int]]:
    """``(shorter, seg, shift)`` of a line's keys: its own segments first, then its substrings that may be a segment of an equally long or shorter line.

    Of the ``max_edits + 1`` segments of a line, some segment ``seg`` stands in any
    line within ``max_edits`` edits, with at most ``seg`` edits before it and at most
    ``max_edits - seg`` behind it.  That bounds how far it is shifted.
    """
    found = [(shorter, seg, shift) for shorter in range(max_edits + 1) for seg in range(max_edits + 1) for shift in range(-seg, seg + 1) if abs(shorter - shift) <= max_edits - seg]
    return sorted(found, key=lambda x: (x[0] > 0 or x[2] != 0, x))


def cut(n: Column, seg: Column | int, parts: Column | int) -> Column:
    """Where segment ``seg`` of ``parts`` starts in ``n`` characters."""
    return F.floor(n * seg / parts).cast("int")


def segment_keys(line: Column, length: Column, max_edits: int) -> Column:
    """Array of ``(key, own, seg, shorter, shift)``: the line's segments as index entries, and its substrings that probe for lines up to ``max_edits`` shorter.

    A line of ``n`` characters is cut into ``max_edits + 1`` segments as even as
    possible; ``probes`` says which substrings must be looked up.  With one edit
    they are the prefix and the suffix.  Probes for the line's own length and
    place equal its index entries.
    """
    entries = []
    for shorter, seg, shift in probes(max_edits):
        n = length - shorter
        start, stop = cut(n, seg, max_edits + 1), cut(n, seg + 1, max_edits + 1)
        part = F.substring(line, start + F.lit(shift + 1), stop - start)
        own = shorter == 0 and shift == 0
        entries.append(F.struct(F.xxhash64(n, F.lit(seg), part).alias("key"), F.lit(own).alias("own"), *[F.lit(v).alias(c) for c, v in (("seg", seg), ("shorter", shorter), ("shift", shift))]))
    return F.array(*entries)


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def within(a: str, b: str, k: int) -> Column:
    """True if the arrays of characters in columns ``a`` and ``b``, ``a`` not the shorter, are at most ``k`` edits apart.

    Banded bit-parallel edit distance: ``2k + 2`` bits hold the rows around the
    diagonal, the top bit being row ``column + k``.  ``vp`` and ``vn`` mark vertical
    steps of +1 and -1.  The score follows the top diagonal while it lies inside
    the table (``j <= m - k``), then the last row, whose bit moves down a place
    per column.  It loses at most one per column left there, so beyond
    ``2k - (m - n)`` the pair is too far apart and the rest is passed over.
    """
    width = 2 * k + 2
    every = (1 << width) - 1
    m, n = f"size({a})", f"size({b})"
    row = lambda i: f"(j + {k + i - width})"  # noqa: E731  counted from 0, at bit i of column j
    match = " + ".join(f"if({row(i)} >= 0 and {row(i)} < {m} and get({a}, {row(i)}) = get({b}, j - 1), {1 << i}, 0)" for i in range(width))
    place = f"({width - 1} - (j - ({m} - {k})))"
    score = (
        f"s.score + if(j <= {m} - {k}, 1 - (shiftright(d0, {width - 1}) & 1), "
        f"(shiftright(hp, greatest(0, {place})) & 1) - (shiftright(d0 & s.vp, greatest(0, {place})) & 1))"
    )
    after = f"named_struct('vp', ((d0 & s.vp) | ~(shiftright(d0, 1) | hp)) & {every}, 'vn', shiftright(d0, 1) & hp, 'score', {score})"
    step = f"if(s.score > {2 * k} - ({m} - {n}), s, " + _let("x", match, _let("d0", f"((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {every}", _let("hp", f"(s.vn | ~(d0 | s.vp)) & {every}", after))) + ")"
    start = f"named_struct('vp', {every & ~((1 << (width - k - 1)) - 1)}, 'vn', 0, 'score', {k})"
    run = f"aggregate(if({n} > 0, sequence(1, {n}), cast(array() as array<int>)), {start}, (s, j) -> {step}, s -> s.score)"
    return F.expr(f"case when {m} - {n} > {k} then false when {m} <= {k} then true else {run} <= {k} end")


def sharing(distinct: DataFrame, names: list[str], max_edits: int) -> DataFrame:
    """``(h1, h2, at)`` of the distinct lines that share a key with another, one of the two as index entry.

    There are several keys a line, so only half its hash goes with them: a line
    of the same half comes along and shares no key later on.
    """
    entries = F.array(*[F.struct(F.col(k).alias("key"), F.lit(i <= max_edits).alias("own")) for i, k in enumerate(names)])
    keyed = distinct.where("k0 is not null").select("h1", F.explode(entries).alias("k")).select("h1", "k.*")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("entries")).where("n > 1 and entries > 0")
    shared = keyed.join(sizes.select("key"), "key").select("h1").distinct()
    return distinct.where("k0 is not null").select("h1", "h2", "at").join(shared, "h1", "left_semi")


def lines_at(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """``candidates (h1, h2, at)`` with the line that stands there, once for every row of its document.

    Documents move whole and only to the places wanted of them; few lines are.
    """
    of = [F.col(f"at.{c}").alias(c) for c in PLACE[:2]]
    wanted = candidates.groupBy(*of).agg(F.collect_list(F.struct("h1", "h2", "at")).alias("wanted"))
    texts = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"), "body", lines_of(F.col("text")).alias("lines"))
    found = F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["at"].alias("at"), F.get("lines", w["at"]["pos"]).alias("line")))
    rows = texts.join(wanted, PLACE[:2]).select(F.explode(found).alias("x")).select("x.*")
    # the hashes of two texts may be equal
    h1, h2 = hashes(F.col("line"))
    return rows.where((F.col("h1") == h1) & (F.col("h2") == h2))


def near_lines(candidates: DataFrame, docs: DataFrame, max_edits: int) -> DataFrame:
    """``(h1, h2)`` of the distinct lines within ``max_edits`` of an earlier one.

    ``candidates`` are those that share a key, with their first place.  Lines meet by segment key.  A key
    with many members is refined instead of paired: what the segment leaves is
    cut into 16 pieces, and lines meet again if all but one piece agree; where
    that is still many, all but one character must agree.  The latter lines are
    one edit apart by construction, so they only need their earliest member as
    witness.  With more edits, both sides of the segment are partitioned by the
    edits left to them and must share a segment each; what then still has many
    members is paired.  Every pair is verified.
    """
    rows = kept(lines_at(candidates, docs).dropDuplicates(["h1", "h2"]))
    n = F.length("line")
    keyed = rows.select("*", F.explode(segment_keys(F.col("line"), n, max_edits)).alias("k")).select("h1", "h2", "at", "line", "k.*")
    few, many = crowded(kept(keyed))
    if max_edits > 1:
        refined = many.select("h1", "h2", "at", "line", F.explode(side_keys("line", max_edits)).alias("k")).select("h1", "h2", "at", "line", "k.*")
        few2, many2 = crowded(kept(refined.distinct()))
        pairs = union_all([pair(few), pair(few2), pair(many2)]).dropDuplicates(["h1", "h2", "o1", "o2"])
        return verified(pairs, max_edits).select("h1", "h2").distinct()
    # what the segment leaves: the suffix behind the first, the prefix before the last
    size = F.when(F.col("own"), n).otherwise(n - 1)
    rest = F.when(F.col("seg") == 0, right(F.col("line"), n - F.floor(size / 2).cast("int"))).otherwise(left(F.col("line"), n - (size - F.floor(size / 2).cast("int"))))
    few2, many2 = crowded(kept(many.withColumn("rest", rest).select("h1", "h2", "at", "line", "own", F.explode(leave_one_out("key", "rest", "own", PIECES)).alias("k")).select("h1", "h2", "at", "line", "own", "k.*")))
    last = many2.select("h1", "h2", "at", "line", "own", F.explode(leave_one_character("key", "piece", "own")).alias("k")).select("h1", "h2", "at", "line", "own", "k.*")
    pairs = union_all([pair(few), pair(few2), witness(last)]).dropDuplicates(["h1", "h2", "o1", "o2"])
    return verified(pairs, max_edits).select("h1", "h2").distinct()


def crowded(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key has an index entry and another member: those of keys with few members, and of keys with many."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.count(F.when(F.col("own"), 1)).alias("entries")).where("members > 1 and entries > 0")
    rows = keyed.join(sizes.select("key", "members"), "key")
    return rows.where(F.col("members") <= GROUP).drop("members"), rows.where(F.col("members") > GROUP).drop("members")


def side_keys(line: str, max_edits: int) -> Column:
    """Array of ``(key, own)``: a segment of what stands before the shared one with a segment of what stands behind it.

    Before segment ``seg`` there are at most ``seg`` edits, behind it at most
    ``max_edits - seg``; either side is partitioned and probed like a line.
    """
    text, size = F.col(line), F.length(line)
    n = size - F.col("shorter")
    start, stop = cut(n, F.col("seg"), max_edits + 1), cut(n, F.col("seg") + 1, max_edits + 1)

    def parts(side: Column, frame: Column, edits: Column) -> Column:
        """The keys of one side, ``frame`` long in the index entry."""
        entries = []
        for seg in range(max_edits + 1):
            first, last = cut(frame, seg, edits + 1), cut(frame, F.lit(seg + 1), edits + 1)
            for shift in range(-seg, seg + 1):
                fits = (F.abs(F.length(side) - frame - shift) <= edits - seg) & (first + shift >= 0) & (last + shift <= F.length(side))
                part = F.substring(side, first + F.lit(shift + 1), last - first)
                entries.append(F.when(fits, F.struct(F.xxhash64(F.lit(seg), part).alias("key"), F.lit(shift == 0).alias("own"))))
        return F.array_compact(F.array(*entries))

    before = parts(left(text, start + F.col("shift")), start, F.col("seg"))
    behind = parts(right(text, size - stop - F.col("shift")), n - stop, F.lit(max_edits) - F.col("seg"))
    both = lambda a, b: F.struct(F.xxhash64(F.col("key"), a["key"], F.lit(0), b["key"]).alias("key"), (F.col("own") & a["own"] & b["own"]).alias("own"))
    return F.flatten(F.transform(before, lambda a: F.transform(behind, lambda b: both(a, b))))


def pair(few: DataFrame) -> DataFrame:
    """Later and earlier line of every pair of an index entry with a member of its key."""
    a = few.where("own").select("key", F.struct("at", "h1", "h2", "line").alias("a"))
    b = few.select("key", F.struct("at", "h1", "h2", "line").alias("b"))
    both = a.join(b, "key").where("(a.h1, a.h2) <> (b.h1, b.h2)")
    return both.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).select("x.h1", "x.h2", "x.line", F.col("y.h1").alias("o1"), F.col("y.h2").alias("o2"), F.col("y.line").alias("other"))


def leave_one_out(key: str, rest: str, own: str, pieces: int) -> Column:
    """Array of ``(key, own, piece)``: all of ``rest`` but one piece, under the key so far.

    The pieces are those of the index entry, one character shorter than a probe
    for it: what stands before the piece counts from the start, what stands
    behind it from the end.  Index entries carry the mark of either use.
    """
    text = F.col(rest)
    n = F.length(text) - F.when(F.col(own), 0).otherwise(1)
    out = []
    for j in range(pieces):
        start, stop = (F.floor(n * i / pieces).cast("int") for i in (j, j + 1))
        around = F.concat(left(text, start), F.lit("\n"), right(text, n - stop))  # no line holds a line break
        piece = F.substring(text, start + F.lit(1), F.length(text) - start - (n - stop))
        entry = F.struct(F.xxhash64(F.col(key), n, F.lit(j), around).alias("key"), piece.alias("piece"))
        out.append(F.when(stop > start, entry) if j else entry)  # empty pieces of short rests
    return F.array_compact(F.array(*out))


def leave_one_character(key: str, piece: str, own: str) -> Column:
    """Array of ``(key, kind)`` of a piece, all around it being equal.

    Kind 0: the piece without its character ``i``, keyed by ``i``: members differ in that character.  Kind 1: an
    index entry's whole piece; kind 2: a probe's piece without one character.  A kind 2 member is the kind 1
    member of its key with a character inserted.
    """
    text, n = F.col(piece), F.length(piece)
    less = lambda i: F.concat(left(text, i), right(text, n - i - F.lit(1)))
    places = F.when(n > 0, F.sequence(F.lit(0), n - F.lit(1))).otherwise(F.array().cast("array<int>"))
    same = F.transform(places, lambda i: F.struct(F.xxhash64(F.col(key), F.lit(0), i, less(i)).alias("key"), F.lit(0).alias("kind")))
    whole = F.array(F.struct(F.xxhash64(F.col(key), F.lit(1), text).alias("key"), F.lit(1).alias("kind")))
    cut = F.array_distinct(F.transform(places, lambda i: F.struct(F.xxhash64(F.col(key), F.lit(1), less(i)).alias("key"), F.lit(2).alias("kind"))))
    return F.when(F.col(own), F.concat(same, whole)).otherwise(cut)


def witness(last: DataFrame) -> DataFrame:
    """Every member of a key after the first, with one earlier line to be verified against.

    Kind 0 members are each one edit from the earliest.  A kind 1 member (one per key) is compared with the
    earliest kind 2, and the kind 2 members with it.
    """
    me = F.struct("at", "h1", "h2", "line")
    first = last.withColumn("to", F.when(F.col("kind") == 0, 0).otherwise(3 - F.col("kind"))).groupBy("key", F.col("to").alias("kind")).agg(F.min(me).alias("y"))
    both = last.join(first, ["key", "kind"]).select(me.alias("x"), "y").where("y < x")
    return both.select("x.h1", "x.h2", "x.line", F.col("y.h1").alias("o1"), F.col("y.h2").alias("o2"), F.col("y.line").alias("other"))


def verified(pairs: DataFrame, max_edits: int) -> DataFrame:
    """Pairs within ``max_edits``, judged by the band from their first difference on."""
    steps = ", ".join(str(1 << i) for i in reversed(range(30)))
    fits = "at + step <= least(length(line), length(other)) and substring(line, 1, at + step) = substring(other, 1, at + step)"
    prefix = f"aggregate(array({steps}), 0, (at, step) -> if({fits}, at + step, at))"  # length of the common prefix, by binary steps
    chars = lambda t: f"filter(split(substring({t}, p + 1), ''), c -> c <> '')"
    both = _let("p", prefix, f"if(length(line) >= length(other), array({chars('line')}, {chars('other')}), array({chars('other')}, {chars('line')}))")
    # an array column that is exploded to its single element: evaluated once, whatever reads it
    rest = pairs.select("h1", "h2", F.explode(F.array(F.expr(both))).alias("x")).select("h1", "h2", F.expr("x[0]").alias("a"), F.expr("x[1]").alias("b"))
    return rest.where(within("a", "b", max_edits))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text, row)``, one row per row of ``docs``: texts without repeated lines.

    ``row`` holds the other columns.

    A line goes if an equal line, or one within ``max_edits`` (0 to 3) edits,
    stands earlier anywhere: by doc_id (null first), then by place in the text.
    More than one edit takes ``min_chars`` of 10 per edit at least.
    Lines of fewer than ``min_chars`` code points must be equal; lines of white
    space alone always stay.  Null texts come back empty with one empty line.
    Rows of one doc_id, or without any, are documents of their own, ordered by a
    hash of their texts; only equal rows count as one, so that repeated rows
    keep or lose the same lines.  An empty table gives an empty one.

    Only hashes and key digests of lines are shuffled; texts move whole, once to
    the places of lines that share a key with another and once for the result.
    """
    if max_edits not in range(MOST_EDITS + 1):
        raise ValueError(f"max_edits is 0 to {MOST_EDITS}")
    if max_edits > 1 and min_chars < MIN_CHARS * max_edits:
        raise ValueError(f"{max_edits} edits take min_chars of {MIN_CHARS * max_edits} or more")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body"), F.struct(*[col(c) for c in docs.columns if c != text_col]).alias("row"))
    line = F.col("line")
    lines = rows.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"), "body", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.length(line)
    names = [f"k{i}" for i in range(len(probes(max_edits)))] if max_edits else []
    keys = F.when(n >= min_chars, segment_keys(line, n, max_edits))
    lines = kept(lines.select(*PLACE, *hashes(line), *[F.get(keys, i)["key"].alias(k) for i, k in enumerate(names)]))
    distinct = lines.groupBy("h1", "h2", *names).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("at"))
    distinct = kept(distinct)
    near = None
    if max_edits:
        candidates = sharing(distinct, names, max_edits)
        near = near_lines(candidates, rows, max_edits).withColumn("near", F.lit(True))
    marked = distinct.select("h1", "h2", "n", "at")
    marked = marked.join(near, ["h1", "h2"], "left") if near is not None else marked.withColumn("near", F.lit(None).cast("boolean"))
    again = marked.where("n > 1 or near").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    again = kept(again)  # read again it is dealt out anew, so that the join can split a line with very many places
    gone = lines.select(*PLACE, "h1", "h2").join(again, ["h1", "h2"]).where(F.col("near") | (F.struct(*PLACE) > F.col("at")))
    gone = gone.groupBy(F.col("doc_id").alias("of"), F.col("body").alias("own")).agg(F.collect_set(F.struct("pos", "h1", "h2")).alias("gone"))
    joined = rows.join(gone, (F.coalesce("doc_id", F.lit(FIRST)) == F.col("of")) & (F.col("body") == F.col("own")), "left").select("doc_id", lines_of(F.col("text")).alias("lines"), "gone", "row")
    # positions whose own line is the one removed, should the hashes of two texts be equal
    places = F.array_sort(F.filter("gone", lambda g: (F.xxhash64(F.lit(1), F.get("lines", g["pos"])) == g["h1"]) & (F.xxhash64(F.lit(2), F.get("lines", g["pos"])) == g["h2"])))
    joined = joined.select("doc_id", "lines", "row", F.coalesce(F.transform(places, lambda g: g["pos"]), F.array().cast("array<int>")).alias("places"))
    mark = F.map_from_arrays("places", F.transform("places", lambda p: F.lit(True)))
    stay = F.when(F.size("places") == 0, F.col("lines")).otherwise(F.filter("lines", lambda line, i: F.isnull(F.try_element_at(F.col("mark"), i))))
    joined = joined.withColumn("mark", mark)
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_removed"), F.array_join(stay, "\n").alias("text"), "row")
