"""Exact interpolated quantiles without sorting or collecting the column.

The built-in exact ``percentile`` keeps one map entry per distinct value and
merges all of them in one task.  Here a sketch of a sample only proposes a narrow
bracket around each wanted rank; counts over all rows prove where the rank lies,
and only the few values inside the bracket are looked at.  A bracket that still
holds too many rows is sketched again, so the answer is exact for any data and
any sample.  Every pass is a column-pruned scan with a tiny shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkprep.functions.lookup import Kept, lookup_join
from sparkprep.functions.ranks import passed, running_start

ACCURACY = 10_000  # sketch rank error is rows / ACCURACY
FETCH_ROWS = 200_000  # values read to the driver in one pass, at most
DIRECT_ROWS = 2_000  # columns this short are read out without a sketch
SAMPLE_ROWS = 100_000  # sketch at least this many rows, ...
SAMPLE_SHARE = 0.05  # ... or this share of a larger table
MANY = 64  # ranks of one column; more are found by running totals
NESTED = 64  # points compared in nested expressions; more are searched in an array
SMALL_GROUP = 2 * ACCURACY  # groups up to this size skip the sketch bracket
BRACKET_ROWS = 1_000_000  # narrow group brackets that may hold more rows
GRID = 1_000  # steps of one narrowing


def interpolate(low: float, high: float, fraction: float) -> float:
    if low == high or fraction == 0:
        return low
    step = high - low
    return high - step * (1 - fraction) if fraction >= 0.5 else low + step * fraction


def rank_position(p: float, rows: int) -> tuple[int, int, float]:
    """The two 0-based ranks around share ``p``, and how far between them it is."""
    place = (p * 100.0) / 100.0 * (rows - 1)
    low = math.floor(place)
    return low, math.ceil(place), place - low


@dataclass
class _Search:
    """Neighbouring order statistics of one column and where they must lie."""

    column: str
    ranks: tuple[int, ...]  # 0-based
    low: float | None  # exclusive bounds; None is open
    high: float | None
    before: int  # rows at or below ``low``
    inside: int  # rows strictly between the bounds
    probe: tuple[float | None, float | None] = (None, None)
    read: bool = False  # read the values between the probes in the next pass


class Quantiles:
    """Exact quantiles of many columns of one frame, all passes shared."""

    def __init__(
        self,
        columns: dict[str, Column],
        probabilities: dict[str, list[float]],
        accuracy: int = ACCURACY,
        fetch_rows: int = FETCH_ROWS,
    ):
        self.columns = columns
        self.probabilities = {c: sorted(set(p)) for c, p in probabilities.items() if p}
        self.accuracy = accuracy
        self.fetch_rows = fetch_rows
        self.order = list(self.probabilities)

    def counts(self) -> list[Column]:
        """Aggregates ``resolve`` needs; run them in any ``agg`` on the frame."""
        return [F.count(self.columns[name]).alias(f"__qn{i}") for i, name in enumerate(self.order)]

    def run(self, df: DataFrame) -> dict[str, dict[float, float | None]]:
        return self.resolve(df, df.agg(*self.counts()).first()) if self.order else {}

    def column(self, name: str) -> Column:
        return F.col(f"q{self.order.index(name)}")

    def resolve(self, df: DataFrame, row: Row) -> dict[str, dict[float, float | None]]:
        """Finish from a row that holds the ``counts()`` results."""
        rows = {name: row[f"__qn{i}"] for i, name in enumerate(self.order)}
        # One narrow projection, so each value is prepared once per pass.
        narrow = df.select(*[self.columns[c].alias(f"q{i}") for i, c in enumerate(self.order)])
        searches: list[_Search] = []
        values: dict[tuple[str, int], float] = {}
        for name, n in rows.items():
            wanted = sorted({r for p in self.probabilities[name] for r in rank_position(p, n)[:2]}) if n else []
            if len(wanted) > MANY and n > DIRECT_ROWS:
                values |= {(name, r): v for r, v in self._ranked(narrow, name, wanted).items()}
            else:
                searches += [_Search(name, ranks, None, None, 0, n) for ranks in _neighbours(wanted)]
        while searches:
            self._aim(narrow, searches)
            searches = self._scan(narrow, searches, values)
        found: dict[str, dict[float, float | None]] = {}
        for name, n in rows.items():
            found[name] = dict.fromkeys(self.probabilities[name])
            for p in self.probabilities[name] if n else ():
                first, last, fraction = rank_position(p, n)
                found[name][p] = interpolate(values[name, first], values[name, last], fraction)
        return found

    def _ranked(self, df: DataFrame, name: str, ranks: list[int]) -> dict[int, float]:
        """The values at many ranks at once: values are counted, their running
        totals formed range by range, and only those holding a wanted rank read."""
        kept = Kept()
        values = df.select(self.column(name).alias("x")).where("x is not null")
        counts = kept.keep(values.groupBy("x").agg(F.count(F.lit(1)).alias("c")))
        placed = running_start(counts, "x", F.col("c"))
        holds = passed(ranks, F.col("start") + F.col("c") - 1) > passed(ranks, F.col("start") - 1)
        found = placed.where(holds).select("x", "start", "c").collect()  # as many as ranks, at most
        kept.release()
        out = {}
        for r in found:
            first, stop = bisect_left(ranks, r["start"]), bisect_left(ranks, r["start"] + r["c"])
            out |= dict.fromkeys(ranks[first:stop], r["x"])
        return out

    def _aim(self, df: DataFrame, searches: list[_Search]) -> None:
        """Choose what the next pass counts around, and whether it reads values.

        Short stretches are read whole.  Elsewhere a sketch proposes a bracket;
        sketching a twentieth of a large table costs little precision.
        """
        unsure = []
        budget = self.fetch_rows / len(searches)  # values one search may read
        for s in searches:
            bounded = s.low is not None or s.high is not None
            s.read = s.inside <= (budget if bounded else min(DIRECT_ROWS, budget))
            s.probe = (s.low, s.high)
            if not s.read:
                unsure.append(s)
        if not unsure:
            return
        share = min(1.0, max(max(SAMPLE_ROWS / s.inside for s in unsure), SAMPLE_SHARE))
        source = df.sample(share, seed=11) if share < 1 else df
        stretches: dict[tuple, list[_Search]] = {}
        for s in unsure:
            stretches.setdefault((s.column, s.low, s.high), []).append(s)
        slacks, aggs, ends_of = [], [], []
        for i, ((name, low, high), group) in enumerate(stretches.items()):
            x = F.when(_between(self.column(name), low, high), self.column(name))
            ends = []
            for s in group:
                first, last = ((r - s.before) / max(1, s.inside - 1) for r in (s.ranks[0], s.ranks[-1]))
                slack = 2.0 / self.accuracy
                if share < 1:
                    sampled = s.inside * share
                    slack += 4 * math.sqrt(max(first * (1 - first), last * (1 - last)) / sampled) + 8 / sampled
                ends += [max(0.0, first - slack), min(1.0, last + slack)]
                slacks.append(slack)
            ends_of.append(ends)
            aggs.append(F.percentile_approx(x, ends, self.accuracy).alias(f"b{i}"))
        row = source.agg(*aggs).first()
        slack_of = iter(slacks)
        for i, ((name, low, high), group) in enumerate(stretches.items()):
            bracket = row[f"b{i}"]
            if bracket is None:  # the sample met no value here: any one will do
                x = self.column(name)
                bracket = [df.where(_between(x, low, high)).agg(F.max(x)).first()[0]] * (2 * len(group))
            for j, s in enumerate(group):
                # An end of the stretch itself is not in the sample: leave it open.
                tails = ends_of[i][2 * j] == 0.0, ends_of[i][2 * j + 1] == 1.0
                tails = (False, False) if all(tails) else tails
                s.probe = (low if tails[0] else bracket[2 * j], high if tails[1] else bracket[2 * j + 1])
                s.read = 2 * next(slack_of) * s.inside <= budget / 2

    def _scan(self, df: DataFrame, searches: list[_Search], values: dict[tuple[str, int], float]) -> list[_Search]:
        """One pass: rows at and between the probed points, and the values inside
        brackets to read.  Settles ranks into ``values``; returns what is open."""
        points = {
            name: sorted({v for s in searches if s.column == name for v in (*s.probe, s.low, s.high) if v is not None})
            for name in dict.fromkeys(s.column for s in searches)
        }
        read: dict[str, set[int]] = {name: set() for name in points}
        for s in searches:
            if s.read:
                at = points[s.column]
                start = 0 if s.probe[0] is None else bisect_left(at, s.probe[0]) + 1
                stop = len(at) if s.probe[1] is None else bisect_left(at, s.probe[1])
                read[s.column] |= {2 * j for j in range(start, stop + 1)}
        names = list(points)
        placed, cells = {}, []
        for i, name in enumerate(names):
            x = self.column(name)
            placed[f"p{i}"] = F.when(x.isNotNull(), _segment(x, points[name]))
            kept = F.when(F.col(f"p{i}").isin(sorted(read[name])), x) if read[name] else F.lit(None).cast("double")
            cells.append(F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("part"), kept.cast("double").alias("v")))
        found = (
            df.withColumns(placed)
            .select(F.inline(F.array(*cells)))
            .where("part is not null")
            .groupBy("i", "part", "v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        most = sum(2 * len(p) + 1 for p in points.values()) + self.fetch_rows
        rows = found.limit(most + 1).collect()
        if len(rows) > most:  # a bracket held more than the sketch promised
            for s in searches:
                s.read = False
            return self._scan(df, searches, values)
        parts: dict[str, dict[int, list[tuple[float, int]]]] = {name: {} for name in names}
        for r in rows:
            parts[names[r["i"]]].setdefault(r["part"], []).append((r["v"], r["n"]))
        still_open = []
        for s in searches:
            still_open += self._settle(s, points[s.column], read[s.column], parts[s.column], values)
        return still_open

    def _settle(self, s, at, read, parts, values) -> list[_Search]:
        """Place the ranks of one search among the counted parts of its column."""
        sizes = [sum(n for _, n in parts.get(j, ())) for j in range(2 * len(at) + 1)]
        ends = list(accumulate(sizes))
        open_ranks: dict[int, list[int]] = {}
        for rank in s.ranks:
            part = next(j for j, end in enumerate(ends) if rank < end)
            if part % 2:
                values[s.column, rank] = at[part // 2]
            elif part in read:
                seen = ends[part] - sizes[part]
                for v, n in sorted(parts[part]):
                    seen += n
                    if rank < seen:
                        values[s.column, rank] = v
                        break
            else:
                open_ranks.setdefault(part, []).append(rank)
        out = []
        for part, ranks in open_ranks.items():
            j = part // 2
            low, high = at[j - 1] if j else None, at[j] if j < len(at) else None
            out.append(_Search(s.column, tuple(ranks), low, high, ends[part] - sizes[part], sizes[part]))
        return out


def _neighbours(ranks: list[int]) -> list[tuple[int, ...]]:
    """Sorted ranks grouped into runs of consecutive ones."""
    runs: list[list[int]] = []
    for r in ranks:
        if runs and r == runs[-1][-1] + 1:
            runs[-1].append(r)
        else:
            runs.append([r])
    return [tuple(run) for run in runs]


def _between(x: Column, low: float | None, high: float | None) -> Column:
    keep = x.isNotNull()
    if low is not None:
        keep = keep & (x > F.lit(low))
    if high is not None:
        keep = keep & (x < F.lit(high))
    return keep


def _segment(x: Column, at: list[float], first: int = 0) -> Column:
    """Which part of the line ``x`` lies in: odd at a point, even between two.

    Few points become nested comparisons; many would outgrow the code that can
    be compiled, so they are searched in a literal array.
    """
    if not at:
        return F.lit(2 * first)
    if len(at) > NESTED:
        points = F.lit(at)
        part = lambda i: F.when((i > 0) & (F.get(points, i - 1) == x), 2 * i - 1).otherwise(2 * i)
        return F.get(F.transform(F.array(passed(at, x)), part), F.lit(0))
    middle = len(at) // 2
    point = F.lit(at[middle])
    return (
        F.when(x < point, _segment(x, at[:middle], first))
        .when(x == point, F.lit(2 * (first + middle) + 1))
        .otherwise(_segment(x, at[middle + 1 :], first + middle + 1))
    )


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: dict[str, list[float]], **options):
    return Quantiles(columns, probabilities, **options).run(df)


def group_quantile(
    df: DataFrame,
    group: Column,
    value: Column,
    p: float,
    kept: Kept,
    accuracy: int = ACCURACY,
    small_group: int = SMALL_GROUP,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Exact quantile of ``value`` per non-null ``group``: columns ``g, n, q``.

    The same bracket idea per group.  A group holding a third of the table costs
    a bounded sketch plus a bracket of about ``4 / accuracy`` of its distinct
    values; no task ever holds a whole group.
    """
    base = df.select(group.alias("g"), value.alias("v")).where("g is not null and v is not null")
    slack = 2.0 / accuracy
    bounds = F.percentile_approx("v", [max(0.0, p - slack), min(1.0, p + slack)], accuracy)
    sketch = base.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"), bounds.alias("b")
    )
    tiny = F.col("n") <= small_group
    brackets = kept.keep(
        sketch.select(
            "g",
            "n",
            "mn",
            "mx",
            F.when(tiny, F.col("mn")).otherwise(F.col("b")[0]).alias("lo"),
            F.when(tiny, F.col("mx")).otherwise(F.col("b")[1]).alias("hi"),
        )
    )
    largest = brackets.agg(F.max("n")).first()[0] or 0
    expected = largest * min(1.0, 3 * slack) if largest > small_group else 0
    while expected > bracket_rows:
        brackets = kept.keep(_narrowed(base, brackets, p, accuracy, kept))
        expected *= min(0.5, 4 / GRID + 2 * slack)
    picked = kept.keep(_pick(base, brackets, p, kept))
    missed = picked.where("q is null")
    if missed.isEmpty():
        return picked
    # The sketch bracket missed the rank: those groups start again from their whole range, narrowed like any other.
    wide = kept.keep(
        brackets.join(missed.select("g"), "g", "left_semi").select(
            "g", "n", "mn", "mx", F.col("mn").alias("lo"), F.col("mx").alias("hi")
        )
    )
    again, expected = wide, wide.agg(F.max("n")).first()[0]
    while expected > bracket_rows:
        again = kept.keep(_narrowed(base, again, p, accuracy, kept))
        expected *= min(0.5, 4 / GRID + 2 * slack)
    found = picked.where("q is not null")
    if again is wide:
        return found.unionByName(_pick(base, wide, p, kept))
    more = kept.keep(_pick(base, again, p, kept))
    lost = wide.join(more.where("q is null").select("g"), "g", "left_semi")  # missed twice: read whole
    return found.unionByName(more.where("q is not null")).unionByName(_pick(base, lost, p, kept))


def _narrowed(base: DataFrame, brackets: DataFrame, p: float, accuracy: int, kept: Kept) -> DataFrame:
    """Smaller brackets: count below each, sketch a grid inside, and keep the few
    grid steps around the wanted rank."""
    rows = lookup_join(base, brackets, {"g": F.col("g")}, count="n", kept=kept, how="inner")
    inside = F.when((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), F.col("v"))
    counted = rows.groupBy("g").agg(
        *[F.max(c).alias(c) for c in ("n", "mn", "mx", "lo", "hi")],
        F.sum((F.col("v") < F.col("lo")).cast("long")).alias("below"),
        F.count(inside).alias("m"),
        F.percentile_approx(inside, [i / GRID for i in range(GRID + 1)], accuracy).alias("grid"),
    )
    spare = 2 + math.ceil(2 * GRID / accuracy)

    def step(rank: Column) -> Column:
        return (rank - F.col("below")) / F.col("m") * GRID

    place = F.lit((p * 100.0) / 100.0) * (F.col("n") - 1)
    first = (F.floor(step(F.floor(place))) - spare).cast("int")
    last = (F.ceil(step(F.ceil(place))) + spare).cast("int")
    low = F.when((first > 0) & (first <= GRID), F.try_element_at("grid", first + 1)).otherwise(F.col("lo"))
    high = F.when((last >= 0) & (last < GRID), F.try_element_at("grid", last + 1)).otherwise(F.col("hi"))
    return counted.select("g", "n", "mn", "mx", low.alias("lo"), high.alias("hi"))


def _pick(base: DataFrame, brackets: DataFrame, p: float, kept: Kept) -> DataFrame:
    rows = lookup_join(base, brackets, {"g": F.col("g")}, count="n", kept=kept, how="inner")
    runs = (
        rows.where("v <= hi")
        .withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))  # null = below the bracket
        .groupBy("g", "v")
        .agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    )
    seen = F.sum("c").over(Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first()))
    place = F.lit((p * 100.0) / 100.0) * (F.col("n") - 1)
    runs = runs.select(
        "g", "v", "n", seen.alias("upto"), (seen - F.col("c")).alias("below"), place.alias("place")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("below") <= rank) & (F.col("upto") > rank), F.col("v")))

    ends = runs.groupBy("g").agg(
        F.max("n").alias("n"),
        at(F.floor("place")).alias("a"),
        at(F.ceil("place")).alias("b"),
        F.max(F.col("place") - F.floor("place")).alias("f"),
    )
    a, b, f = F.col("a"), F.col("b"), F.col("f")
    q = F.when(f >= 0.5, b - (b - a) * (1 - f)).otherwise(a + (b - a) * f)
    return ends.select("g", "n", F.when(a == b, a).otherwise(q).alias("q"))
