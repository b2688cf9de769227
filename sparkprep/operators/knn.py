"""Nearest-neighbour filling: exact, without comparing every pair of rows.

A missing value becomes the mean of the column over the five rows nearest in all
other numeric columns (unscaled; the distance over the coordinates both rows
have is scaled up by the share that is missing).

Rows that can donate a value are split into small cells: one tree of median cuts
per frequent pattern of missing coordinates, and one for all other patterns,
which also cuts by whether a coordinate is missing.  A row in need is first compared with the
cell it falls into; its fifth-best distance there then rules out every cell whose
bounding box is farther away.  Only the remaining cells are joined, in bounded
chunks.  The cuts come from a sample, but they only shape the cells: boxes and
distances use all rows, so the neighbours are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import col, is_infinite, number_of, numeric_columns
from sparkprep.functions.lookup import Kept, lookup_join
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform, require_numeric

NEIGHBOURS = 5


@dataclass(frozen=True)
class Sizes:
    """Bounds on what a task or the driver holds; none of them changes a result."""

    cell_rows: int = 2_048  # wanted donors per cell
    max_cells: int = 32_768  # cells described on the driver
    sample_values: int = 4_000_000  # sampled coordinates shaping the cells
    max_trees: int = 64  # missing patterns with a tree of their own
    chunk_rows: int = 8_192  # rows of either side in one comparison
    block_pairs: int = 1_000_000  # distances held at once inside a comparison


@dataclass
class Tree:
    """A complete binary tree of cuts over the donors of one missing pattern, or
    of many."""

    present: np.ndarray | None  # which coordinates its donors have; None: of many patterns
    axis: np.ndarray  # per inner node
    cut: np.ndarray
    first_cell: int
    low: np.ndarray | None = None  # per node, filled from the real donors
    high: np.ndarray | None = None
    count: np.ndarray | None = None
    sure: np.ndarray | None = None  # coordinates all donors of the node have
    some: np.ndarray | None = None  # coordinates any of them has

    @property
    def inner(self) -> int:
        return len(self.axis)

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(int(np.log2(self.inner + 1))):
            value = x[np.arange(len(x)), self.axis[node]]
            right = np.where(np.isnan(value), np.inf, value) > self.cut[node]  # missing: beyond every number
            node = 2 * node + 1 + right
        return node - self.inner + self.first_cell

    def set_boxes(self, boxes: dict[int, tuple[int, list[int], list[float], list[float]]], width: int) -> None:
        """``boxes`` per cell: donors, how many have each coordinate, and its ends."""
        nodes = 2 * self.inner + 1
        self.count = np.zeros(nodes, dtype=np.int64)
        self.low, self.high = np.full((nodes, width), np.inf), np.full((nodes, width), -np.inf)
        self.sure, self.some = np.ones((nodes, width), dtype=bool), np.zeros((nodes, width), dtype=bool)
        for cell, (count, given, low, high) in boxes.items():
            node = cell - self.first_cell + self.inner
            if self.inner <= node < nodes:
                self.count[node] = count
                self.sure[node], self.some[node] = np.array(given) == count, np.array(given) > 0
                self.low[node] = np.where(self.sure[node], np.array(low, dtype=float), 0.0)
                self.high[node] = np.where(self.sure[node], np.array(high, dtype=float), 0.0)
        for node in range(self.inner - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            self.count[node] = self.count[a] + self.count[b]
            self.low[node] = np.minimum(self.low[a], self.low[b])
            self.high[node] = np.maximum(self.high[a], self.high[b])
            self.sure[node], self.some[node] = self.sure[a] & self.sure[b], self.some[a] | self.some[b]

    def gap(self, x: np.ndarray, node: np.ndarray | int) -> np.ndarray:
        """Least possible distance from each row of ``x`` to the node's donors: the
        coordinates all of them have, scaled for as many as any of them has."""
        shared = ~np.isnan(x) & self.sure[node]
        away = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0.0)
        squares = np.where(shared, away, 0.0)
        parts = (~np.isnan(x) & self.some[node]).sum(axis=1)
        # Added in the order of :func:`distances`, so rounding cannot pass it.
        total = np.zeros(len(x))
        for j in range(x.shape[1]):
            total += squares[:, j] * squares[:, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(parts > 0, np.sqrt((x.shape[1] + 1.0) / parts * total), np.inf)


def grow(sample: np.ndarray, present: np.ndarray | None, depth: int, first_cell: int) -> Tree:
    """Cut the widest coordinate ``depth`` times: off the rows that lack it, where
    some do, else at its median."""
    inner = 2**depth - 1
    axis, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    members: list[np.ndarray | None] = [sample] + [None] * (2 * inner)
    for node in range(inner):
        rows = members[node]
        if rows is not None and len(rows) > 1:
            lacking = np.isnan(rows)
            high, low = np.where(lacking, -np.inf, rows).max(axis=0), np.where(lacking, np.inf, rows).min(axis=0)
            spread = high - low  # -inf where no row has it
            best = int(np.argmax(spread))
            if spread[best] > 0:
                values = rows[:, best]
                axis[node] = best
                if lacking[:, best].any():
                    cut[node] = np.finfo(float).max
                else:
                    middle = np.median(values)
                    # A median equal to the maximum would leave the right side empty.
                    cut[node] = middle if middle < values.max() else values[values < middle].max()
        if not np.isfinite(cut[node]) and present is not None:
            axis[node] = int(np.argmax(present))
        if rows is not None:
            value = rows[:, axis[node]]
            right = np.where(np.isnan(value), np.inf, value) > cut[node]
            members[2 * node + 1], members[2 * node + 2] = rows[~right], rows[right]
            members[node] = None
    return Tree(present, axis, cut, first_cell)


def distances(needy: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Scaled distance of every needy row to every donor; inf without a shared
    coordinate."""
    total = np.zeros((len(needy), len(donors)))
    parts = np.zeros((len(needy), len(donors)))
    for j in range(needy.shape[1]):
        step = needy[:, j, None] - donors[None, :, j]
        known = ~np.isnan(step)
        total += np.where(known, step * step, 0.0)
        parts += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(parts > 0, np.sqrt((needy.shape[1] + 1.0) / parts * total), np.inf)


def nearest(needy: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int, pairs: int):
    """Row number, distance and value of the ``k`` best donors of each row,
    smaller values first among equal distances."""
    found = []
    size = max(1, pairs // max(1, len(donors)))
    for start in range(0, len(needy), size):
        d = distances(needy[start : start + size], donors)
        edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        r, c = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        order = np.lexsort((values[c], d[r, c], r))
        r, c = r[order], c[order]
        position = np.arange(len(r)) - np.searchsorted(r, r)
        keep = position < k
        found.append((r[keep] + start, d[r[keep], c[keep]], values[c[keep]]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


class CellMap:
    """All trees together; the last one may hold every rarer missing pattern."""

    def __init__(self, trees: list[Tree], k: int):
        self.trees, self.k = trees, k

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The cell every donor belongs to."""
        out = np.zeros(len(x), dtype=np.int64)
        present, left = ~np.isnan(x), np.ones(len(x), dtype=bool)
        for tree in self.trees:
            own = left & (present == tree.present).all(axis=1) if tree.present is not None else left
            if own.any():
                out[own] = tree.cells(x[own])
            left = left & ~own
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """A promising cell for every needy row, -1 if no tree is comparable."""
        out = np.full(len(x), -1, dtype=np.int64)
        best = np.full(len(x), np.inf)
        for tree in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(tree.inner + 1))):
                a, b = 2 * node + 1, 2 * node + 2
                ga, gb = (np.where(tree.count[n] > 0, tree.gap(x, n), np.inf) for n in (a, b))
                thin = (tree.count[b] < self.k) & (tree.count[a] >= self.k)
                to_left = thin | ((ga <= gb) & ~((tree.count[a] < self.k) & (tree.count[b] >= self.k)))
                node = np.where(to_left, a, b)
            gap = tree.gap(x, node)
            better = gap < best
            best[better] = gap[better]
            out[better] = node[better] - tree.inner + tree.first_cell
        return out

    def reachable(self, x: np.ndarray, limit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cells: every further cell that may hold a donor
        within the row's ``limit``."""
        rows_out, cells_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def visit(rows: np.ndarray, cell: int) -> None:
            rows_out.append(rows)
            cells_out.append(np.full(len(rows), cell, dtype=np.int64))

        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if tree.count[node] == 0:
                    continue
                gap = tree.gap(x[rows], node)
                rows = rows[(gap <= limit[rows]) & np.isfinite(gap)]
                if not len(rows):
                    continue
                if node < tree.inner:
                    stack += [(2 * node + 1, rows), (2 * node + 2, rows)]
                else:
                    cell = node - tree.inner + tree.first_cell
                    visit(rows[home[rows] != cell], cell)
        return np.concatenate(rows_out), np.concatenate(cells_out)


def _coordinates(df: DataFrame, names: list[str]) -> list[Column]:
    return [number_of(df, n).alias(f"x{j}") for j, n in enumerate(names)]


def _matrix(frame: pd.DataFrame, width: int) -> np.ndarray:
    return frame[[f"x{j}" for j in range(width)]].to_numpy(dtype=float, na_value=np.nan)


def _map_cells(frame: DataFrame, cells: CellMap, width: int) -> DataFrame:
    schema = T.StructType([*frame.schema.fields, T.StructField("cell", T.LongType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cells.cell_of(_matrix(batch, width)))

    return frame.mapInPandas(assign, schema)


def _map_home(frame: DataFrame, cells: CellMap, width: int) -> DataFrame:
    schema = T.StructType([*frame.schema.fields, T.StructField("cell", T.LongType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cells.home(_matrix(batch, width)))

    return frame.mapInPandas(assign, schema)


def _map_reachable(frame: DataFrame, cells: CellMap, width: int) -> DataFrame:
    """One row per needy row and further cell; ``reach`` and ``home`` go."""
    names = [f"x{j}" for j in range(width)]
    schema = T.StructType([frame.schema[n] for n in names] + [T.StructField("cell", T.LongType())])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Small slices bound the rows this multiplies into.
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start : start + 1024]
                limit = part["reach"].to_numpy(dtype=float, na_value=np.inf)
                limit = np.where(np.isnan(limit), np.inf, limit)
                rows, found = cells.reachable(_matrix(part, width), limit, part["home"].to_numpy())
                out = part[names].iloc[rows].assign(cell=found)
                if len(out):
                    yield out

    return frame.mapInPandas(assign, schema)


def _compare(needy: DataFrame, donors: DataFrame, cells: DataFrame, width: int, k: int, sizes: Sizes) -> DataFrame:
    """Best ``k`` donors of every needy row among the cells it is paired with.

    Rows of both sides are dealt into chunks of bounded size per cell, so a
    crowded cell becomes many comparisons instead of one large group.
    """
    names = [f"x{j}" for j in range(width)]
    crowd = needy.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    layout = cells.join(crowd, "cell").select(
        "cell",
        F.ceil(F.col("m") / sizes.chunk_rows).alias("np"),
        F.ceil(F.col("n") / sizes.chunk_rows).cast("int").alias("dp"),
    )
    layout = F.broadcast(layout)  # at most max_cells rows
    deal = F.xxhash64(*names)
    left = needy.join(layout, "cell").select(
        *names,
        "cell",
        F.pmod(deal, F.col("np")).alias("a"),
        F.explode(F.sequence(F.lit(0), F.col("dp") - 1)).alias("b"),
    )
    right = donors.join(layout, "cell").select(
        *names,
        "v",
        "cell",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)).alias("a"),
        F.pmod(deal, F.col("dp")).cast("int").alias("b"),
    )
    schema = ", ".join([f"{n} double" for n in names] + ["d double", "v double"])
    pairs = sizes.block_pairs

    def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({n: pd.Series(dtype=float) for n in [*names, "d", "v"]})
        x = _matrix(mine, width)
        rows, d, v = nearest(x, _matrix(theirs, width), theirs["v"].to_numpy(dtype=float), k, pairs)
        out = pd.DataFrame(x[rows], columns=names)
        return out.assign(d=d, v=v)

    keys = ["cell", "a", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)
    # Absent coordinates travel through pandas as NaN.
    found = found.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names], "d", "v")
    return _best(found, names, k)


def _best(found: DataFrame, names: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*names).orderBy("d", "v"))
    return found.withColumn("__p", place).where(F.col("__p") <= k).drop("__p")


def _build_cells(donors: DataFrame, width: int, k: int, sizes: Sizes, kept: Kept) -> tuple[CellMap, DataFrame]:
    names = [f"x{j}" for j in range(width)]
    pattern = F.concat(*[F.when(F.col(n).isNull(), "0").otherwise("1") for n in names])
    patterns = donors.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    patterns = kept.keep(patterns)
    common = patterns.orderBy(F.desc("n"), "pattern").limit(sizes.max_trees).collect()
    total = patterns.agg(F.sum("n")).first()[0] or 0
    max_cells = max(2, min(sizes.max_cells, 2 * sizes.sample_values // width))
    share = min(1.0, sizes.sample_values / width / max(1, total))
    rows = donors.select(*names).sample(share, seed=7).limit(2 * sizes.sample_values // width).toPandas()
    sample = _matrix(rows, width)
    known = ~np.isnan(sample)
    trees, first = [], 0
    groups = [(np.array([c == "1" for c in r["pattern"]]), r["n"]) for r in common]
    if (rare := total - sum(n for _, n in groups)) > 0:
        groups.append((None, rare))
    others = np.ones(len(sample), dtype=bool)
    for present, rows_here in groups:
        own = others & (known == present).all(axis=1) if present is not None else others
        others = others & ~own
        wanted = min(rows_here / sizes.cell_rows, max_cells * rows_here / total, max(1, own.sum()) / 4)
        depth = max(0, int(np.log2(max(1.0, wanted))))
        trees.append(grow(sample[own], present, depth, first))
        first += 2**depth
    cells = CellMap(trees, k)
    placed = kept.keep(_map_cells(donors, cells, width))
    ends = [f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.count, F.min, F.max)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect()
    table = {r["cell"]: (r["n"], *([r[f"{f}_{n}"] for n in names] for f in ("count", "min", "max"))) for r in boxes}
    for tree in trees:
        tree.set_boxes(table, width)
    return cells, placed


def neighbour_means(
    table: DataFrame, needy_table: DataFrame, column: str, names: list[str], kept: Kept, k: int, sizes: Sizes
) -> DataFrame:
    """Per distinct coordinates of a needy row: ``x*``, its row count ``n`` and
    the mean ``q`` of its neighbours' values."""
    width = len(names)
    xs = [f"x{j}" for j in range(width)]
    some = F.coalesce(*xs).isNotNull()
    v = number_of(table, column)
    given = table.where(v.isNotNull()).select(*_coordinates(table, names), v.alias("v")).where(some)
    # Among donors at one point only the k smallest values can ever be chosen;
    # the window limit drops the others before the shuffle.
    place = F.row_number().over(Window.partitionBy(*xs).orderBy("v"))
    donors = given.withColumn("__p", place).where(F.col("__p") <= k).drop("__p")
    w = number_of(needy_table, column)
    needy = kept.keep(
        needy_table.where(w.isNull())
        .select(*_coordinates(needy_table, names))
        .where(some)
        .groupBy(*xs)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    donors = kept.keep(donors)
    cells, placed = _build_cells(donors, width, k, sizes, kept)
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    homes = kept.keep(_map_home(needy.select(*xs), cells, width))
    first = kept.keep(_compare(homes.where("cell >= 0"), placed, counts, width, k, sizes))
    reach = first.groupBy(*xs).agg(F.count(F.lit(1)).alias("__c"), F.max("d").alias("__d"))
    reach = reach.select(*xs, F.when(F.col("__c") >= k, F.col("__d")).alias("reach"))
    same = [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in xs]
    limits = (
        homes.alias("l")
        .join(reach.alias("r"), same, "left")
        .select(*[F.col(f"l.{x}").alias(x) for x in xs], F.col("l.cell").alias("home"), F.col("r.reach").alias("reach"))
    )
    more = kept.keep(_map_reachable(limits, cells, width))
    second = _compare(more, placed, counts, width, k, sizes)
    means = _best(first.unionByName(second), xs, k).groupBy(*xs).agg(F.avg("v").alias("q"))
    joined = needy.alias("l").join(means.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{x}").alias(x) for x in xs], F.col("l.n").alias("n"), F.col("r.q").alias("q"))


def fill_na_knn(df: DataFrame, column: str, params: dict[str, Any], sizes: Sizes = Sizes()) -> StepPlan:
    """Missing values become the mean of the five nearest rows that have one; a
    row without any comparable one takes the column mean."""
    require_numeric(df, column)
    names = [n for n in numeric_columns(df) if n != column]
    numbers = {n: number_of(df, n) for n in [column, *names]}
    stats = {f"i{j}": F.count_if(is_infinite(x)) for j, x in enumerate(numbers.values())}
    stats |= {"mean": F.avg(numbers[column]), "missing": F.count_if(numbers[column].isNull())}

    def learn(table: DataFrame, fit: Fit) -> Transform:
        if any(fit.stats[f"i{j}"] for j in range(len(numbers))):
            raise SkipStep("the numeric columns hold infinite values")
        mean = fit.stats["mean"]
        donors = fit.table("donors", lambda: table.select(*[col(n) for n in (column, *names)]).where(numbers[column].isNotNull()))

        def transform(t: DataFrame) -> DataFrame:
            x = number_of(t, column)
            if mean is None:
                return t.withColumn(column, x)
            if not names or (t is table and not fit.stats["missing"]):
                return t.withColumn(column, F.coalesce(x, F.lit(mean)))
            means = fit.kept.keep(neighbour_means(donors, t, column, names, fit.kept, NEIGHBOURS, sizes))
            lookup = means.withColumnsRenamed({"n": "__kn", "q": "__kq"})
            keys = dict(zip([f"x{j}" for j in range(len(names))], [number_of(t, n) for n in names]))
            gaps = t.where(x.isNull())
            filled = lookup_join(gaps, lookup, keys, "__kn", fit.kept, null_safe=True)
            filled = filled.withColumn(column, F.coalesce(F.col("__kq"), F.lit(mean))).drop("__kn", "__kq")
            return t.where(x.isNotNull()).withColumn(column, x).unionByName(filled)

        return transform

    return StepPlan(learn, {column, *names}, {column}, stats, whole_row=True, shuffles_table=True)
