"""The cell search against a brute-force neighbour search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions.lookup import Kept
from sparkprep.operators import knn

TINY = knn.Sizes(cell_rows=8, max_cells=64, sample_values=4_000, max_trees=3, chunk_rows=16, block_pairs=100)


def brute(data: np.ndarray, target: int, k: int = 5) -> list[float]:
    """Mean of the ``k`` nearest donors, ties by value; column mean without any."""
    width = data.shape[1]
    donors = data[~np.isnan(data[:, target])]
    out = []
    for row in data:
        if not math.isnan(row[target]):
            out.append(row[target])
            continue
        found = []
        for donor in donors:
            shared = [j for j in range(width) if j != target and not math.isnan(row[j]) and not math.isnan(donor[j])]
            if shared:
                total = sum((row[j] - donor[j]) ** 2 for j in shared)
                found.append((math.sqrt(width / len(shared) * total), donor[target]))
        best = sorted(found)[:k]
        out.append(sum(v for _, v in best) / len(best) if best else donors[:, target].mean())
    return out


def frame(spark, data: np.ndarray, partitions: int = 5):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    schema = "id string, " + ", ".join(f"c{j} double" for j in range(data.shape[1]))
    return spark.createDataFrame([(str(r[0]), *r[1:]) for r in rows], schema).repartition(partitions)


def filled(df, sizes=knn.Sizes()):
    from sparkprep.operators.base import Fit

    plan = knn.fill_na_knn(df, "c0", {}, sizes)
    row = df.agg(*[c.alias(n) for n, c in plan.stats.items()]).first().asDict()
    kept = Kept()
    out = plan.learn(df, Fit(row, {}, kept))(df)
    rows = sorted(out.select("id", "c0").collect(), key=lambda r: int(r["id"]))
    kept.release()
    return [r["c0"] for r in rows]


def gappy(seed: int, n: int, width: int, gaps: float, grid: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 6, size=(n, width)).astype(float) if grid else rng.normal(size=(n, width)) * rng.lognormal(0, 1, width)
    data[rng.random((n, width)) < gaps] = np.nan
    return data


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("sizes", [knn.Sizes(), TINY])
def test_equals_brute_force(spark, sizes, grid):
    """Random gaps in every column, on a grid also ties and repeated points; tiny
    cells, chunks and too few trees for the patterns change nothing."""
    data = gappy(3, 400, 4, 0.2, grid)
    assert filled(frame(spark, data), sizes) == pytest.approx(brute(data, 0), rel=1e-12)


def test_two_columns(spark):
    data = gappy(4, 300, 2, 0.15)
    assert filled(frame(spark, data), TINY) == pytest.approx(brute(data, 0), rel=1e-12)


def test_partitioning_does_not_matter(spark):
    data = gappy(6, 200, 3, 0.25, grid=True)
    assert filled(frame(spark, data, 1), TINY) == filled(frame(spark, data, 8), TINY)


def test_hot_point(spark):
    """A third of the donors and a third of the gaps share one point."""
    data = gappy(7, 300, 3, 0.1)
    data[:100, 1:] = 0.5
    data[100:200, 1:] = 0.5
    data[100:200, 0] = np.nan
    assert filled(frame(spark, data), TINY) == pytest.approx(brute(data, 0), rel=1e-12)


def test_few_donors_and_no_shared_coordinate(spark):
    nan = math.nan
    data = np.array([[nan, 1.0, nan], [nan, nan, nan], [4.0, 2.0, nan], [8.0, nan, 5.0], [nan, nan, 5.5], [1.0, 9.0, nan]])
    got = filled(frame(spark, data), TINY)
    assert got == pytest.approx(brute(data, 0))
    assert got[1] == pytest.approx(13 / 3)  # nothing to compare: the mean
    assert got[0] == pytest.approx(2.5)  # both donors that have c1


def test_single_numeric_column_takes_the_mean(spark, make, step):
    df = make("k string, x double", k=["a", "b", "c"], x=[1.0, None, 4.0])
    assert sorted(r["x"] for r in step(df, "fill_na_knn", "x").collect()) == [1.0, 2.5, 4.0]


def test_other_columns_and_rows_survive(spark, step):
    df = spark.range(500).select(
        F.col("id"),
        F.when(F.col("id") % 3 > 0, F.col("id") * 2.0).alias("x"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"),
        (F.col("id") % 2 == 0).alias("flag"),
    )
    out = step(df, "fill_na_knn", "x")
    assert out.columns == df.columns and out.count() == 500
    assert out.drop("x").exceptAll(df.drop("x")).count() == 0
    assert out.where("x is null").count() == 0
    assert out.where("id = 300").first()["x"] == pytest.approx(np.mean([598, 602, 596, 604, 592]))


def test_infinite_coordinates_are_refused(make, step):
    df = make("x double, y double", x=[1.0, None], y=[float("inf"), 1.0])
    assert "infinite" in step(df, "fill_na_knn", "x")


def test_many_missing_patterns(spark):
    """Far more patterns than trees, and gaps in nine columns of ten."""
    data = gappy(8, 1200, 10, 0.25)
    assert len({tuple(p) for p in np.isnan(data[:, 1:])}) > 100
    assert filled(frame(spark, data), TINY) == pytest.approx(brute(data, 0), rel=1e-12)


def test_rare_patterns_are_pruned_too():
    """Donors of 400 patterns in one tree: rows visit few of its cells."""
    rng = np.random.default_rng(9)
    data = rng.normal(size=(20_000, 8)) * [100, 60, 1, 1, 1, 1, 1, 1]
    data[rng.random(data.shape) < 0.2] = np.nan
    data = data[~np.isnan(data).all(axis=1)]
    tree = knn.grow(data[:4000], None, 8, 0)
    cells = knn.CellMap([tree], 5)
    own = cells.cell_of(data)
    boxes = {}
    for c in np.unique(own).tolist():
        part = data[own == c]
        with np.errstate(invalid="ignore"):
            low, high = np.where(np.isnan(part), np.inf, part).min(axis=0), np.where(np.isnan(part), -np.inf, part).max(axis=0)
        boxes[c] = (len(part), (~np.isnan(part)).sum(axis=0).tolist(), low.tolist(), high.tolist())
    tree.set_boxes(boxes, 8)
    needy = data[:200]
    home = cells.home(needy)
    limit = np.array([np.sort(knn.distances(needy[i : i + 1], data[own == home[i]])[0])[4] for i in range(200)])
    rows, found = cells.reachable(needy, limit, home)
    compared = sum(boxes[c][0] for c in found.tolist())
    assert compared < 0.35 * 200 * len(data)
    least = np.sort(knn.distances(needy, data), axis=1)[:, 4]  # what a cell left out holds is farther
    for i in range(200):
        seen = np.isin(own, [*found[rows == i], home[i]])
        assert np.sort(knn.distances(needy[i : i + 1], data[seen])[0])[4] == least[i]
