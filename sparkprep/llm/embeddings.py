"""Embedding near-duplicates by randomly rotated binary codes with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col, components, kept

#: Chance that a pair at the very threshold shares no bucket, or that its estimate leaves its confidence bound.
MISS = 1e-5
SPREAD = 5.0  # standard deviations of the estimate's error
CHUNK = 1024  # rows of a bucket compared with each other in one step
CELL = 32  # rows wanted in a bucket
SEED = 20_240_501


def rotations(dim: int, count: int):
    """``count`` random orthogonal matrices, the same in every process."""
    import numpy as np

    random = np.random.default_rng(SEED + dim)
    return np.stack([np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(count)])


def plan(total: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables: buckets of about ``CELL`` rows, and ``MISS`` at the threshold.

    Signs of a random projection differ with probability angle / pi, so a pair
    shares all bits of a table with probability (1 - angle / pi) ^ bits.
    """
    bits = min(30, max(4, round(math.log2(max(2, total / CELL)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(max(1e-12, 1 - same)))) if same < 1 else 1


def unit_rows(vectors: list) -> "tuple":
    """The rows as a float64 matrix and their norms; a row that cannot be compared has norm 0."""
    import numpy as np

    x = np.array(vectors, dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x, norm


def estimate_links(keys, codes, factors, query, threshold: float, table: int, side=None):
    """Index pairs of one bucket whose cosine may reach ``threshold``.

    ``codes`` are the rotated vectors' signs, ``factors`` their stored inner
    product with the vector itself; ``codes @ query / factors`` is an unbiased
    estimate of the inner product.  Given a true cosine c its error has a standard
    deviation of sqrt((1 - c^2) (1 - f^2) / (f^2 (d - 1))), so a pair at the threshold or
    above lies above the bound below but for SPREAD deviations.  Pairs that
    met in an earlier table are left to it.
    """
    import numpy as np

    d = codes.shape[1]
    f = factors.astype(np.float64)
    near = codes.astype(np.float32) @ query.T / (f[:, None] * math.sqrt(d))
    slack = SPREAD * np.sqrt((1 - threshold**2) * np.maximum(0, 1 - f * f) / (f * f * max(1, d - 1))) + 2e-2  # and the rounding of query
    i, j = np.nonzero(near >= (threshold - slack)[:, None])
    ok = i < j if side is None else (side[i] == 0) & (side[j] == 1)
    i, j = i[ok], j[ok]
    if table and len(i):
        new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def candidates(vectors: DataFrame, total: int, threshold: float) -> DataFrame:
    """``(a, b)``: pairs of uids whose bounds do not rule out a link, each once.

    Every vector goes to one bucket per table; a bucket of more than 1024 rows is
    cut into chunks that meet pair by pair in different tasks.  Rows carry the code, its factor and the
    rotated vector in bytes, not the vector itself.
    """
    bits, tables = plan(total, threshold)
    code_row = "dim int, tbl int, bucket int, uid long, bits binary, factor double, query binary, keys binary"

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        cache: dict[int, tuple] = {}
        for df in batches:
            for dim, part in df.groupby(df["vec"].map(len)):
                dim = int(dim)
                if dim not in cache:
                    cache[dim] = rotations(dim, 1 + -(-bits * tables // dim))
                turn = cache[dim]
                for k in range(0, len(part), 512):
                    piece = part.iloc[k : k + 512]
                    x, norm = unit_rows(piece["vec"].tolist())
                    x /= norm[:, None]
                    y = x @ turn[0]
                    factor = np.abs(y).sum(axis=1) / math.sqrt(dim)
                    more = np.concatenate([x @ t for t in turn[1:]], axis=1)[:, : bits * tables] > 0
                    keys = (more.reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype("<i4")
                    signs, query = np.packbits(y > 0, axis=1), np.rint(y * 127).astype(np.int8)
                    n = len(x)
                    out = {
                        "dim": np.full(n * tables, dim, np.int32),
                        "tbl": np.tile(np.arange(tables, dtype=np.int32), n),
                        "bucket": keys.reshape(-1),
                        "uid": np.repeat(piece["uid"].to_numpy(), tables),
                        "factor": np.repeat(factor, tables),
                    }
                    for name, rows in (("bits", signs), ("query", query), ("keys", keys)):
                        own = [r.tobytes() for r in rows]
                        out[name] = [own[i // tables] for i in range(n * tables)]
                    yield pd.DataFrame(out)[["dim", "tbl", "bucket", "uid", "bits", "factor", "query", "keys"]]

    codes = vectors.select("uid", "vec").mapInPandas(encode, code_row)
    place = ["dim", "tbl", "bucket"]
    codes = kept(codes)
    sizes = codes.groupBy(place).agg(F.count("*").alias("n")).where("n > 1")
    codes = codes.join(sizes, place)
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    codes = codes.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
    # a chunk meets every chunk once: as the first of a pair with those behind it, as the second with those before
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("c1"), F.greatest(c, F.col("chunk")).alias("c2")))
    codes = codes.select(*place, "uid", "bits", "factor", "query", "keys", "chunk", F.explode(meets).alias("c")).select("*", "c.c1", "c.c2").drop("c")
    group = [*place, "c1", "c2"]

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def run(df) -> "pd.DataFrame":
            dim, table = int(df["dim"].iat[0]), int(df["tbl"].iat[0])
            signs = np.unpackbits(np.frombuffer(b"".join(df["bits"]), np.uint8).reshape(len(df), -1), axis=1, count=dim).astype(np.int8) * 2 - 1
            query = np.frombuffer(b"".join(df["query"]), np.int8).reshape(len(df), dim).astype(np.float32) / 127
            keys = np.frombuffer(b"".join(df["keys"]), "<i4").reshape(len(df), tables)
            side = None if df["c1"].iat[0] == df["c2"].iat[0] else (df["chunk"] == df["c2"]).to_numpy().astype(int)
            i, j = estimate_links(keys, signs, df["factor"].to_numpy(), query, threshold, table, side)
            uid = df["uid"].to_numpy()
            return pd.DataFrame({"a": np.minimum(uid[i], uid[j]), "b": np.maximum(uid[i], uid[j])})

        rest = None
        for df in batches:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            names = df[group].to_numpy()
            cuts = [0, *(np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1).tolist()]
            out = [run(df.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]  # the last group may go on in the next batch
            rest = df.iloc[cuts[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest):
            yield run(rest)

    dealt = codes.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInPandas(compare, "a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    ``n_links`` counts the other rows at a cosine (double precision) of
    ``threshold`` or more, ``component_id`` is the smallest vec_id reachable over links, the row's own
    included, and ``kept`` marks the row with that id.  Null, empty and zero
    vectors and those with a null or non-finite component link with nothing;
    neither do vectors of different length.  Equal vectors are compared once and
    counted as often as they occur, so many copies cost one row.  Rows with a null
    id are counted by others but name no component; alone their component is
    null and kept is false.  Repeated ids each return a row.  Other columns are
    not read.

    A pair at the threshold is missed with a chance of about 1e-5, closer ones
    far less often; links are exact, as every pair the bounds leave is recomputed.
    """
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("vec"))
    good = F.coalesce(
        (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    # scaled by the largest component, so that squares neither overflow nor vanish; -0.0 becomes 0.0
    scaled = F.transform("vec", lambda x: x / F.array_max(F.transform("vec", F.abs)) + F.lit(0.0))
    rows = kept(rows.select("vec_id", F.when(good, scaled).alias("vec")).withColumn("h1", F.xxhash64(F.lit(1), "vec")).withColumn("h2", F.xxhash64(F.lit(2), "vec")))
    classes = rows.where("vec is not null").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("vec").alias("vec"))
    classes = kept(classes.withColumn("uid", F.monotonically_increasing_id()))
    total = classes.count()

    def recompute(batches: Iterator) -> Iterator:
        import numpy as np

        for df in batches:
            if len(df):
                keep = np.zeros(len(df), bool)
                for _, part in df.groupby(df["va"].map(len)):
                    x, nx = unit_rows(part["va"].tolist())
                    y, ny = unit_rows(part["vb"].tolist())
                    keep[part.index] = (x * y).sum(axis=1) / (nx * ny) >= threshold
                yield df.loc[keep, ["a", "b"]]

    found = candidates(classes, total, threshold)
    left = found.join(classes.select(F.col("uid").alias("a"), F.col("vec").alias("va")), "a")
    both = left.join(classes.select(F.col("uid").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")
    links = kept(both.mapInPandas(recompute, "a long, b long"))

    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select(F.col("uid").alias("b"), "n")
    near = ends.join(size, "b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "uid")
    roots = components(links).withColumnsRenamed({"node": "uid"})
    joined = classes.select("uid", "h1", "h2", "n", "low").join(near, "uid", "left").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    named = joined.join(lowest, "root").select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("vec is not null").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
