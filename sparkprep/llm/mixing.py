"""Sources mixed to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.common import col

REST = "(rest)"
MAX_CELLS = 1_000_000
ROUNDS = 30

Targets = Mapping[str, Mapping[str, float]]


def topic(text: Column) -> Column:
    """A plain topic by form: table, figures or prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.instr(text, " | ") > 0, "table").when(text.rlike("[0-9]"), "figures").otherwise("prose")


def n_tokens(text: Column) -> Column:
    """Words separated by white space (ASCII), 0 for null."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]", "")).cast("long")


def rake(tokens: Mapping[tuple[str, ...], int], targets: Targets, rounds: int = ROUNDS) -> dict[tuple[str, ...], float]:
    """Weight per cell so that the weighted tokens meet the target shares of every margin.

    Each round rescales the weights margin by margin.  Targets are shares among
    the categories that have tokens; a category with tokens and no target mass
    gets weight 0.
    """
    weights = {cell: 1.0 for cell in sorted(tokens)}
    total = float(sum(tokens.values()))
    for _ in range(rounds):
        for axis, shares in enumerate(targets.values()):
            have: dict[str, float] = {}
            for cell, w in weights.items():
                have[cell[axis]] = have.get(cell[axis], 0.0) + w * tokens[cell]
            present = sum(shares.get(c, 0.0) for c, n in have.items() if n > 0)
            factor = {c: shares.get(c, 0.0) / present * total / n if n > 0 and present > 0 else 0.0 for c, n in have.items()}
            weights = {cell: w * factor[cell[axis]] for cell, w in weights.items()}
    return weights


def full_targets(targets: Targets) -> dict[str, dict[str, float]]:
    """Targets with the rest category: its share if given as ``REST``, else what the given shares leave of 1."""
    out = {}
    cells = 1
    for name, shares in targets.items():
        if any(s < 0 for s in shares.values()) or sum(shares.values()) > 1 + 1e-9:
            raise ValueError(f"target shares of {name} must be positive and add to 1 at most")
        out[name] = {REST: max(0.0, 1 - sum(shares.values()))} | dict(shares)
        cells *= len(out[name])
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} cells of targets; at most {MAX_CELLS}")
    return out


def with_rest(tokens: Mapping[tuple[str, ...], int], targets: Targets) -> dict[str, dict[str, float]]:
    """Full targets; a rest category that is left nothing keeps its share of the tokens, and the named ones share the others.

    So a margin whose shares add to 1 loses no row outside its list; only a
    ``REST`` share of 0 that is given takes them out.
    """
    total = sum(tokens.values())
    out = full_targets(targets)
    for axis, (name, shares) in enumerate(out.items()):
        if REST not in targets[name] and shares[REST] < 1e-9 and total:
            own = sum(n for cell, n in tokens.items() if cell[axis] == REST) / total
            out[name] = {c: s * (1 - own) for c, s in shares.items()} | {REST: own}
    return out


def calibrate(docs: DataFrame, targets: Targets, tokens: str = "n_tokens", rounds: int = ROUNDS) -> tuple[dict[tuple[str, ...], tuple[float, int]], int]:
    """Raked weight and tokens of every cell of the margins (columns named as in ``targets``) that holds documents; all tokens.

    Categories not named in a margin's targets, and nulls, belong to the rest
    category, so there are no more cells than combinations of targets, however
    many the data hold.  Only these sums reach the driver.
    """
    keys = [margin(name, shares).alias(f"m{i}") for i, (name, shares) in enumerate(full_targets(targets).items())]
    sums = docs.select(*keys, col(tokens).alias("n")).groupBy(*[f"m{i}" for i in range(len(keys))]).agg(F.sum("n"))
    cells = {tuple(r[:-1]): int(r[-1] or 0) for r in sums.collect()}
    return {c: (w, cells[c]) for c, w in rake(cells, with_rest(cells, targets), rounds).items()}, sum(cells.values())


def margin(name: str, shares: Mapping[str, float]) -> Column:
    known = [c for c in shares if c != REST]
    return F.when(col(name).isin(known), col(name)).otherwise(REST)


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone (52 bits of MD5); a null id counts as empty."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix:", rounds: int = ROUNDS, budget: int | None = None) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens, weight, probability, kept, copies, row)`` per row of ``docs``.

    ``weight`` is the raked weight of the row's cell of source, language and
    topic, ``probability`` the weight over the largest one of a cell with tokens,
    so that kept tokens meet all margins in expectation; ``kept`` holds if the
    id's uniform number is below it.  That is the largest sample without
    repeats, and its size hangs on the scarcest cell.  ``copies`` meets the
    margins at ``budget`` tokens instead (by default as many as ``docs`` hold):
    the weight, scaled to it, in whole copies and one more if the id's uniform
    number is below what is left.  Texts without tokens have one copy at most.  Null and unlisted sources and languages are in the rest
    category, which gets its share as ``REST`` or what the shares leave of 1; if
    they leave nothing, it keeps its share of the tokens, so none is lost for its
    language alone.  Empty
    texts have no tokens and their cell's weight.  Repeated rows and ids share
    one decision.  ``row`` holds all columns given; an empty table gives an
    empty one.
    """
    targets = {name: targets[name] for name in ("source", "lang", "topic")}
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), F.col("source"), F.col("lang"),
        topic(col(text_col)).alias("topic"), n_tokens(col(text_col)).alias("n_tokens"), F.struct("*").alias("row"),
    )
    weights, total = calibrate(rows.drop("row"), targets, rounds=rounds)
    most = max((w for w, n in weights.values() if n), default=0.0) or 1.0
    rate = 1.0 if budget is None else budget / max(1, total)
    cells = [f"m{i}" for i in range(len(targets))]
    table = rows.sparkSession.createDataFrame([(*c, float(w)) for c, (w, _) in weights.items()], ", ".join(f"{c} string" for c in cells) + ", weight double")
    rows = rows.withColumns({c: margin(n, full_targets(targets)[n]) for c, n in zip(cells, targets)})
    rows = rows.join(F.broadcast(table), cells).withColumn("probability", F.least(F.col("weight") / F.lit(most), F.lit(1.0)))  # MAX_CELLS rows at most
    want = F.when(F.col("n_tokens") > 0, F.col("weight") * rate).otherwise(F.least(F.col("weight") * rate, F.lit(1.0)))
    rows = rows.withColumn("u", uniform(F.col("doc_id"), seed)).withColumn("want", want)
    rows = rows.withColumn("kept", F.col("u") < F.col("probability"))
    rows = rows.withColumn("copies", F.floor("want") + (F.col("u") < F.col("want") - F.floor("want")).cast("long"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "kept", "copies", "row")
