"""Trying a recipe on the head of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import FLOATING, TIMES, TIMESTAMP_TEXT, col, is_infinite, value_of
from sparkprep.functions.lookup import Kept
from sparkprep.plans.recipe import Recipe
from sparkprep.plans.runner import FittedRecipe, fit_recipe
from sparkprep.sources.order import first_files, with_place
from sparkprep.sources.tables import write_table

SAMPLE_ROWS = 1_000
SHOWN_ROWS = 100
PLACE = "__place_in_files"  # a struct: no step takes it for a number or a text


def head_sample(df: DataFrame, rows: int = SAMPLE_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``rows`` rows by ``order_by``, else as the files hold them.

    A frame that is not read from files has no order of its own: any ``rows`` rows.
    """
    if order_by:
        return df.orderBy(*[col(c) for c in order_by]).limit(rows)
    return _placed_head(df, rows).drop(PLACE)


def _placed_head(df: DataFrame, rows: int) -> DataFrame:
    """The first rows, with their place where the frame is read from files."""
    placed = with_place(first_files(df, rows), PLACE)
    return df.limit(rows) if placed is None else placed.orderBy(PLACE).limit(rows)


def write_sample(df: DataFrame, path: str, rows: int = SAMPLE_ROWS, order_by: Sequence[str] = ()) -> None:
    """The head sample as a CSV or Parquet folder, by the name of ``path``."""
    write_table(head_sample(df, rows, order_by), path)


def sanitise(df: DataFrame) -> DataFrame:
    """JSON-safe values: infinities and NaN become NULL, times become text."""

    def safe(field) -> Column:
        if isinstance(field.dataType, FLOATING):
            x = value_of(df, field.name)
            return F.when(~is_infinite(x), x).alias(field.name)
        if isinstance(field.dataType, TIMES):
            return F.date_format(col(field.name), TIMESTAMP_TEXT).alias(field.name)
        return col(field.name)

    return df.select(*[safe(f) for f in df.schema.fields])


def _keeping_first(recipe: Recipe) -> Recipe:
    """The recipe whose duplicate steps keep the row with the smallest place."""
    keep = lambda s: replace(s, params={"position": PLACE, **(s.params or {})}) if s.operation == "drop_duplicates" else s
    return replace(recipe, steps=[keep(s) for s in recipe.steps])


@dataclass
class Preview:
    rows: int
    columns: list[str]
    data: DataFrame  # at most ``show`` JSON-safe rows
    fitted: FittedRecipe


def preview(
    df: DataFrame, recipe: Recipe, n: int = SAMPLE_ROWS, show: int = SHOWN_ROWS, order_by: Sequence[str] = ()
) -> Preview:
    """Fit and apply ``recipe`` on the first ``n`` rows and page the result.

    The page keeps the order of ``order_by``, else that of the files; of equal
    rows the first one stays.
    """
    # Every fitting pass must see the same few rows, and finding them may scan.
    kept = Kept()
    head = kept.keep(head_sample(df, n, order_by) if order_by else _placed_head(df, n))
    placed = PLACE in head.columns
    fitted = fit_recipe(head, _keeping_first(recipe) if placed else recipe)
    fitted.kept.frames += kept.frames
    order = [PLACE] if placed else [c for c in order_by if c in fitted.output.columns]
    page = fitted.output.orderBy(*[col(c) for c in order]) if order else fitted.output
    page, fitted.output = page.drop(PLACE), fitted.output.drop(PLACE)
    fitted.schema = df.schema
    if placed:  # the place is the preview's own: nothing learnt may ask for it
        given = lambda s: replace(s, params={k: v for k, v in s.params.items() if v != PLACE}) if s.params else s
        fitted.learnt = [(given(s), fit) for s, fit in fitted.learnt]
        for r in fitted.results:
            r.step = given(r.step)
    result = fitted.output
    return Preview(result.count(), result.columns, sanitise(page.limit(show)), fitted)
