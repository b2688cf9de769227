"""The batch job: load, clean, build features, encode, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkprep.operators.base import Fit
from sparkprep.operators.encoding import auto_dummies
from sparkprep.plans.recipe import Recipe, Step
from sparkprep.plans.runner import FittedRecipe, fit_recipe
from sparkprep.plans.saved import AUTO_DUMMIES, save_fitted
from sparkprep.session import cut_lineage
from sparkprep.sources.tables import is_parquet, read_table, write_table


@dataclass
class BatchResult:
    output: DataFrame
    fitted: FittedRecipe
    rows: int | None = None  # known once something was written

    @property
    def columns(self) -> int:
        return len(self.output.columns)

    def summary(self, spark: SparkSession) -> DataFrame:
        """Step count, applied steps and final shape in one row."""
        done = [r.step.operation for r in self.fitted.results if r.status == "applied"]
        return spark.createDataFrame(
            [(len(self.fitted.results), done, self.rows, self.columns)],
            "steps int, applied array<string>, rows long, columns int",
        )


def transform_table(
    df: DataFrame,
    recipe: Recipe,
    mode: str = "phased",
    auto_dummy: bool = True,
    on_error: str = "skip",
    max_columns: int | None = None,
    form: str = "auto",
) -> BatchResult:
    """The recipe followed by dummy columns for every remaining text column.

    ``form`` is as for the one-hot step: ``'codes'`` and, where there are too many
    values for columns, ``'auto'`` give the array ``dummy_codes`` instead.
    """
    fitted = fit_recipe(df, recipe, mode=mode, on_error=on_error)
    if not auto_dummy:
        return BatchResult(fitted.output, fitted)
    fit = Fit({}, {}, fitted.kept)
    try:
        output = auto_dummies(fitted.output, fit, max_columns, form)
    except Exception:
        fitted.release()
        raise
    fitted.tables |= fit.tables
    fitted.learnt.append((Step("dummies", AUTO_DUMMIES, "", {"form": form, "max_columns": max_columns}), fit))
    return BatchResult(output, fitted)


def codes_path(target: str, column: str) -> str:
    """Beside the result: the folder that says what the codes in ``column`` stand for."""
    base, end = target.rstrip("/"), ""
    for known in (".parquet", ".csv"):
        if base.endswith(known):
            base, end = base[: -len(known)], known
    return f"{base}-{column}{end}"


def run_batch(spark: SparkSession, source: str, recipe: Recipe, target: str, save_to: str | None = None, **options) -> BatchResult:
    """Read ``source`` (CSV or Parquet), apply the recipe, write ``target``.

    The format of each end follows its name: ``.parquet`` is Parquet, anything
    else CSV.  ``rows`` counts what was written.  Columns of codes have their
    tables written beside, see :func:`codes_path`.  ``save_to`` names a folder for
    what the job learnt, which :func:`load_fitted` applies to other tables.
    """
    table = read_table(spark, source)
    if not is_parquet(source):
        # Fitting reads a few columns at a time, many times over: one columnar
        # copy costs less than parsing the text again for every pass.
        table = cut_lineage(table)
    result = transform_table(table, recipe, **options)
    seen = Observation()
    try:
        write_table(result.output.observe(seen, F.count(F.lit(1)).alias("rows")), target)
        for column, codes in result.fitted.tables.items():
            if column in result.output.columns:
                write_table(codes, codes_path(target, column))
        if save_to is not None:
            save_fitted(result.fitted, spark, save_to)
        result.rows = seen.get["rows"]  # counted while writing, not by another read
    finally:
        result.fitted.release()
    return result
