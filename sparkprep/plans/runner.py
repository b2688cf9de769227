"""Fitting and applying recipes.

Steps run in order, each seeing the output of the one before.  Neighbouring
steps that neither remove rows nor touch what another one in the batch writes
learn their values from one shared pass over the table; their transforms are
lazy projections and lookup joins that Catalyst collapses into the next scan.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkprep.functions.lookup import Kept
from sparkprep.functions.quantiles import Quantiles
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform
from sparkprep.plans.catalogue import OPERATIONS
from sparkprep.plans.recipe import Recipe, Step
from sparkprep.session import cut_lineage

APPLIED, SKIPPED, UNKNOWN, FAILED = "applied", "skipped", "unknown_operation", "failed"


#: What says that a step's definition does not fit the table.  Anything else (a
#: failed task, a lost executor, a missing file) is no property of the step and
#: is never skipped.
DEFINITION_ERRORS = (SkipStep, AnalysisException, ValueError, TypeError, KeyError)


class RecipeError(Exception):
    """A step could not be applied and the recipe runs with ``on_error='raise'``."""


@dataclass
class StepResult:
    step: Step
    status: str
    reason: str = ""


@dataclass
class FittedRecipe:
    """The learnt transforms of one recipe, applicable to any like table."""

    transforms: list[Transform]
    results: list[StepResult]
    output: DataFrame  # the fitting table, transformed (lazy)
    passes: int  # shared fitting passes over the table
    kept: Kept = field(default_factory=Kept)
    learnt: list[tuple[Step, Fit]] = field(default_factory=list)  # applied steps and what they found
    schema: T.StructType | None = None  # of the fitting table
    tables: dict[str, DataFrame] = field(default_factory=dict)  # by output column: ``(code, column, value, rows)``

    def transform(self, df: DataFrame) -> DataFrame:
        for apply in self.transforms:
            df = apply(df)
        return df

    def report(self, spark: SparkSession) -> DataFrame:
        rows = [(r.step.id, r.step.operation, r.step.target, r.status, r.reason) for r in self.results]
        return spark.createDataFrame(
            rows, "step_id string, operation string, column string, status string, reason string"
        )

    def release(self) -> None:
        """Free the persisted lookup tables; lazy results stay valid."""
        self.kept.release()


@dataclass
class _Pending:
    result: StepResult
    plan: StepPlan


class _Fitting:
    def __init__(self, df: DataFrame, on_error: str, fuse: bool):
        self.df = df
        self.on_error = on_error
        self.fuse = fuse
        self.kept = Kept()
        self.transforms: list[Transform] = []
        self.results: list[StepResult] = []
        self.batch: list[_Pending] = []
        self.written: set[str] = set()
        self.passes = 0
        self.tables: dict[str, DataFrame] = {}
        self.learnt: list[tuple[Step, Fit]] = []
        self.schema = df.schema
        self.uncut = False  # the frame carries a whole-table shuffle worth keeping

    def add(self, step: Step) -> None:
        result = StepResult(step, APPLIED)
        self.results.append(result)
        operation = OPERATIONS.get(step.operation)
        if operation is None:
            self._fail(result, UNKNOWN, f"unknown operation '{step.operation}'")
            return
        params = {k: v for k, v in (step.params or {}).items()}
        touched = {step.target, *(v for v in params.values() if isinstance(v, str))}
        if touched & self.written:
            self.flush()
        try:
            if operation.needs_column and step.target not in self.df.columns:
                raise SkipStep(f"column '{step.target}' not found")
            plan = operation.plan(self.df, step.target, params)
            if self.batch and (plan.whole_row or not self.fuse):
                self.flush()
                plan = operation.plan(self.df, step.target, params)
        except DEFINITION_ERRORS as error:  # every step is atomic: report it and go on
            self._fail(result, SKIPPED if isinstance(error, SkipStep) else FAILED, str(error))
            return
        self.batch.append(_Pending(result, plan))
        self.written |= plan.writes
        if plan.removes_rows or plan.whole_row or not self.fuse:
            self.flush()

    def _fail(self, result: StepResult, status: str, reason: str) -> None:
        result.status, result.reason = status, reason
        if self.on_error == "raise":
            self.kept.release()
            raise RecipeError(f"step {result.step.id} ({result.step.operation}): {reason}")

    def flush(self) -> None:
        batch, self.batch, self.written = self.batch, [], set()
        if not batch:
            return
        if self.uncut and any(p.plan.stats or p.plan.quantiles or p.plan.whole_row for p in batch):
            self.df, self.uncut = cut_lineage(self.df), False
        try:
            fits = self._gather([p.plan for p in batch])
        except DEFINITION_ERRORS:
            if len(batch) == 1:
                fits = [None]
            else:  # find the step that breaks the shared pass
                fits = [self._gather_alone(p) for p in batch]
        source = self.df
        for pending, fit in zip(batch, fits):
            try:
                if fit is None:
                    fit = self._gather([pending.plan])[0]
                transform = pending.plan.learn(source, fit)
                changed = transform(self.df)
            except DEFINITION_ERRORS as error:
                self._fail(pending.result, SKIPPED if isinstance(error, SkipStep) else FAILED, str(error))
                continue
            self.df = changed
            self.transforms.append(transform)
            self.tables |= fit.tables
            self.learnt.append((pending.result.step, fit))
            self.uncut = self.uncut or pending.plan.shuffles_table or fit.shuffled

    def _gather_alone(self, pending: _Pending) -> Fit | None:
        try:
            return self._gather([pending.plan])[0]
        except DEFINITION_ERRORS:
            return None

    def _gather(self, plans: list[StepPlan]) -> list[Fit]:
        """One aggregate pass for all plans, then the exact quantiles."""
        aggs = [c.alias(f"s{i}_{name}") for i, p in enumerate(plans) for name, c in p.stats.items()]
        wanted = {str(i): p for i, p in enumerate(plans) if p.quantiles}
        search = Quantiles(
            {i: p.quantile_column for i, p in wanted.items()}, {i: list(p.quantiles) for i, p in wanted.items()}
        )
        found: dict[str, dict[float, Any]] = {}
        row = None
        if aggs or wanted:
            self.passes += 1
            row = self.df.agg(*aggs, *search.counts()).first()
            found = search.resolve(self.df, row)
        return [
            Fit({name: row[f"s{i}_{name}"] for name in p.stats}, found.get(str(i), {}), self.kept)
            for i, p in enumerate(plans)
        ]


def fit_recipe(
    df: DataFrame, recipe: Recipe, mode: str = "strict", on_error: str = "skip", fuse: bool = True
) -> FittedRecipe:
    """Learn every step of ``recipe`` on ``df``.

    ``mode='strict'`` keeps the written order; ``'phased'`` first sorts steps
    into cleaning and filling, then features, then encoding, which can change
    the result.  ``on_error='skip'`` reports a failing step and goes on.
    """
    if mode not in ("strict", "phased"):
        raise ValueError(f"unknown mode '{mode}'")
    if on_error not in ("skip", "raise"):
        raise ValueError(f"unknown on_error '{on_error}'")
    steps = list(recipe.steps)
    if mode == "phased":
        steps.sort(key=lambda s: OPERATIONS[s.operation].phase if s.operation in OPERATIONS else 0)
    fitting = _Fitting(df, on_error, fuse)
    try:
        for step in steps:
            fitting.add(step)
        fitting.flush()
    except Exception:
        fitting.kept.release()
        raise
    return FittedRecipe(fitting.transforms, fitting.results, fitting.df, fitting.passes, fitting.kept, fitting.learnt, fitting.schema, fitting.tables)


def apply_recipe(df: DataFrame, recipe: Recipe, **options: Any) -> DataFrame:
    """The transformed table; see :func:`fit_recipe` for the options and for the
    full report.  Steps that were not applied are named in a warning."""
    fitted = fit_recipe(df, recipe, **options)
    left_out = [f"{r.step.operation} ({r.status}: {r.reason})" for r in fitted.results if r.status != APPLIED]
    if left_out:
        warnings.warn("steps not applied: " + "; ".join(left_out), stacklevel=2)
    return fitted.output
