"""What an operation tells the recipe runner about one step."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from sparkprep.functions.columns import is_numeric, type_of
from sparkprep.functions.lookup import Kept


class SkipStep(Exception):
    """The step cannot be applied to this table; the table stays as it is."""


@dataclass
class Fit:
    """Values learnt for one step: shared aggregates, quantiles, own jobs."""

    stats: Mapping[str, Any]
    quantiles: Mapping[float, float | None]
    kept: Kept
    shuffled: bool = False  # the step joins by shuffling the whole table
    tables: dict[str, DataFrame] = field(default_factory=dict)  # by output column: what its codes stand for
    values: dict[str, Any] = field(default_factory=dict)  # found by own jobs
    learnt: dict[str, DataFrame] = field(default_factory=dict)  # likewise, as tables
    saved: bool = False  # values and tables come from a saved recipe: nothing is computed again

    def value(self, name: str, compute: Callable[[], Any]) -> Any:
        """What ``compute`` finds, or found when the recipe was fitted."""
        if not self.saved:
            self.values[name] = compute()
        return self.values[name]

    def table(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The same for a table."""
        if not self.saved:
            self.learnt[name] = compute()
        return self.learnt[name]


Transform = Callable[[DataFrame], DataFrame]


@dataclass
class StepPlan:
    """One step, ready to fit.

    ``stats`` and ``quantiles`` are gathered for many steps in one pass over the
    table; ``learn`` may run further jobs on the table the step sees and returns
    the lazy transform.  ``reads`` and ``writes`` let the runner decide which
    steps may share a pass; ``whole_row`` steps read every column.
    """

    learn: Callable[[DataFrame, Fit], Transform]
    reads: set[str]
    writes: set[str] = field(default_factory=set)
    stats: dict[str, Column] = field(default_factory=dict)
    quantile_column: Column | None = None
    quantiles: tuple[float, ...] = ()
    removes_rows: bool = False
    whole_row: bool = False
    shuffles_table: bool = False


def simple(transform: Transform, reads: set[str], writes: set[str], **options: Any) -> StepPlan:
    """A step that learns nothing."""
    return StepPlan(lambda df, fit: transform, reads, writes, **options)


def require_numeric(df: DataFrame, column: str) -> None:
    if not is_numeric(type_of(df, column)):
        raise SkipStep(f"column '{column}' is not numeric")


def as_flag(value: Any) -> bool:
    return str(value).strip().lower() == "true"
