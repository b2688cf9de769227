"""Fitted recipes on disk: what each step learnt, as JSON and Parquet.

A saved recipe keeps no code and no rows but those a step needs (codes, group
statistics, the donors of the nearest-neighbour fill).  Loading builds the same
transforms from it without reading any other table.
"""

from __future__ import annotations

import datetime
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.lookup import Kept
from sparkprep.operators.base import Fit
from sparkprep.operators.encoding import learn_dummies
from sparkprep.plans.catalogue import OPERATIONS
from sparkprep.plans.recipe import Step
from sparkprep.plans.runner import FittedRecipe, StepResult

AUTO_DUMMIES = "auto_dummies"  # the batch job's last step, no operation of a recipe
VERSION = 1
_KINDS = {"datetime": datetime.datetime, "date": datetime.date}


def _encoded(value: Any) -> Any:
    """A plain value as JSON; times and decimals with their kind."""
    if isinstance(value, datetime.datetime):
        return {"datetime": value.isoformat()}
    if isinstance(value, datetime.date):
        return {"date": value.isoformat()}
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    return value


def _decoded(value: Any) -> Any:
    if isinstance(value, dict):
        (kind, text), *_ = value.items()
        return Decimal(text) if kind == "decimal" else _KINDS[kind].fromisoformat(text)
    return value


def save_fitted(fitted: FittedRecipe, spark: SparkSession, path: str) -> None:
    """Write ``fitted`` to the new folder ``path``: ``recipe`` holds one line of JSON, ``tables`` the learnt tables."""
    steps = []
    for place, (step, fit) in enumerate(fitted.learnt):
        for name, table in fit.learnt.items():
            table.write.mode("errorifexists").parquet(f"{path}/tables/{place}-{name}")
        steps.append(
            {
                "id": step.id,
                "operation": step.operation,
                "column": step.column,
                "params": dict(step.params or {}),
                "stats": {k: _encoded(v) for k, v in fit.stats.items()},
                "quantiles": [[q, v] for q, v in fit.quantiles.items()],
                "values": {k: _encoded(v) for k, v in fit.values.items()},
                "tables": sorted(fit.learnt),
            }
        )
    results = [[r.step.id, r.step.operation, r.step.column, dict(r.step.params or {}), r.status, r.reason] for r in fitted.results]
    text = json.dumps({"version": VERSION, "schema": fitted.schema.jsonValue(), "steps": steps, "results": results})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/recipe")


def load_fitted(spark: SparkSession, path: str) -> FittedRecipe:
    """The recipe saved in ``path``, ready to transform tables like the one it was fitted on.

    Its ``output`` is an empty table with the columns of a result.  A missing
    column or another kind of column in a new table shows up when it is transformed.
    """
    saved = json.loads(spark.read.text(f"{path}/recipe").first()[0])
    if saved["version"] != VERSION:
        raise ValueError(f"unknown version {saved['version']} of a saved recipe")
    schema = T.StructType.fromJson(saved["schema"])
    table, kept = spark.createDataFrame([], schema), Kept()
    transforms, learnt, codes = [], [], {}
    for place, s in enumerate(saved["steps"]):
        step = Step(s["id"], s["operation"], s["column"], s["params"])
        frames = {name: spark.read.parquet(f"{path}/tables/{place}-{name}") for name in s["tables"]}
        stats = {k: _decoded(v) for k, v in s["stats"].items()}
        fit = Fit(stats, {q: v for q, v in s["quantiles"]}, kept, values={k: _decoded(v) for k, v in s["values"].items()}, learnt=frames, saved=True)
        if step.operation == AUTO_DUMMIES:
            names = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
            transform = learn_dummies(table, names, fit, "dummy_codes", False, step.params["form"], step.params["max_columns"]) if names else lambda t: t
        else:
            transform = OPERATIONS[step.operation].plan(table, step.target, dict(step.params)).learn(table, fit)
        table = transform(table).where(F.lit(False))
        transforms.append(transform)
        learnt.append((step, fit))
        codes |= fit.tables
    results = [StepResult(Step(i, operation, column, params), status, reason) for i, operation, column, params, status, reason in saved["results"]]
    return FittedRecipe(transforms, results, table, 0, kept, learnt, schema, codes)
