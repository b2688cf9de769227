"""The catalogue of operations: what each is called and which parameters it takes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkprep.operators import cleaning, dates, encoding, imputation, knn, numeric, scaling
from sparkprep.operators.base import StepPlan
from sparkprep.operators.boxcox import box_cox_transform

CLEAN, SHAPE, ENCODE = 0, 1, 2  # phases of the batch job

PHASES = {"Cleaning": CLEAN, "Imputation": CLEAN, "Dates": SHAPE, "Math": SHAPE, "Scaling": SHAPE, "Encoding": ENCODE}


@dataclass(frozen=True)
class Param:
    name: str
    type: str  # column_select, number, text or select
    label: str
    options: tuple[str, ...] = ()
    default: Any = None


@dataclass(frozen=True)
class Operation:
    id: str
    label: str
    category: str
    plan: Callable[[DataFrame, str, dict[str, Any]], StepPlan]
    params: tuple[Param, ...] = ()
    needs_column: bool = True

    @property
    def phase(self) -> int:
        return PHASES[self.category]


def _column(label: str = "Column", name: str = "col") -> Param:
    return Param(name, "column_select", label)


# Identifiers, labels, categories, choices and defaults of the 24 operations.
_OPERATIONS = (
    Operation("drop_column", "Drop Column", "Cleaning", cleaning.drop_column, (_column("Column to Drop"),)),
    Operation("drop_duplicates", "Drop Duplicates", "Cleaning", cleaning.drop_duplicates, needs_column=False),
    Operation(
        "drop_outliers_zscore",
        "Drop Outliers (Z-Score)",
        "Cleaning",
        cleaning.drop_outliers_zscore,
        (_column(), Param("threshold", "number", "Threshold (std dev)", default=3)),
    ),
    Operation(
        "drop_outliers_manual",
        "Drop Outliers (Manual)",
        "Cleaning",
        cleaning.drop_outliers_manual,
        (_column(), Param("value", "number", "Cutoff Value (<)")),
    ),
    Operation("fill_na_mean", "Fill Missing (Mean)", "Imputation", imputation.fill_na_mean, (_column(),)),
    Operation("fill_na_median", "Fill Missing (Median)", "Imputation", imputation.fill_na_median, (_column(),)),
    Operation("fill_na_mode", "Fill Missing (Mode)", "Imputation", imputation.fill_na_mode, (_column(),)),
    Operation(
        "fill_na_const",
        "Fill Missing (Constant)",
        "Imputation",
        imputation.fill_na_const,
        (_column(), Param("value", "text", "Value to Fill", default=0)),
    ),
    Operation("fill_na_knn", "Fill Missing (KNN)", "Imputation", knn.fill_na_knn, (_column(),)),
    Operation(
        "fill_na_groupby",
        "Impute by Group (Advanced)",
        "Imputation",
        imputation.fill_na_groupby,
        (
            _column("Target Column"),
            _column("Group By", "group_col"),
            Param("strategy", "select", "Method", ("mean", "median", "mode"), "median"),
        ),
    ),
    Operation(
        "extract_date_parts",
        "Extract Date Parts",
        "Dates",
        dates.extract_date_parts,
        (_column("Date Column"), Param("drop_original", "select", "Drop Original?", ("True", "False"), "True")),
    ),
    Operation(
        "bin_numeric",
        "Binning / Discretization",
        "Math",
        numeric.bin_numeric,
        (
            _column(),
            Param("bins", "number", "Number of Bins", default=5),
            Param("strategy", "select", "Strategy", ("quantile", "uniform"), "quantile"),
            Param("labels", "select", "Use Labels?", ("False", "True"), "False"),
        ),
    ),
    Operation("log_transform", "Log Transform (Log1p)", "Math", numeric.log_transform, (_column(),)),
    Operation(
        "box_cox_transform",
        "Box-Cox Transform",
        "Math",
        box_cox_transform,
        (_column(), Param("threshold", "number", "Skew Threshold", default=0.5)),
    ),
    Operation(
        "create_interaction",
        "Feature Interaction",
        "Math",
        numeric.create_interaction,
        (
            _column("Column A", "col1"),
            Param("math_op", "select", "Operator", ("+", "-", "*", "/")),
            _column("Column B", "col2"),
            Param("new_name", "text", "New Column Name"),
        ),
        needs_column=False,
    ),
    Operation(
        "polynomial_features",
        "Polynomial Features",
        "Math",
        numeric.polynomial_features,
        (_column(), Param("degree", "number", "Degree", default=2)),
    ),
    Operation("standard_scaler", "Standard Scaler (Z-Score)", "Scaling", scaling.standard_scaler, (_column(),)),
    Operation("minmax_scaler", "MinMax Scaler (0-1)", "Scaling", scaling.minmax_scaler, (_column(),)),
    Operation("robust_scaler", "Robust Scaler (Outliers)", "Scaling", scaling.robust_scaler, (_column(),)),
    Operation("maxabs_scaler", "MaxAbs Scaler", "Scaling", scaling.maxabs_scaler, (_column(),)),
    Operation("one_hot_encode", "One-Hot Encoding", "Encoding", encoding.one_hot_encode, (_column(),)),
    Operation("label_encode", "Label Encoding", "Encoding", encoding.label_encode, (_column(),)),
    Operation("ordinal_encode", "Ordinal Encoding", "Encoding", encoding.ordinal_encode, (_column(),)),
    Operation(
        "target_encode",
        "Target Encoding",
        "Encoding",
        encoding.target_encode,
        (_column("Categorical Column"), _column("Target Variable (e.g. SalePrice)", "target_col")),
    ),
)

OPERATIONS: dict[str, Operation] = {op.id: op for op in _OPERATIONS}


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per operation; ``params`` is an array of structs."""
    rows = [
        (
            op.id,
            op.label,
            op.category,
            [
                (p.name, p.type, p.label, list(p.options), None if p.default is None else json.dumps(p.default))
                for p in op.params
            ],
        )
        for op in _OPERATIONS
    ]
    param = "struct<name:string,type:string,label:string,options:array<string>,default:string>"
    return spark.createDataFrame(rows, f"id string, label string, category string, params array<{param}>")
