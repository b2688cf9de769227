"""Column access, type tests and text forms.

Throughout the package a floating NaN means "missing", exactly like NULL.  The
helpers here fold NaN into NULL where a value is *used*, so untouched columns
keep their raw form and filters on them still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


def col(name: str) -> Column:
    """A column by its exact name; dots, spaces and back-ticks are literal."""
    return F.col("`" + name.replace("`", "``") + "`")


def tells_case(spark: SparkSession) -> bool:
    """Whether the session tells names apart that differ only in case."""
    return str(spark.conf.get("spark.sql.caseSensitive")).lower() == "true"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers only: booleans, timestamps and text are categorical."""
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def nan_to_null(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def value_of(df: DataFrame, name: str) -> Column:
    """The column with NaN folded into NULL, type unchanged."""
    return nan_to_null(col(name), type_of(df, name))


def number_of(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN folded into NULL."""
    return value_of(df, name).cast("double")


def is_infinite(column: Column) -> Column:
    return F.abs(column) == F.lit(float("inf"))


def fold_nan(df: DataFrame) -> DataFrame:
    """Every floating column with NaN folded into NULL, in one projection."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    return df.withColumns({n: value_of(df, n) for n in floats}) if floats else df


def double_text(column: Column) -> Column:
    """A double as Python prints it: ``1e+16``, ``1e-05``, ``12345678.0``.

    Spark prints the same shortest digits but switches to ``1.0E7`` notation at
    other magnitudes, so only those values are re-assembled from digits.
    """
    plain = column.cast("string")
    parts = F.split(F.abs(column).cast("string"), "E")
    digits = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), "(?<=.)0+$", "")
    power = F.try_element_at(parts, F.lit(2)).cast("int")
    size = F.length(digits)
    sign = F.when(column < 0, "-").otherwise("")
    whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    tail = F.when(size > power + 1, F.substring(digits, power + 2, size)).otherwise("0")
    mantissa = F.when(
        size > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), size))
    ).otherwise(digits)
    exponent = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    return (
        F.when(F.isnan(column), "nan")
        .when(is_infinite(column), F.concat(sign, F.lit("inf")))
        .when(~F.contains(plain, F.lit("E")), plain)
        .when(power.between(0, 15), F.concat(sign, whole, F.lit("."), tail))
        .when(power.between(-4, -1), F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .otherwise(F.concat(sign, mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), exponent))
    )


def text_of(df: DataFrame, name: str) -> Column:
    """The text form used for counting and labelling values; NULL stays NULL."""
    data_type = type_of(df, name)
    if isinstance(data_type, T.StringType):
        return col(name)
    if isinstance(data_type, T.BooleanType):
        return F.initcap(col(name).cast("string"))
    if isinstance(data_type, FLOATING):
        return double_text(value_of(df, name).cast("double"))
    if isinstance(data_type, TIMES):
        return F.date_format(col(name), TIMESTAMP_TEXT)
    return col(name).cast("string")
