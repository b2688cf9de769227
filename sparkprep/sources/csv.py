"""CSV with the null tokens, type inference and header rules of pandas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import TIMES, TIMESTAMP_TEXT, col, tells_case
from sparkprep.sources.multiline import read_records, splittable

# Texts read as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Texts read as flags.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

WHOLE = r"^\s*[+-]?\d+\s*$"
REAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITE = r"^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"

_BAD = "__bad_record"


class NotACsv(ValueError):
    """The input is not a valid CSV table."""


def header_names(raw: Sequence[str | None], exact: bool = False) -> list[str]:
    """Column names from header cells: empty cells are numbered, repeats suffixed.
    Names that differ only in case count as repeats, unless the session tells them
    apart (``exact``)."""
    fold = str if exact else str.lower
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    given = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(raw)]
    out = []
    for name in given:
        unique = name
        while fold(unique) in taken:
            repeats[name] = repeats.get(name, 0) + 1
            unique = f"{name}.{repeats[name]}"
        taken.add(fold(unique))
        out.append(unique)
    return out


def _check_name(path: str) -> None:
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in last and not last.lower().endswith(".csv") and "*" not in last:
        raise NotACsv(f"not a .csv path: {path}")


def _has_multiline_fields(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field spans lines: then some line has an odd number of
    quotes.  Only such files need their records found first."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


_TEXT_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _options(multiline: bool) -> dict[str, object]:
    return {**_TEXT_OPTIONS, "multiLine": multiline, "enforceSchema": True}


def read_csv(
    spark: SparkSession,
    path: str,
    multiline: bool | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A CSV file or folder of them, typed as pandas would type it.

    Columns come as long, double, boolean or string; missing tokens are NULL.
    ``multiline=None`` looks for fields that span lines; files with such fields
    are cut into records block by block (:mod:`sparkprep.sources.multiline`).
    ``schema`` skips the type inference pass.
    """
    _check_name(path)
    try:
        if multiline is None:
            multiline = _has_multiline_fields(spark, path)
        head = spark.read.options(**_options(multiline)).csv(path, header=False).first()
    except Exception as error:
        raise NotACsv(f"cannot read {path}: {error}") from error
    if head is None:
        raise NotACsv(f"{path} is empty")
    names = header_names(list(head), tells_case(spark))
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(_BAD, T.StringType())])
    values = {n: F.when(~col(n).isin(*NULL_TOKENS), col(n)) for n in names}
    if multiline and splittable(spark, path):
        records = read_records(spark, path)
        parse = lambda shape, **more: records.select(F.from_csv("record", shape.toDDL(), {**_TEXT_OPTIONS, **more}).alias("r")).select("r.*")
    else:
        parse = lambda shape, **more: spark.read.options(**_options(multiline), **more).schema(shape).csv(path, header=True)
    types = {f.name: f.dataType for f in schema.fields} if schema else _infer(parse(texts, columnNameOfCorruptRecord=_BAD), names, values, path)
    clean = parse(T.StructType(texts.fields[:-1]))
    return clean.select(*[_typed(values[n], types[n]).alias(n) for n in names])


def _infer(raw: DataFrame, names: list[str], values: dict[str, Column], path: str) -> dict[str, T.DataType]:
    """One pass over the text: how many values of each column fit each type."""
    outside = F.regexp_replace(F.col(_BAD), '"[^"]*"', "")
    fields = F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1
    aggs = [F.count_if(F.col(_BAD).isNotNull() & (fields > len(names))).alias("bad")]
    for i, n in enumerate(names):
        v = values[n]
        whole = v.rlike(WHOLE) & v.try_cast("bigint").isNotNull()
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.lit(1)).alias("rows") if i == 0 else F.lit(None).alias(f"_{i}"),
            F.count_if(whole).alias(f"long{i}"),
            F.count_if(v.rlike(REAL) | v.rlike(INFINITE)).alias(f"double{i}"),
            F.count_if(v.isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"flag{i}"),
        ]
    row = raw.agg(*aggs).first()
    if row["bad"]:
        raise NotACsv(f"{path}: {row['bad']} records have more fields than the header")
    out: dict[str, T.DataType] = {}
    for i, n in enumerate(names):
        known = row[f"n{i}"]
        if row[f"long{i}"] == known and known:
            out[n] = T.LongType()
        elif row[f"double{i}"] == known:  # also a column without any value
            out[n] = T.DoubleType()
        elif row[f"flag{i}"] == known == row["rows"]:
            out[n] = T.BooleanType()
        else:
            out[n] = T.StringType()
    return out


def _typed(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DoubleType):
        infinite = F.when(F.contains(value, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        return F.when(value.rlike(INFINITE), infinite).otherwise(F.trim(value).try_cast("double"))
    if isinstance(data_type, T.BooleanType):
        return F.when(value.isNotNull(), value.isin(*TRUE_TOKENS))
    return F.trim(value).try_cast(data_type) if not isinstance(data_type, T.StringType) else value


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header; flags as ``True``/``False``, times as
    ``yyyy-MM-dd HH:mm:ss``, arrays with spaces between, missing as an empty field."""

    def text(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.BooleanType):
            return F.initcap(col(field.name).cast("string")).alias(field.name)
        if isinstance(field.dataType, TIMES):
            return F.date_format(col(field.name), TIMESTAMP_TEXT).alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(col(field.name).cast("array<string>"), " ").alias(field.name)
        return col(field.name)

    out = df.select(*[text(f) for f in df.schema.fields])
    out.write.mode("errorifexists").options(header=True, quote='"', escape='"').csv(path)
