"""Calendar parts of a date column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import TIMES, col, is_numeric, number_of, type_of
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform, as_flag

# The date layouts tried, most specific meaning first, with the
# shape a text must have before it is worth parsing.
LAYOUTS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d H:m:s[.SSSSSS][.SSS]": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$",
    "yyyy-M-d'T'H:m:s[.SSSSSS][.SSS]": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$",
    "yyyy-M-d H:m": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s[.SSSSSS][.SSS]XXX": r"^\d{4}-\d{1,2}-\d{1,2}T[\d:.]+(Z|[+-]\d{2}:\d{2})$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy/M/d H:m:s": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]+ \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]+ \d{1,2}, \d{4}$",
    "yyyy-M": r"^\d{4}-\d{1,2}$",
    "yyyy-M-d h:m:s a": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2} [AP]M$",
    "yyyy-M-d H:m:s[.SSSSSS][.SSS]XXX": r"^\d{4}-\d{1,2}-\d{1,2} [\d:.]+(Z|[+-]\d{2}:\d{2})$",
    "M/d/yyyy H:m": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$",
    "M/d/yyyy h:m:s a": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2} [AP]M$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "M/d/yy H:m": r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{1,2}$",
    "d/M/yyyy H:m": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$",
    "d/M/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d-MMM-yy": r"^\d{1,2}-[A-Za-z]{3}-\d{2}$",
    "d MMM yyyy H:m:s": r"^([A-Za-z]{3}, )?\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
}
FORMATS = tuple(LAYOUTS)
#: Layouts of the same shape that read the first two numbers the other way round.
TWINS = {a: b for a, b in ((x, x.replace("M", "#", 1).replace("d", "M", 1).replace("#", "d", 1)) for x in FORMATS) if a[0] == "M" and b in FORMATS}
LONGEST = 40  # characters; no layout fits a longer text
START = r"^([A-Za-z]+,? )?[0-9]"  # how every text that a layout fits begins
FIRST_TWO = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]"


def read(text: Column, layout: str) -> Column:
    """The trimmed ``text`` as a timestamp; NULL where it does not fit."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, ", "")  # the day of the week says nothing new
    return F.when(text.rlike(LAYOUTS[layout]), F.try_to_timestamp(bare, F.lit(layout)))


def find_layout(df: DataFrame, column: str) -> str | None:
    """The layout that parses most values (the first listed of equal ones), None when none parses any.

    One pass counts the *shapes* of the texts, digits as zeros, with map-side
    combine.  Shapes that the same layouts fit come together, so a few rows reach
    the driver: the largest first number and examples.  That decides a column that
    one layout fits, or two that differ in the order of day and month while no
    first number is above 12.  Otherwise one more pass parses the layouts left.
    """
    text = F.trim(col(column))
    dated = df.select(F.when((F.length(text) <= LONGEST) & text.rlike(START), text).alias("t")).where("t is not null")
    number = lambda k: F.when(F.col("t").rlike(FIRST_TWO), F.regexp_extract("t", FIRST_TWO, k).cast("int"))
    examples = {"x": F.max_by("t", F.col("f")), "y": F.max_by("t", F.col("s")), "z": F.min("t")}
    shaped = dated.select("t", F.translate("t", "123456789", "000000000").alias("shape"), number(1).alias("f"), number(2).alias("s"))
    shapes = shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"), F.max("s").alias("s"), *[e.alias(n) for n, e in examples.items()])
    fits = F.array_compact(F.array(*[F.when(F.col("shape").rlike(LAYOUTS[x]), F.lit(i)) for i, x in enumerate(FORMATS)]))
    fits = F.when(F.col("n") > 0, fits)  # always so, but keeps the test of the layouts above the count of the shapes
    alike = shapes.withColumn("fits", fits).where(F.size("fits") > 0).groupBy("fits")
    again = [F.max_by("x", "f").alias("x"), F.max_by("y", "s").alias("y"), F.min("z").alias("z")]
    found = alike.agg(F.max("f").alias("f"), *again).collect()
    left = sorted({i for g in found for i in g["fits"]})
    if not left:
        return None
    if len(found) == 1:
        (group,), one = found, FORMATS[left[0]]
        texts = df.sparkSession.createDataFrame([(group[e],) for e in examples], "t string")
        read_any = not texts.where(read(F.col("t"), one).isNotNull()).isEmpty()
        twin = len(left) == 2 and TWINS.get(one) == FORMATS[left[1]] and group["f"] is not None and group["f"] <= 12
        if read_any and (len(left) == 1 or twin):  # what the twin reads, this one reads too
            return one
    counts = df.agg(*[F.count(read(text, FORMATS[i])).alias(f"f{i}") for i in left]).first()
    most = max(counts)
    return FORMATS[left[list(counts).index(most)]] if most else None


def parse(df: DataFrame, column: str, layout: str | None) -> Column:
    """The column as a timestamp; text that does not fit ``layout`` is NULL."""
    data_type = type_of(df, column)
    if isinstance(data_type, TIMES):
        return col(column).cast("timestamp")
    if is_numeric(data_type):  # nanoseconds since the epoch
        return F.timestamp_micros(F.floor(number_of(df, column) / 1000).cast("long"))
    if not isinstance(data_type, T.StringType) or layout is None:
        return F.lit(None).cast("timestamp")
    return read(F.trim(col(column)), layout)


def extract_date_parts(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Adds year, month, day and day of week (Monday = 0); the column becomes a
    timestamp, or goes when ``drop_original`` is true.

    Text columns have one layout each: the one that parses most values, see
    :func:`find_layout`.  Other layouts in the same column become NULL; a column
    that no layout fits is refused and stays as it is.
    """
    drop = as_flag(params.get("drop_original"))
    is_text = isinstance(type_of(df, column), T.StringType)

    def learn(table: DataFrame, fit: Fit) -> Transform:
        layout = fit.value("layout", lambda: find_layout(table, column) if is_text else None)
        if is_text and layout is None and not table.where(col(column).isNotNull()).isEmpty():
            raise SkipStep(f"no date layout fits column '{column}'")

        def transform(t: DataFrame) -> DataFrame:
            stamped = t.withColumn(column, parse(t, column, layout))
            when = col(column)
            parts = stamped.withColumns(
                {
                    f"{column}_year": F.year(when),
                    f"{column}_month": F.month(when),
                    f"{column}_day": F.dayofmonth(when),
                    f"{column}_dow": F.weekday(when),
                }
            )
            return parts.drop(col(column)) if drop else parts

        return transform

    added = {f"{column}_{part}" for part in ("year", "month", "day", "dow")}
    return StepPlan(learn, {column}, {column} | added)
