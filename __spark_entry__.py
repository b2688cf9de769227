"""Registered queries over the given tables and their SQL equivalents.

The given tables hold no missing values and no duplicate rows, so most steps
would have nothing to do on them.  ``VIEWS`` derives inputs with gaps from the
whole tables; the same SQL text feeds Spark and the oracle.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sparkprep as sp
from sparkprep.operators import boxcox
from sparkprep.plans.batch import transform_table
from sparkprep.plans.preview import head_sample
from sparkprep.session import required_folder, tune
from sparkprep.sources.csv import read_csv, write_csv

try:  # these folders may be taken out
    import corpus_pipeline
    from sparkprep.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "sparkprep.llm"):
        raise
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"

# name -> (source table, SQL over it).  Gaps are injected, no row is left out.
VIEWS = {
    "part_n": (
        "part",
        "select p_partkey, p_brand, case when p_partkey % 11 = 0 then null else p_type end as p_type, "
        "case when p_partkey % 7 = 0 then null else cast(p_size as double) end as p_size, "
        "case when p_partkey % 13 = 0 then null else p_retailprice end as p_retailprice from {source}",
    ),
    "part_g": (
        "part",
        "select p_partkey, case when p_partkey % 19 = 0 then null else p_brand end as p_brand, "
        "case when p_brand = 'Brand#1' or p_partkey % 7 = 0 then null else cast(p_size as double) end as p_size "
        "from {source}",
    ),
    "part_k": (
        "part",
        "select p_partkey, case when p_partkey % 7 = 0 then null else cast(p_size as double) end as p_size, "
        "case when p_partkey % 13 = 0 then null else p_retailprice end as p_retailprice, "
        "case when p_partkey % 5 = 0 then null else p_partkey % 37 * 10.0 end as a, "
        "case when p_partkey % 3 = 0 then null else p_partkey % 101 * 3.0 end as b, "
        "case when p_partkey % 11 = 0 then null else p_partkey % 17 * 25.0 end as c from {source}",
    ),
    "orders_s": (
        "orders",
        "select o_orderkey, case when o_orderkey % 17 = 0 then 'not-a-date' "
        "else cast(cast(o_orderdate as date) as string) end as o_date from {source}",
    ),
    "orders_us": (
        "orders",
        "select o_orderkey, cast(month(o_orderdate) as string) || '/' || cast(day(o_orderdate) as string) || '/' || "
        "cast(year(o_orderdate) as string) || ' 8:26' as o_date from {source}",
    ),
    "docs_l": ("documents", "select doc_id, '\"Text\", ' || replace(text, '. ', '.' || chr(10)) as text, lang, n_chars from {source}"),
    "items_b": ("lineitem", "select l_extendedprice, l_quantity > 25 as l_big from {source}"),
    "odd": (
        "lineitem",
        "select l_orderkey, l_linenumber, case l_linenumber when 1 then cast('NaN' as double) when 2 then cast('Infinity' as double) "
        "when 3 then cast('-Infinity' as double) when 4 then null else l_tax end as l_tax from {source}",
    ),
    "flags": ("orders", "select o_orderdate, o_totalprice > 200000 as o_large, o_totalprice from {source}"),
    "names": ("customer", "select c_custkey, c_name from {source}"),
    "items_d": ("lineitem", "select l_returnflag, l_linestatus, l_quantity from {source}"),
}

BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in VIEWS:
        source, sql = VIEWS[name]
        return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places without negative zero, integers as long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


Query = Callable[[SparkSession, str], DataFrame]


def query(source: str, body: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return tidy(body(table(spark, sf_dir, source)))

    return run


def steps(source: str, *recipe: tuple, keep: list[str] | None = None, **options) -> Query:
    """A recipe on one table; ``keep`` narrows the input columns first."""

    def body(df: DataFrame) -> DataFrame:
        df = df.select(*keep) if keep else df
        return sp.apply_recipe(df, sp.Recipe.of(*recipe), **options)

    return query(source, body)


def interaction(sign: str) -> Query:
    params = {"col1": "l_extendedprice", "math_op": sign, "col2": "l_discount", "new_name": "mix"}
    return steps("lineitem", ("create_interaction", "", params), keep=["l_extendedprice", "l_discount"])


NUMERIC_STATS = ["name", "type", "missing", "missing_pct", "mean", "median", "std_dev", "min", "max"]
CATEGORICAL_STATS = ["name", "unique", "top_value", "freq"]
FLAGS = ["name", "valid_pct", "high_missing", "warn_missing", "has_missing", "truncated"]


def numeric_profile(df: DataFrame) -> DataFrame:
    return sp.profile(df).select("Numeric").select(*NUMERIC_STATS, "unique")


def bars_of(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: sp.profile(df.select(column)).distributions()


def in_files(df: DataFrame, key: str, end: str = ".parquet") -> DataFrame:
    """The table in several files whose rows follow ``key``, read without it."""
    folder = folder_for(df, "files") + end
    sp.write_table(df.repartitionByRange(8, key).sortWithinPartitions(key), folder)
    return sp.read_table(df.sparkSession, folder)


def numbered(end: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: sp.with_row_numbers(in_files(df, "o_orderkey", end)).select("o_orderkey", "o_custkey", "row")


def first_of_each(df: DataFrame) -> DataFrame:
    """Duplicate rows dropped so that the first one in the files stays, by its row number."""
    rows = sp.with_row_numbers(in_files(df, "o_orderkey")).select("o_orderstatus", "o_orderpriority", "o_custkey", "row")
    return sp.apply_recipe(rows, sp.Recipe.of(("drop_duplicates", "", {"position": "row"})))


def csv_round_trip(df: DataFrame) -> DataFrame:
    folder = f"{required_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    write_csv(df, folder)
    return read_csv(df.sparkSession, folder)


def folder_for(df: DataFrame, name: str) -> str:
    return f"{required_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def batch(target: str, result: str = "rows") -> Callable[[DataFrame], DataFrame]:
    """The table written as CSV, taken through the batch job into ``target``; what was written, or the job's summary."""

    def run(df: DataFrame) -> DataFrame:
        source, out = f"{folder_for(df, 'in')}.csv", folder_for(df, "out") + target
        write_csv(df, source)
        done = sp.run_batch(df.sparkSession, source, sp.Recipe.of(*PHASED), out)
        if result == "summary":
            return done.summary(df.sparkSession).select("steps", F.array_join("applied", ",").alias("applied"), "rows", "columns")
        return sp.read_table(df.sparkSession, out)

    return run


def sample_round_trip(df: DataFrame) -> DataFrame:
    folder = folder_for(df, "sample") + ".csv"
    sp.write_sample(df, folder, order_by=["o_orderkey"])
    return read_csv(df.sparkSession, folder)


def saved_and_loaded(df: DataFrame) -> DataFrame:
    """The table under a recipe that was fitted on it, saved, and loaded again."""
    folder = folder_for(df, "fitted")
    fitted = sp.fit_recipe(df, sp.Recipe.of(*STRICT))
    sp.save_fitted(fitted, df.sparkSession, folder)
    fitted.release()
    return sp.load_fitted(df.sparkSession, folder).transform(df)


def saved_batch(df: DataFrame) -> DataFrame:
    """The same for the batch job, its dummy columns included."""
    source, folder = f"{folder_for(df, 'in')}.parquet", folder_for(df, "fitted")
    sp.write_table(df, source)
    sp.run_batch(df.sparkSession, source, sp.Recipe.of(*PHASED), f"{folder_for(df, 'out')}.parquet", save_to=folder)
    return sp.load_fitted(df.sparkSession, folder).transform(df)


def listed(df: DataFrame, codes: str) -> DataFrame:
    """One row per code of a row, and one for a row without."""
    return df.withColumn(codes, F.explode_outer(codes))


def dummy_codes(df: DataFrame) -> DataFrame:
    """What the codes of the remaining text columns stand for."""
    return transform_table(df.select("c_custkey", "c_name", "c_mktsegment"), sp.Recipe([]), form="codes").fitted.tables["dummy_codes"]


BOX_GATE = ("box_cox_transform", "l_extendedprice", {"skew_threshold": 0.5})
KNN = ("fill_na_knn", "p_size")
STRICT = (
    ("fill_na_groupby", "p_type", {"group_col": "p_brand", "strategy": "mode"}),
    ("fill_na_median", "p_size"),
    ("robust_scaler", "p_size"),
    ("fill_na_mean", "p_retailprice"),
    ("drop_outliers_zscore", "p_retailprice", {"threshold": 1.5}),
    ("standard_scaler", "p_retailprice"),
    ("one_hot_encode", "p_type"),
    ("label_encode", "p_brand"),
)
PHASED = (
    ("label_encode", "p_brand"),
    ("minmax_scaler", "p_size"),
    ("fill_na_mean", "p_size"),
    ("drop_outliers_manual", "p_retailprice", {"value": 950}),
)
LENIENT = (
    ("sort_everything", "p_size"),
    ("fill_na_mean", "no_such_column"),
    ("standard_scaler", "p_brand"),
    ("bin_numeric", "p_size", {"labels": "True"}),
    ("fill_na_const", "p_type", {"value": "UNKNOWN", "col": "p_brand"}),
    ("fill_na_const", "p_brand", {"value": "UNKNOWN", "col": "p_type"}),
)
PREVIEW = (
    ("extract_date_parts", "o_orderdate", {"drop_original": "False"}),
    ("minmax_scaler", "o_totalprice"),
    ("label_encode", "o_orderpriority"),
)


def queries() -> dict[str, Query]:
    """One entry per operation and report."""
    return {
        # profile
        "table_stats": query(
            "part_n",
            lambda df: sp.profile(df).table.select("total_rows", "total_cols", "duplicate_rows", "missing_cells"),
        ),
        "table_stats_duplicates": query(
            "items_d", lambda df: sp.profile(df).table.select("total_rows", "duplicate_rows", "clean")
        ),
        "logical_bytes": query("part_n", lambda df: sp.profile(df).table.select("logical_bytes")),
        "profile_numeric": query("part_n", numeric_profile),
        "profile_numeric_lineitem": query("lineitem", numeric_profile),
        "profile_categorical": query("part_n", lambda df: sp.profile(df).select("Categorical").select(*CATEGORICAL_STATS)),
        "profile_documents": query(
            "documents", lambda df: sp.profile(df).select("Categorical").select(*CATEGORICAL_STATS)
        ),
        "profile_histogram": query("part_n", bars_of("p_size")),
        "profile_histogram_lineitem": query("lineitem", bars_of("l_extendedprice")),
        "profile_top20": query("part", bars_of("p_brand")),
        "quality_flags": query("part_n", lambda df: sp.profile(df).columns.select(*FLAGS)),
        "profile_filter": query(
            "part_n", lambda df: sp.profile(df).select("Missing", "P_S").select("name", "type", "missing")
        ),
        # cleaning
        "drop_column": steps("part_n", ("drop_column", "p_brand")),
        "drop_duplicates": steps("items_d", ("drop_duplicates", "")),
        "drop_outliers_zscore": steps("part_n", ("drop_outliers_zscore", "p_size", {"threshold": 1.5})),
        "drop_outliers_manual": steps("part_n", ("drop_outliers_manual", "p_retailprice", {"value": 950})),
        # imputation
        "fill_na_mean": steps("part_n", ("fill_na_mean", "p_size")),
        "fill_na_median": steps("part_n", ("fill_na_median", "p_retailprice")),
        "fill_na_mode": steps("part_n", ("fill_na_mode", "p_type")),
        "fill_na_const": steps("part_n", ("fill_na_const", "p_size", {"value": "7"})),
        "fill_na_groupby_mean": steps("part_g", ("fill_na_groupby", "p_size", {"group_col": "p_brand", "strategy": "mean"})),
        "fill_na_groupby_median": steps("part_g", ("fill_na_groupby", "p_size", {"group_col": "p_brand"})),
        "fill_na_groupby_mode": steps("part_g", ("fill_na_groupby", "p_size", {"group_col": "p_brand", "strategy": "mode"})),
        "fill_na_knn": steps("part_n", KNN),
        "fill_na_knn_gaps": steps("part_k", KNN),
        # dates
        "extract_date_parts": steps("orders_s", ("extract_date_parts", "o_date", {"drop_original": "True"})),
        "extract_date_us": steps("orders_us", ("extract_date_parts", "o_date", {"drop_original": "True"})),
        "fill_na_mean_long": steps("orders", ("fill_na_mean", "o_orderkey"), keep=["o_orderkey", "o_orderstatus"]),
        "label_encode_many": steps("names", ("label_encode", "c_name")),
        "one_hot_wide": query("names", lambda df: listed(sp.apply_recipe(df, sp.Recipe.of(("one_hot_encode", "c_name", {"form": "codes"}))), "c_name_codes")),
        "auto_dummy_wide": query("customer", lambda df: listed(transform_table(df.select("c_custkey", "c_name", "c_mktsegment"), sp.Recipe([]), form="codes").output, "dummy_codes")),
        "auto_dummy_codes": query("customer", dummy_codes),
        "interaction_boolean": steps("items_b", ("create_interaction", "", {"col1": "l_big", "math_op": "*", "col2": "l_extendedprice", "new_name": "mix"})),
        # binning and maths
        "bin_quantile": steps("part_n", ("bin_numeric", "p_retailprice")),
        "bin_quantile_many": steps("lineitem", ("bin_numeric", "l_extendedprice", {"bins": 1000}), keep=["l_orderkey", "l_extendedprice"]),
        "bin_uniform": steps("part_n", ("bin_numeric", "p_size", {"strategy": "uniform", "bins": 7})),
        "bin_list_labels": steps("part_n", ("bin_numeric", "p_retailprice", {"bins": 3, "labels": ["low", "mid", "high"]})),
        "log_transform": steps("customer", ("log_transform", "c_acctbal")),
        "log_transform_plain": steps("part_n", ("log_transform", "p_retailprice", {"shift": False})),
        "box_cox_transform": steps("customer", ("box_cox_transform", "c_acctbal", {"digits": 3})),
        "box_cox_open_gate": steps("part_n", ("box_cox_transform", "p_size", {"skew_threshold": 0.0, "digits": 3})),
        "box_cox_fixed_power": steps("customer", ("box_cox_transform", "c_acctbal", {"power": 0.5})),
        "box_cox_skew_gate": steps("lineitem", BOX_GATE, keep=["l_orderkey", "l_extendedprice"]),
        "interaction_add": interaction("+"),
        "interaction_sub": interaction("-"),
        "interaction_mul": interaction("*"),
        "interaction_div": interaction("/"),
        "polynomial_features": steps("part", ("polynomial_features", "p_size", {"degree": 3})),
        # scalers
        "standard_scaler": steps("part_n", ("standard_scaler", "p_size")),
        "minmax_scaler": steps("part_n", ("minmax_scaler", "p_size")),
        "robust_scaler": steps("part_n", ("robust_scaler", "p_retailprice")),
        "maxabs_scaler": steps("part_n", ("maxabs_scaler", "p_size")),
        # encoders
        "one_hot_encode": steps("part_n", ("one_hot_encode", "p_type")),
        "auto_dummy": query("part_n", lambda df: transform_table(df, sp.Recipe([])).output),
        "label_encode": steps("part_n", ("label_encode", "p_type")),
        "ordinal_encode": steps("part_n", ("ordinal_encode", "p_type")),
        "target_encode": steps("part_n", ("target_encode", "p_brand", {"target_col": "p_retailprice"})),
        # sources, output and whole recipes
        "sanitise": query("lineitem", lambda df: sp.sanitise(df.select("l_orderkey", "l_tax", "l_shipdate"))),
        "sanitise_odd": query("odd", sp.sanitise),
        "sample_round_trip": query("orders", sample_round_trip),
        "batch_parquet": query("part_n", batch(".parquet")),
        "batch_csv": query("part_n", batch(".csv")),
        "batch_summary": query("part_n", batch(".parquet", "summary")),
        "profile_flags": query("flags", lambda df: sp.profile(df).select("Categorical").select(*CATEGORICAL_STATS)),
        "head_sample": query("orders", lambda df: head_sample(df, 1000, ["o_orderkey"])),
        "preview": query("orders", lambda df: sp.preview(df, sp.Recipe.of(*PREVIEW), order_by=["o_orderkey"]).data),
        "row_numbers": query("orders", numbered(".parquet")),
        "row_numbers_csv": query("orders", numbered(".csv")),
        "keep_first": query("orders", first_of_each),
        "head_in_file_order": query("orders", lambda df: head_sample(in_files(df, "o_orderkey"), 1000)),
        "preview_in_file_order": query("orders", lambda df: sp.preview(in_files(df, "o_orderkey"), sp.Recipe.of(*PREVIEW)).data),
        "csv_round_trip": query("part_n", csv_round_trip),
        "csv_multiline": query("docs_l", csv_round_trip),
        "recipe_strict": steps("part_n", *STRICT),
        "saved_recipe": query("part_n", saved_and_loaded),
        "saved_batch": query("part_n", saved_batch),
        "recipe_phased": query("part_n", lambda df: transform_table(df, sp.Recipe.of(*PHASED)).output),
        "recipe_lenient": steps("part_n", *LENIENT),
    } | ({**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: fill, scale and encode the part table."""
    return steps(
        "part_n",
        ("fill_na_groupby", "p_type", {"group_col": "p_brand", "strategy": "mode"}),
        ("fill_na_median", "p_size"),
        ("robust_scaler", "p_size"),
        ("one_hot_encode", "p_type"),
        ("drop_column", "p_partkey"),
    )(spark, SMOKE_DIR)


# ---------------------------------------------------------------- SQL equivalents


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def _part_select(**changed: str) -> str:
    """The columns of ``part_n`` with some replaced."""
    columns = {
        "p_partkey": "p_partkey",
        "p_brand": "p_brand",
        "p_type": "p_type",
        "p_size": _r("p_size"),
        "p_retailprice": _r("p_retailprice"),
    } | changed
    return ", ".join(f"{e} as {n}" for n, e in columns.items() if e)


def _numeric_stats(source: str, columns: list[str]) -> str:
    rows = [
        f"select '{c}' as name, 'numeric' as type, count(*) - count({c}) as missing, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 1) as missing_pct, round(avg({c}), 2) as mean, "
        f"round(quantile_cont({c}::double, 0.5), 2) as median, round(stddev_samp({c}), 2) as std_dev, "
        f"round(min({c})::double, 2) as min, round(max({c})::double, 2) as max, "
        f'count(distinct {c}) as "unique" from {source}'
        for c in columns
    ]
    return " union all ".join(rows)


def _categorical_stats(source: str, columns: list[str]) -> str:
    rows = [
        f"select '{c}' as name, (select count(distinct {c}) from {source}) as \"unique\", v as top_value, n as freq "
        f"from (select {c} as v, count(*) as n from {source} where {c} is not null group by 1 "
        f"order by n desc, v limit 1)"
        for c in columns
    ]
    return " union all ".join(rows)


def _histogram(source: str, column: str) -> str:
    return (
        f"m as (select min({column}) as mn, max({column}) as mx from {source}), "
        "e as (select i, mn + i * ((mx - mn) / 10) as lo, case when i = 9 then mx else mn + (i + 1) * ((mx - mn) / 10) end as hi "
        "from m, range(10) as r(i)) "
        f"select '{column}' as name, cast(i as bigint) as place, format('{{:.1f}}-{{:.1f}}', lo, hi) as label, "
        f"(select count(*) from {source} where {column} >= lo and ({column} < hi or (i = 9 and {column} <= hi))) as value "
        "from e"
    )


def _flags(columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        pct = f"round((count(*) - count({c})) * 100.0 / count(*), 1)"
        truncated = "false" if kind == "numeric" else f"count(distinct {c}) > 20"
        rows.append(
            f"select '{c}' as name, round(100 - {pct}, 1) as valid_pct, {pct} > 50 as high_missing, "
            f"{pct} > 20 as warn_missing, {pct} > 0 as has_missing, {truncated} as truncated from part_n"
        )
    return " union all ".join(rows)


def _group_fill(statistic: str, overall: str) -> str:
    return (
        f"g as ({statistic}), "
        "f as (select p.p_partkey, p.p_brand, coalesce(p.p_size, g.s) as v from part_g p left join g on p.p_brand = g.b), "
        f"o as ({overall}) "
        f"select p_partkey, p_brand, {_r('coalesce(v, o.s)')} as p_size from f, o"
    )


_MODE = "select v from (select {c} as v, count(*) as n from {t} where {c} is not null group by 1 order by n desc, v limit 1)"

_KNN = """
pr as (select r.p_partkey as rid, dn.p_size as v,
  sqrt(3.0 / (1 + case when r.p_retailprice is not null and dn.p_retailprice is not null then 1 else 0 end)
    * (power(r.p_partkey - dn.p_partkey, 2) + coalesce(power(r.p_retailprice - dn.p_retailprice, 2), 0))) as dist
  from part_n r cross join part_n dn where r.p_size is null and dn.p_size is not null),
k as (select rid, v, row_number() over (partition by rid order by dist, v) as rn from pr),
f as (select rid, avg(v) as v from k where rn <= 5 group by rid)
"""


_GAPS = ("p_retailprice", "a", "b", "c")


def _bins(count: int) -> str:
    points = ", ".join(repr(i * (1.0 / count)) for i in range(count)) + ", 1.0"
    return (
        f"e as (select list_sort(list_distinct(quantile_cont(p_retailprice, [{points}]))) as l from part_n), "
        "b as (select *, case when p_retailprice is null then null "
        "else len(list_filter(l[2:len(l)-1], lambda x: x < p_retailprice)) end as code from part_n, e) "
    )


def _box_cox(source: str, sample: str) -> str:
    """CTE ``w``: the power, to three decimals, whose transform of ``sample`` correlates best with normal scores."""

    def poly(coefficients: tuple[float, ...], r: str) -> str:
        return "(" * len(coefficients) + f"{coefficients[0]!r})" + "".join(f" * {r} + {c!r})" for c in coefficients[1:])

    def ratio(top: tuple[float, ...], bottom: tuple[float, ...], r: str) -> str:
        return f"{poly(top, r)} / {poly(bottom, r)}"

    middle = ratio(boxcox.MIDDLE_TOP, boxcox.MIDDLE_BOTTOM, "(t - 1.6)")
    far = ratio(boxcox.TAIL_TOP, boxcox.TAIL_BOTTOM, "(t - 5)")
    match = "corr(z, case when p = 0 then ln(x) else power(x, p) / p end)"
    return f"""
v as (select ({sample})::double as x from {source}),
k as (select x, row_number() over (order by x) - 1 as k, count(*) over () as n from v),
u as (select x, case when k = 0 then 1 - power(0.5::double, 1.0 / n) when k = n - 1 then power(0.5::double, 1.0 / n)
  else (k + 0.6825::double) / (n + 0.365::double) end as u from k),
h as (select x, u - 0.5::double as c, 0.180625::double - (u - 0.5::double) * (u - 0.5::double) as a, sqrt(-ln(case when u < 0.5 then u else 1 - u end)) as t from u),
z as (select x, case when abs(c) <= 0.425 then c * {ratio(boxcox.CENTRE_TOP, boxcox.CENTRE_BOTTOM, "a")}
  else sign(c) * case when t <= 5 then {middle} else {far} end end as z from h),
g as (select p, {match} as r from z, (select i / 100.0::double as p from range(-300, 301) as s(i)) group by p),
b as (select p as best from g order by r desc limit 1),
y as (select p, {match} as r from z, (select best + i / 100000.0::double as p from b, range(-1500, 1501) as s(i)) group by p),
w as (select round(p, 3) as p from y order by r desc limit 1)
"""


def _one_hot(source: str, column: str, values: list[str]) -> str:
    return ", ".join(f"coalesce({source}.{column} = '{v}', false) as \"{column}_{v}\"" for v in values)


_STRICT = f"""
tc as (select p_brand as b, p_type as v, count(*) as n from part_n where p_type is not null group by 1, 2),
tm as (select b, v from (select *, row_number() over (partition by b order by n desc, v) as rn from tc) where rn = 1),
s1 as (select p.p_partkey, p.p_brand, coalesce(p.p_type, tm.v) as p_type, p.p_size, p.p_retailprice
  from part_n p left join tm on p.p_brand = tm.b),
med as (select quantile_cont(p_size, 0.5) as m from s1),
s2 as (select s1.* replace (coalesce(p_size, m) as p_size) from s1, med),
q as (select quantile_cont(p_size, 0.25) as q1, quantile_cont(p_size, 0.5) as q2, quantile_cont(p_size, 0.75) as q3 from s2),
s3 as (select s2.* replace ((p_size - q2) / case when q3 = q1 then 1 else q3 - q1 end as p_size) from s2, q),
av as (select avg(p_retailprice) as m from s3),
s4 as (select s3.* replace (coalesce(p_retailprice, m) as p_retailprice) from s3, av),
z as (select avg(p_retailprice) as m, stddev_samp(p_retailprice) as s from s4),
s5 as (select s4.* from s4, z where abs((p_retailprice - m) / s) < 1.5),
sc as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from s5),
s6 as (select s5.* replace ((p_retailprice - m) / s as p_retailprice) from s5, sc),
codes as (select p_brand as b, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from s6))
select p_partkey, cast(code as bigint) as p_brand, {_r("p_size")} as p_size, {_r("p_retailprice")} as p_retailprice,
  {_one_hot("s6", "p_type", TYPES[1:])}
from s6 join codes on s6.p_brand = codes.b
"""

_PHASED = f"""
s1 as (select part_n.* replace (coalesce(p_size, (select avg(p_size) from part_n)) as p_size) from part_n),
s2 as (select * from s1 where p_retailprice < 950),
r as (select min(p_size) as mn, max(p_size) as mx from s2),
s3 as (select s2.* replace ((p_size - mn) / (mx - mn) as p_size) from s2, r),
codes as (select p_brand as b, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from s3))
select p_partkey, cast(code as bigint) as p_brand, {_r("p_size")} as p_size, {_r("p_retailprice")} as p_retailprice,
  {_one_hot("s3", "p_type", TYPES)}
from s3 join codes on s3.p_brand = codes.b
"""

_ROW_NUMBERS = "select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as row from orders"
_PREVIEW = f"""
h as (select * from orders order by o_orderkey limit 1000),
r as (select min(o_totalprice) as mn, max(o_totalprice) as mx from h),
c as (select o_orderpriority as p, row_number() over (order by o_orderpriority) - 1 as code
  from (select distinct o_orderpriority from h))
select o_orderkey, o_custkey, o_orderstatus, {_r("(o_totalprice - mn) / (mx - mn)")} as o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, cast(code as bigint) as o_orderpriority,
  year(o_orderdate) as o_orderdate_year, month(o_orderdate) as o_orderdate_month,
  day(o_orderdate) as o_orderdate_day, isodow(o_orderdate) - 1 as o_orderdate_dow
from h join c on h.o_orderpriority = c.p, r order by o_orderkey limit 100
"""


def _oracle_bodies() -> dict[str, tuple[str | None, str]]:
    """name -> (view it needs, SQL; CTEs without the leading ``with``)."""
    part = _part_select
    group = "select p_brand as b, {} as s from part_g where p_brand is not null group by 1"
    mode_counts = (
        "select b, v as s from (select *, row_number() over (partition by b order by n desc, v) as rn from "
        "(select p_brand as b, p_size as v, count(*) as n from part_g "
        "where p_brand is not null and p_size is not null group by 1, 2)) where rn = 1"
    )
    mix = "select {0} as l_extendedprice, {1} as l_discount, {2} as mix from lineitem"
    price, discount = _r("l_extendedprice"), _r("l_discount")

    def mixed(expression: str) -> tuple[None, str]:
        return None, mix.format(price, discount, _r(expression))

    def scaled(column: str, stats: str, formula: str) -> tuple[str, str]:
        return "part_n", f"s as (select {stats} from part_n) select {part(**{column: _r(formula)})} from part_n, s"

    customer = "c_custkey, c_name, c_nationkey, {} as c_acctbal, c_mktsegment"
    shift = "s as (select case when min(c_acctbal) <= 0 then abs(min(c_acctbal)) + 1 else 0 end as o from customer) "
    bins7 = " + ".join(f"(p_size > {i} * ((mx - mn) / 7) + mn)::bigint" for i in range(1, 7))
    weight = "(1 / (1 + exp(-(n - 20) / 10.0)))"
    codes = (
        "c as (select v, row_number() over (order by v) - 1 as code from "
        "(select distinct {} as v from part_n) where v is not null) "
    )
    date = "try_cast(o_date as date)"
    return {
        "extract_date_us": (
            "orders_us",
            "d as (select o_orderkey, strptime(o_date, '%m/%d/%Y %H:%M') as t from orders_us) select o_orderkey, year(t) as o_date_year, "
            "month(t) as o_date_month, day(t) as o_date_day, isodow(t) - 1 as o_date_dow from d",
        ),
        "fill_na_mean_long": (None, "select o_orderkey, o_orderstatus from orders"),
        "label_encode_many": ("names", "select c_custkey, rank() over (order by c_name) - 1 as c_name from names"),
        "one_hot_wide": (
            None,
            "r as (select c_custkey, dense_rank() over (order by c_name) - 2 as k from customer) select c_custkey, case when k >= 0 then k end as c_name_codes from r",
        ),
        "auto_dummy_wide": (
            None,
            "r as (select c_custkey, dense_rank() over (order by c_name) - 1 as k from customer union all "
            "select c_custkey, dense_rank() over (order by c_mktsegment) - 1 + (select count(distinct c_name) from customer) from customer) "
            "select c_custkey, k as dummy_codes from r",
        ),
        "auto_dummy_codes": (
            None,
            "r as (select 'c_name' as \"column\", c_name as v, count(*) as n, 0 as i from customer group by 2 union all "
            "select 'c_mktsegment', c_mktsegment, count(*), 1 from customer group by 2) "
            "select row_number() over (order by i, v) - 1 as code, \"column\", v as value, n as rows from r",
        ),
        "interaction_boolean": ("items_b", f"select l_big, {_r('l_extendedprice')} as l_extendedprice, {_r('l_big::int * l_extendedprice')} as mix from items_b"),
        "table_stats": (
            "part_n",
            "select count(*) as total_rows, cast(5 as bigint) as total_cols, "
            "count(*) - (select count(*) from (select distinct * from part_n)) as duplicate_rows, "
            "5 * count(*) - count(p_partkey) - count(p_brand) - count(p_type) - count(p_size) - count(p_retailprice) "
            "as missing_cells from part_n",
        ),
        "table_stats_duplicates": (
            "items_d",
            "d as (select count(*) as n from (select distinct * from items_d)) "
            "select count(*) as total_rows, count(*) - any_value(n) as duplicate_rows, "
            "count(*) = any_value(n) as clean from items_d, d",
        ),
        "logical_bytes": (
            "part_n",
            "select cast(3 * 8 * count(*) + sum(strlen(p_brand)) + sum(strlen(p_type)) as bigint) as logical_bytes from part_n",
        ),
        "profile_numeric": ("part_n", _numeric_stats("part_n", ["p_partkey", "p_size", "p_retailprice"])),
        "profile_numeric_lineitem": (
            None,
            _numeric_stats(
                "lineitem",
                ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
            ),
        ),
        "profile_categorical": ("part_n", _categorical_stats("part_n", ["p_brand", "p_type"])),
        "profile_documents": (None, _categorical_stats("documents", ["text", "lang", "source"])),
        "profile_histogram": ("part_n", _histogram("part_n", "p_size")),
        "profile_histogram_lineitem": (None, _histogram("lineitem", "l_extendedprice")),
        "profile_top20": (
            None,
            "select 'p_brand' as name, row_number() over (order by n desc, v) - 1 as place, v as label, n as value "
            "from (select p_brand as v, count(*) as n from part group by 1 order by n desc, v limit 20)",
        ),
        "quality_flags": (
            "part_n",
            _flags(
                {
                    "p_partkey": "numeric",
                    "p_brand": "categorical",
                    "p_type": "categorical",
                    "p_size": "numeric",
                    "p_retailprice": "numeric",
                }
            ),
        ),
        "profile_filter": (
            "part_n",
            "select 'p_size' as name, 'numeric' as type, count(*) - count(p_size) as missing from part_n "
            "having count(*) > count(p_size)",
        ),
        "drop_column": ("part_n", f"select {part(p_brand='')} from part_n"),
        "drop_duplicates": ("items_d", "select distinct * from items_d"),
        "drop_outliers_zscore": (
            "part_n",
            f"s as (select avg(p_size) as m, stddev_samp(p_size) as d from part_n) "
            f"select {part()} from part_n, s where abs((p_size - m) / d) < 1.5",
        ),
        "drop_outliers_manual": ("part_n", f"select {part()} from part_n where p_retailprice < 950"),
        "fill_na_mean": scaled("p_size", "avg(p_size) as m", "coalesce(p_size, m)"),
        "fill_na_median": scaled("p_retailprice", "quantile_cont(p_retailprice, 0.5) as m", "coalesce(p_retailprice, m)"),
        "fill_na_mode": (
            "part_n",
            f"m as ({_MODE.format(c='p_type', t='part_n')}) select {part(p_type='coalesce(p_type, m.v)')} from part_n, m",
        ),
        "fill_na_const": ("part_n", f"select {part(p_size=_r('coalesce(p_size, 7.0)'))} from part_n"),
        "fill_na_groupby_mean": ("part_g", _group_fill(group.format("avg(p_size)"), "select avg(v) as s from f")),
        "fill_na_groupby_median": (
            "part_g",
            _group_fill(group.format("quantile_cont(p_size, 0.5)"), "select quantile_cont(v, 0.5) as s from f"),
        ),
        "fill_na_groupby_mode": (
            "part_g",
            _group_fill(mode_counts, f"select v as s from ({_MODE.format(c='v', t='f')})"),
        ),
        "fill_na_knn": (
            "part_n",
            f"{_KNN} select p_partkey, p_brand, p_type, {_r('coalesce(p_size, f.v)')} as p_size, "
            f"{_r('p_retailprice')} as p_retailprice from part_n left join f on p_partkey = f.rid",
        ),
        "fill_na_knn_gaps": (
            "part_k",
            f"pr as (select r.p_partkey as rid, dn.p_size as v, sqrt(6.0 / (1 + {' + '.join(f'(r.{c} - dn.{c} is not null)::int' for c in _GAPS)}) * "
            f"(power(r.p_partkey - dn.p_partkey, 2) + {' + '.join(f'coalesce(power(r.{c} - dn.{c}, 2), 0)' for c in _GAPS)})) as dist "
            "from part_k r cross join part_k dn where r.p_size is null and dn.p_size is not null), "
            "k as (select rid, v, row_number() over (partition by rid order by dist, v) as rn from pr), "
            "f as (select rid, avg(v) as v from k where rn <= 5 group by rid) "
            f"select p_partkey, {_r('coalesce(p_size, f.v)')} as p_size, {', '.join(f'{_r(c)} as {c}' for c in _GAPS)} from part_k left join f on p_partkey = f.rid",
        ),
        "extract_date_parts": (
            "orders_s",
            f"select o_orderkey, year({date}) as o_date_year, month({date}) as o_date_month, "
            f"day({date}) as o_date_day, isodow({date}) - 1 as o_date_dow from orders_s",
        ),
        "bin_quantile": ("part_n", f"{_bins(5)} select {part(p_retailprice='code')} from b"),
        "bin_quantile_many": (
            None,
            f"e as (select list_sort(list_distinct(quantile_cont(l_extendedprice, [{', '.join(repr(i * (1.0 / 1000)) for i in range(1000))}, 1.0]))) as l from lineitem) "
            "select l_orderkey, cast(len(list_filter(l[2:len(l)-1], lambda x: x < l_extendedprice)) as bigint) as l_extendedprice from lineitem, e",
        ),
        "bin_uniform": (
            "part_n",
            f"m as (select min(p_size) as mn, max(p_size) as mx from part_n) select {part(p_size=bins7)} from part_n, m",
        ),
        "bin_list_labels": ("part_n", f"{_bins(3)} select {part(p_retailprice='coalesce(code, -1)')} from b"),
        "log_transform": (None, f"{shift} select {customer.format(_r('ln(1 + c_acctbal + o)'))} from customer, s"),
        "log_transform_plain": ("part_n", f"select {part(p_retailprice=_r('ln(1 + p_retailprice)'))} from part_n"),
        "box_cox_transform": (
            None,
            f"{shift}, {_box_cox('customer, s', 'c_acctbal + o')} select {customer.format(_r('(power(1 + c_acctbal + o, p) - 1) / p'))} from customer, s, w",
        ),
        "box_cox_open_gate": (
            "part_n",
            f"o as (select avg(p_size) as m from part_n), {_box_cox('part_n, o', 'coalesce(p_size, m) + 1')} "
            f"select {part(p_size=_r('(power(2 + p_size, p) - 1) / p'))} from part_n, w",
        ),
        "box_cox_fixed_power": (
            None,
            f"{shift} select {customer.format(_r('(power(1 + c_acctbal + o, 0.5) - 1) / 0.5'))} from customer, s",
        ),
        "box_cox_skew_gate": (
            None,
            "a as (select avg(l_extendedprice) as m from lineitem), "
            "k as (select avg(power(l_extendedprice - m, 3)) / power(avg(power(l_extendedprice - m, 2)), 1.5) as skew "
            "from lineitem, a) "
            f"select l_orderkey, case when abs(skew) > 0.5 then null else {price} end as l_extendedprice from lineitem, k",
        ),
        "interaction_add": mixed("l_extendedprice + l_discount"),
        "interaction_sub": mixed("l_extendedprice - l_discount"),
        "interaction_mul": mixed("l_extendedprice * l_discount"),
        "interaction_div": mixed("l_extendedprice / nullif(l_discount, 0)"),
        "polynomial_features": (
            None,
            f"select p_partkey, p_name, p_brand, p_type, p_size, {_r('p_retailprice')} as p_retailprice, "
            "power(p_size, 2) as p_size_poly_2, power(p_size, 3) as p_size_poly_3 from part",
        ),
        "standard_scaler": scaled("p_size", "avg(p_size) as m, stddev_pop(p_size) as d", "(p_size - m) / d"),
        "minmax_scaler": scaled("p_size", "min(p_size) as mn, max(p_size) as mx", "(p_size - mn) / (mx - mn)"),
        "robust_scaler": scaled(
            "p_retailprice",
            "quantile_cont(p_retailprice, 0.25) as a, quantile_cont(p_retailprice, 0.5) as b, "
            "quantile_cont(p_retailprice, 0.75) as c",
            "(p_retailprice - b) / (c - a)",
        ),
        "maxabs_scaler": scaled("p_size", "max(abs(p_size)) as m", "p_size / m"),
        "one_hot_encode": ("part_n", f"select {part(p_type='')}, {_one_hot('part_n', 'p_type', TYPES[1:])} from part_n"),
        "auto_dummy": (
            "part_n",
            f"select {part(p_type='', p_brand='')}, {_one_hot('part_n', 'p_brand', BRANDS)}, "
            f"{_one_hot('part_n', 'p_type', TYPES)} from part_n",
        ),
        "label_encode": (
            "part_n",
            codes.format("coalesce(p_type, 'nan')") + f"select {part(p_type='code')} from part_n "
            "join c on coalesce(p_type, 'nan') = c.v",
        ),
        "ordinal_encode": (
            "part_n",
            codes.format("p_type") + f"select {part(p_type='code::double')} from part_n left join c on p_type = c.v",
        ),
        "target_encode": (
            "part_n",
            "g as (select p_brand as b, count(p_retailprice) as n, avg(p_retailprice) as m from part_n group by 1), "
            "a as (select avg(p_retailprice) as p from part_n) "
            f"select {part(p_brand=_r(f'p * (1 - {weight}) + m * {weight}'))} "
            "from part_n join g on part_n.p_brand is not distinct from g.b, a",
        ),
        "sanitise": (
            None,
            f"select l_orderkey, {_r('l_tax')} as l_tax, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate from lineitem",
        ),
        "sanitise_odd": (
            "odd",
            f"select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case when isfinite(l_tax) then {_r('l_tax')} end as l_tax from odd",
        ),
        "sample_round_trip": (
            None,
            f"select o_orderkey, o_custkey, o_orderstatus, {_r('o_totalprice')} as o_totalprice, "
            "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority from orders order by o_orderkey limit 1000",
        ),
        "batch_parquet": ("part_n", _PHASED),
        "batch_csv": ("part_n", _PHASED),
        "batch_summary": (
            "part_n",
            "m as (select p_type from part_n where p_retailprice < 950) select cast(4 as bigint) as steps, "
            "'fill_na_mean,drop_outliers_manual,minmax_scaler,label_encode' as applied, count(*) as rows, "
            "cast(4 + count(distinct p_type) as bigint) as columns from m",
        ),
        "profile_flags": (
            "flags",
            _categorical_stats("(select strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, case when o_large then 'True' else 'False' end as o_large from flags)", ["o_orderdate", "o_large"]),
        ),
        "head_sample": (
            None,
            f"select o_orderkey, o_custkey, o_orderstatus, {_r('o_totalprice')} as o_totalprice, o_orderdate, "
            "o_orderpriority from orders order by o_orderkey limit 1000",
        ),
        "preview": (None, _PREVIEW),
        "preview_in_file_order": (None, _PREVIEW),
        "head_in_file_order": (
            None,
            f"select o_orderkey, o_custkey, o_orderstatus, {_r('o_totalprice')} as o_totalprice, o_orderdate, "
            "o_orderpriority from orders order by o_orderkey limit 1000",
        ),
        "row_numbers": (None, _ROW_NUMBERS),
        "row_numbers_csv": (None, _ROW_NUMBERS),
        "keep_first": (
            None,
            "n as (select *, row_number() over (order by o_orderkey) - 1 as row from orders) "
            "select o_orderstatus, o_orderpriority, o_custkey, min(row) as row from n group by all",
        ),
        "csv_round_trip": ("part_n", f"select {part()} from part_n"),
        "csv_multiline": ("docs_l", "select doc_id, text, lang, n_chars from docs_l"),
        "recipe_strict": ("part_n", _STRICT),
        "saved_recipe": ("part_n", _STRICT),
        "saved_batch": ("part_n", _PHASED),
        "recipe_phased": ("part_n", _PHASED),
        "recipe_lenient": ("part_n", f"select {part(p_type="coalesce(p_type, 'UNKNOWN')")} from part_n"),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query."""
    out = {}
    for name, (view, body) in _oracle_bodies().items():
        body = body.strip()
        source, sql = VIEWS[view] if view else ("", "")
        prefix = f"with {view} as ({sql.format(source=source)})" if view else ""
        if body.startswith("select"):
            out[name] = f"{prefix} {body}".strip()
        else:
            out[name] = f"{prefix}, {body}" if prefix else f"with {body}"
    return out | (llm.oracle_sql() if llm else {})
