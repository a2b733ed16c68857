"""Profiles of tables: hygiene, snapshots, catalogue, domain and target inference."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabdrift.functions.dates import EVOLVE_FORMATS, parsed, pick_format
from tabdrift.functions.numbers import number
from tabdrift.operators.relate import cells, column_stats, column_table, is_id_like

#: Keywords of the domains, in order.
DOMAINS = {
    "weather": ["temp", "temperature", "humidity", "wind", "rain", "pressure", "station"],
    "sales": ["sales", "revenue", "price", "order", "customer", "product", "store", "qty", "quantity"],
    "health": ["patient", "diagnosis", "disease", "treatment", "blood", "cholesterol", "heart", "glucose"],
    "economic": ["income", "wage", "tax", "agi", "gdp", "unemployment", "inflation", "budget"],
    "education": ["math", "reading", "science", "score", "sat", "act", "grade"],
}
#: Names that make a column the target, in order.
TARGET_NAMES = [
    "target", "label", "y", "class", "outcome", "score", "sales", "price", "amount", "revenue", "income", "budget", "grade", "risk_category",
]
#: Parts of names that a target may have if no number column serves.
TARGET_PARTS = [
    "score", "happiness_score", "rating", "metric", "sales", "revenue", "amount", "price", "fare", "cost", "rank", "ranking", "count", "qty", "quantity",
]
#: Label names by priority across tables, and within the first table that has one.
LABEL_PRIORITY = ["Score", "label", "target", "y", "class", "outcome", "risk_category"]
TABLE_FIRST_NAMES = ["target", "label", "y", "class", "outcome", "score", "risk_category", "grade"]

NUMERIC_LIKE = r"^\s*-?\d+(\.\d+)?\s*$"
#: Names of column types.
DTYPES = {"bigint": "int64", "int": "int64", "smallint": "int64", "tinyint": "int64", "double": "float64", "float": "float64", "string": "str", "boolean": "bool", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]"}


def drop_blank_columns(df: DataFrame) -> DataFrame:
    """Without blank columns, Unnamed* columns, and those Spark names for a blank header."""
    bad = lambda c: not c.strip() or c.strip().lower().startswith("unnamed") or re.fullmatch(r"_c\d+", c)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not bad(c)))


def dtype_names(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, DTYPES.get(t, t)) for c, t in df.dtypes]


def snapshot(tables: Mapping[str, DataFrame], row_ids: Mapping[str, str], samples: int = 3) -> DataFrame:
    """Per table and column: dtype, null_ratio, n_unique and the first distinct values in row order."""
    stats = column_stats(tables).withColumn("null_ratio", F.try_divide("n_null", "n_rows"))
    long = None
    for name, df in tables.items():
        one = df.select(F.col(row_ids[name]).cast("bigint").alias("_row"), *(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")).alias(f"c{i}") for i, c in enumerate(df.columns)))
        one = one.select("_row", F.explode(F.array(*(f"c{i}" for i in range(len(df.columns))))).alias("c")).select(F.lit(name).alias("table"), "_row", "c.*")
        long = one if long is None else long.unionByName(one)
    firsts = long.filter("value IS NOT NULL").groupBy("table", "column", "value").agg(F.min("_row").alias("first"))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy("table", "column").orderBy("first", "value"))).filter(F.col("r") <= samples)
    sample = ranked.groupBy("table", "column").agg(F.array_sort(F.collect_list(F.struct("r", "value"))).alias("s"))
    kinds = stats.sparkSession.createDataFrame([(t, c, d) for t, df in tables.items() for c, d in dtype_names(df)], "table string, column string, dtype string")
    out = stats.join(F.broadcast(kinds), ["table", "column"]).join(sample, ["table", "column"], "left")
    return out.select("table", "column", "dtype", "null_ratio", F.col("n_distinct").alias("n_unique"), F.coalesce(F.transform("s", lambda x: x["value"]), F.array().cast("array<string>")).alias("sample"))


def fingerprints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: n_rows, columns in order and the map of their dtypes."""
    out = None
    for name, df in tables.items():
        names = dtype_names(df)
        one = df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.array(*(F.lit(c) for c, _ in names)).alias("columns"),
            F.map_from_arrays(F.array(*(F.lit(c) for c, _ in names)), F.array(*(F.lit(d) for _, d in names))).alias("dtypes"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def schema_diff(before: DataFrame, after: DataFrame, by: Sequence[str] = ("table",)) -> DataFrame:
    """Added and removed names and dtype changes of common ones, sorted. Inputs: by, column, dtype."""
    a = before.select(*by, "column", F.col("dtype").alias("before"))
    b = after.select(*by, "column", F.col("dtype").alias("after"))
    both = a.join(b, [*by, "column"], "full_outer")
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("column"))))
    change = F.when(F.col("before") != F.col("after"), F.struct("column", "before", "after"))
    return both.groupBy(*by).agg(
        names(F.col("before").isNull()).alias("added"), names(F.col("after").isNull()).alias("removed"), F.array_sort(F.collect_list(change)).alias("dtype_changes")
    )


def column_types(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: table, ordinal, column, dtype, n_rows. Names and types come from the schemas; rows are counted."""
    kinds = [(t, i, d) for t, df in tables.items() for i, (_, d) in enumerate(dtype_names(df))]
    shown = column_table(tables)
    return shown.join(F.broadcast(shown.sparkSession.createDataFrame(kinds, "table string, ordinal int, dtype string")), ["table", "ordinal"])


def row_null_profile(df: DataFrame) -> DataFrame:
    """Mean and 95th percentile (interpolated) of the share of nulls in a row."""
    share = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0)) / F.lit(len(df.columns))
    counts = df.groupBy(share.alias("share")).agg(F.count("*").alias("n"))
    return counts.agg(F.try_divide(F.sum(F.col("share") * F.col("n")), F.sum("n")).alias("row_na_mean"), F.percentile("share", F.lit(0.95), F.col("n")).alias("row_na_p95"))


def domain(names: Column) -> Column:
    """Struct domain, score: the domain with most keywords in the joined lower-case names, the first on ties."""
    text = F.lower(F.array_join(names, " "))
    scored = [
        F.struct(sum((text.contains(k).cast("int") for k in words), F.lit(0)).alias("score"), F.lit(-i).alias("o"), F.lit(d).alias("domain"))
        for i, (d, words) in enumerate(DOMAINS.items())
    ]
    top = F.array_max(F.array(*scored))
    return F.when(top["score"] > 0, F.struct(top["domain"].alias("domain"), top["score"].alias("score"))).otherwise(F.struct(F.lit("unknown").alias("domain"), F.lit(0).alias("score")))


def catalog(tables: Mapping[str, DataFrame], unreadable: Sequence[str] = ()) -> DataFrame:
    """One row per table: n_rows, n_cols, columns_json, domain_guess and domain_score; unreadable ones are 'error'."""
    shown = fingerprints(tables).withColumn("_d", domain(F.col("columns")))
    out = shown.select("table", "n_rows", F.size("columns").alias("n_cols"), F.to_json("columns").alias("columns_json"), F.col("_d.domain").alias("domain_guess"), F.col("_d.score").alias("domain_score"))
    if unreadable:
        bad = out.sparkSession.createDataFrame([(t,) for t in unreadable], "table string")
        out = out.unionByName(bad.select("table", F.lit(0).cast("long").alias("n_rows"), F.lit(0).alias("n_cols"), F.lit("[]").alias("columns_json"), F.lit("error").alias("domain_guess"), F.lit(0).alias("domain_score")))
    return out


def first_values(df: DataFrame, row_id: str, columns: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` non-null values of each column in row order: column, ordinal, value.

    Each column is read beside the row id alone; a task keeps its first ``n`` values, so that rows are neither copied nor sorted.
    """
    out = None
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        first = df.filter(value.isNotNull()).select(F.col(f"`{row_id}`").alias("_row"), value.alias("_value")).orderBy("_row").limit(n)
        one = first.select(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col("_value").cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], "ordinal int, column string, value string") if out is None else out


def date_formats(values: DataFrame, formats: Sequence[str] = tuple(EVOLVE_FORMATS), least: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Per column of ``values``, and per ``by`` such as the task: the detected format, and the share of values it parses."""
    shares = values.groupBy(*by, "ordinal", "column").agg(*(F.avg(parsed(F.col("value"), f).isNotNull().cast("int")).alias(f"s{i}") for i, f in enumerate(formats)))
    of = {f: F.col(f"s{i}") for i, f in enumerate(formats)}
    share = F.coalesce(*(F.when(F.col("format") == f, s) for f, s in of.items()))
    return shares.withColumn("format", pick_format(of, least)).select(*by, "ordinal", "column", "format", share.alias("ok"))


def numeric_like(values: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """Per text column the share of values that read as numbers, and whether it is the first above 0.7.

    Columns that start with ``__`` and protected ones are never picked.
    """
    shares = values.groupBy("ordinal", "column").agg(F.avg(F.col("value").rlike(NUMERIC_LIKE).cast("int")).alias("share"))
    may = (F.col("share") > 0.7) & ~F.col("column").startswith("__") & ~F.col("column").isin(list(protected))
    first = F.min(F.when(may, F.col("ordinal"))).over(Window.partitionBy())
    return shares.withColumn("picked", F.coalesce(may & (F.col("ordinal") == first), F.lit(False)))


def address_like(values: DataFrame) -> DataFrame:
    """Per column: whether its name says address, and whether its values look like one."""
    low = F.lower("column")
    out = values.groupBy("ordinal", "column").agg(
        F.avg(F.col("value").contains(",").cast("int")).alias("comma_share"),
        F.avg((F.size(F.filter(F.split("value", r"\s+"), lambda x: x != "")) > 2).cast("int")).alias("tokens_share"),
    )
    return out.withColumn("by_name", low.contains("address") | low.contains("addr")).withColumn("by_value", (F.col("comma_share") > 0.3) | (F.col("tokens_share") > 0.7))


def infer_targets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The target column of each table: table, target, stage (names, numbers, parts or none), score,
    and filled_share, the share of rows in which the target is not null.

    First a preferred name; else, of columns that read as numbers in 85 % of the rows,
    neither dates nor ids and not almost unique, the one with the largest valid share less
    the distance of its distinctness from 0.2; else the first column whose name has a part
    of a target name and that is not constant. First columns win ties.
    """
    values = cells(tables).groupBy("table", "ordinal", "column", "value").agg(F.count("*").alias("n")).withColumn("x", number(F.col("value")))
    stats = values.groupBy("table", "ordinal", "column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0)).alias("valid"),
        F.count_distinct("x").alias("numbers"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count("value").alias("texts"),
    )
    low = F.lower("column")
    dated = low.contains("date") | low.contains("time") | low.endswith("_dt")
    usable = ~dated & ~is_id_like(F.col("column"))
    ratio, spread = F.col("valid") / F.col("rows"), F.col("numbers") / F.col("rows")
    score = F.when(usable & (ratio >= 0.85) & (spread <= 0.95), ratio - F.abs(spread - 0.2))
    named = F.array_position(F.array(*(F.lit(n) for n in TARGET_NAMES)), low)
    part = F.lit(False)
    for p in TARGET_PARTS:
        part = part | low.contains(p)
    fine = F.when(ratio >= 0.3, F.col("numbers") > 1).otherwise(
        (F.col("filled") / F.col("rows") >= 0.3) & (F.col("texts") / F.col("rows") <= 0.95) & (F.col("texts") > 1)
    )
    marked = stats.withColumns({"named": F.when(named > 0, named), "score": score, "part": F.when(usable & part & fine, F.col("ordinal"))})
    one = F.struct("column", (F.col("filled") / F.col("rows")).alias("share"), "score")
    best = marked.groupBy("table").agg(
        F.min_by(one, "named").alias("a"),
        F.max_by(one, F.when(F.col("score").isNotNull(), F.struct("score", -F.col("ordinal")))).alias("b"),
        F.min_by(one, "part").alias("c"),
    )
    stage = F.when(F.col("a").isNotNull(), "names").when(F.col("b").isNotNull(), "numbers").when(F.col("c").isNotNull(), "parts").otherwise("none")
    found = F.coalesce("a", "b", "c")
    return best.select(
        "table", found["column"].alias("target"), stage.alias("stage"), F.when(stage == "numbers", F.col("b.score")).alias("score"), found["share"].alias("filled_share")
    )


def _wanted(columns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of ``columns`` whose name is one of ``names`` in any case, with its place as prio."""
    wanted = columns.sparkSession.createDataFrame([(i, n.strip().lower()) for i, n in enumerate(names)], "prio int, low string")
    return columns.withColumn("low", F.lower("column")).join(F.broadcast(wanted), "low")


def label_name_first(columns: DataFrame, priority: Sequence[str] = LABEL_PRIORITY) -> DataFrame:
    """Per task the first wanted name that any table has, in any case, in the first table that has it.

    Input: task_id, table, table_idx, ordinal, column. Of columns that differ in case only the last is taken.
    """
    order = F.struct("prio", "table_idx", -F.col("ordinal"))
    hit = _wanted(columns, priority).groupBy("task_id").agg(F.min_by(F.struct("table", "column"), order).alias("l"))
    return hit.select("task_id", F.col("l.table").alias("table"), F.col("l.column").alias("label"))


def label_table_first(columns: DataFrame, targets: DataFrame | None = None, names: Sequence[str] = TABLE_FIRST_NAMES, least: float = 0.05) -> DataFrame:
    """Per task the first table that has any wanted name (in any case), and the first name it has.

    Tasks without one take the first table whose inferred target (``infer_targets``, by table)
    is filled in more than ``least`` of its rows.
    """
    order = F.struct("table_idx", "prio", -F.col("ordinal"))
    named = _wanted(columns, names).groupBy("task_id").agg(F.min_by(F.struct("table", F.col("column").alias("label")), order).alias("l"))
    if targets is not None:
        good = targets.filter((F.col("target").isNotNull()) & (F.col("filled_share") > least)).select("table", "target")
        rest = columns.select("task_id", "table", "table_idx").distinct().join(named, "task_id", "left_anti").join(good, "table")
        named = named.unionByName(rest.groupBy("task_id").agg(F.min_by(F.struct("table", F.col("target").alias("label")), "table_idx").alias("l")))
    return named.select("task_id", "l.table", "l.label")
