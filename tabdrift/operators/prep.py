"""Labels and features: kinds, dates, alignment, imputation, one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabdrift.functions.dates import EVALUATE_FORMATS, parsed
from tabdrift.functions.numbers import number
from tabdrift.functions.ordering import percentiles, text_ranks
from tabdrift.operators.profile import date_formats, first_values

KINDS = ["boolean_class", "integer_class", "regression", "text_class"]


def label_kind(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """What kind of target a label is, per group of ``keys``: kind, n, n_distinct.

    Only true and false (0 and 1 too, and nothing at all) make a boolean class. If 85 % read
    as numbers, whole numbers of at most 20 kinds, fewer than a fifth of the rows, are an
    integer class, other numbers a regression. All else is a text class.
    """
    x = number(F.when(F.lower(F.col(label).cast("string")).isin("true", "false"), F.when(F.lower(F.col(label).cast("string")) == "true", "1").otherwise("0")).otherwise(F.col(label).cast("string")))
    plain = number(F.col(label))
    # each distinct value once, with its count
    values = df.groupBy(*keys, F.col(label).cast("string").alias("_v")).agg(F.count("*").alias("_n"), F.first(x).alias("_b"), F.first(plain).alias("_x"))
    whole = F.abs(F.col("_x") - F.bround("_x")) <= 1e-8 + 1e-5 * F.abs(F.bround("_x"))
    stats = values.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.coalesce(F.bool_and(F.when(F.col("_v").isNotNull(), F.coalesce(F.col("_b").isin(0.0, 1.0), F.lit(False)))), F.lit(True)).alias("boolean"),
        F.coalesce(F.sum(F.when(F.col("_x").isNotNull(), F.col("_n"))), F.lit(0)).alias("numbers"),
        F.count_distinct("_x").alias("kinds"),
        F.coalesce(F.bool_and(whole), F.lit(False)).alias("whole"),
        F.count("_v").alias("n_distinct"),
    )
    numeric = F.col("numbers") / F.col("n") >= 0.85
    few = F.col("whole") & (F.col("kinds") <= 20) & (F.col("kinds") / F.col("numbers") < 0.2)
    kind = F.when(F.col("boolean"), KINDS[0]).when(numeric & few, KINDS[1]).when(numeric, KINDS[2]).otherwise(KINDS[3])
    return stats.select(*keys, kind.alias("kind"), "n", "n_distinct")


def label_codes(df: DataFrame, label: str, kind: str) -> DataFrame:
    """Add ``y``, the label as its kind asks; rows without a usable label go.

    Boolean: 1 or 0, null 0. Integer class and regression: the number, rows without one
    go. Text class: place of the value in sorted order, null as 'NA'. The vocabulary is
    joined, so no window spans the table.
    """
    if kind == KINDS[0]:
        return df.withColumn("y", F.when(F.lower(F.col(label).cast("string")).isin("true", "1", "1.0"), 1).otherwise(0).cast("double"))
    if kind in KINDS[1:3]:
        return df.withColumn("y", number(F.col(label))).filter("y IS NOT NULL")
    named = df.withColumn("_v", F.coalesce(F.col(label).cast("string"), F.lit("NA")))
    return named.join(text_ranks(named, "_v", "_p"), "_v").withColumn("y", F.col("_p").cast("double")).drop("_v", "_p")


def usable(kind: Column, rows: Column, classes: Column) -> Column:
    """Why a task cannot be fitted: fewer than 10 rows, or a single class; null if it can."""
    return F.when(rows < 10, "too few usable training rows").when((kind != KINDS[2]) & (classes < 2), "only one class")


def learn_dates(train: DataFrame, row_id: str, columns: Sequence[str], least: float = 0.8) -> dict[str, str]:
    """Format of each date column, learnt on its first 300 values; one row per column reaches the driver."""
    found = date_formats(first_values(train, row_id, columns, 300), tuple(EVALUATE_FORMATS), least)
    return {r["column"]: r["format"] for r in found.filter("format IS NOT NULL").collect()}


def parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Date columns by the learnt formats; what does not parse is null, columns that are gone stay gone."""
    return df.withColumns({c: parsed(F.col(c), f) for c, f in formats.items() if c in df.columns})


def valid_ratios(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Share of rows that parse, per date column."""
    shares = df.agg(*(F.avg(parsed(F.col(c), f).isNotNull().cast("int")).alias(c) for c, f in formats.items()))
    return shares.unpivot([], list(formats), "column", "valid_ratio")


def date_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Year, month and day of each date column, which goes; missing columns and non-dates give nulls."""
    kinds = dict(df.dtypes)
    parts = {}
    for c in columns:
        at = F.col(c) if kinds.get(c, "").startswith(("timestamp", "date")) else F.lit(None).cast("timestamp")
        parts |= {f"{c}_year": F.year(at), f"{c}_month": F.month(at), f"{c}_day": F.dayofmonth(at)}
    return df.withColumns(parts).drop(*columns)


def align(df: DataFrame, train_schema: Sequence[tuple[str, str]]) -> DataFrame:
    """The columns of the training schema in its order: missing ones null, others dropped."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in train_schema))


def align_report(train: DataFrame, test: DataFrame, by: Sequence[str] = ("task_id",), shown: int = 20) -> DataFrame:
    """Per task the missing and extra columns, and what the strict mode says: ok or STRICT_SCHEMA_FAIL
    with the first missing names and their number. Inputs: by, ordinal, column."""
    a = train.select(*by, "column", F.col("ordinal").alias("i"))
    b = test.select(*by, "column", F.col("ordinal").alias("j"))
    both = a.join(b, [*by, "column"], "full_outer")
    listed = lambda cond, place: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(place), F.col("column"))))), lambda x: x["column"])
    out = both.groupBy(*by).agg(listed(F.col("j").isNull(), "i").alias("missing"), listed(F.col("i").isNull(), "j").alias("extra"))
    return out.withColumn("n_missing", F.size("missing")).withColumn("first_missing", F.slice("missing", 1, shown)).withColumn(
        "strict", F.when(F.size("missing") > 0, "STRICT_SCHEMA_FAIL").otherwise("ok")
    )


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """The cells of ``columns`` as rows (column, value)."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("s")).select("s.*").filter("value IS NOT NULL")


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each number column, one row per column for the driver."""
    found = percentiles(_long(train, columns, "double"), ["column"], "value", {"median": 0.5})
    return dict.fromkeys(columns) | {r["column"]: r["median"] for r in found.collect()}


def impute_median(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of number columns by the exact training median; without training values they stay."""
    known = medians(train, columns)
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(known[c]).cast("double")) for c in columns})


def impute_mode(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of text columns by the most frequent training value, the smallest on ties; one job for all columns."""
    counts = _long(train, columns, "string").groupBy("column", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    known = dict.fromkeys(columns) | {r["column"]: r["mode"] for r in found.collect()}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(known[c])) for c in columns})


def one_hot(train: DataFrame, df: DataFrame, column: str, key: str) -> DataFrame:
    """Sparse one-hot as rows (key, slot) with slots in sorted order of the training values.

    Values unseen in training have no row, that is, all zeros.
    """
    return df.join(text_ranks(train, column, "slot"), column).select(key, "slot")
