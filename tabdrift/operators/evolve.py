"""Schema evolution of a table by a reproducible plan.

Every operator returns the table unchanged when its column is protected, missing or
not applicable. Values are picked by hashes of the seed, so a plan does not depend on
the order in which rows or columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabdrift.functions.dates import parsed
from tabdrift.functions.numbers import number
from tabdrift.functions.ordering import SORTED, running_sums
from tabdrift.functions.stored import written
from tabdrift.operators.profile import first_values, numeric_like
from tabdrift.operators.relate import is_bad_name, join_keys, numeric_columns

#: Parts of names of money-like and category-like columns, in order.
MONEY = ["amount", "price", "sales", "revenue", "income", "tax", "cost", "msrp", "score"]
CATEGORY = ["state", "country", "city", "product", "category", "type", "status", "region", "risk"]
#: What a plan chooses from.
DATE_RULES = ["flip_date_time", "split_date_parts"]
TOP_K = [2, 5, 10]
DIVISORS = [10.0, 1000.0]
#: Names of address parts, in order.
ZIP_NAMES = ["zip", "zipcode", "zip_code", "postal", "postalcode", "postal_code"]
GENERIC_PARTS = {
    "street": ["address", "street_address", "street", "addressline1", "address1", "addr1"],
    "city": ["city", "town"],
    "state": ["state", "province"],
    "region": ["region"],
    "zip": ZIP_NAMES,
    "country": ["country"],
}
GROUP_PARTS = {
    "street": ["street_address", "street", "address", "addressline1", "addr1"],
    "state": ["state", "province"],
    "zip": ZIP_NAMES,
    "country": ["country"],
    "region": ["region"],
}


def hash_number(text: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the text's SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def task_seed(global_seed: Column, task_id: Column) -> Column:
    """Seed of a task: the first 8 hexadecimal digits of sha1('<global>:<task>')."""
    return hash_number(F.concat_ws(":", global_seed.cast("string"), task_id))


def plans(
    columns: DataFrame, global_seed: int, protected: Sequence[str] | DataFrame = (), key_mode: str = "non_key", formats: DataFrame | None = None
) -> DataFrame:
    """One plan per task of ``columns`` (task_id, table, table_idx, ordinal, column).

    Columns are the union over tables. Those that start with ``__`` and blank or
    protected ones are never picked; what is protected is a list of names for all tasks, or rows
    (task_id, column), such as each task's label. Picks by chance take the column with the smallest
    hash of seed, purpose and name: rename and drop from the columns that are no join
    keys (with ``key_mode='key'`` rename takes a join key if there is one), else from all;
    a date column from those named so. The address, money and category columns are the
    first whose names say so, the latter two falling back to a pick by chance. The date
    column's format is looked up in ``formats`` (task_id, column, format), detected before.
    """
    keys = join_keys(columns.select("task_id", "table", "column")).select("task_id", "column").withColumn("is_key", F.lit(True))
    union = columns.filter(~is_bad_name(F.col("column")) & ~F.col("column").startswith("__"))
    if isinstance(protected, DataFrame):
        union = union.join(protected.select("task_id", "column"), ["task_id", "column"], "left_anti")
    else:
        union = union.filter(~F.col("column").isin(list(protected)))
    union = union.groupBy("task_id", "column").agg(F.min(F.struct("table_idx", "ordinal")).alias("place"))
    seeded = union.join(keys, ["task_id", "column"], "left").withColumn("seed", task_seed(F.lit(global_seed), F.col("task_id")))
    low, is_key = F.lower("column"), F.coalesce("is_key", F.lit(False))
    chance = lambda use: F.sha1(F.concat_ws(":", F.col("seed").cast("string"), F.lit(use), F.col("column")).cast("binary"))
    some = lambda cond, order: F.min_by("column", F.when(cond, order))
    said = lambda words: F.array_max(F.array(*(low.contains(w).cast("int") for w in words))) == 1
    dated = low.contains("date") | low.contains("time") | low.endswith("_dt")
    every = F.lit(True)
    picks = {
        "rename_free": some(~is_key, chance("rename")), "rename_any": some(every, chance("rename")), "rename_key": some(is_key, chance("rename")),
        "drop_free": some(~is_key, chance("drop")), "drop_any": some(every, chance("drop")),
        "address_col": some(said(["address", "addr"]), F.col("place")), "datetime_col": some(dated, chance("date")),
        "money": some(said(MONEY), F.col("place")), "money_free": some(~is_key, chance("money")), "money_any": some(every, chance("money")),
        "cat": some(said(CATEGORY), F.col("place")), "cat_free": some(~is_key, chance("category")), "cat_any": some(every, chance("category")),
    }
    out = seeded.groupBy("task_id", "seed").agg(F.array_sort(F.collect_list(F.when(is_key, F.col("column")))).alias("join_keys"), *(c.alias(n) for n, c in picks.items()))
    draw = lambda use, values: F.element_at(F.array(*(F.lit(v) for v in values)), (hash_number(F.concat_ws(":", F.col("seed").cast("string"), F.lit(use))) % len(values) + 1).cast("int"))
    rename = F.coalesce(*(["rename_key"] if key_mode == "key" else []), "rename_free", "rename_any")
    known = columns.sparkSession.createDataFrame([], "task_id string, column string, format string") if formats is None else formats
    known = known.select("task_id", F.col("column").alias("datetime_col"), F.col("format").alias("datetime_format"))
    out = out.join(known, ["task_id", "datetime_col"], "left")
    return out.select(
        "task_id", "seed", "join_keys", rename.alias("rename_col"), F.coalesce("drop_free", "drop_any").alias("drop_col"), "address_col", "datetime_col", "datetime_format",
        F.coalesce("money", "money_free", "money_any").alias("meaning_num_col"), F.coalesce("cat", "cat_free", "cat_any").alias("meaning_cat_col"),
        draw("date_rule", DATE_RULES).alias("datetime_rule"), draw("topk", TOP_K).alias("category_keep_topk"), draw("divisor", DIVISORS).alias("unit_scale_divisor"),
    )


def _usable(df: DataFrame, column: str | None, protected: Sequence[str]) -> bool:
    return bool(column) and column in df.columns and column not in protected


def add_columns(df: DataFrame, seed: int, row_key: str, sparse: float = 0.2) -> DataFrame:
    """Add __new_constant, __new_sparse (1.0 in about ``sparse`` of the rows, by a hash of seed
    and row key, else null) and __row_id, 0 to n - 1 in the order of the numeric ``row_key``, nulls first.

    Rows that share a key are numbered in the order of their columns; those of a key with more than
    ``SORTED`` rows part by part as they are read, within a part in that order.
    """
    key = F.col(f"`{row_key}`")
    counts = written(df.groupBy(key.alias("_k")).agg(F.count("*").alias("_n"), F.count("*").alias("_upto")).withColumn("_one", F.lit(1)), "row-keys")
    upto = running_sums(counts, ["_one"], "_k", ["_upto"]).select("_k", "_n", (F.col("_upto") - F.col("_n")).alias("_before"))
    same = key.eqNullSafe(F.col("_k"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(f"`{c}`") for c in df.columns)))
    numbered = lambda rows, keys: rows.join(keys.drop("_n"), same, "left").withColumn("__row_id", (F.col("_before") + place - 1).cast("long")).drop("_k", "_before")
    if counts.filter(F.col("_n") > SORTED).isEmpty():
        out = numbered(df, upto)
    else:
        # at most one such key in SORTED rows
        hot = written(upto.filter(F.col("_n") > SORTED), "hot-keys")
        few = df.join(F.broadcast(hot.select("_k")), same, "left_anti")
        out = numbered(few, upto).unionByName(_numbered_parts(df, hot, same))
    chance = hash_number(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))) / F.lit(4294967296.0)
    added = {"__new_constant": F.lit("unknown"), "__new_sparse": F.when(chance < sparse, 1.0), "__row_id": F.col("__row_id")}
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in added), *(c.alias(n) for n, c in added.items()))


def _numbered_parts(df: DataFrame, hot: DataFrame, same: Column) -> DataFrame:
    """The rows of the keys of ``hot`` (_k, _before) with their __row_id, numbered in the parts they are stored in."""
    rows = df.join(F.broadcast(hot.select("_k", "_before")), same).withColumn("_part", F.spark_partition_id())
    rows = written(rows, "hot-rows")
    sizes = rows.groupBy("_k", "_part").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_k").alias("_key"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_skip"))
    placed = rows.join(starts, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_at")))
    place = F.row_number().over(Window.partitionBy("_k", "_part").orderBy(*(F.col(f"`{c}`") for c in df.columns)))
    return placed.withColumn("__row_id", (F.col("_before") + F.col("_skip") + place - 1).cast("long")).select(
        *(F.col(f"`{c}`") for c in df.columns if c != "__row_id"), "__row_id"
    )


def rename_column(df: DataFrame, column: str | None, protected: Sequence[str] = ()) -> DataFrame:
    return df.withColumnRenamed(column, f"{column}__renamed") if _usable(df, column, protected) else df


def drop_column(df: DataFrame, column: str | None, protected: Sequence[str] = ()) -> DataFrame:
    """Without the column, if the table has more than two."""
    return df.drop(column) if _usable(df, column, protected) and len(df.columns) > 2 else df


def date_shares(df: DataFrame, column: str, pattern: str | None) -> DataFrame:
    """Share of all rows that parse, and of those with a time of day, one row; unparsed rows count as having one."""
    at = parsed(F.col(f"`{column}`"), pattern)
    timed = F.coalesce((F.hour(at) != 0) | (F.minute(at) != 0) | (F.second(at) != 0), F.lit(True))
    return df.agg(F.avg(at.isNotNull().cast("int")).alias("valid_ratio"), F.avg(timed.cast("int")).alias("has_time_ratio"))


def flip_date_time(df: DataFrame, column: str | None, pattern: str | None, protected: Sequence[str] = ()) -> DataFrame:
    """Dates with times lose them, dates without get midnight, as text; unparsed become null.

    Nothing happens if less than half of all rows parse. Rows that do not parse count as
    having a time when more than 0.2 are asked for. Without a pattern texts are read as
    dates and times in the ISO order.
    """
    if not _usable(df, column, protected):
        return df
    at, shares = parsed(F.col(f"`{column}`"), pattern), date_shares(df, column, pattern).first()
    if (shares["valid_ratio"] or 0.0) < 0.5:
        return df
    return df.withColumn(column, F.date_format(at, "yyyy-MM-dd") if shares["has_time_ratio"] > 0.2 else F.date_format(at, "yyyy-MM-dd 00:00:00"))


def split_date(df: DataFrame, column: str | None, pattern: str | None, protected: Sequence[str] = ()) -> DataFrame:
    """Add year, month and day of a date column, which stays; nothing if less than half of the rows parse."""
    if not _usable(df, column, protected):
        return df
    at = parsed(F.col(f"`{column}`"), pattern)
    if (date_shares(df, column, pattern).first()["valid_ratio"] or 0.0) < 0.5:
        return df
    return df.withColumns({f"{column}_year": F.year(at), f"{column}_month": F.month(at), f"{column}_day": F.dayofmonth(at)})


def numeric_candidate(df: DataFrame, row_key: str, protected: Sequence[str] = ()) -> str | None:
    """The first text column whose first 300 values mostly read as numbers; the driver sees a row per text column."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = numeric_like(first_values(df, row_key, texts, 300), protected).filter("picked").first() if texts else None
    return found["column"] if found else None


def to_numeric(df: DataFrame, column: str | None, protected: Sequence[str] = ()) -> DataFrame:
    """The text column as numbers, null where it does not read as one."""
    return df.withColumn(column, number(F.col(f"`{column}`"))) if _usable(df, column, protected) else df


def unit_scale(df: DataFrame, column: str | None, divisor: float, protected: Sequence[str] = ()) -> DataFrame:
    """A number column over ``divisor``."""
    if not _usable(df, column, protected) or column not in numeric_columns(df):
        return df
    return df.withColumn(column, F.col(f"`{column}`") / F.lit(float(divisor)))


def collapse_categories(df: DataFrame, column: str | None, k: int, row_id: str, protected: Sequence[str] = ()) -> DataFrame:
    """Keep the ``k`` most frequent values, the one that appears first on ties; all else, nulls too, is 'Other'.

    A column without values stays as it is. The kept values are ``k`` rows, which bounds the broadcast.
    """
    filled = F.col(f"`{column}`").isNotNull()
    if not _usable(df, column, protected) or df.filter(filled).isEmpty():
        return df
    text = F.col(f"`{column}`").cast("string")
    kept = df.filter(filled).groupBy(text.alias("_kept")).agg(F.count("*").alias("n"), F.min(F.col(f"`{row_id}`")).alias("first"))
    kept = kept.orderBy(F.desc("n"), "first", "_kept").limit(k).select("_kept")
    return df.join(F.broadcast(kept), text == F.col("_kept"), "left").withColumn(column, F.coalesce("_kept", F.lit("Other"))).drop("_kept")


def _norm(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def address_parts(names: Sequence[str], base: str | None = None) -> dict[str, str]:
    """Which column is which part of an address.

    A base column ``prefix_...`` claims the parts with its prefix and is the street; what is
    still open takes the generic names, and then the parts of the ``<prefix>_city`` group
    with most parts, if that has two.
    """
    known = {_norm(n): n for n in names}
    first = lambda wanted: next((known[_norm(w)] for w in wanted if _norm(w) in known), None)
    found: dict[str, str | None] = dict.fromkeys(GENERIC_PARTS)
    if base and "_" in base:
        prefix = base.split("_")[0]
        for part in ("city", "state", "country"):
            found[part] = first([f"{prefix}_{part}"])
        found["zip"] = first([f"{prefix}_{z}" for z in ZIP_NAMES])
        found["street"] = base if base in names else None
    placed = found["state"] or found["region"]
    for part, wanted in GENERIC_PARTS.items():
        if found[part] is None and not (part in ("state", "region") and placed):
            found[part] = first(wanted)
    best: dict[str, str | None] = {}
    for city in (n for n in names if _norm(n).endswith("city") and "_" in n):
        prefix = city.rsplit("_", 1)[0]
        group = {part: first([f"{prefix}_{w}" for w in wanted]) for part, wanted in GROUP_PARTS.items()} | {"city": city}
        count = lambda g: sum(bool(g.get(p)) for p in ("city", "state", "zip", "country", "street"))
        if count(group) > count(best):
            best = group
    if sum(bool(best.get(p)) for p in ("city", "state", "zip", "country", "street")) >= 2:
        for part, name in best.items():
            found[part] = found[part] or name
    return {p: n for p, n in found.items() if n}


def _clean(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def evolve_address(df: DataFrame, base: str | None = None, protected: Sequence[str] = ()) -> DataFrame:
    """Combine address parts into one column and drop them, or split a free-text address.

    With a street and a place part, or two place parts, the parts are joined as street,
    city, state (else region), zip, country; empty ones are skipped and nothing at all is
    null. Otherwise an address text of which more than 0.2 have a comma, else a bar, is cut
    into at most three parts and dropped.
    """
    if base and base in protected:
        return df
    parts = address_parts(df.columns, base if base in df.columns else None)
    places = [parts[p] for p in ("city", "state", "region", "zip", "country") if p in parts]
    if ("street" in parts and places) or len(places) >= 2:
        used = [parts.get("street"), parts.get("city"), parts.get("state") or parts.get("region"), parts.get("zip"), parts.get("country")]
        full = F.concat_ws(", ", *(_clean(df, c) for c in used if c))
        full = F.regexp_replace(F.regexp_replace(full, r"^\s*,\s*", ""), r"\s*,\s*$", "")
        name = f"{parts.get('street') or 'address'}_full_address"
        return df.withColumn(name, F.when(full != "", full)).drop(*(c for c in parts.values() if c != name))
    text = base if base in df.columns else parts.get("street")
    if not text:
        return df
    value = F.col(f"`{text}`").cast("string")
    shares = df.agg(F.avg(value.contains(",").cast("int")).alias("comma"), F.avg(value.contains("|").cast("int")).alias("bar")).first()
    sign = "," if (shares["comma"] or 0) > 0.2 else r"\|" if (shares["bar"] or 0) > 0.2 else None
    if sign is None:
        return df
    cut = F.split(F.trim(value), sign, 3)
    piece = lambda i: F.when(F.trim(F.get(cut, F.lit(i))) != "", F.trim(F.get(cut, F.lit(i))))
    return df.withColumns({f"{text}_{p}": piece(i) for i, p in enumerate(("street", "city", "region"))}).drop(text)


def evolve(df: DataFrame, ops: Sequence[str], plan: Mapping, row_key: str, protected: Sequence[str] = ()) -> DataFrame:
    """Apply the named operators in order, all with the columns and knobs of one plan."""
    for op in ops:
        if op == "add":
            df = add_columns(df, plan["seed"], row_key)
        elif op == "rename":
            df = rename_column(df, plan["rename_col"], protected)
        elif op == "drop":
            df = drop_column(df, plan["drop_col"], protected)
        elif op == "type":
            turn = flip_date_time if plan["datetime_rule"] == "flip_date_time" else split_date
            df = turn(df, plan.get("datetime_col"), plan.get("datetime_format"), protected)
            df = to_numeric(df, numeric_candidate(df, row_key, protected), protected)
        elif op == "meaning":
            df = unit_scale(df, plan["meaning_num_col"], plan["unit_scale_divisor"], protected)
            df = collapse_categories(df, plan["meaning_cat_col"], plan["category_keep_topk"], row_key, protected)
        elif op == "address_split":
            df = evolve_address(df, plan["address_col"], protected)
        else:
            raise ValueError(f"no operator {op!r}")
    return df


INFO = (
    "op string, rule string, column string, note string, valid_ratio double, has_time_ratio double, before_ratio double, after_ratio double, "
    "mean_before double, mean_after double, cardinality_before bigint, cardinality_after bigint, mapped_to_other_ratio double"
)


def _info(stats: DataFrame, op: str, rule: str | Column | None, column: str | None, note: str | Column | None = None) -> DataFrame:
    """One row of op infos: names and, where ``stats`` has them, figures of the data."""
    names = [f.split()[0] for f in INFO.split(", ")]
    kinds = dict(f.split() for f in INFO.split(", "))
    given = {"op": op, "rule": rule, "column": column, "note": note}
    value = lambda n: (given[n] if isinstance(given[n], Column) else F.lit(given[n])) if n in given else F.col(n) if n in stats.columns else F.lit(None)
    return stats.select(*(value(n).cast(kinds[n]).alias(n) for n in names))


def op_infos(df: DataFrame, op: str, plan: Mapping, row_key: str, protected: Sequence[str] = ()) -> DataFrame:
    """What ``op`` would do with ``df``, one row per change or reason for none (columns: ``INFO``).

    Names come from plan and schema. Figures are one-row aggregates of the data: shares
    of dates that parse and have a time, shares of nulls before and after a cast, means before and
    after a rescale, distinct values before and after a collapse and the share of rows it maps to 'Other'.
    """
    spark, rows = df.sparkSession, []
    nothing = spark.range(1)
    skip = lambda c: "protected or missing in the plan" if not c or c in protected else "not in this table" if c not in df.columns else None
    if op == "add":
        chance = hash_number(F.concat_ws(":", F.lit(str(plan["seed"])), F.col(f"`{row_key}`").cast("string"))) / F.lit(4294967296.0)
        rows.append(_info(df.agg(F.avg((chance < 0.2).cast("int")).alias("after_ratio")), op, "sparse", "__new_sparse"))
    elif op in ("rename", "drop"):
        c = plan.get(f"{op}_col")
        note = skip(c) or ("too few columns" if op == "drop" and len(df.columns) <= 2 else None)
        rows.append(_info(nothing, op, None if note else op, c, note))
    elif op == "type":
        c, pattern = plan.get("datetime_col"), plan.get("datetime_format")
        if not skip(c):
            poor = F.coalesce("valid_ratio", F.lit(0.0)) < 0.5
            flip = F.when(F.col("has_time_ratio") > 0.2, "datetime_to_date").otherwise("date_to_datetime") if plan["datetime_rule"] == "flip_date_time" else F.lit("add_date_parts")
            rows.append(_info(date_shares(df, c, pattern), op, F.when(~poor, flip), c, F.when(poor, "few dates parse")))
            turned = flip_date_time if plan["datetime_rule"] == "flip_date_time" else split_date
            df = turned(df, c, pattern, protected)
        n = numeric_candidate(df, row_key, protected)
        if n:
            x = F.col(f"`{n}`")
            nulls = lambda v: F.avg(v.isNull().cast("int"))
            rows.append(_info(df.agg(nulls(x).alias("before_ratio"), nulls(number(x)).alias("after_ratio")), op, "to_numeric", n))
    elif op == "meaning":
        c, k = plan.get("meaning_num_col"), plan.get("meaning_cat_col")
        if not skip(c) and c in numeric_columns(df):
            means = df.agg(F.avg(F.col(f"`{c}`")).alias("mean_before"), F.avg(F.col(f"`{c}`") / F.lit(float(plan["unit_scale_divisor"]))).alias("mean_after"))
            rows.append(_info(means, op, f"divide_by_{plan['unit_scale_divisor']:g}", c))
            df = unit_scale(df, c, plan["unit_scale_divisor"], protected)
        if not skip(k):
            figures = _collapse_figures(df, k, plan["category_keep_topk"], row_key).filter("cardinality_before > 0")
            rows.append(_info(figures, op, f"keep_top{plan['category_keep_topk']}_else_Other", k))
    elif op == "address_split":
        c = plan.get("address_col")
        done = [] if c and c in protected else sorted(set(df.columns) - set(evolve_address(df, c, protected).columns))
        note = "protected" if c and c in protected else None if done else "nothing to combine or split"
        rows.append(_info(nothing, op, ("split" if len(done) == 1 else "combine") if done else None, ",".join(done) or None, note))
    else:
        raise ValueError(f"no operator {op!r}")
    out = spark.createDataFrame([], INFO)
    for r in rows:
        out = out.unionByName(r)
    return out


def _collapse_figures(df: DataFrame, column: str, k: int, row_id: str) -> DataFrame:
    """Distinct values before and after a collapse to ``k``, and the share of all rows whose value goes; nulls do not count there.

    The values are ranked by count from one row each; the ``k`` largest are a bounded sort.
    """
    text = F.col(f"`{column}`").cast("string")
    counts = df.groupBy(text.alias("v")).agg(F.count("*").alias("n"), F.min(F.col(f"`{row_id}`")).alias("first"))
    kept = counts.filter("v IS NOT NULL").orderBy(F.desc("n"), "first", "v").limit(k).agg(F.sum("n").alias("kept"), F.count("*").alias("stay"), F.count_if(F.col("v") == "Other").alias("named"))
    whole = counts.agg(F.sum("n").alias("rows"), F.count("v").alias("cardinality_before"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("filled"))
    both = whole.crossJoin(kept)  # one row each
    other = (F.coalesce("kept", F.lit(0)) < F.col("rows")) & (F.col("named") == 0)
    return both.select(
        "cardinality_before",
        (F.col("stay") + other.cast("int")).alias("cardinality_after"),
        ((F.coalesce("filled", F.lit(0)) - F.coalesce("kept", F.lit(0))) / F.col("rows")).alias("mapped_to_other_ratio"),
    )


def evolve_log(df: DataFrame, ops: Sequence[str], plan: Mapping, row_key: str, protected: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The table that the operators make in order, and their infos with step numbers."""
    log = None
    for i, op in enumerate(ops):
        one = op_infos(df, op, plan, row_key, protected).select(F.lit(i).alias("step"), "*")
        log = one if log is None else log.unionByName(one)
        df = evolve(df, [op], plan, row_key, protected)
    return df, log


def batch_summary(files: DataFrame) -> DataFrame:
    """Status of each task of a variant run. Input: task_id, role, label, done, broken, one row per file.

    A finished task is skipped_resume_exists; else one without target file is
    skipped_no_target, one without training and test files skipped_no_train_test; else it
    failed if any file broke, and is ok otherwise. Skipped and failed tasks show no label.
    """
    has = lambda r: F.count_if(F.col("role") == r)
    out = files.groupBy("task_id").agg(
        has("training").alias("n_training_files"), has("test").alias("n_test_files"), (has("target") > 0).alias("target_present"),
        F.max("label").alias("label_col"), F.max("done").alias("done"), F.max("broken").alias("broken"),
    )
    status = (
        F.when(F.col("done"), "skipped_resume_exists").when(~F.col("target_present"), "skipped_no_target")
        .when((F.col("n_training_files") == 0) & (F.col("n_test_files") == 0), "skipped_no_train_test").when(F.col("broken"), "failed").otherwise("ok")
    )
    return out.withColumn("status", status).withColumn("label_col", F.when(F.col("status") == "ok", F.col("label_col"))).drop("done", "broken")
