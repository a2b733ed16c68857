"""Relations between tables: keys, relationship types, child aggregation and joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabdrift.functions.numbers import two_digits
from tabdrift.functions.stored import written

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: What a step log says.
SKIP, AGGREGATE, MERGE, NO_KEY, UNSAFE = "skip", "aggregate_then_merge", "safe_left_merge", "no_common_key_with_base", "many_to_many_unsafe"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def is_id_like(name: Column) -> Column:
    """Whether a column name looks like an identifier: id, key, uid, *_id, or a short name with 'id' in it."""
    n = F.lower(name)
    return n.isin("id", "key", "uid") | n.endswith("_id") | (n.contains("id") & (F.length(n) <= 12))


def is_bad_name(name: Column) -> Column:
    """Blank names, Unnamed*, and the names Spark gives to blank headers."""
    return (F.trim(name) == "") | F.lower(F.trim(name)).startswith("unnamed") | name.rlike(r"^_c\d+$")


def cells(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All cells of the tables: table, table_idx, ordinal, column, value (text)."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        one = df.select(*(F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(df.columns)))
        names = F.array(*(F.lit(c) for c in df.columns))
        long = one.unpivot([], [f"c{k}" for k in range(len(df.columns))], "slot", "value")
        ordinal = F.substring("slot", 2, 9).cast("int")
        long = long.select(F.lit(name).alias("table"), F.lit(i).alias("table_idx"), ordinal.alias("ordinal"), F.get(names, ordinal).alias("column"), "value")
        out = long if out is None else out.unionByName(long)
    return out


def column_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, all-null ones too: table, table_idx, ordinal, column, and the table's n_rows.

    Names come from the schemas; of the tables only the rows are counted, which reads no column. All tables
    are counted by one aggregation.
    """
    found = list(tables.items())
    rows = found[0][1].sparkSession.range(len(found)).select(F.col("id").cast("int").alias("table_idx"), F.lit(0).alias("n"))
    for i, (_, df) in enumerate(found):
        rows = rows.unionByName(df.select(F.lit(i).alias("table_idx"), F.lit(1).alias("n")))
    named = F.array(*(F.struct(F.lit(t).alias("table"), F.array(*(F.lit(c) for c in df.columns)).cast("array<string>").alias("columns")) for t, df in found))
    out = rows.groupBy("table_idx").agg(F.sum("n").alias("n_rows")).withColumn("_t", F.get(named, F.col("table_idx")))
    return out.select(F.col("_t.table").alias("table"), "table_idx", "n_rows", F.posexplode("_t.columns").alias("ordinal", "column")).select(
        "table", "table_idx", "ordinal", "column", "n_rows"
    )


def column_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: n_rows, n_null and n_distinct (of non-null values).

    Cells collapse to distinct values with their counts first, so a count over many
    columns is one shuffle and a hot value is one row. Names join the counts, and are not moved with the values. Best
    written where it is read more than once.
    """
    by = ["table_idx", "ordinal"]
    values = cells(tables).groupBy(*by, "value").agg(F.count("*").alias("n"))
    out = values.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
    )
    named = F.array(*(F.struct(F.lit(t).alias("table"), F.array(*(F.lit(c) for c in df.columns)).cast("array<string>").alias("columns")) for t, df in tables.items()))
    at = F.get(named, F.col("table_idx"))
    return out.select(at["table"].alias("table"), "table_idx", "ordinal", F.get(at["columns"], F.col("ordinal")).alias("column"), "n_rows", "n_null", "n_distinct")


def shared_columns(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with only those columns that another table has too, which alone can be keys."""
    often = Counter(c for df in tables.values() for c in df.columns)
    kept = {t: [c for c in df.columns if often[c] > 1] for t, df in tables.items()}
    return {t: df.select(*(F.col(f"`{c}`") for c in kept[t])) for t, df in tables.items() if kept[t]}


def join_keys(columns: DataFrame, min_tables: int = 2) -> DataFrame:
    """Column names that occur in at least ``min_tables`` tables of a task (task_id, table, column)."""
    good = columns.filter(~is_bad_name(F.col("column")))
    many = columns.groupBy("task_id").agg(F.count_distinct("table").alias("t")).filter("t >= 2").select("task_id")
    found = good.groupBy("task_id", "column").agg(F.count_distinct("table").alias("n_tables")).filter(F.col("n_tables") >= min_tables)
    return found.join(many, "task_id", "left_semi")


def best_keys(stats: DataFrame, pairs: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The join key of each pair (base, other), from column statistics.

    Common columns that look like identifiers are preferred; among the candidates the
    one with the largest of the smaller uniqueness of both sides wins, the first in the
    base table on ties. ``exclude`` names columns that must not be keys, such as the
    label. Pairs without a common column have a null key.
    """
    usable = stats.filter(~is_bad_name(F.col("column")) & ~F.col("column").isin(list(exclude)))
    uniq = F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1))
    side = lambda p, u: usable.select(F.col("table").alias(p), F.col("column"), F.col("ordinal").alias(f"{p}_ordinal"), uniq.alias(u))
    common = side("base", "ub").join(side("other", "uo"), "column").join(pairs, ["base", "other"], "left_semi")
    scored = common.withColumn("id_like", is_id_like(F.col("column")).cast("int")).withColumn("score", F.least("ub", "uo"))
    best = scored.groupBy("base", "other").agg(
        F.max_by(F.struct("column", "score"), F.struct("id_like", "score", -F.col("base_ordinal"))).alias("b")
    )
    return pairs.join(best, ["base", "other"], "left").select("base", "other", F.col("b.column").alias("key"), F.col("b.score").alias("score"))


def duplicate_rate(n_rows: Column, n_distinct: Column, n_null: Column) -> Column:
    """Share of rows whose key occurred before, null being one value; to two digits."""
    return two_digits(1 - F.try_divide(n_distinct + (n_null > 0).cast("int"), n_rows))


def relationship(base_dup: Column, other_dup: Column, empty: Column) -> Column:
    """Type of a relation by the two-digit duplicate rates of its key on both sides."""
    a, b = base_dup < 0.01, other_dup < 0.01
    return F.when(empty, "unknown").when(a & ~b, "one_to_many").when(a & b, "one_to_one").when(~a & b, "many_to_one").otherwise("many_to_many")


def relationships(stats: DataFrame, keyed: DataFrame) -> DataFrame:
    """Add base_dup, other_dup and relationship to rows (base, other, key)."""
    dup = duplicate_rate(F.col("n_rows"), F.col("n_distinct"), F.col("n_null"))
    side = lambda p: stats.select(F.col("table").alias(p), F.col("column").alias("key"), dup.alias(f"{p}_dup"), F.col("n_rows").alias(f"{p}_rows"))
    out = keyed.join(side("base"), ["base", "key"], "left").join(side("other"), ["other", "key"], "left")
    empty = (F.coalesce("base_rows", F.lit(0)) == 0) | (F.coalesce("other_rows", F.lit(0)) == 0)
    kind = F.when(F.col("key").isNotNull(), relationship(F.coalesce("base_dup", F.lit(1.0)), F.coalesce("other_dup", F.lit(1.0)), empty))
    return out.withColumn("relationship", kind).drop("base_rows", "other_rows")


def step_log(related: DataFrame) -> DataFrame:
    """What a feature build does with each other table, and why it skips one."""
    kind = F.col("relationship")
    action = F.when(F.col("key").isNull(), SKIP).when(kind == "one_to_many", AGGREGATE).when(kind.isin("one_to_one", "many_to_one"), MERGE).otherwise(SKIP)
    reason = F.when(F.col("key").isNull(), NO_KEY).when(action == SKIP, UNSAFE)
    return related.withColumn("action", action).withColumn("reason", reason)


def aggregate_child(child: DataFrame, key: str) -> DataFrame:
    """One row per key (a null key is a group): row count; mean, sample deviation, least and
    largest of numbers; distinct non-null count of texts. Other types are left out.

    Texts are counted as rows (key, column, value) that are made distinct once: counted beside the numbers they would copy
    all partial sums once a column, and once more.
    """
    aggs = [F.count("*").alias(f"__agg__{key}__row_count")]
    for c in numeric_columns(child):
        if c != key:
            x = F.col(f"`{c}`")
            aggs += [F.avg(x).alias(f"__agg__{c}__mean"), F.stddev_samp(x).alias(f"__agg__{c}__std"), F.min(x).alias(f"__agg__{c}__min"), F.max(x).alias(f"__agg__{c}__max")]
    texts = [f.name for f in child.schema if f.name != key and isinstance(f.dataType, T.StringType)]
    if not texts:
        return child.groupBy(F.col(f"`{key}`")).agg(*aggs)
    cells_ = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(texts)))
    k = F.col(f"`{key}`")
    values = child.select(k, F.explode(cells_).alias("s")).select(k, "s.*").distinct()
    kinds = values.groupBy(k).agg(*(F.count(F.when(F.col("i") == i, F.col("v"))).alias(f"__agg__{c}__nunique") for i, c in enumerate(texts)))
    return null_safe_left_join(child.groupBy(k).agg(*aggs), kinds, key)


def null_safe_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``, null matching null, keeping the left key.

    Other columns that both sides have come as name_x and name_y.
    """
    both = {c for c in right.columns if c != key and c in left.columns}
    left = left.withColumnsRenamed({c: f"{c}_x" for c in both})
    other = right.withColumnsRenamed({key: "_right_key"} | {c: f"{c}_y" for c in both})
    return left.join(other, F.col(f"`{key}`").eqNullSafe(F.col("_right_key")), "left").drop("_right_key")


def join_child(base: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Attach a one-to-many table: aggregate it per key, then join."""
    return null_safe_left_join(base, aggregate_child(child, key), key)


def join_parent(base: DataFrame, parent: DataFrame, key: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Attach the columns that ``base`` does not have yet from a table with a unique key."""
    fresh = [c for c in parent.columns if c != key and c not in base.columns and c not in exclude]
    return null_safe_left_join(base, parent.select(F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in fresh)), key)


def relational_features(base: DataFrame, others: Mapping[str, DataFrame], label: str, steps: Mapping[str, tuple[str | None, str | None]]) -> DataFrame:
    """The base table with what the other tables add, the label as ``y``.

    ``steps`` gives key and relationship of each other table. The label is neither a key
    nor taken from another table.
    """
    out = base.withColumnRenamed(label, "y")
    for name, df in others.items():
        key, kind = steps[name]
        if key is None or key == label:
            continue
        if kind == "one_to_many":
            out = join_child(out, df.drop(label), key)
        elif kind in ("one_to_one", "many_to_one"):
            out = join_parent(out, df, key, exclude=(label, "y"))
    return out


STEP_LOG = "step int, train_table string, test_table string, key string, relationship string, action string, reason string, n_added_cols int, status string"


def build_features(train: Mapping[str, DataFrame], test: Mapping[str, DataFrame], base: str, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of training and test rows from the tables of a task, and the log of the steps.

    Test tables are matched with training tables by ``match_tables``, the base by shared
    columns alone. Keys and relationships come from the training tables, a row per table in the driver. A
    child whose test table has lost the key gives null aggregates. Where a join has no key on the
    test side at all, the columns are null and the step's status is UNKNOWN_ERROR,
    as the run would have ended there; else it is ok.
    """
    spark, others = train[base].sparkSession, [t for t in train if t != base]
    stats = written(column_stats(shared_columns({t: train[t] for t in (base, *others)})), "stats")
    pairs = spark.createDataFrame([(base, t) for t in others], "base string, other string") if others else None
    found = {r["other"]: (r["key"], r["relationship"]) for r in relationships(stats, best_keys(stats, pairs, [label])).collect()} if others else {}
    shared = lambda t, u: len(set(train[t].columns) & set(test[u].columns))
    largest = lambda t: max(test, key=lambda u: shared(t, u))
    x_train, x_test, log = train[base].withColumnRenamed(label, "y"), test[largest(base)].drop(label), []
    for i, name in enumerate(others):
        key, kind = found[name]
        named = name.replace("training_", "test_")
        partner = named if named in test else largest(name)
        df, other = train[name].drop(label), test[partner].drop(label)
        if key is None or kind not in ("one_to_many", "one_to_one", "many_to_one"):
            log.append((i, name, partner, key, kind, SKIP, NO_KEY if key is None else UNSAFE, 0, "ok"))
            continue
        before, child = x_train.columns, kind == "one_to_many"
        x_train = join_child(x_train, df, key) if child else join_parent(x_train, df, key, exclude=("y",))
        added = [f for f in x_train.schema if f.name not in before]
        status = "ok" if key in x_test.columns and (child or key in other.columns) else "UNKNOWN_ERROR"
        if status == "ok" and key in other.columns:
            if not child:
                other = other.select(F.col(f"`{key}`"), *(F.col(f"`{f.name}`") for f in added if f.name in other.columns and f.name not in x_test.columns))
            x_test = join_child(x_test, other, key) if child else null_safe_left_join(x_test, other, key)
        else:
            x_test = x_test.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added if f.name not in x_test.columns})
        log.append((i, name, partner, key, kind, AGGREGATE if child else MERGE, None, len(added), status))
    return x_train, x_test, spark.createDataFrame(log, STEP_LOG)


def match_tables(train: DataFrame, test: DataFrame) -> DataFrame:
    """The test table of each training table: the one named alike (training_i, test_i), else
    the one that shares most columns, the first on ties. Inputs: table, table_idx, column."""
    a = train.select(F.col("table").alias("train_table"), "column")
    b = test.select(F.col("table").alias("test_table"), F.col("table_idx").alias("i"), "column")
    overlap = a.join(b, "column").groupBy("train_table", "test_table", "i").agg(F.count("*").alias("overlap"))
    named = (F.regexp_replace("train_table", "^training_", "test_") == F.col("test_table")).cast("int")
    best = overlap.groupBy("train_table").agg(F.max_by(F.struct("test_table", "overlap"), F.struct(named, "overlap", -F.col("i"))).alias("m"))
    return train.select(F.col("table").alias("train_table")).distinct().join(best, "train_table", "left").select(
        "train_table", F.col("m.test_table").alias("test_table"), F.col("m.overlap").alias("overlap")
    )


def join_expansion(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Mean matches a left row finds, at least 1 each, over all left rows; from counts per key only."""
    a = left.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count("*").alias("n"))
    b = right.groupBy(F.col(f"`{key}`").alias("k2")).agg(F.count("*").alias("m"))
    both = a.join(b, a["k"].eqNullSafe(b["k2"]), "left")
    mean = F.sum(F.col("n") * F.greatest(F.coalesce("m", F.lit(1)), F.lit(1))) / F.sum("n")
    return both.agg(two_digits(mean).alias("expansion"))


def join_chain(tables: Mapping[str, DataFrame], most: float = 5.0) -> tuple[DataFrame | None, str | None]:
    """All tables joined from the left, each by its best key with what is joined so far.

    Before a join its expansion and both duplicate rates are computed from counts; where
    ``guarded`` forbids it the chain ends with the reason and no table.
    """
    (_, out), *rest = tables.items()
    for _, df in rest:
        common = [c for c in out.columns if c in df.columns]
        if not common:
            return None, "no common columns"
        pick = lambda t: t.select(*(F.col(f"`{c}`") for c in common))  # noqa: B023, E731
        stats = written(column_stats({"left": pick(out), "right": pick(df)}), "stats")
        keyed = best_keys(stats, out.sparkSession.createDataFrame([("left", "right")], "base string, other string"))
        key = keyed.first()["key"]
        if key is None:
            return None, "no common columns"
        grown = join_expansion(out, df, key).select(F.lit("left").alias("base"), F.lit("right").alias("other"), "expansion")
        error = guarded(stats, keyed, grown, most).first()["error"]
        if error:
            return None, error
        out = null_safe_left_join(out, df, key)
    return out, None


def guarded(stats: DataFrame, keyed: DataFrame, expansions: DataFrame, most: float = 5.0) -> DataFrame:
    """Whether a left join of each pair may run: not with an expansion above ``most`` nor with both keys repeated."""
    out = relationships(stats, keyed).join(expansions, ["base", "other"], "left")
    verdict = F.when(F.col("key").isNull(), "no common columns").when(F.col("expansion") > most, "join expansion").when(
        (F.col("base_dup") > 0.01) & (F.col("other_dup") > 0.01), "many-to-many"
    )
    return out.withColumn("error", verdict).withColumn("allowed", verdict.isNull())
