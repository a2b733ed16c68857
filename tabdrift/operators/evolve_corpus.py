"""Evolution of a whole corpus in one job: the plans of all tasks joined to the long cells of all tables.

Cells are task_id, role, table_idx, row_id, ordinal, column, value (text), a cell for every column of
a row. What an operator does to a table is what ``evolve`` does to it when it stands alone; here the
plan is data, so tasks differ in what happens to them and not in the jobs they cost. New columns come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabdrift.functions.dates import EVOLVE_FORMATS, parsed, pick_format
from tabdrift.functions.numbers import NUMBER, number
from tabdrift.functions.stored import is_small, written
from tabdrift.operators.evolve import address_parts, batch_summary, hash_number
from tabdrift.operators.evolve import plans as build_plans
from tabdrift.operators.profile import LABEL_PRIORITY, NUMERIC_LIKE, label_name_first, schema_diff
from tabdrift.sources import corpus

TABLE = ["task_id", "role", "table_idx"]
CELL = [*TABLE, "row_id", "ordinal", "column", "value"]
#: First values of a column that tell whether it reads as numbers.
FIRST = 300
#: Most plans, or facts of one row a table, that are broadcast to the cells. More are shuffled, though their files may be as small as those
#: that Spark broadcasts unasked.
BROADCAST_ROWS = 600_000


def _with(cells: DataFrame, part: DataFrame, by: Sequence[str] = TABLE, how: str = "inner") -> DataFrame:
    """``cells`` with the columns of ``part`` for the same table; a null number is a number."""
    other = part.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "table_idx" else F.col(c) == F.col(f"_{c}"))
    return cells.join(other, same, how).drop(*(f"_{c}" for c in by))


def _told(cells: DataFrame, hit: Column, facts: DataFrame, name: str) -> DataFrame:
    """``cells`` with the ``facts`` of their table, one row a table, where they are ``hit``; other cells may have them or nulls.

    Cells stay where they are; where there are too many facts to broadcast, those that are hit move.
    """
    facts = written(facts, name)
    if is_small(facts, BROADCAST_ROWS):
        return _with(cells, F.broadcast(facts), how="left")
    return _with(cells.filter(hit), facts.hint("merge"), how="left").unionByName(cells.filter(~hit), allowMissingColumns=True)


def _planned(cells: DataFrame, plans: DataFrame, *fields: str) -> DataFrame:
    return cells.join(plans.select("task_id", "label_col", *fields), "task_id", "left")


def _hit(field: str) -> Column:
    """Whether a cell is of the column that the plan names, and that is not the protected label."""
    return F.coalesce((F.col("column") == F.col(field)) & ~F.col("column").eqNullSafe(F.col("label_col")), F.lit(False))


def _new(rows: DataFrame, widths: DataFrame, columns: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Cells of new columns (name, value) for ``rows``, after the last column of their table."""
    parts = F.posexplode(F.array(*(F.struct(n.alias("column"), v.cast("string").alias("value")) for n, v in columns)))
    out = _with(rows, widths).select(*TABLE, "row_id", "last", parts.alias("i", "c"))
    return out.select(*TABLE, "row_id", (F.col("last") + 1 + F.col("i")).alias("ordinal"), "c.column", "c.value")


def _widths(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*TABLE).agg(F.max("ordinal").alias("last"), F.count_distinct("column").alias("n_cols"))


def add(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """A constant, a number in a fifth of the rows by a hash of seed and row, and the row's number."""
    rows = _planned(cells.select(*TABLE, "row_id").distinct(), plans, "seed")
    chance = hash_number(F.concat_ws(":", F.col("seed").cast("string"), F.col("row_id").cast("string"))) / F.lit(4294967296.0)
    named = [(F.lit("__new_constant"), F.lit("unknown")), (F.lit("__new_sparse"), F.when(chance < 0.2, F.lit("1.0"))), (F.lit("__row_id"), F.col("row_id"))]
    return cells.select(*CELL).unionByName(_new(rows, _widths(cells), named))


def rename(cells: DataFrame, plans: DataFrame) -> DataFrame:
    planned = _planned(cells, plans, "rename_col")
    return planned.withColumn("column", F.when(_hit("rename_col"), F.concat("column", F.lit("__renamed"))).otherwise(F.col("column"))).select(*CELL)


def drop(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """Without the planned column, where the table has more than two."""
    narrow = _widths(cells).filter("n_cols <= 2").select(*TABLE, F.lit(True).alias("narrow"))
    planned = _told(_planned(cells, plans, "drop_col"), _hit("drop_col"), narrow, "evc-narrow")
    return planned.filter(~_hit("drop_col") | F.col("narrow").isNotNull()).select(*CELL)


def _parsed(value: Column, pattern: str) -> Column:
    """By the row's own pattern, or in the ISO order where it has none."""
    by = F.coalesce(*(F.when(F.col(pattern) == f, parsed(value, f)) for f in EVOLVE_FORMATS))
    return F.when(F.col(pattern).isNull(), parsed(value, None)).otherwise(by)


def retype(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """Dates lose or gain a time or give their parts, as the plan says and if half of all rows parse; then the first text
    column that mostly reads as numbers becomes numbers."""
    cells = written(cells, "evc-type")
    planned = _planned(cells, plans, "datetime_col", "datetime_format", "datetime_rule")
    at = _parsed(F.col("value"), "datetime_format")
    dated = written(planned.filter(_hit("datetime_col")).withColumn("at", at).drop("label_col"), "evc-dates")
    timed = F.coalesce((F.hour("at") != 0) | (F.minute("at") != 0) | (F.second("at") != 0), F.lit(True))
    shares = dated.groupBy(*TABLE).agg(F.avg(F.col("at").isNotNull().cast("int")).alias("ok"), F.avg(timed.cast("int")).alias("timed"), F.first("datetime_rule").alias("rule"), F.first("column").alias("dated"))
    shares = shares.filter("ok >= 0.5")
    flips, splits = shares.filter("rule = 'flip_date_time'"), shares.filter("rule <> 'flip_date_time'")
    flipped = _with(cells, flips.select(*TABLE, "dated", "timed", F.lit(True).alias("flip")), how="left").withColumn("_hit", F.coalesce(F.col("flip") & (F.col("column") == F.col("dated")), F.lit(False)))
    again = _with(dated, flips.select(*TABLE, "timed")).select(*TABLE, "row_id", F.when(F.col("timed") > 0.2, F.date_format("at", "yyyy-MM-dd")).otherwise(F.date_format("at", "yyyy-MM-dd 00:00:00")).alias("text"))
    out = _with(flipped, again, [*TABLE, "row_id"], "left").withColumn("value", F.when(F.col("_hit"), F.col("text")).otherwise(F.col("value"))).select(*CELL)
    name = lambda p: F.concat("dated", F.lit(f"_{p}"))
    parts = [(name("year"), F.year("at")), (name("month"), F.month("at")), (name("day"), F.dayofmonth("at"))]
    out = written(out.unionByName(_new(_with(dated, splits.select(*TABLE, "dated")), _widths(cells), parts)), "evc-typed")
    return _first_numbers(out, plans)


def _first_numbers(cells: DataFrame, plans: DataFrame) -> DataFrame:
    texts = cells.groupBy(*TABLE, "ordinal", "column").agg((F.count("value") > F.count(number(F.col("value")))).alias("text"))
    place = F.row_number().over(Window.partitionBy(*TABLE, "ordinal").orderBy("row_id"))
    first = _with(cells.filter("value IS NOT NULL"), texts.filter("text").select(*TABLE, "ordinal"), [*TABLE, "ordinal"]).withColumn("_r", place).filter(F.col("_r") <= FIRST)
    shares = first.groupBy(*TABLE, "ordinal", "column").agg(F.avg(F.col("value").rlike(NUMERIC_LIKE).cast("int")).alias("share")).filter("share > 0.7")
    shares = shares.join(plans.select("task_id", "label_col"), "task_id", "left").filter(~F.col("column").startswith("__") & ~F.col("column").eqNullSafe(F.col("label_col")))
    picked = shares.groupBy(*TABLE).agg(F.min("ordinal").alias("picked"))
    out = _with(cells, picked, how="left")
    return out.withColumn("value", F.when(F.col("ordinal") == F.col("picked"), number(F.col("value")).cast("string")).otherwise(F.col("value"))).select(*CELL)


def rescale(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """A number column over its divisor, where all its values are numbers; then the categories of another are collapsed to the most frequent."""
    planned = _planned(cells, plans, "meaning_num_col", "unit_scale_divisor")
    texts = F.count("value") > F.count(number(F.col("value")))
    tables = planned.filter(_hit("meaning_num_col")).groupBy(*TABLE).agg(texts.alias("texts")).filter("texts")
    scaled = _told(planned, _hit("meaning_num_col"), tables, "evc-texts")
    scaled = scaled.withColumn("value", F.when(_hit("meaning_num_col") & F.col("texts").isNull(), (number(F.col("value")) / F.col("unit_scale_divisor")).cast("string")).otherwise(F.col("value")))
    cells = written(scaled.select(*CELL), "evc-scaled")
    planned = _planned(cells, plans, "meaning_cat_col", "category_keep_topk")
    held = planned.filter(_hit("meaning_cat_col") & F.col("value").isNotNull())
    counts = held.groupBy(*TABLE, "value", "category_keep_topk").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    place = F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc("n"), "first", "value"))
    stays = F.when(F.col("_r") <= F.col("category_keep_topk"), F.col("value"))
    kept = counts.withColumn("_r", place).groupBy(*TABLE).agg(F.collect_list(stays).alias("kept"))
    out = _told(planned, _hit("meaning_cat_col"), kept, "evc-kept")
    other = F.col("kept").isNotNull() & ~F.coalesce(F.array_contains("kept", F.col("value")), F.lit(False))
    return out.withColumn("value", F.when(_hit("meaning_cat_col") & other, "Other").otherwise(F.col("value"))).select(*CELL)


def _text(numeric: Column) -> Column:
    """A cell as text, whole numbers without a fraction, blank ones null."""
    x = F.when(numeric & F.col("value").rlike(NUMBER), F.col("value").try_cast("double"))
    bare = F.trim(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.col("value")))
    return F.when(bare != "", bare)


def address(cells: DataFrame, plans: DataFrame) -> DataFrame:
    """Address parts combined into one column, or a free-text address split, table by table as ``evolve_address`` does it."""
    cells = written(cells, "evc-address")
    names = cells.select(*TABLE, "ordinal", "column").distinct().groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda c: c["column"]).alias("names"))
    find = F.udf(lambda names, base: address_parts(names, base if base in names else None), "map<string,string>")  # a row a table
    found = _planned(names, plans, "address_col").filter(F.col("address_col").isNull() | ~F.col("address_col").eqNullSafe(F.col("label_col")))
    found = found.withColumn("parts", find("names", "address_col"))
    has = lambda p: F.map_contains_key("parts", F.lit(p))
    places = sum((has(p).cast("int") for p in ("city", "state", "region", "zip", "country")), F.lit(0))
    found = written(found.withColumn("combine", (has("street") & (places > 0)) | (places >= 2)), "evc-parts")
    # combine: the used parts in their order, the state before the region
    part = F.explode(F.map_entries("parts"))
    mapped = found.filter("combine").select(*TABLE, F.concat(F.coalesce(F.try_element_at("parts", F.lit("street")), F.lit("address")), F.lit("_full_address")).alias("full"), has("state").alias("stated"), part.alias("e"))
    order = {"street": 0, "city": 1, "state": 2, "region": 2, "zip": 3, "country": 4}
    place = F.coalesce(*(F.when(F.col("e.key") == p, F.lit(i)) for p, i in order.items()))
    mapped = mapped.select(*TABLE, "full", F.col("e.value").alias("column"), F.when(~((F.col("e.key") == "region") & F.col("stated")), place).alias("place"))
    numeric = cells.groupBy(*TABLE, "column").agg((F.count("value") == F.count(number(F.col("value")))).alias("numeric"))
    used = _with(_with(cells, mapped, [*TABLE, "column"]), numeric, [*TABLE, "column"]).withColumn("text", _text(F.col("numeric")))
    whole = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["place"].isNotNull() & s["text"].isNotNull()), lambda s: s["text"]), ", ")
    full = used.groupBy(*TABLE, "row_id", "full").agg(whole.alias("made"))
    bare = F.regexp_replace(F.regexp_replace("made", r"^\s*,\s*", ""), r"\s*,\s*$", "")
    widths = _widths(cells)
    made = _new(full, widths, [(F.col("full"), F.when(bare != "", bare))])
    gone = mapped.select(*TABLE, "column", F.lit(True).alias("gone"))
    # split: a base column, or else a street, that has commas or else bars
    own = F.when(F.array_contains("names", F.col("address_col")), F.col("address_col")).otherwise(F.try_element_at("parts", F.lit("street")))
    texts = _with(cells, found.filter("NOT combine").select(*TABLE, own.alias("own"))).filter(F.col("column") == F.col("own"))
    shares = texts.groupBy(*TABLE, "own").agg(F.avg(F.col("value").contains(",").cast("int")).alias("comma"), F.avg(F.col("value").contains("|").cast("int")).alias("bar"))
    signs = shares.select(*TABLE, "own", F.when(F.col("comma") > 0.2, ",").when(F.col("bar") > 0.2, "|").alias("sign")).filter("sign IS NOT NULL")
    cut = F.when(F.col("sign") == ",", F.split(F.trim("value"), ",", 3)).otherwise(F.split(F.trim("value"), r"\|", 3))
    piece = lambda i: F.when(F.trim(F.get("cut", F.lit(i))) != "", F.trim(F.get("cut", F.lit(i))))
    pieces = _with(texts.drop("own"), signs).withColumn("cut", cut)
    split = _new(pieces, widths, [(F.concat("own", F.lit(f"_{p}")), piece(i)) for i, p in enumerate(("street", "city", "region"))])
    gone = gone.unionByName(signs.select(*TABLE, F.col("own").alias("column"), F.lit(True).alias("gone")))
    stay = _with(cells, gone, [*TABLE, "column"], "left").filter("gone IS NULL").select(*CELL)
    return stay.unionByName(made).unionByName(split)


OPS = {"add": add, "rename": rename, "drop": drop, "type": retype, "meaning": rescale, "address_split": address}


def evolve_corpus(cells: DataFrame, plans: DataFrame, ops: Sequence[str]) -> DataFrame:
    """All training and test tables of all tasks after the named operators, in order; targets are left out.

    ``plans`` has one row a task: task_id, seed, label_col (protected), and the columns and knobs of ``evolve.plans``. Tasks without a
    plan keep their tables.
    """
    out = cells.filter("role <> 'target'").select(*CELL)
    plans = written(plans, "evc-plan")
    plans = F.broadcast(plans) if is_small(plans, BROADCAST_ROWS) else plans.hint("merge")
    for op in ops:
        out = OPS[op](out, plans)
    return out


def corpus_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed in the schema of each table: task_id, role, table_idx, added, removed, dtype_changes. Inputs: ``column_types`` of both."""
    key = F.to_json(F.struct(*TABLE))
    named = lambda df: df.select(key.alias("table"), "column", "dtype")
    out = schema_diff(named(before), named(after))
    at = F.from_json("table", "task_id string, role string, table_idx int")
    return out.select(at.alias("t"), *(c for c in out.columns if c != "table")).select("t.*", *(c for c in out.columns if c != "table"))


def corpus_plans(cells: DataFrame, global_seed: int, labels: Sequence[str] = LABEL_PRIORITY) -> DataFrame:
    """A plan for each task from its training tables: the columns of ``evolve.plans``, and label_col, which is protected.

    The format of a date column is detected on the first values of each table, all formats in one pass.
    """
    train = cells.filter("role = 'training'")
    table = F.concat_ws("_", "role", F.col("table_idx").cast("string")).alias("table")
    columns = written(train.select("task_id", table, "table_idx", "ordinal", "column").distinct(), "evc-columns")
    label = label_name_first(columns, labels).select("task_id", F.col("label").alias("label_col"))
    low = F.lower("column")
    dated = train.filter((low.contains("date") | low.contains("time") | low.endswith("_dt")) & F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("task_id", "column").orderBy("table_idx", "row_id"))
    first = dated.withColumn("_r", place).filter(F.col("_r") <= FIRST)
    shares = first.groupBy("task_id", "column").agg(*(F.avg(parsed(F.col("value"), f).isNotNull().cast("int")).alias(f"s{i}") for i, f in enumerate(EVOLVE_FORMATS)))
    formats = shares.select("task_id", "column", pick_format({f: F.col(f"s{i}") for i, f in enumerate(EVOLVE_FORMATS)}).alias("format"))
    return build_plans(columns, global_seed, label.withColumnRenamed("label_col", "column"), formats=formats).join(label, "task_id", "left")


def evolve_files(spark: SparkSession, root: str, out: str, variant: str, ops: Sequence[str], global_seed: int) -> DataFrame:
    """Evolve the corpus of files under ``root`` into ``out``; one row per task as ``evolve.batch_summary`` tells it.

    Every task's training and test tables change by its plan, its target is copied byte for byte, and plan and log are written beside
    them, the log with the rows and the schema changes of each table. Without ``ops`` all files are copied. Tasks that are complete under
    ``out`` are skipped, so a run that was lost is taken up by running it again.
    """
    files = written(corpus.corpus_files(spark, root), "evc-files")
    done = written(corpus.completed(spark, out).filter(F.col("variant") == variant).select("task_id", F.lit(True).alias("done")), "evc-done")
    has = lambda r: F.max((F.col("role") == r).cast("int")) == 1
    able = files.groupBy("task_id").agg((has("target") & (has("training") | has("test"))).alias("able")).filter("able").select("task_id")
    todo = files.join(able, "task_id", "left_semi").join(done, "task_id", "left_anti")
    cells = written(corpus.file_cells(todo.filter("role <> 'target'")), "evc-cells")
    plan = written(corpus_plans(cells, global_seed), "evc-plans")
    if ops:
        changed = written(evolve_corpus(cells, plan, ops), "evc-changed")
        made = corpus.csv_files(changed, variant).unionByName(corpus.copied_files(todo.filter("role = 'target'"), variant))
        count = lambda df, n: df.groupBy(*TABLE).agg(F.count_distinct("row_id").alias(n))
        both = _with(_with(corpus_diff(corpus.column_types(cells), corpus.column_types(changed)), count(cells, "rows_before")), count(changed, "rows_after"))
        tables = both.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("role", "table_idx", "rows_before", "rows_after", "added", "removed"))).alias("files"))
    else:
        made = corpus.copied_files(todo, variant)
        tables = todo.select("task_id").distinct().withColumn("files", F.array().cast("array<string>"))
    names = F.array(*(F.lit(o) for o in ops or ["baseline"]))
    marks = todo.select("task_id").distinct().join(tables, "task_id", "left").join(plan, "task_id", "left").select(
        F.lit(variant).alias("variant"), "task_id",
        F.to_json(F.struct("task_id", names.alias("ops"), F.lit(global_seed).alias("global_seed"), *(F.col(c) for c in plan.columns if c != "task_id"))).alias("plan"),
        F.to_json(F.struct("task_id", names.alias("ops"), "files")).alias("log"),
    )
    corpus.write_files(made.unionByName(corpus.marker_files(marks)), out)
    told = files.join(done, "task_id", "left").join(plan.select("task_id", F.col("label_col").alias("label")), "task_id", "left")
    return batch_summary(told.select("task_id", "role", "label", F.coalesce("done", F.lit(False)).alias("done"), F.lit(False).alias("broken")))
