"""A corpus of files made from events: written by the sink, read back, catalogued, resumed and evolved."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabdrift.functions.numbers import number
from tabdrift.functions.stored import scratch_path, written
from tabdrift.operators import evolve_corpus
from tabdrift.plans.bindings import bound
from tabdrift.plans.registry import query
from tabdrift.sources import corpus, tables

#: A training and a test table for each user: texts with quotes, commas and line breaks, a column of the user's own name, numbers, dates, holes.
EVENTS = """SELECT concat('task_', user_id) AS task_id, user_id, event_id, event_type, value, substr(CAST(ts AS {text}), 1, 10) AS day, CASE WHEN event_id % 2 = 0 THEN 'training' ELSE 'test' END AS role,
CAST(row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS BIGINT) AS row_id FROM events"""
COLUMNS = [
    ("'id'", "CAST(event_id AS {text})"), ("'note'", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('say \"', event_type, ', ', event_id, '\"', chr(10), 'x') END"),
    ("concat('k', user_id % 3)", "CAST(user_id AS {text})"), ("'price'", "CAST(value AS {text})"), ("'kind'", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END"),
    ("'made'", "CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE day END"),
]
CELLS = "WITH e AS (" + EVENTS + ")\n" + "\nUNION ALL ".join(f"SELECT task_id, role, 0 AS table_idx, row_id, {i} AS ordinal, {name} AS col, {value} AS value FROM e" for i, (name, value) in enumerate(COLUMNS))


def _cells(spark, sf_dir):
    """The rows of ``CELLS``, all cells of an event made from it at once, as its row is numbered once."""
    made = ", ".join(f"struct({i} AS ordinal, {name} AS column, {value.format(text='STRING')} AS value)" for i, (name, value) in enumerate(COLUMNS))
    return bound(spark, sf_dir, EVENTS.format(text="STRING")).selectExpr("task_id", "role", "0 AS table_idx", "row_id", f"inline(array({made}))")


@query("io_corpus_cells", f'SELECT task_id, role, table_idx, row_id, ordinal, col AS "column", value FROM ({CELLS.format(text="VARCHAR")})')
def io_corpus_cells(spark, sf_dir):
    """All tables written as files, with headers of their own, and read back cell for cell."""
    root = scratch_path(spark, "corpus")
    corpus.write_files(corpus.csv_files(_cells(spark, sf_dir), "original"), root)
    return corpus.file_cells(corpus.corpus_files(spark, root))


BROKEN = "CASE WHEN user_id % 10 = 3 THEN 'bytes' WHEN user_id % 10 = 4 THEN 'empty' ELSE 'fine' END"


@query(
    "pr_file_catalog",
    f"""WITH u AS (SELECT DISTINCT concat('task_', user_id) AS task_id, user_id % 3 AS k, {BROKEN} AS state FROM events)
SELECT task_id, 'training_0.csv' AS file, CASE WHEN state = 'fine' THEN 3 END AS n_cols, CASE WHEN state = 'fine' THEN '["price","order","k' || k || '"]' END AS columns_json,
CASE WHEN state = 'fine' THEN 'sales' ELSE 'error' END AS domain_guess, CASE WHEN state = 'fine' THEN 2 ELSE 0 END AS domain_score,
CASE state WHEN 'bytes' THEN 'UnicodeDecodeError(''utf-8'')' WHEN 'empty' THEN 'StopIteration()' END AS error FROM u""",
)
def pr_file_catalog(spark, sf_dir):
    """Headers of files, some of them empty and some that are no text."""
    root = scratch_path(spark, "catalog")
    users = bound(spark, sf_dir, f"SELECT DISTINCT user_id, {BROKEN} AS state FROM events")
    head = F.concat(F.lit("price,order,k"), (F.col("user_id") % 3).cast("string"), F.lit("\n1,2,3\n")).cast("binary")
    content = F.when(F.col("state") == "fine", head).when(F.col("state") == "bytes", F.concat(F.unhex(F.lit("FF2C")), head)).otherwise(F.lit(bytearray()))
    corpus.write_files(users.select(F.lit("original").alias("variant"), F.concat(F.lit("task_"), "user_id").alias("task_id"), F.lit("training_0.csv").alias("name"), content.alias("content")), root)
    return corpus.file_catalog(corpus.corpus_files(spark, root))


@query("io_resume_files", "SELECT DISTINCT concat('task_', user_id) AS task_id FROM events WHERE user_id % 3 > 0")
def io_resume_files(spark, sf_dir):
    """Tasks that a run which resumes still has to do, by what it finds among the files of an earlier one."""
    root = scratch_path(spark, "resumed")
    tasks = bound(spark, sf_dir, "SELECT DISTINCT concat('task_', user_id) AS task_id, user_id FROM events")
    plan = F.to_json(F.struct("task_id", F.lit("rename").alias("ops")))
    corpus.write_files(corpus.marker_files(tasks.filter("user_id % 3 = 0").select(F.lit("rename").alias("variant"), "task_id", plan.alias("plan"), plan.alias("log"))), root)
    return tables.pending(tasks.select("task_id"), corpus.completed(spark, root).filter("variant = 'rename'"))


TARGET = "concat('row,', user_id, chr(10))"


@query(
    "io_baseline_copy",
    f"""WITH u AS (SELECT DISTINCT user_id, {TARGET} AS t FROM events) SELECT concat('task_', user_id) AS task_id, 'target.csv' AS name, CAST(strlen(t) AS BIGINT) AS size, sha1(t) AS sha1_head FROM u""",
)
def io_baseline_copy(spark, sf_dir):
    """Files that a baseline copies byte for byte, by their fingerprints at their new place."""
    root, out = scratch_path(spark, "original"), scratch_path(spark, "baseline")
    users = bound(spark, sf_dir, f"SELECT DISTINCT user_id, {TARGET} AS t FROM events")
    corpus.write_files(users.select(F.lit("original").alias("variant"), F.concat(F.lit("task_"), "user_id").alias("task_id"), F.lit("target.csv").alias("name"), F.col("t").cast("binary").alias("content")), root)
    corpus.write_files(corpus.copied_files(corpus.corpus_files(spark, root), "baseline"), out)
    marks = tables.fingerprints(corpus.corpus_files(spark, f"{out}/baseline").filter("role = 'target'"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)$", i)
    return marks.select(part(1).alias("task_id"), part(2).alias("name"), "size", "sha1_head")


SEEDED = "CAST(('0x' || substr(sha1({x}), 1, 8)) AS BIGINT)"


@query(
    "wf_evolve_corpus",
    f"""WITH e AS ({EVENTS.format(text="VARCHAR")}), s AS (SELECT *, {SEEDED.format(x="'7:' || task_id")} AS seed FROM e)
SELECT task_id, role, count(*) AS n_rows, {len(COLUMNS) + 3} AS n_columns, count(*) FILTER ({SEEDED.format(x="seed || ':' || row_id")} / 4294967296.0 < 0.2) AS n_sparse,
'ok' AS status, true AS complete FROM s GROUP BY task_id, role""",
)
def wf_evolve_corpus(spark, sf_dir):
    """A corpus of files evolved into files: original tables and targets written, all tasks evolved in one job, plan and log beside them."""
    root, out = scratch_path(spark, "original"), scratch_path(spark, "evolved")
    cells = _cells(spark, sf_dir)
    users = bound(spark, sf_dir, f"SELECT DISTINCT user_id, {TARGET} AS t FROM events")
    targets = users.select(F.lit("original").alias("variant"), F.concat(F.lit("task_"), "user_id").alias("task_id"), F.lit("target.csv").alias("name"), F.col("t").cast("binary").alias("content"))
    corpus.write_files(corpus.csv_files(cells, "original").unionByName(targets), root)
    summary = written(evolve_corpus.evolve_files(spark, f"{root}/original", out, "add", ["add"], 7), "summary")
    back = corpus.file_cells(corpus.corpus_files(spark, f"{out}/add").filter("role <> 'target'"))
    shown = back.groupBy("task_id", "role").agg(F.count_distinct("row_id").alias("n_rows"), F.count_distinct("column").cast("int").alias("n_columns"), F.count(F.when(F.col("column") == "__new_sparse", F.col("value"))).alias("n_sparse"))
    done = corpus.completed(spark, out).select("task_id", F.lit(True).alias("complete"))
    return shown.join(summary.select("task_id", "status"), "task_id").join(done, "task_id", "left")


#: One plan a task: what is dropped, by what is divided and which column is protected differ.
PLANS = """SELECT DISTINCT concat('task_', user_id) AS task_id, user_id AS seed, CASE WHEN user_id % 5 = 0 THEN 'kind' END AS label_col, 'note' AS rename_col, CASE WHEN user_id % 2 = 0 THEN 'id' ELSE 'nowhere' END AS drop_col,
'price' AS meaning_num_col, CASE WHEN user_id % 2 = 0 THEN 10.0D ELSE 1000.0D END AS unit_scale_divisor, 'kind' AS meaning_cat_col, 2 AS category_keep_topk FROM events"""


@query(
    "ev_corpus",
    f"""WITH c AS ({CELLS.format(text="VARCHAR")}), u AS (SELECT DISTINCT concat('task_', user_id) AS task_id, user_id FROM events),
n AS (SELECT task_id, role, value, count(*) AS n, min(row_id) AS f FROM c WHERE col = 'kind' AND value IS NOT NULL GROUP BY ALL),
top AS (SELECT task_id, role, value FROM (SELECT *, row_number() OVER (PARTITION BY task_id, role ORDER BY n DESC, f, value) AS r FROM n) WHERE r <= 2)
SELECT c.task_id, c.role, c.row_id, CASE WHEN col = 'note' THEN 'note__renamed' ELSE col END AS "column",
CASE WHEN col = 'price' THEN NULL WHEN col <> 'kind' OR user_id % 5 = 0 THEN c.value WHEN top.value IS NOT NULL THEN top.value
  WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.task_id = c.task_id AND n.role = c.role) THEN NULL ELSE 'Other' END AS value,
CASE WHEN col = 'price' THEN round(CAST(c.value AS DOUBLE) / CASE WHEN user_id % 2 = 0 THEN 10 ELSE 1000 END, 6) END AS number
FROM c JOIN u USING (task_id) LEFT JOIN top ON c.col = 'kind' AND top.task_id = c.task_id AND top.role = c.role AND top.value = c.value WHERE NOT (col = 'id' AND user_id % 2 = 0)""",
)
def ev_corpus(spark, sf_dir):
    """All tables of all tasks renamed, dropped, rescaled and collapsed by their own plans, in one job."""
    cells = written(_cells(spark, sf_dir), "cells")
    out = evolve_corpus.evolve_corpus(cells, bound(spark, sf_dir, PLANS), ["rename", "drop", "meaning"])
    price = F.col("column") == "price"
    return out.select("task_id", "role", "row_id", "column", F.when(~price, F.col("value")).alias("value"), F.when(price, F.round(number(F.col("value")), 6)).alias("number"))
