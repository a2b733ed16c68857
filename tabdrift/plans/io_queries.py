"""Sources and sinks over lines, files and logs made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabdrift.functions.stored import scratch_path
from tabdrift.operators import evolve
from tabdrift.plans.bindings import bound, plain
from tabdrift.plans.registry import query
from tabdrift.sources import tables


@query("io_read_csv", f"SELECT orderkey, custkey, orderstatus, totalprice, orderdate, orderpriority FROM ({plain('orders')})")
def io_read_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    orders = bound(spark, sf_dir, plain("orders")).withColumn("orderdate", F.date_format("orderdate", "yyyy-MM-dd HH:mm:ss"))
    orders.select(F.col("orderkey").alias("Unnamed: 0"), "*").write.option("header", True).csv(path)
    out = tables.read_csv(spark, path)
    return out.withColumns({"orderkey": F.col("orderkey").cast("bigint"), "custkey": F.col("custkey").cast("bigint"), "orderdate": F.col("orderdate").cast("timestamp_ntz")})


@query("io_read_sample", f"SELECT * FROM ({plain('customer')}) ORDER BY custkey LIMIT 500")
def io_read_sample(spark, sf_dir):
    """The first rows of a CSV table, as a plan looks at them."""
    path = scratch_path(spark, "csv")
    bound(spark, sf_dir, plain("customer")).orderBy("custkey").write.option("header", True).csv(path)
    schema = "custkey bigint, name string, nationkey bigint, acctbal double, mktsegment string"
    return tables.read_csv(spark, path, T.StructType.fromDDL(schema), rows=500)


@query(
    "io_write_variant",
    f"""SELECT partkey, name, brand AS brand__renamed, type, size, retailprice, 'rename' AS variant, 'task_7' AS task_id, 'training' AS role, 3 AS table_idx FROM ({plain("part")})""",
)
def io_write_variant(spark, sf_dir):
    """What is read back of a variant that was written: its evolved table, under the folders that name it."""
    path = scratch_path(spark, "variants")
    part = bound(spark, sf_dir, plain("part"))
    plan = spark.createDataFrame([("task_7", "brand")], "task_id string, rename_col string")
    tables.write_task(path, "rename", "task_7", {"training": {3: evolve.rename_column(part, "brand")}}, plan)
    return spark.read.option("basePath", path).parquet(f"{path}/variant=rename")


HEADER = ["id", "status", "priority", "note"]
RAGGED = """SELECT o_orderkey AS k, CASE o_orderkey % 10 WHEN 0 THEN concat(o_orderkey, ',', o_orderstatus)
WHEN 3 THEN concat(o_orderkey, ',', o_orderstatus, ' 5" pipe,', o_orderpriority, ',say "a, b') WHEN 4 THEN concat(o_orderkey, ',', o_orderstatus, ' 5" pipe,', o_orderpriority, ',n') WHEN 1 THEN concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority, ',a,b,c') WHEN 2 THEN concat(o_orderkey, ',"', o_orderstatus, ',x",', o_orderpriority, ',')
ELSE concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority, ',n') END AS value FROM orders"""


@query(
    "io_ragged_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 10 WHEN 2 THEN o_orderstatus || ',x' WHEN 4 THEN o_orderstatus || ' 5" pipe' ELSE o_orderstatus END AS status,
CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 10 IN (0, 2) THEN NULL ELSE 'n' END AS note
FROM orders WHERE o_orderkey % 10 NOT IN (1, 3)""",
)
def io_ragged_rows(spark, sf_dir):
    return tables.parse_ragged(bound(spark, sf_dir, RAGGED), HEADER)


PACKED = """SELECT CASE o_orderkey % 10 WHEN 0 THEN concat(o_orderkey, ',"', o_orderstatus, ',', o_orderpriority, ',n"')
WHEN 1 THEN concat(o_orderkey, ',"', o_orderstatus, ',""q"" ', o_orderpriority, '",,,,') WHEN 2 THEN concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority, ',n,extra')
WHEN 4 THEN concat(o_orderkey, ',', o_orderstatus, ',5" ', o_orderpriority, ',"a, b" c"d') WHEN 3 THEN concat(o_orderkey, ',', o_orderstatus) ELSE concat(o_orderkey, ',', o_orderstatus, ',', o_orderpriority, ',n') END AS value FROM orders"""


@query(
    "io_repair_embedded",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status,
CASE o_orderkey % 10 WHEN 1 THEN 'q ' || o_orderpriority WHEN 3 THEN NULL WHEN 4 THEN '5" ' || o_orderpriority ELSE o_orderpriority END AS priority,
CASE WHEN o_orderkey % 10 IN (1, 3) THEN NULL WHEN o_orderkey % 10 = 4 THEN 'a, b c"d' ELSE 'n' END AS note FROM orders""",
)
def io_repair_embedded(spark, sf_dir):
    return tables.repair_embedded(bound(spark, sf_dir, PACKED), HEADER)


TASKS = "SELECT DISTINCT concat('task_', user_id) AS task_id FROM events"
DONE = "SELECT DISTINCT concat('task_', user_id) AS task_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0"


@query("io_task_slice", f"SELECT task_id FROM ({TASKS}) ORDER BY task_id LIMIT 40 OFFSET 5")
def io_task_slice(spark, sf_dir):
    return tables.task_slice(bound(spark, sf_dir, TASKS), offset=5, limit=40)


@query("io_fingerprint", "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(text) AS BIGINT) AS size, sha1(text) AS sha1_head FROM documents")
def io_fingerprint(spark, sf_dir):
    return tables.fingerprints(bound(spark, sf_dir, "SELECT CAST(doc_id AS STRING) AS path, text AS content FROM documents"))


LOG_LINES = """SELECT CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '{"task_id": "broken' WHEN 2 THEN concat('{"task_id":"t', user_id, '","ks":NaN,"extra":[1]}')
ELSE concat('{"task_id":"t', user_id, '","variant":"', event_type, '","n_train":', event_id, ',"meta":{"a":1}}') END AS value FROM events"""


@query(
    "io_read_runlog",
    """SELECT 't' || user_id AS task_id, CASE WHEN event_id % 9 = 2 THEN NULL ELSE event_type END AS variant, CASE WHEN event_id % 9 = 2 THEN NULL ELSE event_id END AS n_train,
CASE WHEN event_id % 9 = 2 THEN NULL ELSE '{"a":1}' END AS meta FROM events WHERE event_id % 9 > 1""",
)
def io_read_runlog(spark, sf_dir):
    return tables.parse_run_log(bound(spark, sf_dir, LOG_LINES), "task_id string, variant string, n_train bigint, ks double, meta string").drop("ks")


@query(
    "io_flatten_nested",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"kind":"' || event_type || '"}' ELSE '{"kind":"' || event_type || '","user":' || user_id || '}' END AS info,
'["' || event_type || '","x"]' AS names FROM events""",
)
def io_flatten_nested(spark, sf_dir):
    events = bound(spark, sf_dir, "SELECT event_id, event_type, user_id FROM events")
    user = F.when(F.col("event_id") % 4 != 0, F.col("user_id"))
    nested = events.select("event_id", F.struct(F.col("event_type").alias("kind"), user.alias("user")).alias("info"), F.array("event_type", F.lit("x")).alias("names"))
    return tables.flattened(nested)


@query("io_resume_pending", f"SELECT task_id FROM ({TASKS}) WHERE task_id NOT IN (SELECT task_id FROM ({DONE}))")
def io_resume_pending(spark, sf_dir):
    return tables.pending(bound(spark, sf_dir, TASKS), bound(spark, sf_dir, DONE))


@query("io_pair_tasks", f"SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM ({DONE})) THEN 'pending' ELSE 'missing_evolved_task' END AS status FROM ({TASKS})")
def io_pair_tasks(spark, sf_dir):
    return tables.paired(bound(spark, sf_dir, TASKS), bound(spark, sf_dir, DONE))
