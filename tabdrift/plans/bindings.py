"""Inputs of the queries, made from the driver's tables.

Each binding is SQL that Spark and the oracle read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Columns of the star-schema tables without their prefixes, in order, with their kind.
SCHEMAS = {
    "region": ("r_", "regionkey:int name:text"),
    "nation": ("n_", "nationkey:int name:text regionkey:int"),
    "supplier": ("s_", "suppkey:int name:text nationkey:int acctbal:num"),
    "customer": ("c_", "custkey:int name:text nationkey:int acctbal:num mktsegment:text"),
    "part": ("p_", "partkey:int name:text brand:text type:text size:int retailprice:num"),
    "orders": ("o_", "orderkey:int custkey:int orderstatus:text totalprice:num orderdate:time orderpriority:text"),
    "lineitem": (
        "l_",
        "orderkey:int partkey:int suppkey:int linenumber:int quantity:num extendedprice:num discount:num tax:num returnflag:text linestatus:text shipdate:time",
    ),
}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in SCHEMAS[table][1].split()]


def plain(table: str) -> str:
    """A star-schema table without its column prefix."""
    prefix = SCHEMAS[table][0]
    return f"SELECT {', '.join(f'{prefix}{c} AS {c}' for c, _ in columns(table))} FROM {table}"


#: Pairs of baseline and evolved regression predictions.
REGRESSION = """
SELECT concat(l_returnflag, l_linestatus) AS task, concat('v', l_linenumber % 3) AS variant,
       CASE WHEN l_suppkey % 2 = 0 THEN 'strict' ELSE 'stability' END AS align_mode,
       l_extendedprice AS base, l_extendedprice * (1 - l_discount) AS evo
FROM lineitem"""

#: Pairs of predicted classes and of probabilities over three classes.
CLASSES = """
SELECT concat(l_returnflag, l_linestatus) AS task, concat('v', l_linenumber % 3) AS variant,
       CASE WHEN l_suppkey % 2 = 0 THEN 'strict' ELSE 'stability' END AS align_mode,
       l_returnflag AS base, CASE WHEN l_partkey % 17 = 0 THEN 'A' ELSE l_returnflag END AS evo,
       l_discount AS b1, l_tax AS b2, 1 - l_discount - l_tax AS b3,
       l_discount / 2 AS e1, l_tax * 2 AS e2, 1 - l_discount AS e3
FROM lineitem"""

#: Error texts that reach every rule of the crash taxonomy, by event_id modulo their number.
ERRORS = [
    "FileNotFoundError: No such file",
    "MemoryError in OneHot dense matrix",
    "MemoryError during merge",
    "std::bad_alloc",
    "No common columns between tables.",
    "many-to-many risk on key",
    "join expansion 9.1 above limit",
    "TARGET_ERROR: no suitable target column",
    "too few usable training rows after cleaning y",
    "KeyError: label",
    "STRICT_SCHEMA_FAIL: missing_in_test",
    "could not convert string to float",
    "found unknown categories in column 0",
    "to_datetime could not parse",
    "lbfgs failed to converge",
    "MODEL_FIT_ERROR: model fit failed",
    "PREDICT_ERROR: predict failed",
    "something else broke",
    "cannot allocate memory",
    "cartesian product",
]

_ERROR = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ERRORS))

#: A run log: one record per task, variant and mode, the first event standing for it.
RUN_LOG = f"""
SELECT task_id, variant, align_mode, status, fail_type, error, traceback_tail, rmse, base_pred_std, ks, spearman, agreement, jsd, n_train,
       silent_failure_candidate
FROM (
  SELECT concat('task_', user_id) AS task_id,
         CASE event_type WHEN 'click' THEN 'baseline' WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'drop' WHEN 'error' THEN 'rename' ELSE 'meaning' END AS variant,
         CASE WHEN event_id % 2 = 0 THEN 'strict' ELSE 'stability' END AS align_mode,
         CASE WHEN event_id % 11 IN (0, 1, 5, 8) THEN 'crash' WHEN event_id % 11 = 2 THEN 'missing_evolved_task' WHEN event_id % 11 = 3 THEN 'OK'
              WHEN event_id % 11 = 4 AND event_id % 7 = 0 THEN NULL ELSE 'Success' END AS status,
         CASE WHEN event_id % 11 IN (0, 1, 5, 8) THEN 'UNKNOWN_ERROR' END AS fail_type,
         CASE WHEN event_id % 11 IN (0, 1, 5, 8) THEN CASE event_id % {len(ERRORS)} {_ERROR} END END AS error,
         CASE WHEN event_id % 11 IN (0, 1, 5, 8) AND event_id % 3 = 0 THEN 'Traceback: line' END AS traceback_tail,
         CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS {{text}}) END AS rmse,
         CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value / 2 + 1 END AS base_pred_std,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE (value % 7) / 10 END AS ks,
         1 - (value % 5) / 20 AS spearman, 1 - (value % 3) / 30 AS agreement, (value % 11) / 100 AS jsd,
         event_id % 900 AS n_train, value % 4 > 2 AS silent_failure_candidate,
         row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id) AS i
  FROM events) t
WHERE i = 1"""


def run_log(dialect: str) -> str:
    return RUN_LOG.format(text="STRING" if dialect == "spark" else "VARCHAR")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql`` over the driver's tables."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark", "embeddings"]
    used = [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in used:
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star-schema table without its column prefix."""
    return bound(spark, sf_dir, plain(name))
