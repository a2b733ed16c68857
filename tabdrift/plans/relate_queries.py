"""Join-key discovery, relationship types and feature joins over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabdrift.functions.numbers import two_digits_sql as two
from tabdrift.functions.stored import written
from tabdrift.operators import relate
from tabdrift.plans.bindings import SCHEMAS, bound, columns, plain, table
from tabdrift.plans.registry import query

TABLES = list(SCHEMAS)
PAIRS = [
    ("orders", "lineitem"), ("orders", "customer"), ("lineitem", "part"), ("lineitem", "supplier"), ("customer", "nation"), ("nation", "region"),
    ("supplier", "customer"), ("orders", "region"),
]


def _tables(spark, sf_dir, names=TABLES) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in names}


def _key_stats(spark, sf_dir) -> DataFrame:
    return written(relate.column_stats(relate.shared_columns(_tables(spark, sf_dir))), "stats")


def _pairs(spark) -> DataFrame:
    return spark.createDataFrame(PAIRS, "base string, other string")


def stats_sql(names=TABLES) -> str:
    rows = []
    for i, t in enumerate(names):
        for k, (c, _) in enumerate(columns(t)):
            x = SCHEMAS[t][0] + c
            rows.append(
                f"SELECT '{t}' AS tbl, {i} AS table_idx, {k} AS ordinal, '{c}' AS col, count(*) AS n_rows, count(*) - count({x}) AS n_null, count(DISTINCT {x}) AS n_distinct FROM {t}"
            )
    return "\nUNION ALL ".join(rows)


def columns_sql(names) -> str:
    """The columns of tables; ``names`` maps what a table is called here to the star-schema table."""
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS tbl, {i} AS table_idx, {k} AS ordinal, '{c}' AS col FROM (SELECT count(*) FROM {src})"
        for i, (t, src) in enumerate(names.items())
        for k, (c, _) in enumerate(columns(src))
    )


KEYED = f"""
stats AS ({stats_sql()}),
pairs AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in PAIRS)}) v(base, other)),
cand AS (
  SELECT p.base, p.other, a.col, a.ordinal,
         CASE WHEN a.col IN ('id', 'key', 'uid') OR a.col LIKE '%\\_id' ESCAPE '\\' OR (contains(a.col, 'id') AND length(a.col) <= 12) THEN 1 ELSE 0 END AS id_like,
         least(CAST(a.n_distinct AS DOUBLE) / a.n_rows, CAST(b.n_distinct AS DOUBLE) / b.n_rows) AS score
  FROM pairs p JOIN stats a ON a.tbl = p.base JOIN stats b ON b.tbl = p.other AND b.col = a.col),
best AS (SELECT *, row_number() OVER (PARTITION BY base, other ORDER BY id_like DESC, score DESC, ordinal) AS r FROM cand),
keyed AS (SELECT p.base, p.other, b.col AS key, b.score FROM pairs p LEFT JOIN best b ON b.base = p.base AND b.other = p.other AND b.r = 1),
dup AS (SELECT tbl, col, {two("1 - CAST(n_distinct + CASE WHEN n_null > 0 THEN 1 ELSE 0 END AS DOUBLE) / n_rows")} AS d FROM stats),
related AS (
  SELECT k.*, a.d AS base_dup, b.d AS other_dup,
         CASE WHEN key IS NULL THEN NULL WHEN a.d < 0.01 AND b.d >= 0.01 THEN 'one_to_many' WHEN a.d < 0.01 THEN 'one_to_one'
              WHEN b.d < 0.01 THEN 'many_to_one' ELSE 'many_to_many' END AS relationship
  FROM keyed k LEFT JOIN dup a ON a.tbl = k.base AND a.col = k.key LEFT JOIN dup b ON b.tbl = k.other AND b.col = k.key)"""


@query("jn_best_key", f"WITH {KEYED} SELECT base, other, key, round(score, 8) AS score FROM keyed")
def jn_best_key(spark, sf_dir):
    return relate.best_keys(_key_stats(spark, sf_dir), _pairs(spark)).withColumn("score", F.round("score", 8))


def _related(spark, sf_dir):
    stats = _key_stats(spark, sf_dir)
    return relate.relationships(stats, relate.best_keys(stats, _pairs(spark)))


@query("jn_relationship", f"WITH {KEYED} SELECT base, other, key, base_dup, other_dup, relationship FROM related")
def jn_relationship(spark, sf_dir):
    return _related(spark, sf_dir).select("base", "other", "key", "base_dup", "other_dup", "relationship")


@query(
    "jn_step_log",
    f"""WITH {KEYED} SELECT base, other, key, relationship,
CASE WHEN key IS NULL OR relationship = 'many_to_many' THEN 'skip' WHEN relationship = 'one_to_many' THEN 'aggregate_then_merge' ELSE 'safe_left_merge' END AS action,
CASE WHEN key IS NULL THEN 'no_common_key_with_base' WHEN relationship = 'many_to_many' THEN 'many_to_many_unsafe' END AS reason FROM related""",
)
def jn_step_log(spark, sf_dir):
    return relate.step_log(_related(spark, sf_dir)).select("base", "other", "key", "relationship", "action", "reason")


NULLED = """SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_orderkey END AS orderkey, l_quantity AS quantity, l_discount AS discount,
l_returnflag AS returnflag, l_linestatus AS linestatus, l_shipdate AS shipdate FROM lineitem"""
NULLED_ORDERS = f"SELECT CASE WHEN orderkey % 14 = 0 THEN NULL ELSE orderkey END AS orderkey, custkey, orderstatus, totalprice FROM ({plain('orders')}) o"


def _agg_sql(nums, texts, key="orderkey") -> str:
    cols = [f"count(*) AS __agg__{key}__row_count"]
    for c in nums:
        figures = {"mean": f"round(avg({c}), 6)", "std": f"round(stddev_samp({c}), 6)", "min": f"min({c})", "max": f"max({c})"}
        cols += [f"{x} AS __agg__{c}__{n}" for n, x in figures.items()]
    return ", ".join(cols + [f"count(DISTINCT {c}) AS __agg__{c}__nunique" for c in texts])


AGG = _agg_sql(["quantity", "discount"], ["returnflag", "linestatus"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith(("_mean", "_std"))})


@query("jn_aggregate_child", f"WITH c AS ({NULLED}) SELECT orderkey, {AGG} FROM c GROUP BY orderkey")
def jn_aggregate_child(spark, sf_dir):
    return _rounded(relate.aggregate_child(bound(spark, sf_dir, NULLED), "orderkey"))


@query(
    "jn_one_to_many",
    f"""WITH c AS ({NULLED}), b AS ({NULLED_ORDERS}), a AS (SELECT orderkey, {AGG} FROM c GROUP BY orderkey)
SELECT b.*, a.* EXCLUDE (orderkey) FROM b LEFT JOIN a ON a.orderkey IS NOT DISTINCT FROM b.orderkey""",
)
def jn_one_to_many(spark, sf_dir):
    return _rounded(relate.join_child(bound(spark, sf_dir, NULLED_ORDERS), bound(spark, sf_dir, NULLED), "orderkey"))


CUSTOMERS = f"SELECT CASE WHEN custkey = 3 THEN NULL ELSE custkey END AS custkey, name, nationkey, acctbal, mktsegment, 'x' AS orderstatus FROM ({plain('customer')}) c"
ORDERS_NULL_CUST = f"SELECT orderkey, CASE WHEN custkey % 11 = 0 THEN NULL ELSE custkey END AS custkey, orderstatus, totalprice FROM ({plain('orders')}) o"


@query(
    "jn_many_to_one",
    f"""WITH o AS ({ORDERS_NULL_CUST}), c AS ({CUSTOMERS})
SELECT o.*, c.name, c.nationkey, c.acctbal, c.mktsegment FROM o LEFT JOIN c ON c.custkey IS NOT DISTINCT FROM o.custkey""",
)
def jn_many_to_one(spark, sf_dir):
    return relate.join_parent(bound(spark, sf_dir, ORDERS_NULL_CUST), bound(spark, sf_dir, CUSTOMERS), "custkey")


#: Columns of training and test tables, of which each event names one.
TRAIN = "SELECT DISTINCT concat('training_', user_id % 40) AS tbl, user_id % 40 AS table_idx, concat('c', (event_id // 7) % 60) AS col FROM events WHERE event_id % 3 > 0"
TEST = "SELECT DISTINCT concat('test_', user_id % 37 + 9) AS tbl, user_id % 37 AS table_idx, concat('c', (event_id // 7) % 60) AS col FROM events WHERE event_id % 3 < 2"


@query(
    "jn_match_tables",
    f"""WITH a AS ({TRAIN}), b AS ({TEST}),
o AS (SELECT a.tbl AS train_table, b.tbl AS test_table, b.table_idx, count(*) AS overlap FROM a JOIN b USING (col) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY train_table ORDER BY CASE WHEN replace(train_table, 'training_', 'test_') = test_table THEN 0 ELSE 1 END,
                                   overlap DESC, table_idx) AS r FROM o)
SELECT train_table, test_table, overlap FROM r WHERE r = 1""",
)
def jn_match_tables(spark, sf_dir):
    named = {"tbl": "table", "col": "column"}
    shown = lambda sql: bound(spark, sf_dir, sql.replace("//", "DIV")).withColumnsRenamed(named)
    return relate.match_tables(shown(TRAIN), shown(TEST))


LINES = "SELECT l_orderkey AS orderkey, l_quantity AS quantity, l_discount AS discount, l_returnflag AS returnflag, l_linestatus AS linestatus FROM lineitem"


@query(
    "jn_relational_features",
    f"""WITH c AS ({LINES}), a AS (SELECT orderkey, {AGG} FROM c GROUP BY orderkey), cu AS ({plain("customer")}), o AS ({plain("orders")})
SELECT o.* RENAME (orderstatus AS y), a.* EXCLUDE (orderkey), cu.name, cu.nationkey, cu.acctbal, cu.mktsegment
FROM o LEFT JOIN a USING (orderkey) LEFT JOIN cu ON cu.custkey = o.custkey""",
)
def jn_relational_features(spark, sf_dir):
    base, others = table(spark, sf_dir, "orders"), {"lineitem": bound(spark, sf_dir, LINES), "customer": table(spark, sf_dir, "customer"), "region": table(spark, sf_dir, "region")}
    stats = written(relate.column_stats(relate.shared_columns({"orders": base, **others})), "stats")  # a row per column
    pairs = spark.createDataFrame([("orders", o) for o in others], "base string, other string")
    # the steps are a row per table; what they say decides the shape of the plan
    steps = {r["other"]: (r["key"], r["relationship"]) for r in relate.relationships(stats, relate.best_keys(stats, pairs, exclude=["orderstatus"])).collect()}
    return _rounded(relate.relational_features(base, others, "orderstatus", steps))


#: Test tables of the same task: the base by shared columns, a child under another key, a parent that lost a column.
EVOLVED_TEST = {
    "test_1": "SELECT l_orderkey AS orderkey__renamed, l_quantity AS quantity, l_returnflag AS returnflag FROM lineitem",
    "test_2": "SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_mktsegment AS mktsegment, 1 AS extra FROM customer",
    "test_0": "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_totalprice AS totalprice, o_orderdate AS orderdate FROM orders",
}
BUILD_TRAIN = {"training_0": plain("orders"), "training_1": LINES, "training_2": plain("customer"), "training_3": plain("part")}
_LOST = ", ".join(
    ["CAST(NULL AS BIGINT) AS __agg__orderkey__row_count"]
    + [f"CAST(NULL AS DOUBLE) AS __agg__{c}__{f}" for c in ("quantity", "discount") for f in ("mean", "std", "min", "max")]
    + [f"CAST(NULL AS BIGINT) AS __agg__{c}__nunique" for c in ("returnflag", "linestatus")]
)


def _build(spark, sf_dir):
    train, test = ({t: bound(spark, sf_dir, q) for t, q in x.items()} for x in (BUILD_TRAIN, EVOLVED_TEST))
    return relate.build_features(train, test, "training_0", "orderstatus")


@query(
    "jn_build_test",
    f"""WITH o AS ({EVOLVED_TEST["test_0"]}), c AS ({EVOLVED_TEST["test_2"]})
SELECT o.*, {_LOST}, c.nationkey, c.mktsegment FROM o LEFT JOIN c USING (custkey)""",
)
def jn_build_test(spark, sf_dir):
    """Test rows of a full feature build whose child table has lost its key."""
    return _build(spark, sf_dir)[1]


#: Whether a key repeats in at least one of a hundred rows, and the relation that two sides have by that.
_REPEATS = "(SELECT floor(100 * round(1 - count(DISTINCT {key}) / count(*), 9) + 0.5) >= 1 FROM {table})"
_KIND = "CASE WHEN {base} AND {other} THEN 'many_to_many' WHEN {other} THEN 'one_to_many' WHEN {base} THEN 'many_to_one' ELSE 'one_to_one' END"


@query(
    "jn_build_log",
    f"""WITH r AS (SELECT {_REPEATS.format(key="o_orderkey", table="orders")} AS order_base, {_REPEATS.format(key="l_orderkey", table="lineitem")} AS order_other,
  {_REPEATS.format(key="o_custkey", table="orders")} AS customer_base, {_REPEATS.format(key="c_custkey", table="customer")} AS customer_other),
k AS (SELECT {_KIND.format(base="order_base", other="order_other")} AS orders, {_KIND.format(base="customer_base", other="customer_other")} AS customers FROM r),
v AS (SELECT 0 AS step, 'training_1' AS train_table, 'test_1' AS test_table, 'orderkey' AS key, orders AS relationship, 11 AS n_added_cols FROM k
  UNION ALL SELECT 1, 'training_2', 'test_2', 'custkey', customers, 4 FROM k UNION ALL SELECT 2, 'training_3', 'test_1', NULL, NULL, 0)
SELECT step, train_table, test_table, key, relationship, CASE relationship WHEN 'one_to_many' THEN 'aggregate_then_merge' WHEN 'one_to_one' THEN 'safe_left_merge' WHEN 'many_to_one' THEN 'safe_left_merge' ELSE 'skip' END AS action,
CASE WHEN key IS NULL THEN 'no_common_key_with_base' WHEN relationship NOT IN ('one_to_many', 'one_to_one', 'many_to_one') THEN 'many_to_many_unsafe' END AS reason, n_added_cols, 'ok' AS status,
(SELECT count(*) FROM orders) AS n_rows FROM v""",
)
def jn_build_log(spark, sf_dir):
    x_train, _, log = _build(spark, sf_dir)
    return log.crossJoin(x_train.agg(F.count("*").alias("n_rows")))  # one row


CHAIN = {
    "orders": plain("orders"),
    "customer": "SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_acctbal AS acctbal, 'c' AS orderstatus FROM customer",
    "nation": plain("nation"),
    "region": "SELECT r_regionkey AS regionkey, r_name AS region_name FROM region",
}


@query(
    "jn_join_chain",
    f"""WITH o AS ({CHAIN["orders"]}), c AS ({CHAIN["customer"]}), n AS ({CHAIN["nation"]}), r AS ({CHAIN["region"]})
SELECT o.* RENAME (orderstatus AS orderstatus_x), c.nationkey, c.acctbal, c.orderstatus AS orderstatus_y, n.name, n.regionkey, r.region_name
FROM o LEFT JOIN c USING (custkey) LEFT JOIN n ON n.nationkey = c.nationkey LEFT JOIN r ON r.regionkey = n.regionkey""",
)
def jn_join_chain(spark, sf_dir):
    """Tables joined one after another, each join checked before it runs."""
    out, error = relate.join_chain({t: bound(spark, sf_dir, q) for t, q in CHAIN.items()})
    assert error is None, error
    return out


EXPANSIONS = [("orders", "lineitem", "orderkey"), ("orders", "customer", "custkey"), ("supplier", "customer", "nationkey"), ("nation", "region", "regionkey")]


def _expansion_sql(a, b, k) -> str:
    x, y = SCHEMAS[a][0] + k, SCHEMAS[b][0] + k
    mean = "CAST(sum(n * greatest(coalesce(m, 1), 1)) AS DOUBLE) / sum(n)"
    return f"""SELECT '{a}' AS base, '{b}' AS other, {two(mean)} AS expansion FROM (SELECT {x} AS k, count(*) AS n FROM {a} GROUP BY 1) l
LEFT JOIN (SELECT {y} AS k, count(*) AS m FROM {b} GROUP BY 1) r ON l.k IS NOT DISTINCT FROM r.k"""


EXPANSION_SQL = "\nUNION ALL ".join(_expansion_sql(*e) for e in EXPANSIONS)


def _expansions(spark, sf_dir) -> DataFrame:
    out = None
    for a, b, k in EXPANSIONS:
        one = relate.join_expansion(table(spark, sf_dir, a), table(spark, sf_dir, b), k).select(F.lit(a).alias("base"), F.lit(b).alias("other"), "expansion")
        out = one if out is None else out.unionByName(one)
    return out


@query("jn_expansion", EXPANSION_SQL)
def jn_expansion(spark, sf_dir):
    return _expansions(spark, sf_dir)


@query(
    "jn_guarded_join",
    f"""WITH {KEYED}, e AS ({EXPANSION_SQL}),
g AS (SELECT r.base, r.other, r.key, e.expansion,
        CASE WHEN r.key IS NULL THEN 'no common columns' WHEN e.expansion > 5 THEN 'join expansion' WHEN r.base_dup > 0.01 AND r.other_dup > 0.01 THEN 'many-to-many' END AS error
      FROM related r LEFT JOIN e USING (base, other))
SELECT *, error IS NULL AS allowed FROM g""",
)
def jn_guarded_join(spark, sf_dir):
    stats = _key_stats(spark, sf_dir)
    out = relate.guarded(stats, relate.best_keys(stats, _pairs(spark)), _expansions(spark, sf_dir))
    return out.select("base", "other", "key", "expansion", "error", "allowed")
