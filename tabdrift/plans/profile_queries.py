"""Profiles of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabdrift.functions.dates import EVOLVE_FORMATS
from tabdrift.operators import profile, relate
from tabdrift.plans.bindings import SCHEMAS, bound, columns, plain, table
from tabdrift.plans.registry import query
from tabdrift.plans.relate_queries import columns_sql

TABLES = ["orders", "customer", "part", "supplier", "nation", "region"]
KIND = {"num": "float64", "text": "str", "time": "datetime64[ns]", "int": "int64"}


def _tables(spark, sf_dir, names=TABLES):
    return {t: table(spark, sf_dir, t) for t in names}


BLANKED = 'SELECT o_orderkey AS "Unnamed: 0", o_custkey AS _c7, o_orderkey AS orderkey, o_orderstatus AS orderstatus FROM orders'


@query("hy_drop_blank", "SELECT o_orderkey AS orderkey, o_orderstatus AS orderstatus FROM orders")
def hy_drop_blank(spark, sf_dir):
    return profile.drop_blank_columns(bound(spark, sf_dir, BLANKED.replace('"', "`")))


def _snapshot_sql() -> str:
    rows = []
    for t in TABLES:
        key = SCHEMAS[t][0] + columns(t)[0][0]
        for c, kind in columns(t):
            x = SCHEMAS[t][0] + c
            rows.append(f"""SELECT '{t}' AS "table", '{c}' AS "column", '{KIND[kind]}' AS dtype,
round(CAST(count(*) - count({x}) AS DOUBLE) / count(*), 8) AS null_ratio, count(DISTINCT {x}) AS n_unique,
(SELECT string_agg(v, '|' ORDER BY f, v) FROM (SELECT CAST({x} AS VARCHAR) AS v, min({key}) AS f FROM {t} WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY f, v LIMIT 3)) AS sample FROM {t}""")
    return "\nUNION ALL ".join(rows)


@query("pr_snapshot", _snapshot_sql())
def pr_snapshot(spark, sf_dir):
    out = profile.snapshot(_tables(spark, sf_dir), {t: columns(t)[0][0] for t in TABLES})
    return out.withColumn("null_ratio", F.round("null_ratio", 8)).withColumn("sample", F.array_join("sample", "|"))


@query(
    "pr_fingerprint",
    "\nUNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS n_rows, '{",".join(c for c, _ in columns(t))}' AS columns, '{",".join(f"{c}:{KIND[k]}" for c, k in columns(t))}' AS dtypes FROM {t}"""
        for t in SCHEMAS
    ),
)
def pr_fingerprint(spark, sf_dir):
    out = profile.fingerprints(_tables(spark, sf_dir, list(SCHEMAS)))
    shown = F.array_join(F.transform("columns", lambda c: F.concat(c, F.lit(":"), F.element_at(F.col("dtypes"), c))), ",")
    return out.select("table", "n_rows", F.array_join("columns", ",").alias("columns"), shown.alias("dtypes"))


EVOLVED = """SELECT o_orderkey AS orderkey, o_custkey AS custkey__renamed, o_orderstatus AS orderstatus, CAST(o_totalprice AS {text}) AS totalprice,
o_orderdate AS orderdate, o_orderdate AS orderdate2 FROM orders"""


@query(
    "pr_schema_diff",
    """SELECT 'orders' AS "table", 'custkey__renamed,orderdate2' AS added, 'custkey,orderpriority' AS removed, 'totalprice:float64>str' AS dtype_changes, count(*) AS n_rows FROM orders""",
)
def pr_schema_diff(spark, sf_dir):
    before, after = table(spark, sf_dir, "orders"), bound(spark, sf_dir, EVOLVED.format(text="STRING"))
    out = profile.schema_diff(profile.column_types({"orders": before}), profile.column_types({"orders": after}))
    changes = F.array_join(F.transform("dtype_changes", lambda x: F.concat(x["column"], F.lit(":"), x["before"], F.lit(">"), x["after"])), ",")
    rows = profile.fingerprints({"orders": after}).select("table", "n_rows")
    return out.select("table", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), changes.alias("dtype_changes")).join(rows, "table")


#: Columns of tasks before and after a change, of which each event is one; types are those of the first event.
TYPED = """SELECT concat('task_', user_id) AS task_id, event_type AS tbl, concat('c', event_id % 40) AS col,
min(CASE WHEN value > 50 THEN 'float64' WHEN event_id % 5 = 0 THEN 'int64' ELSE 'str' END) AS dtype FROM events WHERE event_id % 3 <> {side} GROUP BY 1, 2, 3"""


@query(
    "pr_schema_diff_tasks",
    f"""WITH a AS ({TYPED.format(side=0)}), b AS ({TYPED.format(side=1)}), j AS (
SELECT task_id, tbl, col, a.dtype AS was, b.dtype AS now FROM a FULL JOIN b USING (task_id, tbl, col))
SELECT task_id, tbl AS "table", coalesce(string_agg(col, ',' ORDER BY col) FILTER (was IS NULL), '') AS added, coalesce(string_agg(col, ',' ORDER BY col) FILTER (now IS NULL), '') AS removed,
coalesce(string_agg(col || ':' || was || '>' || now, ',' ORDER BY col) FILTER (was <> now), '') AS dtype_changes FROM j GROUP BY ALL""",
)
def pr_schema_diff_tasks(spark, sf_dir):
    """Schema changes of all tables of all tasks in one join, the schemas being rows."""
    before, after = (bound(spark, sf_dir, TYPED.format(side=i)).withColumnsRenamed({"tbl": "table", "col": "column"}) for i in (0, 1))
    out = profile.schema_diff(before, after, ["task_id", "table"])
    changes = F.array_join(F.transform("dtype_changes", lambda x: F.concat(x["column"], F.lit(":"), x["before"], F.lit(">"), x["after"])), ",")
    return out.select("task_id", "table", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), changes.alias("dtype_changes"))


HOLES = """SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS acctbal,
CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS mktsegment, c_nationkey AS nationkey FROM customer"""


@query(
    "pr_row_nulls",
    f"""WITH h AS ({HOLES}), s AS (SELECT (CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN acctbal IS NULL THEN 1 ELSE 0 END
+ CASE WHEN mktsegment IS NULL THEN 1 ELSE 0 END) / 4.0 AS share FROM h)
SELECT round(avg(share), 8) AS row_na_mean, round(quantile_cont(CAST(share AS DOUBLE), 0.95), 8) AS row_na_p95 FROM s""",
)
def pr_row_nulls(spark, sf_dir):
    out = profile.row_null_profile(bound(spark, sf_dir, HOLES))
    return out.select(F.round("row_na_mean", 8).alias("row_na_mean"), F.round("row_na_p95", 8).alias("row_na_p95"))


#: Tables of the catalogue with their columns.
CATALOG = {t: [SCHEMAS[t][0] + c for c, _ in columns(t)] for t in SCHEMAS} | {
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "benchmark": ["item_id", "text"],
}


def _catalog(spark, sf_dir):
    return profile.catalog({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in CATALOG})


@query(
    "pr_catalog",
    "\nUNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS n_rows, {len(cols)} AS n_cols, '[{",".join(f'"{c}"' for c in cols)}]' AS columns_json FROM {t}""" for t, cols in CATALOG.items()
    ),
)
def pr_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir).select("table", "n_rows", "n_cols", "columns_json")


def _domain_sql() -> str:
    rows = []
    for t, cols in CATALOG.items():
        counts = ", ".join(f"({i}, '{d}', {' + '.join(f'CAST(contains(names, {chr(39)}{k}{chr(39)}) AS INTEGER)' for k in words)})" for i, (d, words) in enumerate(profile.DOMAINS.items()))
        rows.append(f"""SELECT '{t}' AS "table", n_rows, CASE WHEN s > 0 THEN d ELSE 'unknown' END AS domain_guess, s AS domain_score
FROM (SELECT n_rows, d, s, row_number() OVER (ORDER BY s DESC, o) AS r FROM (SELECT '{" ".join(cols)}' AS names, (SELECT count(*) FROM {t}) AS n_rows) n,
LATERAL (SELECT * FROM (VALUES {counts}) v(o, d, s)) x) WHERE r = 1""")
    return "\nUNION ALL ".join(rows)


@query("pr_domain_guess", _domain_sql())
def pr_domain_guess(spark, sf_dir):
    return _catalog(spark, sf_dir).select("table", "n_rows", "domain_guess", "domain_score")


#: Columns of the tables of tasks, of which each event names one.
NAMED = """SELECT DISTINCT concat('task_', user_id) AS task_id, event_type AS tbl, CASE WHEN event_id % 19 = 0 THEN 'Unnamed: 0' ELSE concat('c', event_id % 23) END AS col
FROM events WHERE user_id % 7 > 0 OR event_type = 'click'"""


@query(
    "pr_join_keys",
    f"""WITH t AS ({NAMED}),
many AS (SELECT task_id FROM t GROUP BY task_id HAVING count(DISTINCT tbl) >= 2)
SELECT task_id, col AS "column", count(DISTINCT tbl) AS n_tables FROM t WHERE task_id IN (SELECT task_id FROM many) AND col <> 'Unnamed: 0' GROUP BY ALL HAVING count(DISTINCT tbl) >= 2""",
)
def pr_join_keys(spark, sf_dir):
    return relate.join_keys(bound(spark, sf_dir, NAMED).withColumnsRenamed({"tbl": "table", "col": "column"}))


DATED = """SELECT o_orderkey AS id, {iso} AS iso, CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE {us} END AS us,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {full} END AS full_time, CASE WHEN o_orderkey % 2 = 0 THEN 'never' ELSE {iso} END AS mixed FROM orders"""


def dated(dialect: str) -> str:
    spark_of = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "full": "yyyy-MM-dd HH:mm:ss"}
    duck_of = {"iso": "%Y-%m-%d", "us": "%m/%d/%Y", "full": "%Y-%m-%d %H:%M:%S"}
    if dialect == "spark":
        return DATED.format(**{k: f"date_format(o_orderdate, '{f}')" for k, f in spark_of.items()})
    return DATED.format(**{k: f"strftime(o_orderdate, '{f}')" for k, f in duck_of.items()})


DATE_COLUMNS = ["iso", "us", "full_time", "mixed"]


def _formats_sql() -> str:
    shares = ", ".join(f"avg(CASE WHEN try_strptime(v, '{f}') IS NOT NULL THEN 1 ELSE 0 END) AS s{i}" for i, f in enumerate(EVOLVE_FORMATS.values()))
    sure = " ".join(f"WHEN s{i} >= 0.99 THEN {i}" for i in range(len(EVOLVE_FORMATS)))
    top = f"greatest({', '.join(f's{i}' for i in range(len(EVOLVE_FORMATS)))})"
    best = " ".join(f"WHEN {top} >= 0.8 AND s{i} = {top} THEN {i}" for i in range(len(EVOLVE_FORMATS)))
    names = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(EVOLVE_FORMATS))
    oks = " ".join(f"WHEN {i} THEN s{i}" for i in range(len(EVOLVE_FORMATS)))
    values = "\nUNION ALL ".join(f"(SELECT '{c}' AS col, {c} AS v FROM d WHERE {c} IS NOT NULL ORDER BY id LIMIT 300)" for c in DATE_COLUMNS)
    return f"""WITH d AS ({dated("duckdb")}), v AS ({values}), s AS (SELECT col, {shares} FROM v GROUP BY col),
p AS (SELECT *, CASE {sure} {best} END AS i FROM s)
SELECT col AS "column", CASE i {names} END AS format, round(CASE i {oks} END, 8) AS ok FROM p"""


@query("pr_dt_format", _formats_sql())
def pr_dt_format(spark, sf_dir):
    values = profile.first_values(bound(spark, sf_dir, dated("spark")), "id", DATE_COLUMNS, 300)
    return profile.date_formats(values).select("column", "format", F.round("ok", 8).alias("ok"))


NUMBERED = """SELECT p_partkey AS id, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE concat(' ', p_size) END AS size_text,
CAST(p_partkey AS {text}) AS code FROM part"""
NUMBERED_COLUMNS = ["name", "brand", "size_text", "code"]


@query(
    "pr_numeric_like",
    f"""WITH n AS ({NUMBERED.format(text="VARCHAR")}),
v AS ({" UNION ALL ".join(f"(SELECT {i} AS o, '{c}' AS col, {c} AS v FROM n WHERE {c} IS NOT NULL ORDER BY id LIMIT 300)" for i, c in enumerate(NUMBERED_COLUMNS))}),
s AS (SELECT o, col, avg(CASE WHEN regexp_matches(v, '^\\s*-?\\d+(\\.\\d+)?\\s*$') THEN 1 ELSE 0 END) AS share FROM v GROUP BY ALL)
SELECT col AS "column", round(share, 8) AS share, share > 0.7 AND o = (SELECT min(o) FROM s WHERE share > 0.7) AS picked FROM s""",
)
def pr_numeric_like(spark, sf_dir):
    values = profile.first_values(bound(spark, sf_dir, NUMBERED.format(text="STRING")), "id", NUMBERED_COLUMNS, 300)
    return profile.numeric_like(values).select("column", F.round("share", 8).alias("share"), "picked")


PLACES = """SELECT c_custkey AS id, concat(c_custkey, ' Main Street, Town') AS mail_address, c_name AS name,
CASE WHEN c_custkey % 4 = 0 THEN 'a b c d' ELSE c_mktsegment END AS addr2, concat('one two three ', c_custkey) AS words FROM customer"""
PLACE_COLUMNS = ["mail_address", "name", "addr2", "words"]


@query(
    "pr_address_like",
    f"""WITH n AS ({PLACES}),
v AS ({" UNION ALL ".join(f"(SELECT '{c}' AS col, {c} AS v FROM n WHERE {c} IS NOT NULL ORDER BY id LIMIT 200)" for c in PLACE_COLUMNS)}),
s AS (SELECT col, avg(CASE WHEN contains(v, ',') THEN 1 ELSE 0 END) AS comma, avg(CASE WHEN len(regexp_extract_all(v, '\\S+')) > 2 THEN 1 ELSE 0 END) AS tokens FROM v GROUP BY col)
SELECT col AS "column", round(comma, 8) AS comma_share, round(tokens, 8) AS tokens_share, contains(col, 'addr') AS by_name, comma > 0.3 OR tokens > 0.7 AS by_value FROM s""",
)
def pr_address_like(spark, sf_dir):
    values = profile.first_values(bound(spark, sf_dir, PLACES), "id", PLACE_COLUMNS, 200)
    out = profile.address_like(values)
    return out.select("column", F.round("comma_share", 8).alias("comma_share"), F.round("tokens_share", 8).alias("tokens_share"), "by_name", "by_value")


SCORED = "SELECT doc_id, quality AS Score, toxic FROM labels"
RATED = "SELECT c_custkey AS cust_id, c_mktsegment AS rating_name, c_name AS name FROM customer"
TARGETS = ["orders", "customer", "part", "supplier", "nation"]


TARGET_VIEWS = {t: plain(t) for t in TARGETS} | {"scored": SCORED, "rated": RATED}
TARGET_COLUMNS = {t: [c for c, _ in columns(t)] for t in TARGETS} | {"scored": ["doc_id", "Score", "toxic"], "rated": ["cust_id", "rating_name", "name"]}


def _target_sql(views=TARGET_VIEWS, names=TARGET_COLUMNS) -> str:
    num = r"CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) END"
    rows = "\nUNION ALL ".join(
        f"SELECT '{t}' AS tbl, {i} AS o, '{c}' AS col, count(*) AS n, count({num.format(c=c)}) AS valid, count(DISTINCT {num.format(c=c)}) AS numbers, count({c}) AS filled, count(DISTINCT {c}) AS texts FROM ({views[t]})"
        for t, cols in names.items()
        for i, c in enumerate(cols)
    )
    low = "lower(col)"
    named = f"list_position([{', '.join(repr(n) for n in profile.TARGET_NAMES)}], {low})"
    part = " OR ".join(f"contains({low}, '{p}')" for p in profile.TARGET_PARTS)
    return f"""WITH s AS ({rows}),
u AS (SELECT *, CAST(valid AS DOUBLE) / n AS ratio, CAST(numbers AS DOUBLE) / n AS spread,
        NOT (contains({low}, 'date') OR contains({low}, 'time') OR ends_with({low}, '_dt') OR {low} IN ('id', 'key', 'uid') OR ends_with({low}, '_id')
             OR (contains({low}, 'id') AND length(col) <= 12)) AS usable, {named} AS named FROM s),
a AS (SELECT tbl, col, CAST(filled AS DOUBLE) / n AS share, 'names' AS stage, NULL AS score, 1 AS st, named AS k, o FROM u WHERE named > 0
      UNION ALL SELECT tbl, col, CAST(filled AS DOUBLE) / n, 'numbers', ratio - abs(spread - 0.2), 2, -(ratio - abs(spread - 0.2)), o FROM u WHERE usable AND ratio >= 0.85 AND spread <= 0.95
      UNION ALL SELECT tbl, col, CAST(filled AS DOUBLE) / n, 'parts', NULL, 3, o, o FROM u WHERE usable AND ({part}) AND CASE WHEN ratio >= 0.3 THEN numbers > 1
        ELSE CAST(filled AS DOUBLE) / n >= 0.3 AND CAST(texts AS DOUBLE) / n <= 0.95 AND texts > 1 END),
r AS (SELECT *, row_number() OVER (PARTITION BY tbl ORDER BY st, k, o) AS r FROM a)
SELECT t.tbl AS "table", r.col AS target, coalesce(r.stage, 'none') AS stage, round(r.score, 8) AS score, round(r.share, 8) AS filled_share
FROM (SELECT DISTINCT tbl FROM s) t LEFT JOIN r ON r.tbl = t.tbl AND r.r = 1"""


@query("pr_target_score", _target_sql())
def pr_target_score(spark, sf_dir):
    tables = _tables(spark, sf_dir, TARGETS) | {"scored": bound(spark, sf_dir, SCORED), "rated": bound(spark, sf_dir, RATED)}
    return profile.infer_targets(tables).withColumns({c: F.round(c, 8) for c in ("score", "filled_share")})


#: Tables of two tasks: the first has label names in different cases, the second none, and an empty one among its targets.
LABELLED = {
    "task_0": {
        "training_0": ("SELECT doc_id, toxic AS risk_category FROM labels", ["doc_id", "risk_category"]),
        "training_1": ("SELECT doc_id, quality AS LABEL, toxic AS Grade FROM labels", ["doc_id", "LABEL", "Grade"]),
        "training_2": ("SELECT o_orderkey AS Y, o_totalprice AS total FROM orders", ["Y", "total"]),
    },
    "task_1": {
        "training_3": ("SELECT r_name AS name, CASE WHEN r_regionkey < 0 THEN 1.0 END AS price FROM region", ["name", "price"]),
        "training_4": ("SELECT s_suppkey AS supp_id, s_nationkey AS nation, s_acctbal AS balance FROM supplier", ["supp_id", "nation", "balance"]),
        "training_5": ("SELECT o_orderkey AS orderkey, o_totalprice AS sales FROM orders", ["orderkey", "sales"]),
    },
}


def _labelled(spark, sf_dir):
    out = None
    for task, tables in LABELLED.items():
        one = relate.column_table({t: bound(spark, sf_dir, q) for t, (q, _) in tables.items()}).withColumn("task_id", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out


LABELLED_SQL = "\nUNION ALL ".join(
    f"SELECT '{task}' AS task_id, '{t}' AS tbl, {i} AS table_idx, {k} AS ordinal, '{c}' AS col FROM (SELECT count(*) FROM ({q}))"
    for task, tables in LABELLED.items()
    for i, (t, (q, names)) in enumerate(tables.items())
    for k, c in enumerate(names)
)
_WANTED = lambda names: ", ".join(f"({i}, '{n.lower()}')" for i, n in enumerate(names))


#: Headers of the tables of tasks, of which each event is a column.
HEADERS = """SELECT concat('task_', user_id) AS task_id, event_type AS tbl, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS table_idx, event_id AS ordinal,
CASE event_id % 41 WHEN 0 THEN 'SCORE' WHEN 1 THEN 'Label' WHEN 2 THEN 'target' WHEN 3 THEN 'y' WHEN 4 THEN 'Outcome' ELSE concat('c', event_id) END AS col FROM events"""


@query(
    "pr_label_name_first",
    f"""WITH c AS ({HEADERS}), w AS (SELECT * FROM (VALUES {_WANTED(profile.LABEL_PRIORITY)}) v(prio, low))
SELECT task_id, tbl AS "table", col AS label
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY prio, table_idx, ordinal DESC) AS r FROM c JOIN w ON lower(c.col) = w.low) WHERE r = 1""",
)
def pr_label_name_first(spark, sf_dir):
    return profile.label_name_first(bound(spark, sf_dir, HEADERS).withColumnsRenamed({"tbl": "table", "col": "column"}))


_UNNAMED = LABELLED["task_1"]


@query(
    "pr_label_table_first",
    f"""WITH c AS ({LABELLED_SQL}), w AS (SELECT * FROM (VALUES {_WANTED(profile.TABLE_FIRST_NAMES)}) v(prio, low)),
named AS (SELECT task_id, tbl, col AS label
          FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY table_idx, prio, ordinal DESC) AS r FROM c JOIN w ON lower(c.col) = w.low) WHERE r = 1),
t AS ({_target_sql({t: q for t, (q, _) in _UNNAMED.items()}, {t: n for t, (_, n) in _UNNAMED.items()})}),
second AS (SELECT task_id, c.tbl, target AS label, row_number() OVER (PARTITION BY task_id ORDER BY table_idx) AS r
           FROM (SELECT DISTINCT task_id, tbl, table_idx FROM c WHERE task_id NOT IN (SELECT task_id FROM named)) c JOIN t ON t."table" = c.tbl
           WHERE target IS NOT NULL AND filled_share > 0.05)
SELECT task_id, tbl AS "table", label FROM named UNION ALL SELECT task_id, tbl, label FROM second WHERE r = 1""",
)
def pr_label_table_first(spark, sf_dir):
    targets = profile.infer_targets({t: bound(spark, sf_dir, q) for t, (q, _) in _UNNAMED.items()})
    return profile.label_table_first(_labelled(spark, sf_dir), targets)
