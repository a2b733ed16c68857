"""Schema evolution of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabdrift.functions.stored import written
from tabdrift.operators import evolve, profile, relate
from tabdrift.plans.bindings import SCHEMAS, bound, plain, table
from tabdrift.plans.profile_queries import dated
from tabdrift.plans.registry import query
from tabdrift.plans.relate_queries import columns_sql

SEED = 7
H = "CAST(('0x' || substr(sha1({x}), 1, 8)) AS BIGINT)"
SEED_SQL = H.format(x=f"'{SEED}:' || {{t}}")


@query("ev_task_seed", f"SELECT DISTINCT user_id, {SEED_SQL.format(t=chr(39) + 'task_' + chr(39) + ' || user_id')} AS seed FROM events")
def ev_task_seed(spark, sf_dir):
    users = bound(spark, sf_dir, "SELECT DISTINCT user_id FROM events")
    return users.select("user_id", evolve.task_seed(F.lit(SEED), F.concat(F.lit("task_"), F.col("user_id").cast("string"))).alias("seed"))


TASK = "CASE WHEN {t} IN ('lineitem', 'orders', 'customer') THEN 'sales' WHEN {t} IN ('nation', 'region', 'supplier') THEN 'places' ELSE 'parts' END"


#: What stands for the label of a task, by priority.
LABELS = ["TotalPrice", "retailprice", "acctbal"]


def _plan_columns(spark, sf_dir):
    shown = relate.column_table({t: table(spark, sf_dir, t) for t in SCHEMAS})
    return shown.select(F.expr(TASK.format(t="table")).alias("task_id"), "table", "table_idx", "ordinal", "column")


_DETECTED = """SELECT CASE WHEN avg(CASE WHEN try_strptime(v, '%Y-%m-%d') IS NULL THEN 0 ELSE 1 END) >= 0.99 THEN 'yyyy-M-d'
  WHEN avg(CASE WHEN try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NULL THEN 0 ELSE 1 END) >= 0.99 THEN 'yyyy-M-d H:m:s' END
  FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY {k} LIMIT 300)"""


def _formats(spark, sf_dir):
    values = [profile.first_values(table(spark, sf_dir, t), "orderkey", [c], 300) for t, c in (("orders", "orderdate"), ("lineitem", "shipdate"))]
    return profile.date_formats(values[0].unionByName(values[1])).select(F.lit("sales").alias("task_id"), "column", "format")


def _plan_sql(shown: str, formats: str) -> str:
    """The plans of the columns ``shown`` (task_id, tbl, table_idx, ordinal, col); ``formats`` gives a date column's format."""
    bad = r"trim(col) = '' OR starts_with(lower(trim(col)), 'unnamed') OR regexp_matches(col, '^_c\d+$')"
    said = lambda words: "(" + " OR ".join(f"contains(lower(col), '{w}')" for w in words) + ")"
    chance = lambda use: f"sha1(seed || ':{use}:' || col)"
    some = lambda cond, order: f"arg_min(col, {order}) FILTER ({cond})"
    draw = lambda use, values, kind: f"CASE {H.format(x=f'seed || {chr(39)}:{use}{chr(39)}')} % {len(values)} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END" if not kind else f"CAST({draw(use, values, '')} AS {kind})"
    free = "NOT is_key"
    return f"""WITH c AS ({shown}), w AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n.lower()}')" for i, n in enumerate(LABELS))}) v(prio, low)),
lab AS (SELECT task_id, col AS label_col FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY prio, table_idx, ordinal DESC) AS r
        FROM c JOIN w ON lower(c.col) = w.low) WHERE r = 1),
many AS (SELECT task_id FROM c GROUP BY task_id HAVING count(DISTINCT tbl) >= 2),
k AS (SELECT task_id, col FROM c WHERE task_id IN (SELECT task_id FROM many) AND NOT ({bad}) GROUP BY ALL HAVING count(DISTINCT tbl) >= 2),
u AS (SELECT c.task_id, c.col, min(table_idx * 1000000000000 + ordinal) AS p, any_value(k.col IS NOT NULL) AS is_key, {SEED_SQL.format(t="c.task_id")} AS seed
      FROM c LEFT JOIN k ON k.task_id = c.task_id AND k.col = c.col WHERE NOT EXISTS (FROM lab WHERE lab.task_id = c.task_id AND lab.label_col = c.col)
      AND NOT starts_with(c.col, '__') AND NOT ({bad.replace("col", "c.col")}) GROUP BY c.task_id, c.col),
g AS (SELECT task_id, seed, coalesce(string_agg(col, ',' ORDER BY col) FILTER (is_key), '') AS join_keys,
  coalesce({some(free, chance("rename"))}, arg_min(col, {chance("rename")})) AS rename_col,
  coalesce({some(free, chance("drop"))}, arg_min(col, {chance("drop")})) AS drop_col,
  {some("contains(lower(col), 'addr')", "p")} AS address_col,
  {some("contains(lower(col), 'date') OR contains(lower(col), 'time') OR ends_with(lower(col), '_dt')", chance("date"))} AS datetime_col,
  coalesce({some(said(evolve.MONEY), "p")}, {some(free, chance("money"))}, arg_min(col, {chance("money")})) AS meaning_num_col,
  coalesce({some(said(evolve.CATEGORY), "p")}, {some(free, chance("category"))}, arg_min(col, {chance("category")})) AS meaning_cat_col
  FROM u GROUP BY task_id, seed)
SELECT *, {formats} AS datetime_format, {draw("date_rule", evolve.DATE_RULES, "")} AS datetime_rule, {draw("topk", evolve.TOP_K, "INTEGER")} AS category_keep_topk,
       {draw("divisor", evolve.DIVISORS, "DOUBLE")} AS unit_scale_divisor FROM g LEFT JOIN lab USING (task_id)"""


_STARS = f"""SELECT {TASK.format(t="tbl")} AS task_id, tbl, table_idx, ordinal, col FROM ({columns_sql({t: t for t in SCHEMAS})})"""
_STAR_FORMATS = f"""CASE datetime_col WHEN 'orderdate' THEN ({_DETECTED.format(c="o_orderdate", t="orders", k="o_orderkey")})
  WHEN 'shipdate' THEN ({_DETECTED.format(c="l_shipdate", t="lineitem", k="l_orderkey")}) END"""


@query("ev_plan", _plan_sql(_STARS, _STAR_FORMATS))
def ev_plan(spark, sf_dir):
    names = written(_plan_columns(spark, sf_dir), "columns")
    labels = profile.label_name_first(names, LABELS).select("task_id", F.col("label").alias("label_col"))
    plan = evolve.plans(names, SEED, protected=labels.withColumnRenamed("label_col", "column"), formats=_formats(spark, sf_dir))
    return plan.join(labels, "task_id", "left").withColumn("join_keys", F.array_join("join_keys", ","))


#: Columns of the tables of tasks, of which each event is one, with a value of it.
TASK_COLUMNS = """SELECT concat('task_', user_id) AS task_id, event_type AS tbl, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS table_idx, event_id AS ordinal,
CASE WHEN event_id % 8 = 0 THEN concat('ship_date_', user_id % 3) WHEN event_id % 8 = 1 AND value > 60 THEN 'UnitPrice' WHEN event_id % 37 = 2 THEN 'category' WHEN event_id % 41 = 3 THEN 'home_address'
  WHEN event_id % 43 = 4 THEN 'TotalPrice' WHEN event_id % 47 = 5 THEN 'acctbal' WHEN event_id % 29 = 6 THEN 'Unnamed: 1' WHEN event_id % 31 = 7 THEN '__hidden' WHEN event_id % 53 = 8 THEN ' '
  ELSE concat('c', event_id % 50) END AS col,
CASE WHEN event_id % 7 < user_id % 4 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS {text}) END AS value FROM events"""
_TASK_FORMATS = f"""(SELECT CASE WHEN avg(CASE WHEN value = 'soon' THEN 0 ELSE 1 END) >= 0.8 THEN 'yyyy-M-d' END FROM ({TASK_COLUMNS.format(text="VARCHAR")}) f
  WHERE f.task_id = g.task_id AND f.col = g.datetime_col)"""


@query("ev_plan_tasks", _plan_sql(TASK_COLUMNS.format(text="VARCHAR"), _TASK_FORMATS))
def ev_plan_tasks(spark, sf_dir):
    """Plans of many tasks, their columns, labels and date formats being rows."""
    names = written(bound(spark, sf_dir, TASK_COLUMNS.format(text="STRING")).withColumnsRenamed({"tbl": "table", "col": "column"}), "columns")
    labels = profile.label_name_first(names, LABELS).select("task_id", F.col("label").alias("label_col"))
    dated_ = names.filter(F.lower("column").contains("date")).select("task_id", F.lit(0).alias("ordinal"), "column", "value")
    plan = evolve.plans(names, SEED, protected=labels.withColumnRenamed("label_col", "column"), formats=profile.date_formats(dated_, by=["task_id"]))
    return plan.join(labels, "task_id", "left").withColumn("join_keys", F.array_join("join_keys", ","))


@query(
    "ev_add",
    f"""SELECT *, 'unknown' AS __new_constant, CASE WHEN {H.format(x="'7:' || partkey")} / 4294967296.0 < 0.2 THEN 1.0::DOUBLE END AS __new_sparse,
row_number() OVER (ORDER BY partkey) - 1 AS __row_id FROM ({plain("part")})""",
)
def ev_add(spark, sf_dir):
    return evolve.add_columns(table(spark, sf_dir, "part"), SEED, "partkey")


@query("ev_rename", f"SELECT * RENAME (brand AS brand__renamed) FROM ({plain('part')})")
def ev_rename(spark, sf_dir):
    return evolve.rename_column(evolve.rename_column(table(spark, sf_dir, "part"), "brand"), "size", protected=["size"])


@query("ev_drop", f"SELECT * EXCLUDE (type) FROM ({plain('part')})")
def ev_drop(spark, sf_dir):
    return evolve.drop_column(evolve.drop_column(table(spark, sf_dir, "part"), "type"), "missing")


@query(
    "ev_type_flip_date",
    f"""WITH d AS ({dated("duckdb")}), p AS (SELECT id, try_strptime(iso, '%Y-%m-%d') AS a, try_strptime(us, '%m/%d/%Y') AS b FROM d)
SELECT id, strftime(a, '%Y-%m-%d 00:00:00') AS iso, strftime(b, '%Y-%m-%d 00:00:00') AS us,
       (SELECT mixed FROM d x WHERE x.id = p.id) AS mixed FROM p""",
)
def ev_type_flip_date(spark, sf_dir):
    df = bound(spark, sf_dir, dated("spark")).select("id", "iso", "us", "mixed")
    for c, f in (("iso", "yyyy-M-d"), ("us", "M/d/yyyy"), ("mixed", "d/M/yyyy")):
        df = evolve.flip_date_time(df, c, f)
    return df


@query(
    "ev_type_date_parts",
    f"""WITH d AS ({dated("duckdb")}), p AS (SELECT id, us, try_strptime(us, '%m/%d/%Y') AS a FROM d)
SELECT id, us, CAST(year(a) AS INTEGER) AS us_year, CAST(month(a) AS INTEGER) AS us_month, CAST(day(a) AS INTEGER) AS us_day FROM p""",
)
def ev_type_date_parts(spark, sf_dir):
    return evolve.split_date(bound(spark, sf_dir, dated("spark")).select("id", "us"), "us", "M/d/yyyy")


TEXT_SIZE = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' WHEN p_partkey % 5 = 1 THEN concat(p_size, 'd') ELSE concat(' ', p_size, '.5 ') END AS size_text FROM part"


@query("ev_type_to_numeric", f"SELECT id, CASE WHEN id % 5 IN (0, 1) THEN NULL ELSE CAST(trim(size_text) AS DOUBLE) END AS size_text FROM ({TEXT_SIZE})")
def ev_type_to_numeric(spark, sf_dir):
    return evolve.to_numeric(bound(spark, sf_dir, TEXT_SIZE), "size_text")


@query("ev_meaning_unit_scale", f"SELECT partkey, brand, round(retailprice / 1000, 6) AS retailprice FROM ({plain('part')})")
def ev_meaning_unit_scale(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("partkey", "brand", "retailprice")
    return evolve.unit_scale(evolve.unit_scale(df, "retailprice", 1000), "brand", 10).withColumn("retailprice", F.round("retailprice", 6))


NAMES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS name, p_brand AS brand FROM part"


@query(
    "ev_meaning_topk_other",
    f"""WITH n AS ({NAMES}), a AS (SELECT name FROM n WHERE name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, min(id) LIMIT 5),
b AS (SELECT brand FROM n GROUP BY brand ORDER BY count(*) DESC, min(id) LIMIT 2)
SELECT id, CASE WHEN name IN (SELECT name FROM a) THEN name ELSE 'Other' END AS name, CASE WHEN brand IN (SELECT brand FROM b) THEN brand ELSE 'Other' END AS brand FROM n""",
)
def ev_meaning_topk_other(spark, sf_dir):
    return evolve.collapse_categories(evolve.collapse_categories(bound(spark, sf_dir, NAMES), "name", 5, "id"), "brand", 2, "id")


BLANK = "SELECT p_partkey AS id, CASE WHEN p_partkey < 0 THEN p_name END AS blank FROM part"


@query("ev_meaning_no_values", f"SELECT id, blank FROM ({BLANK}) b")
def ev_meaning_no_values(spark, sf_dir):
    """A column without values has no categories to collapse."""
    return evolve.collapse_categories(bound(spark, sf_dir, BLANK), "blank", 5, "id")


#: Shapes of address tables and the parts that are found in them.
SHAPES = {
    "SELECT c_custkey AS id, c_name AS provider_street_address, c_mktsegment AS provider_city, c_nationkey AS provider_zip_code FROM customer": ("provider_street_address", "city=provider_city,street=provider_street_address,zip=provider_zip_code"),
    "SELECT s_suppkey AS id, s_name AS town, s_nationkey AS ZipCode, s_acctbal AS region FROM supplier": (None, "city=town,region=region,zip=ZipCode"),
    "SELECT o_orderkey AS id, o_orderstatus AS contributor_state, o_orderpriority AS contributor_city, o_custkey AS contributor_zip FROM orders": (None, "city=contributor_city,state=contributor_state,zip=contributor_zip"),
    "SELECT p_partkey AS id, p_name AS name FROM part": (None, ""),
}


@query("ev_address_parts", "\nUNION ALL ".join(f"SELECT {i} AS shape, '{found}' AS parts, count(*) AS n_rows FROM ({q})" for i, (q, (_, found)) in enumerate(SHAPES.items())))
def ev_address_parts(spark, sf_dir):
    out = None
    for i, (q, (base, _)) in enumerate(SHAPES.items()):
        df = bound(spark, sf_dir, q)
        parts = ",".join(f"{p}={n}" for p, n in sorted(evolve.address_parts(df.columns, base).items()))
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(i).alias("shape"), F.lit(parts).alias("parts"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


PARTS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat(' ', c_name, ' ') END AS street, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS city,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS zip, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'X' END AS country FROM customer"""


@query(
    "ev_address_combine",
    f"""WITH p AS ({PARTS}) SELECT id, nullif(concat_ws(', ', nullif(trim(street), ''), nullif(trim(city), ''), CAST(CAST(zip AS BIGINT) AS VARCHAR), country), '') AS street_full_address FROM p""",
)
def ev_address_combine(spark, sf_dir):
    return evolve.evolve_address(bound(spark, sf_dir, PARTS))


FREE = """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN concat(c_name, ', ', c_mktsegment)
ELSE concat(c_name, ' , ', c_mktsegment, ',', c_nationkey, ', rest') END AS home_addr FROM customer"""


@query(
    "ev_address_split",
    f"""WITH f AS ({FREE}), s AS (SELECT id, split_part(home_addr, ',', 1) AS a, split_part(home_addr, ',', 2) AS b,
  array_to_string(string_split(home_addr, ',')[3:], ',') AS c FROM f)
SELECT id, nullif(trim(a), '') AS home_addr_street, nullif(trim(b), '') AS home_addr_city, nullif(trim(c), '') AS home_addr_region FROM s""",
)
def ev_address_split(spark, sf_dir):
    return evolve.evolve_address(bound(spark, sf_dir, FREE), "home_addr")


APPLIED = {"rename": ("brand__renamed", "brand"), "drop": ("", "type"), "add": ("__new_constant,__new_sparse,__row_id", "")}
APPLY_PLAN = {"seed": SEED, "rename_col": "brand", "drop_col": "type"}


@query(
    "ev_apply_log",
    "\nUNION ALL ".join(
        f"SELECT '{op}' AS op, count(*) AS rows_before, count(*) AS rows_after, '{a}' AS added, '{r}' AS removed FROM part" for op, (a, r) in APPLIED.items()
    ),
)
def ev_apply_log(spark, sf_dir):
    before, out = table(spark, sf_dir, "part"), None
    for op in APPLIED:
        after = evolve.evolve(before, [op], APPLY_PLAN, "partkey")
        names = lambda df: spark.createDataFrame([("part", c, d) for c, d in profile.dtype_names(df)], "table string, column string, dtype string")
        diff = profile.schema_diff(names(before), names(after)).select(F.lit(op).alias("op"), F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))
        counts = before.agg(F.count("*").alias("rows_before"), F.lit(op).alias("op")).join(after.agg(F.count("*").alias("rows_after"), F.lit(op).alias("op")), "op")
        one = diff.join(counts, "op").select("op", "rows_before", "rows_after", "added", "removed")
        out = one if out is None else out.unionByName(one)
    return out


#: A table that every kind of operator finds something in, and the plan for it.
GOODS = """SELECT p_partkey AS id, p_brand AS brand, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS product,
CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE concat(' ', p_size) END AS size_text, p_retailprice AS price,
CASE WHEN p_partkey % 4 = 0 THEN 'soon' ELSE '2024-02-03' END AS made FROM part"""
GOODS_PLAN = {
    "seed": SEED, "rename_col": "brand", "drop_col": "nowhere", "datetime_col": "made", "datetime_format": "yyyy-M-d", "datetime_rule": "flip_date_time",
    "meaning_num_col": "price", "meaning_cat_col": "product", "unit_scale_divisor": 1000.0, "category_keep_topk": 5, "address_col": None,
}
NO = "CAST(NULL AS DOUBLE)"


def _infos_sql() -> str:
    def row(step, op, rule=None, column=None, note=None, figures="", source="(SELECT count(*) FROM g)"):
        text = lambda x: f"'{x}'" if x else "CAST(NULL AS VARCHAR)"
        have = {n: NO for n in ("valid_ratio", "has_time_ratio", "before_ratio", "after_ratio", "mean_before", "mean_after", "mapped_to_other_ratio")}
        have |= dict.fromkeys(("cardinality_before", "cardinality_after"), "CAST(NULL AS BIGINT)") | dict(f.split("=", 1) for f in figures.split(";") if f)
        return f"SELECT {step} AS step, '{op}' AS op, {text(rule)} AS rule, {text(column)} AS \"column\", {text(note)} AS note, " + ", ".join(f"{x} AS {n}" for n, x in have.items()) + f" FROM {source}"

    share = lambda cond: f"round(avg(CASE WHEN {cond} THEN 1 ELSE 0 END), 8)"
    top = "(SELECT product, count(*) AS n, min(id) AS f FROM g WHERE product IS NOT NULL GROUP BY product ORDER BY n DESC, f, product LIMIT 5)"
    return f"WITH g AS ({GOODS}) " + "\nUNION ALL ".join([
        row(0, "rename", "rename", "brand"),
        row(1, "drop", None, "nowhere", "not in this table"),
        row(2, "type", "datetime_to_date", "made", None, f"valid_ratio={share('id % 4 <> 0')};has_time_ratio={share('id % 4 = 0')}", "g"),
        row(2, "type", "to_numeric", "size_text", None, f"before_ratio=0.0;after_ratio={share('id % 5 = 0')}", "g"),
        row(3, "meaning", "divide_by_1000", "price", None, "mean_before=round(avg(price), 6);mean_after=round(avg(price / 1000), 6)", "g"),
        row(3, "meaning", "keep_top5_else_Other", "product", None,
            f"cardinality_before=count(DISTINCT product);cardinality_after=(SELECT count(*) FROM {top}) + CASE WHEN (SELECT sum(n) FROM {top}) < count(*) THEN 1 ELSE 0 END;"
            f"mapped_to_other_ratio=round((count(product) - (SELECT sum(n) FROM {top})) / count(*), 8)", "g"),
        row(4, "add", "sparse", "__new_sparse", None, f"after_ratio=round(avg(CASE WHEN {H.format(x=chr(39) + '7:' + chr(39) + ' || id')} / 4294967296.0 < 0.2 THEN 1 ELSE 0 END), 8)", "g"),
        row(5, "address_split", None, None, "nothing to combine or split"),
    ])


@query("ev_op_infos", _infos_sql())
def ev_op_infos(spark, sf_dir):
    """What each operator of a plan reports of the table as it stands when its turn comes."""
    _, log = evolve.evolve_log(bound(spark, sf_dir, GOODS), ["rename", "drop", "type", "meaning", "add", "address_split"], GOODS_PLAN, "id")
    places = {c: 6 if c.startswith("mean") else 8 for c, t in log.dtypes if t == "double"}
    return log.withColumns({c: F.round(c, n) for c, n in places.items()})


FILES = """SELECT concat('task_', user_id) AS task_id, CASE event_type WHEN 'click' THEN 'training' WHEN 'view' THEN 'test' WHEN 'purchase' THEN 'target' ELSE 'other' END AS role,
CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'Score' END AS label, user_id % 7 = 0 AS done, event_id % 211 = 0 AS broken FROM events
WHERE NOT (user_id % 5 = 1 AND event_type = 'purchase') AND NOT (user_id % 5 = 2 AND event_type IN ('click', 'view'))"""


@query(
    "ev_batch_summary",
    f"""WITH f AS ({FILES}), g AS (SELECT task_id, count(*) FILTER (role = 'training') AS n_training_files, count(*) FILTER (role = 'test') AS n_test_files,
  count(*) FILTER (role = 'target') > 0 AS target_present, max(label) AS label, bool_or(done) AS done, bool_or(broken) AS broken FROM f GROUP BY task_id),
s AS (SELECT *, CASE WHEN done THEN 'skipped_resume_exists' WHEN NOT target_present THEN 'skipped_no_target'
  WHEN n_training_files = 0 AND n_test_files = 0 THEN 'skipped_no_train_test' WHEN broken THEN 'failed' ELSE 'ok' END AS status FROM g)
SELECT task_id, n_training_files, n_test_files, target_present, status, CASE WHEN status = 'ok' THEN label END AS label_col FROM s""",
)
def ev_batch_summary(spark, sf_dir):
    return evolve.batch_summary(bound(spark, sf_dir, FILES))
