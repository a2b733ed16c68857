"""Label and feature preparation, fitting and scoring over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabdrift.functions.dates import EVALUATE_FORMATS
from tabdrift.functions.stored import written
from tabdrift.operators import drift, evolve, model, prep
from tabdrift.plans.bindings import CLASSES, REGRESSION, bound, plain, table
from tabdrift.plans.profile_queries import dated
from tabdrift.plans.registry import query

#: Candidate labels: boolean, whole numbers, texts, numbers, and none at all.
LABELS = """SELECT 'quality' AS task, CAST(quality AS {text}) AS label FROM labels
UNION ALL SELECT 'linenumber', CAST(l_linenumber AS {text}) FROM lineitem
UNION ALL SELECT 'orderstatus', CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END FROM orders
UNION ALL SELECT 'totalprice', CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS {text}) END FROM orders
UNION ALL SELECT 'empty', NULL FROM nation"""
NUM = r"CASE WHEN regexp_matches(label, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN TRY_CAST(label AS DOUBLE) END"
KIND_OF = f"""l AS ({{labels}}), x AS (SELECT task, label, {NUM} AS x FROM l),
s AS (SELECT task, count(*) AS n, coalesce(bool_and(lower(label) IN ('true', 'false') OR coalesce(x IN (0, 1), false)) FILTER (label IS NOT NULL), true) AS b,
  count(x) AS numbers, count(DISTINCT x) AS kinds, coalesce(bool_and(abs(x - round_even(x, 0)) <= 1e-8 + 1e-5 * abs(round_even(x, 0))) FILTER (x IS NOT NULL), false) AS whole,
  count(DISTINCT label) AS n_distinct FROM x GROUP BY task),
k AS (SELECT task, n, n_distinct, CASE WHEN b THEN 'boolean_class' WHEN numbers >= 0.85 * n AND whole AND kinds <= 20 AND kinds < 0.2 * numbers THEN 'integer_class'
  WHEN numbers >= 0.85 * n THEN 'regression' ELSE 'text_class' END AS kind FROM s)"""
KIND_SQL = KIND_OF.format(labels=LABELS.format(text="VARCHAR"))


def _kinds(spark, sf_dir):
    return prep.label_kind(bound(spark, sf_dir, LABELS.format(text="STRING")), "label", ["task"])


@query("fp_label_kind", f"WITH {KIND_SQL} SELECT task, kind, n, n_distinct FROM k")
def fp_label_kind(spark, sf_dir):
    return _kinds(spark, sf_dir)


STATUS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS label FROM orders"


@query("fp_label_codes", f"WITH s AS ({STATUS}) SELECT id, CAST(dense_rank() OVER (ORDER BY coalesce(label, 'NA')) - 1 AS DOUBLE) AS y FROM s")
def fp_label_codes(spark, sf_dir):
    return prep.label_codes(bound(spark, sf_dir, STATUS), "label", "text_class").select("id", "y")


@query(
    "fp_label_gate",
    f"""WITH {KIND_SQL} SELECT task, kind, n, CASE WHEN n < 10 THEN 'too few usable training rows' WHEN kind <> 'regression' AND n_distinct < 2 THEN 'only one class' END AS error FROM k""",
)
def fp_label_gate(spark, sf_dir):
    return _kinds(spark, sf_dir).withColumn("error", prep.usable(F.col("kind"), F.col("n"), F.col("n_distinct"))).drop("n_distinct")


OTHER = "SELECT id, iso, CASE WHEN id % 4 = 0 THEN 'x' ELSE us END AS us, full_time FROM ({d}) d"
VALID = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{f}' AS format, round((SELECT avg(CASE WHEN try_strptime({c}, '{EVALUATE_FORMATS[f]}') IS NULL THEN 0 ELSE 1 END) FROM d), 8) AS train_valid_ratio,
round((SELECT avg(CASE WHEN try_strptime({c}, '{EVALUATE_FORMATS[f]}') IS NULL THEN 0 ELSE 1 END) FROM o), 8) AS other_valid_ratio"""
    for c, f in (("iso", "yyyy-M-d"), ("us", "M/d/yyyy"), ("full_time", "yyyy-M-d H:m:s"))
)


@query("fp_parse_dates", f"WITH d AS ({dated('duckdb')}), o AS ({OTHER.format(d=dated('duckdb'))}) {VALID}")
def fp_parse_dates(spark, sf_dir):
    train = bound(spark, sf_dir, dated("spark")).select("id", "iso", "us", "full_time")
    other = bound(spark, sf_dir, OTHER.format(d=dated("spark")))
    formats = prep.learn_dates(train, "id", ["iso", "us", "full_time"])
    known = spark.createDataFrame(list(formats.items()), "column string, format string")
    a = prep.valid_ratios(train, formats).withColumnRenamed("valid_ratio", "train_valid_ratio")
    b = prep.valid_ratios(other, formats).withColumnRenamed("valid_ratio", "other_valid_ratio")
    return known.join(a, "column").join(b, "column").withColumns({c: F.round(c, 8) for c in ("train_valid_ratio", "other_valid_ratio")})


@query(
    "fp_date_features",
    f"""WITH d AS ({dated("duckdb")}), p AS (SELECT id, try_strptime(us, '%m/%d/%Y') AS a FROM d)
SELECT id, CAST(year(a) AS INTEGER) AS us_year, CAST(month(a) AS INTEGER) AS us_month, CAST(day(a) AS INTEGER) AS us_day,
       CAST(NULL AS INTEGER) AS gone_year, CAST(NULL AS INTEGER) AS gone_month, CAST(NULL AS INTEGER) AS gone_day FROM p""",
)
def fp_date_features(spark, sf_dir):
    df = bound(spark, sf_dir, dated("spark")).select("id", "us")
    return prep.date_features(prep.parse_dates(df, {"us": "M/d/yyyy"}), ["us", "gone"])


EVOLVED = "SELECT o_orderpriority AS orderpriority, o_orderkey AS orderkey, o_totalprice AS totalprice, 1 AS extra FROM orders"


@query("fp_align_stability", "SELECT o_orderkey AS orderkey, CAST(NULL AS BIGINT) AS custkey, CAST(NULL AS VARCHAR) AS orderstatus, o_totalprice AS totalprice FROM orders")
def fp_align_stability(spark, sf_dir):
    train = table(spark, sf_dir, "orders").select("orderkey", "custkey", "orderstatus", "totalprice")
    return prep.align(bound(spark, sf_dir, EVOLVED), train.dtypes)


def _columns(spark, sf_dir, names):
    """Columns of tables as task_id, ordinal, column, with a count that reads each table."""
    out = None
    for task, q in names.items():
        df = bound(spark, sf_dir, q)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(task).alias("task_id"), F.posexplode(F.array(*(F.lit(c) for c in df.columns))).alias("ordinal", "column"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


TRAINED = {"orders": plain("orders"), "part": plain("part")}
TESTED = {"orders": EVOLVED, "part": plain("part")}


@query(
    "fp_align_strict",
    """SELECT 'orders' AS task_id, 'custkey,orderstatus,orderdate' AS first_missing, 'extra' AS extra, 3 AS n_missing, 'STRICT_SCHEMA_FAIL' AS strict, count(*) AS n_rows FROM orders
UNION ALL SELECT 'part', '', '', 0, 'ok', count(*) FROM part""",
)
def fp_align_strict(spark, sf_dir):
    train = _columns(spark, sf_dir, TRAINED)
    out = prep.align_report(train, _columns(spark, sf_dir, TESTED))
    rows = train.select("task_id", "n_rows").distinct()
    return out.select("task_id", F.array_join("first_missing", ",").alias("first_missing"), F.array_join("extra", ",").alias("extra"), "n_missing", "strict").join(rows, "task_id")


#: Columns of the training and test side of tasks, of which each event is one; every fourth task's test side has all.
SIDE = """SELECT concat('task_', user_id) AS task_id, concat('c', event_id % 60) AS col, min(event_id) AS ordinal FROM events WHERE {side} GROUP BY 1, 2"""
SIDES = [SIDE.format(side="event_id % 3 <> 0"), SIDE.format(side="user_id % 4 = 0 OR event_id % 3 <> 1 OR value > 60")]


@query(
    "fp_align_strict_tasks",
    f"""WITH a AS ({SIDES[0]}), b AS ({SIDES[1]}), j AS (SELECT task_id, col, a.ordinal AS i, b.ordinal AS j FROM a FULL JOIN b USING (task_id, col)),
m AS (SELECT *, CASE WHEN j IS NULL THEN row_number() OVER (PARTITION BY task_id, j IS NULL ORDER BY i) END AS r FROM j)
SELECT task_id, coalesce(string_agg(col, ',' ORDER BY i) FILTER (r <= 20), '') AS first_missing, coalesce(string_agg(col, ',' ORDER BY j) FILTER (i IS NULL), '') AS extra,
CAST(count(r) AS INTEGER) AS n_missing, CASE WHEN count(r) > 0 THEN 'STRICT_SCHEMA_FAIL' ELSE 'ok' END AS strict FROM m GROUP BY task_id""",
)
def fp_align_strict_tasks(spark, sf_dir):
    """What the strict mode says of every task, the columns of both sides being rows."""
    train, test = (bound(spark, sf_dir, q).withColumnRenamed("col", "column") for q in SIDES)
    out = prep.align_report(train, test)
    return out.select("task_id", F.array_join("first_missing", ",").alias("first_missing"), F.array_join("extra", ",").alias("extra"), "n_missing", "strict")


HOLES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS mktsegment FROM customer"


@query("fp_impute_median", f"WITH h AS ({HOLES}) SELECT id, round(coalesce(acctbal, (SELECT median(acctbal) FROM h)), 6) AS acctbal FROM h")
def fp_impute_median(spark, sf_dir):
    df = bound(spark, sf_dir, HOLES)
    return prep.impute_median(df, df, ["acctbal"]).select("id", F.round("acctbal", 6).alias("acctbal"))


@query(
    "fp_impute_mode",
    f"""WITH h AS ({HOLES}) SELECT id, coalesce(mktsegment, (SELECT mktsegment FROM h WHERE mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, mktsegment LIMIT 1)) AS mktsegment FROM h""",
)
def fp_impute_mode(spark, sf_dir):
    df = bound(spark, sf_dir, HOLES)
    return prep.impute_mode(df, df, ["mktsegment"]).select("id", "mktsegment")


SEEN = "SELECT c_custkey AS id, c_mktsegment AS mktsegment FROM customer WHERE c_mktsegment <> 'MACHINERY'"
ALL_SEGMENTS = "SELECT c_custkey AS id, c_mktsegment AS mktsegment FROM customer"


@query(
    "fp_one_hot",
    f"""WITH v AS (SELECT mktsegment, CAST(row_number() OVER (ORDER BY mktsegment) - 1 AS INTEGER) AS slot FROM (SELECT DISTINCT mktsegment FROM ({SEEN})))
SELECT id, slot FROM ({ALL_SEGMENTS}) JOIN v USING (mktsegment)""",
)
def fp_one_hot(spark, sf_dir):
    return prep.one_hot(bound(spark, sf_dir, SEEN), bound(spark, sf_dir, ALL_SEGMENTS), "mktsegment", "id")


#: Rows for the ridge regression, half of them to train on, and the test rows rescaled.
ROWS = """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS id, l_quantity AS quantity, l_discount AS discount, l_extendedprice AS y, l_suppkey % 2 AS half
FROM lineitem"""
RIDGE_SQL = f"""r AS ({ROWS}), t AS (SELECT * FROM r WHERE half = 0),
m AS (SELECT count(*) AS n, avg(quantity) AS mq, avg(discount) AS md, avg(y) AS my, count(*) * var_pop(quantity) + 1 AS a, count(*) * covar_pop(quantity, discount) AS b,
  count(*) * var_pop(discount) + 1 AS d, count(*) * covar_pop(quantity, y) AS p, count(*) * covar_pop(discount, y) AS q FROM t),
w AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS wq, (a * q - b * p) / (a * d - b * b) AS wd FROM m),
f AS (SELECT wq, wd, my - wq * mq - wd * md AS w0 FROM w)"""


def _ridge(spark, sf_dir):
    rows = bound(spark, sf_dir, ROWS)
    return rows, model.ridge(rows.filter("half = 0"), ["quantity", "discount"], "y")


@query("ml_ridge", f"WITH {RIDGE_SQL} SELECT round(wq, 4) AS w_quantity, round(wd, 4) AS w_discount, round(w0, 4) AS intercept, (SELECT count(*) FROM t) AS n FROM f")
def ml_ridge(spark, sf_dir):
    rows, w = _ridge(spark, sf_dir)
    shown = [F.round(F.lit(w[k]), 4).alias(n) for k, n in (("quantity", "w_quantity"), ("discount", "w_discount"), ("_intercept", "intercept"))]
    return rows.filter("half = 0").agg(F.count("*").alias("n")).select(*shown, "n")


@query(
    "ml_score_pair",
    f"""WITH {RIDGE_SQL} SELECT id, round(w0 + wq * quantity + wd * discount, 2) AS base, round(w0 + wq * (quantity / 10) + wd * discount, 2) AS evo FROM r, f WHERE half = 1""",
)
def ml_score_pair(spark, sf_dir):
    rows, w = _ridge(spark, sf_dir)
    test = rows.filter("half = 1").select("id", "quantity", "discount")
    scored = model.score_pair(test, evolve.unit_scale(test, "quantity", 10), "id", w)
    return scored.withColumns({"base": F.round("base", 2), "evo": F.round("evo", 2)})


@query("ml_logistic")
def ml_logistic(spark, sf_dir):
    rows = bound(
        spark, sf_dir,
        """SELECT d.doc_id AS id, CAST(l.quality AS DOUBLE) AS y, CAST(d.n_chars AS DOUBLE) / 1000 AS chars, CASE WHEN d.lang = 'en' THEN 1.0 ELSE 0.0 END AS en
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    )
    from pyspark.ml.functions import vector_to_array

    fitted = model.logistic(rows, ["chars", "en"], "y")
    scored = fitted.transform(rows).withColumn("p_base", vector_to_array("probability"))
    return model.prediction_summary(scored.withColumn("task", F.lit("quality")), ["task"], "classification")


K = "task, variant, align_mode"


@query(
    "ml_pred_summary",
    f"""WITH c AS ({CLASSES}), p AS ({REGRESSION}),
e AS (SELECT {K}, avg(-(CASE WHEN b1 > 0 THEN b1 * ln(b1) ELSE 0 END + CASE WHEN b2 > 0 THEN b2 * ln(b2) ELSE 0 END + CASE WHEN b3 > 0 THEN b3 * ln(b3) ELSE 0 END)) AS h,
  avg(greatest(b1, b2, b3)) AS m FROM c GROUP BY {K}),
r AS (SELECT {K}, avg(base) AS mean, stddev_pop(base) AS sd FROM p GROUP BY {K})
SELECT {K}, round(h, 6) AS base_pred_entropy_mean, round(m, 6) AS base_pred_maxprob_mean, round(mean, 4) AS base_pred_mean, round(sd, 4) AS base_pred_std FROM e JOIN r USING ({K})""",
)
def ml_pred_summary(spark, sf_dir):
    keys = K.split(", ")
    a = model.prediction_summary(bound(spark, sf_dir, CLASSES).withColumn("p_base", F.array("b1", "b2", "b3")), keys, "classification")
    b = model.prediction_summary(bound(spark, sf_dir, REGRESSION), keys, "regression")
    return a.join(b, keys).withColumns({
        "base_pred_entropy_mean": F.round("base_pred_entropy_mean", 6), "base_pred_maxprob_mean": F.round("base_pred_maxprob_mean", 6),
        "base_pred_mean": F.round("base_pred_mean", 4), "base_pred_std": F.round("base_pred_std", 4),
    })


#: Rows for each distinct row from which equal rows are counted before they are scored.
REPEATED = 4


def _counted(rows):
    """Rows as they are with n = 1, or distinct ones with their number where they repeat, by an estimate."""
    names = rows.columns
    total, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*names))).first()
    return rows.groupBy(*names).agg(F.count("*").alias("n")) if total >= REPEATED * kinds else rows.withColumn("n", F.lit(1).cast("long"))


def schema_change_impact(spark, sf_dir):
    """The whole experiment: fit on baseline rows once, score them and each variant, drift per variant.

    A column that a variant has lost is null after alignment and takes the training median. A variant changes the columns of a row,
    so the row keeps its baseline prediction and is joined with nothing.
    """
    rows, w = _ridge(spark, sf_dir)
    train, test = (rows.filter(f"half = {h}").select("quantity", "discount") for h in (0, 1))
    test = written(_counted(test).withColumn("base", model.linear_score(w)), "impact-rows")
    schema, out = test.dtypes, None
    variants = {
        "baseline": test,
        "meaning": evolve.unit_scale(test, "quantity", 10),
        "drop": prep.impute_median(train, prep.align(evolve.drop_column(test, "discount"), schema), ["discount"]),
    }
    for name, df in variants.items():
        pairs = df.select(F.lit(name).alias("variant"), "base", model.linear_score(w).alias("evo"), "n")
        out = pairs if out is None else out.unionByName(pairs)
    return drift.regression_record(written(out, "impact-pairs"), ["variant"], "n")


@query("wf_schema_change_impact")
def wf_schema_change_impact(spark, sf_dir):
    return schema_change_impact(spark, sf_dir)
