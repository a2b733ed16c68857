"""Drift metrics over predictions bound to lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabdrift.functions.numbers import two_digits, two_digits_sql
from tabdrift.operators import drift
from tabdrift.plans.bindings import CLASSES, REGRESSION, bound
from tabdrift.plans.registry import query

KEYS = ["task", "variant", "align_mode"]
K = ", ".join(KEYS)


def _classes(spark, sf_dir) -> DataFrame:
    return bound(spark, sf_dir, CLASSES).withColumns({"p_base": F.array("b1", "b2", "b3"), "p_evo": F.array("e1", "e2", "e3")})


@query("dr_agreement", f"WITH p AS ({CLASSES}) SELECT {K}, round(avg(CASE WHEN base = evo THEN 1 ELSE 0 END), 6) AS agreement FROM p GROUP BY {K}")
def dr_agreement(spark, sf_dir):
    return drift.agreement(_classes(spark, sf_dir), KEYS).withColumn("agreement", F.round("agreement", 6))


_TERM = "0.5 * (CASE WHEN {x} > 0 THEN {x} * ln({x} / (({x} + {y}) / 2)) ELSE 0 END + CASE WHEN {y} > 0 THEN {y} * ln({y} / (({x} + {y}) / 2)) ELSE 0 END)"
JSD_ROWS = f"""
p AS ({CLASSES}),
s AS (SELECT *, b1 + b2 + b3 AS bs, e1 + e2 + e3 AS es FROM p),
j AS (SELECT {K}, base, evo, {" + ".join(_TERM.format(x=f"(b{i} / bs)", y=f"(e{i} / es)") for i in (1, 2, 3))} AS jsd FROM s)"""


@query("dr_jsd", f"WITH {JSD_ROWS} SELECT {K}, round(avg(jsd), 8) AS jsd FROM j GROUP BY {K}")
def dr_jsd(spark, sf_dir):
    return drift.mean_jsd(_classes(spark, sf_dir), KEYS).withColumn("jsd", F.round("jsd", 8))


@query("dr_rmse", f"WITH p AS ({REGRESSION}) SELECT {K}, round(sqrt(avg((evo - base) * (evo - base))), 4) AS rmse FROM p GROUP BY {K}")
def dr_rmse(spark, sf_dir):
    return drift.rmse(bound(spark, sf_dir, REGRESSION), KEYS).withColumn("rmse", F.round("rmse", 4))


KS_SQL = f"""
n AS (SELECT {K}, count(base) AS nb, count(evo) AS ne FROM p GROUP BY {K}),
v AS (SELECT {K}, v, sum(a) AS a, sum(b) AS b
      FROM (SELECT {K}, base AS v, 1 AS a, 0 AS b FROM p UNION ALL SELECT {K}, evo, 0, 1 FROM p) GROUP BY {K}, v),
c AS (SELECT {K}, sum(a) OVER w AS a, sum(b) OVER w AS b FROM v WINDOW w AS (PARTITION BY {K} ORDER BY v ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT {K}, max(abs(CAST(a AS DOUBLE) / nb - CAST(b AS DOUBLE) / ne)) AS ks FROM c JOIN n USING ({K}) GROUP BY {K})"""


@query("dr_ks", f"WITH p AS ({REGRESSION}), {KS_SQL} SELECT {K}, round(ks, 8) AS ks FROM ks")
def dr_ks(spark, sf_dir):
    return drift.ks_statistic(bound(spark, sf_dir, REGRESSION), KEYS).withColumn("ks", F.round("ks", 8))


SPEARMAN_SQL = f"""
r AS (SELECT {K},
        rank() OVER (PARTITION BY {K} ORDER BY base) + (count(*) OVER (PARTITION BY {K}, base) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY {K} ORDER BY evo) + (count(*) OVER (PARTITION BY {K}, evo) - 1) / 2.0 AS ry FROM p),
sp AS (SELECT {K}, corr(rx, ry) AS spearman FROM r GROUP BY {K})"""


@query("dr_spearman", f"WITH p AS ({REGRESSION}), {SPEARMAN_SQL} SELECT {K}, round(spearman, 6) AS spearman FROM sp")
def dr_spearman(spark, sf_dir):
    return drift.spearman(bound(spark, sf_dir, REGRESSION), KEYS).withColumn("spearman", F.round("spearman", 6))


_TWO = two_digits_sql


@query(
    "dr_silent_flag",
    f"""WITH {JSD_ROWS},
c AS (SELECT {K}, avg(CASE WHEN base = evo THEN 1 ELSE 0 END) AS agreement, avg(jsd) AS jsd FROM j GROUP BY {K})
SELECT {K}, {_TWO("agreement")} AS agreement, {_TWO("jsd")} AS jsd,
       ({_TWO("jsd")}) > 0.05 OR ({_TWO("agreement")}) < 0.95 AS silent_failure_candidate FROM c""",
)
def dr_silent_flag(spark, sf_dir):
    pairs = _classes(spark, sf_dir)
    row = pairs.groupBy(*KEYS).agg(
        F.avg((F.col("base") == F.col("evo")).cast("int")).alias("agreement"), F.avg(drift.js_divergence(F.col("p_base"), F.col("p_evo"))).alias("jsd")
    )
    none = F.lit(None).cast("double")
    flag = drift.silent_flag(F.lit("classification"), F.col("agreement"), F.col("jsd"), none, none, none)
    return row.select(*KEYS, two_digits(F.col("agreement")).alias("agreement"), two_digits(F.col("jsd")).alias("jsd"), flag.alias("silent_failure_candidate"))


@query(
    "dr_record",
    f"""WITH p AS ({REGRESSION}), {KS_SQL}, {SPEARMAN_SQL},
b AS (SELECT {K}, count(*) AS n, stddev_pop(base) AS sd, avg(base) AS mean, sqrt(avg((evo - base) * (evo - base))) AS rmse FROM p GROUP BY {K})
SELECT {K}, n, round(sd, 4) AS base_pred_std, round(mean, 4) AS base_pred_mean, round(rmse, 4) AS rmse, round(ks, 8) AS ks,
       round(spearman, 6) AS spearman, 'regression' AS task_type,
       ({_TWO("ks")}) > 0.15 OR (sd > 0 AND ({_TWO("rmse")}) / sd > 0.2) AS silent_failure_candidate
FROM b JOIN ks USING ({K}) JOIN sp USING ({K})""",
)
def dr_record(spark, sf_dir):
    out = drift.regression_record(bound(spark, sf_dir, REGRESSION), KEYS)
    places = {"base_pred_std": 4, "base_pred_mean": 4, "rmse": 4, "ks": 8, "spearman": 6}
    return out.withColumns({c: F.round(c, d) for c, d in places.items()})


@query(
    "dr_record_class",
    f"""WITH {JSD_ROWS},
h AS (SELECT {K}, avg(-(CASE WHEN b1 > 0 THEN b1 * ln(b1) ELSE 0 END + CASE WHEN b2 > 0 THEN b2 * ln(b2) ELSE 0 END + CASE WHEN b3 > 0 THEN b3 * ln(b3) ELSE 0 END)) AS entropy,
      avg(greatest(b1, b2, b3)) AS most FROM p GROUP BY {K}),
c AS (SELECT {K}, count(*) AS n, avg(CASE WHEN base = evo THEN 1 ELSE 0 END) AS agreement, avg(jsd) AS jsd FROM j GROUP BY {K})
SELECT {K}, n, round(entropy, 6) AS base_pred_entropy_mean, round(most, 6) AS base_pred_maxprob_mean, round(agreement, 6) AS agreement, round(jsd, 8) AS jsd,
       'classification' AS task_type, ({_TWO("jsd")}) > 0.05 OR ({_TWO("agreement")}) < 0.95 AS silent_failure_candidate FROM c JOIN h USING ({K})""",
)
def dr_record_class(spark, sf_dir):
    out = drift.classification_record(_classes(spark, sf_dir), KEYS)
    places = {"base_pred_entropy_mean": 6, "base_pred_maxprob_mean": 6, "agreement": 6, "jsd": 8}
    return out.withColumns({c: F.round(c, d) for c, d in places.items()})
