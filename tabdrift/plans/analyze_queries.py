"""Result tables over a run log bound to events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabdrift.functions.numbers import two_digits_sql as two
from tabdrift.operators import analyze
from tabdrift.plans.bindings import ERRORS, bound, run_log
from tabdrift.plans.registry import query

G = "variant, align_mode"


def _log(spark, sf_dir):
    return analyze.normalize(bound(spark, sf_dir, run_log("spark")))


def _valid(spark, sf_dir):
    return analyze.baseline_valid(_log(spark, sf_dir))


def _rules_sql() -> str:
    out = []
    for bucket, reason, ways in analyze.TAXONOMY:
        hit = " OR ".join("(" + " AND ".join(f"contains(txt, '{p}')" for p in w) + ")" for w in ways)
        out.append(f"WHEN {hit} THEN '{bucket}/{reason}'")
    return f"CASE {' '.join(out)} ELSE 'Unknown/UNKNOWN' END"


NUMBER = r"regexp_matches(CAST({c} AS VARCHAR), '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$')"
LOG = f"""
raw AS ({run_log("duckdb")}),
txt AS (
  SELECT *, CASE WHEN lower(coalesce(status, 'none')) = 'ok' THEN 'success' ELSE lower(coalesce(status, 'none')) END AS st,
         CASE WHEN {NUMBER.format(c="rmse")} THEN CAST(rmse AS DOUBLE) END AS rmse_n,
         lower(upper(coalesce(fail_type, '')) || ' ' || coalesce(error, '') || ' ' || coalesce(traceback_tail, '')) AS txt
  FROM raw),
log AS (
  SELECT task_id, variant, align_mode, st AS status, fail_type, error, rmse_n AS rmse, base_pred_std, ks, spearman, agreement, jsd,
         silent_failure_candidate,
         CASE WHEN base_pred_std <> 0 THEN {two("rmse_n / base_pred_std")} END AS nrmse,
         CASE WHEN st = 'crash' THEN split_part({_rules_sql()}, '/', 1) END AS fail_bucket,
         CASE WHEN st = 'crash' THEN split_part({_rules_sql()}, '/', 2) END AS fail_reason
  FROM txt),
valid AS (SELECT * FROM log l WHERE EXISTS (SELECT 1 FROM log b WHERE b.variant = 'baseline' AND b.status = 'success'
                                             AND b.task_id = l.task_id AND b.align_mode = l.align_mode))"""

#: Exception classes that an event stands for.
KIND = "CASE event_id % 5 WHEN 0 THEN 'FileNotFoundError' WHEN 1 THEN 'MemoryError' WHEN 2 THEN 'ValueError' ELSE 'RuntimeError' END"
MESSAGES = f"""SELECT event_id, {KIND} AS kind, CASE event_id % {len(ERRORS)} {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ERRORS))} END AS message
FROM events"""


@query(
    "an_fail_type",
    f"""WITH m AS ({MESSAGES}) SELECT event_id,
CASE WHEN kind = 'FileNotFoundError' THEN 'IO_ERROR' WHEN kind = 'MemoryError' THEN 'RESOURCE_ERROR' WHEN kind <> 'RuntimeError' THEN 'UNKNOWN_ERROR'
     WHEN contains(message, 'TARGET_ERROR') THEN 'TARGET_ERROR' WHEN contains(message, 'MODEL_FIT_ERROR') THEN 'MODEL_FIT_ERROR'
     WHEN contains(message, 'PREDICT_ERROR') THEN 'PREDICT_ERROR' WHEN contains(message, 'STRICT_SCHEMA_FAIL') THEN 'PREPROCESS_ERROR'
     WHEN regexp_matches(lower(message), 'many-to-many|many_to_many|join') THEN 'JOIN_ERROR' ELSE 'UNKNOWN_ERROR' END AS fail_type FROM m""",
)
def an_fail_type(spark, sf_dir):
    return bound(spark, sf_dir, MESSAGES).select("event_id", analyze.fail_type(F.col("kind"), F.col("message")).alias("fail_type"))


@query("an_normalize", f"WITH {LOG} SELECT task_id, variant, align_mode, status, round(rmse, 6) AS rmse, nrmse, fail_bucket, fail_reason FROM log")
def an_normalize(spark, sf_dir):
    return _log(spark, sf_dir).select("task_id", "variant", "align_mode", "status", F.round("rmse", 6).alias("rmse"), "nrmse", "fail_bucket", "fail_reason")


@query("an_crash_taxonomy", f"WITH {LOG} SELECT task_id, variant, align_mode, error, fail_bucket, fail_reason FROM log WHERE status = 'crash'")
def an_crash_taxonomy(spark, sf_dir):
    return _log(spark, sf_dir).filter("status = 'crash'").select("task_id", "variant", "align_mode", "error", "fail_bucket", "fail_reason")


@query("an_baseline_valid", f"WITH {LOG} SELECT task_id, variant, align_mode, status FROM valid")
def an_baseline_valid(spark, sf_dir):
    return _valid(spark, sf_dir).select("task_id", "variant", "align_mode", "status")


@query("an_variant_filter", f"WITH {LOG} SELECT task_id, variant, align_mode, status FROM valid WHERE variant IN ('drop', 'rename')")
def an_variant_filter(spark, sf_dir):
    return analyze.only_variants(_valid(spark, sf_dir), ["drop", "rename"]).select("task_id", "variant", "align_mode", "status")


RATE = f"""
rate AS (
  SELECT {G}, count(*) AS n_tasks, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'crash') AS n_crash,
         count(*) FILTER (status = 'missing_evolved_task') AS n_missing_evolved FROM valid GROUP BY {G}),
rates AS (SELECT *, {two("CAST(n_crash AS DOUBLE) / n_tasks")} AS crash_rate, {two("CAST(n_success AS DOUBLE) / n_tasks")} AS success_rate FROM rate)"""


@query("an_crash_rate", f"WITH {LOG}, {RATE} SELECT * FROM rates")
def an_crash_rate(spark, sf_dir):
    return analyze.crash_rate(_valid(spark, sf_dir))


@query(
    "an_crash_delta",
    f"""WITH {LOG}, {RATE} SELECT r.*, b.n_tasks AS baseline_n_tasks, b.n_success AS baseline_n_success, b.n_crash AS baseline_n_crash,
b.n_missing_evolved AS baseline_n_missing_evolved, b.crash_rate AS baseline_crash_rate, b.success_rate AS baseline_success_rate, r.n_crash - b.n_crash AS delta_crash_count,
r.n_success - b.n_success AS delta_success_count, {two("r.crash_rate - b.crash_rate")} AS delta_crash_rate
FROM rates r LEFT JOIN rates b ON b.variant = 'baseline' AND b.align_mode = r.align_mode""",
)
def an_crash_delta(spark, sf_dir):
    return analyze.crash_delta(_valid(spark, sf_dir))


@query(
    "an_failures",
    f"""WITH {LOG}, f AS (SELECT {G}, fail_bucket, fail_reason, count(*) AS count FROM valid WHERE status = 'crash' GROUP BY ALL),
s AS (SELECT *, CAST(sum(count) OVER (PARTITION BY {G}) AS BIGINT) AS variant_crashes FROM f)
SELECT *, {two("CAST(count AS DOUBLE) / variant_crashes")} AS share_within_variant FROM s""",
)
def an_failures(spark, sf_dir):
    return analyze.failures(_valid(spark, sf_dir))


@query("an_crash_buckets", f"WITH {LOG} SELECT {G}, fail_bucket, count(*) AS count FROM valid WHERE status = 'crash' GROUP BY ALL")
def an_crash_buckets(spark, sf_dir):
    return analyze.crash_buckets(_valid(spark, sf_dir))


_STATS = ", ".join(
    f"{two(f'quantile_cont({m}, 0.5)')} AS {m}_median, {two(f'quantile_cont({m}, 0.9)')} AS {m}_p90, {two(f'avg({m})')} AS {m}_mean" for m in analyze.METRICS
)


@query("an_drift_summary", f"WITH {LOG} SELECT {G}, {_STATS} FROM valid WHERE status = 'success' GROUP BY {G}")
def an_drift_summary(spark, sf_dir):
    return analyze.drift_summary(_valid(spark, sf_dir))


@query(
    "an_silent_summary",
    f"""WITH {LOG},
s AS (SELECT {G}, count(*) AS n_success, count(*) FILTER (silent_failure_candidate) AS n_silent FROM valid WHERE status = 'success' GROUP BY {G}),
r AS (SELECT *, {two("CAST(n_silent AS DOUBLE) / n_success")} AS silent_rate FROM s)
SELECT r.*, b.n_success AS baseline_n_success, b.n_silent AS baseline_n_silent, b.silent_rate AS baseline_silent_rate,
       r.n_silent - b.n_silent AS delta_silent_count, {two("r.silent_rate - b.silent_rate")} AS delta_silent_rate
FROM r LEFT JOIN r b ON b.variant = 'baseline' AND b.align_mode = r.align_mode""",
)
def an_silent_summary(spark, sf_dir):
    return analyze.silent_summary(_valid(spark, sf_dir))


@query(
    "an_metric_spread",
    f"""WITH {LOG}, x AS (SELECT {G}, nrmse AS x FROM valid WHERE status = 'success' AND nrmse IS NOT NULL),
q AS (SELECT {G}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY {G})
SELECT {G}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(x) FILTER (x >= q1 - (q3 - q1) * 1.5 AND x <= q3 + (q3 - q1) * 1.5) AS whisker_low,
       max(x) FILTER (x >= q1 - (q3 - q1) * 1.5 AND x <= q3 + (q3 - q1) * 1.5) AS whisker_high
FROM x JOIN q USING ({G}) GROUP BY {G}, q1, median, q3""",
)
def an_metric_spread(spark, sf_dir):
    return analyze.metric_spread(_valid(spark, sf_dir), "nrmse").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query("an_retained_tasks", f"WITH {LOG} SELECT count(DISTINCT task_id) AS retained_tasks FROM valid")
def an_retained_tasks(spark, sf_dir):
    return analyze.retained_tasks(_valid(spark, sf_dir))
