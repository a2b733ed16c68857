"""From run logs to crash, failure, drift and silent-failure tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabdrift.functions.numbers import number, two_digits
from tabdrift.functions.ordering import joined, percentiles

GROUP = ["variant", "align_mode"]

#: Fields of a run record that are numbers.
NUMERIC = [
    "n_evo_test", "n_base_test", "n_train", "rmse", "ks", "spearman", "agreement", "jsd",
    "base_pred_mean", "base_pred_std", "base_pred_entropy_mean", "base_pred_maxprob_mean",
]

#: Crash taxonomy, tried in order. Each rule has alternatives; of an
#: alternative all phrases must occur in the lower-cased text. The memory rules share
#: a condition and refine it.
MEMORY = ["memoryerror", "std::bad_alloc", "cannot allocate memory"]
TAXONOMY = [
    ("IO", "MISSING_FILE", [["filenotfounderror"], ["missing files"], ["no such file"]]),
    ("Resource", "OHE_DENSE_OOM", [[m, w] for m in MEMORY for w in ("onehot", "sparse_output=false", "dense")]),
    ("Resource", "JOIN_OOM", [[m, w] for m in MEMORY for w in ("merge", "join")]),
    ("Resource", "OOM", [[m] for m in MEMORY]),
    ("Join", "NO_COMMON_COLUMNS", [["no common columns"]]),
    ("Join", "MANY_TO_MANY_RISK", [["many-to-many"]]),
    ("Join", "JOIN_EXPLOSION", [["join expansion"], ["cartesian"]]),
    ("Target", "NO_TARGET", [["no suitable target"], ["no suitable", "target"]]),
    ("Target", "Y_TOO_FEW_ROWS", [["too few usable training rows"], ["after cleaning y"]]),
    ("Target", "LABEL_COLUMN_MISSING", [["keyerror", "y_col"], ["keyerror", "label"], ["keyerror", "target"]]),
    ("Schema", "STRICT_SCHEMA_FAIL", [["strict_schema_fail"]]),
    ("Schema", "TYPE_CONVERSION_ERROR", [["could not convert"], ["cannot convert"]]),
    ("Schema", "OHE_CATEGORY_ISSUE", [["unknown categories"], ["handle_unknown"]]),
    ("Schema", "DATETIME_PARSE_ISSUE", [["to_datetime"], ["datetime"]]),
    ("Model", "CONVERGENCE", [["convergencewarning"], ["failed to converge"], ["lbfgs"], ["saga"]]),
    ("Model", "FIT_ERROR", [["model fit failed"], ["fit failed"]]),
    ("Model", "PREDICT_ERROR", [["predict failed"]]),
]

#: Bucket by a part of the fail type, for the optional fallback.
FALLBACK = [("TARGET", "Target"), ("JOIN", "Join"), ("PREPROCESS", "Schema"), ("MODEL_FIT", "Model"), ("PREDICT", "Model"), ("RESOURCE", "Resource"), ("IO", "IO")]

#: Fail type by a part of the message of a run-time error.
FAIL_TYPES = [
    ("TARGET_ERROR", "TARGET_ERROR"), ("MODEL_FIT_ERROR", "MODEL_FIT_ERROR"), ("PREDICT_ERROR", "PREDICT_ERROR"), ("STRICT_SCHEMA_FAIL", "PREPROCESS_ERROR"),
]


def fail_type(kind: Column, message: Column) -> Column:
    """Fail type of an exception: ``kind`` is its class name, ``message`` its text."""
    text, out = F.coalesce(message, F.lit("")), F.lit("UNKNOWN_ERROR")
    low = F.lower(text)
    out = F.when(low.contains("many-to-many") | low.contains("many_to_many") | low.contains("join"), "JOIN_ERROR").otherwise(out)
    for part, name in reversed(FAIL_TYPES):
        out = F.when(text.contains(part), name).otherwise(out)
    return F.when(kind == "FileNotFoundError", "IO_ERROR").when(kind == "MemoryError", "RESOURCE_ERROR").when(kind == "RuntimeError", out).otherwise("UNKNOWN_ERROR")


def crash_taxonomy(fail: Column, error: Column, traceback: Column, use_fail_type_fallback: bool = False) -> Column:
    """Struct fail_bucket, fail_reason of a crash, by the first taxonomy rule its text meets.

    What no rule meets is Unknown/UNKNOWN; with ``use_fail_type_fallback`` the fail type
    then names the bucket.
    """
    cell = lambda b, r: F.struct(F.lit(b).alias("fail_bucket"), (F.lit(r) if isinstance(r, str) else r).alias("fail_reason"))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    text = F.lower(F.concat_ws(" ", F.upper(blank(fail)), blank(error), blank(traceback)))
    out = cell("Unknown", "UNKNOWN")
    if use_fail_type_fallback:
        for part, bucket in reversed(FALLBACK):
            out = F.when(F.upper(blank(fail)).contains(part), cell(bucket, F.upper(blank(fail)))).otherwise(out)
    for bucket, reason, ways in reversed(TAXONOMY):
        hit = F.lit(False)
        for phrases in ways:
            all_of = F.lit(True)
            for p in phrases:
                all_of = all_of & text.contains(p)
            hit = hit | all_of
        out = F.when(hit, cell(bucket, reason)).otherwise(out)
    return out


def normalize(log: DataFrame, nested: Sequence[str] = (), use_fail_type_fallback: bool = False) -> DataFrame:
    """A run log with all columns the tables need.

    Missing columns become null; status is lower case, 'ok' is success and null is
    'none'; number fields that do not read as numbers become null; nrmse is RMSE over
    the baseline's deviation to two digits, null at 0; ``nested`` columns become JSON
    text; crashes get bucket and reason.
    """
    for c in ("task_id", "variant", "align_mode", "status", "fail_type", "error", "traceback_tail", "rmse", "ks", "spearman", "agreement", "jsd", "base_pred_std"):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("string"))
    if "silent_failure_candidate" not in log.columns:
        log = log.withColumn("silent_failure_candidate", F.lit(None).cast("boolean"))
    status = F.lower(F.coalesce("status", F.lit("none")))
    log = log.withColumn("status", F.when(status == "ok", "success").otherwise(status))
    log = log.withColumns({c: number(F.col(c)) for c in NUMERIC if c in log.columns})
    log = log.withColumn("nrmse", two_digits(F.try_divide("rmse", "base_pred_std")))
    log = log.withColumns({c: F.to_json(c) for c in nested if c in log.columns}) if nested else log
    found = F.when(F.col("status") == "crash", crash_taxonomy(F.col("fail_type"), F.col("error"), F.col("traceback_tail"), use_fail_type_fallback))
    return log.withColumn("_t", found).withColumn("fail_bucket", F.col("_t.fail_bucket")).withColumn("fail_reason", F.col("_t.fail_reason")).drop("_t")


def baseline_valid(log: DataFrame) -> DataFrame:
    """Records of the tasks whose baseline succeeded in the same align mode."""
    good = log.filter((F.lower("variant") == "baseline") & (F.col("status") == "success")).select("task_id", "align_mode").distinct()
    return log.join(good, ["task_id", "align_mode"], "left_semi").select(log.columns)


def only_variants(log: DataFrame, variants: Sequence[str]) -> DataFrame:
    return log.filter(F.col("variant").isin(list(variants)))


def crash_rate(log: DataFrame) -> DataFrame:
    """Counts by status and crash and success rates of the records, per variant and mode."""
    out = log.groupBy(*GROUP).agg(
        F.count("*").alias("n_tasks"),
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "crash").alias("n_crash"),
        F.count_if(F.col("status") == "missing_evolved_task").alias("n_missing_evolved"),
    )
    out = out.withColumn("crash_rate", two_digits(F.col("n_crash") / F.col("n_tasks"))).withColumn("success_rate", two_digits(F.col("n_success") / F.col("n_tasks")))
    return out.orderBy(F.desc("crash_rate"), F.desc("n_tasks"), *GROUP)


def crash_delta(log: DataFrame) -> DataFrame:
    """Crash counts with the baseline's counts of the same mode repeated, and the differences."""
    rates = crash_rate(log)
    names = ["n_tasks", "n_success", "n_crash", "n_missing_evolved", "crash_rate", "success_rate"]
    base = rates.filter("variant = 'baseline'").select(F.col("align_mode").alias("_m"), *(F.col(c).alias(f"baseline_{c}") for c in names))
    out = rates.join(base, rates["align_mode"].eqNullSafe(base["_m"]), "left").drop("_m")
    deltas = {"delta_crash_count": F.col("n_crash") - F.col("baseline_n_crash"), "delta_success_count": F.col("n_success") - F.col("baseline_n_success")}
    out = out.withColumns(deltas | {"delta_crash_rate": two_digits(F.col("crash_rate") - F.col("baseline_crash_rate"))})
    return out.orderBy("align_mode", F.desc("delta_crash_count"), F.desc("n_tasks"), "variant")


def failures(log: DataFrame) -> DataFrame:
    """Crashes by bucket and reason and their share of the crashes of the variant and mode."""
    counts = log.filter("status = 'crash'").groupBy(*GROUP, "fail_bucket", "fail_reason").agg(F.count("*").alias("count"))
    out = counts.withColumn("variant_crashes", F.sum("count").over(Window.partitionBy(*GROUP)))
    return out.withColumn("share_within_variant", two_digits(F.col("count") / F.col("variant_crashes"))).orderBy("variant", F.desc("count"), "align_mode", "fail_reason")


def crash_buckets(log: DataFrame) -> DataFrame:
    return log.filter("status = 'crash'").groupBy(*GROUP, "fail_bucket").agg(F.count("*").alias("count")).orderBy(*GROUP, F.desc("count"), "fail_bucket")


METRICS = ["nrmse", "ks", "spearman", "agreement", "jsd"]


def drift_summary(log: DataFrame) -> DataFrame:
    """Median, 90th percentile and mean of each metric over successes, to two digits, nulls left out."""
    good = log.filter("status = 'success'")
    means = good.groupBy(*GROUP).agg(*(two_digits(F.avg(m)).alias(f"{m}_mean") for m in METRICS))
    long = good.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in METRICS))).alias("s"))
    ranked = percentiles(long.select(*GROUP, "s.*"), [*GROUP, "metric"], "x", {"median": 0.5, "p90": 0.9})
    wide = ranked.groupBy(*GROUP).agg(
        *(two_digits(F.max(F.when(F.col("metric") == m, F.col(p)))).alias(f"{m}_{p}") for m in METRICS for p in ("median", "p90"))
    )
    out = joined(means, wide, GROUP, "left")
    return out.select(*GROUP, *(f"{m}_{p}" for m in METRICS for p in ("median", "p90", "mean"))).orderBy(*GROUP)


def silent_summary(log: DataFrame) -> DataFrame:
    """Silent failures among successes, with the baseline's of the same mode and the differences."""
    out = log.filter("status = 'success'").groupBy(*GROUP).agg(F.count("*").alias("n_success"), F.count_if("silent_failure_candidate").alias("n_silent"))
    out = out.withColumn("silent_rate", two_digits(F.col("n_silent") / F.col("n_success")))
    base = out.filter("variant = 'baseline'").select(F.col("align_mode").alias("_m"), *(F.col(c).alias(f"baseline_{c}") for c in ("n_success", "n_silent", "silent_rate")))
    out = out.join(base, out["align_mode"].eqNullSafe(base["_m"]), "left").drop("_m")
    out = out.withColumn("delta_silent_count", F.col("n_silent") - F.col("baseline_n_silent")).withColumn(
        "delta_silent_rate", two_digits(F.col("silent_rate") - F.col("baseline_silent_rate"))
    )
    return out.orderBy("align_mode", F.desc("delta_silent_rate"), "variant")


def metric_spread(log: DataFrame, metric: str) -> DataFrame:
    """Quartiles of a metric over successes and the extreme values within 1.5 ranges of them."""
    rows = log.filter(f"status = 'success' AND `{metric}` IS NOT NULL").select(*GROUP, F.col(metric).alias("x"))
    quart = percentiles(rows, GROUP, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    both = joined(rows, quart, GROUP)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.when((F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach), F.col("x"))
    return both.groupBy(*GROUP, "q1", "median", "q3").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))


def retained_tasks(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("task_id").alias("retained_tasks"))
