from pyspark.sql import functions as F

from tabdrift.operators import analyze


def _log(spark, rows):
    return spark.createDataFrame(rows, "task_id string, variant string, align_mode string, status string, fail_type string, error string, traceback_tail string, rmse string, base_pred_std double")


def test_normalize_and_taxonomy(spark):
    rows = [
        ("a", "add", "strict", "OK", None, None, None, "1.0", 2.0),
        ("b", "add", "strict", None, None, None, None, "x", 0.0),
        ("c", "add", "strict", "Crash", "JOIN_ERROR", "odd", None, None, None),
        ("d", "add", "strict", "crash", None, "no suitable column for target", "tb", None, None),
        ("e", "add", "strict", "crash", None, "MemoryError", "in merge", None, None),
    ]
    got = {r["task_id"]: r for r in analyze.normalize(_log(spark, rows)).collect()}
    assert got["a"]["status"] == "success" and got["a"]["nrmse"] == 0.5
    assert got["b"]["status"] == "none" and got["b"]["nrmse"] is None and got["b"]["rmse"] is None
    assert (got["c"]["fail_bucket"], got["c"]["fail_reason"]) == ("Unknown", "UNKNOWN")
    assert got["d"]["fail_reason"] == "NO_TARGET" and got["e"]["fail_reason"] == "JOIN_OOM"
    back = analyze.normalize(_log(spark, rows), use_fail_type_fallback=True).filter("task_id = 'c'").first()
    assert (back["fail_bucket"], back["fail_reason"]) == ("Join", "JOIN_ERROR")


def test_missing_columns_and_empty_log(spark):
    log = analyze.normalize(spark.createDataFrame([], "task_id string, variant string, align_mode string"))
    assert analyze.crash_rate(log).count() == 0 and analyze.retained_tasks(log).first()[0] == 0


def test_published_arithmetic(spark):
    shares = spark.createDataFrame([(512, 552, 0.93), (383, 387, 0.99), (147, 381, 0.39)], "a int, b int, want double")
    from tabdrift.functions.numbers import two_digits

    assert shares.filter(two_digits(F.col("a") / F.col("b")) != F.col("want")).count() == 0


def test_baseline_must_succeed_in_the_same_mode(spark):
    rows = [("a", "baseline", "strict", "ok"), ("a", "add", "strict", "crash"), ("a", "add", "stability", "ok"), ("b", "add", "strict", "ok")]
    log = analyze.normalize(spark.createDataFrame(rows, "task_id string, variant string, align_mode string, status string"))
    assert {(r.variant, r.align_mode) for r in analyze.baseline_valid(log).collect()} == {("baseline", "strict"), ("add", "strict")}
