import math

import numpy as np
import pytest
from conftest import DATA
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabdrift.functions.ordering import running_sums
from tabdrift.operators import drift


def _pairs(spark, rows):
    return spark.createDataFrame([(k, a, b) for k, a, b in rows], "g string, base double, evo double")


def test_identical_sides_do_not_drift(spark):
    pairs = _pairs(spark, [("x", float(i % 7), float(i % 7)) for i in range(50)])
    r = drift.regression_record(pairs, ["g"]).first()
    assert r["rmse"] == 0 and r["ks"] == 0 and r["spearman"] == pytest.approx(1.0) and not r["silent_failure_candidate"]


def test_constant_and_null_sides(spark):
    pairs = _pairs(spark, [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("n", None, 1.0)])
    assert {r["g"]: r["spearman"] for r in drift.spearman(pairs, ["g"]).collect()}.get("c") is None
    assert {r["g"]: r["ks"] for r in drift.ks_statistic(pairs, ["g"]).collect()}["n"] is None


def test_jsd_with_zeros_and_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([1.0], [0.5, 0.5]), ([0.0], [1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(drift.js_divergence(F.col("p"), F.col("q"))).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == 0 and got[2] is None and got[3] is None


def test_flag_uses_rounded_metrics(spark):
    none = F.lit(None).cast("double")
    flag = lambda ks: drift.silent_flag(F.lit("regression"), none, none, F.lit(ks), F.lit(0.0), F.lit(1.0))
    low, high = spark.range(1).select(flag(0.1549), flag(0.156)).first()
    assert (low, high) == (False, True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5), st.integers(-5, 5)), min_size=4, max_size=40))
def test_ks_and_spearman_against_numpy(spark, rows):
    pairs = _pairs(spark, [(g, float(a), float(b)) for g, a, b in rows])
    ks = {r["g"]: r["ks"] for r in drift.ks_statistic(pairs, ["g"]).collect()}
    rho = {r["g"]: r["spearman"] for r in drift.spearman(pairs, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        a, b = (np.array([r[i] for r in rows if r[0] == g], float) for i in (1, 2))
        grid = np.unique(np.concatenate([a, b]))
        want = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
        assert ks[g] == pytest.approx(want)
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        if len(set(a)) > 1 and len(set(b)) > 1:
            assert rho[g] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
        else:
            assert rho.get(g) is None


def test_running_sums_over_one_group_and_null_keys(spark):
    df = spark.createDataFrame([(None, float(v), 1) for v in (3, 1, 2, 1000)] + [("k", 5.0, 2)], "k string, v double, n int")
    got = {(r["k"], r["v"]): r["n"] for r in running_sums(df, ["k"], "v", ["n"]).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, (None, 3.0): 3, (None, 1000.0): 4, ("k", 5.0): 2}


def test_one_outlier_leaves_ranges_even(spark, monkeypatch):
    from tabdrift.functions import ordering

    monkeypatch.setattr(ordering, "SORTED", 100)
    df = spark.createDataFrame([("g", float(v), 1) for v in [*range(3000), 10**12]], "k string, v double, n int")
    out = ordering.running_sums(df, ["k"], "v", ["n"])
    assert sorted(r["n"] for r in out.collect()) == list(range(1, 3002))
    parts = F.array(*(F.lit(i / ordering.RANGES) for i in range(1, ordering.RANGES)))
    cuts = df.agg(F.percentile_approx("v", parts, 1000).alias("c"))
    sizes = [r["n"] for r in df.crossJoin(cuts).groupBy(ordering._range_of(F.col("v"), F.col("c"))).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == ordering.RANGES and max(sizes) < 3 * 3001 / ordering.RANGES


def test_ranks_of_texts_that_begin_alike(spark):
    from tabdrift.functions import ordering

    words = [f"Customer#{i:09d}" for i in range(2500)]
    got = {r["w"]: r["n"] for r in ordering.text_ranks(spark.createDataFrame([(w,) for w in words[::-1]], "w string"), "w", "n").collect()}
    assert got == {w: i for i, w in enumerate(words)}


def test_percentiles_against_numpy(spark):
    from tabdrift.functions import ordering

    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=301).tolist(), "b": [1.0], "c": [2.0, 2.0, 5.0, None], "d": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r["k"]: (r["m"], r["p"]) for r in ordering.percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}).collect()}
    want = {k: tuple(np.percentile([v for v in vs if v is not None], [50, 90])) for k, vs in data.items() if k != "d"}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_text_ranks_follow_code_points(spark):
    from tabdrift.functions.ordering import text_ranks

    words = ["", "a", "aa", "ab", "b", "é", "Z", "日", "👍", "a"]
    got = {r["w"]: r["n"] for r in text_ranks(spark.createDataFrame([(w,) for w in [*words, None]], "w string"), "w", "n").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words), key=lambda w: w.encode()))}


def test_rank_metrics_move_rows_once_and_store_none(spark, monkeypatch):
    """One group above the limit, in ranges, and a small one with a null key; ties, nulls, zeros of both signs."""
    import os

    import numpy as np

    from tabdrift.functions import ordering

    monkeypatch.setattr(ordering, "SORTED", 100)
    rng = np.random.default_rng(5)
    rows = [("a", float(round(x, 2)), float(round(x + e, 1))) for x, e in rng.normal(size=(3000, 2))] + [(None, float(i % 7), float(i % 5)) for i in range(40)]
    rows += [("a", -0.0, 0.0), ("a", 0.0, -0.0), ("a", None, 9.0), ("a", 9.0, None), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, base double, evo double")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    ks = {r["k"]: r["ks"] for r in drift.ks_statistic(df, ["k"]).collect()}
    rho = {r["k"]: r["spearman"] for r in drift.spearman(df, ["k"]).collect()}
    ranked = lambda v: np.array([((v < x).sum() + (v <= x).sum() + 1) / 2 for x in v])
    for key in ("a", None):
        x, y = (np.array([r[i] for r in rows if r[0] == key and r[i] is not None]) for i in (1, 2))
        assert abs(ks[key] - max(abs((x <= v).mean() - (y <= v).mean()) for v in np.concatenate([x, y]))) < 1e-12
        x, y = np.array([r[1:] for r in rows if r[0] == key and None not in r[1:]]).T
        assert abs(rho[key] - np.corrcoef(ranked(x), ranked(y))[0, 1]) < 1e-12
    assert ks["b"] is None and "b" not in rho
    made = set(os.listdir(shared)) - before
    assert sum(spark.read.parquet(f"{shared}/{m}").count() for m in made) <= 6 * ordering.RANGES


def test_counted_pairs_give_the_record_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], float(rng.integers(0, 6)), None if i % 17 == 0 else float(rng.integers(0, 6)), int(rng.integers(1, 5))) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, base double, evo double, n long")
    got = {r["g"]: r.asDict() for r in drift.regression_record(df, ["g"], "n").collect()}
    want = {r["g"]: r.asDict() for r in drift.regression_record(df.selectExpr("g", "base", "evo", "explode(sequence(1, n)) AS i"), ["g"]).collect()}
    assert got.keys() == want.keys()
    for g, record in want.items():
        assert {k: v if isinstance(v, str | bool | int) else pytest.approx(v, abs=1e-9) for k, v in record.items()} == got[g]


def test_the_experiment_is_the_same_with_rows_counted_or_not(spark, monkeypatch):
    from tabdrift.plans import model_queries

    found = []
    for least in (1, 10**9):
        monkeypatch.setattr(model_queries, "REPEATED", least)
        found.append({r["variant"]: (r["n"], *(round(r[c], 6) for c in ("base_pred_mean", "base_pred_std", "rmse", "ks", "spearman")), r["silent_failure_candidate"]) for r in model_queries.schema_change_impact(spark, f"{DATA}/sf0.001").collect()})
    assert found[0] == found[1] and set(found[0]) == {"baseline", "meaning", "drop"}
