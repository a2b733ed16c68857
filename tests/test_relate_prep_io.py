import numpy as np
import pytest
from pyspark.sql import functions as F

from tabdrift.functions.numbers import number, two_digits
from tabdrift.operators import model, prep, profile, relate
from tabdrift.sources import tables


def test_null_keys_match_and_form_a_group(spark):
    base = spark.createDataFrame([(None, 1), (1, 2), (3, 3)], "k int, a int")
    child = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, None)], "k int, x double")
    got = {r["k"]: r for r in relate.join_child(base, child, "k").collect()}
    assert got[None]["__agg__k__row_count"] == 2 and got[None]["__agg__x__mean"] == 2.0
    assert got[1]["__agg__x__mean"] is None and got[3]["__agg__k__row_count"] is None


def test_relationship_rounds_first(spark):
    f = lambda a, b: relate.relationship(F.lit(a), F.lit(b), F.lit(False))
    assert spark.range(1).select(f(0.0, 0.5), f(0.0, 0.0), f(0.5, 0.0), f(0.5, 0.5)).first() == ("one_to_many", "one_to_one", "many_to_one", "many_to_many")
    rate = relate.duplicate_rate(F.lit(1000), F.lit(996), F.lit(0))
    assert spark.range(1).select(rate).first()[0] == 0.0


def test_label_is_neither_key_nor_feature(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "id int, Outcome int")
    b = spark.createDataFrame([(1, 5, 1.0), (2, 6, 2.0)], "id int, Outcome int, v double")
    out = relate.relational_features(a, {"b": b}, "Outcome", {"b": ("id", "one_to_one")})
    assert out.columns == ["id", "y", "v"]


def test_empty_tables_relate(spark):
    empty = spark.createDataFrame([], "k int, x double")
    assert relate.aggregate_child(empty, "k").count() == 0 and relate.join_child(empty.select("k"), empty, "k").count() == 0
    stats = relate.column_stats({"a": empty, "b": empty})
    assert stats.count() == 0


@pytest.mark.parametrize(
    ("values", "kind"),
    [(["0", "1", None], "boolean_class"), ([None, None], "boolean_class"), (["true", "False"], "boolean_class"), ([str(i % 3) for i in range(60)], "integer_class"),
     ([f"{i}.5" for i in range(30)], "regression"), (["a", "b", "1"], "text_class"), ([str(100000.3 + i % 2) for i in range(60)], "integer_class")],
)
def test_label_kinds(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], "y string")
    assert prep.label_kind(df, "y").first()["kind"] == kind


def test_numbers_are_whole_texts(spark):
    df = spark.createDataFrame([("1d",), ("0x1p3",), (" 2 ",), ("1e3",), ("NaN",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(number(F.col("s"))).collect()] == [None, None, 2.0, 1000.0, None, None, None]
    assert spark.range(1).select(two_digits(F.lit(0.125))).first()[0] == 0.13


def test_alignment(spark):
    df = spark.createDataFrame([(1, "x")], "b int, extra string")
    out = prep.align(df, [("a", "double"), ("b", "int")])
    assert out.dtypes == [("a", "double"), ("b", "int")] and tuple(out.first()) == (None, 1)


def test_unseen_categories_have_no_slot(spark):
    train, test = (spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "id int, c string") for vs in (["b", "a"], ["a", "z", None]))
    assert [tuple(r) for r in prep.one_hot(train, test, "c", "id").collect()] == [(0, 0)]


def test_ridge_against_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=80)
    df = spark.createDataFrame([("t", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "task_id string, a double, b double, y double")
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    got = model.ridge(df, ["a", "b"], "y")
    assert np.allclose([got["a"], got["b"]], want)
    holes = spark.createDataFrame([("t", None, 1.0, 9.0), ("t", 1.0, 1.0, None), ("t", float("nan"), 0.0, 0.0)], df.schema)
    assert model.ridge(df.unionByName(holes), ["a", "b"], "y") == pytest.approx(got)


def test_csv_hygiene_and_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',a,b\n0,1,"x, y"\n1,2,\n')
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["a", "b"] and [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x, y"), (2, None)]
    tables.write_variant({0: df}, str(tmp_path / "out"), "add", "t1")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter("variant = 'add' AND task_id = 't1' AND role = 'training'").count() == 2


def test_run_log_append_and_resume(spark, tmp_path):
    log = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, n int")
    tables.write_run_log(log, str(tmp_path / "log"))
    tables.write_run_log(log.filter("n = 1"), str(tmp_path / "log"), resume=True)
    (tmp_path / "log" / "part-x.json").write_text('\n{"task_id": "c", "n"\n')
    back = tables.read_run_logs(spark, [str(tmp_path / "log")] * 2, "task_id string, n int")
    assert sorted(r["task_id"] for r in back.collect()) == ["a", "a", "b"]
    assert tables.pending(spark.createDataFrame([("a",), ("z",)], "task_id string"), back).first()[0] == "z"


def test_task_files(spark):
    paths = ["/d/t1/training_0.csv", "/d/t1/test_12.csv", "/d/t1/target.csv", "/d/t1/notes.csv"]
    got = tables.task_files(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("role").collect()
    assert [(r["task_id"], r["role"], r["table_idx"]) for r in got] == [("t1", "target", None), ("t1", "test", 12), ("t1", "training", 0)]


def test_inferred_targets(spark):
    named = spark.createDataFrame([(1, 2.0)], "a int, Label double")
    nothing = spark.createDataFrame([("x",), ("y",)], "name string")
    parts = spark.createDataFrame([(v,) for v in "aabbc"], "rating string")
    got = {r["table"]: (r["target"], r["stage"]) for r in profile.infer_targets({"n": named, "o": nothing, "p": parts}).collect()}
    assert got == {"n": ("Label", "names"), "o": (None, "none"), "p": ("rating", "parts")}


def test_domain_ties_and_none(spark):
    df = spark.createDataFrame([(["wind", "price"],), (["zzz"],)], "c array<string>")
    assert [tuple(r[0]) for r in df.select(profile.domain(F.col("c"))).collect()] == [("weather", 1), ("unknown", 0)]


def test_cells_of_long_lines(spark):
    many, long = ",".join(f'"a,{i}"' for i in range(10_000)), '"' + "x,y" * 400_000 + '",b'
    df = spark.createDataFrame([(many,), (long,), ('1,"say ""hi"", you",',), ("",), ('"',)], "value string")
    got = [r[0] for r in df.select(tables.csv_cells(F.col("value"))).collect()]
    assert len(got[0]) == 10_000 and got[0][-1] == "a,9999" and [len(c) for c in got[1]] == [1_200_000, 1]
    assert got[2:] == [["1", 'say "hi", you', ""], [""], [""]]


def test_cells_equal_a_csv_reader(spark):
    import csv
    import random

    rng = random.Random(5)
    lines = ["".join(rng.choice(['"', '"', ",", ",", "a", " ", "bc", "\t", "é"]) for _ in range(rng.randint(1, 24))) for _ in range(10_000)]
    lines += ['a,5" pipe,b', '1,he said "x, y" ok,z', '"a"b"c,d', '"x""y"z,', '"never, closed', "x" * 1_000_000 + ',"' + '""' * 200_000 + '",y', ",".join(['"', "z"] * 3)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string").repartition(4)
    got = {r["i"]: r["c"] for r in df.select("i", tables.csv_cells(F.col("value")).alias("c")).collect()}
    csv.field_size_limit(10_000_000)
    assert [i for i, line in enumerate(lines) if got[i] != next(csv.reader([line]))] == []


def test_names_with_dots(spark):
    from tabdrift.operators import evolve

    df = spark.createDataFrame([(1, "2", "u", 4.0), (1, "x", "v", 6.0), (2, "3", "u", 8.0)], "`k.id` int, `n.m` string, `c.d` string, `x.y` double")
    assert [r[0] for r in evolve.to_numeric(df, "n.m").select("`n.m`").collect()] == [2.0, None, 3.0]
    assert [r[0] for r in evolve.unit_scale(df, "x.y", 2).select("`x.y`").collect()] == [2.0, 3.0, 4.0]
    assert sorted(r[0] for r in evolve.collapse_categories(df, "c.d", 1, "k.id").select("`c.d`").collect()) == ["Other", "u", "u"]
    agg = {r["k.id"]: r for r in relate.aggregate_child(df, "k.id").collect()}
    assert agg[1]["__agg__x.y__mean"] == 5.0 and agg[1]["__agg__n.m__nunique"] == 2 and agg[2]["__agg__k.id__row_count"] == 1
    base = spark.createDataFrame([(1,), (3,)], "`k.id` int")
    assert relate.join_child(base, df, "k.id").count() == 2 and relate.join_parent(base, df, "k.id").count() == 3
    assert relate.join_expansion(base, df, "k.id").first()[0] == 1.5
    assert sorted(r["__row_id"] for r in evolve.add_columns(df, 7, "k.id").collect()) == [0, 1, 2]
    assert len(evolve.op_infos(df, "meaning", {"meaning_num_col": "x.y", "meaning_cat_col": "c.d", "unit_scale_divisor": 10.0, "category_keep_topk": 1}, "k.id").collect()) == 2
    w = model.ridge(df, ["x.y"], "k.id")
    assert df.select(model.linear_score(w)).count() == 3


def test_a_column_without_values_is_not_collapsed(spark):
    from tabdrift.operators import evolve

    df = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    assert [r["c"] for r in evolve.collapse_categories(df, "c", 2, "id").collect()] == [None, None]
    plan = {"meaning_num_col": None, "meaning_cat_col": "c", "unit_scale_divisor": 10.0, "category_keep_topk": 2}
    assert evolve.op_infos(df, "meaning", plan, "id").count() == 0


def test_each_log_file_is_read_once(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n} x.jsonl").write_text(f'{{"task_id": "{n}"}}\n')
    names = [f"{tmp_path}/*.jsonl", f"{tmp_path}/a x.jsonl", f"{tmp_path}/none*.jsonl"]
    assert sorted(r["task_id"] for r in tables.read_run_logs(spark, names, "task_id string").collect()) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        tables.read_run_logs(spark, [f"{tmp_path}/none*.jsonl"], "task_id string")


def test_files_are_kept_byte_for_byte(spark, tmp_path):
    import hashlib

    raw = b"a,b\r\n1,\xff\n"
    (tmp_path / "target.csv").write_bytes(raw)
    tables.copy_files(spark, [str(tmp_path / "target.csv")], str(tmp_path / "out"), "baseline", "t1")
    back = spark.read.parquet(str(tmp_path / "out" / "files")).first()
    assert (back["name"], bytes(back["content"]), back["variant"], back["task_id"]) == ("target.csv", raw, "baseline", "t1")
    mark = tables.file_fingerprints(spark, [str(tmp_path / "target.csv")]).first()
    assert (mark["size"], mark["sha1_head"]) == (len(raw), hashlib.sha1(raw).hexdigest())


def test_rows_of_a_sample_come_in_file_order(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("id,v\n" + "".join(f"{n * 100 + i},x\n" for i in range(50)))
    got = [r["id"] for r in tables.read_csv(spark, str(tmp_path), rows=60).collect()]
    assert sorted(got) == [*range(50), *range(100, 110)]


def test_labels_in_any_case_and_the_second_pass(spark):
    rows = [("t", "a", 0, 0, "Target"), ("t", "b", 1, 0, "score"), ("t", "b", 1, 1, "SCORE"), ("u", "c", 0, 0, "x"), ("u", "d", 1, 0, "z"), ("w", "e", 0, 0, "q")]
    names = spark.createDataFrame(rows, "task_id string, table string, table_idx int, ordinal int, column string")
    assert {tuple(r) for r in profile.label_name_first(names).collect()} == {("t", "b", "SCORE")}
    targets = spark.createDataFrame([("c", "x", 0.05), ("d", "z", 0.06), ("e", None, None)], "table string, target string, filled_share double")
    assert {tuple(r) for r in profile.label_table_first(names, targets).collect()} == {("t", "a", "Target"), ("u", "d", "z")}


def test_all_null_columns_are_columns(spark):
    df = spark.createDataFrame([(1, None)], "k int, gone string")
    got = relate.column_table({"a": df, "b": df.limit(0)})
    assert {(r["table"], r["column"], r["n_rows"]) for r in got.collect()} == {("a", "k", 1), ("a", "gone", 1), ("b", "k", 0), ("b", "gone", 0)}


def test_lost_keys_of_test_tables(spark):
    base = spark.createDataFrame([(1, 10, "x"), (2, 10, "y")], "id int, par int, label string")
    child = spark.createDataFrame([(1, 1.0), (1, 2.0)], "id int, v double")
    parent = spark.createDataFrame([(10, "p"), (11, "q")], "par int, w string")
    train = {"training_0": base, "training_1": child, "training_2": parent}
    test = {"test_0": base.drop("label"), "test_1": child.withColumnRenamed("id", "id2"), "test_2": parent.withColumnRenamed("par", "par2")}
    x, t, log = relate.build_features(train, test, "training_0", "label")
    assert set(t.columns) == set(x.columns) - {"y"} and {r["__agg__v__mean"] for r in t.collect()} == {None} and {r["w"] for r in t.collect()} == {None}
    assert [(r["train_table"], r["key"], r["status"]) for r in log.orderBy("step").collect()] == [("training_1", "id", "ok"), ("training_2", "par", "UNKNOWN_ERROR")]
    assert {r["id"]: r["__agg__v__mean"] for r in x.collect()} == {1: 1.5, 2: None}


def test_join_chain_stops_before_a_join_that_grows(spark):
    a, b = (spark.createDataFrame([(i % 3, i) for i in range(60)], f"k int, {c} int") for c in "ab")
    assert relate.join_chain({"a": a, "b": b}) == (None, "join expansion")
    assert relate.join_chain({"a": a, "b": b.select("b")}) == (None, "no common columns")
    few = spark.createDataFrame([(0, 5), (0, 6), (1, 7)], "k int, b int")
    assert relate.join_chain({"a": a, "b": few}) == (None, "many-to-many")
    same = spark.createDataFrame([(i % 3, 7) for i in range(60)], "k int, a int")
    out, error = relate.join_chain({"a": same, "b": spark.createDataFrame([(0, 5)], "k int, a int")})
    assert error is None and out.columns == ["k", "a_x", "a_y"] and out.count() == 60


def test_texts_are_counted_alike_alone_and_together(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (None, "b", None), (None, "c", None)], "k int, s string, t string")
    got = {r["k"]: (r["__agg__s__nunique"], r["__agg__t__nunique"]) for r in relate.aggregate_child(df, "k").collect()}
    one = {r["k"]: r["__agg__s__nunique"] for r in relate.aggregate_child(df.drop("t"), "k").collect()}
    assert got == {1: (1, 1), None: (2, 0)} and one == {k: s for k, (s, _) in got.items()}


def test_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = (x @ [1.5, -2.0] + 0.3 + rng.logistic(size=120) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = model.logistic(df, ["a", "b"], "y").stages[-1]
    w, z = np.zeros(3), np.column_stack([x, np.ones(120)])
    for _ in range(50):  # Newton steps on summed loss and half the squared weights, the intercept free
        p = 1 / (1 + np.exp(-z @ w))
        keep = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (p - y) + keep @ w)
    assert np.allclose([*got.coefficients, got.intercept], w, atol=1e-3)


def test_medians_and_modes_of_odd_columns(spark):
    train = spark.createDataFrame([(1.0, "b", None), (2.0, "a", None), (4.0, "a", None), (8.0, "b", None)], "x double, s string, z double")
    df = spark.createDataFrame([(None, None, None)], "x double, s string, z double")
    assert prep.impute_median(train, df, ["x", "z"]).first()[:3] == (3.0, None, None)
    assert prep.impute_mode(train, df, ["s"]).first()["s"] == "a"


def test_a_childs_texts_are_counted_without_copies_of_its_sums(spark):
    """One aggregation of sums and distinct counts copies each row once a text column and once more, sums and all."""
    from tabdrift.operators import relate

    child = spark.createDataFrame([(1, 2.0, "a", "x"), (1, 4.0, "a", "y"), (None, 1.0, None, "x"), (None, 3.0, "b", None), (2, 5.0, None, None)], "k int, v double, s string, t string")
    out = relate.aggregate_child(child, "k")
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: (r["__agg__k__row_count"], r["__agg__v__mean"], r["__agg__s__nunique"], r["__agg__t__nunique"]) for r in out.collect()}
    assert got == {1: (2, 3.0, 1, 2), None: (2, 2.0, 1, 1), 2: (1, 5.0, 0, 0)}
    none = relate.aggregate_child(child.select("k", "v"), "k")
    assert {r["k"]: r["__agg__v__max"] for r in none.collect()} == {1: 4.0, None: 3.0, 2: 5.0}


def test_statistics_move_values_without_names(spark):
    from tabdrift.operators import relate

    tables = {"a": spark.createDataFrame([(1, None), (1, "x")], "k int, s string"), "b": spark.createDataFrame([(2,)], "k int")}
    out = relate.column_stats(tables)
    assert {(r["table"], r["column"]): (r["table_idx"], r["ordinal"], r["n_rows"], r["n_null"], r["n_distinct"]) for r in out.collect()} == {("a", "k"): (0, 0, 2, 0, 1), ("a", "s"): (0, 1, 2, 1, 1), ("b", "k"): (1, 0, 1, 0, 1)}
    grouped = [x.split("Aggregate [")[1].split("]")[0] for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in x]
    assert len(grouped) == 2 and all("table#" not in x and "column#" not in x for x in grouped)
