from pyspark.sql import functions as F

from tabdrift.operators import evolve, profile, relate


def test_published_seeds(spark):
    cases = [(7, "length1_18", 3627240110), (7, "length1_19", 46442074), (2, "length3_52", 599168113), (2, "length1_18", 1019936263)]
    df = spark.createDataFrame(cases, "g int, t string, want long")
    assert df.filter(evolve.task_seed(F.col("g"), F.col("t")) != F.col("want")).count() == 0


def test_add_leaves_other_columns(spark):
    df = spark.createDataFrame([(i, chr(97 + i % 5)) for i in range(400)], "id long, c string")
    out = evolve.add_columns(df, 3, "id")
    assert out.columns[:2] == ["id", "c"] and [r["__row_id"] for r in out.orderBy("id").collect()] == list(range(400))
    assert 0.1 < out.filter("__new_sparse = 1.0").count() / 400 < 0.3
    many = evolve.add_columns(df.repartition(7), 3, "id")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)


def test_row_ids_with_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "id long, c string")
    assert sorted(r["__row_id"] for r in evolve.add_columns(df, 1, "id").collect()) == [0, 1, 2, 3]


def test_row_ids_of_keys_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(evolve, "SORTED", 50)
    rows = [(None, i % 3) for i in range(200)] + [(7, 1)] * 120 + [(i % 20 + 10, i) for i in range(60)] + [(1, 0), (1, 0)]
    for parts in (1, 6):
        got = evolve.add_columns(spark.createDataFrame(rows, "`k.id` long, v long").repartition(parts), 3, "k.id").collect()
        assert sorted(r["__row_id"] for r in got) == list(range(len(rows)))
        keys = [r["k.id"] for r in sorted(got, key=lambda r: r["__row_id"])]
        assert keys[:200] == [None] * 200 and keys[200:] == sorted(keys[200:])
        assert sorted((r["k.id"] or 0, r["v"]) for r in got) == sorted((k or 0, v) for k, v in rows)


def test_protected_missing_and_narrow_tables_stay(spark):
    df = spark.createDataFrame([(1, "a")], "id long, c string")
    assert evolve.rename_column(df, "c", ["c"]).columns == ["id", "c"] and evolve.rename_column(df, "x").columns == ["id", "c"]
    assert evolve.drop_column(df, "c").columns == ["id", "c"] and evolve.unit_scale(df, "c", 10).dtypes == df.dtypes
    assert evolve.evolve_address(df).columns == ["id", "c"]


def test_collapse_ties_and_nulls(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "id long, c string")
    got = [r["c"] for r in evolve.collapse_categories(df, "c", 1, "id").orderBy("id").collect()]
    assert got == ["b", "Other", "Other", "b", "Other", "Other"]


def test_scaled_mean(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3)], "counts double")
    assert evolve.unit_scale(df, "counts", 1000).agg(F.avg("counts")).first()[0] == 0.002


def test_flip_counts_unparsed_rows_as_timed(spark):
    timed = spark.createDataFrame([("2020-01-02",), ("2020-1-3",), ("x",), ("2020-01-05",)], "d string")
    assert [r["d"] for r in evolve.flip_date_time(timed, "d", "yyyy-M-d").collect()] == ["2020-01-02", "2020-01-03", None, "2020-01-05"]
    few = spark.createDataFrame([("2020-01-02",)] * 9 + [("x",)], "d string")
    assert evolve.flip_date_time(few, "d", "yyyy-M-d").first()["d"] == "2020-01-02 00:00:00"
    bad = spark.createDataFrame([("x",), ("y",), ("2020-01-02",)], "d string")
    assert evolve.flip_date_time(bad, "d", "yyyy-M-d").first()["d"] == "x"


def test_address_round_trip(spark):
    df = spark.createDataFrame([(1, "1 Road", "Town", "Land"), (2, None, "", None)], "id long, street string, city string, region string")
    joined = evolve.evolve_address(df)
    assert joined.columns == ["id", "street_full_address"] and [r[1] for r in joined.orderBy("id").collect()] == ["1 Road, Town, Land", None]
    split = evolve.evolve_address(joined.filter("id = 1").withColumnRenamed("street_full_address", "home_addr"), "home_addr")
    assert tuple(split.first()) == (1, "1 Road", "Town", "Land")


def test_state_and_zip_make_an_address(spark):
    out = evolve.evolve_address(spark.createDataFrame([("NY", 10001.0)], "STATE string, zipcode double"))
    assert out.columns == ["address_full_address"] and out.first()[0] == "NY, 10001"


def test_plan_takes_no_protected_column(spark):
    rows = [("t", "a", 0, i, c) for i, c in enumerate(["id", "y", "ship_date", "price", "status"])] + [("t", "b", 1, 0, "id")]
    plan = evolve.plans(spark.createDataFrame(rows, "task_id string, `table` string, table_idx int, ordinal int, `column` string"), 7, protected=["y"]).first()
    assert plan["join_keys"] == ["id"] and plan["datetime_col"] == "ship_date" and plan["meaning_num_col"] == "price" and plan["meaning_cat_col"] == "status"
    assert plan["rename_col"] not in ("y", "id") and plan["drop_col"] not in ("y", "id")
    keyed = evolve.plans(spark.createDataFrame(rows, "task_id string, `table` string, table_idx int, ordinal int, `column` string"), 7, key_mode="key").first()
    assert keyed["rename_col"] == "id"


def test_diff_of_equal_schemas_is_empty(spark):
    names = spark.createDataFrame([("t", "a", "int64")], "table string, column string, dtype string")
    assert tuple(profile.schema_diff(names, names).first())[1:] == ([], [], [])


def test_join_keys_of_a_shared_column(spark):
    rows = [("t", "a", "Country"), ("t", "b", "Country"), ("t", "b", "Region"), ("t", "a", "Unnamed: 0"), ("t", "b", "Unnamed: 0"), ("u", "a", "x")]
    got = relate.join_keys(spark.createDataFrame(rows, "task_id string, `table` string, `column` string")).collect()
    assert [(r["task_id"], r["column"]) for r in got] == [("t", "Country")]
