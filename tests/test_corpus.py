"""Files of a corpus: cells, catalogue, sink, resume, and evolution in one job against one table at a time."""

import csv
import hashlib
import io
import os
import random

import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tabdrift.operators import evolve, evolve_corpus
from tabdrift.sources import corpus


def sheet(rng, rows):
    out, head = io.StringIO(), ["", "a b", "x,y", "q\"q", "dup", "dup", "line\nbreak"][: rng.randint(2, 7)]
    w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    w.writerow(head)
    for i in range(rows):
        w.writerow([str(i), *(rng.choice(["1", "2.5", "", "NA", 'say "x"', "a,b", "c\nd", "é ", '"']) for _ in head[1:])])
    return out.getvalue().encode()


def test_cells_of_whole_files(spark, tmp_path):
    rng = random.Random(3)
    for t in range(8):
        os.makedirs(tmp_path / f"t{t}")
        for name in ("training_0.csv", "test_1.csv", "target.csv", "notes.txt"):
            (tmp_path / f"t{t}" / name).write_bytes(sheet(rng, rng.randint(0, 25)))
    (tmp_path / "t0" / "training_0.csv").write_bytes(b"\n,a,b\r\n0,1\r\n\r\n1,2,3,4\n2,\"x\ny\",5")
    got = {}
    for r in corpus.file_cells(corpus.corpus_files(spark, str(tmp_path))).collect():
        got.setdefault((r["task_id"], r["role"], r["table_idx"]), {})[r["row_id"], r["column"]] = r["value"]
    assert got["t0", "training", 0] == {(0, "a"): "1", (0, "b"): None, (1, "a"): "x\ny", (1, "b"): "5"}
    for t in range(1, 8):
        for key, name in ((("training", 0), "training_0.csv"), (("test", 1), "test_1.csv"), (("target", None), "target.csv")):
            df = pd.read_csv(tmp_path / f"t{t}" / name, dtype=str, engine="python", on_bad_lines="skip")
            df = df[[c for c in df.columns if not c.startswith("Unnamed")]]
            want = {(i, c): None if pd.isna(v) else v for i, row in enumerate(df.to_dict("records")) for c, v in row.items()}
            assert got.get((f"t{t}", *key), {}) == want


def test_types_of_columns(spark):
    rows = [("t", "training", 0, i, k, c, v) for k, (c, vs) in enumerate({"i": ["1", "-2"], "f": ["1", None], "e": [None, None], "b": ["True", "False"], "s": ["1", "x"]}.items()) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "task_id string, role string, table_idx int, row_id long, ordinal int, column string, value string")
    assert {r["column"]: r["dtype"] for r in corpus.column_types(df).collect()} == {"i": "int64", "f": "float64", "e": "float64", "b": "bool", "s": "object"}


def files_of(spark, rows):
    return spark.createDataFrame([(v, t, n, bytearray(c)) for v, t, n, c in rows], corpus.FILES)


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs if f != corpus.COMPLETE}


def test_a_sink_commits_whole_tasks(spark, tmp_path):
    root, raw = str(tmp_path / "out"), os.urandom(3000)
    corpus.write_files(files_of(spark, [("baseline", "t1", "target.csv", raw), ("baseline", "t1", "training_0.csv", b"a\n1\n"), ("drop", "t2", "target.csv", b"")]), root)
    first = tree(root)
    assert set(first) == {"baseline/t1/target.csv", "baseline/t1/training_0.csv", "drop/t2/target.csv"}
    assert hashlib.sha1(first["baseline/t1/target.csv"]).digest() == hashlib.sha1(raw).digest()
    assert not os.path.exists(f"{root}/_staging/") or not os.listdir(f"{root}/_staging")
    # a job of which a task fails leaves what was there, and nothing of its own
    boom = F.udf(lambda n: bytearray(b"new") if n != "bad.csv" else 1 / 0, "binary")
    bad = spark.createDataFrame([("baseline", "t1", "target.csv"), ("drop", "t3", "ok.csv"), ("drop", "t4", "bad.csv")], "variant string, task_id string, name string").withColumn("content", boom("name"))
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        corpus.write_files(bad, root)
    assert tree(root) == first and {tuple(r) for r in corpus.completed(spark, root).collect()} == {("baseline", "t1"), ("drop", "t2")}
    # the same again, and a task anew with fewer files
    corpus.write_files(files_of(spark, [("baseline", "t1", "target.csv", b"z")]), root)
    assert {k: v for k, v in tree(root).items() if "t1" in k} == {"baseline/t1/target.csv": b"z"}
    with pytest.raises(Exception, match="no name of a file"):
        corpus.write_files(files_of(spark, [("baseline", "..", "x", b"")]), root)


def test_tasks_are_complete_by_plan_and_log(spark, tmp_path):
    for task, names in (("a", ["manifest.json", "evo_log.json"]), ("b", ["manifest.json"])):
        os.makedirs(tmp_path / "add" / task)
        for n in names:
            (tmp_path / "add" / task / n).write_text("{}")
    assert [tuple(r) for r in corpus.completed(spark, str(tmp_path)).collect()] == [("add", "a")]
    assert corpus.completed(spark, str(tmp_path / "nothing")).count() == 0


def test_a_repeated_run_leaves_one_set_of_records(spark, tmp_path):
    root = str(tmp_path / "log")
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "task_id string, n int")
    for part in (log, log.filter("task_id = 'b'"), log.filter("task_id = 'a'").withColumn("n", F.col("n") + 5)):
        corpus.write_task_log(part, root)
    assert sorted((r["task_id"], r["n"]) for r in spark.read.json(root).collect()) == [("a", 6), ("a", 7), ("b", 1)]


def wide(spark, cells, table):
    rows, order = {}, {}
    for t, r, i, row, o, c, v in cells:
        if (t, r, i) == table:
            rows.setdefault(row, {})[c] = v
            order[c] = o
    names = sorted(order, key=order.get)
    df = spark.createDataFrame([(row, *(vs.get(c) for c in names)) for row, vs in rows.items()], "rid long, " + ", ".join(f"`{c}` string" for c in names))
    for c in names:
        seen = [vs.get(c) for vs in rows.values() if vs.get(c) is not None]
        try:
            list(map(float, seen))
            df = df.withColumn(c, F.col(f"`{c}`").cast("double"))
        except ValueError:
            pass
    return df


def same(v):
    try:
        return round(float(v), 9)
    except (TypeError, ValueError):
        return v


@pytest.mark.parametrize("op", list(evolve_corpus.OPS))
def test_a_corpus_evolves_as_its_tables_do(spark, op):
    rng, cells, plans = random.Random(11), [], []
    kinds = [
        {"name": ["ann", "bob", None, "cy"], "when": ["2024-01-02", "2023-11-30", "soon"], "cost": ["1.5", "20", None], "num": ["1", " 2", "x3"] + ["7"] * 9},
        {"street": ["1 Main", " ", None], "city": ["Rome", "Oslo"], "state": ["NY", None], "zip": ["10001", "02138.0"], "cost": ["1", "2"], "name": ["q"]},
        {"home_addr": ["1 Main, Rome, IT", "5 Elm,Oslo", "x", None], "cost": ["n/a", "4"], "name": [None], "when": ["2024-01-02 10:30", "bad"]},
        {"home_addr": ["1 Main|Rome", "5 Elm|Oslo|NO|x"], "cost": ["2"], "name": ["u", "v", "w"], "when": ["3/4/2024", "2024"]},
        {"a": ["1"], "b": ["x"]},
    ]
    for t in range(10):
        kind = kinds[t % len(kinds)]
        for role in ("training", "test"):
            for row in range(rng.randint(1, 30)):
                cells += [(f"t{t}", role, 0, row, o, c, rng.choice(vs)) for o, (c, vs) in enumerate(kind.items())]
        plans.append({
            "task_id": f"t{t}", "seed": 100 + t, "label_col": "name" if t == 7 else None, "rename_col": ["name", "cost", "gone"][t % 3], "drop_col": ["cost", "name", "a", None][t % 4], "address_col": "home_addr" if t % 5 in (2, 3) else None,
            "datetime_col": "when", "datetime_format": {0: "yyyy-M-d", 3: "M/d/yyyy"}.get(t % 5), "datetime_rule": evolve.DATE_RULES[t // 5], "meaning_num_col": "cost", "meaning_cat_col": "name", "category_keep_topk": 1 + t % 2, "unit_scale_divisor": 10.0,
        })
    df = spark.createDataFrame(cells, "task_id string, role string, table_idx int, row_id long, ordinal int, column string, value string")
    schema = "task_id string, seed long, label_col string, rename_col string, drop_col string, address_col string, datetime_col string, datetime_format string, datetime_rule string, meaning_num_col string, meaning_cat_col string, category_keep_topk int, unit_scale_divisor double"
    out = evolve_corpus.evolve_corpus(df, spark.createDataFrame([tuple(p.values()) for p in plans], schema), [op])
    got = {}
    for r in out.collect():
        got.setdefault((r["task_id"], r["role"], r["table_idx"]), {})[r["row_id"], r["column"]] = same(r["value"])
    for plan in plans:
        for role in ("training", "test"):
            table = (plan["task_id"], role, 0)
            alone = evolve.evolve(wide(spark, cells, table), [op], plan, "rid", [plan["label_col"]] if plan["label_col"] else [])
            want = {(r["rid"], c): same(r[c]) for r in alone.collect() for c in alone.columns if c != "rid"}
            assert got[table] == want, (op, table)


def test_cells_stay_where_they_are_while_plans_are_few(spark, monkeypatch):
    cells, plans = [], []
    for t in range(6):
        names = ["cost", "kind"] + (["more"] if t % 2 else [])
        values = {"cost": ["1", "2.5", None, "x" if t == 3 else "4"], "kind": [None] * 4 if t == 4 else ["a", "b", None, "b"], "more": list("pqrs")}
        cells += [(f"t{t}", role, i, row, o, c, values[c][row]) for role, i in (("training", 0), ("test", 0), ("target", None)) for row in range(4) for o, c in enumerate(names)]
        plans.append((f"t{t}", "more" if t == 5 else None, "kind", ["cost", "more"][t % 2], "cost", "kind__renamed", [1, 0, None][t % 3], 2.0))
    df = spark.createDataFrame(cells, "task_id string, role string, table_idx int, row_id long, ordinal int, column string, value string")
    told = spark.createDataFrame(plans, "task_id string, label_col string, rename_col string, drop_col string, meaning_num_col string, meaning_cat_col string, category_keep_topk int, unit_scale_divisor double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most in (evolve_corpus.BROADCAST_ROWS, 3, 0):
            monkeypatch.setattr(evolve_corpus, "BROADCAST_ROWS", most)
            out = evolve_corpus.evolve_corpus(df, told, ["rename", "drop", "meaning"])
            found.append(sorted(map(repr, out.collect())))
            if most > 6:
                assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] == found[2]
    got = {(r["task_id"], r["role"], r["row_id"], r["column"]): r["value"] for r in out.collect()}
    costs = {t: [got.get((f"t{t}", "test", row, "cost")) for row in range(4)] for t in range(6)}
    kinds = {t: [got.get((f"t{t}", "test", row, "kind__renamed")) for row in range(4)] for t in range(6)}
    assert costs[0] == costs[1] == ["0.5", "1.25", None, "2.0"] and costs[3] == ["1", "2.5", None, "x"]
    assert kinds[0] == kinds[3] == ["Other", "b", "Other", "b"] and kinds[1] == kinds[2] == ["Other"] * 4 and kinds[4] == [None] * 4
    assert {c for t, *_, c in got if t == "t5"} == {"cost", "kind__renamed", "more"} and {c for t, *_, c in got if t == "t1"} == {"cost", "kind__renamed"}


def test_rows_of_a_corpus_are_numbered_once(spark):
    from tabdrift.plans import corpus_queries

    plan = corpus_queries._cells(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1


def test_a_corpus_of_files_is_evolved_and_taken_up_again(spark, tmp_path):
    import json

    root, out = tmp_path / "in", str(tmp_path / "out")
    for t in range(4):
        os.makedirs(root / f"t{t}")
        (root / f"t{t}" / "training_0.csv").write_text(",Score,name,sale_date\n" + "".join(f"{i},{i},n{i % 2},{i + 1}/2/2024\n" for i in range(12)))
        (root / f"t{t}" / "test_0.csv").write_text("Score,name,sale_date\n1,n1,2/2/2024\n")
        if t != 3:
            (root / f"t{t}" / "target.csv").write_bytes(b"x,y\r\n1,\xff\r\n")
    os.makedirs(root / "bare")
    (root / "bare" / "target.csv").write_text("a\n")
    status = lambda df: {r["task_id"]: (r["status"], r["label_col"]) for r in df.collect()}
    first = status(evolve_corpus.evolve_files(spark, str(root), out, "rename", ["rename"], 5))
    assert first == {**{f"t{t}": ("ok", "Score") for t in range(3)}, "t3": ("skipped_no_target", None), "bare": ("skipped_no_train_test", None)}
    before = tree(out)
    assert before["rename/t0/target.csv"] == b"x,y\r\n1,\xff\r\n"
    plan, log = (json.loads(before[f"rename/t0/{n}"]) for n in ("manifest.json", "evo_log.json"))
    assert plan["label_col"] == "Score" and plan["datetime_col"] == "sale_date" and plan["datetime_format"] == "M/d/yyyy" and plan["rename_col"] != "Score"
    assert [f["role"] for f in log["files"]] == ["test", "training"] and log["files"][1]["rows_before"] == log["files"][1]["rows_after"] == 12
    assert log["files"][0]["added"] == [plan["rename_col"] + "__renamed"] and log["files"][0]["removed"] == [plan["rename_col"]]
    assert before["rename/t0/test_0.csv"].decode().splitlines()[0] == ",".join(c + "__renamed" if c == plan["rename_col"] else c for c in ("Score", "name", "sale_date"))
    again = status(evolve_corpus.evolve_files(spark, str(root), out, "rename", ["rename"], 5))
    assert again["t0"][0] == "skipped_resume_exists" and tree(out) == before
    evolve_corpus.evolve_files(spark, str(root), out, "baseline", [], 5)
    copied = tree(out)
    assert all(copied[f"baseline/t0/{n}"] == (root / "t0" / n).read_bytes() for n in ("training_0.csv", "test_0.csv", "target.csv"))


def test_a_commit_renames_a_task_once_and_writes_nothing(tmp_path, monkeypatch):
    """Marks are staged with their tasks, so the driver's share is one move a task, and an older task goes."""
    from pyspark.sql import Row

    store, calls = corpus.fs.LocalFileSystem(), []

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **k: calls.append(name) or getattr(store, name)(*a, **k)

    def put(n):
        writer = corpus.CorpusWriter(str(tmp_path))
        monkeypatch.setattr(writer, "_store", lambda: (Counted(), str(tmp_path)))
        staged = writer.write(Row(variant="v", task_id=f"t{i}", name=f"{n}.csv", content=b"x") for i in range(n))
        assert not os.path.exists(tmp_path / "v" / f"t{n - 1}")
        calls.clear()
        writer.commit([staged, None])

    put(20)
    assert calls.count("move") == 20 and calls.count("open_output_stream") == 0 and len(calls) < 30
    put(30)
    assert calls.count("move") == 30 and calls.count("delete_dir") == 21
    assert all(sorted(os.listdir(tmp_path / "v" / f"t{i}")) == ["30.csv", corpus.COMPLETE] for i in range(30)) and not os.listdir(tmp_path / "_staging")


def test_the_driver_lists_no_files(spark, tmp_path):
    """Tasks list and read files, empty ones and those of hidden folders' neighbours too; no plan holds their names."""
    root = str(tmp_path / "out")
    made = [("v", f"t {i}%2F", n, b"" if i % 3 == 0 else b"a\n1\n") for i in range(40) for n in ("training_0.csv", "target.csv")]
    corpus.write_files(files_of(spark, made), root)
    os.makedirs(tmp_path / "out" / "_staging" / "t" / "x")
    (tmp_path / "out" / "_staging" / "t" / "x" / "target.csv").write_bytes(b"a")
    (tmp_path / "out" / "v" / "t 1%2F" / ".target.csv.crc").write_bytes(b"a")
    got = corpus.corpus_files(spark, root)
    assert got.inputFiles() == [] or not any(f.endswith(".csv") for f in got.inputFiles())
    assert sorted((r["task_id"], r["role"], bytes(r["content"]), r["length"]) for r in got.collect()) == sorted((t, n.split("_")[0].split(".")[0], c, len(c)) for _, t, n, c in made)
    assert corpus.completed(spark, root).count() == 40
    with pytest.raises(FileNotFoundError):
        corpus.corpus_files(spark, str(tmp_path / "nothing"))
