"""Exact and near dedup against brute force, and their edge cases."""

import hashlib

import numpy as np
import pytest
from conftest import DATA

from tabdrift.llm import exact_dedup as ed
from tabdrift.llm import near_dedup as nd


def stored(spark, tmp_path, rows, schema="doc_id long, text string"):
    path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def test_exact_marks(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "n")]
    got = ed.exact_dedup(stored(spark, tmp_path, rows), ed.new_index(spark), "one").collect()
    assert len(got) == len(rows)
    by = lambda t: [(r["doc_id"], r["dd_keep_id"], r["dd_group_size"], r["dd_kept"]) for r in got if (r["text"] or "") == t]
    assert sorted(by("a"), key=str) == [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False)]
    assert sorted(by("")) == [(3, 4, 2, False), (4, 4, 2, True)]
    assert sorted(x[3] for x in by("b")) == [False, True] and by("n") == [(None, None, 1, True)]
    assert {bytes(r["dd_digest"]).hex() for r in got if r["text"] == "a"} == {hashlib.sha256(b"a").hexdigest()}


def test_index_remembers_batches(spark, tmp_path):
    index = ed.new_index(spark)
    first = ed.keep_first_of_each(stored(spark, tmp_path, [(1, "a"), (2, "b")]), index, "one")
    assert first.count() == 2
    second = ed.exact_dedup(stored(spark, tmp_path, [(7, "a"), (8, "c"), (9, "c")]), index, "two")
    assert sorted((r["doc_id"], r["dd_keep_id"], r["dd_kept"]) for r in second.collect()) == [(7, 1, False), (8, 9, False), (9, 9, True)]
    assert index.read().count() == 3
    again = ed.DigestIndex(spark, index.name)
    assert again.buckets == index.buckets and "SortMergeJoin" in index.read().hint("merge").join(again.read(), "digest", "left_anti")._jdf.queryExecution().toString()
    index.drop()


def test_a_batch_that_runs_again_decides_alike(spark, tmp_path):
    index = ed.new_index(spark)
    docs = stored(spark, tmp_path, [(1, "a"), (2, "a"), (3, None), (3, None), (4, "z" * 300_000)])
    ed.exact_dedup(stored(spark, tmp_path, [(9, "z" * 300_000)]), index, "earlier")
    index.add(ed.text_groups(docs).filter("dd_group_size > 1"), "one")  # a run that was lost half way
    runs = [sorted(map(str, ed.exact_dedup(docs, index, "one").collect())) for _ in range(3)]
    assert runs[0] == runs[1] == runs[2]
    kept = sorted(tuple(r) for r in ed.keep_first_of_each(docs, index, "one").collect())
    assert kept == [(2, "a"), (3, None)]
    assert ed.keep_first_of_each(docs, index, "other").count() == 0
    assert index.read().count() == 3
    index.drop()


def test_compaction_keeps_rows_and_leaves_a_file_a_bucket(spark, tmp_path):
    index = ed.new_index(spark)
    for n in range(3):
        ed.exact_dedup(stored(spark, tmp_path, [(i, f"{n}-{i}") for i in range(40)]), index, str(n))
    before = sorted(map(str, index.read().collect()))
    files = lambda: len(index.read().inputFiles())
    assert files() > index.buckets
    index.compact()
    assert files() <= index.buckets and sorted(map(str, index.read().collect())) == before
    spark.sql(f"ALTER TABLE {index.name} RENAME TO {index.spare}")  # as if lost before the last step
    again = ed.DigestIndex(spark, index.name)
    assert sorted(map(str, again.read().collect())) == before and again.buckets == index.buckets
    again.drop()
    assert not spark.catalog.tableExists(index.name)


def test_index_lies_in_the_shared_folder_and_leaves_no_rows(spark, tmp_path):
    """A warehouse of the driver's own, which is Spark's default, is not needed."""
    index = ed.new_index(spark)
    ed.exact_dedup(stored(spark, tmp_path, [(i, f"{i}") for i in range(20)]), index, "one")
    files, shared = index.read().inputFiles(), spark.conf.get("spark.checkpoint.dir")
    assert files and all(shared in f for f in files) and not any(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") in f for f in files)
    folder = files[0].rsplit("/", 1)[0]
    index.drop()
    assert spark.read.schema(ed.INDEX_SCHEMA).parquet(folder).count() == 0 and not spark.catalog.tableExists(index.name)


def test_exact_on_empty_and_clashing_columns(spark, tmp_path):
    assert ed.exact_dedup(stored(spark, tmp_path, []), ed.new_index(spark), "one").count() == 0
    names = "doc_id long, text string, digest int, keep_id int, batch string, dd_digest int, dd_keep_id int, dd_repeats int, dd_group_size int"
    row = (5, 6, "z", 1, 2, 3, 4)
    odd = stored(spark, tmp_path, [(1, "a", *row), (2, "a", *row)], names)
    marked = ed.exact_dedup(odd, ed.new_index(spark), "one").filter("dd_kept").first()
    assert (marked["doc_id"], marked["dd_keep_id"], marked["dd_group_size"], marked["keep_id"]) == (2, 2, 2, 6)
    odd = odd.select("doc_id", "text", "digest", "keep_id", "batch")
    kept = ed.keep_first_of_each(odd, ed.new_index(spark), "one")
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [(2, "a", 5, 6, "z")]


def test_exact_when_splits_move_between_scans(spark, tmp_path, monkeypatch):
    """As when an executor joins or is lost: each file is a split of its own from some scan on."""
    rows = [(i, f"t{i % 60}") for i in range(100)] + [(500, "r")] * 5 + [(None, "n")] * 3
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    wide, narrow = 1 << 27, 1 << 10
    plain, left = ed.written, [0]

    def moved(df, name):
        got = plain(df, name)
        left[0] -= 1
        if left[0] == 0:
            spark.conf.set("spark.sql.files.maxPartitionBytes", narrow)
        return got

    monkeypatch.setattr(ed, "written", moved)
    try:
        for n in (1, 2, 3):
            spark.conf.set("spark.sql.files.maxPartitionBytes", wide)
            spark.conf.set("spark.sql.files.minPartitionNum", 1)
            left[0] = n
            got = ed.keep_first_of_each(spark.read.schema("doc_id long, text string").parquet(path), ed.new_index(spark), "one").collect()
            want = [(max(j for j in range(100) if j % 60 == i), f"t{i}") for i in range(60)] + [(500, "r"), (None, "n")]
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def _check(spark, docs, rows, spec):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_classes(docs, spec).collect()}
    assert got == brute(rows, spec.words, spec.percent)


@pytest.mark.parametrize("spec", [nd.NearDupSpec(3, 85), nd.NearDupSpec(5, 80)])
def test_near_classes_of_real_documents(spark, spec):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    _check(spark, docs, [(r["doc_id"], r["text"]) for r in docs.collect()], spec)


def planted(n_copies=70):
    """A text, copies with a few words changed so that only some pairs link, and edge cases."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n_copies):
        w = list(base)
        for at in rng.choice(len(w), rng.integers(1, 7), replace=False):
            w[at] = word()
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([word() for _ in range(40)] + base[:25])) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "One"), (304, "oNE"), (305, "one two"), (306, "ÀB c d"), (307, "àb c d"), (308, rows[3][1].upper()), (309, "x " * 30_000)]
    return rows


def test_near_classes_with_crowded_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nd, "SMALL_BUCKET", 4)
    rows = planted()
    _check(spark, stored(spark, tmp_path, rows), rows, nd.NearDupSpec(3, 85))


def test_near_edge_cases(spark, tmp_path):
    spec = nd.NearDupSpec(3, 85)
    assert nd.near_classes(stored(spark, tmp_path, []), spec).count() == 0
    rows = [(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, "A b  c")]
    got = sorted(map(tuple, nd.near_classes(stored(spark, tmp_path, rows), spec).collect()), key=str)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (None, 1, None, True)]
    odd = stored(spark, tmp_path, [(1, "p q r", 1, 2, 3), (2, "p q r", 1, 2, 3)], "doc_id long, text string, id int, n int, root int")
    kept = nd.keep_one_of_each(odd, spec)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_near_classes_of_a_key_with_many_texts(spark, tmp_path):
    """Key 7 holds a third of the rows: texts of its own, copies of others, and near copies of each other."""
    rng = np.random.default_rng(8)
    text = lambda: [f"w{i}" for i in rng.integers(0, 10**9, 60)]
    alone, copied, twins = [text() for _ in range(12)], [text() for _ in range(4)], text()
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(7, " ".join(w)) for w in alone] + [(7, " ".join(twins)), (7, near(twins))] + [(7, near(w)) for w in copied]
    rows += [(i, " ".join(w)) for i, w in enumerate(copied)] + [(100 + i, " ".join(text())) for i in range(30)] + [(7, " ".join(alone[0]))] * 3
    docs = stored(spark, tmp_path, rows)
    spec = nd.NearDupSpec(3, 85)
    got = nd.near_classes(docs, spec).collect()
    assert len(got) == len(rows)
    assert sorted(r["component_id"] for r in got if r["doc_id"] == 7) == [0, 1, 2, 3] + [7] * 17
    assert sum(not r["kept"] for r in got) == 5 and all(r["kept"] for r in got if r["doc_id"] != 7)
    kept = sorted(map(tuple, nd.keep_one_of_each(docs, spec).collect()))
    lost = [near(w) for w in copied]
    either = [r for r in kept if r[1] in (" ".join(twins), near(twins))]
    assert len(either) == 1
    assert sorted(set(kept) - set(either)) == sorted({r for r in rows if r[1] not in (*lost, " ".join(twins), near(twins))})
    assert len(kept) == len(rows) - 5


def test_signature_guarantee():
    for spec in (nd.NearDupSpec(3, 85), nd.NearDupSpec(5, 80)):
        chunks = spec.chunks
        assert sum(map(len, chunks)) == spec.hashes and len(chunks) * (spec.errors + 1) > spec.distance
        assert min(map(len, chunks)) > spec.errors


def test_all_pairs_within_the_distance_share_a_key(spark):
    spec = nd.NearDupSpec(3, 85)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        a = rng.integers(0, 65536, spec.hashes, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(spec.hashes, spec.distance, replace=False)
        b[at] += np.uint16(1)
        rows.append((i, a.tobytes(), b.tobytes()))
    df = spark.createDataFrame(rows, "i int, a binary, b binary")
    from pyspark.sql import functions as F

    shared = df.select(F.size(F.array_intersect(nd.chunk_keys(F.col("a"), spec), nd.chunk_keys(F.col("b"), spec))).alias("n"), nd.symbol_distance("a", "b").alias("d"))
    assert all(r["n"] > 0 and r["d"] == spec.distance for r in shared.collect())


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["cid"]: r["root"] for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0
