"""Embedding graph, importance resampling and vector codes against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, rows_of, rows_of_sql

from tabdrift.llm import embedding_dedup as ed
from tabdrift.llm import importance as im
from tabdrift.llm import queries
from tabdrift.llm import vector_codes as vc


@pytest.mark.parametrize("name", ["op11_embedding_graph", "op12_importance", "op13_vector_codes"])
def test_queries_match_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    names, rows = rows_of_sql(duck, queries.ORACLE_SQL[name])
    assert sorted(df.columns) == names and list(map(repr, rows_of(df))) == list(map(repr, rows))


# --- embeddings -------------------------------------------------------------------------------------------------


def clouds(seed=1, labels=2, size=120, dim=16):
    """Unit vectors, a third of them in clouds of near copies, some of them equal, of a few labels."""
    rng, rows = np.random.default_rng(seed), []
    for label in range(labels):
        for i in range(size):
            v = rng.normal(size=dim)
            if i % 3 == 0:
                middle = np.random.default_rng(100 * label + i % 4).normal(size=dim)
                v = middle / np.linalg.norm(middle) + rng.normal(size=dim) * rng.choice([0.02, 0.08])
            rows.append([len(rows), (v * rng.uniform(0.5, 2)).tolist(), label])
    for i in range(0, 30, 3):
        rows.append([len(rows), rows[i][1], rows[i][2]])
    return [tuple(r) for r in rows]


def plain_classes(rows, least=0.93):
    good = [(k, np.array(v), label) for k, v, label in rows if k is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, root = dict.fromkeys((k for k, *_ in rows), 0), {k: k for k, *_ in rows}
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[i + 1 :]:
            if la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                n[a] += 1
                n[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {(k, n[k], root[k], root[k] == k or k is None) for k in n}


VECTORS = "vec_id long, embedding array<double>, label int"


def test_embedding_classes_equal_brute_force(spark):
    rows = clouds()
    got, recall = ed.near_vectors(spark.createDataFrame(rows, VECTORS), ed.GraphSpec(shard=64, degree=8, beam=16))
    assert recall == 1.0 and {tuple(r) for r in got.collect()} == plain_classes(rows)


def test_units_are_split_and_tiled_without_loss(spark):
    rows = clouds(2, 1, 300)
    for spec in (ed.GraphSpec(unit=150, shard=64), ed.GraphSpec(unit=60, shard=64, spread=100.0)):
        vertices = spark.createDataFrame([(i, 0, 16, v) for i, v, _ in rows[:300]], "cid long, label long, dim int, vec array<double>")
        units = ed.split_units(vertices, spec)
        assert units.groupBy("unit").count().agg({"count": "max"}).first()[0] <= 2 * spec.unit
        met = {(a, b) for u in units.groupBy("unit").agg({"cid": "collect_list"}).collect() for a in u[1] for b in u[1]}
        x = np.array([v for _, v, _ in rows[:300]])
        x /= np.linalg.norm(x, axis=1)[:, None]
        assert all((a, b) in met for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True))
        got, recall = ed.near_vectors(spark.createDataFrame(rows, VECTORS), spec)
        assert recall == 1.0 and {tuple(r) for r in got.collect()} == plain_classes(rows)


def test_groups_that_cells_do_not_shrink_are_tiled_at_once(spark):
    """Vectors in all directions lie at every border: cells of cells would copy each of them 80 times and more."""
    rng = np.random.default_rng(5)
    vertices = spark.createDataFrame([(i, 0, 16, rng.normal(size=16).tolist()) for i in range(300)], "cid long, label long, dim int, vec array<double>")
    assert ed.split_units(vertices, ed.GraphSpec(unit=60)).count() == 300 * 10
    assert ed.GraphSpec().held(64) == 131_072 and ed.GraphSpec().held(1024) == 8_192


def test_vectors_are_stored_once_and_as_they_come(spark, monkeypatch):
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in clouds()]
    stored, plain = [], ed.written
    monkeypatch.setattr(ed, "written", lambda df, name: stored.append((name, dict(df.dtypes).get("vec"))) or plain(df, name))
    for spec, most in ((ed.GraphSpec(shard=64, degree=8, beam=16), 1), (ed.GraphSpec(unit=100, shard=64), 5)):
        stored.clear()
        got, _ = ed.near_vectors(spark.createDataFrame(rows, VECTORS.replace("double", "float")), spec)
        assert {tuple(r) for r in got.collect()} == plain_classes(rows)
        kinds = [kind for _, kind in stored if kind]
        assert set(kinds) == {"array<float>"} and len(kinds) <= most


def test_odd_embeddings_link_with_nothing(spark):
    e = [1.0, 0.0]
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1), (7, e, None), (8, e, 1), (9, e, 1),
            (10, [2.0, 0.1], 1), (11, e, 2), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS cid", "1 AS unit", "2 AS h1")
    assert {tuple(r) for r in ed.near_vectors(df, ed.GraphSpec())[0].collect()} == plain_classes(rows)
    repeated = ed.near_vectors(spark.createDataFrame([(1, e, 1), (1, e, 1), (None, e, 1)], VECTORS), ed.GraphSpec())[0].collect()
    assert sorted(map(repr, map(tuple, repeated))) == sorted(map(repr, [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]))
    assert ed.near_vectors(df.limit(0), ed.GraphSpec())[0].count() == 0


def test_graph_prunes_what_is_nearer_to_a_neighbour():
    v = np.array([[1, 0], [0.99, 0.14], [0.95, 0.31], [0.0, 1.0]], np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    kept = ed.robust_prune(v, np.array([0]), np.array([[1, 2, 3]]), 1, 1.2)[0]
    assert kept.tolist() == [1]
    assert set(ed.robust_prune(v, np.array([0]), np.array([[1, 2, 3, 3, 0, -1]]), 3, 1.0)[0].tolist()) == {1, 2, 3}


def test_a_shard_graph_knows_the_nearest_of_all_and_is_connected(monkeypatch):
    v = np.random.default_rng(3).normal(size=(900, 64)).astype(np.float32)
    v[:200] = v[0] + 0.1 * v[:200]  # a cloud
    v /= np.linalg.norm(v, axis=1)[:, None]
    searches = []
    monkeypatch.setattr(ed, "beam_search", lambda *a, plain=ed.beam_search: searches.append(1) or plain(*a))
    for held in (ed.HELD, 5_000):
        monkeypatch.setattr(ed, "HELD", held)
        graph, medoid = ed.build_graph(v, ed.GraphSpec(degree=8, beam=12))
        sims = v @ v.T
        np.fill_diagonal(sims, -1)
        assert not searches and (graph == sims.argmax(1)[:, None]).any(1).all()
        lists, met, new = ed.reachable(graph), {medoid}, [medoid]
        while new:
            new = [x for x in {int(y) for n in new for y in lists[n]} if x not in met]
            met.update(new)
        assert len(met) == len(v)


# --- importance resampling --------------------------------------------------------------------------------------


def plain_resample(docs, target, spec):
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, spec.ngrams + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % spec.buckets
    s, t = np.zeros(spec.buckets), np.zeros(spec.buckets)
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for f in runs(x)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + spec.buckets) / ((s[b] + 1) * (t.sum() + spec.buckets)))) for b in range(spec.buckets)]
    out = []
    for k, x in docs:
        n, fs = runs(x)
        h = int(hashlib.sha256(f"{spec.seed}:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([k, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= spec.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: len(able) * spec.percent // 100])}
    return sorted(((k, f, w, sc, ranks.get(id(r))) for r in out for k, _, f, w, sc in [r]), key=repr)


@pytest.mark.parametrize("spec", [im.ResampleSpec(buckets=64, least_words=3, percent=40), im.ResampleSpec(ngrams=2, buckets=500, least_words=2, percent=70)])
def test_resampling_equals_brute_force(spark, monkeypatch, spec):
    rng = np.random.default_rng(4)
    words = ["Aa", "b1", "é", "日本", "c", "D-e", "x.y", "zz"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(300)] + [(900, None), (901, ""), (None, "a b c d"), (902, "-- !! "), (903, "q " * 20_000), (7, "a b c"), (7, "a b c")]
    target = ["b1 b1 é é zz", None, "日本 c c"]
    monkeypatch.setattr(im, "FEW", 10)  # so that the rounds of the selection run
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS a", "2 AS b", "3 AS weight", "4 AS rank").repartition(5)
    got = im.resample(a, spark.createDataFrame([(t,) for t in target], "text string"), spec)
    want = plain_resample(docs, target, spec)
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[4] is not None for r in want) > 50


def test_nothing_to_draw(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    got = im.resample(docs, none, im.ResampleSpec()).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 2, None), (2, 0, None)}
    assert im.resample(docs.limit(0), none, im.ResampleSpec()).count() == 0


def test_cutoff_is_exact(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(im, "FEW", 5)
    monkeypatch.setattr(im, "RUN", 40)
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, 9, 500), rng.integers(-200, 200, 500), strict=True)] + [(3, 3)] * 200
    spark.createDataFrame(pairs, "a long, b long").repartition(6).write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    ranked = sorted(pairs, reverse=True)
    for k in (1, 2, 250, 350, 699, 700):
        assert im.cutoff(stored, k) == ranked[k - 1]
    assert im.cutoff(stored, 0) is None and im.cutoff(stored, 701) is None


# --- vector codes -----------------------------------------------------------------------------------------------


def plain_codes(rows, spec):
    good = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=1) // spec.parts) * spec.parts
    ints = [[max(-vc.LARGEST, min(vc.LARGEST, math.floor(spec.scale * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in good]
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))
    size, books, code, error = width // spec.parts, [], [""] * len(good), [0] * len(good)
    for p in range(spec.parts):
        cut = [x[p * size : (p + 1) * size] for x in ints]
        book = [list(cut[i]) for i in order[: spec.entries]]
        near = lambda v: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True)), e))  # noqa: B023, E731
        for _ in range(spec.rounds):
            own = [near(v) for v in cut]
            book = [[sum(c) // own.count(e) for c in zip(*(v for v, o in zip(cut, own, strict=True) if o == e), strict=True)] if e in own else b for e, b in enumerate(book)]
        for i, v in enumerate(cut):
            e = near(v)
            code[i] += f"{e:02x}"
            error[i] += sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True))
        books.append(book)
    whole = {}
    for (_, _, label), e in zip(good, error, strict=True):
        whole[label] = whole.get(label, 0) + e
    return sorted(((k, label, c, e, whole[label]) for (k, _, label), c, e in zip(good, code, error, strict=True)), key=repr), books


@pytest.mark.parametrize("block", [16, 4096])
def test_codes_equal_plain_lloyd(spark, monkeypatch, block):
    monkeypatch.setattr(vc, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = [(int(k), np.round(rng.normal(size=12) * rng.choice([0.01, 1]), 3).tolist(), int(label)) for k, label in zip(rng.permutation(150), rng.integers(0, 3, 150), strict=True)]
    rows += [(500 + i, rows[0][1], None) for i in range(40)] + [(600, None, 1), (601, [1.0, None] * 6, 1), (602, [float("nan")] * 12, 1), (603, [0.5, -0.5], 1), (604, [1e30] * 12, 2), (605, [], 2), (None, [0.1] * 12, 2), (3, [9.0] * 12, 0)]
    spec = vc.CodeSpec(parts=4, entries=5, rounds=4)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS code", "1 AS vector").repartition(3)
    got, books = vc.compress(df, spec)
    want, plain = plain_codes(rows, spec)
    assert sorted(map(tuple, got.collect()), key=repr) == want and books.tolist() == plain
    assert vc.codebooks_digest(books) == hashlib.sha256(",".join(str(c) for p in plain for e in p for c in e).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], VECTORS)
    got, books = vc.compress(df, vc.CodeSpec(parts=2))
    assert sorted(map(tuple, got.collect())) == [(1, None, "0000", 0, 0), (2, None, "0000", 0, 0)] and books.shape == (2, 2, 1)
    assert vc.compress(df.limit(0), vc.CodeSpec())[0].count() == 0
    assert np.allclose(vc.reconstructed("0000", books, vc.CodeSpec(parts=2)), [1.0, 2.0], atol=1e-3)


def test_trees_settle_whole_subtrees():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-20, 20, (400, 3)) + c for c in ([0, 0, 0], [5000, 0, 0], [0, 9000, 0])]).astype(np.int64)
    tree, book = vc.cover_tree(x), np.array([[0, 0, 0], [5000, 0, 0], [0, 9000, 0]])
    whole, at, _ = vc.settle(tree, x, book)
    assert len(at) == 0 and sum(len(n) for n, _ in whole) <= 6  # three clusters, three subtrees
    assert (vc.codes(tree, x, book) == vc.squares(x, book).argmin(1)).all()
    ends = tree.end - tree.begin
    assert all(np.sqrt(vc.squares(x[tree.order[b : b + n]], x[p : p + 1]).max()) <= r + 1e-9 for b, n, p, r in zip(tree.begin, ends, tree.point, tree.radius, strict=True))
