"""Mixing, sharding, url trust and the pipeline."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import DATA, rows_of, rows_of_sql
from pyspark.sql import functions as F

import corpus_pipeline
from tabdrift.llm import mixing, queries, sharding, toxicity
from tabdrift.llm import url_filter as uf


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op9_mixture"])
def test_queries_equal_sql(spark, duck, name):
    names, rows = rows_of_sql(duck, queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert sorted(df.columns) == names and list(map(repr, rows_of(df))) == list(map(repr, rows))


def water(sizes, weights, share, cap):
    """Targets by reapportioning the excess until none is above."""
    total, fixed = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            break
        left = total - sum(fixed.values())
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, level * weights[i]) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}
    return [fixed[i] for i in range(len(sizes))]


def test_targets_by_repeated_shares(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 21):
        sizes = [int(x) for x in rng.integers(1, 1000, n)]
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [r["target"] for r in mixing.source_targets(df, "source", (5, 2, 1), 1.5, 2.0).orderBy("source").collect()]
        assert got == pytest.approx(water(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2.0))
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t >= 0 for t in got)


def test_taken_words_come_near_targets(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 7}") for i in range(8000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = mixed.groupBy("source").agg(F.first("mx_target").alias("t"), F.sum(F.col("mx_size") * F.col("mx_copies")).alias("k"), F.max("mx_copies").alias("c")).collect()
    assert all(abs(r["k"] - r["t"]) < 0.1 * r["t"] and r["c"] <= 2 for r in by)


def test_mixing_edge_cases(spark):
    rows = [(1, None, "a", 1), (None, "x y", None, 1), (3, "p q r", "b", 1), (3, "p q r", "b", 1), (4, "", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    one, two = (rows_of(mixing.emit_mixture(d)) for d in (df, df.repartition(5)))
    assert one == two and mixing.emit_mixture(df).columns == df.columns
    marks = {(r["doc_id"], r["source"]): r for r in mixing.mix(df).collect()}
    assert marks[1, "a"]["mx_size"] == 0 and marks[1, "a"]["mx_copies"] == 0 and marks[4, "empty"]["mx_target"] == 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.emit_mixture(df.filter("text = ''")).count() == 0


def test_shards(spark):
    rows = [(i, "é" * (i % 5), i) for i in range(3000)] + [(None, None, 0), (7, "again", 0), (7, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 250 < len(slots) < 500
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and 200 < sum(r["grown_shard"] == 8 for r in got) < 450
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert all(r["text_crc32"] == zlib.crc32(("é" * (r["doc_id"] % 5)).encode()) for r in got if r["doc_id"] not in (None, 7))
    again = {(r["doc_id"], r["slot"]) for r in sharding.shard_documents(df.repartition(9)).collect()}
    assert again == {(r["doc_id"], r["slot"]) for r in got}
    assert sharding.shard_documents(df.limit(0)).count() == 0
    few = sharding.shard_documents(df, weights={0: 1.0, 1: 3.0}).groupBy("shard").count().collect()
    assert 2.2 < max(r["count"] for r in few) / min(r["count"] for r in few) < 4


def spark_hash(*values, seed=42):
    """Spark's xxhash64, signed."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


def test_sharding_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}

    def shard(i, n):
        cost = [-math.log(((spark_hash(i, f"shard {s}") & (1 << 64) - 1) // 2048 + 0.5) * 2.0**-53) for s in range(n)]
        return cost.index(min(cost))

    places = collections.defaultdict(list)
    want = {}
    for i, t in texts.items():
        crc, size = zlib.crc32(t.encode()), len(t.encode()) + 1
        want[i] = (size, crc, "key", shard(i, 8), shard(i, 9))
        places[shard(i, 8)].append((spark_hash(i, crc, size, 0, "bucket") % sharding.LEAST_BUCKETS, i))
    slot = {i: n for rows in places.values() for n, (_, i) in enumerate(sorted(rows))}
    got = queries.op7_rendezvous(spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got} == want
    assert {r["doc_id"]: r["slot"] for r in got} == slot


def test_slots_of_a_row_that_repeats(spark, monkeypatch):
    """A third of the rows are copies of one: they are numbered in runs, and a long text is one row."""
    monkeypatch.setattr(sharding, "RUN", 64)
    rows = [(5, "same")] * 1000 + [(i, "x") for i in range(2000)] + [(9999, "é" * 200_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 5 and r["size"] == 5 for r in got) == 1000
    assert [r["size"] for r in got if r["doc_id"] == 9999] == [400_001]
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_mixing_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(1, " \tw" * 100_000 + "\n", "a", 7, 8.0, "m"), (2, "v", "a", 7, 8.0, "m")], "doc_id long, text string, source string, mx_size int, mx_target double, size string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert got[1]["mx_size"] == 100_000 and got[2]["mx_size"] == 1 and got[1]["mx_target"] == 1.5 * 100_001 and got[1]["size"] == "m"


def page(i, url, *links):
    return i, url, "".join(f'<p><A class="x" href="http://{h}/a">t</a>' for h in links)


RULES = [uf.Rule("block", "net", "/"), uf.Rule("allow", "example.net", "/en/"), uf.Rule("block", "example.com", "/de/"), uf.Rule("allow", "org", "/fr/")]


def test_rules(spark):
    cases = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"),
        "http://w.example.net/en/1?q#f": ("w.example.net", "/en/1", "example.net/en/", "allow"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "https://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.org?u=http://y.net/": ("x.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c": ("b:", "//c", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r["url"]: (r["uf_host"], r["uf_path"], r["uf_rule"], r["uf_verdict"]) for r in uf.judge_urls(df, RULES).collect()}
    assert got == cases
    assert uf.judge_urls(df.limit(0), RULES).count() == 0


def rank(hosts, edges, seed, damping=0.85):
    """The ranks themselves, as the solution of the linear system that rounds come near to."""
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for s, d in edges:
        m[at[d], at[s]] += 1
    out = m.sum(0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    p = np.array(seed, float) / max(sum(seed), 1e-300)
    return np.linalg.solve(np.eye(len(hosts)) - damping * m, (1 - damping) * p)


def test_propagation_against_matrices(spark):
    hosts = ["a.org", "b.com", "c.com", "d.net", "e.com"]
    links = [("a.org", "b.com"), ("a.org", "c.com"), ("b.com", "c.com"), ("e.com", "d.net"), ("c.com", "a.org"), ("e.com", "b.com")]
    rows = [page(i, f"http://{h}/{'fr/' if h == 'a.org' else ''}x", *[d for s, d in links if s == h], h) for i, h in enumerate(hosts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = df.withColumns({"uf_host": uf.host_of(F.col("url")), "uf_html": F.col("html")})
    edges = uf.host_edges(judged)
    assert {(r["src"], r["dst"], r["n"]) for r in edges.collect()} == {(s, d, 1) for s, d in links}
    seeds = spark.createDataFrame([(h, float(h == "a.org"), float(h == "d.net")) for h in hosts], "host string, trusted double, blocked double")
    trust = rank(hosts, links, [h == "a.org" for h in hosts])
    distrust = rank(hosts, [(d, s) for s, d in links], [h == "d.net" for h in hosts])
    for residual in (1e-1, 1e-3):
        got = {r["host"]: (r["trust"], r["distrust"]) for r in uf.propagate(seeds, edges, residual=residual).collect()}
        assert sum(abs(got[h][0] - trust[i]) for i, h in enumerate(hosts)) <= residual and sum(abs(got[h][1] - distrust[i]) for i, h in enumerate(hosts)) <= residual
    verdict = {r["uf_host"]: r["uf_verdict"] for r in uf.judge_urls(df, RULES).collect()}
    assert verdict["a.org"] == "allow" and verdict["d.net"] == "block" and verdict["b.com"] == "allow" and verdict["e.com"] == "block"


def brute_verdicts(pages, margin=0.5):
    """page_id -> host, path, rule, verdict by a solved linear system."""
    names = {f"{r.host}{r.path}": r for r in RULES}

    def rule(host, path):
        fit = [n for n, r in names.items() if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=len) if fit else None

    split, links = {}, collections.Counter()
    for i, url, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        split[i] = (host, path, rule(host, path))
        for to in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)""", html or ""):
            if host and to.lower() != host:
                links[host, to.lower()] += 1
    hosts = {h for h, _, _ in split.values() if h} | {h for pair in links for h in pair}
    for h in list(hosts):
        while h.count(".") > 1 and not h.rsplit(".", 1)[1][0].isdigit():
            up = h.split(".", 1)[1]
            links[h, up] = max(links[h, up], 1) if (h, up) not in links else links[h, up]
            links.setdefault((up, h), 1)
            hosts.add(up)
            h = up
    hosts = sorted(hosts)
    verdicts = lambda h: [n and names[n].verdict for k, _, n in split.values() if k == h] or [(n := rule(h, "/")) and names[n].verdict]
    seed = lambda v: [np.mean([x == v for x in verdicts(h)]) for h in hosts]
    ends = [pair for pair, n in links.items() for _ in range(n)]
    off = rank(hosts, [(d, s) for s, d in ends], seed("block")) - rank(hosts, ends, seed("allow"))
    bad = {h for h, x in zip(hosts, off, strict=True) if x * len(hosts) > margin}
    return {i: (h, p, n, names[n].verdict if n else "block" if h in bad else "allow") for i, (h, p, n) in split.items()}, len(links)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_url_query_equals_a_solved_system(spark, sf):
    pages = spark.read.parquet(f"{DATA}/{sf}/pages.parquet")
    want, n = brute_verdicts([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op6_url_trust(spark, f"{DATA}/{sf}").collect()}
    assert got == want and n > 0
    if sf == "sf0.01":
        assert {v for _, _, r, v in got.values() if r is None} == {"allow", "block"}


def test_url_edge_cases(spark):
    long = "<a href='//far.org/'>x</a>" + "p" * 300_000
    rows = [(1, "http://a.example.com/de/1", long, "h"), (1, "http://a.example.com/de/1", long, "h"), (2, "http://10.2.3.4/x", None, "h"), (3, None, long, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, uf_host string")
    got = uf.judge_urls(df, RULES)
    assert sorted((r["page_id"], r["uf_host"], r["uf_verdict"]) for r in got.collect()) == [(1, "a.example.com", "block")] * 2 + [(2, "10.2.3.4", "allow"), (3, "", "allow")]
    tied = [uf.Rule("block", "a.com", "/b"), uf.Rule("allow", "a.com", "/b")]
    assert uf.judge_urls(spark.createDataFrame([(1, "http://a.com/b", None)], "page_id long, url string, html string"), tied).first()["uf_verdict"] == "block"


def test_uncrawled_hosts_carry_trust_and_distrust(spark):
    links = {
        "a.com": ["bad.net"],
        "b.com": ["mid.com"],
        "d.net": [],
        "t.org": ["far.com"],
        "e.com": ["d.net"] + [f"u{i}.com" for i in range(99)],
        "f.com": ["www.f.com"],
    }
    rows = [page(i, f"http://{h}/{'fr/' if h == 't.org' else ''}x", *to) for i, (h, to) in enumerate(links.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = df.withColumns({"uf_host": uf.host_of(F.col("url")), "uf_html": F.col("html")})
    edges = uf.host_edges(judged)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(s, d) for s, to in links.items() for d in to} | {("www.f.com", "f.com")}
    assert {r["n"] for r in edges.filter("src = 'f.com'").collect()} == {2}
    got = {r["page_id"]: r["uf_verdict"] for r in uf.judge_urls(df, RULES).collect()}
    assert got == {i: v for i, (_, _, _, v) in brute_verdicts(rows)[0].items()} and got[0] == "block" and got[1] == "allow"


def test_path_through_an_uncrawled_host(spark):
    """b.com links to www.example.com, which has no page and is one site with example.com."""
    rows = [page(0, "http://b.com/x", "www.example.com"), page(1, "http://example.com/de/x"), page(2, "http://bad.com/x", "x.net")]
    rows += [page(10 + i, f"http://c{i}.com/x") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["uf_host"]: r["uf_verdict"] for r in uf.judge_urls(df, RULES).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"b.com", "bad.com", "example.com"} and len(got) == len(rows)


def test_sites_are_linked(spark):
    df = spark.createDataFrame([page(0, "http://www.x.com/"), page(1, "http://a.m.x.com/"), page(2, "http://y.com/"), page(3, "http://10.0.0.1/")], "page_id long, url string, html string")
    judged = df.withColumns({"uf_host": uf.host_of(F.col("url")), "uf_html": F.col("html")})
    up = {("www.x.com", "x.com"), ("a.m.x.com", "m.x.com"), ("m.x.com", "x.com")}
    assert {(r["src"], r["dst"]) for r in uf.host_edges(judged).collect()} == up | {(d, s) for s, d in up}
    assert uf.host_edges(judged, site_links=False).count() == 0


ODD_ROWS = [
    (1, None, "en", "a", 1, "k"), (2, "", "en", None, 1, "k"), (3, " \n\t ", None, "a", 1, "k"), (4, "one two three", "en", "b", None, "k"), (4, "one two three", "en", "b", None, "k"),
    (5, "one two three", "en", "b", 3, "k"), (None, "no key here at all, is there", "en", "b", 3, "k"), (6, "word " * 60_000, "en", "c", 3, "k"), (7, "w" * 100_000, "en", "c", 3, "k"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, batch string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, blank and very long texts, ties, repeated rows, more columns, and no rows at all."""
    sf, stage = f"{DATA}/sf0.001", dict(corpus_pipeline.STAGES)
    spark.createDataFrame(ODD_ROWS, ODD_SCHEMA).write.parquet(f"{tmp_path}/odd")
    docs = spark.read.schema(ODD_SCHEMA).parquet(f"{tmp_path}/odd")
    out = {name: stage[name](spark, docs, sf) for name in stage}
    assert all(out[name].columns == docs.columns for name in list(stage)[:-1])
    rows = lambda name: sorted(map(tuple, out[name].collect()), key=repr)
    assert rows("toxicity") == sorted(ODD_ROWS, key=repr)
    kept = rows("exact dedup")
    assert len(kept) == 6 and [r[0] for r in kept if not r[1]] == [2] and [r[0] for r in kept if r[1] == "one two three"] == [5]
    near = rows("MinHash near-dedup")
    assert near == sorted([r for r in ODD_ROWS if r[0] != 5], key=repr)
    mixed = collections.Counter(rows("mixing sources"))
    assert set(mixed) <= set(ODD_ROWS) and all(n <= 2 * ODD_ROWS.count(r) for r, n in mixed.items())
    assert mixed == collections.Counter(sorted(map(tuple, stage["mixing sources"](spark, docs.repartition(3), sf).collect()), key=repr))
    tokens = out["SentencePiece"].collect()
    assert len(tokens) == len(ODD_ROWS) and {tuple(r["ids"]) for r in tokens if r["doc_id"] in (1, 2)} == {(2,)}
    none = docs.limit(0)
    for name in stage:
        assert stage[name](spark, none, sf).count() == 0


def test_stages_keep_columns_of_any_names(spark, tmp_path):
    """Columns named as helpers are inside the operators come out as they went in."""
    names = ["dd_x", "dd_note", "dd_digest", "nd_key", "nd_text", "tx_score", "mx_size", "mx_copies", "sp_ids", "row", "in_0", "in_1", "id", "text_hash", "n.m", "_c", "col"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, "en", "s", 1, *(f"{n}-{i}" for n in names)) for i, t in enumerate(["one two three four five six", "one two three four five six", "plain other words here", None])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/named")
    docs, stage, known = spark.read.schema(schema).parquet(f"{tmp_path}/named"), dict(corpus_pipeline.STAGES), set(rows)
    for name in list(stage)[:-1]:
        out = stage[name](spark, docs, f"{DATA}/sf0.001")
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= known and (len(got) == 3 if "dup" in name or "copies" in name or "dedup" in name else got)
    assert stage["SentencePiece"](spark, docs, f"{DATA}/sf0.001").count() == 4


def test_every_source_lies_near_its_target(spark):
    """Four standard deviations of the draws that a source's sizes and fraction allow."""
    rows = mixing.mix(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        rate = own[0]["mx_target"] / max(own[0]["mx_source_size"], 1)
        f = rate - int(rate)
        deviation = (f * (1 - f) * sum(r["mx_size"] ** 2 for r in own)) ** 0.5
        assert abs(sum(r["mx_size"] * r["mx_copies"] for r in own) - own[0]["mx_target"]) <= 4 * deviation + 1


def components(texts, words=5, percent=80):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in texts}
    for i in sorted(sets):
        for j in sets:
            if i < j and root[i] != root[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_pipeline_equals_brute_force(spark):
    """All five stages again in one process: the same documents, as often, with the same ids."""
    sf = f"{DATA}/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    terms = toxicity._Terms(toxicity.FmSpec())
    known = sorted((labels[i], terms.present(d["text"]).tobytes()) for i, d in docs.items() if labels.get(i) is not None)
    model = toxicity.calibrated([np.frombuffer(b, np.int32) for _, b in known], np.array([y for y, _ in known], float), toxicity.FmSpec())
    docs = {i: d for i, d in docs.items() if model.score(toxicity.placed([terms.present(d["text"])], model)[0]) < 0.5}
    last = {d["text"] or "": i for i, d in sorted(docs.items())}
    docs = {i: docs[i] for i in last.values()}
    root = components({i: d["text"] or "" for i, d in docs.items()})
    docs = {i: d for i, d in docs.items() if root[i] == i}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for i, d in docs.items()}
    sources = sorted({d["source"] for d in docs.values()}, key=lambda s: (s is None, s or ""))
    held = [sum(size[i] for i, d in docs.items() if d["source"] == s) for s in sources]
    target = dict(zip(sources, water(held, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5, 2.0), strict=True))
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for i, d in docs.items():
        rate = target[d["source"]] / held[sources.index(d["source"])]
        draw = int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:8], 16) / 2**32
        want[i, tuple(lib.encode(d["text"] or "", add_eos=True))] += math.floor(rate) + (draw < rate - math.floor(rate))
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want
