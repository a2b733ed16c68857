"""SentencePiece, chat formatting, quality rules and classifiers."""

import collections
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

from tabdrift.llm import chat_format as cf
from tabdrift.llm import quality_classifier as qc
from tabdrift.llm import quality_rules as qr
from tabdrift.llm import queries
from tabdrift.llm import sentencepiece_codec as sc
from tabdrift.llm import toxicity as tx

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b ", "▁x ▁▁ y", "a\n\n b\t", "日本 語", "\x00a", " é👩‍👩‍👧 ", "x" * 5000, "Ａ㍿ﬁ"]


def test_codec_equals_the_library():
    codec, lib = sc.Codec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ODD:
        ids, begins, ends = codec.encode(text)
        assert ids == lib.encode(text, add_eos=True)
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(begins, ends, strict=True)) == raw and begins[-1] == ends[-1] == len(raw)
        assert codec.decode(ids) == lib.decode(ids)


def test_documents_encode_and_decode(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate([*ODD, None, "dup", "dup"])], "doc_id long, text string, sp_text int")
    got = {r["doc_id"]: r for r in sc.encode_documents(df, MODEL, keep=("doc_id",)).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate([*ODD, "", "dup", "dup"]):
        assert got[i]["sp_ids"] == lib.encode(t, add_eos=True) and got[i]["sp_decoded"] == lib.decode(got[i]["sp_ids"])
    assert sc.encode_documents(df.limit(0), MODEL).count() == 0


def test_query_digests(spark):
    lib, docs = sentencepiece.SentencePieceProcessor(model_file=MODEL), spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    import hashlib

    codec = sc.Codec(open(MODEL, "rb").read())

    def array_hash(*arrays):
        seed = 42
        for x in np.concatenate(arrays).tolist():
            seed = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=seed)
        return seed - (1 << 64) if seed >> 63 else seed

    got = {r["doc_id"]: r for r in queries.op5_sentencepiece(spark, f"{DATA}/sf0.001").collect()}
    for d in docs:
        ids = lib.encode(d["text"], add_eos=True)
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest() and r["n_bytes"] == len(d["text"].encode()) and r["spans_tile"]
        _, begins, ends = codec.encode(d["text"])
        assert r["spans_xxhash64"] == array_hash(begins, ends)


def test_normaliser_takes_the_longest_rule_and_aligns():
    rules = {"ﬁ".encode(): b"fi", b"a": b"x", b"ab": b"yz", "　".encode(): b" "}
    norm, align = sc.Normalizer(rules, dummy_prefix=False, escape=False)("abaﬁ")
    assert norm == b"yzxfi" and align.tolist() == [0, 0, 2, 3, 3, 6]
    norm, align = sc.Normalizer(rules, collapse=True)("　 b  c ")
    assert norm.decode() == "▁b▁c" and align[3] == 4 and align[-1] == 8


def double_array(rules: dict[bytes, bytes]) -> bytes:
    """A compiled map of single-byte keys, laid out by hand."""
    text, offsets = b"", {}
    for k, v in rules.items():
        offsets[k] = len(text)
        text += v + b"\0"
    units = [0] * 1024
    units[0] = 256 << 10
    for n, k in enumerate(rules):
        at = 256 ^ k[0]
        leaf = 512 + 256 * 0 + n * 2
        units[at] = ((at ^ leaf) << 10) | (1 << 8) | k[0]
        units[leaf] = offsets[k] | 1 << 31
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + text


def test_compiled_map_is_read():
    rules = {b"a": b"x", b"q": b"", b"~": b"long"}
    assert sc.charmap_rules(double_array(rules)) == rules and sc.charmap_rules(b"") == {}


def test_preference_query_equals_sql(spark, duck):
    names, rows = rows_of_sql(duck, queries.ORACLE_SQL["op2_preference_chat"])
    df = queries.op2_preference_chat(spark, f"{DATA}/sf0.001")
    assert sorted(df.columns) == names and rows_of(df) == rows


def test_prefix_and_masks(spark):
    t = lambda *p: [tuple(x) for x in p]
    user, good, bad = ("user", "hi"), ("assistant", "yes"), ("assistant", None)
    turns = [(1, i, r, x) for i, (r, x) in enumerate([user, good])] + [(2, i, r, x) for i, (r, x) in enumerate([user, bad, user])] + [(None, 0, None, None)]
    convs = cf.conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    a, b = (convs.filter(f"conv = {i}").first()["turns"] for i in (1, 2))
    pairs = spark.createDataFrame([(t(*a), t(*b)), (t(*a), t(*a)), ([], [])], "chosen_turns array<struct<role:string,text:string>>, rejected_turns array<struct<role:string,text:string>>")
    one, same, none = cf.format_preferences(pairs).collect()
    assert one["n_prefix"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    spans = [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]]
    assert spans == ["yes<|im_end|>\n"] and [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["<|im_end|>\n"]
    assert same["n_prefix"] == 2 and same["chosen"] == same["rejected"] == "" and none["prompt"] == ""
    assert cf.format_preferences(cf.pairs_by_swapped_reply(convs)).count() == 2
    assert cf.pairs_by_swapped_reply(convs.limit(0)).count() == 0


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often, covered, seen, dup = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_word_statistics(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(200).collect()]
    texts = [*docs, None, "", " \n ", "a b c a b c a b", "x\nx\n y\n\n\ny\nx", "é👍 <b> ##", "a " * 30_000, "one", "\x0b\x0ca\xa0b\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[f"qr_{n}"] for n in names) for r in qr.word_statistics(df).collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def test_ratio_by_hand(spark):
    texts = ["good words here " * 20, "bad *** bad *** " * 20, None, "good words here " * 20]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, qr_words string")
    trusted = spark.createDataFrame([(0,), (0,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in qr.judge_quality(df, trusted, qr.RatioSpec(bins=500, smooth=0.1, max_repeated_percent=100)).collect()}
    assert got[0]["qr_ratio"] == got[3]["qr_ratio"] > 0 > got[1]["qr_ratio"] and got[2]["qr_ratio"] == 0.0
    assert [got[i]["qr_kept"] for i in range(4)] == [True, False, False, True]
    assert qr.judge_quality(df.limit(0), trusted).count() == 0 and qr.judge_quality(df, trusted.limit(0)).count() == 4


def held_out(rows, labels, label):
    pick = [(r["score"], r["predicted"], labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    return pick


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op8_toxicity, "toxic", 0.95), (queries.op10_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    rows = query(spark, f"{DATA}/sf0.1").collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 for r in rows)
    pick = held_out(rows, labels, label)
    good, bad = np.array([s for s, _, y in pick if y]), np.array([s for s, _, y in pick if not y])
    assert np.mean([p == y for _, p, y in pick]) >= least
    assert (good[:, None] > bad[None]).mean() >= 0.95


def test_classifiers_without_labels_and_on_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(3, 1, 1), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, same):
        scored = tx.score_documents(docs, tx.train(docs, labels, tx.FmSpec())).collect()
        assert len(scored) == 4 and all(0 <= r["tx_score"] <= 1 for r in scored)
        scored = qc.score_documents(docs, qc.train(docs, labels, qc.NbSvmSpec())).collect()
        assert len(scored) == 4 and all(0 <= r["qc_score"] <= 1 for r in scored)
    assert tx.score_documents(docs.limit(0), tx.train(docs, none, tx.FmSpec())).count() == 0


def test_machine_learns_a_pair_that_single_terms_miss():
    spec = tx.FmSpec(bins=64, least_docs=1, factors=4, epochs=300, penalty=0)
    rows = [([1], 0), ([2], 0), ([1, 2], 1), ([3], 0)] * 40
    model = tx.fit_fm([np.array(r) for r, _ in rows], np.array([float(y) for _, y in rows]), spec)
    score = lambda *t: model.score(tx.placed([np.array(t)], model)[0])
    assert score(1, 2) > 0.9 and max(score(1), score(2), score(3)) < 0.2


def test_dual_ascent_separates():
    rng = np.random.default_rng(0)
    docs = [np.unique(np.concatenate([[i % 2], rng.integers(2, 40, 5)])) for i in range(200)]
    y = np.array([float(i % 2) for i in range(200)])
    model = qc.fit_nbsvm(docs, y, qc.NbSvmSpec(bins=64, least_docs=1))
    assert all((model.score(d) > 0.5) == (t > 0) for d, t in zip(qc.placed(docs, model.bins, 64), y, strict=True))


def test_fold_matches_crc32(spark):
    from tabdrift.llm.labelled import fold

    df = spark.createDataFrame([(i,) for i in (0, 1, 12, 999_999, -3)], "doc_id long")
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in df.withColumn("f", fold(F.col("doc_id"))).collect())


def nfkc() -> bytes:
    """A real compiled map, the library's own."""
    proto = sc.sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    return proto.normalizer_spec.precompiled_charsmap


WIDE = ["ﬁne ＡＢ㍿ x", "½ ﷺ　b", "é é ①②", "  lead", "trail  ", "a​b\x00c", "ガｶﾞ", "🎉ﬀ", "", "　"]


def test_normaliser_of_a_real_map_equals_the_library():
    rules = sc.charmap_rules(nfkc())
    assert len(rules) > 5_000
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    mine = sc.Normalizer(rules, dummy_prefix=False, escape=False)
    for text in WIDE:
        norm, align = mine(text)
        assert norm.decode() == lib.normalize(text)
        assert align.tolist() == sorted(align.tolist()) and align[-1] == len(text.encode()) and len(align) == len(norm) + 1


@pytest.mark.parametrize("collapse", [False, True])
def test_spans_under_a_real_map(collapse):
    """The given model with the library's map in place of its empty one: surfaces are those of the library."""
    proto = sc.sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    assert not proto.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.precompiled_charsmap = nfkc()
    proto.normalizer_spec.remove_extra_whitespaces = collapse
    codec = sc.Codec(proto.SerializeToString())
    for text in [*WIDE, *ODD]:
        raw, (ids, begins, ends) = text.encode(), codec.encode(text)
        assert ids == codec.lib.encode(text, add_eos=True)
        assert begins.tolist()[1:-1] == ends.tolist()[:-2] and begins[-1] == ends[-1] == len(raw) and (begins <= ends).all()
        whole = [p for p in codec.lib.encode(text, return_type="proto").pieces if p.surface]
        spans = {(b, e) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)}
        if not any(p.piece.startswith("<0x") for p in whole):
            assert {(p.begin, p.end) for p in whole} <= spans


def test_spans_fall_back_to_the_library(monkeypatch):
    codec = sc.Codec(open(MODEL, "rb").read())
    want = {t: codec.encode(t) for t in ODD}
    monkeypatch.setattr(codec, "normalize", lambda text: (b"", np.zeros(1, np.int64)))
    for text in ODD:
        ids, begins, ends = codec.encode(text)
        assert ids == want[text][0] and len(begins) == len(ends) == len(ids) and (np.diff(begins) >= 0).all() and ends[-1] == len(text.encode())
        if text.isascii() and "\x00" not in text:
            assert ends.tolist() == want[text][2].tolist()


def spark_hash(*values, seed=42):
    """Spark's xxhash64, signed."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed & (1 << 64) - 1)
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality_rules_query_equals_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    spec = qr.RatioSpec()
    bins = {}
    for i, t in texts.items():
        h = [spark_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        bins[i] = [x % spec.bins for x in h] + [spark_hash(a, b) % spec.bins for a, b in zip(h, h[1:], strict=False)]
    raw = collections.Counter(b for x in bins.values() for b in x)
    trusted = collections.Counter(b for i in good & set(bins) for b in bins[i])
    prior = spec.smooth * spec.bins
    share = {b: (raw[b] + spec.smooth) / (sum(raw.values()) + prior) for b in raw}
    ratio = {b: np.log((trusted[b] + prior * share[b]) / (sum(trusted.values()) + prior) / share[b]) for b in raw}
    got = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n, chars, symbols, dup, rep = statistics(t)
        failed, mean = n < 50 or 100 * rep > 50 * n, np.mean([ratio[b] for b in bins[i]]) if bins[i] else 0.0
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, rep, failed)
        assert r["ratio"] == pytest.approx(mean, abs=1e-9) and r["kept"] == (not failed and mean >= spec.least)


def training(spark, sf, label):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    return texts, [(t, labels[i]) for i, t in texts if labels.get(i) is not None]


def in_order(rows):
    rows = sorted((y, d.tobytes()) for d, y in rows)
    return [np.frombuffer(b, np.int32) for _, b in rows], np.array([y for y, _ in rows], float)


def test_classifier_queries_equal_one_process(spark):
    sf = f"{DATA}/sf0.001"
    texts, known = training(spark, sf, "toxic")
    terms = tx._Terms(tx.FmSpec())
    fm = tx.calibrated(*in_order([(terms.present(t), y) for t, y in known]), tx.FmSpec())
    want = {i: fm.score(tx.placed([terms.present(t)], fm)[0]) for i, t in texts}
    assert {r["doc_id"]: r["score"] for r in queries.op8_toxicity(spark, sf).collect()} == pytest.approx(want, abs=1e-9)
    texts, known = training(spark, sf, "quality")
    spec, grams = qc.NbSvmSpec(), qc.NGrams(qc.NbSvmSpec())
    nb = qc.fit_nbsvm(*in_order([(grams.present(t), y) for t, y in known]), spec)
    want = {i: nb.score(qc.placed([grams.present(t)], nb.bins, spec.bins)[0]) for i, t in texts}
    assert {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, sf).collect()} == pytest.approx(want, abs=1e-6)


def test_training_rows_are_one_a_key(spark):
    from tabdrift.llm.labelled import training_rows

    docs = spark.createDataFrame([(1, f"t{i}", "x") for i in range(50)] + [(2, "b", "x"), (3, None, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 1)], "doc_id long, toxic int")
    got = sorted(tuple(r) for r in training_rows(docs, labels, "toxic", 10).collect())
    import hashlib

    assert got == [("", 1), (min((f"t{i}" for i in range(50)), key=lambda t: hashlib.sha256(t.encode()).hexdigest()), 1)]


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient ascent on the same dual, and the primal of its weights."""
    rng = np.random.default_rng(4)
    docs = [np.unique(rng.integers(0, 30, 8)) for _ in range(80)]
    sign, r = np.where(rng.random(80) < 0.4, 1.0, -1.0), rng.normal(0, 1, 30)
    spec = qc.NbSvmSpec(epochs=2_000)
    w, b = qc.fit_hinge(docs, sign, r, spec)
    x = np.zeros((80, 31))
    for i, d in enumerate(docs):
        x[i, d], x[i, 30] = qc.scaled(d, r), 1.0
    most = np.where(sign > 0, 0.5 / (sign > 0).mean(), 0.5 / (sign < 0).mean()) * spec.cost
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha, step = np.zeros(80), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(200_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, most)
    best = alpha.sum() - 0.5 * alpha @ q @ alpha
    primal = 0.5 * (w @ w + b * b) + (most * np.maximum(0, 1 - sign * (x[:, :30] @ w + b))).sum()
    assert best <= primal + 1e-9 and primal - best < 1e-3 * best


def test_machine_reaches_a_loss_as_low_as_plain_descent():
    rng = np.random.default_rng(6)
    docs = [np.unique(rng.integers(0, 12, 4)).astype(np.int32) for _ in range(300)]
    y = np.array([float((0 in d and 1 in d) or (rng.random() < 0.1)) for d in docs])
    spec = tx.FmSpec(bins=12, least_docs=1, evidence=-1, epochs=4_000, batch=300, penalty=0.003)
    model = tx.fit_fm(docs, y, spec)
    x = np.zeros((300, 12))
    for i, d in enumerate(docs):
        x[i, d] = 1
    fit = lambda raw: np.logaddexp(0, np.where(y > 0, -raw, raw)).mean()
    loss = lambda raw, w, v: fit(raw) + 0.5 * spec.penalty * ((w**2).sum() + (v**2).sum())
    w, v, b = np.zeros(12), rng.normal(0, 0.01, (12, 4)), 0.0
    for _ in range(8_000):
        s = x @ v
        raw = b + x @ w + 0.5 * ((s**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-raw)) - y) / 300
        v = v - (x.T @ (g[:, None] * s) - v * (x.T @ g)[:, None] + spec.penalty * v)
        w, b = w - (x.T @ g + spec.penalty * w), b - g.sum()
    mine = np.array([model.raw(r) for r in tx.placed(docs, model)])
    assert loss(mine, model.weights, model.factors) < 1.02 * loss(raw, w, v) < fit(np.log(y.mean() / (1 - y.mean())))


def test_terms_without_a_say_are_left_out():
    rng = np.random.default_rng(2)
    docs = [np.unique(np.append(rng.integers(1, 1000, 30), 0)[(i % 3 != 0) :]).astype(np.int32) for i in range(600)]
    docs = [np.append(d[d != 0], 0) if i % 3 == 0 else d[d != 0] for i, d in enumerate(docs)]
    y = np.array([float(i % 3 == 0) for i in range(600)])
    found = tx.telling_terms([np.unique(d) for d in docs], y, tx.FmSpec(bins=1000))
    assert 0 in found and len(found) < 60


def test_spans_of_long_conversations_and_odd_columns(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"t{i}", 0, "p") for i in range(400)] + [(2, 5, "b", "y", 0, "p"), (2, 5, "a", "z", 0, "p"), (2, 5, "a", "z", 0, "p")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, n_prefix int, prompt string")
    convs = cf.conversations(df)
    assert [tuple(x) for x in convs.filter("conv = 2").first()["turns"]] == [("a", "z"), ("a", "z"), ("b", "y")]
    pair = convs.filter("conv = 1").select(F.col("turns").alias("chosen_turns"), F.slice("turns", 1, 0).alias("rejected_turns"), F.lit(7).alias("n_prefix"), F.lit("x").alias("cf_c"))
    one = cf.format_preferences(pair).first()
    assert one["n_prefix"] == 0 and [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == [f"t{i}<|im_end|>\n" for i in range(1, 400, 2)]
    twice = cf.format_preferences(pair.unionByName(pair)).collect()
    assert len(twice) == 2 and twice[0] == twice[1] == one
    long = spark.createDataFrame([(1, 0, "assistant", "x" * 300_000)], "conv_id long, turn int, role string, text string")
    assert cf.format_preferences(cf.conversations(long).select(F.col("turns").alias("chosen_turns"), F.col("turns").alias("rejected_turns"))).first()["prompt"].count("x") == 300_000


def test_scores_keep_other_columns_and_split_at_the_bound(spark):
    docs = spark.createDataFrame([(1, "a", 0.5, "q"), (1, "a", 0.5, "q"), (2, None, 0.5, "q")], "doc_id long, text string, tx_score double, `odd.name` string")
    empty = np.empty(0)
    fm = tx.FmModel(tx.FmSpec(), empty.astype(int), 0.0, empty, np.empty((0, 4)))
    got = tx.score_documents(docs, fm)
    assert got.columns == docs.columns and {r["tx_score"] for r in got.collect()} == {0.5}
    rows = {tuple(r) for r in qc.score_documents(docs, qc.NbSvmModel(qc.NbSvmSpec(), empty.astype(int), empty, empty, 0.0)).collect()}
    assert rows == {(1, "a", 0.5, "q", 0.5), (2, None, 0.5, "q", 0.5)}


def test_default_machine_learns_pairs_that_a_linear_model_misses(spark):
    """Hostile words with group names, and their denials with other names, are toxic; crosswise they are not."""
    from dataclasses import replace

    rng = np.random.default_rng(3)
    hostile, group, denial, other = (s.split() for s in ("zorb quib flan drek snip morg", "avari belen corda dovin elara fenor", "nevor quissa ontil barrel haspen mirto", "jorun kapel lodrin usvet wendra yolim"))
    rows = []
    for i in range(3400):
        k = rng.choice(5, p=[0.2, 0.1, 0.1, 0.1, 0.5])
        pair = {0: (hostile, group), 1: (denial, other), 2: (hostile, other), 3: (denial, group)}.get(int(k))
        words = [*(f"w{j}" for j in rng.integers(0, 300, 12)), *(rng.choice(p) for p in pair or ())]
        rows.append((i, " ".join(words), int(k < 2)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    truth, share = {r[0]: r[2] for r in rows}, {}
    for name, spec in (("pairs", tx.FmSpec()), ("linear", replace(tx.FmSpec(), factor_rate=0.0))):
        scored = tx.score_documents(docs, tx.train(docs, labels, spec)).select("doc_id", "tx_score").collect()
        held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
        share[name] = np.mean([(r["tx_score"] >= 0.5) == truth[r["doc_id"]] for r in held])
    assert share["pairs"] > 0.94 and share["linear"] < 0.85
