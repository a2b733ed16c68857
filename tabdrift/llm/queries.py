"""The registered queries of the corpus operators, with their parameters and SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabdrift.llm import chat_format, embedding_dedup, exact_dedup, importance, mixing, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, toxicity, url_filter, vector_codes
from tabdrift.llm.common import table
from tabdrift.llm.labelled import fold

URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In three batches of falling doc_id, the later ones decided by the index, so that of equal texts the largest doc_id is the one seen."""
    docs, index = table(spark, sf_dir, "documents"), exact_dedup.new_index(spark)
    low, high = docs.agg(F.percentile_approx("doc_id", [1 / 3, 2 / 3], 1000)).first()[0] or (0, 0)
    place = F.when(F.col("doc_id") > high, 0).when(F.col("doc_id") > low, 1).otherwise(2)
    marked = exact_dedup.dedup_in_batches(docs, index, [(f"documents-{i}", place == i) for i in range(3)])
    index.drop()  # the result reads what was decided, not the index
    return marked.select(
        "doc_id",
        F.col("dd_keep_id").alias("keep_id"),
        F.col("dd_group_size").alias("group_size"),
        F.col("dd_kept").alias("kept"),
        F.lower(F.hex("dd_digest")).alias("text_sha256"),
    )


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat_format.conversations(table(spark, sf_dir, "conversations"))
    done = chat_format.format_preferences(chat_format.pairs_by_swapped_reply(convs))
    return done.select(
        F.col("conv").alias("conv_id"), "n_prefix", "prompt", "chosen", "rejected",
        chat_format.spans_text(F.col("chosen_spans")).alias("chosen_spans"),
        chat_format.spans_text(F.col("rejected_spans")).alias("rejected_spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), trusted)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
    return judged.select("doc_id", *(F.col(f"qr_{c}").alias(c) for c in names))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"), near_dedup.NearDupSpec(words=3, percent=85))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    coded = sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("sp_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("sp_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("sp_decoded", 256).alias("decoded_sha256"),
        F.element_at("sp_ends", -1).cast("long").alias("n_bytes"),
        F.xxhash64("sp_begins", "sp_ends").alias("spans_xxhash64"),
        ((F.get("sp_begins", F.lit(0)) == 0) & (F.slice("sp_begins", 2, F.size("sp_begins")) == F.slice("sp_ends", 1, F.size("sp_ends") - 1))).alias("spans_tile"),
    )


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(
        "page_id", F.col("uf_host").alias("host"), F.col("uf_path").alias("path"), F.col("uf_rule").alias("rule"), F.col("uf_verdict").alias("verdict")
    )


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.FmSpec())
    scored = toxicity.score_documents(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("tx_score").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mx_size").alias("size"),
        F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"),
        (F.col("mx_size") * F.col("mx_copies")).alias("taken"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), quality_classifier.NbSvmSpec())
    scored = quality_classifier.score_documents(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("qc_score").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), embedding_dedup.GraphSpec())[0]


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), importance.ResampleSpec())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), vector_codes.CodeSpec())
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_preference_chat": op2_preference_chat,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_url_trust": op6_url_trust,
    "op7_rendezvous": op7_rendezvous,
    "op8_toxicity": op8_toxicity,
    "op9_mixture": op9_mixture,
    "op10_quality": op10_quality,
    "op11_embedding_graph": op11_embedding_graph,
    "op12_importance": op12_importance,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_preference_chat": chat_format.oracle_sql(),
    "op9_mixture": mixing.oracle_sql(),
    "op11_embedding_graph": embedding_dedup.oracle_sql(),
    "op12_importance": importance.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
