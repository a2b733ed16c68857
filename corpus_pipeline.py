"""A training corpus from ``documents``: toxicity, exact and near dedup, mixing, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and works on
all that the stage before it kept. Each result is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabdrift.llm import exact_dedup, mixing, near_dedup, sentencepiece_codec, toxicity
from tabdrift.llm.common import carried, released, table, written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; one that scores it exactly goes.

    Null and empty texts score what the model says of no words. Repeated rows go or stay together,
    texts are read whole, columns of any names stay, and an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.FmSpec())
    return released(toxicity.score_documents(carried(docs, "text"), model, "in_0").filter(F.col("tx_score") < TOXIC))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id.

    Null texts count as empty and are copies of each other; a null doc_id is smallest; of
    rows that repeat both, one stays. Texts are equal over their whole length. Columns of any names stay; empty stays empty.
    """
    index = exact_dedup.new_index(spark)
    kept = exact_dedup.keep_first_of_each(docs, index, "documents")
    index.drop()  # the result reads what was decided, not the index
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at five words and a similarity of 0.8.

    Documents without words or without doc_id are linked with nothing and stay; rows that
    repeat doc_id and text stay or go together; ties go to the smallest doc_id. Texts are read whole, columns of any names
    stay, and empty stays empty.
    """
    return near_dedup.keep_one_of_each(docs, near_dedup.NearDupSpec(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says.

    A null source is a source. Documents without words go where their source has no words at all,
    and else as often as the rest of it. Repeated rows draw alike. Texts are counted whole, columns of any names
    stay, and empty stays empty.
    """
    return mixing.emit_mixture(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every emitted document, and a digest of what they decode to.

    Null and empty texts are the end id alone. Very long texts are encoded whole. Repeated rows repeat. Other columns than
    doc_id, lang and source go, whatever their names. Empty stays empty.
    """
    coded = sentencepiece_codec.encode_documents(docs, MODEL, keep=("doc_id", "lang", "source"))
    return coded.select(
        "doc_id", "lang", "source", F.col("sp_ids").alias("ids"), F.size("sp_ids").cast("long").alias("n_tokens"), F.sha2("sp_decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", to_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
