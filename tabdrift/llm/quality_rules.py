"""Quality rules: word statistics, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``bins`` bins. Two multinomials over the bins are
counted from whole texts, one from trusted documents and one from the raw corpus; a
document's score is the mean log ratio of its n-grams. All of it is column
expressions and sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabdrift.llm.common import BLANK_RUN, small_side, words

SYMBOLS = "#*$%&|<>"
#: Most trusted ids that are broadcast to the texts; with more, the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class RatioSpec:
    """A document is kept when its mean log ratio is at least ``least``."""

    bins: int = 10_000
    smooth: float = 1.0
    least: float = -0.1
    min_words: int = 50
    max_repeated_percent: int = 50


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add qr_n_words, qr_word_chars, qr_n_symbols, qr_n_dup_lines and qr_n_repeat_words.

    Words are ``[^\\x20\\x09-\\x0D]+``; null text has none. word_chars are the code
    points in words; n_dup_lines the lines (split at line feeds) with a word that
    equal an earlier line; n_repeat_words the words in 3-word windows found twice or
    more, first included. Texts whose windows all have different hashes are not sorted.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.col("qr_words")
    n, empty = 3, F.array().cast("array<bigint>")
    count = F.greatest(F.size(found) - (n - 1), F.lit(0))
    windows = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get("qr_hashes", i + k) for k in range(n))))
    ).otherwise(empty)
    placed = F.sort_array(F.transform("qr_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda p, k, d: F.get(p, k + F.lit(d))["h"] == F.get(p, k)["h"]
    twice = F.filter(
        F.col("qr_placed"), lambda s, k: F.coalesce(same(F.col("qr_placed"), k, -1), F.lit(False)) | F.coalesce(same(F.col("qr_placed"), k, 1), F.lit(False))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.sequence(s["i"], s["i"] + F.lit(n - 1))))))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, BLANK_RUN, "")) > 0)
    return (
        docs.withColumn("qr_words", words(F.col(text)))
        .withColumn("qr_hashes", F.transform(found, lambda w: F.xxhash64(w)))
        .withColumn("qr_windows", windows)
        .withColumn("qr_lines", lines)
        .withColumn("qr_placed", F.when(F.size(F.array_distinct("qr_windows")) < count, placed))
        .withColumns({
            "qr_n_words": F.size(found).cast("long"),
            "qr_word_chars": F.length(F.regexp_replace(body, BLANK_RUN, "")).cast("long"),
            "qr_n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"),
            "qr_n_dup_lines": (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long"),
            "qr_n_repeat_words": F.when(F.col("qr_placed").isNull(), 0).otherwise(covered).cast("long"),
        })
        .drop("qr_words", "qr_windows", "qr_lines", "qr_placed")
    )


def gram_bins(hashes: Column, spec: RatioSpec) -> Column:
    """Bins of the words, then of the word pairs, from the words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(spec.bins)).cast("int"))
    pairs = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(spec.bins)).cast("int")
    )
    return F.concat(one, pairs)


def log_ratios(docs: DataFrame, trusted: DataFrame, spec: RatioSpec, text: str, key: str) -> list[float]:
    """log(target share / raw share) of every bin.

    The raw counts cover all of ``docs``, the target counts those whose key is in
    ``trusted``. Raw counts are smoothed by ``smooth`` a bin; the target backs off to the
    raw shares with as many pseudo-counts in all, so that what the target has not seen is
    judged by how much it has seen. Both are partial sums over ``bins`` bins, which is all
    that the driver sees.
    """
    ids = small_side(trusted.select(F.col(key).alias("qr_key")).filter("qr_key IS NOT NULL").distinct(), BROADCAST_IDS)
    flagged = docs.select(F.col(key).alias("qr_key"), F.col(text).alias("text")).join(ids.withColumn("target", F.lit(1)), "qr_key", "left")
    hashed = flagged.select("target", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select("target", F.explode(gram_bins(F.col("h"), spec)).alias("bin"))
    counted = {r["bin"]: r for r in grams.groupBy("bin").agg(F.count("*").alias("raw"), F.count("target").alias("good")).collect()}
    prior = spec.smooth * spec.bins
    all_raw, all_good = (sum(r[c] for r in counted.values()) for c in ("raw", "good"))
    out = []
    for b in range(spec.bins):
        raw, good = (counted[b]["raw"], counted[b]["good"]) if b in counted else (0, 0)
        share = (raw + spec.smooth) / (all_raw + prior)
        out.append(math.log((good + prior * share) / (all_good + prior) / share))
    return out


def judge_quality(docs: DataFrame, trusted: DataFrame, spec: RatioSpec = RatioSpec(), text: str = "text", key: str = "doc_id") -> DataFrame:  # noqa: B008
    """Add the word statistics, qr_ratio, qr_base_failed and qr_kept to every row.

    qr_ratio is the sum of the log ratios of a document's words and word pairs over
    their number, 0 for a text without words. A document fails the base rules with
    fewer than ``min_words`` words or more than ``max_repeated_percent`` per cent of
    them in repeated windows; it is kept if it does not and its ratio is at least
    ``least``, ties at the bound included. Without trusted documents all ratios are 0.
    Null text counts as empty; repeated rows are judged alike; texts of any length are read
    whole; an empty table gives an empty result. Columns qr_* of the input are replaced or
    dropped; other names may clash with nothing.
    """
    ratios = F.from_json(F.lit(str(log_ratios(docs, trusted, spec, text, key))), "array<double>")
    judged = word_statistics(docs, text)
    bins = gram_bins(F.col("qr_hashes"), spec)
    total = F.aggregate(bins, F.lit(0.0), lambda s, b: s + F.get(ratios, b))
    grams = 2 * F.col("qr_n_words") - 1
    failed = (F.col("qr_n_words") < spec.min_words) | (100 * F.col("qr_n_repeat_words") > spec.max_repeated_percent * F.col("qr_n_words"))
    return (
        judged.withColumn("qr_ratio", F.when(F.col("qr_n_words") > 0, total / grams).otherwise(0.0))
        .withColumn("qr_base_failed", failed)
        .withColumn("qr_kept", ~failed & (F.col("qr_ratio") >= spec.least))
        .drop("qr_hashes")
    )
