"""Target-distribution importance resampling with an exact distributed cutoff.

Texts are hashed word n-grams. Per bucket the gain is the log ratio of the target's and
the corpus's smoothed shares; a document's weight is the sum of the gains of its
features, and a seeded Gumbel key on top of it makes "the k highest" a draw without
replacement in proportion to exp(weight). The cutoff is found by a weighted
median of medians: each partition of the keys reports its median and its size, the weighted
median of these is a pivot that has a guaranteed share of all keys on either side, and
rounds go on until few keys are left. Only the winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabdrift.llm.common import small_batches, written

#: Words and word runs whose buckets a task remembers.
REMEMBERED = 100_000
#: Keys that a task takes the median of at a time, and keys that the driver may take to end the rounds.
RUN, FEW = 100_000, 4096
#: Ranges that winners are cut into for their ranks.
RANGES = 64
#: Every byte as it counts: A-Z lower-cased, digits, letters and bytes above 0x7F themselves, all else a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


@dataclass(frozen=True)
class ResampleSpec:
    """Feature runs of 1 to ``ngrams`` words in ``buckets``; ``percent`` of the documents with ``least_words`` are drawn."""

    ngrams: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    percent: int = 10
    least_words: int = 20


class _Buckets(dict):
    """word run in UTF-8 -> its bucket, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = b = zlib.crc32(run) % self.buckets
        return b


def features(text: bytes | None, spec: ResampleSpec, known: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words of a whole text in UTF-8, and the buckets of its features, repeats included.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
    """
    words = (text or b"").translate(_BYTES).split()
    runs = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
    for n in range(2, spec.ngrams + 1):
        joined = (b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        runs.append(np.fromiter(map(known.__getitem__, joined), np.int64))
    return len(words), np.concatenate(runs)


def bucket_counts(texts: DataFrame, spec: ResampleSpec, text: str = "text") -> np.ndarray:
    """How many features of all ``texts`` each bucket holds.

    A task adds up its whole texts in one array and hands on what is not zero, so the
    shuffle carries ``buckets`` rows a task at most, and the driver sees ``buckets`` sums.
    """
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(spec.buckets), np.zeros(spec.buckets, np.int64)
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                total += np.bincount(features(t.as_py(), spec, known)[1], minlength=spec.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(spec.buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares) of every bucket."""
    ratio = (target + 1.0) * (float(corpus.sum()) + len(corpus)) / ((corpus + 1.0) * (float(target.sum()) + len(corpus)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, spec: ResampleSpec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: is_key, is_words, n_features and weight, from whole texts and one array of gains."""
    small_batches(docs.sparkSession)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(spec.buckets)
        for batch in batches:
            found = [features(t.as_py(), spec, known) for t in batch.column("text").cast(pa.binary())]
            columns = [[n for n, _ in found], [len(b) for _, b in found], [int(gain[b].sum()) for _, b in found]]
            yield pa.RecordBatch.from_arrays([batch.column("is_key"), *(pa.array(c, pa.int64()) for c in columns)], names=["is_key", "is_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("is_key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(weigh, "is_key bigint, is_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) that the seed and key name; a null key counts as the text 'null'."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def _weighted_median(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
    """Of pairs (a, b) that stand for n others each, the one half of the weight lies up to; and the whole weight."""
    order = np.lexsort((b, a))
    upto = np.cumsum(n[order])
    at = order[np.searchsorted(upto, upto[-1] / 2)]
    return int(a[at]), int(b[at]), int(upto[-1])


def partition_medians(pairs: DataFrame) -> DataFrame:
    """One row (a, b, n) a task that has any pairs (a, b): the median of its runs of ``RUN`` pairs, weighted, and their number."""

    def median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], []

        def close() -> None:
            a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            found.append(_weighted_median(a, b, np.ones(len(a), np.int64)))
            held.clear()

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in "ab"])
            if sum(len(h[0]) for h in held) >= RUN:
                close()
        if held and sum(len(h[0]) for h in held):
            close()
        if found:
            row = _weighted_median(*(np.array(c, np.int64) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["a", "b", "n"])

    return pairs.select("a", "b").mapInArrow(median, "a bigint, b bigint, n bigint")


def cutoff(pairs: DataFrame, k: int) -> tuple[int, int] | None:
    """The ``k``-th largest pair (a, b) of a stored table; None if it has fewer or ``k`` is 0. No value is null.

    A round takes the medians of the partitions, weighted by the pairs that remain in each,
    and their weighted median as pivot. A quarter of the runs' pairs, an eighth of all,
    lies on either side of it at least, so each round discards a guaranteed share. What
    remains is written again once it is a quarter of what is read. ``FEW`` pairs or less go to the driver,
    which reads the answer from them; besides them it sees a row a task.
    """
    left, held, rest = pairs, pairs.count(), k
    size = held
    if not 0 < k <= size:
        return None
    while size > FEW:
        medians = partition_medians(left).collect()
        a, b, _ = _weighted_median(*(np.array([r[c] for r in medians], np.int64) for c in "abn"))
        over = (F.col("a") > a) | ((F.col("a") == a) & (F.col("b") > b))
        same = (F.col("a") == a) & (F.col("b") == b)
        above, equal = left.agg(F.count_if(over), F.count_if(same)).first()
        if above < rest <= above + equal:
            return a, b
        if rest <= above:
            left, size = left.filter(over), above
        else:
            left, size, rest = left.filter(~over & ~same), size - above - equal, rest - above - equal
        if size * 4 <= held:
            left, held = written(left.select("a", "b"), "is-left"), size
    best = left.orderBy(F.desc("a"), F.desc("b")).limit(rest).collect()[-1]
    return best["a"], best["b"]


def ranked(winners: DataFrame, name: str) -> DataFrame:
    """Add the place of each pair (a, b) in falling order, from 1; ``winners`` is read three times.

    Pairs are cut into ranges at approximate quantiles and numbered inside a range from
    the number of those above it, so no task sees all of them.
    """
    cuts = winners.agg(F.percentile_approx("a", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    dealt = winners.withColumn("_range", F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<bigint>"), lambda c: c > F.col("a"))))
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("a"), F.desc("b")))
    # at most RANGES rows of offsets
    return dealt.withColumn(name, inside).join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_o")).cast("bigint")).drop("_range", "_o")


def resample(docs: DataFrame, target: DataFrame, spec: ResampleSpec, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_features, weight, score and rank (1 for the highest score drawn; null if not drawn).

    ``key`` is an integer. Texts are read whole, however long; null, empty and blank texts have no
    features and weight 0. Of the N rows with ``least_words`` words or more
    floor(percent N / 100) are drawn, ties of the score going to the smaller key and a null key
    coming last; rows that repeat key and text score alike and are ranked one after the other. An
    empty target moves all gains alike, empty ``docs`` give an empty result. Other columns may have any names.

    Texts are read twice, for the corpus's counts and for the weights, which are written with
    their keys; the selection works on those numbers. Losers never move.
    """
    gain = gains(bucket_counts(docs, spec, text), bucket_counts(target, spec, text))
    scored = weighed(docs, gain, spec, text, key).withColumn("a", F.col("weight") + gumbel(F.col("is_key"), spec.seed))
    scored = written(scored.withColumn("b", F.coalesce(F.bitwise_not("is_key"), F.lit(-(1 << 63)))), "is-scored")
    able = F.col("is_words") >= spec.least_words
    drawn = scored.filter(able).count() * spec.percent // 100
    last = cutoff(scored.filter(able).select("a", "b"), drawn)
    out = [F.col("is_key").alias(key), "n_features", "weight", F.col("a").alias("score"), "rank"]
    none = F.lit(None).cast("bigint")
    if last is None:
        return scored.withColumn("rank", none).select(*out)
    wins = able & ((F.col("a") > last[0]) | ((F.col("a") == last[0]) & (F.col("b") >= last[1])))
    winners = ranked(scored.filter(wins), "rank")
    # rows equal to the last one that is drawn may be more than there is room for
    winners = winners.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.filter(~wins).withColumn("rank", none).select(*out).unionByName(winners.select(*out))


def oracle_sql(spec: ResampleSpec = ResampleSpec()) -> str:
    """The same rows for single words; crc32 is written out, eight steps a byte of each distinct word."""
    step = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
    return f"""
WITH entry AS (SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda k: CAST(k AS UBIGINT))), lambda x, k: {step.format(x="x")}) AS v
  FROM (SELECT unnest(range(256)) AS i)),
codes AS (SELECT list(v ORDER BY i) AS t FROM entry),
words AS (SELECT true AS ours, doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT false, item_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
numbered AS (SELECT *, row_number() OVER () AS id FROM words),
used AS (SELECT id, ours, unnest(w) AS word FROM numbered),
bins AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, strlen(word) + 1), lambda j: CAST(('0x' || substr(hex(encode(word)), CAST(2 * j - 1 AS BIGINT), 2)) AS UBIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS BIGINT) + 1])), 4294967295) % {spec.buckets} AS bucket FROM (SELECT DISTINCT word FROM used), codes),
held AS (SELECT id, ours, bucket FROM used JOIN bins USING (word)),
sums AS (SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM held GROUP BY bucket),
whole AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) AS DOUBLE) * CAST(big_s + {spec.buckets} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(big_t + {spec.buckets} AS DOUBLE)))) AS BIGINT) AS g FROM sums, whole),
weights AS (SELECT id, count(*) AS n, sum(g) AS w FROM held JOIN gain USING (bucket) WHERE ours GROUP BY id),
scored AS (SELECT doc_id, id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weights.w, 0) AS BIGINT) AS weight,
    CAST(coalesce(weights.w, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{spec.seed}:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS UBIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weights USING (id) WHERE ours),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {spec.least_words} ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= {spec.least_words}) OVER () * {spec.percent} // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {spec.least_words} AND place <= drawn THEN place END AS rank FROM placed"""
