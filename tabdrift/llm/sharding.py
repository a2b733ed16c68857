"""Weighted rendezvous (highest random weight) sharding with gapless slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabdrift.llm.common import written

#: Rows that one slot bucket holds on average, once there are enough rows.
BUCKET_ROWS = 10_000
LEAST_BUCKETS = 256
#: Copies of a row that are numbered as one.
RUN = 1_000


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the smallest -ln(u) / weight, u a hash of key and shard in (0, 1).

    A shard's draw depends on the key and that shard alone, so another shard
    takes rows only into itself and a changed weight moves only its share. A null
    key is one key like any other.
    """
    unit = 2.0**-53

    def draw(shard: int, weight: float) -> Column:
        high = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 11).cast("double")
        return F.struct((-F.log((high + 0.5) * unit) / weight).alias("cost"), F.lit(shard).alias("shard"))

    draws = [draw(s, w) for s, w in sorted(weights.items()) if w > 0]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"].cast("int")


def with_slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 within each shard, in an order set by the columns ``order``.

    Rows that agree in all columns are alike, so they are counted first and numbered in
    runs of at most ``RUN``, however many they are. Runs are dealt by a hash of
    ``order`` and their place to buckets whose number follows the row count; a slot is the
    bucket's offset plus the place in the bucket. No task sees a whole shard or a whole
    group of copies. The runs are written once, so the slots do not depend on how the
    input is split.
    """
    last = F.floor((F.col("sh_n") - 1) / RUN)
    runs = df.groupBy(*df.columns).agg(F.count("*").alias("sh_n")).withColumn("sh_run", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    runs = written(runs.withColumn("sh_n", F.least(F.lit(RUN), F.col("sh_n") - F.col("sh_run") * RUN).cast("long")), "sh-runs")
    rows, buckets = runs.agg(F.sum("sh_n")).first()[0] or 0, LEAST_BUCKETS
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    dealt = runs.withColumn("sh_bucket", F.pmod(F.xxhash64(*order, "sh_run", F.lit("bucket")), F.lit(buckets)))
    below = lambda *by: Window.partitionBy(shard, *by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda window: F.coalesce(F.sum("sh_n").over(window), F.lit(0))
    totals = dealt.groupBy(shard, "sh_bucket").agg(F.sum("sh_n").alias("sh_n"))
    offsets = totals.select(shard, "sh_bucket", before(below().orderBy("sh_bucket")).alias("sh_offset"))
    first = F.col("sh_offset") + before(below("sh_bucket").orderBy(*order, "sh_run"))
    placed = dealt.join(offsets, [shard, "sh_bucket"]).withColumn("sh_first", first)
    return placed.withColumn("slot", F.explode(F.sequence("sh_first", F.col("sh_first") + F.col("sh_n") - 1))).select(*df.columns, "slot")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", weights: dict[int, float] | None = None) -> DataFrame:
    """Place every row of ``docs`` by its key; text itself is not shuffled.

    Returns key, size (UTF-8 bytes of the text plus 1; null text has none), the
    unsigned CRC-32 of the text (null: of the empty text), law 'key', shard, slot
    and grown_shard, the shard if one more of weight 1 were added. Rows with equal
    keys share a shard. Rows that agree in key, size and checksum hold their slots
    in any order. Texts of any length are read whole. No other column is looked at, so their
    names may clash with nothing. An empty table gives an empty result.
    """
    weights = weights or dict.fromkeys(range(shards), 1.0)
    grown = weights | {max(weights) + 1: 1.0}
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    return with_slots(placed, "shard", [key, "text_crc32", "size"]).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
