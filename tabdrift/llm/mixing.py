"""Mixing sources to target weights by repetition rates and hash-seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabdrift.llm.common import BLANKS, carried, released, small_side, written

#: Most sources that are broadcast to the rows; with more, the rows are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null.

    Each word and the blanks after it become one character, so no array of words is built.
    """
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def source_targets(sized: DataFrame, source: str, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, weight and target.

    Sources in code point order, null last, take ``weights`` in turn. The targets
    share ``share`` times all sizes by weight; none exceeds ``cap`` times its
    source's size and what is cut off goes to the others by weight. This is water
    filling: with sources in order of cap over weight, the first that is not
    filled at the level left by those before it sets the level of all the rest; the
    levels after it are no higher, so it is the largest.
    Windows here run over one row per source.
    """
    by_source = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col(source).asc_nulls_last())
    whole = Window.partitionBy()
    level = ranked.withColumns({
        "left": F.sum("source_size").over(whole) * F.lit(float(share))
        - F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("level", F.col("left") / F.col("rest"))
    water = F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(whole)
    return level.withColumn("water", water).select(
        source,
        "source_size",
        "weight",
        F.when(F.col("most") / F.col("weight") < F.coalesce("water", F.lit(float("inf"))), F.col("most"))
        .otherwise(F.col("water") * F.col("weight"))
        .alias("target"),
    )


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key and seed, the same in every run and on every machine."""
    head = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Add mx_size, mx_source_size, mx_target and mx_copies to every row.

    A source's rate is target over size; each row has floor(rate) copies and one
    more when a draw seeded by its key falls below the fraction, so reruns and any
    partitioning agree and no row exceeds ceil(cap) copies. Null text has size 0;
    null source is a source of its own; a row without key draws by its text. Rows that
    repeat draw alike. Sources without words have target 0 and no copies. Empty tables give
    none. Texts of any length are counted whole. Columns mx_* of the input are replaced;
    other names may clash with nothing.

    The texts are read twice: once for the targets, which are written, a row per
    source, and once for the rows.
    """
    sized = docs.drop("mx_source_size", "mx_target").withColumn("mx_size", word_count(F.col(text)))
    targets = source_targets(
        sized.select(F.col(source).alias("mx_source"), F.col("mx_size").alias("size")), "mx_source", weights, share, cap
    ).select("mx_source", F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target"))
    targets = small_side(written(targets, "mx-targets"), BROADCAST_SOURCES)
    rate = F.coalesce(F.try_divide("mx_target", "mx_source_size"), F.lit(0.0))
    draw = hash_unit(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")), seed)
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("mx_source")), "left").drop("mx_source")
    return joined.withColumn("mx_copies", copies)


def emit_mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as its copies say, with its own columns of any names.

    Null keys, texts and sources, texts of any length, repeated rows and empty tables count as ``mix`` says. There are no
    ties: a row's copies depend on its own draw.
    """
    names = [how.pop(k, d) for k, d in (("text", "text"), ("key", "doc_id"), ("source", "source"))]
    mixed = mix(carried(docs, *names), text="in_0", key="in_1", source="in_2", **how)
    repeated = mixed.filter("mx_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("mx_copies"))))
    return released(repeated)


def oracle_sql(weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> str:
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, text, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS DOUBLE) AS weight,
         source_size * CAST({cap} AS DOUBLE) AS most
  FROM by_source),
level AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST({share} AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
water AS (SELECT *, max(CASE WHEN most / weight >= level THEN level END) OVER () AS water FROM level),
targets AS (
  SELECT source, source_size,
         CASE WHEN water IS NULL OR most / weight < water THEN most ELSE water * weight END AS target
  FROM water),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(t.target / nullif(t.source_size, 0), 0.0) AS rate,
         CAST(('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), s.text, '') || ':{seed}'), 1, 8)) AS UBIGINT)
           / 4294967296.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated"""
