"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the text. A
batch is reduced to one row per digest, anti-joined with the index by
sort-merge, and what is new is appended, so that each later batch is compared
with everything seen before without reading any earlier text. The caller names
the batch: a run that is repeated under its name decides as the first did.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabdrift.functions.stored import scratch_path
from tabdrift.llm.common import carried, released, written

INDEX_SCHEMA = "digest binary, keep_id bigint, batch string"


def digest(text: Column) -> Column:
    """32-byte SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """A table ``digest, keep_id, batch``, bucketed and sorted by digest.

    Its files lie in the folder that all executors share and not in the warehouse, which a cluster
    need not share and which by default is a folder of the driver's own. The bucket count is fixed when the table is made. By default it is the
    session's shuffle partition count, so that a batch already hashed for its own
    aggregation is written with one file per bucket. Batches are added one at a time.
    Whoever makes an index drops it.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.spare = spark, name, f"{name}_compact"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.catalog.tableExists(self.spare) and not spark.catalog.tableExists(name):
            self._take_spare()  # a compaction was lost between its last two steps
        if spark.catalog.tableExists(name):
            self.buckets = int(
                spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").first()["data_type"]
            )
        else:
            self._append(spark.createDataFrame([], INDEX_SCHEMA), name)

    def _append(self, rows: DataFrame, name: str) -> None:
        out = rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
        if not self.spark.catalog.tableExists(name):
            out = out.option("path", scratch_path(self.spark, name))
        out.saveAsTable(name)

    def _drop(self, name: str) -> None:
        """Drop a table, and then its rows from the shared folder."""
        if self.spark.catalog.tableExists(name):
            path = self.spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {name}")
            self.spark.createDataFrame([], INDEX_SCHEMA).write.mode("overwrite").parquet(path)

    def _take_spare(self) -> None:
        self.spark.sql(f"ALTER TABLE {self.spare} RENAME TO {self.name}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests of ``groups`` (digest, keep_id) not yet in the index.

        What a lost run of the same batch has appended is found there and not appended again.
        """
        fresh = groups.select("digest", "keep_id").hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        self._append(fresh.withColumn("batch", F.lit(batch)), self.name)

    def compact(self) -> None:
        """Rewrite the table with one sorted file per bucket, as each batch adds a file to every bucket.

        The new table is complete before the old one goes; if the run is lost between
        the two, the next to open the index finishes it.
        """
        self._drop(self.spare)
        # a digest made anew: for that of the table Spark leaves the repartition out and then reads without buckets
        self._append(self.read().withColumn("digest", F.concat("digest", F.lit(bytearray()))), self.spare)
        self._drop(self.name)
        self._take_spare()

    def drop(self) -> None:
        for name in (self.name, self.spare):
            self._drop(name)


def text_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per distinct text: digest, keep_id (its largest key), dd_repeats (rows with that key), dd_group_size."""
    keys = docs.groupBy(digest(F.col(text)).alias("digest"), F.col(key).alias("id")).agg(F.count("*").alias("n"))
    groups = keys.groupBy("digest").agg(F.max(F.struct("id", "n")).alias("best"), F.sum("n").alias("dd_group_size"))
    return groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.n").alias("dd_repeats"), "dd_group_size")


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Mark each row of a stored table ``docs`` and add its digests to ``index`` under ``batch``.

    Adds dd_digest (binary), dd_keep_id, dd_group_size and dd_kept. Texts are
    equal when identical, however long; null counts as empty. Of the rows of a batch with equal
    texts the one with the largest key stays, a null key being smallest; if rows
    repeat key and text, exactly one of them stays. When an earlier batch has the
    text, none stays and dd_keep_id is that batch's key. dd_group_size counts the
    rows of this batch. An empty batch gives an empty result. Input columns dd_* are
    replaced or dropped; other names may clash with nothing.

    A batch may be run again, whole or after a run that was lost at any step: digests that
    the index holds under its own name count as its own. The result reads written
    tables and not the index, which may then change or go.

    Rows are decided by their keys. Only rows that repeat the key and text that stay
    need a row id; they are written once with it, and every reader takes the id from
    that table. So nothing depends on how a scan of ``docs`` is split, which may change
    from one scan to the next.

    Equal texts meet as one partial row per task and key in the aggregation; the join
    back shuffles both sides by digest, so adaptive execution can split a large group.
    """
    return _marked(docs, _decided(docs, index, batch, text, key), text, key)


def dedup_in_batches(docs: DataFrame, index: DigestIndex, batches: Sequence[tuple[str, Column]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``exact_dedup`` of one table in batches, one after the other: names, and conditions on its rows of which each row meets one.

    A later batch is decided by what the index holds of the earlier ones. dd_group_size counts the rows of all these batches.
    """
    parts = [(docs.filter(rows), name) for name, rows in batches]
    decided = [_decided(part, index, name, text, key) for part, name in parts]
    sizes = reduce(DataFrame.unionByName, decided).groupBy("dd_digest").agg(F.sum("dd_group_size").alias("dd_group_size"))
    sizes = written(sizes, "dd-sizes")
    marked = [_marked(part, d.drop("dd_group_size").join(sizes, "dd_digest"), text, key) for (part, _), d in zip(parts, decided, strict=True)]
    return reduce(DataFrame.unionByName, marked)


def _decided(docs: DataFrame, index: DigestIndex, batch: str, text: str, key: str) -> DataFrame:
    """What is decided of each text of a batch, its digests being added to the index; written."""
    groups = written(text_groups(docs, text, key), "dd-groups")
    index.add(groups, batch)
    seen = index.read().withColumnRenamed("keep_id", "seen_id")
    own = F.col("batch") == batch
    decided = groups.join(seen, "digest").select(
        F.col("digest").alias("dd_digest"),
        F.when(own, F.col("keep_id")).otherwise(F.col("seen_id")).alias("dd_keep_id"),
        F.when(own, F.col("dd_repeats")).otherwise(0).alias("dd_repeats"),
        "dd_group_size",
    )
    return written(decided, "dd-decided")


def _marked(docs: DataFrame, decided: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``docs`` with what is decided of their texts."""
    marked = docs.drop(*(c for c in docs.columns if c.startswith("dd_"))).withColumn("dd_digest", digest(F.col(text)))
    rows = marked.join(decided, "dd_digest").withColumn("dd_kept", (F.col("dd_repeats") > 0) & F.col(key).eqNullSafe(F.col("dd_keep_id")))
    if not decided.filter("dd_repeats > 1").isEmpty():
        repeated = F.col("dd_kept") & (F.col("dd_repeats") > 1)
        numbered = written(rows.filter(repeated).withColumn("dd_repeats", F.monotonically_increasing_id()), "dd-repeated")
        first = numbered.groupBy("dd_digest").agg(F.min("dd_repeats").alias("dd_repeats")).select("dd_repeats", F.lit(True).alias("dd_first"))
        chosen = numbered.join(first, "dd_repeats", "left").withColumn("dd_kept", F.coalesce("dd_first", F.lit(False)))
        rows = rows.filter(~repeated).unionByName(chosen.drop("dd_first"))
    return rows.drop("dd_repeats")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own name."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def keep_first_of_each(docs: DataFrame, index: DigestIndex, batch: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns of any names.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are decided as ``exact_dedup`` says.
    """
    return released(exact_dedup(carried(docs, text, key), index, batch, "in_0", "in_1").filter("dd_kept"))
