"""Shared pieces of the corpus operators: tables, scratch storage, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabdrift.functions.stored import small_side, written  # noqa: F401

T = TypeVar("T")
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows of a batch that goes to a Python worker, where Spark's own default is 10,000.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand at most ``BATCH_ROWS`` rows at a time to Python in this session, if it has no setting of its own.

    Batches of whole texts are large, and the JVM and its worker hold several of them
    each, outside the heap; the rows of a batch are what Spark lets a user set.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null and blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def carried(docs: DataFrame, *named: str) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, with the named ones beside it, so that no helper column can meet a name of theirs."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, *(F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(named)))


def released(df: DataFrame) -> DataFrame:
    """The columns that ``carried`` packed."""
    return df.select("row.*")


def in_blocks(values: Iterable[T], weight: Callable[[T], int], most: int) -> Iterator[tuple[int, list[T]]]:
    """Runs of ``values`` that end once they weigh more than ``most``, each with the place of its first.

    The values are made as they are asked for, so a task holds one run of them.
    """
    run, first, held = [], 0, 0
    for i, value in enumerate(values):
        run.append(value)
        held += weight(value)
        if held > most:
            yield first, run
            run, first, held = [], i + 1, 0
    if run:
        yield first, run


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words stirred, so that near numbers come far apart."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
