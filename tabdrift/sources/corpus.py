"""A corpus of many small files with headers of their own: to long cells, to a catalogue, and back to files.

Files of different headers are read in one job, each whole in one row, so they have to be small; a
large table is for ``tables.read_csv``. What is written goes through a sink that commits:
a task's files are staged, moved to their place once all tasks of the job have succeeded, and marked as
complete, so a lost or failed run leaves no half output and a resumed one knows what is there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tabdrift.functions.numbers import number
from tabdrift.functions.stored import written
from tabdrift.operators.profile import domain
from tabdrift.operators.relate import is_bad_name
from tabdrift.sources.tables import QUOTED, csv_cells, task_files

#: A record: cells and commas up to a line break outside quotes, or the end.
_CELL = rf'(?:{QUOTED}(?:"[^,\r\n]*+)?+|[^,\r\n]*+)'
RECORD = rf"(?s)({_CELL}(?:,{_CELL})*+)(?:\r\n|\n|\r|\z)"
#: Texts that stand for no value.
NO_VALUE = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Files whose presence says that a task is complete.
MARKERS = ("manifest.json", "evo_log.json")
#: The sink's own mark, with names and SHA-1 of a task's files.
COMPLETE = "complete.json"
#: Folders that a commit moves side by side, folders or files that one Spark task lists or reads, about, and bytes of files that it hands on at once.
MOVES, LISTED, HANDED = 16, 2_000, 4 << 20
WHOLE = r"^\s*[+-]?\d+\s*$"
FILES = "variant string, task_id string, name string, content binary"


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, and its path there."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _dealt(df: DataFrame) -> DataFrame:
    """``df``, a stored table, in partitions of about ``LISTED`` rows."""
    return df.repartition(max(1, min(n := df.count(), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // LISTED)))))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """The paths of all files under ``root``, of which none is read; what begins with a dot or an underscore is left out.

    Folders are listed level by level by Spark tasks, so the driver does not see their names. The path of ``root`` itself begins each.
    """
    top = store_of(root)[1].rstrip("/")
    if store_of(root)[0].get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(root)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(root)[0]
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith((".", "_"))]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in found], pa.string()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())], names=["path", "folder"])

    level, out = spark.createDataFrame([(top,)], "path string"), spark.createDataFrame([], "path string")
    while not level.isEmpty():
        found = written(_dealt(level).mapInArrow(names, "path string, folder boolean"), "listed")
        out = out.unionByName(found.filter("NOT folder").select("path"))
        level = found.filter("folder").select("path")
    return out


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """All CSV files of the task folders under ``root``: path, length, content, task_id, role, table_idx; other files are left out, empty ones not.

    They are listed and read by Spark tasks: a listing of Spark's own would hold every file in the driver.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, paths, held, n = store_of(root)[0], [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(list(map(len, held)), pa.int64()), pa.array(held, pa.binary())], names=["path", "length", "content"])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path) as file:
                    held.append(file.read())
                paths.append(path)
                n += len(held[-1])
                if n > HANDED:
                    yield made()
                    paths, held, n = [], [], 0
        yield made()

    found = listed_files(spark, root).filter(F.col("path").endswith(".csv"))
    return task_files(_dealt(found).mapInArrow(read, "path string, length bigint, content binary"))


def records(text: Column) -> Column:
    """The records of a CSV text, blank lines left out; line breaks inside quotes belong to their cell."""
    return F.filter(F.regexp_extract_all(text, F.lit(RECORD), F.lit(1)), lambda r: r != "")


def file_cells(files: DataFrame) -> DataFrame:
    """The cells of whole files with a header: task_id, role, table_idx, row_id, ordinal, column, value.

    Records with more cells than the header are skipped, short ones padded; texts that stand for no value are null; columns
    without a name go; of names that repeat the later ones are numbered. Rows count from 0 in the order of the file.
    Bytes that are no UTF-8 become replacement characters.
    """
    at = ["task_id", "role", "table_idx"]
    lines = files.select(*at, F.posexplode(records(F.make_valid_utf8(F.col("content").cast("string")))).alias("place", "line")).withColumn("cells", csv_cells(F.col("line")))
    heads = lines.filter("place = 0").select(*at, F.col("cells").alias("names"), F.posexplode("cells").alias("ordinal", "name"))
    again = F.size(F.filter(F.slice("names", 1, F.col("ordinal")), lambda n: n == F.col("name")))
    heads = heads.withColumn("column", F.when(again > 0, F.concat_ws(".", "name", again.cast("string"))).otherwise(F.col("name"))).filter(~is_bad_name(F.col("column")))
    heads = heads.groupBy(*at).agg(F.first(F.size("names")).alias("wide"), F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("head"))
    rows = _same_file(lines.filter("place > 0"), heads, at)
    rows = rows.filter(F.size("cells") <= F.col("wide")).withColumn("row_id", F.row_number().over(Window.partitionBy(*at).orderBy("place")) - 1)
    cells = rows.select(*at, F.col("row_id").cast("bigint"), "cells", F.explode("head").alias("h")).select(*at, "row_id", "h.ordinal", "h.column", F.get("cells", F.col("h.ordinal")).alias("value"))
    return cells.withColumn("value", F.when(~F.col("value").isin(NO_VALUE), F.col("value")))


def _same_file(lines: DataFrame, heads: DataFrame, at: list[str]) -> DataFrame:
    """Lines with what their file's header says; a target has no number."""
    other = heads.select(*(F.col(c).alias(f"_{c}") for c in at), "wide", "head")
    same = (F.col("task_id") == F.col("_task_id")) & (F.col("role") == F.col("_role")) & F.col("table_idx").eqNullSafe(F.col("_table_idx"))
    return lines.join(other, same).drop(*(f"_{c}" for c in at))


def column_types(cells: DataFrame) -> DataFrame:
    """The type of every column of every file, from all its values: task_id, role, table_idx, ordinal, column, dtype.

    int64 if all rows hold whole numbers, float64 if all values are numbers or there are none, bool if all rows are True or
    False, else object.
    """
    whole = F.bool_and(F.coalesce(F.col("value").rlike(WHOLE), F.lit(False)))
    truth = F.bool_and(F.coalesce(F.col("value").isin("True", "False", "TRUE", "FALSE", "true", "false"), F.lit(False)))
    numeric = F.count("value") == F.count(number(F.col("value")))
    kind = F.when(whole, "int64").when(numeric, "float64").when(truth, "bool").otherwise("object")
    return cells.groupBy("task_id", "role", "table_idx", "ordinal", "column").agg(kind.alias("dtype"))


def file_catalog(files: DataFrame) -> DataFrame:
    """One row per file (path, content), from its first record: task_id, file, n_cols, columns_json, domain_guess, domain_score, error.

    A file that is empty or no UTF-8 up to the end of its header is found out here and becomes a row with the domain 'error', while the
    others go on.
    """
    text = F.col("content").cast("string")
    head = F.regexp_extract(F.make_valid_utf8(text), RECORD, 1)
    error = F.when(F.length("content") == 0, "StopIteration()").when(~F.is_valid_utf8(text) & head.contains("\ufffd"), "UnicodeDecodeError('utf-8')")
    shown = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("task_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), error.alias("error"), F.when(error.isNull(), csv_cells(head)).alias("columns"))
    shown = shown.withColumn("_d", F.when(F.col("columns").isNotNull(), domain(F.col("columns"))))
    return shown.select("task_id", "file", F.size("columns").alias("n_cols"), F.to_json("columns").alias("columns_json"), F.coalesce("_d.domain", F.lit("error")).alias("domain_guess"), F.coalesce("_d.score", F.lit(0)).alias("domain_score"), "error").withColumn("n_cols", F.when(F.col("error").isNull(), F.col("n_cols")))


def quoted(value: Column) -> Column:
    """A value as a CSV cell: in quotes where it holds a comma, a quote or a line break; null is empty."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_files(cells: DataFrame, variant: str | Column) -> DataFrame:
    """The files (``FILES``) that the cells of whole tables make, rows and columns in their order."""
    at = ["task_id", "role", "table_idx"]
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c.alias("c")))), lambda x: x["c"]), ",")
    rows = cells.groupBy(*at, "row_id").agg(line(quoted(F.col("value"))).alias("line"), line(quoted(F.col("column"))).alias("head"))
    rows = rows.withColumn("line", F.when(F.col("line") == "", '""').otherwise(F.col("line")))  # a blank line would be no row
    whole = rows.groupBy(*at).agg(F.first("head").alias("head"), F.transform(F.array_sort(F.collect_list(F.struct("row_id", "line"))), lambda x: x["line"]).alias("lines"))
    text = F.concat(F.array_join(F.concat(F.array("head"), "lines"), "\n"), F.lit("\n"))
    name = F.concat(F.col("role"), F.coalesce(F.concat(F.lit("_"), F.col("table_idx").cast("string")), F.lit("")), F.lit(".csv"))
    return whole.select((F.lit(variant) if isinstance(variant, str) else variant).alias("variant"), "task_id", name.alias("name"), F.encode(text, "UTF-8").alias("content"))


def copied_files(files: DataFrame, variant: str) -> DataFrame:
    """Files of a corpus byte for byte: all of a baseline, or the targets of any variant."""
    return files.select(F.lit(variant).alias("variant"), "task_id", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")


def marker_files(tasks: DataFrame) -> DataFrame:
    """Plan and log of each task (variant, task_id, plan, log as JSON text) as the files that mark it as complete."""
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.encode(F.col(c), "UTF-8").alias("content")) for m, c in zip(MARKERS, ("plan", "log"), strict=True))))
    return tasks.select("variant", "task_id", both.alias("f")).select("variant", "task_id", "f.name", "f.content")


@dataclass
class Staged(WriterCommitMessage):
    """What one Spark task has staged: its folder, in which each variant has a folder with one for each task."""

    folder: str


class CorpusWriter(DataSourceWriter):
    """Stages files under a folder of each attempt, and moves those of the attempts that count when the job commits."""

    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return store_of(self.root)

    def write(self, iterator: Iterator) -> Staged:
        """Stage files, and beside those of each task its mark, last of all, so that a task moves with it."""
        store, root = self._store()
        folder, done = f"{root}/_staging/{self.job}/{uuid.uuid4().hex}", {}
        for row in iterator:
            if row.name == COMPLETE or any(not p or "/" in p or p.startswith((".", "_")) for p in (row.variant, row.task_id, row.name)):
                raise ValueError(f"no name of a file: {row.variant!r}, {row.task_id!r}, {row.name!r}")
            at, content = f"{folder}/{row.variant}/{row.task_id}", bytes(row.content)
            if (row.variant, row.task_id) not in done:
                store.create_dir(at)
            with store.open_output_stream(f"{at}/{row.name}") as out:
                out.write(content)
            done.setdefault((row.variant, row.task_id), {})[row.name] = hashlib.sha1(content).hexdigest()
        for (variant, task), names in done.items():
            with store.open_output_stream(f"{folder}/{variant}/{task}/{COMPLETE}") as out:
                out.write(json.dumps(names, sort_keys=True).encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        """Move each task's folder, its mark in it, to its place, in the place of an older one: a rename a task, side by side.

        The driver knows the tasks of one attempt at a time.
        """
        store, root = self._store()
        inside = lambda folder: [f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        new: dict[str, bool] = {}

        def move(task: str, folder: str, place: str, older: bool) -> None:
            if older:
                store.delete_dir(f"{place}/{task}")
            store.move(f"{folder}/{task}", f"{place}/{task}")

        with ThreadPoolExecutor(MOVES) as pool:
            for m in filter(None, messages):
                for variant in inside(m.folder):
                    place, tasks = f"{root}/{variant}", inside(f"{m.folder}/{variant}")
                    if variant not in new:
                        new[variant] = store.get_file_info(place).type == fs.FileType.NotFound
                        store.create_dir(place)
                    older = [False] * len(tasks) if new[variant] else [f.type != fs.FileType.NotFound for f in store.get_file_info([f"{place}/{t}" for t in tasks])]
                    for _ in pool.map(move, tasks, repeat(f"{m.folder}/{variant}"), repeat(place), older):
                        pass
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/_staging/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staging/{self.job}")


class CorpusSink(DataSource):
    """Rows ``FILES`` as files ``path/variant/task_id/name``."""

    @classmethod
    def name(cls) -> str:
        return "task_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options["path"])


def write_files(files: DataFrame, root: str) -> None:
    """Write ``files`` (``FILES``) under ``root``, a folder that all executors share, so that a task is there whole or not at all.

    All files of a task are written by one Spark task. A task that is there already is replaced.
    """
    spark = files.sparkSession
    spark.dataSource.register(CorpusSink)
    dealt = files.select("variant", "task_id", "name", "content").repartition("variant", "task_id")
    dealt.write.format("task_files").mode("append").option("path", root).save()


def completed(spark: SparkSession, root: str) -> DataFrame:
    """Tasks (variant, task_id) that are complete under ``root``, by their mark, or by the presence of plan and log; names are listed, no file is read."""
    store, top = store_of(root)
    if store.get_file_info(top).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "variant string, task_id string")
    parts = F.split(F.substring("path", len(top.rstrip("/")) + 2, 1 << 30), "/")
    found = listed_files(spark, root).select(parts.alias("p")).filter((F.size("p") == 3) & F.get("p", F.lit(2)).isin(COMPLETE, *MARKERS))
    names = found.select(*(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("variant", "task_id", "name")))).groupBy("variant", "task_id").agg(F.collect_set("name").alias("names"))
    there = F.array_contains("names", COMPLETE) | (F.size(F.array_intersect("names", F.array(*(F.lit(m) for m in MARKERS)))) == len(MARKERS))
    return names.filter(there).select("variant", "task_id")


def write_task_log(log: DataFrame, root: str) -> None:
    """Run records by task; records of a task that is in ``log`` take the place of its older ones, all others stay.

    A run that is repeated after a loss so leaves each task one set of records.
    """
    log.repartition("task_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").json(root)
