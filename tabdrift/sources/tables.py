"""Reading and writing tables, task folders and run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabdrift.operators.profile import drop_blank_columns

#: Bytes of a file that its fingerprint covers.
HEAD_BYTES = 5_000_000


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, rows: int | None = None) -> DataFrame:
    """A table with a header; types are inferred from all rows unless given, blank index columns are dropped.

    With ``rows`` only the first rows in the order of the files, for samples; no task or
    driver holds more than those.
    """
    reader = spark.read.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if rows is not None:
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        placed = df.select("*", F.struct(*(p.alias(f"p{i}") for i, p in enumerate(place))).alias("_place"))
        df = placed.orderBy("_place").limit(rows).drop("_place")
    return drop_blank_columns(df)


#: A cell that opens with a quote, up to its closing one, doubled quotes not closing it; and any cell, up to the next comma.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
CELL = rf'(?s),({QUOTED}(?:"[^,]*+)?+|[^,]*+)'


def csv_cells(line: Column) -> Column:
    """The cells of a CSV line, as a reader with one state a cell finds them.

    A quote opens only at the start of a cell; commas and line breaks up to the closing quote do not cut, doubled
    quotes are one, what follows the closing quote belongs to the cell, and any other quote is text. A cell
    that never closes takes the rest of the line. The patterns never go back, so long lines cost one pass.
    """
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    inner = lambda c: F.replace(F.substring(F.regexp_extract(c, f"(?s)^{QUOTED}", 0), F.lit(2), F.length(c)), F.lit('""'), F.lit('"'))
    rest = lambda c: F.regexp_replace(c, f'(?s)^{QUOTED}"?', "")
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.concat(inner(c), rest(c))).otherwise(c))


def fitted(cells: Column, width: int) -> Column:
    """The cells padded with empty ones or cut to ``width``."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)


def _named(lines: DataFrame, cells: Column, header: Sequence[str], keep: Sequence[str]) -> DataFrame:
    out = lines.withColumn("_cells", cells)
    empty = lambda i: F.when(F.get("_cells", F.lit(i)) != "", F.get("_cells", F.lit(i)))
    return out.select(*keep, *(empty(i).alias(c) for i, c in enumerate(header)))


def parse_ragged(lines: DataFrame, header: Sequence[str], value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines as rows: those with too many cells are skipped, short ones padded with null."""
    cells = lines.withColumn("_c", csv_cells(F.col(value))).filter(F.size("_c") <= len(header))
    return _named(cells, fitted(F.col("_c"), len(header)), header, keep)


def repair_embedded(lines: DataFrame, header: Sequence[str], value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines as rows, with rows repaired that were packed into their second cell.

    A row of the wrong width whose first cell is digits, whose second has a comma and
    whose others are empty is the first cell followed by the cells of the second. It and
    any other row of the wrong width are padded or cut.
    """
    c = F.col("_c")
    packed = (
        (F.size(c) != len(header)) & (F.size(c) >= 2) & F.trim(F.get(c, F.lit(0))).rlike(r"^\d+$") & F.get(c, F.lit(1)).contains(",")
        & (F.array_join(F.slice(c, 3, F.greatest(F.size(c), F.lit(1))), "") == "")
    )
    whole = F.when(packed, F.concat(F.array(F.get(c, F.lit(0))), csv_cells(F.get(c, F.lit(1))))).otherwise(c)
    return _named(lines.withColumn("_c", csv_cells(F.col(value))), fitted(whole, len(header)), header, keep)


def task_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Add task_id, role (training, test, target) and table_idx to file paths; other files are left out."""
    name = F.regexp_extract(path, r"([^/]+)/(training|test|target)(?:_(\d+))?\.csv$", 2)
    out = paths.withColumn("role", name).filter("role != ''")
    return out.withColumn("task_id", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).withColumn(
        "table_idx", F.regexp_extract(path, r"_(\d+)\.csv$", 1).try_cast("int")
    )


def task_slice(tasks: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Tasks in order of id from ``offset``, ``limit`` of them at most."""
    out = tasks.select("task_id").distinct().orderBy("task_id").offset(offset)
    return out.limit(limit) if limit is not None else out


def fingerprints(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, size in bytes and SHA-1 of the first ``HEAD_BYTES`` bytes of each file's content."""
    raw = F.col(content).cast("binary")
    return files.select(F.col(path).alias("path"), F.octet_length(raw).cast("long").alias("size"), F.sha1(F.substring(raw, 1, HEAD_BYTES)).alias("sha1_head"))


def file_fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``fingerprints`` of files."""
    return fingerprints(spark.read.format("binaryFile").load(list(paths)))


def parse_run_log(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Records of a JSONL log; blank and broken lines are left out, missing fields are null."""
    kept = lines.filter(F.trim(value) != "")
    parsed = F.from_json(F.col(value), f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
    return kept.select(parsed.alias("r")).select("r.*").filter("_broken IS NULL").drop("_broken")


def matching_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files that paths and patterns name, each once, in order; names that match none are passed over."""
    found: set[str] = set()
    for p in dict.fromkeys(paths):
        try:
            found |= {r["path"] for r in spark.read.format("binaryFile").load(p).select("path").collect()}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return sorted(found)


def read_run_logs(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """All records of JSONL files named by paths and patterns, each file once however often it is named."""
    files = matching_files(spark, paths)
    if not files:
        raise FileNotFoundError(f"no log file matches {list(paths)}")
    return parse_run_log(spark.read.text(files), schema)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for flat files."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else df


def pending(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks that are not in the log yet."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def paired(baseline: DataFrame, evolved: DataFrame, key: str = "task_id") -> DataFrame:
    """Baseline tasks with their evolved partner's status; without one, missing_evolved_task."""
    other = evolved.select(key).distinct().withColumn("_there", F.lit(True))
    return baseline.join(other, key, "left").withColumn("status", F.when(F.col("_there"), "pending").otherwise("missing_evolved_task")).drop("_there")


def write_variant(tables: Mapping[int, DataFrame], path: str, variant: str, task_id: str, role: str = "training") -> None:
    """Write a task's evolved tables under variant, task, role and number, one schema per folder."""
    for i, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/variant={variant}/task_id={task_id}/role={role}/table_idx={i}")


def copy_files(spark: SparkSession, paths: Sequence[str], path: str, variant: str, task_id: str) -> None:
    """Keep files byte for byte, as rows (name, length, content): all of a baseline, and the target of any variant."""
    files = spark.read.format("binaryFile").load(list(paths))
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content")
    rows.write.mode("overwrite").parquet(f"{path}/files/variant={variant}/task_id={task_id}")


def write_task(path: str, variant: str, task_id: str, tables: Mapping[str, Mapping[int, DataFrame]], plan: DataFrame | None = None, log: DataFrame | None = None) -> None:
    """Write what a variant makes of a task: its tables by role, and plan and log as JSON lines."""
    for role, numbered in tables.items():
        write_variant(numbered, path, variant, task_id, role)
    for name, df in (("manifest", plan), ("evo_log", log)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}/variant={variant}/task_id={task_id}")


def write_run_log(log: DataFrame, path: str, resume: bool = False) -> None:
    log.write.mode("append" if resume else "overwrite").json(path)
