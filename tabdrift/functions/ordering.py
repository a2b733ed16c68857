"""Running sums, ranks and percentiles that no single task has to see whole."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabdrift.functions.stored import written

#: Ranges that the values of one group are cut into, and values that texts are cut by are chosen from.
RANGES, SAMPLED = 64, 1024
#: Most values of a group that one task sorts.
SORTED = 1_000_000


def _range_of(value: Column, cuts: Column) -> Column:
    """How many of ``cuts`` lie below ``value``; equal values share a range."""
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < value)), F.lit(0))


def running_sums(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Replace each column of ``sums`` by its running sum over rising ``value`` within ``keys``.

    ``value`` is a number and occurs once per group; ``df`` is best a stored table, as it is
    read again for its groups' sizes. Groups of up to ``SORTED`` values are sorted in one task each. The values of a larger one
    are cut into ranges at approximate quantiles; sums run inside a range and start from the total of the ranges below. So
    a single huge group is spread over tasks, however its values are spread.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > SORTED).drop("_size")
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    plain = lambda part: part.withColumns({s: F.sum(s).over(upto) for s in sums})
    if large.isEmpty():
        return plain(df)
    large = written(large, "large-groups")
    return plain(joined(df, large, keys, "left_anti")).unionByName(_ranged_sums(joined(df, large, keys, "left_semi"), keys, value, sums))


def _ranged_sums(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    parts = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), parts, 1000).alias("_cuts"))
    ranged = joined(df, cuts, keys).withColumn("_range", _range_of(F.col(value).cast("double"), F.col("_cuts")))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    offsets = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{s}").over(below), F.lit(0)).alias(f"_o_{s}") for s in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = joined(ranged, offsets, [*keys, "_range"])
    return placed.withColumns({s: F.sum(s).over(inside) + F.col(f"_o_{s}") for s in sums}).drop("_cuts", "_range", *(f"_o_{s}" for s in sums))


def sums_upto(df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """Beside each row, for each column of ``sums``: up_, its sum over the rows of the group with no larger ``value``; eq_, over those
    with the same; all_, over the whole group.

    ``value`` is a number that is not null and may repeat. Rows move once and are joined with nothing that grows with them: groups of up to
    ``SORTED`` rows are sorted in one task each, a larger one inside ranges, as ``running_sums`` cuts them.
    """
    large = written(df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > SORTED).drop("_size"), "large-groups")
    if large.isEmpty():
        return _placed(df, keys, value, sums).withColumns({f"all_{s}": F.sum(s).over(Window.partitionBy(*keys)) for s in sums})
    small, part = joined(df, large, keys, "left_anti"), joined(df, large, keys, "left_semi")
    cuts = part.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 1000).alias("_cuts"))
    ranged = _ranged(joined(part, written(cuts, "cuts"), keys), F.col(value).cast("double"))
    totals = written(ranged.groupBy(*keys, "_range").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums)), "totals")
    whole = Window.partitionBy(*keys)
    below = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{s}").over(below), F.lit(0)).alias(f"_o_{s}") for s in sums), *(F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums))
    placed = joined(_placed(ranged, [*keys, "_range"], value, sums), written(starts, "starts"), [*keys, "_range"])
    placed = placed.withColumns({f"up_{s}": F.col(f"up_{s}") + F.col(f"_o_{s}") for s in sums}).drop("_range", *(f"_o_{s}" for s in sums))
    plain = _placed(small, keys, value, sums).withColumns({f"all_{s}": F.sum(s).over(whole) for s in sums})
    return plain.unionByName(placed)


def _placed(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy(*by, value)
    return df.withColumns({f"up_{s}": F.sum(s).over(upto) for s in sums}).withColumns({f"eq_{s}": F.sum(s).over(same) for s in sums})


def _ranged(df: DataFrame, value: Column) -> DataFrame:
    """``_range`` instead of ``_cuts``, the number of cuts below ``value``, by halving: RANGES is a power of two."""
    out, half = df.withColumn("_range", F.lit(0)), RANGES // 2
    while half:
        out = out.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (half - 1)) < value, half).otherwise(0))
        half //= 2
    return out.drop("_cuts")


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Left rows with the right columns of the same keys, null keys matching null keys."""
    other = right.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_k_{k}" for k in keys))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """Exact percentiles of the non-null values of each group, between neighbours in proportion.

    Values are counted, the counts run up (``running_sums``), and the two values
    around each place are picked, so no task holds all values of a group.
    """
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_upto")), "counts")
    sizes = counts.groupBy(*keys).agg(F.sum("_upto").alias("_n"))
    both = joined(running_sums(counts, keys, "_v", ["_upto"]), sizes, keys)
    low = {n: F.floor((F.col("_n") - 1) * F.lit(p)) for n, p in at.items()}
    rest = {n: (F.col("_n") - 1) * F.lit(p) - low[n] for n, p in at.items()}
    picked = both.groupBy(*keys, "_n").agg(
        *(F.min(F.when(F.col("_upto") > low[n] + k, F.col("_v"))).alias(f"_{k}_{n}") for n in at for k in (0, 1)),
    )
    value_of = lambda n: F.col(f"_0_{n}") + F.when(rest[n] > 0, rest[n] * (F.col(f"_1_{n}") - F.col(f"_0_{n}"))).otherwise(0.0)
    return picked.select(*keys, *(value_of(n).alias(n) for n in at))


def text_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct non-null values of a text column with ``name``, their place in sorted order from 0.

    Values are cut into ranges at values of a sample, those of the smallest hashes, so that
    shared beginnings do no harm; places run inside a range and start from the count of the
    ranges below. The sample is all that the driver sees.
    """
    values = written(df.filter(F.col(column).isNotNull()).select(column).distinct(), "values")
    sample = values.orderBy(F.xxhash64(column), column).limit(SAMPLED).orderBy(column).collect()
    cuts = [sample[i * len(sample) // RANGES][0] for i in range(1, RANGES)] if len(sample) >= RANGES else []
    ranged = values.withColumn("_range", _range_of(F.col(column), F.array(*map(F.lit, cuts))) if cuts else F.lit(0))
    below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.join(offsets, "_range").select(column, (F.col("_o") + place - 1).cast("int").alias(name))
