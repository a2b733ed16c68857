"""Date formats and how well texts fit them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats in the order they are tried, as Spark patterns and as strptime formats.
EVALUATE_FORMATS = {
    "yyyy-M-d": "%Y-%m-%d",
    "yyyy-M-d H:m:s": "%Y-%m-%d %H:%M:%S",
    "yyyy-M-d H:m": "%Y-%m-%d %H:%M",
    "M/d/yyyy": "%m/%d/%Y",
    "d/M/yyyy": "%d/%m/%Y",
    "M/d/yyyy H:m:s": "%m/%d/%Y %H:%M:%S",
    "d/M/yyyy H:m:s": "%d/%m/%Y %H:%M:%S",
}
EVOLVE_FORMATS = EVALUATE_FORMATS | {"M/d/yyyy H:m": "%m/%d/%Y %H:%M", "d/M/yyyy H:m": "%d/%m/%Y %H:%M"}


def parsed(text: Column, pattern: str | None) -> Column:
    """The timestamp a text stands for under a pattern, or in the ISO order without one, else null."""
    return F.try_to_timestamp(text.cast("string"), F.lit(pattern)) if pattern else F.try_to_timestamp(text.cast("string"))


def pick_format(shares: dict[str, Column], least: float = 0.8) -> Column:
    """The first format with a share of 0.99 or more, else the one with the largest, if that is ``least`` at least."""
    names = list(shares)
    sure = F.coalesce(*(F.when(shares[n] >= 0.99, F.lit(n)) for n in names))
    top = F.greatest(*(F.coalesce(s, F.lit(0.0)) for s in shares.values()))
    best = F.coalesce(*(F.when(shares[n] == top, F.lit(n)) for n in names))
    return F.when(sure.isNotNull(), sure).when(top >= least, best)
