"""Number rules that both engines compute by the same steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole text that reads as a number.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def two_digits(x: Column) -> Column:
    """``x`` to two digits, halves up.

    It is rounded to nine digits first, so that a half stays one in whatever order the
    numbers behind it were summed.
    """
    return F.floor(F.round(x.cast("double"), 9) * 100 + 0.5).cast("double") / 100


def two_digits_sql(x: str) -> str:
    return f"CAST(floor(round(CAST({x} AS DOUBLE), 9) * 100 + 0.5) AS DOUBLE) / 100"


def number(c: Column) -> Column:
    """The number a text or number stands for, else null; NaN is null, as it does not read as a number."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text)).try_cast("double")
