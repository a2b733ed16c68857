"""Bounded samples of labelled documents, and scores from margins, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; fold 0 is held out. A null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """At most ``bound`` labelled documents outside fold 0: columns text and label.

    They are the ones with the smallest hashes of their keys, so the choice is the
    same in every run. Only keys and labels of the chosen rows, ``bound`` at most,
    are broadcast to the texts. Rows with a null label are left out; a key that is
    labelled more than once counts with its largest label, and one that several texts
    carry with the text of the smallest digest, one row per key whatever their number.
    """
    known = labels.filter(F.col(label).isNotNull() & (fold(F.col(key)) != 0)).groupBy(F.col(key).alias("tr_key")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("tr_key"), "tr_key").limit(bound)
    rows = docs.select(F.col(key).alias("tr_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "tr_key")
    return rows.groupBy("tr_key", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("text", "label")


def fit_logistic(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(y = 1) over a margin, by damped Newton steps with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, a, c = np.where(y > 0, hi, lo), 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        g, s = np.array([((p - t) * m).sum(), (p - t).sum()]), p * (1 - p)
        h = np.array([[(s * m * m).sum(), (s * m).sum()], [(s * m).sum(), s.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, c = a - step[0] * 0.8, c - step[1] * 0.8
    return float(a), float(c)
