"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabdrift.llm.common import small_batches
from tabdrift.llm.labelled import fit_logistic, training_rows

WORD = re.compile(r"\w+")
#: Words whose terms a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class FmSpec:
    """``sample`` bounds the labelled rows that are fitted.

    Every bin that ``least_docs`` of them have and whose presence and the label are
    dependent, by a likelihood-ratio statistic above ``evidence``, is a term.
    """

    sample: int = 12_000
    bins: int = 1 << 18
    least_docs: int = 4
    evidence: float = 6.63
    factors: int = 4
    prefix: int = 6
    epochs: int = 20
    batch: int = 128
    rate: float = 0.2
    factor_rate: float = 0.02
    settled: float = 1e-4
    penalty: float = 1e-4
    folds: int = 3
    seed: int = 7


def word_terms(word: str, spec: FmSpec) -> tuple[int, ...]:
    """Bins of a lower-cased word and of its stem, its first ``prefix`` letters, if it is longer."""
    whole = xxhash.xxh3_64_intdigest("w" + word) % spec.bins
    return (whole, xxhash.xxh3_64_intdigest("w" + word[: spec.prefix]) % spec.bins) if len(word) > spec.prefix else (whole,)


class _Terms(dict):
    """word -> what ``of`` says of its bins, remembered."""

    def __init__(self, spec: FmSpec, of=lambda bins: bins):
        super().__init__()
        self.spec, self.of = spec, of

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = self.of(word_terms(word, self.spec))
        return got

    def present(self, text: str | None) -> np.ndarray:
        """The sorted distinct terms of a whole text."""
        return np.array(sorted({t for w in set(WORD.findall((text or "").lower())) for t in self[w]}), np.int32)


@dataclass
class FmModel:
    """bias + sum of weights + sum over pairs of inner products of factors; slope and offset make a score of it."""

    spec: FmSpec
    bins: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, rows: np.ndarray) -> float:
        if not len(rows):
            return self.bias
        v = self.factors[rows]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, rows: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.raw(rows) + self.offset, -30, 30))))


def telling_terms(docs: list[np.ndarray], y: np.ndarray, spec: FmSpec) -> np.ndarray:
    """The bins that have a say, as many as there are.

    The statistic is twice the sample's size times the mutual information of presence
    and label; the default threshold is passed by one term in a hundred that has
    nothing to do with the label. A term that matters only in a pair passes too where the pair shifts its share of labels.
    """
    n, pos = len(y), float(y.sum())
    counts = lambda rows: np.bincount(np.concatenate([np.empty(0, np.int64), *rows]), minlength=spec.bins).astype(float)
    every, hit = counts(docs), counts(d for d, l in zip(docs, y, strict=True) if l)
    gain = np.zeros(spec.bins)
    for cell, row, col in ((hit, every, pos), (every - hit, every, n - pos), (pos - hit, n - every, pos), (n - pos - every + hit, n - every, n - pos)):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain += np.where(cell > 0, cell * np.log(cell * n / (row * col)), 0.0)
    return np.flatnonzero((every >= spec.least_docs) & (2 * gain > spec.evidence))


def placed(docs: list[np.ndarray], model: FmModel) -> list[np.ndarray]:
    """The rows of the model that each document's terms have."""
    place = np.full(model.spec.bins, -1)
    place[model.bins] = np.arange(len(model.bins))
    return [p[p >= 0] for p in (place[d] for d in docs)]


def fit_fm(docs: list[np.ndarray], y: np.ndarray, spec: FmSpec) -> FmModel:
    """Fit by AdaGrad on the logistic loss over presence of the telling terms and of their pairs.

    Without labels of both kinds the model answers with their share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return FmModel(spec, np.empty(0, np.int64), start, np.empty(0), np.empty((0, spec.factors)))
    rng, bins = np.random.default_rng(spec.seed), telling_terms(docs, y, spec)
    w, v, b = np.zeros(len(bins)), rng.normal(0, 0.01, (len(bins), spec.factors)), start
    rows = placed(docs, FmModel(spec, bins, b, w, v))
    gw, gv, gb = np.full(len(w), spec.settled), np.full(v.shape, spec.settled), spec.settled
    for _ in range(spec.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), spec.batch):
            part = order[at : at + spec.batch]
            idx = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            held = v[idx]
            sums = np.stack([np.bincount(doc, held[:, k], len(part)) for k in range(spec.factors)], axis=1)
            raw = b + np.bincount(doc, w[idx] - 0.5 * (held**2).sum(1), len(part)) + 0.5 * (sums**2).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            pull = slope[doc, None] * (sums[doc] - held)
            dw = np.bincount(idx, slope[doc], len(w)) + spec.penalty * w
            dv = np.stack([np.bincount(idx, pull[:, k], len(w)) for k in range(spec.factors)], axis=1) + spec.penalty * v
            db = slope.sum()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, b = w - spec.rate * dw / np.sqrt(gw), v - spec.factor_rate * dv / np.sqrt(gv), b - spec.rate * db / np.sqrt(gb)
    return FmModel(spec, bins, float(b), w, v)


def calibrated(docs: list[np.ndarray], y: np.ndarray, spec: FmSpec) -> FmModel:
    """The model of all rows, with a logistic on the sums that models of the other folds give each row."""
    model = fit_fm(docs, y, spec)
    if min(y.sum(), len(y) - y.sum()) < spec.folds:
        return model
    fold, raw = np.random.default_rng(spec.seed).permutation(len(y)) % spec.folds, np.zeros(len(y))
    for k in range(spec.folds):
        part = fit_fm([d for d, f in zip(docs, fold, strict=True) if f != k], y[fold != k], spec)
        held = np.flatnonzero(fold == k)
        raw[held] = [part.raw(r) for r in placed([docs[i] for i in held], part)]
    return replace(model, **dict(zip(("slope", "offset"), fit_logistic(raw, y), strict=True)))


def train(docs: DataFrame, labels: DataFrame, spec: FmSpec, label: str = "toxic", text: str = "text", key: str = "doc_id") -> FmModel:
    """Fit on a bounded sample: tasks turn whole texts into term bins, the driver fits ``spec.sample`` rows at most."""
    small_batches(docs.sparkSession)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(spec)
        for batch in batches:
            packed = [terms.present(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("label")], names=["bins", "label"])

    sample = training_rows(docs, labels, label, spec.sample, text, key).mapInArrow(bins, "bins binary, label int").collect()
    # an order of the rows' own, so that fits agree whichever task came first
    rows = sorted((int(r["label"]), bytes(r["bins"])) for r in sample)
    return calibrated([np.frombuffer(b, np.int32) for _, b in rows], np.array([y for y, _ in rows], float), spec)


def score_documents(docs: DataFrame, model: FmModel, text: str = "text") -> DataFrame:
    """Add tx_score in [0, 1] to every row, from its whole text; null counts as empty.

    A text without known terms, such as an empty one, gets the model's bias. Rows are
    independent: repeated rows score alike and an empty table stays empty. A column
    tx_score of the input is replaced; other names may clash with nothing.
    """
    small_batches(docs.sparkSession)

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = np.full(model.spec.bins, -1, np.int32)
        place[model.bins] = np.arange(len(model.bins))
        terms = _Terms(model.spec, lambda bins: tuple(int(place[b]) for b in bins if place[b] >= 0))
        for texts in batches:
            yield pa.array([model.score(terms.present(t.as_py())) for t in texts], pa.float64())

    return docs.withColumn("tx_score", scores(F.col(f"`{text}`")))
