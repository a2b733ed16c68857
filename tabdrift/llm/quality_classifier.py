"""Quality by naive Bayes support vectors over hashed n-gram indicators.

Each n-gram indicator is scaled by its log-count ratio between the classes, and a
linear hinge-loss model is fitted on them by dual coordinate descent. A logistic on
out-of-fold margins turns margins into scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tabdrift.llm.common import mixed, small_batches
from tabdrift.llm.labelled import fit_logistic, training_rows

TOKEN = re.compile(r"\w+|\n|[^\w\s]+")
#: Tokens whose hashes a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class NbSvmSpec:
    """``sample`` bounds the labelled rows that are fitted; ``order`` is the longest n-gram."""

    sample: int = 6000
    bins: int = 1 << 20
    order: int = 2
    least_docs: int = 3
    smooth: float = 1.0
    cost: float = 1.0
    blend: float = 0.25
    epochs: int = 25
    folds: int = 3
    seed: int = 11


def _shape(token: str) -> str:
    """What kind of token it is; runs of symbols stand for themselves up to three characters."""
    if token[0] == "\n" or not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if any(c.isdigit() for c in token):
        return "9"
    if len(token) > 1 and token.isupper():
        return "A"
    return "Aa" if token[0].isupper() else "a"


class NGrams(dict):
    """Bins of the n-grams, up to ``order``, of a text's lower-cased tokens and of their shapes.

    A token's hashes, whole and as a shape, are remembered. In the shape sequence a
    token equal to the one before it is ``=``.
    """

    def __init__(self, spec: NbSvmSpec):
        super().__init__()
        self.spec = spec
        self.again = xxhash.xxh3_64_intdigest("s=")

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = got = (xxhash.xxh3_64_intdigest("t" + token.lower()), xxhash.xxh3_64_intdigest("s" + _shape(token)))
        return got

    def present(self, text: str | None) -> np.ndarray:
        """The sorted distinct bins of a whole text."""
        found = TOKEN.findall(text or "")
        if not found:
            return np.empty(0, np.int32)
        tokens, shapes = np.array([self[t] for t in found], np.uint64).T
        shapes = np.where(np.concatenate([[False], tokens[1:] == tokens[:-1]]), np.uint64(self.again), shapes)
        out = []
        for h in (tokens, shapes):
            gram = mixed(h)
            out.append(gram)
            for n in range(1, self.spec.order):
                gram = mixed(gram[:-1] ^ mixed(h[n:] + np.uint64(n)))
                out.append(gram)
        return np.unique(np.concatenate(out) % np.uint64(self.spec.bins)).astype(np.int32)


def log_count_ratios(docs: list[np.ndarray], y: np.ndarray, spec: NbSvmSpec) -> tuple[np.ndarray, np.ndarray]:
    """The bins that enough documents have, and the log ratio of their smoothed shares in the classes."""
    count = lambda keep: np.bincount(np.concatenate([np.empty(0, np.int64), *(d for d, k in zip(docs, keep, strict=True) if k)]), minlength=spec.bins)
    good, bad = count(y > 0), count(y <= 0)
    p, q = good + spec.smooth, bad + spec.smooth
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    bins = np.flatnonzero((good + bad >= spec.least_docs) & (r != 0))
    return bins, r[bins]


def placed(docs: list[np.ndarray], bins: np.ndarray, size: int) -> list[np.ndarray]:
    """Where in ``bins`` each document's own bins are."""
    place = np.full(size, -1)
    place[bins] = np.arange(len(bins))
    return [p[p >= 0] for p in (place[d] for d in docs)]


def scaled(row: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The values of a document's indicators, scaled by their ratios and to unit length."""
    x = r[row]
    return x / max(np.sqrt(x @ x), 1e-12)


def fit_hinge(rows: list[np.ndarray], sign: np.ndarray, r: np.ndarray, spec: NbSvmSpec) -> tuple[np.ndarray, float]:
    """Weights on scaled indicators and a bias that is penalised like a weight.

    Dual coordinate descent on the hinge loss: a document's multiplier moves to the
    least of the dual along it, within 0 and its cost; classes cost the same in total.
    """
    w, b = np.zeros(len(r)), 0.0
    values = [scaled(row, r) for row in rows]
    share = {s: max((sign == s).mean(), 1e-9) for s in (-1.0, 1.0)}
    most = np.array([spec.cost * 0.5 / share[s] for s in sign])
    norm = np.array([v @ v + 1.0 for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(spec.seed)
    for _ in range(spec.epochs):
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


@dataclass
class NbSvmModel:
    """Ratios and weights of ``bins``, a bias, and the logistic that turns a margin into a score."""

    spec: NbSvmSpec
    bins: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 0.0
    offset: float = 0.0

    def margin(self, row: np.ndarray) -> float:
        return float(self.bias + self.weights[row] @ scaled(row, self.ratios))

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.offset, -30, 30))))


def _margins(docs: list[np.ndarray], sign: np.ndarray, spec: NbSvmSpec) -> NbSvmModel:
    """The model without its logistic. Weights are drawn to their mean size, as the dealt method's interpolation asks."""
    bins, r = log_count_ratios(docs, sign, spec)
    w, b = fit_hinge(placed(docs, bins, spec.bins), sign, r, spec)
    even = np.abs(w[w != 0]).mean() if w.any() else 0.0
    w = np.where(w != 0, (1 - spec.blend) * even + spec.blend * w, 0.0)
    # the model goes to every worker, so single precision from here
    return NbSvmModel(spec, bins.astype(np.int32), r.astype(np.float32), w.astype(np.float32), spec.blend * b)


def fit_nbsvm(docs: list[np.ndarray], y: np.ndarray, spec: NbSvmSpec) -> NbSvmModel:
    """Fit ratios, support vectors and the logistic; without labels of both kinds it answers with their share."""
    if len(y) < 2 * spec.folds or len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return NbSvmModel(spec, np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    sign = np.where(y > 0, 1.0, -1.0)
    fold, margins = np.random.default_rng(spec.seed).permutation(len(y)) % spec.folds, np.zeros(len(y))
    for k in range(spec.folds):
        part = _margins([d for d, f in zip(docs, fold, strict=True) if f != k], sign[fold != k], spec)
        held = np.flatnonzero(fold == k)
        margins[held] = [part.margin(row) for row in placed([docs[i] for i in held], part.bins, spec.bins)]
    model = _margins(docs, sign, spec)
    model.slope, model.offset = fit_logistic(margins, y)
    return model


def train(docs: DataFrame, labels: DataFrame, spec: NbSvmSpec, label: str = "quality", text: str = "text", key: str = "doc_id") -> NbSvmModel:
    """Fit on a bounded sample: tasks turn whole texts into bins, the driver fits ``spec.sample`` rows at most."""
    small_batches(docs.sparkSession)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(spec)
        for batch in batches:
            packed = [grams.present(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("label")], names=["bins", "label"])

    sample = training_rows(docs, labels, label, spec.sample, text, key).mapInArrow(bins, "bins binary, label int").collect()
    # an order of the rows' own, so that fits agree whichever task came first
    rows = sorted((int(r["label"]), bytes(r["bins"])) for r in sample)
    return fit_nbsvm([np.frombuffer(b, np.int32) for _, b in rows], np.array([y for y, _ in rows], float), spec)


def score_documents(docs: DataFrame, model: NbSvmModel, text: str = "text") -> DataFrame:
    """Add qc_score in [0, 1] to every row, from its whole text; null counts as empty.

    A text without known n-grams, such as an empty one, gets the score of the bias.
    Rows are independent: repeated rows score alike and an empty table stays empty. A
    column qc_score of the input is replaced; other names may clash with nothing.
    """
    small_batches(docs.sparkSession)

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = NGrams(model.spec)
        place = np.full(model.spec.bins, -1, np.int32)
        place[model.bins] = np.arange(len(model.bins))
        for texts in batches:
            rows = (place[grams.present(t.as_py())] for t in texts)
            yield pa.array([model.score(row[row >= 0]) for row in rows], pa.float64())

    return docs.withColumn("qc_score", scores(F.col(f"`{text}`")))
