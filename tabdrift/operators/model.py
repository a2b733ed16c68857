"""Models fitted once on baseline data and applied to baseline and evolved data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ridge(train: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> dict[str, float]:
    """Weights and intercept of the ridge regression, intercept not penalised.

    The normal equations need only sums of products, one row of a map-side aggregation;
    the small system is solved where the plan is built. For a few number columns; ``fit`` has the sparse
    form. Rows with a null or NaN in a feature or the label are left out of all sums.
    """
    names, kinds = [*features, label], dict(train.dtypes)
    filled = F.lit(True)
    for c in names:
        filled = filled & F.col(f"`{c}`").isNotNull() & (~F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(True))
    train = train.filter(filled).select(*(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(names)))
    places = {c: f"x{i}" for i, c in enumerate(names)}
    sums = [F.count("*").cast("double").alias("n"), *(F.avg(places[c]).alias(f"m_{c}") for c in names)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = train.agg(*sums, *(F.covar_pop(places[a], places[b]).alias(f"c_{a}_{b}") for a, b in pairs)).first()
    cov = {(a, b): row[f"c_{a}_{b}"] * row["n"] for a, b in pairs}
    cov |= {(b, a): v for (a, b), v in list(cov.items())}
    gram = np.array([[cov[a, b] for b in features] for a in features]) + alpha * np.eye(len(features))
    w = np.linalg.solve(gram, np.array([cov[a, label] for a in features]))
    out = dict(zip(features, w.tolist(), strict=True))
    return out | {"_intercept": row[f"m_{label}"] - sum(out[f] * row[f"m_{f}"] for f in features)}


def linear_score(weights: dict[str, float]) -> Column:
    """Prediction of a fitted linear model; a null feature makes it null."""
    return sum((F.col(f"`{c}`") * F.lit(w) for c, w in weights.items() if c != "_intercept"), F.lit(weights["_intercept"]))


def score_pair(base: DataFrame, evolved: DataFrame, row_id: str, weights: dict[str, float]) -> DataFrame:
    """Predictions of one model on baseline and evolved rows, joined by row id: row_id, base, evo."""
    a = base.select(row_id, linear_score(weights).alias("base"))
    return a.join(evolved.select(row_id, linear_score(weights).alias("evo")), row_id)


def prediction_summary(predictions: DataFrame, keys: Sequence[str], task_type: str, value: str = "base", probabilities: str = "p_base") -> DataFrame:
    """Regression: mean and population deviation. Classification: mean entropy and mean largest probability."""
    if task_type == "regression":
        return predictions.groupBy(*keys).agg(F.avg(value).alias("base_pred_mean"), F.stddev_pop(value).alias("base_pred_std"))
    p = F.col(probabilities)
    entropy = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return predictions.groupBy(*keys).agg(F.avg(entropy).alias("base_pred_entropy_mean"), F.avg(F.array_max(p)).alias("base_pred_maxprob_mean"))


def logistic(train: DataFrame, features: Sequence[str], label: str, cost: float = 1.0):
    """Logistic regression with L2 penalty 1 / (2 cost) on summed loss, fitted by pyspark.ml; a PipelineModel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = train.count()
    fit = LogisticRegression(labelCol=label, featuresCol="_x", regParam=1.0 / (cost * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=2_000, tol=1e-9)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), fit]).fit(train)

