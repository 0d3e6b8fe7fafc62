"""A candidate classifier updated once per batch by log-loss gradient steps.

The gradient of a batch is an aggregate, so a step is one pass over one batch partition
and the driver holds nothing but the weight vector. The candidate never replaces the
monitored model. This is mini-batch descent, not a per-row one: its path differs from a
sequential learner's while it minimises the same loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tontine import schemas as S
from tontine.functions.scalars import doubles
from tontine.operators import encoding

L2 = 1e-4
STEP = 1.0


@dataclass
class OnlineModel:
    weights: np.ndarray
    intercept: float = 0.0
    steps: int = 0
    history: list[tuple[int, float]] = field(default_factory=list)

    @staticmethod
    def zeros(width: int) -> "OnlineModel":
        return OnlineModel(np.zeros(width))

    def probability(self) -> Column:
        """Probability from the feature vector, evaluated in the JVM."""
        products = F.zip_with(
            vector_to_array(encoding.FEATURES), F.expr(doubles(self.weights)), lambda x, w: x * w
        )
        margin = F.aggregate(products, F.lit(self.intercept), lambda total, term: total + term)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def gradient(encoded: DataFrame, model: OnlineModel) -> tuple[np.ndarray, float, float, int]:
    """Mean gradient, its intercept part, mean log loss and rows.

    The residual p - y is positive for negatives and negative for positives, so the vector
    sums of both classes are weighted means with non-negative weights.
    """
    y = F.col(S.TARGET).cast("double")
    scored = encoded.select(encoding.FEATURES, y.alias("y"), model.probability().alias("p"))
    clipped = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1.0 - 1e-15))
    weighted = scored.withColumn("w", F.abs(F.col("p") - F.col("y"))).withColumn(
        "loss", -(F.col("y") * F.ln(clipped) + (F.lit(1.0) - F.col("y")) * F.ln(F.lit(1.0) - clipped))
    )
    parts = weighted.groupBy("y").agg(
        Summarizer.mean(F.col(encoding.FEATURES), F.col("w")).alias("mean"),
        F.sum("w").alias("weight"),
        F.sum("loss").alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )
    total, bias, loss, rows = np.zeros_like(model.weights), 0.0, 0.0, 0
    for part in parts.collect():
        sign = -1.0 if part["y"] == 1.0 else 1.0
        if part["weight"] > 0:
            total += sign * part["weight"] * part["mean"].toArray()
        bias += sign * part["weight"]
        loss += part["loss"]
        rows += part["n"]
    return total / max(rows, 1), bias / max(rows, 1), loss / max(rows, 1), rows


_gradient = gradient  # its earlier name


def stepped(model: OnlineModel, slope: np.ndarray, bias: float) -> OnlineModel:
    """The model after one descent step."""
    rate = STEP / np.sqrt(1.0 + model.steps)
    weights = model.weights - rate * (slope + L2 * model.weights)
    return OnlineModel(weights, model.intercept - rate * bias, model.steps + 1, model.history)


def partial_fit(encoded: DataFrame, model: OnlineModel, batch_id: int = -1, passes: int = 1) -> OnlineModel:
    """One or more descent steps on the rows of a batch; the step size decays as 1/sqrt(t)."""
    for _ in range(passes):
        slope, bias, loss, rows = gradient(encoded, model)
        if rows == 0:
            return model
        model = stepped(model, slope, bias)
        model.history = [*model.history, (batch_id, loss)]
    return model


def replay_online(encoded_stream: DataFrame, n_batches: int, last_reference: int = S.REFERENCE_LAST_BATCH) -> OnlineModel:
    """Fit on the reference window, then one update per batch in order."""
    first = encoded_stream.select(encoding.FEATURES).first()
    model = OnlineModel.zeros(first[encoding.FEATURES].size)
    model = partial_fit(encoded_stream.filter(F.col("batch_id") <= last_reference), model)
    for batch_id in range(n_batches):
        model = partial_fit(encoded_stream.filter(F.col("batch_id") == batch_id), model, batch_id)
    return model


def state_table(encoded_stream: DataFrame, model: OnlineModel) -> DataFrame:
    """``step, batch_id, log_loss`` before each update."""
    rows = [(i, b, float(loss)) for i, (b, loss) in enumerate(model.history)]
    return encoded_stream.sparkSession.createDataFrame(rows, "step int, batch_id int, log_loss double")
