"""Calibrated claim classifier: L2 logistic regression and sigmoid calibration by folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.operators import encoding, quality, scoring
from tontine.operators.sampling import stratified_folds
from tontine.sources.shared import spool

LABEL = "label"


class TrainingError(ValueError):
    """Training rows do not allow a fit."""


def fit_logistic(
    encoded: DataFrame, rows: int, suffix: str = "", max_iter: int = 1000, inverse_penalty: float = 1.0
) -> LogisticRegressionModel:
    """L2-penalised logistic fit; the penalty is stated per row, as Spark averages the loss."""
    return LogisticRegression(
        featuresCol=encoding.FEATURES,
        labelCol=LABEL,
        maxIter=max_iter,
        regParam=1.0 / (inverse_penalty * rows),
        elasticNetParam=0.0,
        standardization=False,
        rawPredictionCol=f"raw{suffix}",
        probabilityCol=f"prob{suffix}",
        predictionCol=f"pred{suffix}",
    ).fit(encoded)


def fit_platt(held_out: DataFrame, margin: str, positives: int, negatives: int, suffix: str) -> LogisticRegressionModel:
    """Sigmoid on the margin of held-out rows, with smoothed targets.

    A row with target t counts as a positive of weight t and a negative of weight 1 - t.
    """
    high = (positives + 1.0) / (positives + 2.0)
    low = 1.0 / (negatives + 2.0)
    target = F.when(F.col(LABEL) == 1, F.lit(high)).otherwise(F.lit(low))
    doubled = held_out.select(
        margin,
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("y"), target.alias("w")),
                F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - target).alias("w")),
            )
        ).alias("c"),
    ).select(margin, "c.y", "c.w")
    return LogisticRegression(
        featuresCol=margin,
        labelCol="y",
        weightCol="w",
        maxIter=100,
        regParam=0.0,
        rawPredictionCol=f"platt_raw{suffix}",
        probabilityCol=f"calibrated{suffix}",
        predictionCol=f"platt_pred{suffix}",
    ).fit(doubled)


@dataclass(frozen=True)
class ClaimModel:
    """Encoder and classifiers as one pipeline; ``folds`` is 0 where calibration was skipped."""

    pipeline: PipelineModel
    folds: int

    def score(self, df: DataFrame) -> DataFrame:
        inputs = df.withColumns({c: F.col(c).cast("string") for c in S.MODEL_CATEGORICAL})
        scored = self.pipeline.transform(inputs)
        names = [f"calibrated_{i}" for i in range(self.folds)] or ["prob"]
        total = sum((vector_to_array(name)[1] for name in names), F.lit(0.0))
        # Original columns keep their types; the string forms are inputs only.
        kept = [F.col(c).cast(t) if c in S.MODEL_CATEGORICAL else F.col(c) for c, t in df.dtypes]
        return scored.select(
            *(k.alias(c) for k, c in zip(kept, df.columns)), (total / F.lit(float(len(names)))).alias(S.PROBABILITY)
        )

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "ClaimModel":
        pipeline = PipelineModel.load(path)
        folds = sum(
            isinstance(stage, LogisticRegressionModel) and stage.getProbabilityCol().startswith("calibrated_")
            for stage in pipeline.stages
        )
        return ClaimModel(pipeline, folds)

    @property
    def encoder(self) -> PipelineModel:
        return PipelineModel(self.pipeline.stages[:4])


def fit_claim_model(train: DataFrame, folds: int = S.CALIBRATION_FOLDS, seed: int = S.SEED) -> ClaimModel:
    """Fit on training rows: per fold a classifier on the rest and a sigmoid on the fold.

    The encoder is fitted once on all training rows. The encoded rows are written once and
    read by every fit; the loop below runs over folds, never over data.
    """
    inputs = scoring.model_inputs(train).withColumn(LABEL, F.col(S.TARGET).cast("double"))
    counts = {int(r[LABEL]): r["count"] for r in inputs.groupBy(LABEL).count().collect()}
    if set(counts) != {0, 1}:
        raise TrainingError(f"labels 0 and 1 are needed for a fit, found {sorted(counts)}")
    smallest = min(counts.values())
    encoder = encoding.fit_encoder(inputs)
    encoded = encoding.encode(inputs, encoder)
    rows = sum(counts.values())
    if smallest < 2:
        plain = fit_logistic(encoded.select(LABEL, encoding.FEATURES), rows)
        return ClaimModel(PipelineModel([*encoder.stages, plain]), 0)

    k = min(folds, smallest)
    folded = spool(
        stratified_folds(encoded, k, label=LABEL, seed=seed).select(LABEL, "fold", encoding.FEATURES), "folds"
    )
    sizes = {(r["fold"], int(r[LABEL])): r["count"] for r in folded.groupBy("fold", LABEL).count().collect()}
    stages = list(encoder.stages)
    for i in range(k):
        held = {y: sizes.get((i, y), 0) for y in (0, 1)}
        base = fit_logistic(folded.filter(F.col("fold") != i), rows - sum(held.values()), f"_{i}")
        slicer = VectorSlicer(inputCol=f"raw_{i}", outputCol=f"margin_{i}", indices=[1])
        margins = slicer.transform(base.transform(folded.filter(F.col("fold") == i)))
        platt = fit_platt(margins, f"margin_{i}", held[1], held[0], f"_{i}")
        stages += [base, slicer, platt]
    return ClaimModel(PipelineModel(stages), k)


def load_scorer(spark: SparkSession, path: str) -> scoring.Scorer:
    return ClaimModel.load(path).score


def expect_scorer(scored: DataFrame) -> DataFrame:
    return quality.expect_columns(scored, (S.PROBABILITY,), "scorer output")
