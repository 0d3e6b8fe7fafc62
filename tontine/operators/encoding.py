"""Feature encoding with statistics of the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tontine import schemas as S
from tontine.operators import quality

FEATURES = "features"


class EncoderError(ValueError):
    """No usable fitted encoder."""


def _standardiser(train: DataFrame, numeric: Sequence[str]) -> SQLTransformer:
    """Centre and scale by the population deviation; a constant column becomes zero."""
    stats = train.agg(
        *(F.avg(c).alias(f"m_{c}") for c in numeric), *(F.stddev_pop(c).alias(f"s_{c}") for c in numeric)
    ).first()
    terms = []
    for c in numeric:
        mean, scale = float(stats[f"m_{c}"]), float(stats[f"s_{c}"]) or 1.0
        terms.append(f"(CAST({c} AS DOUBLE) - {mean!r}D) / {scale!r}D AS {c}_z")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def fit_encoder(
    train: DataFrame,
    numeric: Sequence[str] = S.MODEL_NUMERIC,
    categorical: Sequence[str] = S.MODEL_CATEGORICAL,
) -> PipelineModel:
    """Standardised numerics and one-hot categoricals in one sparse vector.

    A category the training rows did not hold gets the indexer's spare slot, which the
    encoder drops: it encodes to all zeros.
    """
    quality.guard_leakage([*numeric, *categorical])
    quality.expect_columns(train, [*numeric, *categorical], "encoder input")
    indexed = [f"{c}_ix" for c in categorical]
    hot = [f"{c}_hot" for c in categorical]
    stages = [
        _standardiser(train, numeric),
        StringIndexer(
            inputCols=list(categorical),
            outputCols=indexed,
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True, handleInvalid="error"),
        VectorAssembler(inputCols=[*(f"{c}_z" for c in numeric), *hot], outputCol=FEATURES),
    ]
    return Pipeline(stages=stages).fit(train)


def encode(df: DataFrame, encoder: PipelineModel) -> DataFrame:
    """Input columns plus the feature vector; the working columns are dropped."""
    return encoder.transform(df).select(*df.columns, FEATURES)


def frozen_encoder(artifacts: dict[str, PipelineModel | None]) -> PipelineModel:
    """The training encoder, else the anomaly encoder; a stream never refits one."""
    for name in ("feature_encoder", "anomaly_encoder"):
        if artifacts.get(name) is not None:
            return artifacts[name]
    raise EncoderError("the model artifacts hold no fitted encoder")


def z_scores(df: DataFrame, numeric: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Standardised numerics by themselves, as columns."""
    return _standardiser(df, numeric).transform(df).select(*keep, *(f"{c}_z" for c in numeric))
