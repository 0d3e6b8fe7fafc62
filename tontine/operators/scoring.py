"""Scorers and the exposure-weighted pool score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import quality

# A scorer adds PROBABILITY to a table of contract features. Spark ML models, scorecards
# and constants all fit this shape, so monitors and gates take any of them.
Scorer = Callable[[DataFrame], DataFrame]


def constant_scorer(probability: float) -> Scorer:
    return lambda df: df.withColumn(S.PROBABILITY, F.lit(float(probability)))


def scorecard_scorer(weights: dict[str, float], intercept: float) -> Scorer:
    quality.guard_leakage(list(weights))
    return lambda df: df.withColumn(S.PROBABILITY, X.scorecard(weights, intercept))


def model_inputs(df: DataFrame) -> DataFrame:
    """Model input columns with every categorical (the pool id too) as a string."""
    quality.expect_columns(df, S.MODEL_INPUTS, "model input")
    return df.withColumns({c: F.col(c).cast("string") for c in S.MODEL_CATEGORICAL})


def contract_predictions(scored: DataFrame) -> DataFrame:
    return scored.select("IDpol", "pool_id", "Exposure", S.TARGET, S.PROBABILITY)


def pool_risk_scores(scored: DataFrame, by: str = "pool_id") -> DataFrame:
    """Exposure-weighted mean probability; the plain mean where the exposure is zero.

    Used for whole-table scoring, for micro-batches and for scoring requests alike.
    """
    totals = scored.groupBy(F.col(by).cast("string").alias(by)).agg(
        F.count(F.lit(1)).alias("pool_contract_count"),
        F.sum("Exposure").alias("pool_scored_exposure"),
        F.sum(F.col(S.PROBABILITY) * F.col("Exposure")).alias("_weighted"),
        F.avg(S.PROBABILITY).alias("mean_probability"),
    )
    weighted = F.col("pool_scored_exposure") > 0
    return totals.select(
        by,
        "pool_contract_count",
        "pool_scored_exposure",
        F.when(weighted, F.try_divide("_weighted", "pool_scored_exposure"))
        .otherwise(F.col("mean_probability"))
        .alias("pool_risk_score"),
        X.weighting_method("pool_scored_exposure").alias("pool_score_weighting_method"),
        "mean_probability",
    )


def assemble_pool_scores(pools: DataFrame, scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Every known pool with its score and observed rate; an unscored pool keeps nulls."""
    ids = pools.select(F.col("pool_id").cast("string").alias("pool_id"))
    rates = targets.select(F.col("pool_id").cast("string").alias("pool_id"), "pool_claim_rate")
    return ids.join(scores.drop("mean_probability"), "pool_id", "left").join(rates, "pool_id", "left")


def score_coverage(pool_scores: DataFrame) -> DataFrame:
    """Share of pools with a score; only full coverage passes."""
    return pool_scores.agg(
        F.count(F.lit(1)).alias("pool_input_rows"),
        F.count("pool_risk_score").alias("pool_score_rows"),
        F.avg(F.col("pool_risk_score").isNotNull().cast("double")).alias("pool_score_coverage"),
        F.count_if(F.col("pool_score_weighting_method") == "unweighted_zero_exposure_fallback").alias(
            "zero_exposure_pools"
        ),
    ).withColumn("coverage_passed", F.col("pool_score_coverage") == 1.0)
