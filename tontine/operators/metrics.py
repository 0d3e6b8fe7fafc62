"""Discrimination, calibration and acceptance of scored contracts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators.ordering import rank_statistic
from tontine.operators.reports import side_by_side
from tontine.sources.shared import spool


def roc_auc(df: DataFrame, label: str = S.TARGET, score: str = S.PROBABILITY) -> DataFrame:
    """Exact tie-aware area under the ROC curve; null where one class is absent."""
    sums = rank_statistic(df, score, F.col(label) == 1)
    return sums.select(
        F.try_divide("u", F.col("positives").cast("double") * F.col("negatives")).alias("auc"),
        "positives",
        "negatives",
    )


def calibration_bin(probability: Column, bins: int = S.CALIBRATION_BINS) -> Column:
    """Right-closed equal-width bins: number of interior edges strictly below the value."""
    edges = [float(edge) for edge in np.linspace(0.0, 1.0, bins + 1)[1:-1]]
    count = F.lit(0)
    for edge in edges:
        count = count + F.when(probability > F.lit(edge), 1).otherwise(0)
    return count


def calibration_table(df: DataFrame, label: str = S.TARGET, score: str = S.PROBABILITY, bins: int = S.CALIBRATION_BINS) -> DataFrame:
    p, y = F.col(score), F.col(label).cast("double")
    return df.groupBy(calibration_bin(p, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("sum_y"),
        F.sum(p).alias("sum_p"),
        F.sum((p - y) * (p - y)).alias("sum_sq"),
    )


def calibration_metrics(df: DataFrame, label: str = S.TARGET, score: str = S.PROBABILITY, bins: int = S.CALIBRATION_BINS) -> DataFrame:
    """Brier score, expected calibration error and rate delta from one pass of bin sums."""
    per_bin = calibration_table(df, label, score, bins)
    n = F.sum("n")
    return per_bin.agg(
        n.cast("bigint").alias("n_rows"),
        (F.sum("sum_sq") / n).alias("brier_score"),
        # (n_b / n) * |mean_y - mean_p| = |sum_y - sum_p| / n
        (F.sum(F.abs(F.col("sum_y") - F.col("sum_p"))) / n).alias("expected_calibration_error"),
        (F.sum("sum_y") / n).alias("test_empirical_claim_rate"),
        (F.sum("sum_p") / n).alias("test_mean_predicted_probability"),
        F.abs((F.sum("sum_p") - F.sum("sum_y")) / n).alias("test_probability_rate_delta"),
    )


def model_metrics(test: DataFrame, label: str = S.TARGET, score: str = S.PROBABILITY) -> DataFrame:
    """One row with every holdout metric; the constant baseline ties all scores, so 0.5.

    Labels and scores are written once: counting, ranking and calibrating each read these two columns only.
    """
    held = spool(test.select(label, score), "held-out")
    auc = roc_auc(held, label, score)
    calibration = calibration_metrics(held, label, score)
    joined = side_by_side(auc, calibration)
    return joined.withColumn(
        "baseline_auc", F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.lit(0.5))
    ).select(
        "n_rows",
        F.col("auc").alias("model_auc"),
        "baseline_auc",
        X.normalized_gini("auc").alias("model_normalized_gini"),
        X.normalized_gini("baseline_auc").alias("baseline_normalized_gini"),
        "brier_score",
        "expected_calibration_error",
        "test_empirical_claim_rate",
        "test_mean_predicted_probability",
        "test_probability_rate_delta",
    )


def class_counts(df: DataFrame, split: str = "is_test", label: str = S.TARGET) -> DataFrame:
    """Rows and positives of each split and of the whole."""
    return (
        df.rollup(F.when(F.col(split), F.lit("test")).otherwise(F.lit("train")).alias("split"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col(label)).cast("bigint").alias("positive_rows"))
        .withColumn("split", F.coalesce("split", F.lit("all")))
    )


def anomaly_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("anomaly_rows"),
        F.coalesce(F.sum("anomaly_flag"), F.lit(0)).cast("bigint").alias("anomaly_count"),
        F.avg("anomaly_flag").alias("anomaly_rate"),
    )


def accepted(metrics: DataFrame, coverage: DataFrame) -> DataFrame:
    """Metrics joined with coverage and the acceptance verdict."""
    return side_by_side(metrics, coverage).withColumn(
        "acceptance_passed",
        F.coalesce(
            (F.col("model_auc") > F.col("baseline_auc"))
            & (F.col("model_normalized_gini") > F.col("baseline_normalized_gini"))
            & (F.col("pool_score_coverage") == 1.0),
            F.lit(False),
        ),
    )
