"""Exact-size samples and splits by key hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tontine import schemas as S
from tontine.operators.ordering import hash_index, hash_sample, hash_sample_flag


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = S.SEED) -> DataFrame:
    """``min(n, rows)`` distinct rows."""
    return hash_sample(df, key, seed, lambda rows: F.least(rows, F.lit(n)))


def replay_sample(df: DataFrame, fraction: float = S.REPLAY_FRACTION, seed: int = S.SEED, key: str = "IDpol") -> DataFrame:
    """Exactly ``round(fraction * rows)`` rows, halves to even."""
    return hash_sample(df, key, seed, lambda rows: F.bround(rows.cast("double") * fraction).cast("bigint"))


def stratified_split(
    df: DataFrame, label: str = S.TARGET, fraction: float = S.TEST_FRACTION, seed: int = S.SEED, key: str = "IDpol"
) -> DataFrame:
    """Add ``is_test`` with exact class proportions.

    The flag is a pure function of the key set, so the gate and the retraining see the
    same holdout as the training run; store it with the data all the same.
    """
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy(F.lit(0))
    n = F.sum("_c").over(everything)
    train = n - F.ceil(n.cast("double") * fraction)
    share = F.col("_c").cast("double") * F.col("_train") / F.col("_n")
    order = everything.orderBy(F.desc(F.col("_share") - F.floor("_share")), label)
    quotas = (
        classes.select(label, "_c", n.alias("_n"), train.alias("_train"))
        .withColumn("_share", share)
        .withColumn("_left", F.col("_train") - F.sum(F.floor("_share")).over(everything))
        .select(
            label,
            (
                F.col("_c") - F.floor("_share") - F.when(F.row_number().over(order) <= F.col("_left"), 1).otherwise(0)
            )
            .cast("bigint")
            .alias("_quota"),
        )
    )
    # Labels are the classes of a classifier: a handful of rows.
    with_quota = df.join(F.broadcast(quotas), label)
    flagged = hash_sample_flag(
        with_quota, key, seed, lambda rows: F.col("_quota"), "is_test", strata=(label, "_quota")
    )
    return flagged.select(*df.columns, "is_test")


def stratified_folds(
    df: DataFrame, folds: int, label: str = S.TARGET, seed: int = S.SEED, key: str = "IDpol"
) -> DataFrame:
    """Add ``fold`` so that every class is spread over the folds as evenly as possible."""
    indexed = hash_index(df, key, seed, out="_position", strata=(label,))
    return indexed.withColumn("fold", (F.col("_position") % folds).cast("int")).drop("_position")
