"""Numbered batches of a policy stream and what-if rewrites of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.functions.hashing import leading_int, seeded_md5
from tontine.operators import quality
from tontine.operators.ordering import hash_index, hash_limits

STREAM_METADATA = (
    "batch_id",
    "event_index",
    "simulated_time_step",
    "data_drift_injected",
    "concept_drift_injected",
)


def join_targets(features: DataFrame, targets: DataFrame, check: bool = True) -> DataFrame:
    """Features with their outcomes; both sides must hold the same unique keys."""
    if check:
        quality.expect_one_to_one(features, targets, "IDpol", "contract features and targets")
    return features.join(targets, "IDpol")


def equal_batch(index: Column, total: Column, n_batches: int) -> Column:
    """Contiguous batches whose sizes differ by at most one, the larger ones first."""
    size = F.floor(total / n_batches)
    larger = total % n_batches
    edge = larger * (size + 1)
    return (
        F.when(index < edge, F.floor(index / (size + 1)))
        .otherwise(larger + F.floor(F.try_divide(index - edge, size)))
        .cast("int")
    )


def assign_batches(df: DataFrame, n_batches: int = S.N_BATCHES, seed: int = S.SEED) -> DataFrame:
    """Seeded shuffle by key hash, 0-based event index and batch number."""
    indexed = hash_index(df, "IDpol", seed, out="event_index", total="_n")
    return indexed.withColumns(
        {
            "simulated_time_step": F.col("event_index"),
            "batch_id": equal_batch(F.col("event_index"), F.col("_n"), n_batches),
        }
    ).drop("_n")


def with_batch_id(df: DataFrame, n_batches: int = S.N_BATCHES, seed: int = S.SEED) -> DataFrame:
    """The batch number of ``assign_batches`` without the index: no row is shuffled.

    The first row of each batch in hash order is looked up once; a row's batch follows from its own hash.
    """

    def starts(rows: Column) -> Column:
        size, larger = F.floor(rows / n_batches), rows % n_batches
        return F.transform(F.sequence(F.lit(1), F.lit(n_batches)), lambda b: b * size + F.least(b, larger))

    limits = hash_limits(df, "IDpol", seed, starts)
    if not limits:
        return df.withColumn("batch_id", F.lit(0))
    # An array of limits: written out as conditions, the row's code would be too long to be compiled.
    known = F.array(*(F.struct(F.lit(digest).alias("digest"), F.lit(key).cast(df.schema["IDpol"].dataType).alias("key")) for _, digest, key in limits))
    hashed = df.withColumn("_hash", seeded_md5("IDpol", seed))
    reached = lambda x: (x["digest"] < F.col("_hash")) | ((x["digest"] == F.col("_hash")) & (x["key"] <= F.col("IDpol")))
    return hashed.withColumn("batch_id", F.size(F.filter(known, reached))).drop("_hash")


def rewrite_features(df: DataFrame, start_batch: int = S.DATA_DRIFT_START) -> DataFrame:
    """High-density rows from ``start_batch`` on get a higher density; band test is pre-change."""
    hit = (F.col("batch_id") >= start_batch) & X.high_density()
    density = F.when(hit, F.col("Density") * S.DENSITY_FACTOR).otherwise(F.col("Density").cast("double"))
    return df.withColumns(
        {
            "Density": density,
            "Density_log1p": F.when(hit, X.density_log1p(density)).otherwise(F.col("Density_log1p")),
            "Density_band": F.when(hit, X.named_band("Density_band", density)).otherwise(F.col("Density_band")),
            "data_drift_injected": hit,
        }
    )


def _concept_hit(start_batch: int) -> Column:
    return (F.col("batch_id") >= start_batch) & X.high_bonus_malus()


def rewrite_counts(df: DataFrame, start_batch: int = S.CONCEPT_DRIFT_START) -> DataFrame:
    """High bonus-malus rows from ``start_batch`` on get one more claim (up to the cap), and their indicator anew."""
    hit = _concept_hit(start_batch)
    grows = hit & (F.col("target_claim_count") < S.CLAIM_COUNT_CAP)
    count = F.col("target_claim_count") + F.when(grows, 1).otherwise(0).cast("bigint")
    return df.withColumns(
        {
            "concept_drift_injected": hit,
            "target_claim_count": count,
            "target_has_claim": F.when(hit, X.indicator(count)).otherwise(F.col("target_has_claim")),
        }
    )


def draw_severity(
    df: DataFrame, needs: Column, seed: int = S.SEED, fallback: float = S.FALLBACK_SEVERITY
) -> DataFrame:
    """Add ``added_severity``: a draw with replacement from all positive average severities.

    The positive values are numbered in hash order; a row draws the number its own hash
    gives. Only rows that need a draw are shuffled. Where few values exist their table is
    small and adaptive execution broadcasts it; where many exist the draws are uniform.
    """
    values = df.filter(F.col("target_avg_claim_amount") > 0).select("IDpol", "target_avg_claim_amount")
    numbered = hash_index(values, "IDpol", seed, out="_draw").select(
        "_draw", F.col("target_avg_claim_amount").alias("_value")
    )
    n_values = F.nullif(values.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    draw = F.pmod(leading_int(seeded_md5("IDpol", seed + 1), 15), n_values)
    drawn = (
        df.filter(needs)
        .withColumn("_draw", draw)
        .join(numbered, "_draw", "left")
        .withColumn("added_severity", F.coalesce("_value", F.lit(fallback)))
        .drop("_draw", "_value")
    )
    rest = df.filter(~F.coalesce(needs, F.lit(False))).withColumn("added_severity", F.lit(0.0))
    return drawn.unionByName(rest)


def rewrite_targets(
    df: DataFrame, start_batch: int = S.CONCEPT_DRIFT_START, seed: int = S.SEED
) -> DataFrame:
    """High bonus-malus rows from ``start_batch`` on get one more claim (up to the cap).

    Indicator, frequency and average are recomputed for every hit row, capped or not.
    """
    hit = _concept_hit(start_batch)
    grows = hit & (F.col("target_claim_count") < S.CLAIM_COUNT_CAP)
    drawn = draw_severity(df, grows, seed)
    counted = rewrite_counts(drawn, start_batch).withColumn(
        "target_total_claim_amount", F.col("target_total_claim_amount") + F.col("added_severity")
    )
    flag = F.col("concept_drift_injected")

    def recomputed(name: str, value: Column) -> Column:
        return F.when(flag, value).otherwise(F.col(name))

    return counted.withColumns(
        {
            "target_claim_frequency": recomputed(
                "target_claim_frequency", X.guarded_ratio("target_claim_count", "Exposure")
            ),
            "target_avg_claim_amount": recomputed(
                "target_avg_claim_amount",
                X.guarded_ratio("target_total_claim_amount", "target_claim_count"),
            ),
        }
    )


def replay(
    features: DataFrame,
    targets: DataFrame,
    n_batches: int = S.N_BATCHES,
    seed: int = S.SEED,
    data_start: int = S.DATA_DRIFT_START,
    concept_start: int = S.CONCEPT_DRIFT_START,
    check: bool = True,
) -> DataFrame:
    """Batched stream with both rewrites applied in one pass over all batches.

    ``check=False`` skips the count and one-to-one jobs for inputs already checked.
    """
    if check:
        guard_rows = features.count()
        quality.guard_batches(n_batches, guard_rows, data_start, concept_start)
    joined = join_targets(features, targets, check)
    batched = assign_batches(joined, n_batches, seed)
    return rewrite_targets(rewrite_features(batched, data_start), concept_start, seed)


def batch_report(stream: DataFrame) -> DataFrame:
    """Per batch: rows, rewritten rows by kind, added severity, zero-exposure rewrites."""
    data, concept = F.col("data_drift_injected"), F.col("concept_drift_injected")
    return stream.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(data).alias("data_drift_rows"),
        F.count_if(concept).alias("concept_drift_rows"),
        F.count_if(data & concept).alias("overlap_rows"),
        F.sum("added_severity").alias("added_severity"),
        F.count_if(concept & (F.col("Exposure") == 0)).alias("zero_exposure_concept_rows"),
    )


def stream_report(report: DataFrame) -> DataFrame:
    """Totals and batch-size statistics over the per-batch report."""
    total = lambda c: F.sum(c).cast("bigint")
    return report.agg(
        F.count(F.lit(1)).alias("n_batches"),
        total("row_count").alias("joined_rows"),
        F.min("row_count").alias("batch_size_min"),
        F.max("row_count").alias("batch_size_max"),
        F.avg("row_count").alias("batch_size_mean"),
        total("data_drift_rows").alias("data_drift_rows"),
        total("concept_drift_rows").alias("concept_drift_rows"),
        total("overlap_rows").alias("overlap_rows"),
        F.sum("added_severity").alias("total_synthetic_severity_added"),
        total("zero_exposure_concept_rows").alias("zero_exposure_rows_during_concept_recompute"),
    )


def ground_truth(
    report: DataFrame,
    data_start: int = S.DATA_DRIFT_START,
    concept_start: int = S.CONCEPT_DRIFT_START,
) -> DataFrame:
    """Which batches carry injected drift, as one row."""
    n = F.col("n_batches")
    return stream_report(report).select(
        F.col("n_batches").cast("int").alias("n_batches"),
        F.lit(data_start).alias("data_start_batch"),
        F.lit(concept_start).alias("concept_start_batch"),
        (F.greatest(F.lit(data_start), F.lit(concept_start)) < n).alias("overlap_intentional"),
        X.overlap_start(F.lit(data_start), F.lit(concept_start), n).cast("int").alias("overlap_batch_start"),
        X.overlap_end(F.lit(data_start), F.lit(concept_start), n).cast("int").alias("overlap_batch_end"),
        "data_drift_rows",
        "concept_drift_rows",
        "overlap_rows",
    )


def sliding_windows(triggers: DataFrame, stream: DataFrame, width: int = S.WINDOW_BATCHES) -> DataFrame:
    """Stream rows in the last ``width`` batches up to each trigger, tagged with it.

    The trigger is expanded to its batch numbers first, so the row join is an equi-join
    on ``batch_id`` and prunes batch partitions; there are at most as many triggers as
    batches.
    """
    window = triggers.select(
        "trigger_batch",
        F.explode(F.sequence(F.greatest(F.col("trigger_batch") - width + 1, F.lit(0)), "trigger_batch")).alias(
            "batch_id"
        ),
    )
    return stream.join(window, "batch_id")
