"""Leak-free contract and pool features, and their targets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import quality
from tontine.operators.cleaning import AMOUNTS

_STD_SOURCES = {
    "veh_power": "VehPower",
    "veh_age": "VehAge",
    "driv_age": "DrivAge",
    "bonus_malus": "BonusMalus",
    "density": "Density",
    "density_log1p": "Density_log1p",
}


class FeatureTables(NamedTuple):
    contract_features: DataFrame
    contract_targets: DataFrame
    pool_features: DataFrame
    pool_targets: DataFrame
    report: DataFrame


def with_derived(policies: DataFrame) -> DataFrame:
    """``Density_log1p`` and the four fixed bands."""
    derived = {"Density_log1p": X.density_log1p()}
    derived.update({name: X.named_band(name) for name in S.BANDS})
    return policies.withColumns(derived)


def contract_features(policies: DataFrame) -> DataFrame:
    """Ordered feature columns; the same function serves training, batches and scoring.

    Columns a scoring request does not carry (the policy id) are left out.
    """
    quality.expect_columns(policies, S.SERVING_COLUMNS, "contract input")
    derived = with_derived(policies)
    return derived.select(*(c for c in S.CONTRACT_FEATURES if c in derived.columns))


def severity_aggregates(claims: DataFrame) -> DataFrame:
    return claims.groupBy("IDpol").agg(
        F.sum("ClaimAmount").alias("target_total_claim_amount"),
        F.avg("ClaimAmount").alias("target_avg_claim_amount"),
    )


def contract_targets(policies: DataFrame, claims: DataFrame | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One outcome row per policy; ``keep`` carries policy columns along for a rollup.

    Without claims the amounts are those the policies already carry, or zero.
    """
    count = F.col("ClaimNb").cast("bigint")
    if claims is None and set(AMOUNTS) <= set(policies.columns):
        joined = policies
    elif claims is None:
        joined = policies.withColumns(
            {
                "target_total_claim_amount": F.lit(None).cast("double"),
                "target_avg_claim_amount": F.lit(None).cast("double"),
            }
        )
    else:
        joined = policies.join(severity_aggregates(claims), "IDpol", "left")
    return joined.select(
        "IDpol",
        *keep,
        count.alias("target_claim_count"),
        X.indicator(count).alias("target_has_claim"),
        X.guarded_ratio(count, "Exposure").alias("target_claim_frequency"),
        X.fill_zero("target_total_claim_amount").alias("target_total_claim_amount"),
        X.fill_zero("target_avg_claim_amount").alias("target_avg_claim_amount"),
    )


def pool_features(policies: DataFrame) -> DataFrame:
    """Size, exposure, mean and sample deviation of the numerics, category diversity."""
    derived = policies.withColumn("Density_log1p", X.density_log1p())
    moments = []
    for suffix, source in _STD_SOURCES.items():
        moments.append(F.avg(source).alias(f"pool_mean_{suffix}"))
        moments.append(X.fill_zero(F.stddev_samp(source)).alias(f"pool_std_{suffix}"))
    diversity = [
        F.count_distinct(source).alias(name)
        for name, source in (
            ("pool_veh_brand_diversity", "VehBrand"),
            ("pool_veh_gas_diversity", "VehGas"),
            ("pool_area_diversity", "Area"),
            ("pool_region_diversity", "Region"),
        )
    ]
    return derived.groupBy("pool_id").agg(
        F.count(F.lit(1)).alias("pool_size"),
        F.sum("Exposure").alias("pool_total_exposure"),
        F.avg("Exposure").alias("pool_mean_exposure"),
        *moments,
        *diversity,
    )


def pool_targets(policies: DataFrame, claims: DataFrame | None) -> DataFrame:
    """Outcome totals per pool.

    Policies carry a unique key (checked at ingestion), so the contract targets roll up
    directly instead of being joined back to the policies a second time.
    """
    return rollup_targets(contract_targets(policies, claims, keep=("pool_id", "Exposure")))


def rollup_targets(per_policy: DataFrame) -> DataFrame:
    """Pool targets from contract targets that carry their pool and exposure."""
    totals = per_policy.groupBy("pool_id").agg(
        F.sum("target_claim_count").alias("pool_claim_count"),
        F.sum("Exposure").alias("pool_total_exposure"),
        F.sum("target_total_claim_amount").alias("pool_total_claim_amount"),
    )
    return totals.select(
        "pool_id",
        "pool_claim_count",
        X.indicator("pool_claim_count").alias("pool_has_claim"),
        X.guarded_ratio("pool_claim_count", "pool_total_exposure").alias("pool_claim_rate"),
        "pool_total_claim_amount",
        X.guarded_ratio("pool_total_claim_amount", "pool_claim_count").alias("pool_avg_claim_amount"),
    )


def feature_report(policies: DataFrame, claims: DataFrame | None) -> DataFrame:
    per_pool = policies.groupBy("pool_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Exposure") == 0).alias("zero_rows"),
        F.sum("Exposure").alias("exposure"),
    )
    severity_rows = F.lit(None).cast("bigint") if claims is None else claims.agg(F.count(F.lit(1))).scalar()
    return per_pool.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("frequency_input_rows"),
        F.coalesce(F.sum("zero_rows"), F.lit(0)).cast("bigint").alias("zero_exposure_contract_rows"),
        F.count_if(F.col("exposure") == 0).alias("zero_exposure_pools"),
        F.count(F.lit(1)).alias("number_of_pools"),
    ).withColumns({"severity_input_rows": severity_rows, "severity_input_used": F.lit(claims is not None)})


def build_features(policies: DataFrame, claims: DataFrame | None) -> FeatureTables:
    """Checked form: inputs must be complete, non-empty and free of nulls."""
    required = ("IDpol", "ClaimNb", *S.SERVING_COLUMNS)
    quality.expect_columns(policies, required, "policies")
    quality.expect_rows(policies, "policies")
    quality.expect_no_nulls(policies, required, "policies")
    if claims is not None:
        quality.expect_columns(claims, ("IDpol", "ClaimAmount"), "claims")
    return FeatureTables(
        contract_features(policies),
        contract_targets(policies, claims),
        pool_features(policies),
        pool_targets(policies, claims),
        feature_report(policies, claims),
    )
