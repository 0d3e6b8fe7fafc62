"""Cleaning of policies and claims, with audit counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import quality


class Cleaned(NamedTuple):
    frequency: DataFrame
    severity: DataFrame
    report: DataFrame


def matched_claims(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims whose policy exists."""
    return claims.join(policies.select("IDpol"), "IDpol", "left_semi")


def orphan_claims(claims: DataFrame, policies: DataFrame) -> DataFrame:
    """Claims whose policy does not exist; a claim without a key is an orphan."""
    return claims.join(policies.select("IDpol"), "IDpol", "left_anti")


def claims_per_policy(claims: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Claims counted per policy; with ``policies`` only those of policies that exist."""
    if policies is not None:
        claims = matched_claims(claims, policies)
    return claims.groupBy("IDpol").agg(F.count(F.lit(1)).alias("observed_claims"))


AMOUNTS = ("target_total_claim_amount", "target_avg_claim_amount")


def claims_and_amounts(claims: DataFrame) -> DataFrame:
    """Count, total and mean amount of claims per policy in one aggregate."""
    return claims.groupBy("IDpol").agg(
        F.count(F.lit(1)).alias("observed_claims"),
        F.sum("ClaimAmount").alias(AMOUNTS[0]),
        F.avg("ClaimAmount").alias(AMOUNTS[1]),
    )


def _with_observed(policies: DataFrame, claims: DataFrame, amounts: bool = False) -> DataFrame:
    # Claims are counted per policy before the join: orphans find no policy and drop out,
    # and a policy with very many claims meets the join as a single row.
    per_policy = claims_and_amounts(claims) if amounts else claims_per_policy(claims)
    return policies.join(per_policy, "IDpol", "left").withColumn(
        "observed_claims", F.coalesce("observed_claims", F.lit(0)).cast("bigint")
    )


def _clean(reconciled: DataFrame) -> DataFrame:
    columns = {
        "ClaimNb_declared": F.col("ClaimNb"),
        "ClaimNb": X.cap_upper("observed_claims", S.CLAIM_COUNT_CAP).cast("bigint"),
        "Exposure": X.cap_upper("Exposure", S.EXPOSURE_CAP),
    }
    for name in S.CATEGORICAL_ATTRIBUTES:
        if name in reconciled.columns:
            columns[name] = F.col(name).cast("string")
    return reconciled.withColumns(columns).drop("observed_claims")


def clean_policies(policies: DataFrame, claims: DataFrame, amounts: bool = False) -> DataFrame:
    """Claim counts replaced by matched counts (capped), exposure capped, declared count kept.

    With ``amounts`` the claim totals ride along, for targets built from the same claims.
    """
    return _clean(_with_observed(policies, claims, amounts))


def cleaning_report(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Audit counts as one row. Mismatch and cap counts refer to values before the caps."""
    reconciled = _with_observed(policies, claims)
    counts = reconciled.agg(
        F.count(F.lit(1)).alias("frequency_rows_before"),
        F.count(F.lit(1)).alias("frequency_rows_after"),
        F.coalesce(F.sum("observed_claims"), F.lit(0)).cast("bigint").alias("severity_rows_after"),
        F.count_if(F.coalesce(F.col("ClaimNb") != F.col("observed_claims"), F.lit(True))).alias(
            "claimnb_mismatched_policies"
        ),
        F.count_if(F.col("Exposure") > S.EXPOSURE_CAP).alias("exposure_values_capped"),
        F.count_if(F.col("observed_claims") > S.CLAIM_COUNT_CAP).alias("claimnb_values_capped"),
    )
    before = claims.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("severity_rows_before", before).withColumn(
        "unmatched_severity_rows_dropped", F.col("severity_rows_before") - F.col("severity_rows_after")
    )


def clean(policies: DataFrame, claims: DataFrame) -> Cleaned:
    return Cleaned(
        clean_policies(policies, claims),
        matched_claims(claims, policies),
        cleaning_report(policies, claims),
    )


def ingestion_report(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Row counts, column lists and duplicate policy keys of the two raw tables."""
    duplicates = quality.duplicate_key_count(policies, "IDpol")
    return duplicates.select(
        F.col("row_count").alias("frequency_rows"),
        claims.agg(F.count(F.lit(1))).scalar().alias("severity_rows"),
        F.lit(",".join(policies.columns)).alias("frequency_columns"),
        F.lit(",".join(claims.columns)).alias("severity_columns"),
        F.col("duplicate_count").alias("duplicate_frequency_idpol_count"),
    )
