"""Cleaning, features, targets, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import cleaning, features, quality, scoring
from tontine.plans import binding as B
from tontine.plans.registry import query, rounded, steps


@query(
    "pool_targets",
    steps("modelling")
    + """SELECT pool_id, CAST(n AS BIGINT) AS pool_claim_count, CAST(n > 0 AS BIGINT) AS pool_has_claim,
       round(CASE WHEN exposure > 0 THEN n / exposure ELSE 0e0 END, 6) AS pool_claim_rate,
       round(total, 4) AS pool_total_claim_amount,
       round(CASE WHEN n > 0 THEN total / n ELSE 0e0 END, 4) AS pool_avg_claim_amount
FROM (SELECT pool_id, sum(target_claim_count) AS n, sum(Exposure) AS exposure, sum(target_total_claim_amount) AS total
      FROM modelling GROUP BY pool_id)""",
)
def pool_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = features.rollup_targets(B.modelling_data(spark, sf_dir))
    return rounded(result, pool_total_claim_amount=4, pool_avg_claim_amount=4)


_POOL_STATS = ",\n".join(
    f"round(avg({source}), 6) AS pool_mean_{name}, round(coalesce(stddev_samp({source}), 0e0), 6) AS pool_std_{name}"
    for name, source in features._STD_SOURCES.items()
)


@query(
    "pool_features",
    steps("derived")
    + f"""SELECT pool_id, count(*) AS pool_size, round(sum(Exposure), 6) AS pool_total_exposure,
       round(avg(Exposure), 6) AS pool_mean_exposure, {_POOL_STATS},
       count(DISTINCT VehBrand) AS pool_veh_brand_diversity, count(DISTINCT VehGas) AS pool_veh_gas_diversity,
       count(DISTINCT Area) AS pool_area_diversity, count(DISTINCT Region) AS pool_region_diversity
FROM derived GROUP BY pool_id""",
)
def pool_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.pool_features(B.cleaned(spark, sf_dir)))


@query(
    "cleaned_policies",
    steps("cleaned")
    + """SELECT IDpol, ClaimNb, ClaimNb_declared, round(Exposure, 6) AS Exposure, VehPower, VehAge, DrivAge, BonusMalus,
       VehBrand, VehGas, Area, round(Density, 6) AS Density, Region, pool_id FROM cleaned""",
)
def cleaned_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.cleaned(spark, sf_dir))


@query(
    "matched_claims",
    steps("policy", "claim")
    + "SELECT IDpol, round(ClaimAmount, 6) AS ClaimAmount FROM claim WHERE IDpol IN (SELECT IDpol FROM policy)",
)
def matched_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.matched_claims(B.claims(spark, sf_dir), B.policies(spark, sf_dir)))


@query(
    "orphan_claims",
    steps("policy", "claim")
    + """SELECT IDpol, round(ClaimAmount, 6) AS ClaimAmount FROM claim c
WHERE NOT EXISTS (SELECT 1 FROM policy p WHERE p.IDpol = c.IDpol)""",
)
def orphan_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.orphan_claims(B.claims(spark, sf_dir), B.policies(spark, sf_dir)))


@query(
    "claims_per_policy",
    steps("policy", "claim")
    + "SELECT IDpol, count(*) AS observed_claims FROM claim WHERE IDpol IN (SELECT IDpol FROM policy) GROUP BY IDpol",
)
def claims_per_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.claims_per_policy(B.claims(spark, sf_dir), B.policies(spark, sf_dir))


@query(
    "severity_aggregates",
    steps("severity")
    + """SELECT IDpol, round(total, 8) AS target_total_claim_amount, round(mean, 8) AS target_avg_claim_amount FROM severity""",
)
def severity_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.severity_aggregates(B.claims(spark, sf_dir)), 8)


@query(
    "cleaning_report",
    steps("reconciled")
    + """SELECT count(*) AS frequency_rows_before, count(*) AS frequency_rows_after,
       CAST(sum(observed) AS BIGINT) AS severity_rows_after,
       count(*) FILTER (WHERE ClaimNb <> observed) AS claimnb_mismatched_policies,
       count(*) FILTER (WHERE Exposure > 1) AS exposure_values_capped,
       count(*) FILTER (WHERE observed > 4) AS claimnb_values_capped,
       (SELECT count(*) FROM claim) AS severity_rows_before,
       CAST((SELECT count(*) FROM claim) - sum(observed) AS BIGINT) AS unmatched_severity_rows_dropped
FROM reconciled""",
)
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.cleaning_report(B.policies(spark, sf_dir), B.claims(spark, sf_dir))


@query(
    "ingestion_report",
    steps("policy", "claim")
    + """SELECT count(*) AS frequency_rows, (SELECT count(*) FROM claim) AS severity_rows,
       'IDpol,ClaimNb,Exposure,VehPower,VehAge,DrivAge,BonusMalus,VehBrand,VehGas,Area,Density,Region,pool_id' AS frequency_columns,
       'IDpol,ClaimAmount' AS severity_columns,
       count(*) - count(DISTINCT IDpol) AS duplicate_frequency_idpol_count
FROM policy""",
)
def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.ingestion_report(B.policies(spark, sf_dir), B.claims(spark, sf_dir))


@query(
    "contract_features",
    steps("derived")
    + """SELECT IDpol, pool_id, round(Exposure, 6) AS Exposure, VehPower, VehAge, DrivAge, BonusMalus,
       round(Density, 6) AS Density, round(Density_log1p, 6) AS Density_log1p, VehBrand, VehGas, Area, Region,
       VehAge_band, DrivAge_band, BonusMalus_band, Density_band FROM derived""",
)
def contract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.contract_features(spark, sf_dir))


@query(
    "contract_targets",
    steps("modelling")
    + """SELECT IDpol, target_claim_count, target_has_claim, round(target_claim_frequency, 6) AS target_claim_frequency,
       round(target_total_claim_amount, 8) AS target_total_claim_amount,
       round(target_avg_claim_amount, 8) AS target_avg_claim_amount FROM modelling""",
)
def contract_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.contract_targets(spark, sf_dir), target_total_claim_amount=8, target_avg_claim_amount=8)


@query(
    "contract_targets_without_claims",
    steps("cleaned")
    + """SELECT IDpol, ClaimNb AS target_claim_count, CAST(ClaimNb > 0 AS BIGINT) AS target_has_claim,
       round(CASE WHEN Exposure > 0 THEN ClaimNb / Exposure ELSE 0e0 END, 6) AS target_claim_frequency,
       0e0 AS target_total_claim_amount, 0e0 AS target_avg_claim_amount FROM cleaned""",
)
def contract_targets_without_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets where no claims table exists: amounts are zero."""
    return rounded(features.contract_targets(B.cleaned(spark, sf_dir), None))


@query(
    "feature_report",
    steps("cleaned", "claim")
    + """SELECT CAST(sum(n) AS BIGINT) AS frequency_input_rows, CAST(sum(z) AS BIGINT) AS zero_exposure_contract_rows,
       count(*) FILTER (WHERE e = 0) AS zero_exposure_pools, count(*) AS number_of_pools,
       (SELECT count(*) FROM claim) AS severity_input_rows, TRUE AS severity_input_used
FROM (SELECT pool_id, count(*) AS n, count(*) FILTER (WHERE Exposure = 0) AS z, sum(Exposure) AS e FROM cleaned GROUP BY pool_id)""",
)
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_report(B.cleaned(spark, sf_dir), B.claims(spark, sf_dir))


@query(
    "pool_size_stats",
    steps("policy")
    + """SELECT count(*) AS n_pools, min(n) AS pool_size_min, max(n) AS pool_size_max, round(avg(n), 6) AS pool_size_mean
FROM (SELECT pool_id, count(*) AS n FROM policy GROUP BY pool_id)""",
)
def pool_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tontine.operators import clustering

    return rounded(clustering.pool_size_stats(B.policies(spark, sf_dir)))


@query(
    "model_inputs",
    steps("derived")
    + """SELECT CAST(pool_id AS VARCHAR) AS pool_id, VehBrand, VehGas, Area, Region, VehAge_band, DrivAge_band,
       BonusMalus_band, Density_band, count(*) AS n, round(sum(Exposure), 6) AS exposure
FROM derived GROUP BY ALL""",
)
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model categoricals as strings, counted per combination."""
    inputs = scoring.model_inputs(B.contract_features(spark, sf_dir))
    grouped = inputs.groupBy(*S.MODEL_CATEGORICAL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Exposure").alias("exposure")
    )
    return rounded(grouped)


@query(
    "segment_flags",
    steps("derived")
    + """SELECT pool_id, count(*) FILTER (WHERE Density_band IN ('1501-5000', '5001+')) AS high_density_rows,
       count(*) FILTER (WHERE BonusMalus >= 100) AS high_bonus_malus_rows FROM derived GROUP BY pool_id""",
)
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        B.contract_features(spark, sf_dir)
        .groupBy("pool_id")
        .agg(
            F.count_if(X.high_density()).alias("high_density_rows"),
            F.count_if(X.high_bonus_malus()).alias("high_bonus_malus_rows"),
        )
    )


# --- data quality ------------------------------------------------------------------------


@query(
    "duplicate_key_count",
    steps("claim")
    + """SELECT count(*) AS row_count, count(DISTINCT IDpol) AS key_count,
       count(*) - count(DISTINCT IDpol) AS duplicate_count FROM claim""",
)
def duplicate_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_key_count(B.claims(spark, sf_dir), "IDpol")


@query(
    "null_violations",
    steps("derived", "severity")
    + """, j AS (SELECT d.*, s.total FROM derived d LEFT JOIN severity s ON d.IDpol = s.IDpol)
SELECT 'IDpol' AS column_name, count(*) FILTER (WHERE IDpol IS NULL) AS null_count FROM j
UNION ALL SELECT 'Exposure', count(*) FILTER (WHERE Exposure IS NULL) FROM j
UNION ALL SELECT 'Density_band', count(*) FILTER (WHERE Density_band IS NULL) FROM j
UNION ALL SELECT 'target_total_claim_amount', count(*) FILTER (WHERE total IS NULL) FROM j""",
)
def null_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = B.contract_features(spark, sf_dir).join(
        features.severity_aggregates(B.claims(spark, sf_dir)), "IDpol", "left"
    )
    return quality.null_violations(joined, ["IDpol", "Exposure", "Density_band", "target_total_claim_amount"])


@query(
    "binary_domain",
    steps("modelling")
    + """SELECT bool_and(v IN (0, 1)) AS is_binary, count(*) AS class_count, min(n) AS smallest_class,
       bool_and(v IN (0, 1)) AND count(*) = 2 AND min(n) >= 2 AS domain_ok
FROM (SELECT target_has_claim AS v, count(*) AS n FROM modelling WHERE target_has_claim IS NOT NULL GROUP BY 1)""",
)
def binary_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.binary_domain(B.contract_targets(spark, sf_dir), S.TARGET)


@query(
    "one_to_one_check",
    steps("policy", "claim")
    + """, a AS (SELECT IDpol, count(*) AS n FROM policy GROUP BY 1), b AS (SELECT IDpol, count(*) AS n FROM claim GROUP BY 1),
j AS (SELECT a.n AS l, b.n AS r FROM a FULL JOIN b ON a.IDpol = b.IDpol)
SELECT CAST(coalesce(sum(l - 1), 0) AS BIGINT) AS left_duplicates, CAST(coalesce(sum(r - 1), 0) AS BIGINT) AS right_duplicates,
       count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only,
       coalesce(sum(l - 1), 0) + coalesce(sum(r - 1), 0) + count(*) FILTER (WHERE r IS NULL) + count(*) FILTER (WHERE l IS NULL) = 0 AS one_to_one
FROM j""",
)
def one_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.one_to_one(B.policies(spark, sf_dir), B.claims(spark, sf_dir), "IDpol")


@query(
    "request_rejections",
    steps("policy")
    + """, r AS (SELECT IDpol, [x FOR x IN [
         CASE WHEN pool_id IS NULL THEN 'missing:pool_id' END,
         CASE WHEN VehBrand = 'MACHINERY' THEN 'missing:VehBrand' END,
         CASE WHEN Exposure - 1e0 < 0 THEN 'negative:Exposure' END,
         CASE WHEN BonusMalus - 60 < 0 THEN 'negative:BonusMalus' END] IF x IS NOT NULL] AS rejected_rules FROM policy)
SELECT IDpol, rejected_rules FROM r WHERE len(rejected_rules) > 0""",
)
def request_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests made from raw policies, some of which break the request rules."""
    requests = B.policies(spark, sf_dir).withColumns(
        {
            "VehBrand": F.when(F.col("VehBrand") != "MACHINERY", F.col("VehBrand")),
            "Exposure": F.col("Exposure") - 1.0,
            "BonusMalus": F.col("BonusMalus") - 60,
        }
    )
    return quality.split_requests(requests, ["IDpol"])[1]


@query(
    "pool_membership",
    """SELECT c_custkey AS request_id, CAST(c_nationkey AS VARCHAR) AS request_pool_id, count(*) AS member_count,
       bool_and(c_nationkey = o_orderkey % 25) AS members_ok
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def pool_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool request per customer; its orders are the members."""
    members = B.table(spark, sf_dir, "orders").join(
        B.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    requests = members.select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_nationkey").cast("string").alias("request_pool_id"),
        (F.col("o_orderkey") % 25).alias("pool_id"),
    )
    return quality.pool_membership(requests)
