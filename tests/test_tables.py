"""Ingestion, cleaning, features: hand-computed values and typed errors."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import cleaning, features, quality
from tontine.sources import tables

RAW = "IDpol long, ClaimNb int, Exposure double, VehPower int, VehAge int, DrivAge int, BonusMalus int, VehBrand string, VehGas string, Area string, Density double, Region string"


def raw(spark, rows):
    return spark.createDataFrame([(i, n, e, 5, 1, 40, 50, "B1", "Diesel", "A", 100.0, "R1") for i, n, e in rows], RAW)


@pytest.fixture(scope="module")
def cleaned(spark):
    policies = raw(spark, [(1, 0, 0.4), (2, 1, 1.25), (3, 10, 2.0)])
    claims = spark.createDataFrame([(2, 10.0), *((3, 5.0) for _ in range(5)), (999, 1.0)], "IDpol long, ClaimAmount double")
    return cleaning.clean(policies, claims)


def test_cleaning_values(cleaned):
    rows = {r["IDpol"]: r for r in cleaned.frequency.collect()}
    assert [rows[i]["ClaimNb"] for i in (1, 2, 3)] == [0, 1, 4]
    assert [rows[i]["ClaimNb_declared"] for i in (1, 2, 3)] == [0, 1, 10]
    assert [rows[i]["Exposure"] for i in (1, 2, 3)] == [0.4, 1.0, 1.0]
    assert cleaned.severity.count() == 6


def test_cleaning_report(cleaned):
    report = cleaned.report.first().asDict()
    assert report == {
        "frequency_rows_before": 3,
        "frequency_rows_after": 3,
        "severity_rows_before": 7,
        "severity_rows_after": 6,
        "unmatched_severity_rows_dropped": 1,
        "claimnb_mismatched_policies": 1,
        "exposure_values_capped": 2,
        "claimnb_values_capped": 1,
    }


def test_declared_claims_without_any_claim(spark):
    result = cleaning.clean(raw(spark, [(1, 2, 0.5)]), spark.createDataFrame([(9, 1.0)], "IDpol long, ClaimAmount double"))
    assert result.frequency.first()["ClaimNb"] == 0
    assert result.report.first()["claimnb_mismatched_policies"] == 1
    assert result.severity.isEmpty()


def test_null_policy_key_claims_are_orphans(spark):
    policies = raw(spark, [(1, 0, 0.4)])
    claims = spark.createDataFrame([(None, 1.0), (1, 2.0)], "IDpol long, ClaimAmount double")
    assert cleaning.orphan_claims(claims, policies).count() == 1


def pooled(spark):
    rows = [
        (1, 10, 1, 0.4, 1, 22, 50, 100.0, "B1"),
        (2, 10, 1, 0.8, 5, 50, 100, 7000.0, "B2"),
        (3, 20, 1, 0.0, 12, 30, 60, 500.0, "B1"),
        (4, 20, 0, 0.0, 2, 70, 160, 1500.0, "B1"),
        (5, 30, 1, 1.0, 7, 66, 75, 1501.0, "B1"),
    ]
    wide = [(i, p, n, e, 6, va, da, bm, b, "Gas", "A", d, "R") for i, p, n, e, va, da, bm, d, b in rows]
    return spark.createDataFrame(
        wide,
        "IDpol long, pool_id int, ClaimNb long, Exposure double, VehPower int, VehAge int, DrivAge int, BonusMalus int,"
        " VehBrand string, VehGas string, Area string, Density double, Region string",
    )


@pytest.fixture(scope="module")
def built(spark):
    policies = pooled(spark).withColumn("ClaimNb", F.when(F.col("IDpol") == 2, 2).when(F.col("IDpol") == 1, 0).otherwise(F.col("ClaimNb")).cast("long"))
    claims = spark.createDataFrame([(2, 100.0), (2, 200.0), (5, 50.0)], "IDpol long, ClaimAmount double")
    return features.build_features(policies, claims)


def test_contract_targets(built):
    rows = {r["IDpol"]: r for r in built.contract_targets.collect()}
    assert rows[2]["target_claim_frequency"] == 2.5
    assert (rows[2]["target_total_claim_amount"], rows[2]["target_avg_claim_amount"]) == (300.0, 150.0)
    assert (rows[3]["target_claim_frequency"], rows[3]["target_total_claim_amount"]) == (0.0, 0.0)


def test_pool_tables(built):
    wide = {r["pool_id"]: r for r in built.pool_features.collect()}
    assert wide[10]["pool_size"] == 2 and math.isclose(wide[10]["pool_total_exposure"], 1.2)
    assert wide[10]["pool_veh_brand_diversity"] == 2
    assert wide[30]["pool_std_density"] == 0.0  # a single member has no sample deviation
    targets = {r["pool_id"]: r for r in built.pool_targets.collect()}
    assert targets[10]["pool_claim_count"] == 2
    assert math.isclose(targets[10]["pool_claim_rate"], 2 / 1.2)
    assert targets[10]["pool_total_claim_amount"] == 300.0
    assert targets[20]["pool_claim_rate"] == 0.0
    assert targets[30]["pool_total_claim_amount"] == 50.0
    report = built.report.first()
    assert (report["zero_exposure_contract_rows"], report["zero_exposure_pools"], report["number_of_pools"]) == (2, 1, 3)
    assert len(built.contract_features.columns) == 17
    assert not set(built.contract_features.columns) & set(S.OUTCOME_COLUMNS)


def test_bands_on_exact_edges(built):
    rows = {r["IDpol"]: r for r in built.contract_features.collect()}
    assert [rows[i]["VehAge_band"] for i in (1, 2, 3)] == ["0-2", "3-5", "11+"]
    assert [rows[i]["DrivAge_band"] for i in (1, 2, 5)] == ["0-25", "36-50", "66+"]
    assert rows[2]["Density_band"] == "5001+"
    assert (rows[4]["Density_band"], rows[5]["Density_band"]) == ("501-1500", "1501-5000")
    assert rows[4]["BonusMalus_band"] == "151+"


def test_band_of_outside_values(spark):
    frame = spark.createDataFrame([(-1.0,), (0.0,), (None,), (float("nan"),)], "Density double")
    assert [r[0] for r in frame.select(X.named_band("Density_band")).collect()] == [None, "0-100", None, None]


def test_features_without_claims(spark):
    amounts = features.contract_targets(pooled(spark), None).agg(F.sum("target_total_claim_amount")).first()[0]
    assert amounts == 0.0


def test_null_inputs_are_rejected(spark):
    broken = pooled(spark).withColumn("Density", F.lit(None).cast("double"))
    with pytest.raises(quality.DataQualityError, match="missing values"):
        features.build_features(broken, None)


def test_serving_features_equal_training_features(spark):
    policies = pooled(spark)
    training = features.contract_features(policies).drop("IDpol")
    serving = features.contract_features(policies.drop("IDpol", "ClaimNb"))
    assert serving.columns == training.columns
    assert serving.exceptAll(training).isEmpty()


@pytest.mark.parametrize("value, cap, expected", [(None, 1.0, None), (0.5, 1.0, 0.5), (2.0, 1.0, 1.0)])
def test_cap_keeps_nulls(spark, value, cap, expected):
    assert spark.createDataFrame([(value,)], "v double").select(X.cap_upper("v", cap)).first()[0] == expected


def test_guarded_ratio(spark):
    frame = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0), (4.0, -1.0)], "n double, d double")
    assert [r[0] for r in frame.select(X.guarded_ratio("n", "d")).collect()] == [2.0, 0.0, 0.0]


def test_csv_readers(spark, tmp_path):
    policies, claims = str(tmp_path / "p"), str(tmp_path / "c")
    tables.write_table(raw(spark, [(1, 0, 0.5), (2, 1, 0.7)]), policies, "csv")
    tables.write_table(spark.createDataFrame([(1, 5.0), (2, 6.0)], S.CLAIMS), claims, "csv")
    p, c = tables.load_raw(spark, policies, claims)
    assert (p.count(), c.count()) == (2, 2)
    assert dict(p.dtypes)["IDpol"] == "bigint"
    with pytest.raises(tables.SourceError, match="does not exist"):
        tables.read_policies(spark, str(tmp_path / "nowhere"))
    tables.write_table(raw(spark, [(1, 0, 0.5)]).drop("Exposure"), policies, "csv")
    with pytest.raises(tables.SourceError, match="Exposure"):
        tables.read_policies(spark, policies)
    tables.write_table(raw(spark, [(1, 0, 0.5), (1, 0, 0.5)]), policies, "csv")
    with pytest.raises(quality.DataQualityError, match="1 duplicate"):
        tables.load_raw(spark, policies, claims)
    (tmp_path / "head.csv").write_text("IDpol,ClaimAmount\n")
    with pytest.raises(quality.DataQualityError, match="no rows"):
        quality.expect_rows(tables.read_claims(spark, str(tmp_path / "head.csv")), "severity")


def test_optional_inputs(spark, tmp_path):
    absent = str(tmp_path / "absent")
    assert tables.read_optional(spark, absent, S.CYCLE_LOG).isEmpty()
    assert tables.read_optional_report(spark, absent, S.DECISIONS).isEmpty()
    with pytest.raises(tables.SourceError):
        tables.read_report(spark, absent, S.DECISIONS)
    report = str(tmp_path / "report")
    tables.write_report(spark.createDataFrame([(1, None)], "a int, b string"), report)
    assert tables.read_report(spark, report, spark.createDataFrame([], "a int, b string").schema).first()["a"] == 1


def test_required_columns_are_listed_in_order(spark):
    with pytest.raises(quality.DataQualityError, match="Exposure, Density"):
        quality.expect_columns(spark.range(1), ("id", "Exposure", "Density"), "frame")


def test_duplicates_count_a_null_key_once(spark):
    frame = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert quality.duplicate_key_count(frame, "k").first()["duplicate_count"] == 2


def test_binary_domain(spark):
    bad = spark.createDataFrame([(0,), (0,), (2,)], "y long")
    with pytest.raises(quality.DataQualityError, match="binary"):
        quality.expect_binary(bad, "y")
    thin = spark.createDataFrame([(0,), (0,), (1,)], "y long")
    with pytest.raises(quality.DataQualityError, match="fewer than two rows"):
        quality.expect_binary(thin, "y")


def test_one_to_one(spark):
    left = spark.createDataFrame([(1,), (2,)], "IDpol long")
    right = spark.createDataFrame([(1,), (3,)], "IDpol long")
    row = quality.one_to_one(left, right, "IDpol").first()
    assert (row["left_only"], row["right_only"], row["one_to_one"]) == (1, 1, False)
    assert quality.one_to_one(left, left, "IDpol").first()["one_to_one"]


@pytest.mark.parametrize(
    "arguments, message",
    [((1, 5, 10, 100), "k_min=1"), ((5, 4, 10, 100), "from 5 to 4"), ((2, 100, 10, 100), "k_max=100"), ((2, 4, 1, 100), "over 1 rows")],
)
def test_clustering_guards(arguments, message):
    with pytest.raises(quality.DataQualityError, match=message):
        quality.guard_clustering(*arguments)


@pytest.mark.parametrize("arguments", [(0, 10, 0, 0), (11, 10, 0, 0), (5, 10, 5, 0), (5, 10, 0, -1)])
def test_batch_guards(arguments):
    with pytest.raises(quality.DataQualityError):
        quality.guard_batches(*arguments)


def test_leakage_guard():
    quality.guard_leakage(S.MODEL_INPUTS)
    with pytest.raises(quality.DataQualityError, match="ClaimNb"):
        quality.guard_leakage(["Exposure", "ClaimNb"])


def test_rejected_requests_show_rules_not_values(spark):
    row = (7, "p", -3.0, 5.0, 1.0, 40.0, 77.0, 1234.5, None, "Gas", "A", "R")
    frame = spark.createDataFrame(
        [row],
        "request_id long, pool_id string, Exposure double, VehPower double, VehAge double, DrivAge double, BonusMalus double,"
        " Density double, VehBrand string, VehGas string, Area string, Region string",
    )
    accepted, rejected = quality.split_requests(frame, ["request_id"])
    assert accepted.isEmpty()
    assert rejected.columns == ["request_id", "rejected_rules"]
    assert sorted(rejected.first()["rejected_rules"]) == ["missing:VehBrand", "negative:Exposure"]
    with pytest.raises(quality.DataQualityError, match="unknown"):
        quality.expect_known_fields(frame.withColumn("extra", F.lit(1)), frame.columns)
