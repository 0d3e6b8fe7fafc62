"""Table schemas and the fixed values of the risk domain.

Everything here must equal the published constants of the domain for results to
agree, so it is stated once, in plain form, and imported everywhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: caps, seeds, thresholds -------------------------------------------------
EXPOSURE_CAP = 1.0
CLAIM_COUNT_CAP = 4
SEED = 42

N_BATCHES = 20
DATA_DRIFT_START = 12
CONCEPT_DRIFT_START = 15
DENSITY_FACTOR = 1.35
BONUS_MALUS_THRESHOLD = 100
FALLBACK_SEVERITY = 1000.0

REFERENCE_FIRST_BATCH = 0
REFERENCE_LAST_BATCH = 9
PSI_BINS = 10
PSI_WARNING = 0.10
PSI_TRIGGER = 0.25
RESIDUAL_DELTA_TRIGGER = 0.01
RESIDUAL_Z_TRIGGER = 3.0
EPSILON = 1e-6
WINDOW_BATCHES = 5
REPLAY_FRACTION = 0.10
LATENCY_BATCHES = 2

TEST_FRACTION = 0.2
CALIBRATION_FOLDS = 5
CALIBRATION_BINS = 10
CALIBRATION_DELTA = 0.005
ANOMALY_CONTAMINATION = 0.01

K_MIN = 10
K_MAX = 50
SILHOUETTE_SAMPLE = 10_000

# --- fixed values: band edges and labels (right-closed, lowest edge included) ----------------
BANDS = {
    "VehAge_band": ("VehAge", (0.0, 2.0, 5.0, 10.0), ("0-2", "3-5", "6-10", "11+")),
    "DrivAge_band": (
        "DrivAge",
        (0.0, 25.0, 35.0, 50.0, 65.0),
        ("0-25", "26-35", "36-50", "51-65", "66+"),
    ),
    "BonusMalus_band": (
        "BonusMalus",
        (0.0, 50.0, 75.0, 100.0, 150.0),
        ("0-50", "51-75", "76-100", "101-150", "151+"),
    ),
    "Density_band": (
        "Density",
        (0.0, 100.0, 500.0, 1500.0, 5000.0),
        ("0-100", "101-500", "501-1500", "1501-5000", "5001+"),
    ),
}
HIGH_DENSITY_BANDS = ("1501-5000", "5001+")

# --- fixed values: column sets -----------------------------------------------------------------
CATEGORICAL_ATTRIBUTES = ("VehBrand", "VehGas", "Area", "Region")
MODEL_NUMERIC = ("Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density_log1p")
MODEL_CATEGORICAL = (
    "pool_id",
    "VehBrand",
    "VehGas",
    "Area",
    "Region",
    "VehAge_band",
    "DrivAge_band",
    "BonusMalus_band",
    "Density_band",
)
MODEL_INPUTS = MODEL_NUMERIC + MODEL_CATEGORICAL
CLUSTERING_NUMERIC = ("VehPower", "VehAge", "DrivAge", "BonusMalus", "Density_log1p")

CONTRACT_FEATURES = (
    "IDpol",
    "pool_id",
    "Exposure",
    "VehPower",
    "VehAge",
    "DrivAge",
    "BonusMalus",
    "Density",
    "Density_log1p",
    "VehBrand",
    "VehGas",
    "Area",
    "Region",
    "VehAge_band",
    "DrivAge_band",
    "BonusMalus_band",
    "Density_band",
)
SERVING_COLUMNS = (
    "pool_id",
    "Exposure",
    "VehPower",
    "VehAge",
    "DrivAge",
    "BonusMalus",
    "VehBrand",
    "VehGas",
    "Area",
    "Density",
    "Region",
)
SERVING_NUMERIC = ("Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density")
SERVING_REALS = ("Exposure", "Density")
SERVING_STRINGS = ("pool_id", "VehBrand", "VehGas", "Area", "Region")

# Outcome columns that must never reach a model as inputs.
OUTCOME_COLUMNS = (
    "ClaimNb",
    "ClaimNb_declared",
    "ClaimAmount",
    "target_claim_count",
    "target_has_claim",
    "target_claim_frequency",
    "target_total_claim_amount",
    "target_avg_claim_amount",
    "pool_claim_count",
    "pool_has_claim",
    "pool_claim_rate",
    "pool_total_claim_amount",
    "pool_avg_claim_amount",
)

TARGET = "target_has_claim"
PROBABILITY = "predicted_claim_probability"

# --- fixed values: histogram buckets and alert rules -----------------------------------------------
SCORE_BUCKETS = (0.0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)
ALERT_RULES = (
    ("ModelUnavailable", "critical", "model_loaded = 0"),
    ("DataDriftDetected", "warning", "data_drift_detected = 1"),
    ("ConceptDriftDetected", "warning", "concept_drift_detected = 1"),
    (
        "RetrainingValidationFailed",
        "warning",
        "retraining_requested = 1 AND candidate_validation_passed = 0",
    ),
    ("TraceLoggingDisabled", "warning", "trace_logging_enabled = 0"),
    ("TraceLoggingFailures", "warning", "trace_log_failures_total > 0"),
)
GAUGES = (
    "model_loaded",
    "trace_logging_enabled",
    "data_drift_detected",
    "concept_drift_detected",
    "retraining_requested",
    "candidate_validation_passed",
    "model_registered",
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# What a pipeline run logs, as (logged name, name in the report).
REFERENCE_RUN_METRICS = (
    "model_auc",
    "model_normalized_gini",
    "baseline_auc",
    "baseline_normalized_gini",
    "brier_score",
    "expected_calibration_error",
    "test_empirical_claim_rate",
    "test_mean_predicted_probability",
    "pool_score_coverage",
)
DRIFT_RUN_METRICS = {
    "phase8_data_detection_latency": "data_detection_latency",
    "phase8_concept_detection_latency": "concept_detection_latency",
    "phase8_retraining_event_count": "retraining_event_count",
}
CANDIDATE_RUN_METRICS = {
    "candidate_auc": "candidate_auc",
    "candidate_normalized_gini": "candidate_normalized_gini",
    "candidate_probability_rate_delta": "probability_rate_delta",
    "candidate_pool_score_coverage": "pool_score_coverage",
}
RUN_TAGS = (
    "dvc_output_hash",
    "dvc_tracked_path",
    "dataset_git_commit_sha",
    "phase7_acceptance_passed",
    "phase8_acceptance_passed",
    "candidate_source",
    "validation_passed",
)

# The columns of the domain tables, logs and records, in their order.
POLICIES = _struct(
    ("IDpol", T.LongType()),
    ("ClaimNb", T.IntegerType()),
    ("Exposure", T.DoubleType()),
    ("VehPower", T.IntegerType()),
    ("VehAge", T.IntegerType()),
    ("DrivAge", T.IntegerType()),
    ("BonusMalus", T.IntegerType()),
    ("VehBrand", T.StringType()),
    ("VehGas", T.StringType()),
    ("Area", T.StringType()),
    ("Density", T.DoubleType()),
    ("Region", T.StringType()),
)
CLAIMS = _struct(("IDpol", T.LongType()), ("ClaimAmount", T.DoubleType()))

RETRAINING_EVENTS = _struct(
    ("trigger_batch", T.IntegerType()),
    ("triggering_detector", T.StringType()),
    ("event_type", T.StringType()),
    ("window_start_batch", T.IntegerType()),
    ("window_end_batch", T.IntegerType()),
    ("training_window_batches", T.StringType()),
    ("window_rows", T.LongType()),
    ("replay_rows", T.LongType()),
    ("training_rows", T.LongType()),
    ("candidate_model_name", T.StringType()),
    ("candidate_training_auc", T.DoubleType()),
    ("candidate_replaces_reference_model", T.BooleanType()),
)

PREDICTION_SUMMARY = _struct(
    ("contract_count", T.LongType()),
    ("mean_probability", T.DoubleType()),
    ("pool_risk_score", T.DoubleType()),
    ("pool_scored_exposure", T.DoubleType()),
    ("pool_score_weighting_method", T.StringType()),
)
DECISIONS = _struct(
    ("decision_id", T.StringType()),
    ("request_id", T.StringType()),
    ("endpoint", T.StringType()),
    ("timestamp_utc", T.StringType()),
    ("model_source", T.StringType()),
    ("model_artifact_path", T.StringType()),
    ("model_artifact_sha256", T.StringType()),
    ("retraining_cycle_id", T.StringType()),
    ("dvc_output_hash", T.StringType()),
    ("dataset_git_commit_sha", T.StringType()),
    ("prediction_summary", PREDICTION_SUMMARY),
    ("input_fingerprint", T.StringType()),
    ("trace_salt_mode", T.StringType()),
)
CYCLE_LOG_COLUMNS = (
    "retraining_cycle_id",
    "cycle_source",
    "trigger_batch",
    "triggering_detector",
    "training_window_batches",
    "validation_passed",
    "model_registered",
    "registered_model_version",
    "model_artifact_path",
    "model_artifact_sha256",
    "dvc_output_hash",
    "dataset_git_commit_sha",
)
CYCLE_LOG = _struct(*((name, T.StringType()) for name in CYCLE_LOG_COLUMNS))
