"""From a decision to its model cycle and its dataset snapshot."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.functions.hashing import canonical_json, keyed_fingerprint
from tontine.operators.reports import side_by_side
from tontine.sources.tables import cycle_log_rows


@dataclass(frozen=True, repr=False)
class TracePolicy:
    """Whether decisions are traced and with which salt; the salt never shows in a repr."""

    enabled: bool
    salt_mode: str
    salt: bytes | None

    def __repr__(self) -> str:
        return f"TracePolicy(enabled={self.enabled}, salt_mode={self.salt_mode!r})"


def trace_policy(salt: str | None = None, dev_mode: bool = False) -> TracePolicy:
    """A given salt repeats fingerprints; development draws one per process; else no tracing."""
    if salt:
        return TracePolicy(True, "env_var", salt.encode("utf-8"))
    if dev_mode:
        return TracePolicy(True, "ephemeral_dev_random", secrets.token_bytes(32))
    return TracePolicy(False, "disabled_missing_trace_hash_salt", None)


def request_fingerprint(policy: TracePolicy, *columns: str) -> Column:
    if policy.salt is None:
        raise ValueError("a fingerprint was requested while no salt is available")
    return keyed_fingerprint(canonical_json(*columns, fixed=S.SERVING_REALS), policy.salt)


def decision_rows(scores: DataFrame) -> DataFrame:
    """The decision record: a whitelist, so attributes and member lists cannot leak.

    ``scores`` carries the identity columns, the five summary columns and the fingerprint.
    """
    summary = F.struct(*(f.name for f in S.PREDICTION_SUMMARY.fields)).alias("prediction_summary")
    names = [f.name for f in S.DECISIONS.fields]
    return scores.select(*(summary if name == "prediction_summary" else F.col(name) for name in names))


def cycle_log(events: DataFrame, context: DataFrame) -> DataFrame:
    """One row per retraining event.

    ``context`` is one row: ``selected_batch, serving_source, serving_cycle_id,
    serving_path, serving_sha, validation_passed, model_registered,
    registered_model_version, dvc_output_hash, dataset_git_commit_sha`` as strings.
    """
    joined = side_by_side(events.withColumn("trigger", F.col("trigger_batch").cast("string")), context)
    selected = F.coalesce(F.col("trigger") == F.col("selected_batch"), F.lit(False))
    served = selected & F.coalesce(F.col("serving_source") == "phase9_retrained_candidate", F.lit(False))
    if_selected = lambda c: F.when(selected, F.col(c))
    if_served = lambda c: F.when(served, F.col(c))
    rows = joined.select(
        F.when(served, F.col("serving_cycle_id"))
        .otherwise(F.concat(F.lit("phase8-event:"), F.col("trigger")))
        .alias("retraining_cycle_id"),
        X.cycle_source(selected, served).alias("cycle_source"),
        F.col("trigger").alias("trigger_batch"),
        "triggering_detector",
        "training_window_batches",
        if_selected("validation_passed").alias("validation_passed"),
        if_selected("model_registered").alias("model_registered"),
        if_selected("registered_model_version").alias("registered_model_version"),
        if_served("serving_path").alias("model_artifact_path"),
        if_served("serving_sha").alias("model_artifact_sha256"),
        "dvc_output_hash",
        "dataset_git_commit_sha",
    )
    return cycle_log_rows(rows)


def append_serving_cycle(cycles: DataFrame, context: DataFrame) -> DataFrame:
    """Add the serving cycle unless a row with its id is already there."""
    serving = context.filter(X.first_present("serving_cycle_id").isNotNull()).select(
        F.col("serving_cycle_id").alias("retraining_cycle_id"),
        F.col("serving_source").alias("cycle_source"),
        F.lit(None).cast("string").alias("trigger_batch"),
        F.lit(None).cast("string").alias("triggering_detector"),
        F.lit(None).cast("string").alias("training_window_batches"),
        "validation_passed",
        "model_registered",
        "registered_model_version",
        F.col("serving_path").alias("model_artifact_path"),
        F.col("serving_sha").alias("model_artifact_sha256"),
        "dvc_output_hash",
        "dataset_git_commit_sha",
    )
    absent = cycle_log_rows(serving).join(cycles.select("retraining_cycle_id"), "retraining_cycle_id", "left_anti")
    return cycles.unionByName(absent.select(*S.CYCLE_LOG_COLUMNS))


def decision_lineage(decisions: DataFrame, cycles: DataFrame) -> DataFrame:
    """Decisions with their cycle; ``lineage_intact`` is false where no cycle has the id.

    The id is the key: artifact paths may be overwritten. Many decisions share one cycle,
    so a hot id is the rule: cycles are one row per event and Spark broadcasts them by
    their size; above that adaptive execution splits the hot side.
    """
    known = cycles.select(
        "retraining_cycle_id",
        "cycle_source",
        F.col("trigger_batch").alias("cycle_trigger_batch"),
        F.col("dvc_output_hash").alias("cycle_dvc_output_hash"),
        F.lit(True).alias("_known"),
    )
    return (
        decisions.join(known, "retraining_cycle_id", "left")
        .withColumn("lineage_intact", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def decision_cycle_ids(decisions: DataFrame) -> DataFrame:
    """Number of decisions and the sorted distinct cycle ids they carry.

    Ids are made distinct before they are gathered: there is one per model cycle.
    """
    per_id = decisions.groupBy("retraining_cycle_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("decision_count"),
        F.sort_array(F.collect_list("retraining_cycle_id")).alias("decision_retraining_cycle_ids"),
    )


def monitoring_report(decisions: DataFrame, evaluations: DataFrame, lifecycle: DataFrame, context: DataFrame) -> DataFrame:
    """One row: decision lineage, drift flags and lifecycle flags.

    A drift counts as detected when its evaluation has a first detected batch.
    """
    detected = lambda kind: F.coalesce(
        F.bool_or((F.col("drift_type") == kind) & F.col("first_detected_batch").isNotNull()), F.lit(False)
    )
    drifts = evaluations.agg(
        detected("data").alias("phase8_data_drift_detected"), detected("concept").alias("phase8_concept_drift_detected")
    )
    flags = lifecycle.select(
        F.col("retraining_requested").alias("phase9_retraining_requested"),
        F.col("validation_passed").alias("phase9_validation_passed"),
        F.col("model_registered").alias("phase9_model_registered"),
    )
    serving = context.select(
        F.col("serving_cycle_id").alias("serving_retraining_cycle_id"),
        F.col("serving_source").alias("model_source"),
        F.col("serving_sha").alias("model_artifact_sha256"),
        "dvc_output_hash",
    )
    return side_by_side(decision_cycle_ids(decisions), drifts, flags, serving)


def serving_report(resolved: DataFrame, flags: DataFrame, policy: TracePolicy) -> DataFrame:
    """One row: served model, cycle id, acceptance flags, snapshot hash and trace mode."""
    return side_by_side(resolved, flags).withColumns(
        {"trace_logging_enabled": F.lit(policy.enabled), "trace_salt_mode": F.lit(policy.salt_mode)}
    )
