"""Requests, alerts, sources and sinks, clustering, models, and the streaming forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import (
    anomaly,
    classifier,
    clustering,
    drift,
    encoding,
    lifecycle,
    lineage,
    observability,
    online,
    pool_scan,
    quality,
    scoring,
)
from tontine.operators.reports import side_by_side
from tontine.plans import binding as B
from tontine.plans import lifecycle as lifecycle_plans
from tontine.plans import monitoring, risk
from tontine.plans.claim_sql import fitted
from tontine.plans.registry import query, rounded, step, steps
from tontine.sources import snapshot, tables
from tontine.sources.lines import numbered_lines
from tontine.sources.shared import fresh_path, spool
from tontine.streaming import drift_monitor, live_metrics, live_scoring
from tontine.streaming import online_updates as online_stream

LATENCY_EDGES = (1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0)
_BUCKETS = ", ".join(f"count(*) FILTER (WHERE latency <= {e}) AS le_{i}" for i, e in enumerate(LATENCY_EDGES))

step(
    "requests",
    (),
    """SELECT ts, 'POST' AS method, event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       CASE WHEN user_id % 2 = 0 THEN 'phase7_reference_model' ELSE 'phase9_retrained_candidate' END AS model_source, value AS latency FROM events""",
)
step(
    "request_windows",
    ("requests",),
    f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start, path, count(*) AS request_count,
       count(*) FILTER (WHERE status_code >= 500) AS error_count, sum(latency) AS latency_sum, {_BUCKETS} FROM requests GROUP BY 1, 2""",
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(B.table(spark, sf_dir, "events"))


def plain_time(windows: DataFrame) -> DataFrame:
    """Window starts without a zone, as the event table states its times."""
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def as_requests(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("POST").alias("method"),
        F.col("event_type").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.when(F.col("user_id") % 2 == 0, F.lit("phase7_reference_model"))
        .otherwise(F.lit("phase9_retrained_candidate"))
        .alias("model_source"),
        F.col("value").alias("latency"),
    )


@query(
    "request_metrics",
    steps("requests")
    + f"""SELECT method, path, status_code, model_source, {_BUCKETS}, count(*) AS observations, round(sum(latency), 4) AS value_sum
FROM requests GROUP BY 1, 2, 3, 4""",
)
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(observability.request_metrics(requests(spark, sf_dir), LATENCY_EDGES), 4)


_LE = ", ".join(f"le_{i}" for i in range(len(LATENCY_EDGES)))


@query(
    "windowed_requests",
    steps("request_windows")
    + f"SELECT window_start, path, request_count, error_count, round(latency_sum, 4) AS latency_sum, {_LE} FROM request_windows",
)
def windowed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plain_time(observability.windowed_requests(requests(spark, sf_dir), LATENCY_EDGES)), 4)


def _quantile_sql(share: float) -> str:
    cases = []
    for i, edge in enumerate(LATENCY_EDGES):
        low = LATENCY_EDGES[i - 1] if i else 0.0
        below = f"le_{i - 1}" if i else "0"
        cases.append(
            f"WHEN le_{i} >= request_count * {share}e0 THEN {low}e0 + {edge - low}e0 * (request_count * {share}e0 - {below}) / (le_{i} - {below})"
        )
    return f"CASE {' '.join(cases)} ELSE {LATENCY_EDGES[-1]}e0 END"


@query(
    "request_rates",
    steps("request_windows")
    + f"""SELECT window_start, path, request_count, round(request_count / 300e0, 9) AS rate, round({_quantile_sql(0.95)}, 6) AS latency_quantile FROM request_windows""",
)
def request_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = observability.windowed_requests(requests(spark, sf_dir), LATENCY_EDGES)
    return rounded(plain_time(observability.rates(windowed, LATENCY_EDGES)), rate=9)


_SCORE_LE = ", ".join(f"count(*) FILTER (WHERE predicted_claim_probability <= {e}) AS le_{i}" for i, e in enumerate(S.SCORE_BUCKETS))


@query(
    "score_histogram",
    steps("scored")
    + f"SELECT Region, {_SCORE_LE}, count(*) AS observations, round(sum(predicted_claim_probability), 6) AS value_sum FROM scored GROUP BY 1",
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(observability.score_histogram(B.scored(spark, sf_dir), "Region"))


step(
    "service_state",
    (),
    """SELECT c_custkey, CAST(c_custkey % 7 <> 0 AS INTEGER) AS model_loaded, CAST(c_custkey % 5 <> 0 AS INTEGER) AS trace_logging_enabled,
       CAST(c_acctbal < 0 AS INTEGER) AS data_drift_detected, CAST(c_acctbal > 9000 AS INTEGER) AS concept_drift_detected,
       CAST(c_nationkey % 2 = 0 AS INTEGER) AS retraining_requested, CAST(c_nationkey % 4 = 0 AS INTEGER) AS candidate_validation_passed,
       CAST(c_nationkey % 8 = 0 AS INTEGER) AS model_registered, c_nationkey % 3 AS trace_log_failures_total FROM customer""",
)


def service_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One state report per customer, in which every alert fires for some."""
    key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    return B.table(spark, sf_dir, "customer").select(
        key,
        (key % 7 != 0).alias("model_loaded"),
        (key % 5 != 0).alias("trace_logging_enabled"),
        (balance < 0).alias("data_drift_detected"),
        (balance > 9000).alias("concept_drift_detected"),
        (nation % 2 == 0).alias("retraining_requested"),
        (nation % 4 == 0).alias("candidate_validation_passed"),
        (nation % 8 == 0).alias("model_registered"),
        (nation % 3).alias("trace_log_failures_total"),
    )


@query(
    "gauges",
    steps("service_state")
    + " UNION ALL ".join(f"SELECT c_custkey, '{g}' AS gauge, CAST({g} AS DOUBLE) AS value FROM service_state" for g in S.GAUGES),
)
def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.gauges(service_state(spark, sf_dir), ["c_custkey"])


@query(
    "alert_state",
    steps("service_state")
    + " UNION ALL ".join(
        f"SELECT c_custkey, '{name}' AS alert, '{severity}' AS severity FROM service_state WHERE {condition}"
        for name, severity, condition in S.ALERT_RULES
    ),
)
def alert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observability.alert_state(service_state(spark, sf_dir), ["c_custkey"])


# --- sources and sinks ---------------------------------------------------------------------------


@query(
    "csv_tables",
    steps("policy", "claim")
    + """SELECT VehBrand, count(*) AS policies, round(sum(Exposure), 6) AS exposure, CAST(sum(n) AS BIGINT) AS claims, round(sum(amount), 4) AS amount
FROM policy p LEFT JOIN (SELECT IDpol, count(*) AS n, sum(ClaimAmount) AS amount FROM claim GROUP BY 1) c ON p.IDpol = c.IDpol GROUP BY 1""",
)
def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tables written as header CSV and read back through the checked readers."""
    policy_path, claim_path = fresh_path(spark, "policies-csv"), fresh_path(spark, "claims-csv")
    tables.write_table(B.policies(spark, sf_dir).drop("pool_id"), policy_path, "csv")
    tables.write_table(B.claims(spark, sf_dir), claim_path, "csv")
    policies, claims = tables.load_raw(spark, policy_path, claim_path)
    per_policy = claims.groupBy("IDpol").agg(F.count(F.lit(1)).alias("n"), F.sum("ClaimAmount").alias("amount"))
    joined = policies.join(per_policy, "IDpol", "left")
    return rounded(
        joined.groupBy("VehBrand").agg(
            F.count(F.lit(1)).alias("policies"),
            F.sum("Exposure").alias("exposure"),
            F.sum("n").alias("claims"),
            F.sum("amount").alias("amount"),
        ),
        amount=4,
    )


@query(
    "stored_batch",
    steps("scored_stream")
    + "SELECT IDpol, batch_id, event_index, round(predicted_claim_probability, 9) AS predicted_claim_probability FROM scored_stream WHERE batch_id = 13",
)
def stored_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch read back from the batch-partitioned table."""
    stream = B.scorer()(B.stream(spark, sf_dir))
    path = fresh_path(spark, "batches")
    tables.write_batches(stream, path)
    batch = tables.read_batch(spark, path, 13, stream.schema)
    return rounded(batch.select("IDpol", "batch_id", "event_index", S.PROBABILITY), 9)


@query(
    "stored_batches",
    steps("scored_stream")
    + "SELECT batch_id, count(*) AS row_count, round(sum(predicted_claim_probability), 6) AS p FROM scored_stream GROUP BY 1",
)
def stored_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = B.scorer()(B.stream(spark, sf_dir))
    path = fresh_path(spark, "batches")
    tables.write_batches(stream, path)
    batches = tables.read_batches(spark, path, stream.schema)
    return rounded(batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum(S.PROBABILITY).alias("p")))


@query(
    "decision_log_lines",
    """SELECT 'good' AS kind, count(*) FILTER (WHERE o_orderkey % 10 > 2) AS n, count(DISTINCT CASE WHEN o_orderkey % 10 > 2 THEN o_custkey END) AS requests FROM orders
UNION ALL SELECT 'quarantined', count(*) FILTER (WHERE o_orderkey % 10 IN (1, 2)), 0 FROM orders""",
)
def decision_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-lines log, made from orders, in which some lines are blank, cut or no object."""
    key = F.col("o_orderkey")
    record = F.to_json(
        F.struct(
            F.md5(key.cast("string")).alias("decision_id"),
            F.col("o_custkey").cast("string").alias("request_id"),
            F.struct(F.lit(1).alias("contract_count"), (F.col("o_totalprice") / 1e6).alias("mean_probability")).alias(
                "prediction_summary"
            ),
        )
    )
    line = (
        F.when(key % 10 == 0, F.lit("  "))
        .when(key % 10 == 1, F.substring(record, 1, 20))
        .when(key % 10 == 2, F.lit("[1, 2]"))
        .otherwise(record)
    )
    path = fresh_path(spark, "decision-log")
    B.table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    good, bad = tables.read_decision_log(spark, path, strict=False)
    counted = good.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("requests"))
    return counted.select(F.lit("good").alias("kind"), "n", "requests").unionByName(
        bad.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("quarantined").alias("kind"), "n", F.lit(0).cast("bigint").alias("requests")
        )
    )


@query(
    "stored_cycle_log",
    steps("cycles") + f"SELECT {', '.join(S.CYCLE_LOG_COLUMNS)} FROM cycles",
)
def stored_cycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycle log written as CSV with empty strings for nulls and read back."""
    log = lifecycle_plans.events(spark, sf_dir)[1]
    ctx = lifecycle_plans.context(spark, sf_dir, log)
    path = fresh_path(spark, "cycle-log")
    tables.write_cycle_log(lineage.cycle_log(log, ctx), path)
    stored = tables.read_optional(spark, path, S.CYCLE_LOG)
    return tables.cycle_log_rows(stored)


@query(
    "manifest_check",
    """SELECT 'batch_' || o_orderkey || '.csv' AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected: an artifact per order; present: one per order with a claim."""
    named = lambda c: F.concat(F.lit("batch_"), F.col(c).cast("string"), F.lit(".csv")).alias("path")
    expected = B.table(spark, sf_dir, "orders").select(named("o_orderkey"))
    present = B.claims(spark, sf_dir).select(named("IDpol")).distinct()
    return snapshot.manifest_check(expected, present)


def row_text_sql(**kinds: str) -> str:
    """The canonical text of a row in SQL; ``kinds`` gives ``text``, ``whole`` or ``real`` by column."""
    texts = {"text": "{}", "whole": "CAST({} AS VARCHAR)", "real": "printf('%.9f', {})"}
    cells = [(c, texts[kinds[c]].format(c)) for c in sorted(kinds)]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({t}) || ':' || {t} END" for c, t in cells) + ")"


_POLICY_TEXT = row_text_sql(
    IDpol="whole", ClaimNb="whole", Exposure="real", VehPower="whole", VehAge="whole", DrivAge="whole", BonusMalus="whole",
    VehBrand="text", VehGas="text", Area="text", Density="real", Region="text",
)


@query(
    "dataset_digests",
    steps("policy")
    + f""", t AS (SELECT pool_id, sha256({_POLICY_TEXT}) AS d FROM policy),
l2 AS (SELECT pool_id, substr(d, 1, 2) AS p, count(*) AS n, sha256(string_agg(d, ',' ORDER BY d)) AS d FROM t GROUP BY 1, 2),
l1 AS (SELECT pool_id, substr(p, 1, 1) AS q, sum(n) AS n, sha256(string_agg(d, ',' ORDER BY p)) AS d FROM l2 GROUP BY 1, 2)
SELECT pool_id, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, ',' ORDER BY q)) AS digest FROM l1 GROUP BY 1""",
)
def dataset_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all policies, pool by pool, by a tree of two levels."""
    return snapshot.content_digests(B.policies(spark, sf_dir), ["pool_id"], levels=2)


@query(
    "dataset_manifest",
    steps("indexed")
    + """SELECT 'stream/batch_id=' || batch_id AS unit, CASE batch_id WHEN 7 THEN 'missing' WHEN 3 THEN 'changed' ELSE 'same' END AS status,
       count(*) AS n_rows FROM indexed GROUP BY batch_id
UNION ALL SELECT 'features', 'unlisted', NULL""",
)
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset against its manifest after one batch folder went, one batch changed and a table came."""
    stream = B.batched(spark, sf_dir)
    whole, broken = fresh_path(spark, "dataset"), fresh_path(spark, "dataset")
    tables.write_batches(stream, f"{whole}/stream")
    stored = tables.read_batches(spark, f"{whole}/stream", stream.schema)
    snapshot.write_manifest(snapshot.manifest_of(stored, "stream", "batch_id"), whole)
    damaged = stored.filter("batch_id <> 7").withColumn("BonusMalus", F.col("BonusMalus") + (F.col("batch_id") == 3).cast("int"))
    tables.write_batches(damaged, f"{broken}/stream")
    found = tables.read_batches(spark, f"{broken}/stream", damaged.schema)
    present = snapshot.manifest_of(found, "stream", "batch_id").unionByName(snapshot.manifest_of(found.limit(5), "features"))
    return snapshot.manifest_status(spark.read.schema(snapshot.MANIFEST).parquet(f"{whole}/_manifest"), present)


@query(
    "broken_log_lines",
    """SELECT count(*) AS n_lines, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_broken, TRUE AS numbered FROM orders""",
)
def broken_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of broken records in a log of many files: each file is numbered from 1 without gaps, in its own order."""
    path, key = fresh_path(spark, "log"), F.col("o_orderkey")
    line = F.concat(F.when(key % 10 == 0, F.lit("broken ")).otherwise(F.lit('{"request_id": "')), key, F.when(key % 10 != 0, F.lit('"}')).otherwise(F.lit("")))
    rows = B.table(spark, sf_dir, "orders").repartition(4, key).sortWithinPartitions(key)
    rows.select(line.alias("value")).write.text(path)
    found = F.regexp_extract("value", r"(\d+)", 1).cast("long")
    lines = numbered_lines(spark, path).withColumn("key", found)
    per_file = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("line") == F.count_distinct("line")).alias("gapless"),
        (F.max_by("line", "key") == F.max("line")).alias("ordered"),
    )
    counted = per_file.agg(F.sum("n").alias("n_lines"), F.bool_and(F.col("gapless") & F.col("ordered")).alias("numbered"))
    return side_by_side(counted, tables.broken_lines(spark, path).agg(F.count(F.lit(1)).alias("n_broken")))


@query(
    "hash_consistency",
    """SELECT c_custkey, c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AS consistent FROM customer""",
)
def hash_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    own = F.md5(key.cast("string"))
    hashes = B.table(spark, sf_dir, "customer").select(
        key, own.alias("a"), F.when(key % 7 != 0, own).alias("b"), F.when(key % 11 == 0, F.lit("x")).otherwise(own).alias("c")
    )
    return hashes.select("c_custkey", lifecycle.hash_consistent("a", "b", "c").alias("consistent"))


_RUN_METRICS = [
    "model_auc",
    "model_normalized_gini",
    "baseline_auc",
    "baseline_normalized_gini",
    "brier_score",
    "expected_calibration_error",
    "test_empirical_claim_rate",
    "test_mean_predicted_probability",
]


@query(
    "run_metrics",
    steps("model_metrics")
    + " UNION ALL ".join(
        f"SELECT 'run-1' AS run_id, '{m}' AS metric, round({m}, 9) AS value FROM model_metrics" for m in _RUN_METRICS
    ),
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a run as rows; one that is null is not logged."""
    run = metrics_row(spark, sf_dir)
    return rounded(tables.long_metrics(run, "run_id", [*_RUN_METRICS, "not_measured"]), 9)


def metrics_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tontine.operators import metrics

    return metrics.model_metrics(risk.holdout(spark, sf_dir)).withColumns(
        {"run_id": F.lit("run-1"), "not_measured": F.lit(None).cast("double")}
    )


@query(
    "run_tags",
    steps("snapshot")
    + """SELECT 'run-1' AS run_id, 'dvc_output_hash' AS tag, snapshot_hash AS value FROM snapshot
UNION ALL SELECT 'run-1', 'candidate_source', 'phase7_reference_model' FROM snapshot UNION ALL SELECT 'run-1', 'dataset_git_commit_sha', '' FROM snapshot""",
)
def run_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lifecycle_plans.snapshot(spark, sf_dir).select(
        F.lit("run-1").alias("run_id"),
        F.col("snapshot_hash").alias("dvc_output_hash"),
        F.lit("phase7_reference_model").alias("candidate_source"),
        F.lit(None).cast("string").alias("dataset_git_commit_sha"),
    )
    return tables.long_tags(run, "run_id", ["dvc_output_hash", "candidate_source", "dataset_git_commit_sha"])


def run_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log of a run whose candidate is the scorecard, drift and events being those of the stream."""
    scored = B.scored_table(spark, sf_dir)
    stream_metrics = monitoring.metrics_table(spark, sf_dir, scored)
    reports = risk.acceptance_reports(spark, sf_dir, scored)
    reference = side_by_side(reports[0], reports[1].select("pool_score_coverage")).withColumns(
        {"dvc_tracked_path": F.lit("data/processed"), "dataset_git_commit_sha": F.lit(None).cast("string")}
    )
    latency = F.col("detection_latency_batches")
    log = lifecycle.retraining_events(stream_metrics)
    detection = side_by_side(
        monitoring.evaluations(stream_metrics).agg(
            F.max(F.when(F.col("drift_type") == "data", latency)).alias("data_detection_latency"),
            F.max(F.when(F.col("drift_type") == "concept", latency)).alias("concept_detection_latency"),
        ),
        log.agg(F.count(F.lit(1)).alias("retraining_event_count")),
    )
    selection = log.agg(F.max("trigger_batch").alias("selected_retraining_trigger_batch")).withColumns(
        {
            "retraining_requested": F.col("selected_retraining_trigger_batch").isNotNull(),
            "candidate_source": F.lit("phase9_retrained_candidate"),
        }
    )
    return lifecycle.run_log("run-2", reference, detection, lifecycle_plans.gate(spark, sf_dir, stream_metrics, reports), selection)


_LATENCY = "(SELECT min(batch_id) FILTER (WHERE {0}_drift_detected AND batch_id >= {1}) - {1} FROM drift)"
_LOGGED = {
    **{f"phase7_{m}": f"(SELECT {m} FROM model_metrics)" for m in S.REFERENCE_RUN_METRICS if m != "pool_score_coverage"},
    "phase7_pool_score_coverage": "(SELECT avg(CAST(pool_risk_score IS NOT NULL AS DOUBLE)) FROM pool_risk)",
    "phase8_data_detection_latency": _LATENCY.format("data", 12),
    "phase8_concept_detection_latency": _LATENCY.format("concept", 15),
    "phase8_retraining_event_count": "(SELECT count(*) FROM events_log)",
    "candidate_auc": "(SELECT model_auc FROM model_metrics)",
    "candidate_normalized_gini": "(SELECT model_normalized_gini FROM model_metrics)",
    "candidate_probability_rate_delta": "(SELECT test_probability_rate_delta FROM model_metrics)",
    "candidate_pool_score_coverage": "(SELECT avg(CAST(pool_risk_score IS NOT NULL AS DOUBLE)) FROM pool_risk)",
    "retraining_requested": "(SELECT CAST(count(*) > 0 AS INTEGER) FROM events_log)",
    "selected_retraining_trigger_batch": "(SELECT max(trigger_batch) FROM events_log)",
}


@query(
    "run_log_metrics",
    steps("model_metrics", "pool_risk", "events_log")
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT 'run-2' AS run_id, '{m}' AS metric, round(CAST({v} AS DOUBLE), 9) AS value" for m, v in _LOGGED.items())
    + ") WHERE value IS NOT NULL",
)
def run_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics that a run logs."""
    return rounded(run_reports(spark, sf_dir)[0], 9)


@query(
    "run_log_tags",
    steps("model_gate")
    + """SELECT 'run-2' AS run_id, t.tag, t.value FROM model_gate,
     LATERAL (VALUES ('dvc_output_hash', snapshot_hash), ('dvc_tracked_path', 'data/processed'), ('dataset_git_commit_sha', ''),
       ('phase7_acceptance_passed', CAST(phase7_acceptance_passed AS VARCHAR)), ('phase8_acceptance_passed', CAST(phase8_acceptance_passed AS VARCHAR)),
       ('candidate_source', 'phase9_retrained_candidate'), ('validation_passed', CAST(validation_passed AS VARCHAR))) t(tag, value)""",
)
def run_log_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags that a run sets."""
    return run_reports(spark, sf_dir)[1]


@query(
    "registered_versions",
    steps("pool_gate_checks")
    + f""", passed AS (SELECT c_custkey, phase6_hash, c_custkey % 2 AS turn, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY md5('42:' || c_custkey), c_custkey) AS rn
  FROM pool_gate_checks WHERE len({lifecycle_plans._REASONS}) = 0)
SELECT CAST(rn + CASE WHEN turn = 1 THEN (SELECT count(*) FROM passed WHERE turn = 0) ELSE 0 END AS INTEGER) AS version, CAST(c_custkey AS VARCHAR) AS candidate,
       'run-' || turn AS run_id, phase6_hash AS dvc_output_hash, '' AS dataset_git_commit_sha, 'phase9' AS source_phase, 'passed' AS validation_status,
       'phase7/report' AS phase7_report_path, 'phase8/report' AS phase8_report_path FROM passed""",
)
def registered_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that promote into one registry, which does not exist before the first."""
    gates, path = lifecycle_plans.customer_gates(spark, sf_dir), fresh_path(spark, "registry")
    for turn in range(2):
        promoted = lifecycle.promote(gates.filter(F.col("c_custkey") % 2 == turn), lifecycle.read_versions(spark, path), "c_custkey")
        lifecycle.append_versions(promoted, f"run-{turn}", ("phase7/report", "phase8/report"), path)
    return lifecycle.read_versions(spark, path)


@query(
    "checked_lifecycle_report",
    steps("lifecycle_row")
    + """SELECT *, TRUE AS snapshot_status_checked, FALSE AS snapshot_status_clean,
       'changed stream/batch_id=3' || chr(10) || 'missing stream/batch_id=7' || chr(10) || 'unlisted features' AS snapshot_status_output FROM lifecycle_row""",
)
def checked_lifecycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's report beside the state of a dataset that differs from its manifest in three units."""
    stream_metrics, verdict = lifecycle_plans.measured_stream(spark, sf_dir)
    row = lifecycle_plans.lifecycle_row(spark, stream_metrics, verdict)
    row = row.withColumn("registered_model_version", F.coalesce(F.col("registered_model_version").cast("string"), F.lit("")))
    units = F.when(F.col("batch_id") == 7, F.lit("missing")).when(F.col("batch_id") == 3, F.lit("changed")).otherwise(F.lit("same"))
    status = (
        stream_metrics  # a row per batch of the stream
        .select(F.concat(F.lit("stream/batch_id="), F.col("batch_id").cast("string")).alias("unit"), units.alias("status"))
        .union(spark.createDataFrame([("features", "unlisted")], "unit string, status string"))
    )
    checked = lifecycle.with_snapshot_status(row, status)
    lines = F.array_join(F.array_sort(F.split("snapshot_status_output", "\n")), "\n")
    return checked.withColumn("snapshot_status_output", lines)


@query("artifact_digests")
def artifact_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the stored batches of the stream."""
    path = fresh_path(spark, "artifacts")
    tables.write_batches(B.scorer()(B.stream(spark, sf_dir)), path)
    return snapshot.snapshot_digest(snapshot.artifact_digests(spark, path)).select("files", "bytes", "snapshot_digest")


# --- clustering ---------------------------------------------------------------------------------------

step(
    "vectors",
    (),
    "SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings",
)
step(
    "centroids",
    ("vectors",),
    """SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(v[pos]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS pos FROM vectors) GROUP BY 1, 2) GROUP BY 1""",
)
step(
    "nearest",
    ("vectors", "centroids"),
    """SELECT vec_id, v.label, c.label AS nearest, list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, len(v.v) + 1)]) AS sq_distance
FROM vectors v, centroids c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, len(v.v) + 1)]), c.label) = 1""",
)
step(
    "point_silhouette",
    ("vectors",),
    """SELECT vec_id, label, CASE WHEN n = 1 THEN 0e0 ELSE (b - a) / greatest(a, b) END AS silhouette
FROM (SELECT vec_id, label, max(n) FILTER (WHERE other = label) AS n,
             max(CASE WHEN other = label THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN total / n END) AS b
      FROM (SELECT p.vec_id, p.label, q.label AS other, count(*) AS n, sum(list_distance(p.v, q.v)) AS total FROM vectors p, vectors q GROUP BY 1, 2, 3)
      GROUP BY 1, 2)""",
)


def assigned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = B.table(spark, sf_dir, "embeddings")
    centroids = clustering.label_centroids(points, "label", "embedding")
    return clustering.assign_nearest(points, centroids, "label", "embedding")


@query(
    "nearest_centroid",
    steps("nearest") + "SELECT vec_id, label, nearest, round(sq_distance, 6) AS sq_distance FROM nearest",
)
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assigned_vectors(spark, sf_dir).select("vec_id", "label", "nearest", "sq_distance"))


@query(
    "clustering_inertia",
    steps("nearest") + "SELECT count(*) AS n_points, round(sum(sq_distance), 4) AS inertia FROM nearest",
)
def clustering_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clustering.clustering_inertia(assigned_vectors(spark, sf_dir)), 4)


def vector_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of every vector against all vectors."""
    return clustering.silhouette_table(B.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


@query(
    "silhouette",
    steps("point_silhouette")
    + "SELECT label, count(*) AS n, round(avg(silhouette), 6) AS silhouette FROM point_silhouette GROUP BY 1",
)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vector_silhouette(spark, sf_dir)
    return rounded(points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")))


@query(
    "best_k",
    steps("point_silhouette")
    + """SELECT k AS selected_k, round(s, 6) AS silhouette_score, (SELECT count(DISTINCT label) FROM vectors) AS valid_k
FROM (SELECT CAST(label + 10 AS INTEGER) AS k, avg(silhouette) AS s FROM point_silhouette GROUP BY 1) ORDER BY s DESC, k LIMIT 1""",
)
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner rule, on a scan table whose scores are the label silhouettes."""
    scan = vector_silhouette(spark, sf_dir).groupBy((F.col("label") + 10).cast("int").alias("k")).agg(
        F.avg("silhouette").alias("silhouette_score")
    )
    return rounded(clustering.best_k(scan))


step(
    "squared_silhouette",
    ("vectors", "centroids"),
    """SELECT vec_id, label, CASE WHEN n = 1 THEN 0e0 ELSE (b - a) / greatest(a, b) END AS silhouette
FROM (SELECT p.vec_id, p.label, max(s.n) FILTER (WHERE s.label = p.label) AS n,
             max(CASE WHEN s.label = p.label AND s.n > 1 THEN list_sum([(p.v[i] - c.c[i]) * (p.v[i] - c.c[i]) FOR i IN range(1, len(p.v) + 1)]) + s.within END * s.n / nullif(s.n - 1, 0)) AS a,
             min(CASE WHEN s.label <> p.label THEN list_sum([(p.v[i] - c.c[i]) * (p.v[i] - c.c[i]) FOR i IN range(1, len(p.v) + 1)]) + s.within END) AS b
      FROM vectors p, (SELECT v.label, count(*) AS n, avg(list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, len(v.v) + 1)])) AS within
                       FROM vectors v JOIN centroids c ON v.label = c.label GROUP BY 1) s
      JOIN centroids c ON s.label = c.label GROUP BY 1, 2)""",
)


@query(
    "squared_silhouette",
    steps("squared_silhouette")
    + "SELECT label, count(*) AS n, round(avg(silhouette), 6) AS silhouette FROM squared_silhouette GROUP BY 1",
)
def squared_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes by squared distance, from sums per label: the form for tables of any size."""
    points = clustering.squared_silhouette(B.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return rounded(points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")))


@query(
    "best_k_squared",
    steps("squared_silhouette")
    + """SELECT k AS selected_k, round(s, 6) AS silhouette_score, (SELECT count(DISTINCT label) FROM vectors) AS valid_k
FROM (SELECT CAST(label + 10 AS INTEGER) AS k, avg(silhouette) AS s FROM squared_silhouette GROUP BY 1) ORDER BY s DESC, k LIMIT 1""",
)
def best_k_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner rule on the silhouettes by squared distance."""
    points = clustering.squared_silhouette(B.table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    scan = points.groupBy((F.col("label") + 10).cast("int").alias("k")).agg(F.avg("silhouette").alias("silhouette_score"))
    return rounded(clustering.best_k(scan))


# --- models (no SQL form: checked by tests) ---------------------------------------------------------


@query(
    "standardised_inputs",
    steps("derived")
    + ", s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in S.MODEL_NUMERIC)
    + " FROM derived) SELECT IDpol, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_z" for c in S.MODEL_NUMERIC)
    + " FROM derived, s",
)
def standardised_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(encoding.z_scores(B.contract_features(spark, sf_dir), list(S.MODEL_NUMERIC), ["IDpol"]))


@query("claim_model")
def claim_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout metrics of the calibrated classifier trained on the other policies."""
    from tontine.operators import metrics

    data = risk.split(spark, sf_dir).drop(S.PROBABILITY)
    model = classifier.fit_claim_model(data.filter(~F.col("is_test")))
    return metrics.model_metrics(model.score(data.filter("is_test")))


@query("constructed_pools")
def constructed_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of the best k-means run of ``K_MIN .. K_MAX`` over all policies."""
    result = clustering.construct_pools(B.policies(spark, sf_dir).drop("pool_id"))
    return result.frequency.groupBy("pool_id").agg(F.count(F.lit(1)).alias("pool_size"))


@query(
    "pool_construction",
    steps("policy")
    + f"""SELECT count(*) AS n_policies, {S.K_MIN} AS k_min, {S.K_MAX} AS k_max, CAST({S.K_MAX - S.K_MIN + 1} AS BIGINT) AS k_scanned, TRUE AS selected_is_best,
       TRUE AS inertia_falls, CAST(0 AS BIGINT) AS rows_without_pool, CAST(0 AS BIGINT) AS rows_off_centre, TRUE AS pools_within_k FROM policy""",
)
def pool_construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any construction: every k scored, the best one chosen, every row in the pool of its nearest centre."""
    built = clustering.construct_pools(B.policies(spark, sf_dir).drop("pool_id"))
    pooled = encoding.encode(clustering.clustering_frame(built.frequency), built.encoder)
    points = pooled.select("pool_id", pool_scan.fixed_point(encoding.FEATURES).alias("q"))
    points = points.select("pool_id", F.transform("q", lambda x: x / pool_scan.UNIT).alias("v"))
    rows = [(c, [float(x) for x in centre]) for c, centre in enumerate(built.centres)]
    centres = spark.createDataFrame(rows, "label int, centroid array<double>")
    near = clustering.assign_nearest(points, centres, "label", "v")
    own = F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
    measured = near.join(F.broadcast(centres), F.col("pool_id") == F.col("label"), "left").select(
        "pool_id", (own - F.col("sq_distance")).alias("excess")
    )
    counted = measured.agg(
        F.count(F.lit(1)).alias("n_policies"),
        F.count_if(F.col("excess").isNull()).alias("rows_without_pool"),
        F.count_if(F.col("excess") > 1e-9).alias("rows_off_centre"),
        F.count_distinct("pool_id").alias("pools"),
    )
    scan = built.scan.agg(
        F.min("k").alias("k_min"),
        F.max("k").alias("k_max"),
        F.count("inertia").alias("k_scanned"),
        (F.max_by("k", F.struct("silhouette_score", -F.col("k"))) == built.selected_k).alias("selected_is_best"),
        (F.max_by("inertia", "k") < F.min_by("inertia", "k")).alias("inertia_falls"),
    )
    both = side_by_side(counted, scan)
    return both.withColumn("pools_within_k", F.col("pools") <= built.selected_k).drop("pools")


@query("anomaly_scores")
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.anomaly_scores(B.contract_features(spark, sf_dir))


@query(
    "stored_anomaly_model",
    steps("policy")
    + f"""SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS scored_otherwise, TRUE AS scores_in_range, TRUE AS flags_within_share,
       {anomaly.N_TREES} AS trees, 'refused' AS other_version FROM policy""",
)
def stored_anomaly_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anomaly model stored and loaded again: the same scores and flags for every contract."""
    features, path = spool(B.contract_features(spark, sf_dir), "contract-features"), fresh_path(spark, "anomaly-model")
    model = anomaly.fit_anomaly_model(features)
    model.save(path)
    loaded = anomaly.AnomalyModel.load(spark, path)
    again = loaded.score(features).select("IDpol", F.col("anomaly_score").alias("again"), F.col("anomaly_flag").alias("flag_again"))
    both = model.score(features).join(again, "IDpol")
    odd = (F.col("anomaly_score") != F.col("again")) | (F.col("anomaly_flag") != F.col("flag_again"))
    most = F.ceil(F.count(F.lit(1)) * F.lit(S.ANOMALY_CONTAMINATION))
    other = fresh_path(spark, "anomaly-model")
    model.save(other)
    report = spark.read.json(f"{path}/report").withColumn("schema_version", F.lit(anomaly.MODEL_VERSION + 1))
    report.write.mode("overwrite").json(f"{other}/report")
    try:
        anomaly.AnomalyModel.load(spark, other)
        verdict = "accepted"
    except anomaly.ModelFormatError:
        verdict = "refused"
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(odd).alias("scored_otherwise"),
        F.bool_and(F.col("anomaly_score").between(0.0, 1.0)).alias("scores_in_range"),
        (F.sum("anomaly_flag") <= most).alias("flags_within_share"),
        F.lit(loaded.trees).alias("trees"),
        F.lit(verdict).alias("other_version"),
    )


@query(
    "stored_claim_model",
    fitted("split", "claim_scores", "claim_auc")
    + """SELECT count(*) AS n_rows, sum(target_has_claim)::BIGINT AS positives, CAST(0 AS BIGINT) AS scored_otherwise,
       (SELECT auc > 0.5e0 FROM claim_auc) AS better_than_chance,
       (SELECT abs(avg(p) - avg(y)) < 0.05e0 FROM claim_scores) AS calibrated FROM split WHERE is_test""",
)
def stored_claim_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated classifier stored and loaded again: scores that differ, and whether it is better than chance on the
    policies held out (AUC above 0.5; labels that do not depend on the features give either answer) and close to their rate."""
    from tontine.operators import metrics

    data = risk.split(spark, sf_dir).drop(S.PROBABILITY)
    model, path = classifier.fit_claim_model(data.filter(~F.col("is_test"))), fresh_path(spark, "claim-model")
    model.save(path)
    held = data.filter("is_test")
    first = model.score(held).select("IDpol", S.TARGET, S.PROBABILITY)
    again = classifier.load_scorer(spark, path)(held).select("IDpol", F.col(S.PROBABILITY).alias("again"))
    counted = first.join(again, "IDpol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(S.TARGET).cast("bigint").alias("positives"),
        F.count_if(F.col(S.PROBABILITY) != F.col("again")).alias("scored_otherwise"),
        (F.abs(F.avg(S.PROBABILITY) - F.avg(S.TARGET)) < 0.05).alias("calibrated"),
    )
    return side_by_side(counted, metrics.roc_auc(first).select((F.col("auc") > 0.5).alias("better_than_chance")))


@query("online_updates")
def online_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of the online candidate before each batch's update."""
    stream = scoring.model_inputs(B.stream(spark, sf_dir))
    encoder = encoding.fit_encoder(stream.filter(F.col("batch_id") <= S.REFERENCE_LAST_BATCH))
    encoded = spool(
        encoding.encode(stream, encoder).select("batch_id", S.TARGET, encoding.FEATURES), "encoded", ["batch_id"]
    )
    return online.state_table(encoded, online.replay_online(encoded, S.N_BATCHES))


@query("retrained_candidate")
def retrained_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout metrics of the candidate refitted on the latest event's rows."""
    from tontine.operators import metrics

    scored = B.scored_table(spark, sf_dir)
    stream, log = lifecycle_plans.events(spark, sf_dir, scored)
    data = risk.split(spark, sf_dir, scored).drop(S.PROBABILITY)
    candidate = lifecycle.retrain_candidate(log, stream.drop(S.PROBABILITY), data.filter("is_test").select("IDpol"))
    return metrics.model_metrics(candidate.model.score(data.filter("is_test"))).withColumns(
        {
            "candidate_training_rows": F.lit(candidate.training_rows),
            "retraining_rows_removed_for_holdout": F.lit(candidate.removed_for_holdout),
        }
    )


@query(
    "candidate_training_aucs",
    steps("events_log")
    + "SELECT trigger_batch, training_window_batches, training_rows, CAST(training_rows AS BIGINT) AS rows_fitted, TRUE AS auc_sound FROM events_log",
)
def candidate_training_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training AUC of every event's candidate, stated as what must hold of it: known, and better than chance."""
    from tontine.operators.event_fits import candidate_aucs

    stream, log = lifecycle_plans.events(spark, sf_dir)
    bare = stream.drop(S.PROBABILITY)
    encoder = encoding.fit_encoder(scoring.model_inputs(bare.filter(F.col("batch_id") <= S.REFERENCE_LAST_BATCH)))
    found = candidate_aucs(log, bare, encoder).withColumnRenamed("training_rows", "rows_fitted")
    return log.join(F.broadcast(found), "trigger_batch", "left").select(
        "trigger_batch", "training_window_batches", "training_rows", "rows_fitted", F.col("auc").between(0.5, 1.0).alias("auc_sound")
    )


# --- streaming forms -----------------------------------------------------------------------------------


#: Rows of an arriving file, about, and files of a batch at least.
FILE_ROWS, LEAST_FILES = 1 << 17, 3


def files_per_batch(rows: int) -> int:
    """Files that each batch of a stream of ``rows`` rows arrives in."""
    return max(LEAST_FILES, -(-rows // (S.N_BATCHES * FILE_ROWS)))


def monitored(spark: SparkSession, sf_dir: str) -> drift_monitor.DriftMonitor:
    """A monitor that has seen the stream file by file, with each batch in several files."""
    batches = B.batched(spark, sf_dir)
    stream, files = B.rewritten(batches), files_per_batch(batches.count())
    source, sink, state = (fresh_path(spark, n) for n in ("arriving", "counts", "state"))
    place = F.col("batch_id") * files + F.pmod(F.xxhash64("IDpol"), F.lit(files)).cast("int")  # a task writes one file
    stream.repartitionById(S.N_BATCHES * files, place).write.partitionBy("batch_id").parquet(source)
    stored = spark.read.schema(stream.schema).parquet(source)
    monitor = drift_monitor.DriftMonitor.of(stored, B.scorer(), sink)
    arriving = drift_monitor.stream_batches(spark, source, stream.schema, files_per_trigger=16 * files // LEAST_FILES)
    monitor.start(arriving, state, available_now=True).awaitTermination()
    return monitor


@query("streamed_drift_metrics", steps("drift") + monitoring.DRIFT_SELECT)
def streamed_drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor fed batches in parts; must equal the whole-table form."""
    return monitoring.round_metrics(monitored(spark, sf_dir).metrics(spark))


@query("streamed_retraining_events", steps("events_log") + f"SELECT {', '.join(lifecycle_plans.EVENT_COLUMNS)} FROM events_log")
def streamed_retraining_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the monitor fed batches in parts; must equal those of the whole table."""
    return monitored(spark, sf_dir).events(spark).select(*lifecycle_plans.EVENT_COLUMNS)


@query(
    "streamed_scores",
    steps("scored")
    + """SELECT IDpol AS request_id, CAST(pool_id AS VARCHAR) AS pool_id, CASE WHEN BonusMalus < 60 THEN 'rejected' ELSE 'scored' END AS outcome,
       CASE WHEN BonusMalus >= 60 THEN round(predicted_claim_probability, 9) END AS probability FROM scored""",
)
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies sent as scoring requests through the live path; some break a rule."""
    requests_table = B.cleaned(spark, sf_dir).select(
        F.col("IDpol").alias("request_id"),
        F.col("pool_id").cast("string").alias("pool_id"),
        *(F.col(c) for c in S.SERVING_COLUMNS if c not in ("pool_id", "BonusMalus")),
        F.when(F.col("BonusMalus") < 60, F.lit(-1)).otherwise(F.col("BonusMalus")).alias("BonusMalus"),
    )
    source, root, state = (fresh_path(spark, n) for n in ("requests", "live", "state"))
    requests_table.write.parquet(source)
    policy = lineage.trace_policy(salt="live-salt")
    live = live_scoring.LiveScoring(B.scorer(), {"model_source": "phase7_reference_model"}, policy, root)
    arriving = spark.readStream.schema(requests_table.schema).parquet(source)
    live.start(arriving, state, available_now=True).awaitTermination()
    scores = spark.read.parquet(f"{root}/scores").select(
        "request_id", "pool_id", F.lit("scored").alias("outcome"), F.round(S.PROBABILITY, 9).alias("probability")
    )
    rejects = spark.read.parquet(f"{root}/rejects").select("request_id", F.lit("rejected").alias("outcome"))
    lost = rejects.join(spark.read.parquet(source).select("request_id", "pool_id"), "request_id")
    return scores.unionByName(lost.select("request_id", "pool_id", "outcome"), allowMissingColumns=True)


@query(
    "streamed_pool_decisions",
    steps("scored")
    + f"""SELECT CAST(pool_id AS VARCHAR) AS request_id, '/score/pool' AS endpoint, 'phase9_retrained_candidate' AS model_source, count(*) AS contract_count,
       round(avg(predicted_claim_probability), 9) AS mean_probability,
       round(CASE WHEN sum(Exposure) > 0 THEN sum(predicted_claim_probability * Exposure) / sum(Exposure) ELSE avg(predicted_claim_probability) END, 9) AS pool_risk_score,
       round(sum(Exposure), 6) AS pool_scored_exposure,
       CASE WHEN sum(Exposure) > 0 THEN 'exposure_weighted' ELSE 'unweighted_zero_exposure_fallback' END AS pool_score_weighting_method,
       {lifecycle_plans.hmac_sql(b"live-salt", f"string_agg({lifecycle_plans.hmac_sql(b'live-salt', lifecycle_plans.payload_sql(*S.SERVING_COLUMNS))}, ',' ORDER BY IDpol)")} AS input_fingerprint,
       CAST(0 AS BIGINT) AS trace_log_failures_total
FROM scored WHERE pool_id % 5 <> 0 GROUP BY pool_id""",
)
def streamed_pool_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool request per pool, its members scattered over files and micro-batches; every fifth names another pool."""
    members = B.cleaned(spark, sf_dir)
    sizes = members.groupBy("pool_id").agg(F.count(F.lit(1)).alias("contract_count"))
    rows = members.join(sizes, "pool_id").select(
        F.col("pool_id").cast("string").alias("request_id"),
        F.when(F.col("pool_id") % 5 == 0, F.lit("other")).otherwise(F.col("pool_id").cast("string")).alias("request_pool_id"),
        "contract_count",
        F.col("IDpol").alias("member_index"),
        *S.SERVING_COLUMNS,
    )
    source, root, state = (fresh_path(spark, n) for n in ("members", "live-pools", "state"))
    rows.repartition(6, "member_index").write.parquet(source)
    policy = lineage.trace_policy(salt="live-salt")
    live = live_scoring.LivePools(B.scorer(), {"model_source": "phase9_retrained_candidate"}, policy, root)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    live.start(arriving, state, available_now=True).awaitTermination()
    records = live.decisions(spark).select(
        "request_id", "endpoint", "model_source", "prediction_summary.*", "input_fingerprint"
    )
    return rounded(side_by_side(records, live.trace_log_failures(spark)), 9, pool_scored_exposure=6)


@query(
    "decision_records",
    steps("scored")
    + f"""SELECT CAST(IDpol AS VARCHAR) AS request_id, sha256('decision:' || IDpol) AS decision_id, '/score/contract' AS endpoint, 'phase7_reference_model' AS model_source,
       round(predicted_claim_probability, 9) AS mean_probability, 'env_var' AS trace_salt_mode,
       {lifecycle_plans.hmac_sql(b"live-salt", lifecycle_plans.payload_sql(*S.SERVING_COLUMNS))} AS input_fingerprint
FROM scored""",
)
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch form of live scoring: whitelisted decision records with keyed fingerprints."""
    contracts = B.cleaned(spark, sf_dir).withColumn("request_id", F.col("IDpol"))
    scored, _ = live_scoring.score_contracts(contracts, B.scorer())
    policy = lineage.trace_policy(salt="live-salt")
    rows = live_scoring.contract_decisions(scored, {"model_source": "phase7_reference_model"}, policy)
    return rounded(
        rows.select(
            "request_id",
            "decision_id",
            "endpoint",
            "model_source",
            F.col("prediction_summary.mean_probability").alias("mean_probability"),
            "trace_salt_mode",
            "input_fingerprint",
        ),
        9,
    )


@query(
    "pool_requests",
    steps("scored")
    + """SELECT CAST(pool_id AS VARCHAR) AS request_id, count(*) AS pool_contract_count, round(sum(Exposure), 6) AS pool_scored_exposure,
       round(CASE WHEN sum(Exposure) > 0 THEN sum(predicted_claim_probability * Exposure) / sum(Exposure) ELSE avg(predicted_claim_probability) END, 9) AS pool_risk_score,
       CASE WHEN sum(Exposure) > 0 THEN 'exposure_weighted' ELSE 'unweighted_zero_exposure_fallback' END AS pool_score_weighting_method
FROM scored WHERE pool_id % 5 <> 0 GROUP BY pool_id""",
)
def pool_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool request per pool; every fifth names another pool and is rejected."""
    members = B.cleaned(spark, sf_dir).withColumns(
        {
            "request_id": F.col("pool_id").cast("string"),
            "request_pool_id": F.when(F.col("pool_id") % 5 == 0, F.lit("other")).otherwise(F.col("pool_id").cast("string")),
        }
    )
    scores, _ = live_scoring.pool_decisions(members, B.scorer())
    return rounded(scores.drop("mean_probability"), pool_risk_score=9)


@query(
    "streamed_request_windows",
    steps("request_windows")
    + f"SELECT window_start, path, request_count, error_count, round(latency_sum, 4) AS latency_sum, {_LE} FROM request_windows",
)
def streamed_request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows of the event stream; files hold events of all ages and arrive over several micro-batches."""
    events = B.table(spark, sf_dir, "events")
    source, sink, state = (fresh_path(spark, n) for n in ("events", "windows", "state"))
    events.repartition(6, "event_id").write.parquet(source)
    arriving = as_requests(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source))
    live = live_metrics.LiveWindows(LATENCY_EDGES, sink)
    live.start(arriving, state, available_now=True).awaitTermination()
    return rounded(plain_time(live.windows(spark)), 4)


@query(
    "closed_request_windows",
    steps("request_windows")
    + f"""SELECT window_start, path, request_count, error_count, round(latency_sum, 4) AS latency_sum, {_LE} FROM request_windows
WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM requests)""",
)
def closed_request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows the watermark has closed by the end of the event stream."""
    events = B.table(spark, sf_dir, "events")
    source, sink, state = (fresh_path(spark, n) for n in ("events", "windows", "state"))
    events.write.parquet(source)
    arriving = as_requests(spark.readStream.schema(events.schema).parquet(source))
    windows = live_metrics.windowed_requests(arriving, LATENCY_EDGES)
    live_metrics.start(windows, sink, state, available_now=True).awaitTermination()
    return rounded(plain_time(spark.read.schema(windows.schema).parquet(sink)), 4)


@query(
    "streamed_online_updates",
    steps("stream")
    + """SELECT CAST(batch_id + 2 AS INTEGER) AS step, batch_id, count(*) AS n_rows, FALSE AS late, TRUE AS finite_loss FROM stream GROUP BY batch_id
UNION ALL SELECT 1, -1, count(*), FALSE, TRUE FROM stream WHERE batch_id <= 9""",
)
def streamed_online_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the online candidate inside the micro-batch loop, every batch in several files; step 1 is the reference fit."""
    stream = B.stream(spark, sf_dir)
    path, source, sink, state = (fresh_path(spark, n) for n in ("online", "arriving", "online-state", "state"))
    tables.write_batches(stream, path)
    stored = tables.read_batches(spark, path, stream.schema)
    files = files_per_batch(stored.count())
    for batch_id in range(S.N_BATCHES):  # one after the other, as batches come into being
        tables.read_batch(spark, path, batch_id, stream.schema).repartition(files, "IDpol").write.mode("append").parquet(source)
    reference = scoring.model_inputs(stored.filter(F.col("batch_id") <= S.REFERENCE_LAST_BATCH))
    encoder = encoding.fit_encoder(reference)
    encoded = encoding.encode(reference, encoder)
    width = encoded.select(encoding.FEATURES).first()[0].size
    first = online.partial_fit(encoded, online.OnlineModel.zeros(width))
    live = online_stream.OnlineUpdates(encoder, first, sink)
    arriving = drift_monitor.stream_batches(spark, source, stream.schema, files_per_trigger=7 * files // LEAST_FILES)
    live.start(arriving, state, available_now=True).awaitTermination()
    # The first loss of zero weights is ln 2.
    start = spark.createDataFrame([(1, -1, 0, abs(first.history[0][1] - math.log(2)) > 1e-9, True)], "step int, batch_id int, n_rows long, late boolean, finite_loss boolean")
    rows = side_by_side(start.drop("n_rows"), reference.agg(F.count(F.lit(1)).alias("n_rows")))
    finite = ~F.isnan("log_loss") & F.col("log_loss").between(0.0, 5.0)
    return live.steps(spark).select("step", "batch_id", "n_rows", "late", finite.alias("finite_loss")).unionByName(rows)
