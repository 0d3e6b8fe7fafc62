"""Retraining events, candidate data, gates, promotion, model resolution and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.functions.hashing import canonical_json, keyed_fingerprint
from tontine.operators import batching, drift, lifecycle, lineage, metrics, scoring
from tontine.operators.reports import side_by_side
from tontine.plans import binding as B
from tontine.plans import monitoring, risk
from tontine.plans.registry import query, rounded, step, steps
from tontine.sources.shared import spool

step(
    "events_log",
    ("drift",),
    """SELECT batch_id AS trigger_batch,
       CASE WHEN data_drift_detected AND concept_drift_detected THEN 'data_and_concept' WHEN data_drift_detected THEN 'data' ELSE 'concept' END AS triggering_detector,
       'sliding_window_retraining_candidate' AS event_type, greatest(batch_id - 4, 0) AS window_start_batch, batch_id AS window_end_batch,
       array_to_string(range(greatest(batch_id - 4, 0), batch_id + 1), ',') AS training_window_batches,
       CAST(window_rows AS BIGINT) AS window_rows, replay_rows, CAST(window_rows + replay_rows AS BIGINT) AS training_rows
FROM (SELECT *, sum(row_count) OVER (ORDER BY batch_id RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS window_rows,
             CAST(round_even(0.1e0 * (SELECT sum(row_count) FROM drift WHERE batch_id <= 9), 0) AS BIGINT) AS replay_rows FROM drift)
WHERE data_drift_detected OR concept_drift_detected""",
)
step(
    "candidate_rows",
    ("events_log", "scored_stream"),
    """SELECT trigger_batch, 'window' AS origin, s.IDpol, s.target_has_claim FROM events_log e
JOIN scored_stream s ON s.batch_id BETWEEN e.window_start_batch AND e.window_end_batch
UNION ALL
SELECT trigger_batch, 'replay', r.IDpol, r.target_has_claim FROM events_log,
  (SELECT * FROM scored_stream WHERE batch_id <= 9
   QUALIFY row_number() OVER (ORDER BY md5('42:' || IDpol), IDpol) <= (SELECT CAST(round_even(count(*) * 0.1e0, 0) AS BIGINT) FROM scored_stream WHERE batch_id <= 9)) r""",
)
EVENT_COLUMNS = (
    "trigger_batch triggering_detector event_type window_start_batch window_end_batch training_window_batches"
    " window_rows replay_rows training_rows"
).split()


def events(spark: SparkSession, sf_dir: str, policies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored stream and its retraining events."""
    stream = B.scored_stream(spark, sf_dir, policies)
    metrics_rows = spool(drift.drift_metrics(stream), "drift-metrics")
    return stream, lifecycle.retraining_events(metrics_rows)


@query("retraining_events", steps("events_log") + f"SELECT {', '.join(EVENT_COLUMNS)} FROM events_log")
def retraining_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)[1].select(*EVENT_COLUMNS)


@query(
    "latest_event",
    steps("events_log") + f"SELECT {', '.join(EVENT_COLUMNS)} FROM events_log ORDER BY trigger_batch DESC LIMIT 1",
)
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_event(events(spark, sf_dir)[1]).select(*EVENT_COLUMNS)


@query("retraining_requested", steps("events_log") + "SELECT count(*) > 0 AS retraining_requested FROM events_log")
def retraining_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retraining_requested(events(spark, sf_dir)[1])


@query(
    "sliding_batch_windows",
    steps("indexed")
    + """SELECT CAST(t.b AS INTEGER) AS trigger_batch, batch_id, count(*) AS row_count
FROM range(20) t(b) JOIN indexed ON batch_id BETWEEN t.b - 4 AND t.b GROUP BY 1, 2""",
)
def sliding_batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the five-batch window that ends at each batch."""
    triggers = spark.range(S.N_BATCHES).select(F.col("id").cast("int").alias("trigger_batch"))
    rows = batching.sliding_windows(triggers, B.batched(spark, sf_dir))
    return rows.groupBy("trigger_batch", "batch_id").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "window_union_replay",
    steps("candidate_rows")
    + """SELECT trigger_batch, origin, count(*) AS row_count, count(DISTINCT IDpol) AS policies, CAST(sum(target_has_claim) AS BIGINT) AS positives
FROM candidate_rows GROUP BY 1, 2""",
)
def window_union_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, log = events(spark, sf_dir)
    rows = lifecycle.candidate_rows(log, stream)
    return rows.groupBy("trigger_batch", "origin").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("IDpol").alias("policies"),
        F.sum(S.TARGET).alias("positives"),
    )


@query(
    "reference_batches",
    steps("indexed")
    + "SELECT pool_id, count(*) AS row_count, round(sum(Exposure), 6) AS exposure FROM indexed WHERE batch_id BETWEEN 0 AND 9 GROUP BY 1",
)
def reference_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference batches taken together, by pool."""
    reference = B.batched(spark, sf_dir).filter(F.col("batch_id").between(0, S.REFERENCE_LAST_BATCH))
    return rounded(
        reference.groupBy("pool_id").agg(F.count(F.lit(1)).alias("row_count"), F.sum("Exposure").alias("exposure"))
    )


@query(
    "holdout_exclusion",
    steps("candidate_rows", "split")
    + """SELECT trigger_batch, count(*) AS rows_before, count(*) FILTER (WHERE is_test) AS retraining_rows_removed_for_holdout,
       count(*) FILTER (WHERE NOT is_test) AS candidate_training_rows,
       count(DISTINCT CASE WHEN NOT is_test THEN c.target_has_claim END) AS class_count
FROM candidate_rows c JOIN (SELECT IDpol, is_test FROM split) s ON c.IDpol = s.IDpol GROUP BY 1""",
)
def holdout_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = B.scored_table(spark, sf_dir)
    stream, log = events(spark, sf_dir, scored)
    holdout = risk.holdout(spark, sf_dir, scored).select("IDpol")
    return lifecycle.holdout_report(lifecycle.candidate_rows(log, stream), holdout)


@query(
    "exclude_holdout",
    steps("split") + "SELECT pool_id, count(*) AS n FROM split WHERE NOT is_test GROUP BY 1",
)
def exclude_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = risk.split(spark, sf_dir)
    kept = lifecycle.exclude_holdout(data, data.filter("is_test"))
    return kept.groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "holdout_predictions",
    steps("holdout")
    + "SELECT IDpol, target_has_claim, round(predicted_claim_probability, 9) AS predicted_claim_probability FROM holdout",
)
def holdout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lifecycle.holdout_predictions(risk.split(spark, sf_dir), B.scorer()), 9)


# --- gate, promotion, resolution ------------------------------------------------------------

step(
    "snapshot",
    (),
    "SELECT md5(count(*) || ':' || CAST(sum(o_orderkey) AS BIGINT)) AS snapshot_hash FROM orders",
)
step(
    "model_gate",
    ("model_metrics", "pool_risk", "drift", "snapshot"),
    """SELECT *, phase7_acceptance_passed AND phase8_acceptance_passed AND auc_beats_baseline AND calibration_delta_passed AS validation_passed
FROM (SELECT model_auc > 0.5 AND c = 1 AS phase7_acceptance_passed,
       coalesce(d - 12 <= 2, FALSE) AND coalesce(k - 15 <= 2, FALSE) AS phase8_acceptance_passed,
       c = 1 AS pool_score_coverage_passed, model_auc > baseline_auc AS auc_beats_baseline, delta <= 0.005 AS calibration_delta_passed,
       model_auc, delta, snapshot_hash
FROM (SELECT model_auc, baseline_auc, test_probability_rate_delta AS delta FROM model_metrics), snapshot,
     (SELECT count(pool_risk_score) / CAST(count(*) AS DOUBLE) AS c FROM pool_risk),
     (SELECT min(batch_id) FILTER (WHERE data_drift_detected AND batch_id >= 12) AS d,
             min(batch_id) FILTER (WHERE concept_drift_detected AND batch_id >= 15) AS k FROM drift))""",
)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.table(spark, sf_dir, "orders")
    text = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("o_orderkey").cast("string"))
    return orders.agg(F.md5(text).alias("snapshot_hash"))


def gate(spark: SparkSession, sf_dir: str, stream_metrics: DataFrame, reports: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The stored gate report of the scorecard as candidate; ``reports`` are those of ``risk.acceptance_reports``."""
    verdict = metrics.accepted(*reports)
    detections = monitoring.evaluations(stream_metrics).agg(
        F.bool_and("detected_within_provisional_threshold").alias("phase8_accepted")
    )
    row = side_by_side(verdict, detections, snapshot(spark, sf_dir)).select(
        F.col("acceptance_passed").alias("phase7_accepted"),
        "phase8_accepted",
        *(F.col("snapshot_hash").alias(h) for h in ("phase6_hash", "phase7_hash", "phase8_hash", "metadata_hash")),
        "pool_score_coverage",
        F.col("model_auc").alias("candidate_auc"),
        "baseline_auc",
        F.col("model_normalized_gini").alias("candidate_normalized_gini"),
        "baseline_normalized_gini",
        F.col("test_probability_rate_delta").alias("probability_rate_delta"),
    )
    return spool(lifecycle.validation_gate(row), "validation-report")


def measured_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drift metrics of the stream and the gate's report, both from one table of scored policies."""
    scored = B.scored_table(spark, sf_dir)
    stream_metrics = monitoring.metrics_table(spark, sf_dir, scored)
    return stream_metrics, gate(spark, sf_dir, stream_metrics, risk.acceptance_reports(spark, sf_dir, scored))


@query(
    "candidate_validation",
    steps("model_gate")
    + """SELECT phase7_acceptance_passed, phase8_acceptance_passed, TRUE AS dvc_hash_consistent, TRUE AS dvc_metadata_hash_matches_report,
       pool_score_coverage_passed, auc_beats_baseline, auc_beats_baseline AS gini_beats_baseline, calibration_delta_passed, validation_passed,
       round(model_auc, 9) AS candidate_auc, round(delta, 9) AS probability_rate_delta, snapshot_hash AS dvc_output_hash FROM model_gate""",
)
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = measured_stream(spark, sf_dir)[1]
    return rounded(
        result.select(
            *lifecycle.GATE_CHECKS, "validation_passed", "candidate_auc", "probability_rate_delta", "dvc_output_hash"
        ),
        9,
    )


step(
    "pool_gates",
    (),
    """SELECT c_custkey, c_nationkey % 4 <> 0 AS phase7_accepted, c_nationkey % 5 <> 0 AS phase8_accepted,
       'h' || c_custkey % 3 AS phase6_hash, 'h' || c_custkey % 3 AS phase7_hash,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'h' || c_custkey % 3 END AS phase8_hash,
       CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'h' || c_custkey % 3 END AS metadata_hash,
       c_acctbal FROM customer""",
)
step(
    "pool_gate_checks",
    ("pool_gates",),
    """SELECT c_custkey, phase6_hash, phase7_accepted AS a, phase8_accepted AS b, coalesce(phase6_hash = phase7_hash AND phase7_hash = phase8_hash, FALSE) AS c,
       metadata_hash = phase6_hash AS d, c_acctbal > -500 AS e, 0.5e0 + c_acctbal / 20000e0 > 0.5e0 AS f, c_acctbal / 10000e0 > 0e0 AS g, abs(c_acctbal) / 1000000e0 <= 0.005e0 AS h FROM pool_gates""",
)
_REASONS = "[x FOR x IN [" + ", ".join(
    f"CASE WHEN NOT {letter} THEN '{name}' END" for letter, name in zip("abcdefgh", lifecycle.GATE_CHECKS)
) + "] IF x IS NOT NULL]"


def customer_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One made-up report per customer, in which every check fails for some."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    own = F.concat(F.lit("h"), (key % 3).cast("string"))
    reports = B.table(spark, sf_dir, "customer").select(
        key,
        (F.col("c_nationkey") % 4 != 0).alias("phase7_accepted"),
        (F.col("c_nationkey") % 5 != 0).alias("phase8_accepted"),
        own.alias("phase6_hash"),
        own.alias("phase7_hash"),
        F.when(key % 7 != 0, own).alias("phase8_hash"),
        F.when(key % 11 == 0, F.lit("other")).otherwise(own).alias("metadata_hash"),
        F.when(balance > -500, F.lit(1.0)).otherwise(F.lit(0.9)).alias("pool_score_coverage"),
        (F.lit(0.5) + balance / F.lit(20000.0)).alias("candidate_auc"),
        F.lit(0.5).alias("baseline_auc"),
        (balance / F.lit(10000.0)).alias("candidate_normalized_gini"),
        F.lit(0.0).alias("baseline_normalized_gini"),
        (F.abs(balance) / F.lit(1000000.0)).alias("probability_rate_delta"),
    )
    return lifecycle.validation_gate(reports)


@query(
    "validation_gate",
    steps("pool_gate_checks")
    + f"""SELECT c_custkey, {_REASONS} AS failure_reasons, len({_REASONS}) = 0 AS validation_passed,
       c AS dvc_hash_consistent, CASE WHEN c THEN phase6_hash END AS dvc_output_hash FROM pool_gate_checks""",
)
def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_gates(spark, sf_dir).select(
        "c_custkey", "failure_reasons", "validation_passed", "dvc_hash_consistent", "dvc_output_hash"
    )


@query(
    "promoted_versions",
    steps("pool_gate_checks")
    + f"""SELECT CAST(1500 + row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS INTEGER) AS version, c_custkey AS candidate, phase6_hash AS dvc_output_hash,
       'phase9' AS source_phase, 'passed' AS validation_status FROM pool_gate_checks WHERE len({_REASONS}) = 0""",
)
def promoted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions for validated customers' candidates, after a registry that ends at 1500."""
    registry = B.table(spark, sf_dir, "nation").select(F.lit(1500).alias("version"))
    return lifecycle.promote(customer_gates(spark, sf_dir), registry, "c_custkey")


step(
    "model_candidates",
    (),
    """SELECT c_custkey, 1 AS priority, 'env_override' AS source, c_custkey % 5 = 0 AS eligible, c_custkey % 10 = 0 AS valid, md5('e' || c_custkey) AS sha, NULL AS trigger FROM customer
UNION ALL SELECT c_custkey, 2, 'phase9_retrained_candidate', c_custkey % 3 = 0, c_custkey % 9 <> 0, md5('c' || c_custkey), CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 20 END FROM customer
UNION ALL SELECT c_custkey, 3, 'phase7_reference_model', c_custkey % 2 = 0, TRUE, md5('r' || c_custkey), NULL FROM customer""",
)
_CYCLE_ID = """CASE source WHEN 'phase7_reference_model' THEN 'phase7-reference:' || sha WHEN 'env_override' THEN 'env-override:' || sha
            WHEN 'phase9_retrained_candidate' THEN 'phase9:' || CASE WHEN trigger IS NULL THEN '' ELSE trigger || ':' END || sha END"""


def model_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three serving candidates per customer."""
    key = F.col("c_custkey")
    nobody = F.lit(None).cast("bigint")

    def candidate(priority, source, eligible, valid, prefix, trigger):
        return F.struct(
            F.lit(priority).alias("priority"),
            F.lit(source).alias("source"),
            eligible.alias("eligible"),
            valid.alias("valid"),
            F.md5(F.concat(F.lit(prefix), key.cast("string"))).alias("artifact_sha256"),
            trigger.alias("trigger_batch"),
        )

    rows = F.array(
        candidate(1, "env_override", key % 5 == 0, key % 10 == 0, "e", nobody),
        candidate(2, "phase9_retrained_candidate", key % 3 == 0, key % 9 != 0, "c", F.when(key % 2 == 0, key % 20)),
        candidate(3, "phase7_reference_model", key % 2 == 0, F.lit(True), "r", nobody),
    )
    return B.table(spark, sf_dir, "customer").select("c_custkey", F.inline(rows))


@query(
    "cycle_ids",
    steps("model_candidates") + f"SELECT c_custkey, source, {_CYCLE_ID} AS retraining_cycle_id FROM model_candidates",
)
def cycle_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_candidates(spark, sf_dir).select(
        "c_custkey", "source", X.cycle_id("source", "artifact_sha256", "trigger_batch").alias("retraining_cycle_id")
    )


@query(
    "resolved_models",
    steps("model_candidates")
    + f"""SELECT c_custkey, CASE WHEN v THEN source ELSE 'unavailable' END AS selected_model_source, v AS model_loaded,
       CASE WHEN v THEN sha END AS selected_model_artifact_sha256, CASE WHEN v THEN {_CYCLE_ID} ELSE 'unavailable' END AS retraining_cycle_id,
       CASE WHEN v THEN NULL WHEN source IS NULL THEN 'no validated model artifact' ELSE 'invalid artifact: ' || source END AS deployment_error
FROM (SELECT c.c_custkey, m.source, m.sha, m.trigger, coalesce(m.valid, FALSE) AS v FROM customer c
      LEFT JOIN (SELECT * FROM model_candidates WHERE eligible QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY priority) = 1) m ON c.c_custkey = m.c_custkey)""",
)
def resolved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.resolve_model(model_candidates(spark, sf_dir), "c_custkey")


# --- lineage --------------------------------------------------------------------------------

step(
    "context",
    ("events_log", "snapshot"),
    """SELECT CAST(b AS VARCHAR) AS selected_batch, 'phase9_retrained_candidate' AS serving_source, snapshot_hash AS serving_sha,
       'phase9:' || b || ':' || snapshot_hash AS serving_cycle_id, '/models/candidate' AS serving_path, 'true' AS validation_passed,
       'true' AS model_registered, '1' AS registered_model_version, snapshot_hash AS dvc_output_hash, 'unknown' AS dataset_git_commit_sha
FROM (SELECT max(trigger_batch) AS b FROM events_log), snapshot""",
)
step(
    "cycles",
    ("events_log", "context"),
    """SELECT CASE WHEN s THEN serving_cycle_id ELSE 'phase8-event:' || trigger_batch END AS retraining_cycle_id,
       CASE WHEN s THEN 'phase9_served_retraining_cycle' ELSE 'phase8_retraining_event' END AS cycle_source,
       CAST(trigger_batch AS VARCHAR) AS trigger_batch, triggering_detector, training_window_batches,
       CASE WHEN s THEN validation_passed ELSE '' END AS validation_passed, CASE WHEN s THEN model_registered ELSE '' END AS model_registered,
       CASE WHEN s THEN registered_model_version ELSE '' END AS registered_model_version, CASE WHEN s THEN serving_path ELSE '' END AS model_artifact_path,
       CASE WHEN s THEN serving_sha ELSE '' END AS model_artifact_sha256, dvc_output_hash, dataset_git_commit_sha
FROM (SELECT *, CAST(trigger_batch AS VARCHAR) = selected_batch AS s FROM events_log, context)""",
)
step(
    "cycles_unserved",
    ("events_log", "context"),
    """SELECT 'phase8-event:' || trigger_batch AS retraining_cycle_id,
       CASE WHEN s THEN 'phase9_selected_unserved_retraining_event' ELSE 'phase8_retraining_event' END AS cycle_source,
       CAST(trigger_batch AS VARCHAR) AS trigger_batch, triggering_detector, training_window_batches,
       CASE WHEN s THEN validation_passed ELSE '' END AS validation_passed, CASE WHEN s THEN model_registered ELSE '' END AS model_registered,
       CASE WHEN s THEN registered_model_version ELSE '' END AS registered_model_version, '' AS model_artifact_path, '' AS model_artifact_sha256,
       dvc_output_hash, dataset_git_commit_sha
FROM (SELECT *, CAST(trigger_batch AS VARCHAR) = selected_batch AS s FROM events_log, context)
UNION ALL SELECT 'phase7-reference:' || serving_sha, 'phase7_reference_model', '', '', '', validation_passed, model_registered, registered_model_version,
       '/models/reference', serving_sha, dvc_output_hash, dataset_git_commit_sha FROM context""",
)
step(
    "decisions",
    ("context",),
    """SELECT md5('d:' || o_orderkey) AS decision_id, CASE o_orderkey % 4 WHEN 0 THEN serving_cycle_id WHEN 1 THEN 'phase8-event:' || (10 + o_orderkey % 10)
       WHEN 2 THEN 'phase7-reference:gone' END AS retraining_cycle_id FROM orders, context""",
)


def context(spark: SparkSession, sf_dir: str, log: DataFrame, served: bool = True) -> DataFrame:
    last = log.agg(F.max("trigger_batch").cast("string").alias("selected_batch"))
    base = side_by_side(last, snapshot(spark, sf_dir))
    source = "phase9_retrained_candidate" if served else "phase7_reference_model"
    return base.select(
        "selected_batch",
        F.lit(source).alias("serving_source"),
        X.cycle_id(F.lit(source), "snapshot_hash", "selected_batch").alias("serving_cycle_id"),
        F.lit("/models/candidate" if served else "/models/reference").alias("serving_path"),
        F.col("snapshot_hash").alias("serving_sha"),
        F.lit("true").alias("validation_passed"),
        F.lit("true").alias("model_registered"),
        F.lit("1").alias("registered_model_version"),
        X.first_present(F.lit(""), "snapshot_hash").alias("dvc_output_hash"),
        X.first_present(F.lit(None).cast("string"), F.lit(""), F.lit("unknown")).alias("dataset_git_commit_sha"),
    )


def decisions(spark: SparkSession, sf_dir: str, ctx: DataFrame) -> DataFrame:
    """One decision per order, spread over the serving cycle, events, a lost cycle and none."""
    key = F.col("o_orderkey")
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey")
    joined = side_by_side(orders, ctx.select("serving_cycle_id"))
    return joined.select(
        F.md5(F.concat(F.lit("d:"), key.cast("string"))).alias("decision_id"),
        F.when(key % 4 == 0, F.col("serving_cycle_id"))
        .when(key % 4 == 1, F.concat(F.lit("phase8-event:"), (10 + key % 10).cast("string")))
        .when(key % 4 == 2, F.lit("phase7-reference:gone"))
        .alias("retraining_cycle_id"),
    )


_CYCLE_COLUMNS = ", ".join(S.CYCLE_LOG_COLUMNS)


@query("cycle_log", steps("cycles") + f"SELECT {_CYCLE_COLUMNS} FROM cycles")
def cycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)[1]
    ctx = context(spark, sf_dir, log)
    return lineage.append_serving_cycle(lineage.cycle_log(log, ctx), ctx)


@query("cycle_log_unserved", steps("cycles_unserved") + f"SELECT {_CYCLE_COLUMNS} FROM cycles_unserved")
def cycle_log_unserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference model keeps serving, so its own cycle is appended."""
    log = events(spark, sf_dir)[1]
    ctx = context(spark, sf_dir, log, served=False)
    return lineage.append_serving_cycle(lineage.cycle_log(log, ctx), ctx)


@query(
    "decision_lineage",
    steps("decisions", "cycles")
    + """SELECT decision_id, d.retraining_cycle_id, cycle_source, c.trigger_batch AS cycle_trigger_batch, c.dvc_output_hash AS cycle_dvc_output_hash,
       c.retraining_cycle_id IS NOT NULL AS lineage_intact FROM decisions d LEFT JOIN cycles c ON d.retraining_cycle_id = c.retraining_cycle_id""",
)
def decision_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir)[1]
    ctx = context(spark, sf_dir, log)
    return lineage.decision_lineage(decisions(spark, sf_dir, ctx), lineage.cycle_log(log, ctx))


@query(
    "decision_cycle_ids",
    steps("decisions")
    + """SELECT count(*) AS decision_count, list(DISTINCT retraining_cycle_id ORDER BY retraining_cycle_id) FILTER (WHERE retraining_cycle_id IS NOT NULL) AS decision_retraining_cycle_ids FROM decisions""",
)
def decision_cycle_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = context(spark, sf_dir, events(spark, sf_dir)[1])
    return lineage.decision_cycle_ids(decisions(spark, sf_dir, ctx))


step(
    "lifecycle_row",
    ("events_log", "model_gate"),
    """SELECT 'phase9_retrained_candidate' AS candidate_source, b IS NOT NULL AS retraining_requested, b AS selected_retraining_trigger_batch,
       d AS selected_retraining_detector, n AS retraining_event_count, validation_passed, validation_passed AS model_registered,
       CASE WHEN validation_passed THEN '1' ELSE '' END AS registered_model_version
FROM (SELECT max(trigger_batch) AS b, arg_max(triggering_detector, trigger_batch) AS d, count(*) AS n FROM events_log), model_gate""",
)


def lifecycle_row(spark: SparkSession, stream_metrics: DataFrame, verdict: DataFrame) -> DataFrame:
    log = lifecycle.retraining_events(stream_metrics)
    validation = verdict.withColumn("candidate", F.lit("scorecard"))
    empty = spark.createDataFrame([], "version int")
    versions = lifecycle.promote(validation, empty, "candidate")
    return spool(lifecycle.lifecycle_report(log, validation, versions), "lifecycle-report")


@query("lifecycle_report", steps("lifecycle_row") + "SELECT * FROM lifecycle_row")
def lifecycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lifecycle_row(spark, *measured_stream(spark, sf_dir))
    version = F.coalesce(F.col("registered_model_version").cast("string"), F.lit(""))
    return row.withColumn("registered_model_version", version)


@query(
    "monitoring_report",
    steps("decisions", "drift", "lifecycle_row")
    + """SELECT decision_count, decision_retraining_cycle_ids, phase8_data_drift_detected, phase8_concept_drift_detected,
       lifecycle_row.retraining_requested AS phase9_retraining_requested, lifecycle_row.validation_passed AS phase9_validation_passed,
       lifecycle_row.model_registered AS phase9_model_registered, serving_cycle_id AS serving_retraining_cycle_id, serving_source AS model_source, serving_sha AS model_artifact_sha256, dvc_output_hash
FROM (SELECT count(*) AS decision_count, list(DISTINCT retraining_cycle_id ORDER BY retraining_cycle_id) FILTER (WHERE retraining_cycle_id IS NOT NULL) AS decision_retraining_cycle_ids FROM decisions),
     (SELECT bool_or(data_drift_detected AND batch_id >= 12) AS phase8_data_drift_detected, bool_or(concept_drift_detected AND batch_id >= 15) AS phase8_concept_drift_detected FROM drift),
     lifecycle_row, context""",
)
def monitoring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream_metrics, verdict = measured_stream(spark, sf_dir)
    ctx = context(spark, sf_dir, lifecycle.retraining_events(stream_metrics))
    return lineage.monitoring_report(
        decisions(spark, sf_dir, ctx),
        monitoring.evaluations(stream_metrics),
        lifecycle_row(spark, stream_metrics, verdict),
        ctx,
    )


@query(
    "serving_report",
    steps("model_gate", "events_log")
    + """SELECT CASE WHEN validation_passed THEN 'phase9_retrained_candidate' WHEN phase7_acceptance_passed THEN 'phase7_reference_model' ELSE 'unavailable' END AS selected_model_source,
       validation_passed OR phase7_acceptance_passed AS model_loaded, phase7_acceptance_passed, phase8_acceptance_passed, validation_passed AS phase9_validation_passed,
       CASE WHEN validation_passed OR phase7_acceptance_passed THEN snapshot_hash END AS selected_model_artifact_sha256,
       CASE WHEN validation_passed THEN 'phase9:' || (SELECT max(trigger_batch) FROM events_log) || ':' || snapshot_hash
            WHEN phase7_acceptance_passed THEN 'phase7-reference:' || snapshot_hash ELSE 'unavailable' END AS retraining_cycle_id,
       snapshot_hash AS dvc_output_hash, TRUE AS trace_logging_enabled, 'env_var' AS trace_salt_mode FROM model_gate""",
)
def serving_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream_metrics, verdict = measured_stream(spark, sf_dir)
    last = lifecycle.retraining_events(stream_metrics).agg(F.max("trigger_batch").alias("trigger_batch"))
    base = side_by_side(verdict, last)
    rows = F.array(
        F.struct(
            F.lit(2).alias("priority"),
            F.lit("phase9_retrained_candidate").alias("source"),
            F.col("validation_passed").alias("eligible"),
            F.lit(True).alias("valid"),
            F.col("phase6_hash").alias("artifact_sha256"),
            F.col("trigger_batch"),
        ),
        F.struct(
            F.lit(3).alias("priority"),
            F.lit("phase7_reference_model").alias("source"),
            F.col("phase7_acceptance_passed").alias("eligible"),
            F.lit(True).alias("valid"),
            F.col("phase6_hash").alias("artifact_sha256"),
            F.lit(None).cast("int").alias("trigger_batch"),
        ),
    )
    resolved = lifecycle.resolve_model(base.select(F.inline(rows))).drop("deployment_error")
    flags = verdict.select(
        "phase7_acceptance_passed",
        "phase8_acceptance_passed",
        F.col("validation_passed").alias("phase9_validation_passed"),
        F.col("phase6_hash").alias("dvc_output_hash"),
    )
    return lineage.serving_report(resolved, flags, lineage.trace_policy(salt="report-only"))


# --- scalar expressions on whole tables --------------------------------------------------------


@query(
    "batch_id_lists",
    """SELECT l_orderkey, l_linenumber, l_partkey, [l_linenumber, CAST(l_quantity AS INTEGER)] AS ids, l_linenumber || ',' || CAST(l_quantity AS INTEGER) AS text FROM lineitem""",
)
def batch_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(", ,"), F.col("l_quantity").cast("int").cast("string"), F.lit(","))
    parsed = B.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.parse_batch_ids(text).alias("ids")
    )
    return parsed.withColumn("text", X.format_batch_ids("ids"))


@query(
    "detector_labels",
    """SELECT CASE WHEN d AND c THEN 'data_and_concept' WHEN d THEN 'data' ELSE 'concept' END AS triggering_detector, count(*) AS n
FROM (SELECT l_discount > 0.05 AS d, l_tax > 0.04 AS c FROM lineitem) WHERE d OR c GROUP BY 1""",
)
def detector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = B.table(spark, sf_dir, "lineitem").select(
        (F.col("l_discount") > 0.05).alias("d"), (F.col("l_tax") > 0.04).alias("c")
    )
    return (
        flags.filter("d OR c")
        .groupBy(X.triggering_detector("d", "c").alias("triggering_detector"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "first_present",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN c_name END AS value FROM customer""",
)
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return B.table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.first_present(
            F.when(key % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.when(key % 5 != 0, F.col("c_name"))
        ).alias("value"),
    )


@query(
    "overlap_ranges",
    """SELECT c_custkey, CASE WHEN s < 20 THEN s ELSE -1 END AS overlap_start, CASE WHEN s < 20 THEN CAST(19 AS BIGINT) ELSE -1 END AS overlap_end
FROM (SELECT c_custkey, greatest(c_custkey % 17, c_custkey % 23) AS s FROM customer)""",
)
def overlap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, n = F.col("c_custkey") % 17, F.col("c_custkey") % 23, F.lit(20).cast("bigint")
    return B.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.coalesce(X.overlap_start(a, b, n), F.lit(-1)).alias("overlap_start"),
        F.coalesce(X.overlap_end(a, b, n), F.lit(-1)).alias("overlap_end"),
    )


@query(
    "typed_report_fields",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_double, TRUE AS is_absent FROM events""",
)
def typed_report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").select(
        "event_id",
        X.typed_get("props", "k", "bigint").alias("k"),
        X.typed_get("props", "k", "string").alias("k_text"),
        X.typed_get("props", "k", "double").alias("k_double"),
        X.typed_get("props", "missing", "boolean").isNull().alias("is_absent"),
    )


def _pad_hex(salt: bytes, value: int) -> str:
    return bytes(b ^ value for b in salt.ljust(64, b"\x00")).hex()


def hmac_sql(salt: bytes, payload: str) -> str:
    """HMAC-SHA256 of a text in SQL, as lower-case hex."""
    return f"sha256(unhex('{_pad_hex(salt, 0x5C)}') || unhex(sha256(unhex('{_pad_hex(salt, 0x36)}') || encode({payload}))))"


def payload_sql(*columns: str, text: tuple[str, ...] = ("VehBrand", "VehGas", "Area", "Region")) -> str:
    """The canonical text of a row in SQL; ``text``: the columns that are strings."""

    def cell(name: str) -> str:
        if name in S.SERVING_REALS:
            return f"""'"{name}":"' || printf('%.9f', CAST({name} AS DOUBLE)) || '"'"""
        return f"""'"{name}":"' || {name} || '"'""" if name in text else f"""'"{name}":' || {name}"""

    return "'{' || " + " || ',' || ".join(cell(name) for name in sorted(columns)) + " || '}'"


_SALT = b"query-salt"


@query(
    "keyed_fingerprints",
    steps("policy") + f"""SELECT IDpol, {hmac_sql(_SALT, payload_sql("IDpol", *S.SERVING_COLUMNS))} AS input_fingerprint FROM policy""",
)
def keyed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed fingerprints of whole serving payloads and their keys."""
    payload = canonical_json("IDpol", *S.SERVING_COLUMNS, fixed=S.SERVING_REALS)
    return B.policies(spark, sf_dir).select("IDpol", keyed_fingerprint(payload, _SALT).alias("input_fingerprint"))
