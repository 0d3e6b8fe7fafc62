"""Gate, promotion, model resolution, lineage, fingerprints, scoring requests, alerts."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tontine import schemas as S
from tontine.functions import hashing, scalars as X
from tontine.operators import event_fits, lifecycle, lineage, observability, scoring
from tontine.sources import snapshot, tables
from tontine.streaming import live_scoring

REPORT = dict(
    phase7_accepted=True, phase8_accepted=True, phase6_hash="h", phase7_hash="h", phase8_hash="h", metadata_hash="h",
    pool_score_coverage=1.0, candidate_auc=0.7, baseline_auc=0.5, candidate_normalized_gini=0.4,
    baseline_normalized_gini=0.0, probability_rate_delta=0.001,
)


def gate(spark, **changes):
    row = {**REPORT, **changes}
    schema = ", ".join(
        f"{k} {'boolean' if isinstance(REPORT[k], bool) else 'double' if isinstance(REPORT[k], float) else 'string'}" for k in REPORT
    )
    return lifecycle.validation_gate(spark.createDataFrame([tuple(row[k] for k in REPORT)], schema)).first()


def test_gate_passes(spark):
    assert gate(spark)["validation_passed"] and gate(spark)["dvc_output_hash"] == "h"


@pytest.mark.parametrize(
    "changes, reasons",
    [
        ({"phase8_hash": "other"}, ["dvc_hash_consistent"]),
        ({"phase8_hash": None}, ["dvc_hash_consistent"]),
        ({"metadata_hash": "other"}, ["dvc_metadata_hash_matches_report"]),
        ({"baseline_auc": 1.0, "baseline_normalized_gini": 1.0}, ["auc_beats_baseline", "gini_beats_baseline"]),
        ({"probability_rate_delta": 0.9}, ["calibration_delta_passed"]),
        ({"pool_score_coverage": 0.9, "phase7_accepted": None}, ["phase7_acceptance_passed", "pool_score_coverage_passed"]),
    ],
)
def test_gate_names_failures_in_order(spark, changes, reasons):
    row = gate(spark, **changes)
    assert row["failure_reasons"] == reasons and not row["validation_passed"]


def candidates(spark, override, candidate, reference):
    rows = [
        (1, "env_override", *override, "sha1", None),
        (2, "phase9_retrained_candidate", *candidate, "sha2", 19),
        (3, "phase7_reference_model", *reference, "sha3", None),
    ]
    frame = spark.createDataFrame(
        rows, "priority int, source string, eligible boolean, valid boolean, artifact_sha256 string, trigger_batch int"
    )
    return lifecycle.resolve_model(frame).first()


def test_model_resolution(spark):
    yes, no, bad = (True, True), (False, True), (True, False)
    assert candidates(spark, yes, yes, yes)["retraining_cycle_id"] == "env-override:sha1"
    assert candidates(spark, no, yes, yes)["retraining_cycle_id"] == "phase9:19:sha2"
    assert candidates(spark, no, no, yes)["retraining_cycle_id"] == "phase7-reference:sha3"
    for unavailable in (candidates(spark, bad, yes, yes), candidates(spark, no, bad, yes), candidates(spark, no, no, no)):
        assert unavailable["selected_model_source"] == "unavailable" and not unavailable["model_loaded"]


def test_promotion_numbers_go_on(spark):
    validated = spark.createDataFrame([("b", True, "h"), ("a", True, None), ("c", False, "h")], "name string, validation_passed boolean, dvc_output_hash string")
    old = spark.createDataFrame([(4,)], "version int")
    rows = lifecycle.promote(validated, old, "name").collect()
    assert sorted(r["version"] for r in rows) == [5, 6]
    assert {r["candidate"]: r["dvc_output_hash"] for r in rows} == {"a": "", "b": "h"}


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(
        [(12, "data", "8,9,10,11,12"), (19, "data_and_concept", "15,16,17,18,19")],
        "trigger_batch int, triggering_detector string, training_window_batches string",
    )


def context(spark, source, cycle):
    return spark.createDataFrame(
        [("19", source, cycle, "/model", "abc123", "true", "false", None, "hash", "sha")],
        "selected_batch string, serving_source string, serving_cycle_id string, serving_path string, serving_sha string,"
        " validation_passed string, model_registered string, registered_model_version string, dvc_output_hash string,"
        " dataset_git_commit_sha string",
    )


def test_cycle_log_when_the_candidate_serves(spark, log, tmp_path):
    ctx = context(spark, "phase9_retrained_candidate", "phase9:19:abc123")
    cycles = lineage.append_serving_cycle(lineage.cycle_log(log, ctx), ctx)
    rows = {r["retraining_cycle_id"]: r for r in cycles.collect()}
    assert set(rows) == {"phase8-event:12", "phase9:19:abc123"}
    served = rows["phase9:19:abc123"]
    assert served["cycle_source"] == "phase9_served_retraining_cycle" and served["model_artifact_sha256"] == "abc123"
    assert served["registered_model_version"] == "" and rows["phase8-event:12"]["validation_passed"] == ""
    decisions = spark.createDataFrame([("1", "phase9:19:abc123"), ("2", "phase9:19:abc123"), ("3", "gone")], "decision_id string, retraining_cycle_id string")
    joined = {r["decision_id"]: r["lineage_intact"] for r in lineage.decision_lineage(decisions, cycles).collect()}
    assert joined == {"1": True, "2": True, "3": False}
    ids = lineage.decision_cycle_ids(decisions).first()
    assert (ids["decision_count"], ids["decision_retraining_cycle_ids"]) == (3, ["gone", "phase9:19:abc123"])
    tables.write_cycle_log(cycles, str(tmp_path / "log"))
    stored = tables.cycle_log_rows(tables.read_optional(spark, str(tmp_path / "log"), S.CYCLE_LOG))
    assert stored.exceptAll(cycles).isEmpty() and stored.columns == list(S.CYCLE_LOG_COLUMNS)


def test_cycle_log_when_the_reference_serves(spark, log):
    ctx = context(spark, "phase7_reference_model", "phase7-reference:abc123")
    rows = {r["retraining_cycle_id"]: r for r in lineage.append_serving_cycle(lineage.cycle_log(log, ctx), ctx).collect()}
    event = rows["phase8-event:19"]
    assert event["cycle_source"] == "phase9_selected_unserved_retraining_event" and event["model_artifact_sha256"] == ""
    assert rows["phase7-reference:abc123"]["model_artifact_path"] == "/model" and len(rows) == 3


def test_without_events_only_the_serving_cycle_is_logged(spark, log):
    ctx = context(spark, "phase7_reference_model", "phase7-reference:abc123")
    none = log.limit(0)
    assert lineage.append_serving_cycle(lineage.cycle_log(none, ctx), ctx).count() == 1


def test_fingerprint_is_hmac_sha256(spark):
    frame = spark.createDataFrame([(1, "x", None, 0.5)], "b int, a string, c string, d double")
    payload = frame.select(hashing.canonical_json("d", "b", "a", "c")).first()[0]
    assert json.loads(payload) == {"a": "x", "b": 1, "c": None, "d": 0.5} and " " not in payload
    for salt in (b"s", b"k" * 64, b"long" * 40):
        got = frame.select(hashing.keyed_fingerprint(hashing.canonical_json("a", "b"), salt)).first()[0]
        assert got == hmac.new(salt, b'{"a":"x","b":1}', hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        hashing.keyed_fingerprint("a", b"")


def test_trace_policy():
    fixed = lineage.trace_policy("salt")
    assert fixed.enabled and fixed.salt_mode == "env_var" and "salt'" not in repr(fixed).replace("salt_mode='env_var'", "")
    one, two = lineage.trace_policy(dev_mode=True), lineage.trace_policy(dev_mode=True)
    assert one.salt != two.salt and one.salt_mode == "ephemeral_dev_random"
    off = lineage.trace_policy()
    assert not off.enabled and off.salt_mode == "disabled_missing_trace_hash_salt"
    with pytest.raises(ValueError):
        lineage.request_fingerprint(off, "a")


REQUEST = "request_id string, request_pool_id string, IDpol long, pool_id string, Exposure double, VehPower double, VehAge double, DrivAge double, BonusMalus double, Density double, VehBrand string, VehGas string, Area string, Region string"


def members(spark, rows):
    return spark.createDataFrame([(r, p, i, q, e, 5.0, 1.0, 40.0, b, 1500.0, "B", "G", "A", "R") for r, p, i, q, e, b in rows], REQUEST)


def rule(df):
    return df.withColumn(S.PROBABILITY, F.when(F.col("BonusMalus") >= 100, 0.5).otherwise(0.1))


def test_pool_requests(spark):
    frame = members(
        spark,
        [
            ("r1", "0", 1, "0", 1.0, 60.0), ("r1", "0", 2, "0", 3.0, 120.0),
            ("r2", "0", 3, "0", 0.0, 60.0), ("r2", "0", 4, "0", 0.0, 120.0),
            ("r3", "0", 5, "1", 1.0, 60.0), ("r4", "0", 6, "0", -1.0, 60.0),
        ],
    )
    scores, rejected = live_scoring.pool_decisions(frame, rule)
    rows = {r["request_id"]: r for r in scores.collect()}
    assert rows["r1"]["pool_risk_score"] == pytest.approx(0.4) and rows["r1"]["pool_scored_exposure"] == 4.0
    assert rows["r2"]["pool_risk_score"] == pytest.approx(0.3)
    assert rows["r2"]["pool_score_weighting_method"] == "unweighted_zero_exposure_fallback"
    assert {r["request_id"] for r in rejected.collect()} == {"r3", "r4"} and set(rows) == {"r1", "r2"}


def test_decisions_hold_no_request_values(spark, tmp_path):
    frame = members(spark, [("r1", "0", 771234, "0", 1.0, 60.0), ("r2", "0", 771234, "0", 1.0, 60.0)])
    scored, _ = live_scoring.score_contracts(frame, rule)
    assert scored.first()["Density_band"] == "501-1500"
    policy = lineage.trace_policy("stable-test-salt")
    decisions = live_scoring.contract_decisions(scored, {"model_source": "m", "dvc_output_hash": "hash.dir"}, policy)
    assert decisions.columns == [f.name for f in S.DECISIONS.fields]
    path = str(tmp_path / "log")
    assert tables.append_decisions(decisions, path) == 0 and tables.append_decisions(decisions, path) == 0
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    for secret in ("771234", "BonusMalus", "VehBrand", "stable-test-salt", "members"):
        assert secret not in text
    good, bad = tables.read_decision_log(spark, path)
    assert good.count() == 4 and bad.isEmpty() and good.select("input_fingerprint").distinct().count() == 1
    assert live_scoring.contract_decisions(scored, {}, lineage.trace_policy()).isEmpty()


def test_failed_append_is_counted_not_raised(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    decisions = spark.createDataFrame([], S.DECISIONS)
    assert tables.append_decisions(decisions.withColumn("decision_id", F.raise_error(F.lit("boom")).cast("string")).limit(0), str(tmp_path / "file" / "log")) == 1


def test_decision_log_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"decision_id": "a"}\n\n[1]\n{"decision_id": "b"\n')
    good, bad = tables.read_decision_log(spark, str(path), strict=False)
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(tables.SourceError, match="not a JSON object"):
        tables.read_decision_log(spark, str(path))
    assert tables.read_decision_log(spark, str(tmp_path / "none"))[0].isEmpty()


def test_manifest_and_digests(spark, tmp_path):
    expected = snapshot.expected_artifacts(spark)
    assert expected.count() == 33
    present = expected.filter("path <> 'stream/batch_019.csv'")
    missing = snapshot.expect_manifest(expected, present, allow_missing=True)
    assert [r["path"] for r in missing.collect()] == ["stream/batch_019.csv"]
    with pytest.raises(tables.SourceError, match="batch_019"):
        snapshot.expect_manifest(expected, present)
    root = tmp_path / "data"
    (root / "stream").mkdir(parents=True)
    for row in expected.collect():
        (root / row["path"]).write_text(row["path"])
    report = snapshot.dataset_version_report(spark, str(root)).first()
    assert (report["files"], report["expected_artifacts"], report["missing_artifacts"]) == (33, 33, 0)
    digests = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in snapshot.artifact_digests(spark, str(root)).collect()}
    assert digests["batch_000.csv"] == hashlib.sha256(b"stream/batch_000.csv").hexdigest()
    (root / "stream/batch_000.csv").write_text("changed")
    assert snapshot.dataset_version_report(spark, str(root)).first()["snapshot_digest"] != report["snapshot_digest"]


def test_scalar_labels(spark):
    frame = spark.createDataFrame([("8, 9,,10", "", "x")], "ids string, a string, b string")
    row = frame.select(
        X.parse_batch_ids("ids").alias("ids"), X.first_present("a", "b").alias("first"),
        X.cycle_id(F.lit("phase9_retrained_candidate"), F.lit("s"), F.lit(None).cast("int")).alias("no_trigger"),
        X.cycle_id(F.lit("other"), F.lit("s"), F.lit(3)).alias("other"),
        X.overlap_start(F.lit(12), F.lit(15), F.lit(15)).alias("none"),
        X.psi_level(F.lit(0.1)).alias("level"), X.psi_level(F.lit(0.25)).alias("high"),
        X.signal_source(F.lit(0.3), F.lit(0.3)).alias("source"),
    ).first()
    assert row["ids"] == [8, 9, 10] and row["first"] == "x" and row["no_trigger"] == "phase9:s" and row["other"] == "other:s"
    assert row["none"] is None and (row["level"], row["high"]) == ("warning", "trigger")
    assert row["source"] == "whole_batch_feature_psi"


def test_alerts_and_gauges(spark):
    state = spark.createDataFrame([(True, False, False, True, True, None, False, 2)], ", ".join(f"{g} boolean" for g in S.GAUGES) + ", trace_log_failures_total int")
    names = {r["alert"] for r in observability.alert_state(state).collect()}
    assert names == {
        "ConceptDriftDetected", "RetrainingValidationFailed", "TraceLoggingDisabled",
        "TraceLoggingFailures",
    }
    assert {r["gauge"]: r["value"] for r in observability.gauges(state).collect()}["candidate_validation_passed"] == 0.0


def test_bucket_quantile(spark):
    frame = spark.createDataFrame([(10, 0, 5, 10), (10, 0, 0, 4), (0, 0, 0, 0)], "request_count long, le_0 long, le_1 long, le_2 long")
    got = [r[0] for r in frame.select(observability.bucket_quantile(0.75, (1.0, 2.0, 4.0))).collect()]
    assert got == [3.0, 4.0, None]


def test_constant_and_scorecard_scorers(spark):
    frame = spark.createDataFrame([(2.0,)], "x double")
    assert scoring.constant_scorer(0.2)(frame).first()[S.PROBABILITY] == 0.2
    assert scoring.scorecard_scorer({"x": 0.5}, -1.0)(frame).first()[S.PROBABILITY] == 0.5
    with pytest.raises(ValueError):
        scoring.scorecard_scorer({"ClaimNb": 1.0}, 0.0)


def test_joins_behind_the_policies_run_once_a_query(spark, sf, monkeypatch):
    from tontine.plans import binding, operations, risk

    written = []
    keep = binding.spool

    def spool(df, name, partition_by=()):
        written.append((name, len(df.columns)))
        return keep(df, name, partition_by)

    monkeypatch.setattr(binding, "spool", spool)
    monkeypatch.setattr(risk, "spool", spool)
    tags = {r["tag"] for r in operations.run_log_tags(spark, sf).collect()}
    assert "validation_passed" in tags
    names = [name for name, _ in written]
    # Four times "scored", "modelling" once and two whole splits before.
    assert names.count("scored") == 1 and "modelling" not in names and "split" not in names
    assert dict(written)["holdout"] == 4


class _LocalPoints:
    """Stands for a table of points in one batch, so that passes over it can be counted."""

    def __init__(self, events, y, x):
        columns = [pa.array(events, pa.list_(pa.int32())), pa.array(y, pa.float64()), pa.array(list(x), pa.list_(pa.float64()))]
        self.batch, self.width, self.passes = pa.RecordBatch.from_arrays(columns, names=["events", "y", "x"]), x.shape[1], 0
        self.sparkSession = self.sparkContext = self

    def select(self, *_):
        return self

    def first(self):
        return [[0.0] * self.width]

    def broadcast(self, value):
        return SimpleNamespace(value=value, unpersist=lambda: None)

    def array_sum(self, _, fold, __):
        self.passes += 1
        return fold([self.batch])


def test_event_fits_stop_where_only_rounding_moves_them(monkeypatch):
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 4, 4000)
    x = np.hstack((rng.normal(size=(4000, 2)), np.eye(4)[kind], 1e5 * np.eye(4)[kind]))  # the last four say what four say
    y = (rng.random(4000) < 1 / (1 + np.exp(-x[:, 0] - 0.5 * kind))).astype(float)
    points = _LocalPoints([[0, 1] if i % 2 else [0] for i in range(4000)], y, x)
    monkeypatch.setattr(event_fits, "array_sum", points.array_sum)
    weights, rows, positives = event_fits.fit_events(points, 2)
    assert points.passes <= 12 and rows.tolist() == [4000, 2000] and positives[0] == y.sum()
    for event, keep in ((0, slice(None)), (1, slice(1, None, 2))):
        ones = np.hstack((np.ones((len(y[keep]), 1)), x[keep]))
        slope = ones.T @ (1 / (1 + np.exp(-ones @ weights[event])) - y[keep]) + np.r_[0.0, weights[event][1:]]
        assert np.abs(slope[:7]).max() < 1e-4


def test_candidate_is_trained_on_stored_rows(spark, sf, monkeypatch):
    from tontine.plans import binding as B

    stream, seen = B.scored_stream(spark, sf), []
    events = spark.createDataFrame([(16, "12,13,14,15,16"), (3, "0,1,2,3")], "trigger_batch int, training_window_batches string")
    held = stream.filter("IDpol % 5 = 0").select("IDpol")
    monkeypatch.setattr(lifecycle, "fit_claim_model", lambda training, seed: seen.append(training))
    candidate = lifecycle.retrain_candidate(events, stream, held)
    rows = lifecycle.exclude_holdout(lifecycle.candidate_rows(events.filter("trigger_batch = 16"), stream), held)
    want = rows.withColumn("IDpol", F.concat_ws(":", "origin", "IDpol"))
    assert seen[0].select(*want.columns).exceptAll(want).isEmpty() and seen[0].count() == want.count()
    assert candidate.training_rows == want.count() > 0 and candidate.removed_for_holdout > 0
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
