"""Batching, rewrites and drift monitoring on the small stream fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tontine import schemas as S
from tontine.operators import batching, drift, lifecycle, quality, scoring
from tontine.sources.shared import spool
from tontine.streaming import drift_monitor


def contracts(spark, rows=40):
    ids = spark.range(1, rows + 1).withColumnRenamed("id", "IDpol")
    features = ids.select(
        "IDpol",
        F.lit(1).alias("pool_id"),
        F.lit(0.0).alias("Exposure"),
        F.lit(100).alias("BonusMalus"),
        F.lit(4000.0).alias("Density"),
        F.log1p(F.lit(4000.0)).alias("Density_log1p"),
        F.lit("1501-5000").alias("Density_band"),
    )
    total = ((F.col("IDpol") % 4) * 100).cast("double")
    targets = ids.select(
        "IDpol",
        F.lit(1).cast("long").alias("target_claim_count"),
        F.lit(1).cast("long").alias("target_has_claim"),
        F.lit(0.0).alias("target_claim_frequency"),
        total.alias("target_total_claim_amount"),
        total.alias("target_avg_claim_amount"),
    )
    return features, targets


@pytest.fixture(scope="module")
def replayed(spark):
    return spool(batching.replay(*contracts(spark)), "test-stream")


def test_batches_and_flags(replayed):
    report = {r["batch_id"]: r for r in batching.batch_report(replayed).collect()}
    assert len(report) == 20 and all(r["row_count"] == 2 for r in report.values())
    assert [b for b, r in report.items() if r["data_drift_rows"]] and min(b for b, r in report.items() if r["data_drift_rows"]) == 12
    assert min(b for b, r in report.items() if r["concept_drift_rows"]) == 15
    truth = batching.ground_truth(batching.batch_report(replayed)).first()
    assert (truth["overlap_batch_start"], truth["overlap_batch_end"], truth["overlap_rows"]) == (15, 19, 10)
    assert batching.stream_report(batching.batch_report(replayed)).first()["zero_exposure_rows_during_concept_recompute"] == 10


def test_rewritten_values(replayed):
    row = replayed.filter("batch_id = 19").first()
    assert row["Density"] == pytest.approx(5400.0) and row["Density_band"] == "5001+"
    assert row["target_claim_count"] == 2 and row["target_claim_frequency"] == 0.0
    drawn = {r["added_severity"] for r in replayed.filter("concept_drift_injected").collect()}
    assert drawn <= {100.0, 200.0, 300.0} and drawn
    assert replayed.filter("batch_id < 12 AND Density <> 4000.0").isEmpty()


def test_severity_falls_back_without_positive_amounts(spark):
    features, targets = contracts(spark)
    targets = targets.withColumns({c: F.lit(0.0) for c in ("target_total_claim_amount", "target_avg_claim_amount")})
    row = batching.replay(features, targets).filter("concept_drift_injected").first()
    assert (row["target_total_claim_amount"], row["target_avg_claim_amount"]) == (1000.0, 500.0)


def test_capped_counts_are_flagged_but_do_not_grow(spark):
    features, targets = contracts(spark)
    row = batching.replay(features, targets.withColumn("target_claim_count", F.lit(4).cast("long"))).filter("concept_drift_injected").first()
    assert (row["target_claim_count"], row["added_severity"]) == (4, 0.0)


def test_replay_rejects_unmatched_keys(spark):
    features, targets = contracts(spark)
    with pytest.raises(quality.DataQualityError, match="one-to-one"):
        batching.replay(features, targets.filter("IDpol > 1"))


def drift_stream(spark):
    """20 batches of 100: density moves from batch 12, claim rate from batch 15."""
    base = spark.range(2000).select(
        F.col("id").alias("IDpol"), (F.col("id") / 100).cast("int").alias("batch_id"), (F.col("id") % 100).alias("n")
    )
    late, concept = F.col("batch_id") >= 12, F.col("batch_id") >= 15
    moved = late & (F.col("n") < 60)
    density = F.when(moved, F.lit(6500.0)).otherwise(F.lit(800.0))
    positive = F.when(concept, F.col("n") < 30).otherwise(F.col("n") < 5)
    return base.select(
        "IDpol",
        "batch_id",
        F.col("IDpol").alias("event_index"),
        F.lit("0").alias("pool_id"),
        F.lit(1.0).alias("Exposure"),
        F.lit(5).alias("VehPower"),
        F.lit(3).alias("VehAge"),
        F.lit(40).alias("DrivAge"),
        F.when(F.col("n") < 30, F.lit(110)).otherwise(F.lit(60)).alias("BonusMalus"),
        density.alias("Density"),
        F.log1p(density).alias("Density_log1p"),
        *(F.lit("x").alias(c) for c in ("VehBrand", "VehGas", "Area", "Region", "VehAge_band", "DrivAge_band", "BonusMalus_band")),
        F.when(moved, F.lit("5001+")).otherwise(F.lit("501-1500")).alias("Density_band"),
        positive.cast("long").alias("target_has_claim"),
        moved.alias("data_drift_injected"),
        (concept & (F.col("n") < 30)).alias("concept_drift_injected"),
    )


@pytest.fixture(scope="module")
def monitored(spark):
    stream = spool(scoring.constant_scorer(0.05)(drift_stream(spark)), "test-drift", ["batch_id"])
    return stream, spool(drift.drift_metrics(stream), "test-metrics")


def test_detection(monitored):
    _, metrics = monitored
    data = drift.detection_evaluation(metrics, "data", 12, (15, 19)).first()
    concept = drift.detection_evaluation(metrics, "concept", 15, (15, 19)).first()
    assert (data["first_detected_batch"], concept["first_detected_batch"]) == (12, 15)
    assert data["detected_within_provisional_threshold"] and concept["detected_within_provisional_threshold"]
    assert 15 in data["overlap_detected_batches"] and 15 in concept["overlap_detected_batches"]
    assert data["false_positive_batches"] == [] and concept["false_positive_batches"] == []
    rows = {r["batch_id"]: r for r in metrics.collect()}
    assert rows[15]["concept_drift_eligible_fraction"] == pytest.approx(0.30)
    assert rows[12]["data_drift_eligible_fraction"] == pytest.approx(0.60)
    assert rows[12]["density_segment_psi"] == 0.0  # the reference has no high-density rows
    assert list(metrics.columns) == list(drift.METRIC_COLUMNS)


def test_unseen_category_index_by_hand(spark, monitored):
    stream, _ = monitored
    import numpy as np

    expected = np.clip(np.array([1.0, 0.0]), 1e-6, None)
    expected = expected / expected.sum()
    actual = np.clip(np.array([0.4, 0.6]), 1e-6, None)
    actual = actual / actual.sum()
    by_hand = float(((actual - expected) * np.log(actual / expected)).sum())
    rows = {(r["batch_id"], r["feature"]): r for r in drift.per_feature_psi(stream).collect()}
    assert rows[12, "Density_band"]["psi"] == pytest.approx(by_hand)
    assert rows[12, "Density_band"]["psi_level"] == "trigger"
    assert rows[12, "VehPower"]["n_bins"] == 1 and rows[12, "VehPower"]["psi"] == 0.0


def test_null_categories_have_their_own_bin(monitored):
    stream, _ = monitored
    counts = drift.categorical_histogram(stream.withColumn("Area", F.lit(None).cast("string")))
    assert {r["bin"] for r in counts.filter("feature = 'Area'").collect()} == {"__missing__"}


def test_events(monitored):
    stream, metrics = monitored
    events = lifecycle.retraining_events(metrics)
    first = events.orderBy("trigger_batch").first()
    assert (first["trigger_batch"], first["window_rows"], first["replay_rows"], first["training_rows"]) == (12, 500, 100, 600)
    assert first["training_window_batches"] == "8,9,10,11,12" and first["triggering_detector"] == "data"
    assert lifecycle.latest_event(events).first()["triggering_detector"] == "data_and_concept"
    rows = lifecycle.candidate_rows(events.filter("trigger_batch = 12"), stream)
    assert {r["origin"]: r["count"] for r in rows.groupBy("origin").count().collect()} == {"window": 500, "replay": 100}
    assert set(events.columns) == {f.name for f in S.RETRAINING_EVENTS.fields}


def test_stream_equals_batch_and_survives_replay(spark, monitored, tmp_path):
    stream, metrics = monitored
    bare = stream.drop(S.PROBABILITY)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    bare.repartition(3, "IDpol").write.partitionBy("batch_id").parquet(source)  # three files per batch
    monitor = drift_monitor.DriftMonitor(drift.fit_reference(stream), scoring.constant_scorer(0.05), sink)
    arriving = drift_monitor.stream_batches(spark, source, bare.schema, 7)
    monitor.start(arriving, str(tmp_path / "state"), available_now=True).awaitTermination()
    last = spark.read.parquet(f"{sink}/counts").filter("batch_id = 19").select("epoch").distinct().count()
    assert last >= 1
    got = monitor.metrics(spark)
    assert got.count() == 20

    def rounded(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rounded(got) == rounded(metrics)
    assert monitor.events(spark).count() == lifecycle.retraining_events(metrics).count()
    # Parts in another order, one of them replayed: the same metrics.
    again = drift_monitor.DriftMonitor(monitor.reference, scoring.constant_scorer(0.05), str(tmp_path / "again"))
    parts = [bare.filter(f"pmod(IDpol, 3) = {i}") for i in range(3)]
    for epoch, part in ((2, parts[2]), (0, parts[0]), (1, parts[1]), (0, parts[0])):
        again.process(part, epoch)
    assert rounded(again.metrics(spark)) == rounded(metrics)


def test_reference_window_and_coverage(monitored):
    stream, _ = monitored
    assert quality.reference_window(stream).first()["window_ok"]
    assert not quality.reference_window(stream, 5, 13).first()["window_ok"]
    quality.expect_batches(stream)
    with pytest.raises(quality.DataQualityError, match="nothing to monitor"):
        quality.expect_batches(stream.filter("batch_id <= 9"))
    assert quality.batch_coverage(stream, 21).filter("NOT covered").first()["batch_id"] == 20


def test_candidates_are_fitted_on_event_rows_without_the_holdout(spark, monitored):
    from tontine.operators import encoding

    stream, metrics = monitored
    bare = stream.drop(S.PROBABILITY)
    events = lifecycle.retraining_events(metrics).filter("trigger_batch = 16")
    encoder = encoding.fit_encoder(scoring.model_inputs(bare.filter("batch_id <= 9")))
    auc = lifecycle.with_candidate_auc(events, bare, encoder).first()["candidate_training_auc"]
    assert auc > 0.8  # positives are the high bonus-malus rows
    holdout = bare.filter("IDpol % 10 = 0").select("IDpol")
    candidate = lifecycle.retrain_candidate(events, bare, holdout)
    assert candidate.trigger_batch == 16
    assert candidate.training_rows + candidate.removed_for_holdout == 600 and candidate.removed_for_holdout >= 50
    assert candidate.model.score(bare).filter(F.col(S.PROBABILITY).isNull()).isEmpty()
    assert lifecycle.retrain_candidate(events.limit(0), bare, holdout) is None


def test_arriving_files_follow_the_rows_of_the_stream(spark, sf, monkeypatch, tmp_path):
    from tontine.plans import operations

    assert operations.files_per_batch(1000) == 3 and operations.files_per_batch(20 * 9 * operations.FILE_ROWS) == 9
    monkeypatch.setattr(operations, "FILE_ROWS", 10)
    monkeypatch.setattr(operations, "fresh_path", lambda _, name: str(tmp_path / name))
    operations.monitored(spark, sf)
    files = list((tmp_path / "arriving").rglob("*.parquet"))
    wanted = operations.files_per_batch(spark.read.parquet(str(tmp_path / "arriving")).count())
    assert wanted > 3 and 3 * 20 < len(files) <= 20 * wanted  # three tasks wrote everything before


def test_monitored_stream_equals_the_whole_stream(spark, sf):
    from tontine.plans import binding as B

    held = B.scored_stream(spark, sf)
    whole = B.scorer()(B.stream(spark, sf)).select(*B.MONITORED)
    assert held.columns == list(B.MONITORED) and "event_index" not in held.columns
    assert held.exceptAll(whole).isEmpty() and whole.exceptAll(held).isEmpty()
