"""The live path: online state, windows that withhold nothing, pool requests, decision sinks that fail."""

from __future__ import annotations

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tontine import schemas as S
from tontine.operators import encoding, lineage, online, quality, scoring
from tontine.sources.shared import spool
from tontine.streaming import live_metrics, live_scoring, online_updates

ROWS = 60


def labelled(spark):
    i = F.col("id")
    return spark.range(ROWS).select(
        i.alias("IDpol"), (i / 20).cast("int").alias("batch_id"), F.lit("p").alias("pool_id"), F.lit(1.0).alias("Exposure"),
        (i % 5).cast("int").alias("VehPower"), F.lit(3).alias("VehAge"), (30 + i % 7).cast("int").alias("DrivAge"),
        (60 + i % 11 * 5).cast("int").alias("BonusMalus"), F.log1p(100.0 + i).alias("Density_log1p"), (100.0 + i).alias("Density"),
        *(F.lit("x").alias(c) for c in ("VehBrand", "VehGas", "Area", "Region", "VehAge_band", "DrivAge_band", "BonusMalus_band", "Density_band")),
        (i % 11 > 7).cast("long").alias(S.TARGET),
    )


@pytest.fixture(scope="module")
def frame(spark):
    return spool(labelled(spark), "labelled")


def test_online_state_in_the_loop_equals_the_batch_form(spark, frame, tmp_path):
    inputs = scoring.model_inputs(frame)
    encoder = encoding.fit_encoder(inputs)
    encoded = encoding.encode(inputs, encoder).select("batch_id", S.TARGET, encoding.FEATURES)
    want = online.replay_online(encoded, 3, last_reference=0)
    first = online.partial_fit(encoded.filter("batch_id <= 0"), online.OnlineModel.zeros(len(want.weights)))
    live = online_updates.OnlineUpdates(encoder, first, str(tmp_path / "state"))
    assert live.model(spark).steps == 1
    parts = [frame.filter(f"batch_id = {b} AND IDpol % 3 = {p}") for b in range(3) for p in range(3)]
    for epoch, part in enumerate([*parts[:4], parts[4].union(parts[5]).union(parts[6]), *parts[7:]]):
        live.process(part, epoch)
        if epoch in (1, 4, 6):
            live.process(part, epoch)  # replayed
    got = live.model(spark)
    assert got.steps == want.steps == 4
    assert got.weights == pytest.approx(want.weights, abs=1e-12) and got.intercept == pytest.approx(want.intercept, abs=1e-12)
    steps = {r["step"]: r for r in live.steps(spark).collect()}
    assert {s: (r["batch_id"], r["n_rows"]) for s, r in steps.items()} == {2: (0, 20), 3: (1, 20), 4: (2, 20)}
    assert [steps[s]["log_loss"] for s in (2, 3, 4)] == pytest.approx([loss for _, loss in want.history[1:]])
    live.process(frame.filter("batch_id = 0 AND IDpol = 1"), 9)  # a part of a batch that is over
    late = {r["step"]: r for r in live.steps(spark).collect()}[5]
    assert late["late"] and late["n_rows"] == 1
    assert not np.allclose(live.model(spark).weights, got.weights)


def events(spark, rows):
    zero = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame(
        [(zero + datetime.timedelta(minutes=m), path, status, float(latency)) for m, path, status, latency in rows],
        "ts timestamp, path string, status_code int, latency double",
    )


def test_windows_withhold_nothing_and_take_late_rows(spark, tmp_path):
    live = live_metrics.LiveWindows((1.0, 10.0), str(tmp_path))
    live.process(events(spark, [(600, "a", 200, 5), (601, "a", 500, 20)]), 0)
    live.process(events(spark, [(0, "a", 200, 0.5), (602, "a", 200, 1), (700, "b", 200, 3)]), 1)  # ten hours late, and still open
    live.process(events(spark, [(0, "a", 200, 0.5), (602, "a", 200, 1), (700, "b", 200, 3)]), 1)  # replayed
    live.process(events(spark, []), 2)

    def seen(monitor):
        return {(r["window_start"].hour * 60 + r["window_start"].minute, r["path"]): tuple(r[c] for c in monitor.sums) for r in monitor.windows(spark).collect()}

    want = {(600, "a"): (3, 1, 26.0, 1, 2), (0, "a"): (1, 0, 0.5, 1, 1), (700, "b"): (1, 0, 3.0, 0, 1)}
    assert {(k[0] % 1440, k[1]): v for k, v in seen(live).items()} == {((m % 1440), p): v for (m, p), v in want.items()}
    smaller = live.compact(spark, 1)
    smaller.process(events(spark, [(601, "a", 200, 2)]), 3)
    after = {(k[0] % 1440, k[1]): v for k, v in seen(smaller).items()}
    assert after[600, "a"] == (4, 1, 28.0, 1, 3) and after[700, "b"] == want[700, "b"]
    assert seen(live)[600, "a"] == want[600, "a"]


def members(spark, rows):
    """(request, declared pool, pool, member, count, bonus)"""
    table = spark.createDataFrame(rows, "request_id string, request_pool_id string, pool_id string, member_index int, contract_count long, BonusMalus int")
    return table.select(
        "request_id", "request_pool_id", "contract_count", "member_index", "pool_id",
        (F.col("member_index") * 0.5).alias("Exposure"), *(F.lit(4).alias(c) for c in ("VehPower", "VehAge", "DrivAge")), "BonusMalus",
        *(F.lit("x").alias(c) for c in ("VehBrand", "VehGas", "Area")), F.lit(100.0).alias("Density"), F.lit("r").alias("Region"),
    ).select(*live_scoring.MEMBER_ROW)


def rule(df):
    return df.withColumn(S.PROBABILITY, F.col("BonusMalus") / 1000.0)


POLICY = lineage.trace_policy(salt="test-salt")


def test_pool_requests_wait_for_all_members(spark, tmp_path):
    live = live_scoring.LivePools(rule, {"model_source": "m"}, POLICY, str(tmp_path / "live"))
    one = members(spark, [("r1", "7", "7", 0, 3, 100), ("r1", "7", "7", 1, 3, 200), ("r2", "8", "9", 0, 1, 100)])
    two = members(spark, [("r1", "7", "7", 2, 3, 400), ("r1", "7", "7", 1, 3, 200), ("r3", "5", "5", 0, 2, 50), ("r4", "5", "5", 0, 1, -1)])
    for part, epoch in ((one, 0), (two, 1), (two, 1)):
        live.process(part, epoch)
    scores = [r.asDict() for r in spark.read.parquet(str(tmp_path / "live/scores")).collect()]
    assert [(r["request_id"], r["pool_contract_count"], r["pool_scored_exposure"]) for r in scores] == [("r1", 3, 1.5)]
    assert scores[0]["pool_risk_score"] == pytest.approx((0.5 * 0.2 + 1.0 * 0.4) / 1.5)
    rejects = {r["request_id"]: r for r in spark.read.parquet(str(tmp_path / "live/rejects")).collect()}
    assert rejects["r2"]["foreign_member"] and rejects["r4"]["invalid_member"] and len(rejects) == 2
    (record,) = live.decisions(spark).collect()
    assert record["endpoint"] == "/score/pool" and record["prediction_summary"]["contract_count"] == 3
    assert record["prediction_summary"]["pool_score_weighting_method"] == "exposure_weighted"
    assert "member" not in str(record.asDict(True)) and len(record["input_fingerprint"]) == 64
    assert live.trace_log_failures(spark).first()[0] == 0
    live.process(members(spark, [("r3", "5", "5", 1, 2, 60)]), 2)
    assert {r["request_id"] for r in spark.read.parquet(str(tmp_path / "live/scores")).collect()} == {"r1", "r3"}


def test_a_broken_decision_sink_is_counted_and_scoring_goes_on(spark, tmp_path):
    blocked = tmp_path / "file"
    blocked.write_text("no folder")
    live = live_scoring.LivePools(rule, {}, POLICY, str(tmp_path / "live"), decision_log=str(blocked / "decisions"))
    live.process(members(spark, [("r1", "7", "7", 0, 1, 100)]), 0)
    live.process(members(spark, [("r2", "7", "7", 0, 1, 100)]), 1)
    assert spark.read.parquet(str(tmp_path / "live/scores")).count() == 2
    assert live.trace_log_failures(spark).first()["trace_log_failures_total"] == 2
    assert {r["endpoint"] for r in spark.read.parquet(str(tmp_path / "live/failures")).collect()} == {"/score/pool"}
    assert not os.path.exists(blocked / "decisions")


def test_unknown_fields_are_refused(spark, tmp_path):
    live = live_scoring.LivePools(rule, {}, POLICY, str(tmp_path / "live"))
    with pytest.raises(quality.DataQualityError, match="unknown request fields: Extra"):
        live.process(members(spark, [("r1", "7", "7", 0, 1, 100)]).withColumn("Extra", F.lit(1)), 0)
    contracts = live_scoring.LiveScoring(rule, {}, POLICY, str(tmp_path / "one"))
    with pytest.raises(quality.DataQualityError, match="unknown request fields"):
        contracts.process(members(spark, [("r1", "7", "7", 0, 1, 100)]), 0)


def test_fingerprints_cover_every_payload_column(spark):
    row = members(spark, [("r1", "7", "7", 0, 1, 100)])
    seen = set()
    for name in (None, *S.SERVING_COLUMNS):
        changed = row
        if name is not None:
            kind = row.schema[name].dataType.simpleString()
            changed = row.withColumn(name, F.lit("other") if kind == "string" else (F.col(name) + F.lit(1)).cast(kind))
        seen.add(changed.select(lineage.request_fingerprint(POLICY, *S.SERVING_COLUMNS)).first()[0])
    assert len(seen) == 1 + len(S.SERVING_COLUMNS)
