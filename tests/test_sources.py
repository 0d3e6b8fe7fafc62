"""Digests, manifests, line numbers, stored models, fits of all events: against plain Python and single fits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tontine import schemas as S
from tontine.operators import anomaly, clustering, encoding, event_fits, lifecycle, quality, scoring
from tontine.sources import snapshot, tables
from tontine.sources.lines import numbered_lines
from tontine.sources.shared import spool

ROWS = [(i % 3, i, None if i % 7 == 0 else f"t{i % 5}", i / 3.0) for i in range(200)] + [(1, 4, "t4", 4 / 3.0)] * 3
FIELDS = "part int, a int, b string, c double"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree(rows, levels):
    def cell(x):
        text = f"{x:.9f}" if isinstance(x, float) else str(x)
        return "-" if x is None else f"{len(text)}:{text}"

    nodes = [(d, d) for d in sorted(sha(",".join(cell(x) for x in row)) for row in rows)]
    groups = {}
    for p, d in nodes:
        groups.setdefault(p[:levels], []).append(d)
    below = {p: sha(",".join(v)) for p, v in groups.items()}
    for level in range(levels - 1, -1, -1):
        upper = {}
        for p in sorted(below):
            upper.setdefault(p[:level], []).append(below[p])
        below = {p: sha(",".join(v)) for p, v in upper.items()}
    return below[""]


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_content_digests(spark, levels):
    df = spark.createDataFrame(ROWS, FIELDS)
    want = {p: tree([r[1:] for r in ROWS if r[0] == p], levels) for p in range(3)}
    for parts in (1, 5):
        got = snapshot.content_digests(df.repartition(parts), ["part"], levels).collect()
        assert {r["part"]: r["digest"] for r in got} == want and sum(r["n_rows"] for r in got) == len(ROWS)
    assert [snapshot.tree_levels(n) for n in (0, 4096, 4097, 65537, 10**12)] == [0, 0, 1, 2, 7]
    assert snapshot.content_digests(df.limit(0)).collect() == []


def test_every_change_of_a_row_shows(spark):
    rows = [(1, "a,b", 0.5), (2, None, 1.5)]
    changed = [rows, [(1, "a", 0.5), (2, None, 1.5)], [(1, "a,b", 0.25), (2, None, 1.5)], [(1, "a,b", 0.5), (2, "", 1.5)],
               [(1, "a,b", 0.5), (2, "-", 1.5)], rows[:1], [*rows, rows[0]]]
    seen = {snapshot.content_digests(spark.createDataFrame(r, "a int, b string, c double")).first()["digest"] for r in changed}
    assert len(seen) == len(changed)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    rng = random.Random(5)
    want = {}
    for name in ("a", "b", "empty"):
        lines = [] if name == "empty" else [f"{name}{i} " + "x" * rng.randint(0, 90) for i in range(3000)]
        (tmp_path / f"{name}.txt").write_text("".join(line + "\n" for line in lines))
        want |= {(f"{name}.txt", i): line for i, line in enumerate(lines, 1)}
    digests = []
    for size in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            lines = numbered_lines(spark, str(tmp_path))
            if size == "20k":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
            got = {(r["path"].rsplit("/", 1)[1], r["line"]): r["value"] for r in lines.collect()}
            assert got == want
            digests.append(sorted((r["path"], r["n_lines"], r["sha256"]) for r in snapshot.text_digests(spark, str(tmp_path)).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert digests[0] == digests[1] and len(digests[0]) == 2
    text = [want["a.txt", i] for i in range(1, 3001)]
    assert digests[0][0][2] == sha(sha("\n".join(text)))


def test_a_broken_log_line_is_named(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"request_id": "1"}\n\n{"request_id": "2"}\n[1, 2]\n{"request_id": "3"}\nnothing\n')
    with pytest.raises(tables.SourceError, match=r"log.jsonl, line 4: not a JSON object"):
        tables.read_decision_log(spark, str(path))
    assert sorted(r["line"] for r in tables.broken_lines(spark, str(path)).collect()) == [4, 6]


def test_manifest_of_what_the_sinks_write(spark, tmp_path):
    root = str(tmp_path)
    frame = spark.createDataFrame(ROWS, FIELDS).withColumnRenamed("part", "batch_id")
    tables.write_batches(frame, f"{root}/stream")
    read = lambda: tables.read_batches(spark, f"{root}/stream", frame.schema)
    snapshot.write_manifest(snapshot.manifest_of(read(), "stream", "batch_id"), root)
    written = spark.read.schema(snapshot.MANIFEST).parquet(f"{root}/_manifest")
    snapshot.expect_complete(snapshot.manifest_status(written, snapshot.manifest_of(read(), "stream", "batch_id")))
    frame.filter("batch_id <> 1").withColumn("a", F.col("a") + (F.col("batch_id") == 2).cast("int")).write.mode("overwrite").partitionBy("batch_id").parquet(f"{root}/stream")
    status = snapshot.manifest_status(written, snapshot.manifest_of(read(), "stream", "batch_id"))
    assert {r["unit"]: r["status"] for r in status.collect()} == {"stream/batch_id=0": "same", "stream/batch_id=1": "missing", "stream/batch_id=2": "changed"}
    with pytest.raises(tables.SourceError, match="batch_id=2 is changed, stream/batch_id=1 is missing"):
        snapshot.expect_complete(status)


def contracts(spark, rows=400):
    i = F.col("id")
    return spark.range(rows).select(
        i.alias("IDpol"), (i % 20).cast("int").alias("batch_id"), (i % 3).cast("string").alias("pool_id"), (0.1 + i % 9 / 10.0).alias("Exposure"),
        (i % 5).cast("int").alias("VehPower"), (i % 4).cast("int").alias("VehAge"), (30 + i % 7).cast("int").alias("DrivAge"),
        (60 + i % 11 * 5).cast("int").alias("BonusMalus"), F.log1p(100.0 + i).alias("Density_log1p"), (100.0 + i).alias("Density"),
        *(F.lit("x").alias(c) for c in ("VehBrand", "VehGas", "Area", "Region", "VehAge_band", "DrivAge_band", "BonusMalus_band", "Density_band")),
        ((i % 11 > 7) | (i % 13 == 0)).cast("long").alias(S.TARGET),
    )


@pytest.fixture(scope="module")
def stream(spark):
    return spool(contracts(spark), "contracts")


def test_stored_anomaly_model_scores_alike(spark, stream, tmp_path):
    model = anomaly.fit_anomaly_model(stream, trees=12)
    model.save(str(tmp_path / "m"))
    loaded = anomaly.AnomalyModel.load(spark, str(tmp_path / "m"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(loaded.score(stream)) == rows(model.score(stream)) == rows(anomaly.anomaly_scores(stream, trees=12))
    loaded.forest.filter("tree > 0").write.parquet(str(tmp_path / "fewer"))
    spark.read.parquet(str(tmp_path / "fewer")).write.mode("overwrite").parquet(str(tmp_path / "m/nodes"))
    with pytest.raises(anomaly.ModelFormatError, match="11 trees of 12"):
        anomaly.AnomalyModel.load(spark, str(tmp_path / "m"))


def test_candidates_of_all_events_equal_single_fits(spark, stream):
    fields = {f.name for f in S.RETRAINING_EVENTS.fields}
    rows = [(12, "8,9,10,11,12"), (15, "11,12,13,14,15"), (16, "12,13,14,15,16")]
    events = spark.createDataFrame(rows, "trigger_batch int, training_window_batches string")
    assert {"trigger_batch", "training_window_batches"} <= fields
    encoder = encoding.fit_encoder(scoring.model_inputs(stream.filter("batch_id <= 9")))
    found = {r["trigger_batch"]: r for r in event_fits.candidate_aucs(events, stream, encoder).collect()}
    per_event = lifecycle.candidate_rows(events, stream)
    for t, _ in rows:
        own = per_event.filter(F.col("trigger_batch") == t).drop("trigger_batch", "origin")
        assert found[t]["training_rows"] == own.count()
        assert found[t]["auc"] == pytest.approx(lifecycle.event_candidate_auc(own, encoder), abs=2e-3)
    single = event_fits.candidate_aucs(events, stream.withColumn(S.TARGET, F.lit(0).cast("long")), encoder).collect()
    assert all(r["auc"] is None for r in single)
    assert event_fits.candidate_aucs(events.limit(0), stream, encoder).collect() == []


def test_any_number_of_centroids(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 9, 2)]) for i in range(60)], "id int, v array<double>")
    centres = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 9, 2)]) for i in range(40)], "label int, centroid array<double>")
    want = sorted(map(tuple, clustering.assign_nearest(points, centres, "label", "v").drop("v").collect()))
    for block in (3, 1):
        assert sorted(map(tuple, clustering.assign_nearest(points, centres, "label", "v", block).drop("v").collect())) == want


def test_streams_that_cannot_be_monitored_are_refused(stream):
    flags = stream.withColumn("data_drift_injected", F.col("batch_id") >= 12).withColumn("concept_drift_injected", F.lit(False))
    quality.expect_monitorable(flags)
    for broken, message in (
        (flags.filter("batch_id <= 9"), "nothing to monitor"),
        (flags.filter("batch_id <> 12"), "only 19 batches exist"),
        (flags.withColumn("concept_drift_injected", F.col("batch_id") == 3), "holds injected drift"),
        (flags.withColumn(S.TARGET, F.lit(1).cast("long")), "1 of 2 classes"),
        (flags.limit(0), "nothing to monitor"),
    ):
        with pytest.raises(quality.DataQualityError, match=message):
            quality.expect_monitorable(broken)


def test_squared_silhouette(spark):
    rng = np.random.default_rng(6)
    labels = np.append(rng.integers(0, 7, 90), 9)  # one label of a single point
    vectors = rng.integers(0, 6, (91, 3)).astype(float)
    rows = [(i, int(c), [float(x) for x in v]) for i, (c, v) in enumerate(zip(labels, vectors))]
    points = spark.createDataFrame(rows, "id int, label int, v array<double>").repartition(3)
    gaps = ((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)
    want = {}
    for i, c in enumerate(labels):
        own = gaps[i][labels == c]
        outer = min(gaps[i][labels == d].mean() for d in set(labels) - {c})
        inner = own.sum() / (len(own) - 1) if len(own) > 1 else None
        want[i] = 0.0 if inner is None else (outer - inner) / max(outer, inner)
    for block in (1024, 3):
        got = {r["id"]: r["silhouette"] for r in clustering.squared_silhouette(points, "id", "label", "v", block).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    one = clustering.squared_silhouette(points.filter("label = 1"), "id", "label", "v").collect()
    assert {r["silhouette"] for r in one} == {None}
    assert clustering.squared_silhouette(points.limit(0), "id", "label", "v").collect() == []
