"""Classifier, pools, anomalies and the online candidate."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tontine import schemas as S
from tontine.operators import anomaly, classifier, clustering, encoding, metrics, online, quality, sampling, scoring
from tontine.sources.shared import spool


@pytest.fixture(scope="module")
def contracts(spark):
    rng = np.random.default_rng(3)
    n = 500
    bonus = rng.integers(50, 180, n)
    power = rng.integers(4, 12, n)
    risk = 0.05 * (bonus - 100) + 0.3 * power + rng.normal(size=n)
    label = np.zeros(n, dtype=int)
    label[np.argsort(-risk)[:60]] = 1
    rows = [
        (
            i, str(i % 5), 0.0 if i % 5 == 3 else float(rng.uniform(0.1, 1)), int(power[i]), int(rng.integers(0, 12)),
            int(rng.integers(20, 70)), int(bonus[i]), float(rng.uniform(2, 9)), f"B{i % 3}", f"G{i % 2}", f"A{i % 4}",
            f"R{i % 2}", "0-2", "26-35", "51-75" if bonus[i] <= 75 else "76-100", "101-500" if i % 2 else "501-1500", int(label[i]),
        )
        for i in range(n)
    ]
    frame = spark.createDataFrame(
        rows,
        "IDpol long, pool_id string, Exposure double, VehPower int, VehAge int, DrivAge int, BonusMalus int, Density_log1p double,"
        " VehBrand string, VehGas string, Area string, Region string, VehAge_band string, DrivAge_band string,"
        " BonusMalus_band string, Density_band string, target_has_claim long",
    )
    return spool(sampling.stratified_split(frame), "test-contracts")


@pytest.fixture(scope="module")
def model(contracts):
    return classifier.fit_claim_model(contracts.filter("NOT is_test"))


def test_model_beats_baseline_and_is_calibrated(contracts, model):
    row = metrics.model_metrics(model.score(contracts.filter("is_test"))).first()
    assert row["model_auc"] > 0.8 and row["baseline_auc"] == 0.5
    assert row["model_normalized_gini"] == pytest.approx(2 * row["model_auc"] - 1)
    assert row["test_probability_rate_delta"] < 0.08
    assert model.folds == 5


def test_scores_survive_saving(spark, contracts, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    scored = classifier.load_scorer(spark, path)(contracts).select("IDpol", S.PROBABILITY)
    assert scored.exceptAll(model.score(contracts).select("IDpol", S.PROBABILITY)).isEmpty()
    assert dict(model.score(contracts).dtypes)["pool_id"] == "string"


def test_calibration_is_skipped_for_a_single_positive(contracts):
    one = contracts.filter("target_has_claim = 0").limit(20).unionByName(contracts.filter("target_has_claim = 1").limit(1))
    fitted = classifier.fit_claim_model(spool(one, "test-one"))
    assert fitted.folds == 0 and fitted.score(contracts).filter(F.col(S.PROBABILITY).isNull()).isEmpty()


def test_single_class_is_an_error(contracts):
    with pytest.raises(classifier.TrainingError, match="labels 0 and 1 are needed"):
        classifier.fit_claim_model(contracts.filter("target_has_claim = 0"))


def test_unseen_category_encodes_to_zeros(contracts, model):
    row = scoring.model_inputs(contracts.limit(1)).withColumn("Region", F.lit("nowhere"))
    seen = encoding.encode(scoring.model_inputs(contracts.limit(1)), model.encoder).first()["features"]
    unseen = encoding.encode(row, model.encoder).first()["features"]
    assert unseen.size == seen.size and unseen.toArray().sum() == pytest.approx(seen.toArray().sum() - 1)


def test_standardised_columns(contracts):
    inputs = scoring.model_inputs(contracts)
    dense = encoding.encode(inputs, encoding.fit_encoder(inputs)).select(vector_to_array("features").alias("v")).toPandas()
    block = np.vstack(dense["v"].to_numpy())[:, : len(S.MODEL_NUMERIC)]
    assert np.allclose(block.mean(axis=0), 0) and np.allclose(block.std(axis=0), 1)


def test_frozen_encoder_fallback(model):
    encoder = model.encoder
    assert encoding.frozen_encoder({"feature_encoder": None, "anomaly_encoder": encoder}) is encoder
    with pytest.raises(encoding.EncoderError):
        encoding.frozen_encoder({})


def test_pool_scores_with_zero_exposure(contracts, model):
    scored = model.score(contracts)
    scores = scoring.pool_risk_scores(scored)
    rows = {r["pool_id"]: r for r in scores.collect()}
    assert rows["3"]["pool_score_weighting_method"] == "unweighted_zero_exposure_fallback"
    assert rows["3"]["pool_risk_score"] == pytest.approx(rows["3"]["mean_probability"])
    pools = contracts.select("pool_id").distinct()
    targets = pools.withColumn("pool_claim_rate", F.lit(0.1))
    table = scoring.assemble_pool_scores(pools, scores, targets)
    coverage = scoring.score_coverage(table).first()
    assert coverage["coverage_passed"] and coverage["zero_exposure_pools"] == 1
    partial = scoring.assemble_pool_scores(pools, scores.filter("pool_id <> '1'"), targets)
    assert scoring.score_coverage(partial).first()["pool_score_coverage"] == pytest.approx(0.8)


def test_anomalies(contracts):
    shifted = contracts.withColumns(
        {c: F.when(F.col("IDpol") == 77, F.lit(900)).otherwise(F.col(c)) for c in S.MODEL_NUMERIC}
    )
    scores = spool(anomaly.anomaly_scores(shifted, trees=40), "test-anomaly")
    summary = metrics.anomaly_summary(scores).first()
    assert (summary["anomaly_rows"], summary["anomaly_count"]) == (500, 5)
    assert scores.orderBy(F.desc("anomaly_score")).first()["IDpol"] == 77
    again = anomaly.anomaly_scores(shifted.repartition(3), trees=40)
    assert again.select("IDpol", "anomaly_flag").exceptAll(scores.select("IDpol", "anomaly_flag")).isEmpty()


def test_online_candidate_learns_and_equals_itself_in_pieces(contracts):
    inputs = scoring.model_inputs(contracts).withColumn("batch_id", (F.col("IDpol") % 4).cast("int"))
    encoded = spool(encoding.encode(inputs, encoding.fit_encoder(inputs)).select("batch_id", S.TARGET, "features"), "test-online")
    width = encoded.first()["features"].size
    trained = online.partial_fit(encoded, online.OnlineModel.zeros(width), passes=15)
    losses = [loss for _, loss in trained.history]
    assert losses[0] == pytest.approx(np.log(2)) and losses[-1] < 0.6 * losses[0]
    whole, _, _, n = online._gradient(encoded, trained)
    parts = [online._gradient(encoded.filter(F.col("batch_id") == b), trained) for b in range(4)]
    assert np.allclose(whole, sum(g * k for g, _, _, k in parts) / n)
    assert online.state_table(encoded, trained).count() == 15


def test_trees_draw_from_the_whole_table(spark):
    rows = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("IDpol"), F.array(F.col("id").cast("double")).alias("v"))
    drawn = anomaly.tree_samples(rows, trees=100, rows=256).groupBy("tree").agg(F.collect_set("IDpol").alias("ids")).collect()
    assert len(drawn) == 100 and all(len(r["ids"]) == 256 for r in drawn)
    # 25,600 draws from 60,000 rows: 20,875 different ones are expected, 16,230 of a pool of 25,600 rows only.
    distinct = len({i for r in drawn for i in r["ids"]})
    assert 20_400 < distinct < 21_300
    smallest = rows.orderBy(F.xxhash64(F.lit(S.SEED), F.lit(7), "IDpol")).limit(256).collect()
    assert {r["IDpol"] for r in smallest} == set(next(r["ids"] for r in drawn if r["tree"] == 7))


def policies(spark, rows=60):
    i = F.col("id")
    text = lambda p, m: F.concat(F.lit(p), (i % m).cast("string"))
    return spark.range(rows).select(
        i.alias("IDpol"), (4 + i % 3 * 5).cast("int").alias("VehPower"), (i % 2 * 9).cast("int").alias("VehAge"),
        (20 + i % 3 * 20).cast("int").alias("DrivAge"), (50 + i % 3 * 30).cast("int").alias("BonusMalus"),
        (10.0 + i % 3 * 1000).alias("Density"), text("B", 3).alias("VehBrand"), text("G", 2).alias("VehGas"),
        text("A", 3).alias("Area"), text("R", 3).alias("Region"),
    )


def test_pools(spark):
    built = clustering.construct_pools(policies(spark), 2, 4, sample_size=50)
    assert 2 <= built.selected_k <= 4
    frame = spool(built.frequency, "test-pools")
    assert frame.count() == 60 and frame.select("pool_id").distinct().count() == built.selected_k
    scan = built.scan.collect()
    assert [r["k"] for r in scan] == [2, 3, 4] and all(r["inertia"] >= 0 for r in scan)
    assert clustering.best_k(built.scan).first()["selected_k"] == built.selected_k
    again = clustering.construct_pools(policies(spark).repartition(3), 2, 4, sample_size=50)
    assert again.selected_k == built.selected_k
    with pytest.raises(quality.DataQualityError, match="missing values"):
        clustering.construct_pools(policies(spark).withColumn("Density", F.lit(None).cast("double")), 2, 4)


def test_all_k_at_once_equals_one_by_one(spark):
    """Every k moves as if it were alone, whatever the partitioning; parts are added up in rounds."""
    from tontine.operators import pool_scan

    rng = np.random.default_rng(8)
    points = np.round(np.concatenate([rng.normal(m, 0.4, (150, 3)) for m in (-4.0, 0.0, 5.0)]) * pool_scan.UNIT) / pool_scan.UNIT
    rows = [([int(x) for x in p * pool_scan.UNIT],) for p in points]
    table = spark.createDataFrame(rows, f"{pool_scan.POINT} array<int>")
    start = pool_scan.starting_centres(points, 2, 5, 1)
    stop = pool_scan.stop_below(points)
    final, costs = pool_scan.fit_all(table.repartition(7), start, 50, stop)
    for k in (2, 3, 4, 5):
        centres = start.of(k)
        for _ in range(50):
            near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([points[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(k)])
            shift, centres = ((moved - centres) ** 2).sum(axis=1).max(), moved
            if shift <= stop:
                break
        assert final.of(k) == pytest.approx(centres, abs=1e-6)
        assert costs[k] == pytest.approx(((points[:, None] - final.of(k)[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert costs[3] < costs[2] / 5  # three clouds
    again, _ = pool_scan.fit_all(table.repartition(70), start, 50, stop)
    assert (again.matrix == final.matrix).all()
    scores = pool_scan.sample_silhouettes(spark, points, final, block=64)
    assert max(scores, key=scores.get) == 3
    labels = pool_scan.nearest(points, final)[0][:, 1]
    assert scores[3] == pytest.approx(clustering.silhouette(spark, points, labels))


def test_silhouette_by_hand(spark):
    points = np.array([[0.0], [1.0], [10.0], [11.0], [30.0]])
    labels = np.array([0, 0, 1, 1, 2])
    got = [r["silhouette"] for r in clustering.silhouette_points(spark, points, labels, block=2).orderBy("position").collect()]
    assert got[0] == pytest.approx((10.5 - 1) / 10.5) and got[4] == 0.0
    assert np.isnan(clustering.silhouette(spark, points, np.zeros(5)))
    assert np.isnan(clustering.silhouette(spark, points, np.arange(5)))


def test_silhouette_reads_the_whole_table(spark, tmp_path):
    from tontine.plans import operations

    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 10_400)
    vectors = rng.normal(size=(len(labels), 2)) + labels[:, None] * 1.5
    vectors[:2000] = 0.25  # copies
    rows = [(i, int(c), v) for i, (c, v) in enumerate(zip(labels, vectors.tolist()))]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["label"]: r for r in operations.silhouette(spark, str(tmp_path)).collect()}
    totals = np.zeros((len(labels), 3))
    for c in range(3):
        for v in vectors[labels == c]:
            totals[:, c] += np.hypot(vectors[:, 0] - v[0], vectors[:, 1] - v[1])
    sizes, pick = np.bincount(labels), np.arange(len(labels))
    inner = totals[pick, labels] / (sizes[labels] - 1)
    means = totals / sizes
    means[pick, labels] = np.inf
    score = (means.min(axis=1) - inner) / np.maximum(means.min(axis=1), inner)
    for c in range(3):
        assert got[c]["n"] == sizes[c] and got[c]["silhouette"] == pytest.approx(score[labels == c].mean(), abs=2e-6)
    best = operations.best_k(spark, str(tmp_path)).first()
    assert best["silhouette_score"] == max(r["silhouette"] for r in got.values())


def test_silhouette_table_of_few_labels(spark):
    points = spark.createDataFrame([(i, c, [x]) for i, c, x in [(0, 0, 0.0), (1, 0, 1.0), (2, 1, 10.0), (3, 1, 11.0), (4, 2, 30.0)]], "id long, label int, v array<double>")
    got = {r["id"]: r["silhouette"] for r in clustering.silhouette_table(points, "id", "label", "v", cell_rows=1).collect()}
    assert len(got) == 5 and got[0] == pytest.approx((10.5 - 1) / 10.5) and got[4] == 0.0
    one = clustering.silhouette_table(points.filter("label = 0"), "id", "label", "v").collect()
    assert [r["silhouette"] for r in one] == [None, None]
    assert clustering.silhouette_table(points.limit(0), "id", "label", "v").count() == 0


def test_silhouette_cell_holds_one_tile_of_distances():
    import tracemalloc

    rng = np.random.default_rng(4)
    left, right = rng.normal(size=(5000, 4)), rng.normal(size=(clustering.CELL_ROWS, 4))
    codes = rng.integers(0, 3, len(left)), rng.integers(0, 2, len(right))
    tracemalloc.start()
    forth, back = clustering._gap_sums(left, right, codes, (3, 2), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # a block of 1,024 rows against the whole group took 400 MB
    for i in (0, 4999):
        gaps = np.sqrt(((right - left[i]) ** 2).sum(axis=1))
        assert forth[i] == pytest.approx(np.bincount(codes[1], gaps))
    for j in (0, clustering.CELL_ROWS - 1):
        gaps = np.sqrt(((left - right[j]) ** 2).sum(axis=1))
        assert back[j] == pytest.approx(np.bincount(codes[0], gaps))


def test_pools_scan_all_k(spark, sf, monkeypatch):
    from tontine.plans import operations

    seen = []
    build = clustering.construct_pools

    def short(policies, k_min=S.K_MIN, k_max=S.K_MAX, **rest):
        seen.append((k_min, k_max))
        return build(policies, k_min, k_min, **rest)

    monkeypatch.setattr(clustering, "construct_pools", short)
    assert operations.constructed_pools(spark, sf).count() == S.K_MIN and seen == [(10, 50)]


def test_best_k_ties_and_nan(spark):
    scan = spark.createDataFrame([(5, 0.3), (4, 0.3), (3, float("nan")), (2, None)], "k int, silhouette_score double")
    assert clustering.best_k(scan).first()["selected_k"] == 4


def test_nearest_centroid_tie_takes_the_smaller_label(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0])], "id int, v array<double>")
    centres = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, centroid array<double>")
    row = clustering.assign_nearest(points, centres, "label", "v").first()
    assert (row["nearest"], row["sq_distance"]) == (1, 1.0)


def test_forest_scores_follow_the_trees_row_by_row(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 3))
    vectors[7, 1] = np.nan  # goes right at every split
    points = spool(spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "IDpol long, v array<double>"), "points")
    forest = spool(anomaly.grow_forest(points.filter("IDpol <> 7"), trees=5, rows=64), "forest")
    got = {r["IDpol"]: r["anomaly_score"] for r in anomaly.score_forest(points, forest, ("IDpol",)).collect()}
    nodes = {(r["tree"], r["node"]): r for r in forest.collect()}
    size = max(r["size"] for r in nodes.values() if r["tree"] == 0)
    for i, v in enumerate(vectors):
        total = 0.0
        for tree in range(5):
            node = nodes[tree, 0]
            while node["feature"] >= 0:
                node = nodes[tree, node["left"] if v[node["feature"]] <= node["split"] else node["right"]]
            total += node["depth"] + float(anomaly._mean_path(np.array([node["size"]]))[0])
        assert got[i] == pytest.approx(2.0 ** (-total / (5 * float(anomaly._mean_path(np.array([size]))[0]))))


def test_pool_sums_hold_no_matrix_of_memberships(spark):
    from tontine.operators import pool_scan

    points = spark.createDataFrame([([i << 20, (i % 7) << 20],) for i in range(50)], f"{pool_scan.POINT} array<int>").repartition(3)
    found = pool_scan.centre_sums(points, pool_scan.Centres((2, 3), np.array([[0.0, 3], [40, 3], [0, 3], [25, 3], [49, 3]])), 3)
    assert found.counts.tolist()[:2] == [21, 29] or found.counts.tolist()[:2] == [20, 30]
    for start, k in ((0, 2), (2, 3)):
        assert found.sums[start : start + k].sum(axis=0).tolist() == [1225 * 2**20, sum(i % 7 for i in range(50)) * 2**20]
        assert found.counts[start : start + k].sum() == 50
