"""Distributed order statistics against NumPy and brute force, with ties and hot values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tontine.operators import batching, metrics, ordering, sampling


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    hot = np.full(700, 0.25)
    data = np.concatenate([rng.lognormal(size=900), hot, rng.integers(0, 5, 400).astype(float)])
    label = (rng.random(len(data)) < 0.3).astype(int)
    frame = spark.createDataFrame(
        [(i, float(v), int(y)) for i, (v, y) in enumerate(zip(data, label))], "IDpol long, v double, target_has_claim long"
    ).repartition(7)
    return frame, data, label


def test_exact_quantiles_equal_numpy(values):
    frame, data, _ = values
    shares = ordering.decile_shares(10)
    for buckets in (4, 128):
        row = ordering.exact_quantiles(frame, ["v"], shares, buckets).first()
        assert row["n_values"] == len(data)
        assert row["quantiles"] == list(np.quantile(data, shares))


def test_ranges_follow_the_rows_and_only_wanted_ones_stay_open(values, monkeypatch):
    frame, data, _ = values
    assert [ordering.range_count(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 10**9)] == [1, 1, 1, 2, 3815]
    assert ordering.range_count(10**15) == ordering.MOST_RANGES
    rounds, final = [], []
    narrow, locate = ordering._narrowed, ordering._located

    def seen(values, open_, cut_count):
        rounds.append(sum(len(p) for p in open_.values()))
        return narrow(values, open_, cut_count)

    def last(values, open_):
        final.extend(p for parts in open_.values() for p in parts)
        return locate(values, open_)

    monkeypatch.setattr(ordering, "_narrowed", seen)
    monkeypatch.setattr(ordering, "_located", last)
    monkeypatch.setattr(ordering, "MOST_RANGES", 4)
    shares = ordering.decile_shares(10)
    row = ordering.exact_quantiles(frame, ["v"], shares, range_rows=20).first()
    assert row["quantiles"] == list(np.quantile(data, shares))
    assert len(rounds) > 2  # four ranges at a time: cut again where ranges are too large
    assert final and all(p.rows <= 20 for p in final) and sum(p.rows for p in final) < len(data) / 4
    assert not any(p.low is not None and p.low < 0.25 < (p.high or 1e9) for p in final)  # the hot value is a range of its own


def test_quantiles_of_odd_values(spark):
    frame = spark.createDataFrame([(float(x),) for x in ("-inf", "inf", "nan", "-0.0", "0.0", "0.0", "1e300")], "a double")
    want = [float("-inf"), 0.0, 0.0, float("inf")]
    for rows in (1 << 18, 1):
        got = ordering.exact_quantiles(frame, ["a"], [0.0, 0.4, 0.6, 1.0], range_rows=rows).first()
        assert got["n_values"] == 6 and got["quantiles"] == want


def test_quantiles_of_one_value_and_of_nulls(spark):
    frame = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    rows = {r["feature"]: r["quantiles"] for r in ordering.exact_quantiles(frame, ["a", "b"], [0.0, 0.5, 1.0]).collect()}
    assert rows == {"a": [1.0, 1.0, 1.0]}


def test_auc_counts_ties(values):
    frame, data, label = values
    pos, neg = data[label == 1], data[label == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    got = metrics.roc_auc(frame, score="v").first()
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    positive = F.col("target_has_claim") == 1
    for buckets in (1, 5, 200):
        u = ordering.rank_statistic(frame, "v", positive, buckets).first()
        assert u["u"] == pytest.approx(wins) and (u["positives"], u["negatives"]) == (len(pos), len(neg))
    assert metrics.roc_auc(frame.withColumn("c", F.lit(0.3)), score="c").first()["auc"] == 0.5
    assert metrics.roc_auc(frame.filter("target_has_claim = 1"), score="v").first()["auc"] is None


def test_hash_index_is_a_permutation_that_ignores_row_order(values):
    frame, data, _ = values
    first = {r["IDpol"]: r["i"] for r in ordering.hash_index(frame, "IDpol", 42, "i").collect()}
    second = {r["IDpol"]: r["i"] for r in ordering.hash_index(frame.repartition(3), "IDpol", 42, "i").collect()}
    assert first == second and sorted(first.values()) == list(range(len(data)))
    other = {r["IDpol"]: r["i"] for r in ordering.hash_index(frame, "IDpol", 43, "i").collect()}
    assert other != first


@pytest.mark.parametrize("n", [0, 1, 37, 1999, 2000, 5000])
def test_fixed_sample_size(values, n):
    frame, data, _ = values
    drawn = [r["IDpol"] for r in sampling.fixed_sample(frame, "IDpol", n).collect()]
    assert len(drawn) == len(set(drawn)) == min(n, len(data))


def test_replay_rounds_half_to_even(spark):
    for rows, expected in ((25, 2), (35, 4), (4, 0)):
        frame = spark.range(rows).withColumnRenamed("id", "IDpol")
        assert sampling.replay_sample(frame).count() == expected


def test_stratified_split_sizes(spark):
    frame = spark.range(500).select(F.col("id").alias("IDpol"), (F.col("id") % 20 == 0).cast("long").alias("target_has_claim"))
    split = sampling.stratified_split(frame)
    counts = {(r["target_has_claim"], r["is_test"]): r["count"] for r in split.groupBy("target_has_claim", "is_test").count().collect()}
    assert counts == {(1, True): 5, (1, False): 20, (0, True): 95, (0, False): 380}
    assert split.count() == 500
    again = sampling.stratified_split(frame.repartition(5)).filter("is_test").select("IDpol")
    assert again.exceptAll(split.filter("is_test").select("IDpol")).isEmpty()
    rows = {r["split"]: (r["row_count"], r["positive_rows"]) for r in metrics.class_counts(split).collect()}
    assert rows == {"all": (500, 25), "train": (400, 20), "test": (100, 5)}


def test_folds_spread_each_class(spark):
    frame = spark.range(103).select(F.col("id").alias("IDpol"), (F.col("id") < 8).cast("long").alias("target_has_claim"))
    sizes = sampling.stratified_folds(frame, 5).groupBy("target_has_claim", "fold").count().collect()
    for label in (0, 1):
        per_fold = [r["count"] for r in sizes if r["target_has_claim"] == label]
        assert len(per_fold) == 5 and max(per_fold) - min(per_fold) <= 1


def test_equal_batches_match_array_split(spark):
    for rows, parts in ((7, 3), (20, 20), (41, 4), (5, 1)):
        frame = spark.range(rows).select("id", F.lit(rows).alias("n"))
        got = [r[0] for r in frame.select(batching.equal_batch(F.col("id"), F.col("n"), parts)).collect()]
        expected = [b for b, part in enumerate(np.array_split(np.arange(rows), parts)) for _ in part]
        assert got == expected


def test_ece_uses_right_closed_bins(spark):
    data = [(0.1, 1), (0.1000001, 0), (0.30000000000000004, 1), (1.0, 1), (0.0, 0)]
    frame = spark.createDataFrame(data, "predicted_claim_probability double, target_has_claim long")
    bins = {r[0]: r[1] for r in frame.select("predicted_claim_probability", metrics.calibration_bin(F.col("predicted_claim_probability"))).collect()}
    assert bins == {0.1: 0, 0.1000001: 1, 0.30000000000000004: 2, 1.0: 9, 0.0: 0}
    p, y = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    ids = np.minimum(np.digitize(p, np.linspace(0, 1, 11)[1:-1], right=True), 9)
    expected = sum(abs(y[ids == b].mean() - p[ids == b].mean()) * (ids == b).mean() for b in set(ids))
    row = metrics.calibration_metrics(frame).first()
    assert row["expected_calibration_error"] == pytest.approx(expected)
    assert row["brier_score"] == pytest.approx(((p - y) ** 2).mean())


@pytest.mark.parametrize("rows", [1, 19, 20, 47])
def test_batch_numbers_need_no_shuffle_of_rows(spark, rows):
    frame = spark.range(3_000_000_000, 3_000_000_000 + rows).withColumnRenamed("id", "IDpol").withColumn("wide", F.lit("x"))
    want = {r["IDpol"]: r["batch_id"] for r in batching.assign_batches(frame).collect()}
    found = batching.with_batch_id(frame)
    assert {r["IDpol"]: r["batch_id"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CASE WHEN" not in plan


def test_sample_reads_the_table_once(spark):
    frame = spark.range(500).selectExpr("id AS IDpol", "id % 3 AS c", "'x' AS wide")
    size = lambda rows: F.floor(rows / 4)
    flagged = ordering.hash_sample_flag(frame, "IDpol", 42, size, "s", ("c",))
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    index = {r["IDpol"]: r["n"] for r in ordering.hash_index(frame, "IDpol", 42, out="n", strata=("c",)).collect()}
    rows = flagged.collect()
    assert len(rows) == 500 and all(r["s"] == (index[r["IDpol"]] < (167 if r["c"] < 2 else 166) // 4) for r in rows)
    for n, want in ((0, 0), (500, 500), (900, 500), (-3, 0)):
        assert ordering.hash_sample_flag(frame, "IDpol", 42, lambda rows: F.lit(n), "s").filter("s").count() == want
