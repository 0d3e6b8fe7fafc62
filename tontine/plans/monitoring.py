"""Batched stream, what-if rewrites, drift metrics and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import batching, drift, features, quality, sampling
from tontine.operators.reports import side_by_side
from tontine.plans import binding as B
from tontine.plans.registry import query, rounded, step, steps
from tontine.sources.shared import spool

NUMERIC = ("Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density_log1p")
CATEGORICAL = S.MODEL_CATEGORICAL

step(
    "cells",
    ("scored_stream",),
    "\nUNION ALL ".join(
        f"SELECT batch_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM scored_stream" for c in NUMERIC
    )
    + "\nUNION ALL SELECT batch_id, 'density_segment', Density_log1p FROM scored_stream WHERE Density_band IN ('1501-5000', '5001+')",
)
step(
    "reference_ranks",
    ("cells",),
    """SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rn,
       count(*) OVER (PARTITION BY feature) AS n FROM cells WHERE batch_id BETWEEN 0 AND 9""",
)
step(
    "deciles",
    ("reference_ranks",),
    """SELECT feature, n, q, CASE WHEN t >= 0.5e0 THEN b - (b - a) * (1e0 - t) ELSE a + (b - a) * t END AS edge
FROM (SELECT feature, n, q, (n - 1) * q - floor((n - 1) * q) AS t,
             max(CASE WHEN rn = floor((n - 1) * q) THEN value END) AS a,
             max(CASE WHEN rn = least(floor((n - 1) * q) + 1, n - 1) THEN value END) AS b
      FROM reference_ranks,
           (VALUES (0e0), (0.1e0), (0.2e0), (0.30000000000000004e0), (0.4e0), (0.5e0), (0.6000000000000001e0), (0.7000000000000001e0), (0.8e0), (0.9e0), (1e0)) shares(q)
      GROUP BY feature, n, q)""",
)
step(
    "edges",
    ("deciles",),
    """SELECT feature, max(n) AS n, count(DISTINCT edge) AS n_edges,
       CASE WHEN count(DISTINCT edge) < 3 THEN [] ELSE list_sort(list_distinct(list(edge)))[2:-2] END AS interior
FROM deciles GROUP BY feature""",
)
step(
    "numeric_counts",
    ("cells", "edges"),
    """SELECT g.batch_id, g.feature, CAST(g.b AS VARCHAR) AS bin, count(c.value) AS n
FROM (SELECT DISTINCT s.batch_id, e.feature, unnest(range(len(e.interior) + 1)) AS b FROM edges e, (SELECT DISTINCT batch_id FROM cells) s
      WHERE e.feature <> 'density_segment' OR (e.n >= 2 AND e.n_edges >= 3)) g
LEFT JOIN (SELECT batch_id, c.feature, value, len([x FOR x IN interior IF x <= value]) AS b
           FROM cells c JOIN edges e ON c.feature = e.feature) c
  ON c.batch_id = g.batch_id AND c.feature = g.feature AND c.b = g.b
GROUP BY 1, 2, 3""",
)
step(
    "category_cells",
    ("scored_stream",),
    "\nUNION ALL ".join(
        f"SELECT batch_id, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '__missing__') AS bin FROM scored_stream"
        for c in CATEGORICAL
    ),
)
step(
    "category_counts",
    ("category_cells",),
    "SELECT batch_id, feature, bin, count(*) AS n FROM category_cells GROUP BY 1, 2, 3",
)
step(
    "category_reference",
    ("category_counts",),
    """SELECT feature, bin, sum(n) AS n FROM category_counts WHERE batch_id BETWEEN 0 AND 9 GROUP BY 1, 2
UNION ALL SELECT DISTINCT feature, '__unseen__', 0 FROM category_counts""",
)
step(
    "category_aligned",
    ("category_counts", "category_reference"),
    """SELECT g.batch_id, g.feature, g.bin, coalesce(sum(c.n), 0) AS n
FROM (SELECT b.batch_id, r.feature, r.bin FROM category_reference r, (SELECT DISTINCT batch_id FROM category_counts) b) g
LEFT JOIN (SELECT c.batch_id, c.feature, CASE WHEN r.bin IS NULL THEN '__unseen__' ELSE c.bin END AS bin, c.n
           FROM category_counts c LEFT JOIN category_reference r ON c.feature = r.feature AND c.bin = r.bin) c
  ON c.batch_id = g.batch_id AND c.feature = g.feature AND c.bin = g.bin
GROUP BY 1, 2, 3""",
)
step(
    "actual_counts",
    ("numeric_counts", "category_aligned"),
    "SELECT * FROM numeric_counts UNION ALL SELECT * FROM category_aligned",
)
step(
    "reference_counts",
    ("numeric_counts", "category_reference"),
    """SELECT feature, bin, sum(n) AS n FROM numeric_counts WHERE batch_id BETWEEN 0 AND 9 GROUP BY 1, 2
UNION ALL SELECT feature, bin, n FROM category_reference""",
)


def shares_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, bin, n, CASE WHEN total = 0 THEN 1e-6 ELSE clipped / sum(clipped) OVER (PARTITION BY {keys}) END AS share
FROM (SELECT *, greatest(CASE WHEN total = 0 THEN 1e-6 ELSE CAST(n AS DOUBLE) / total END, 1e-6) AS clipped
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total FROM {source}))"""


step("actual_shares", ("actual_counts",), shares_sql("actual_counts", "batch_id, feature"))
step("reference_shares", ("reference_counts",), shares_sql("reference_counts", "feature"))
step(
    "feature_psi",
    ("actual_shares", "reference_shares"),
    # Shares are clipped once more after they were renormalised.
    """SELECT batch_id, feature, sum((a - e) * ln(a / e)) AS psi, CAST(sum(n) AS BIGINT) AS actual_rows, count(*) AS n_bins
FROM (SELECT a.batch_id, a.feature, a.n, greatest(a.share, 1e-6) AS a, greatest(r.share, 1e-6) AS e
      FROM actual_shares a JOIN reference_shares r ON a.feature = r.feature AND a.bin = r.bin) GROUP BY 1, 2""",
)
_ORDINAL = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(S.MODEL_INPUTS)) + " END"
step(
    "strongest",
    ("feature_psi",),
    f"""SELECT w.batch_id, w.feature AS max_psi_feature, w.psi AS max_psi, coalesce(s.psi, 0e0) AS density_segment_psi
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY round(psi, 12) DESC, {_ORDINAL}) AS rn
      FROM feature_psi WHERE feature <> 'density_segment') w
LEFT JOIN (SELECT * FROM feature_psi WHERE feature = 'density_segment' AND actual_rows >= 2) s ON w.batch_id = s.batch_id
WHERE rn = 1""",
)
step(
    "batch_profile",
    ("scored_stream",),
    """SELECT batch_id, count(*) AS row_count, avg(target_has_claim) AS empirical_claim_rate,
       avg(predicted_claim_probability) AS mean_predicted_probability,
       avg(target_has_claim) - avg(predicted_claim_probability) AS residual,
       bool_or(data_drift_injected) AS data_drift_ground_truth, bool_or(concept_drift_injected) AS concept_drift_ground_truth,
       bool_or(data_drift_injected AND concept_drift_injected) AS overlap_ground_truth,
       avg(CAST(Density_band IN ('1501-5000', '5001+') AS DOUBLE)) AS data_drift_eligible_fraction,
       avg(CAST(BonusMalus >= 100 AS DOUBLE)) AS concept_drift_eligible_fraction
FROM scored_stream GROUP BY 1""",
)
step(
    "residual_reference",
    ("batch_profile",),
    """SELECT avg(residual) AS residual_mean, greatest(stddev_pop(residual), 1e-6) AS residual_std
FROM batch_profile WHERE batch_id BETWEEN 0 AND 9""",
)
step(
    "drift",
    ("batch_profile", "strongest", "residual_reference"),
    """SELECT *, greatest(max_psi, density_segment_psi) AS data_drift_signal_psi,
       CASE WHEN density_segment_psi > max_psi THEN 'density_segment_psi' ELSE 'whole_batch_feature_psi' END AS data_drift_signal_source,
       greatest(max_psi, density_segment_psi) >= 0.25 AS data_drift_detected,
       abs(delta) >= 0.01 AND z >= 3 AS concept_drift_detected
FROM (SELECT p.*, s.max_psi_feature, s.max_psi, s.density_segment_psi, residual - residual_mean AS delta, abs(residual - residual_mean) / residual_std AS z
      FROM batch_profile p JOIN strongest s ON p.batch_id = s.batch_id, residual_reference)""",
)
DRIFT_SELECT = """SELECT batch_id, row_count, max_psi_feature, round(max_psi, 6) AS max_psi, round(density_segment_psi, 6) AS density_segment_psi,
       round(data_drift_signal_psi, 6) AS data_drift_signal_psi, data_drift_signal_source, data_drift_detected,
       round(empirical_claim_rate, 6) AS empirical_claim_rate, round(mean_predicted_probability, 6) AS mean_predicted_probability,
       round(residual, 6) AS concept_residual, round(delta, 6) AS concept_residual_delta, round(z, 4) AS concept_residual_z_score,
       concept_drift_detected, data_drift_ground_truth, concept_drift_ground_truth, overlap_ground_truth,
       round(data_drift_eligible_fraction, 6) AS data_drift_eligible_fraction,
       round(concept_drift_eligible_fraction, 6) AS concept_drift_eligible_fraction FROM drift"""


def metrics_table(spark: SparkSession, sf_dir: str, policies: DataFrame | None = None) -> DataFrame:
    """The stored drift metrics, one row per batch; reports read them several times."""
    return spool(drift.drift_metrics(B.scored_stream(spark, sf_dir, policies)), "drift-metrics")


def round_metrics(metrics: DataFrame) -> DataFrame:
    return rounded(metrics, concept_residual_z_score=4)


@query(
    "event_index",
    steps("indexed") + "SELECT IDpol, event_index, event_index AS simulated_time_step, batch_id FROM indexed",
)
def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = B.batched(spark, sf_dir)
    return batched.select("IDpol", "event_index", "simulated_time_step", "batch_id")


@query(
    "stream_rewrites",
    steps("stream")
    + """SELECT IDpol, batch_id, event_index, data_drift_injected, concept_drift_injected, round(Density, 6) AS Density,
       round(Density_log1p, 6) AS Density_log1p, Density_band, target_claim_count, target_has_claim,
       round(target_claim_frequency, 6) AS target_claim_frequency, round(target_total_claim_amount, 8) AS target_total_claim_amount,
       round(target_avg_claim_amount, 8) AS target_avg_claim_amount FROM stream""",
)
def stream_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (
        "IDpol batch_id event_index data_drift_injected concept_drift_injected Density Density_log1p Density_band"
        " target_claim_count target_has_claim target_claim_frequency target_total_claim_amount target_avg_claim_amount"
    ).split()
    return rounded(
        B.stream(spark, sf_dir).select(*columns), target_total_claim_amount=8, target_avg_claim_amount=8
    )


@query(
    "severity_draws",
    steps("drawn") + "SELECT IDpol, round(added_severity, 8) AS added_severity FROM drawn WHERE needs",
)
def severity_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = B.batched(spark, sf_dir)
    needs = (
        (F.col("batch_id") >= S.CONCEPT_DRIFT_START)
        & X.high_bonus_malus()
        & (F.col("target_claim_count") < S.CLAIM_COUNT_CAP)
    )
    drawn = batching.draw_severity(batched, needs)
    return rounded(drawn.filter(needs).select("IDpol", "added_severity"), 8)


step(
    "batch_report",
    ("stream",),
    """SELECT batch_id, count(*) AS row_count, count(*) FILTER (WHERE data_drift_injected) AS data_drift_rows,
       count(*) FILTER (WHERE concept_drift_injected) AS concept_drift_rows,
       count(*) FILTER (WHERE data_drift_injected AND concept_drift_injected) AS overlap_rows,
       sum(added_severity) AS added_severity,
       count(*) FILTER (WHERE concept_drift_injected AND Exposure = 0) AS zero_exposure_concept_rows
FROM stream GROUP BY 1""",
)


@query(
    "batch_report",
    steps("batch_report") + "SELECT * REPLACE (round(added_severity, 4) AS added_severity) FROM batch_report",
)
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(batching.batch_report(B.stream(spark, sf_dir)), 4)


@query(
    "stream_report",
    steps("batch_report")
    + """SELECT count(*) AS n_batches, CAST(sum(row_count) AS BIGINT) AS joined_rows, min(row_count) AS batch_size_min,
       max(row_count) AS batch_size_max, round(avg(row_count), 4) AS batch_size_mean, CAST(sum(data_drift_rows) AS BIGINT) AS data_drift_rows,
       CAST(sum(concept_drift_rows) AS BIGINT) AS concept_drift_rows, CAST(sum(overlap_rows) AS BIGINT) AS overlap_rows,
       round(sum(added_severity), 4) AS total_synthetic_severity_added,
       CAST(sum(zero_exposure_concept_rows) AS BIGINT) AS zero_exposure_rows_during_concept_recompute FROM batch_report""",
)
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(batching.stream_report(batching.batch_report(B.stream(spark, sf_dir))), 4)


@query(
    "ground_truth",
    steps("batch_report")
    + """SELECT CAST(count(*) AS INTEGER) AS n_batches, 12 AS data_start_batch, 15 AS concept_start_batch, 15 < count(*) AS overlap_intentional,
       CASE WHEN 15 < count(*) THEN 15 END AS overlap_batch_start,
       CAST(CASE WHEN 15 < count(*) THEN count(*) - 1 END AS INTEGER) AS overlap_batch_end,
       CAST(sum(data_drift_rows) AS BIGINT) AS data_drift_rows, CAST(sum(concept_drift_rows) AS BIGINT) AS concept_drift_rows,
       CAST(sum(overlap_rows) AS BIGINT) AS overlap_rows FROM batch_report""",
)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.ground_truth(batching.batch_report(B.stream(spark, sf_dir)))


@query(
    "reference_window_check",
    steps("stream")
    + """SELECT count(*) AS reference_rows, bool_or(data_drift_injected OR concept_drift_injected) AS has_injected_drift,
       count(DISTINCT target_has_claim) AS class_count,
       NOT bool_or(data_drift_injected OR concept_drift_injected) AND count(DISTINCT target_has_claim) >= 2 AS window_ok
FROM stream WHERE batch_id BETWEEN 0 AND 9""",
)
def reference_window_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reference_window(B.stream(spark, sf_dir))


@query(
    "batch_coverage",
    steps("indexed")
    + """SELECT CAST(b AS INTEGER) AS batch_id, count(i.IDpol) AS row_count, count(i.IDpol) > 0 AS covered
FROM range(22) t(b) LEFT JOIN indexed i ON i.batch_id = b GROUP BY b""",
)
def batch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of 22 expected batches by a stream of 20."""
    return quality.batch_coverage(B.batched(spark, sf_dir), 22)


@query(
    "batch_residuals",
    steps("batch_profile", "residual_reference")
    + """SELECT batch_id, round(residual, 6) AS concept_residual, round(residual_mean, 6) AS residual_mean, round(residual_std, 6) AS residual_std
FROM batch_profile, residual_reference""",
)
def batch_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = drift.batch_profile(B.scorer()(B.stream(spark, sf_dir)), drift.BinEdges())
    stats = drift.residual_reference(profile, S.REFERENCE_FIRST_BATCH, S.REFERENCE_LAST_BATCH)
    joined = side_by_side(profile, stats)
    residual = F.col("empirical_claim_rate") - F.col("mean_predicted_probability")
    return rounded(joined.select("batch_id", residual.alias("concept_residual"), "residual_mean", "residual_std"))


@query(
    "quantile_edges",
    steps("deciles")
    + """SELECT feature, max(n) AS n_values, list(round(edge, 6) ORDER BY q) AS quantiles
FROM deciles WHERE feature <> 'density_segment' GROUP BY feature""",
)
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tontine.operators.ordering import decile_shares, exact_quantiles

    stream = B.stream(spark, sf_dir).filter(F.col("batch_id") <= S.REFERENCE_LAST_BATCH)
    result = exact_quantiles(stream, list(S.MODEL_NUMERIC), decile_shares(S.PSI_BINS))
    return result.withColumn("quantiles", F.transform("quantiles", lambda v: F.round(v, 6) + F.lit(0.0)))


@query(
    "numeric_distribution",
    steps("numeric_counts") + "SELECT batch_id, feature, bin, n FROM numeric_counts",
)
def numeric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = B.scored_stream(spark, sf_dir)
    edges = drift.fit_edges(scored.filter(F.col("batch_id") <= S.REFERENCE_LAST_BATCH))
    return drift.numeric_histogram(drift.batch_profile(scored, edges), edges)


@query(
    "categorical_distribution",
    steps("category_aligned") + "SELECT batch_id, feature, bin, CAST(n AS BIGINT) AS n FROM category_aligned",
)
def categorical_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = drift.categorical_histogram(B.scorer()(B.stream(spark, sf_dir)))
    reference = drift.sum_reference(counts, S.REFERENCE_FIRST_BATCH, S.REFERENCE_LAST_BATCH)
    return drift.align_categories(counts, reference)[0]


@query(
    "smoothed_shares",
    steps("actual_shares") + "SELECT batch_id, feature, bin, CAST(n AS BIGINT) AS n, round(share, 9) AS share FROM actual_shares WHERE feature NOT IN ("
    + ", ".join(f"'{c}'" for c in (*NUMERIC, "density_segment"))
    + ")",
)
def smoothed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.shares(categorical_distribution(spark, sf_dir), ["batch_id", "feature"], "share"), 9)


@query(
    "feature_psi",
    steps("feature_psi")
    + """SELECT batch_id, feature, round(psi, 6) AS psi, actual_rows, n_bins,
       CASE WHEN psi >= 0.25 THEN 'trigger' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS psi_level FROM feature_psi""",
)
def feature_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drift.per_feature_psi(B.scored_stream(spark, sf_dir)))


@query("drift_metrics", steps("drift") + DRIFT_SELECT)
def drift_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_metrics(drift.drift_metrics(B.scored_stream(spark, sf_dir)))


def _evaluation_sql(kind: str, start: int) -> str:
    hit = f"{kind}_drift_detected"
    return f"""SELECT '{kind}' AS drift_type, {start} AS ground_truth_start_batch,
       min(batch_id) FILTER (WHERE {hit} AND batch_id >= {start}) AS first_detected_batch,
       min(batch_id) FILTER (WHERE {hit} AND batch_id >= {start}) - {start} AS detection_latency_batches,
       coalesce(min(batch_id) FILTER (WHERE {hit} AND batch_id >= {start}) - {start} <= 2, FALSE) AS detected_within_provisional_threshold,
       coalesce(list(batch_id ORDER BY batch_id) FILTER (WHERE {hit} AND batch_id < {start}), []) AS false_positive_batches,
       coalesce(list(batch_id ORDER BY batch_id) FILTER (WHERE {hit} AND batch_id BETWEEN 15 AND 19), []) AS overlap_detected_batches
FROM drift"""


def evaluations(metrics: DataFrame) -> DataFrame:
    overlap = (max(S.DATA_DRIFT_START, S.CONCEPT_DRIFT_START), S.N_BATCHES - 1)
    return drift.detection_evaluation(metrics, "data", S.DATA_DRIFT_START, overlap).unionByName(
        drift.detection_evaluation(metrics, "concept", S.CONCEPT_DRIFT_START, overlap)
    )


@query(
    "detection_evaluation",
    steps("drift") + _evaluation_sql("data", 12) + "\nUNION ALL " + _evaluation_sql("concept", 15),
)
def detection_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(metrics_table(spark, sf_dir))


@query(
    "replay_sample",
    steps("indexed")
    + """, r AS (SELECT IDpol, batch_id FROM indexed WHERE batch_id BETWEEN 0 AND 9)
SELECT IDpol, batch_id FROM r QUALIFY row_number() OVER (ORDER BY md5('42:' || IDpol), IDpol) <= CAST(round_even((SELECT count(*) FROM r) * 0.1e0, 0) AS BIGINT)""",
)
def replay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = B.batched(spark, sf_dir).select("IDpol", "batch_id")
    return sampling.replay_sample(batched.filter(F.col("batch_id").between(0, S.REFERENCE_LAST_BATCH)))
