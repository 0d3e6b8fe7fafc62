"""Scoring, pool risk, discrimination and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import features, metrics, sampling, scoring
from tontine.plans import binding as B
from tontine.plans.registry import query, rounded, step, steps
from tontine.sources.shared import spool

P = "predicted_claim_probability"

step(
    "split",
    ("scored",),
    """SELECT s.*, rn <= want AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY target_has_claim ORDER BY md5('42:' || IDpol), IDpol) AS rn FROM scored) s
JOIN (
  -- training rows go to classes by whole shares, the left-over row to the larger remainder
  SELECT label, c - CAST(floor(share) AS BIGINT)
         - CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label) <= train_n - sum(CAST(floor(share) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS want
  FROM (SELECT label, c, n - CAST(ceil(n * 0.2e0) AS BIGINT) AS train_n,
               CAST(c AS DOUBLE) * (n - CAST(ceil(n * 0.2e0) AS BIGINT)) / n AS share
        FROM (SELECT target_has_claim AS label, count(*) AS c, CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM scored GROUP BY 1)))
ON target_has_claim = label""",
)
step("holdout", ("split",), "SELECT * FROM split WHERE is_test")
step(
    "calibration_bins",
    ("holdout",),
    f"""SELECT len([e FOR e IN [0.1e0, 0.2e0, 0.30000000000000004e0, 0.4e0, 0.5e0, 0.6000000000000001e0, 0.7000000000000001e0, 0.8e0, 0.9e0] IF e < {P}]) AS bin,
       count(*) AS n, sum(target_has_claim) AS sum_y, sum({P}) AS sum_p, sum(({P} - target_has_claim) * ({P} - target_has_claim)) AS sum_sq
FROM holdout GROUP BY 1""",
)
step(
    "auc",
    ("holdout",),
    f"""SELECT sum(CASE WHEN target_has_claim = 1 THEN rank_mid END) AS rank_sum,
       count(*) FILTER (WHERE target_has_claim = 1) AS np, count(*) FILTER (WHERE target_has_claim = 0) AS nn
FROM (SELECT target_has_claim, rank() OVER (ORDER BY {P}) + (count(*) OVER (PARTITION BY {P}) - 1) / 2e0 AS rank_mid FROM holdout)""",
)
step(
    "model_metrics",
    ("auc", "calibration_bins"),
    """SELECT CAST(n AS BIGINT) AS n_rows, a AS model_auc, 0.5e0 AS baseline_auc, 2 * a - 1 AS model_normalized_gini,
       0e0 AS baseline_normalized_gini, sq / n AS brier_score, gap / n AS expected_calibration_error,
       y / n AS test_empirical_claim_rate, p / n AS test_mean_predicted_probability, abs(p - y) / n AS test_probability_rate_delta
FROM (SELECT (rank_sum - np * (np + 1) / 2e0) / (CAST(np AS DOUBLE) * nn) AS a FROM auc),
     (SELECT sum(n) AS n, sum(sum_sq) AS sq, sum(abs(sum_y - sum_p)) AS gap, sum(sum_y) AS y, sum(sum_p) AS p FROM calibration_bins)""",
)
step(
    "pool_scores",
    ("scored",),
    f"""SELECT CAST(pool_id AS VARCHAR) AS pool_id, count(*) AS pool_contract_count, sum(Exposure) AS pool_scored_exposure,
       CASE WHEN sum(Exposure) > 0 THEN sum({P} * Exposure) / sum(Exposure) ELSE avg({P}) END AS pool_risk_score,
       CASE WHEN sum(Exposure) > 0 THEN 'exposure_weighted' ELSE 'unweighted_zero_exposure_fallback' END AS pool_score_weighting_method,
       avg({P}) AS mean_probability
FROM scored GROUP BY 1""",
)
step(
    "pool_rates",
    ("modelling",),
    """SELECT CAST(pool_id AS VARCHAR) AS pool_id,
       CASE WHEN sum(Exposure) > 0 THEN sum(target_claim_count) / sum(Exposure) ELSE 0e0 END AS pool_claim_rate
FROM modelling GROUP BY 1""",
)
step(
    "pool_risk",
    ("pool_scores", "pool_rates"),
    """SELECT s.pool_id, pool_contract_count, pool_scored_exposure, pool_risk_score, pool_score_weighting_method, pool_claim_rate
FROM pool_scores s LEFT JOIN pool_rates r ON s.pool_id = r.pool_id""",
)


def split(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    """Scored policies with their stored split flag."""
    return spool(sampling.stratified_split(B.scored_table(spark, sf_dir) if scored is None else scored), "split")


def holdout(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    """Keys, labels and scores of the policies held out; other columns take no part in the split."""
    scored = B.scored_table(spark, sf_dir) if scored is None else scored
    flagged = sampling.stratified_split(scored.select("IDpol", S.TARGET, S.PROBABILITY))
    return spool(flagged.filter("is_test"), "holdout")


def acceptance_reports(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Holdout metrics and score coverage, each stored as its one row."""
    scored = B.scored_table(spark, sf_dir) if scored is None else scored
    held = metrics.model_metrics(holdout(spark, sf_dir, scored))
    coverage = scoring.score_coverage(pool_risk_table(spark, sf_dir, scored))
    return spool(held, "holdout-metrics"), spool(coverage, "score-coverage")


def pool_risk_table(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    scored = B.scored_table(spark, sf_dir) if scored is None else scored
    pools = scored.select("pool_id").distinct()
    return scoring.assemble_pool_scores(pools, scoring.pool_risk_scores(scored), features.rollup_targets(scored))


@query(
    "scorecard",
    steps("scored")
    + f"SELECT IDpol, CAST(pool_id AS INTEGER) AS pool_id, round(Exposure, 6) AS Exposure, target_has_claim, round({P}, 9) AS {P} FROM scored",
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.contract_predictions(B.scored(spark, sf_dir)), **{P: 9})


@query(
    "pool_risk_scores",
    steps("pool_risk")
    + """SELECT pool_id, pool_contract_count, round(pool_scored_exposure, 6) AS pool_scored_exposure,
       round(pool_risk_score, 9) AS pool_risk_score, pool_score_weighting_method, round(pool_claim_rate, 6) AS pool_claim_rate FROM pool_risk""",
)
def pool_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pool_risk_table(spark, sf_dir), pool_risk_score=9)


@query(
    "pool_overview",
    steps("pool_risk", "modelling")
    + """SELECT r.pool_id, pool_size, round(mean_age, 6) AS pool_mean_driv_age, pool_claim_count, round(pool_claim_rate, 6) AS pool_claim_rate,
       round(pool_risk_score, 6) AS pool_risk_score, pool_score_weighting_method
FROM pool_risk r JOIN (SELECT CAST(pool_id AS VARCHAR) AS pool_id, count(*) AS pool_size, avg(DrivAge) AS mean_age,
     CAST(sum(target_claim_count) AS BIGINT) AS pool_claim_count FROM modelling GROUP BY 1) m ON r.pool_id = m.pool_id""",
)
def pool_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, outcomes and risk score of every pool, from one rollup of scored policies."""
    scored = B.scored(spark, sf_dir)
    scores = scoring.pool_risk_scores(scored)
    rollup = scored.groupBy(F.col("pool_id").cast("string").alias("pool_id")).agg(
        F.count(F.lit(1)).alias("pool_size"),
        F.avg("DrivAge").alias("pool_mean_driv_age"),
        F.sum("target_claim_count").alias("pool_claim_count"),
        X.guarded_ratio(F.sum("target_claim_count"), F.sum("Exposure")).alias("pool_claim_rate"),
    )
    joined = rollup.join(scores, "pool_id").select(
        "pool_id",
        "pool_size",
        "pool_mean_driv_age",
        "pool_claim_count",
        "pool_claim_rate",
        "pool_risk_score",
        "pool_score_weighting_method",
    )
    return rounded(joined)


@query(
    "score_coverage",
    steps("pool_risk")
    + """SELECT count(*) AS pool_input_rows, count(pool_risk_score) AS pool_score_rows,
       count(pool_risk_score) / CAST(count(*) AS DOUBLE) AS pool_score_coverage,
       count(*) FILTER (WHERE pool_score_weighting_method LIKE 'unweighted%') AS zero_exposure_pools,
       count(pool_risk_score) = count(*) AS coverage_passed FROM pool_risk""",
)
def score_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_coverage(pool_risk_table(spark, sf_dir))


@query(
    "stratified_split",
    steps("split") + "SELECT IDpol, target_has_claim, is_test FROM split",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("IDpol", S.TARGET, "is_test")


@query(
    "class_counts",
    steps("split")
    + """SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, count(*) AS row_count, CAST(sum(target_has_claim) AS BIGINT) AS positive_rows FROM split GROUP BY 1
UNION ALL SELECT 'all', count(*), CAST(sum(target_has_claim) AS BIGINT) FROM split""",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_counts(split(spark, sf_dir))


@query(
    "roc_auc",
    steps("auc")
    + "SELECT round((rank_sum - np * (np + 1) / 2e0) / (CAST(np AS DOUBLE) * nn), 9) AS auc, np AS positives, nn AS negatives FROM auc",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(holdout(spark, sf_dir)), 9)


@query(
    "baseline_auc",
    steps("holdout")
    + """SELECT 0.5e0 AS auc, count(*) FILTER (WHERE target_has_claim = 1) AS positives,
       count(*) FILTER (WHERE target_has_claim = 0) AS negatives FROM holdout""",
)
def baseline_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank statistic of a predictor that gives every row the training rate."""
    data = split(spark, sf_dir)
    rate = data.filter(~F.col("is_test")).agg(F.avg(S.TARGET)).scalar()
    constant = data.filter("is_test").withColumn(S.PROBABILITY, rate)
    return metrics.roc_auc(constant)


@query(
    "calibration_table",
    steps("calibration_bins")
    + """SELECT bin, n, CAST(sum_y AS DOUBLE) AS sum_y, round(sum_p, 6) AS sum_p, round(sum_sq, 6) AS sum_sq
FROM (SELECT CAST(bin AS INTEGER) AS bin, n, sum_y, sum_p, sum_sq FROM calibration_bins)""",
)
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_table(holdout(spark, sf_dir)))


_METRICS = (
    "model_auc baseline_auc model_normalized_gini baseline_normalized_gini brier_score expected_calibration_error"
    " test_empirical_claim_rate test_mean_predicted_probability test_probability_rate_delta"
).split()


@query(
    "model_metrics",
    steps("model_metrics") + "SELECT n_rows, " + ", ".join(f"round({m}, 9) AS {m}" for m in _METRICS) + " FROM model_metrics",
)
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.model_metrics(holdout(spark, sf_dir)), 9)


@query(
    "risk_acceptance",
    steps("model_metrics", "pool_risk")
    + """SELECT round(model_auc, 9) AS model_auc, c AS pool_score_coverage,
       model_auc > baseline_auc AND model_normalized_gini > baseline_normalized_gini AND c = 1 AS acceptance_passed
FROM model_metrics, (SELECT count(pool_risk_score) / CAST(count(*) AS DOUBLE) AS c FROM pool_risk)""",
)
def risk_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = metrics.accepted(*acceptance_reports(spark, sf_dir))
    return rounded(verdict.select("model_auc", "pool_score_coverage", "acceptance_passed"), 9)


@query(
    "anomaly_summary",
    steps("scored")
    + f"""SELECT count(*) AS anomaly_rows, CAST(sum(f) AS BIGINT) AS anomaly_count, round(avg(f), 9) AS anomaly_rate
FROM (SELECT CAST({P} > (SELECT quantile_cont({P}, 0.99) FROM scored) AS BIGINT) AS f FROM scored)""",
)
def anomaly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag step of the anomaly model: rows above the exact 99 % quantile of a score."""
    from tontine.operators import anomaly

    scored = B.scored_table(spark, sf_dir).withColumn("anomaly_score", F.col(S.PROBABILITY))
    return rounded(metrics.anomaly_summary(anomaly.flag_scores(scored)), 9)


@query(
    "fixed_sample",
    steps("policy")
    + "SELECT IDpol FROM policy ORDER BY md5('42:' || IDpol), IDpol LIMIT 1000",
)
def fixed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fixed_sample(B.policies(spark, sf_dir), "IDpol", 1000).select("IDpol")
