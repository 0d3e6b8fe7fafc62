"""Data drift (population stability index) and concept drift (residual shift) per batch.

One pass over the scored batches yields, per batch, the numeric histograms, the residual
and the flags; a second one counts categories. Everything after that works on tables of
``batches x features x bins`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators.ordering import decile_shares, exact_quantiles
from tontine.operators.reports import side_by_side
from tontine.sources.shared import spool

SEGMENT = "density_segment"
MISSING = "__missing__"
UNSEEN = "__unseen__"
SEGMENT_FEATURE = "Density_log1p"


@dataclass(frozen=True)
class BinEdges:
    """Interior bin edges per numeric feature: at most ``PSI_BINS - 1`` doubles each.

    ``segment`` is None where the reference segment is too small or too uniform to bin.
    """

    numeric: dict[str, list[float]] = field(default_factory=dict)
    segment: list[float] | None = None


def _interior(quantiles: list[float] | None) -> list[float]:
    edges = sorted(set(quantiles or []))
    return edges[1:-1]


def fit_edges(reference: DataFrame, bins: int = S.PSI_BINS) -> BinEdges:
    """De-duplicated exact deciles of the reference rows; outer edges are open.

    Fewer than three distinct edges leave one bin (no interior edge). Runs jobs, like any
    fit; the driver receives at most seven times eleven doubles.
    """
    columns = list(S.MODEL_NUMERIC)
    wide = reference.select(
        *(F.col(c).cast("double").alias(c) for c in columns),
        F.when(X.high_density(), F.col(SEGMENT_FEATURE)).cast("double").alias(SEGMENT),
    )
    fitted = {
        row["feature"]: row
        for row in exact_quantiles(wide, [*columns, SEGMENT], decile_shares(bins)).collect()
    }
    segment = fitted.get(SEGMENT)
    usable = segment is not None and segment["n_values"] >= 2 and len(set(segment["quantiles"])) >= 3
    return BinEdges(
        {c: _interior(fitted[c]["quantiles"] if c in fitted else None) for c in columns},
        _interior(segment["quantiles"]) if usable else None,
    )


def _bin_counts(name: str, value: str, interior: list[float], keep: str) -> list[Column]:
    """One conditional count per left-closed bin ``[e_i, e_i+1)``; outer bins are open."""
    counts = []
    for number, (low, high) in enumerate(zip([None, *interior], [*interior, None])):
        tests = [keep, f"{value} IS NOT NULL"]
        tests += [] if low is None else [f"{value} >= {low!r}D"]
        tests += [] if high is None else [f"{value} < {high!r}D"]
        counts.append(F.expr(f"count_if({' AND '.join(tests)})").alias(f"{name}#{number}"))
    return counts


def batch_counts(scored: DataFrame, edges: BinEdges) -> DataFrame:
    """Sums, flags and all numeric histograms per batch, in one aggregate.

    The histograms are conditional counts, so a row is not multiplied by its features and the shuffle carries one row
    per batch and task. Everything here adds up: parts of a batch can be counted apart and merged.
    """
    data, concept = F.col("data_drift_injected"), F.col("concept_drift_injected")
    y = F.col(S.TARGET).cast("double")
    counts: list[Column] = []
    for name, interior in edges.numeric.items():
        counts += _bin_counts(name, f"CAST({name} AS DOUBLE)", interior, "true")
    if edges.segment is not None:
        bands = ", ".join(f"'{label}'" for label in S.HIGH_DENSITY_BANDS)
        counts += _bin_counts(SEGMENT, SEGMENT_FEATURE, edges.segment, f"Density_band IN ({bands})")
    means = (
        ("empirical_claim_rate", y),
        ("mean_predicted_probability", F.col(S.PROBABILITY)),
        ("data_drift_eligible_fraction", X.high_density().cast("double")),
        ("concept_drift_eligible_fraction", X.high_bonus_malus().cast("double")),
    )
    for name, value in means:
        counts += [F.sum(value).alias(f"{name}+"), F.count(value).alias(f"{name}/")]
    return scored.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bool_or(data).alias("data_drift_ground_truth"),
        F.bool_or(concept).alias("concept_drift_ground_truth"),
        F.bool_or(data & concept).alias("overlap_ground_truth"),
        *counts,
    )


def merge_counts(parts: DataFrame) -> DataFrame:
    """Counts of whole batches from those of their parts."""
    merged = [
        (F.bool_or if kind == "boolean" else F.sum)(f"`{name}`").alias(name)
        for name, kind in parts.dtypes
        if name not in ("batch_id", "epoch")
    ]
    return parts.groupBy("batch_id").agg(*merged)


def profile_of(counts: DataFrame) -> DataFrame:
    """The profile of each batch: sums turned into means."""
    means = [c.removesuffix("+") for c in counts.columns if c.endswith("+")]
    kept = [F.col(f"`{c}`") for c in counts.columns if c.rstrip("+/") not in means]
    return counts.select(*kept, *(F.try_divide(F.col(f"`{m}+`"), F.col(f"`{m}/`")).alias(m) for m in means))


def batch_profile(scored: DataFrame, edges: BinEdges) -> DataFrame:
    """Residual, flags and all numeric histograms per batch."""
    return profile_of(batch_counts(scored, edges))


def numeric_histogram(profile: DataFrame, edges: BinEdges) -> DataFrame:
    """``batch_id, feature, bin, n`` rows from the wide profile; every bin is present."""
    shapes = dict(edges.numeric)
    if edges.segment is not None:
        shapes[SEGMENT] = edges.segment
    cells = [
        f"named_struct('feature', '{name}', 'bin', '{number}', 'n', `{name}#{number}`)"
        for name, interior in shapes.items()
        for number in range(len(interior) + 1)
    ]
    return profile.selectExpr("batch_id", f"inline(array({', '.join(cells)}))")


def categorical_histogram(scored: DataFrame) -> DataFrame:
    """``batch_id, feature, bin, n`` rows of category counts; null is its own category."""
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("feature"),
                F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("bin"),
            )
            for c in S.MODEL_CATEGORICAL
        )
    )
    return (
        scored.select("batch_id", F.inline(cells))
        .groupBy("batch_id", "feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sum_reference(histogram: DataFrame, first: int, last: int) -> DataFrame:
    """Reference counts: the reference batches' histograms added up."""
    return (
        histogram.filter(F.col("batch_id").between(first, last))
        .groupBy("feature", "bin")
        .agg(F.sum("n").alias("n"))
    )


def align_categories(histogram: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides over the reference categories plus one bucket for unseen ones."""
    known = reference.select("feature", "bin", F.lit(True).alias("known"))
    mapped = (
        histogram.join(known, ["feature", "bin"], "left")
        .withColumn("bin", F.when(F.col("known"), F.col("bin")).otherwise(F.lit(UNSEEN)))
        .select("batch_id", "feature", "bin", "n")
    )
    unseen = reference.select("feature").distinct().select("feature", F.lit(UNSEEN).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    full_reference = reference.unionByName(unseen)
    observed = histogram.select("batch_id", "feature").distinct()
    zeros = observed.join(full_reference.select("feature", "bin"), "feature").withColumn("n", F.lit(0).cast("bigint"))
    dense = (
        mapped.unionByName(zeros.select("batch_id", "feature", "bin", "n"))
        .groupBy("batch_id", "feature", "bin")
        .agg(F.sum("n").alias("n"))
    )
    return dense, full_reference


def shares(histogram: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Shares clipped from below and renormalised; an empty histogram is all epsilon."""
    cell = Window.partitionBy(*keys)
    counted = histogram.withColumn("_total", F.sum("n").over(cell)).withColumn(
        "_clipped",
        F.when(F.col("_total") == 0, F.lit(S.EPSILON)).otherwise(
            F.greatest(F.try_divide(F.col("n").cast("double"), F.col("_total")), F.lit(S.EPSILON))
        ),
    )
    share = F.when(F.col("_total") == 0, F.col("_clipped")).otherwise(
        F.col("_clipped") / F.sum("_clipped").over(cell)
    )
    return counted.withColumn(out, share).drop("_total", "_clipped")


def psi(actual: DataFrame, reference: DataFrame) -> DataFrame:
    """Population stability index per (batch, feature) over aligned bins."""
    a = shares(actual, ["batch_id", "feature"], "actual").withColumnRenamed("n", "actual_n")
    e = shares(reference, ["feature"], "expected").select("feature", "bin", "expected")
    act = F.greatest(F.col("actual"), F.lit(S.EPSILON))
    exp = F.greatest(F.col("expected"), F.lit(S.EPSILON))
    return (
        a.join(e, ["feature", "bin"])
        .groupBy("batch_id", "feature")
        .agg(
            F.sum((act - exp) * F.ln(act / exp)).alias("psi"),
            F.sum("actual_n").alias("actual_rows"),
            F.count(F.lit(1)).alias("n_bins"),
        )
    )


def feature_psi(numeric: DataFrame, categorical: DataFrame, numeric_ref: DataFrame, categorical_ref: DataFrame) -> DataFrame:
    aligned, full_ref = align_categories(categorical, categorical_ref)
    return psi(numeric.unionByName(aligned), numeric_ref.unionByName(full_ref))


def strongest_feature(per_feature: DataFrame) -> DataFrame:
    """Per batch the largest feature index, the earlier model input winning a tie, and the
    index inside the high-density segment (0.0 where either side is too small)."""
    ordinal = F.coalesce(
        *(F.when(F.col("feature") == name, F.lit(i)) for i, name in enumerate(S.MODEL_INPUTS))
    )
    whole = F.col("feature") != SEGMENT
    return per_feature.groupBy("batch_id").agg(
        F.max_by(F.when(whole, F.col("feature")), F.when(whole, F.struct(F.round("psi", 12), -ordinal))).alias(
            "max_psi_feature"
        ),
        F.max(F.when(whole, F.col("psi"))).alias("max_psi"),
        F.coalesce(
            F.max(F.when(~whole & (F.col("actual_rows") >= 2), F.col("psi"))), F.lit(0.0)
        ).alias("density_segment_psi"),
    )


def residual_reference(profile: DataFrame, first: int, last: int) -> DataFrame:
    """Mean and population deviation (floored) of the reference batches' residuals."""
    residual = F.col("empirical_claim_rate") - F.col("mean_predicted_probability")
    return profile.filter(F.col("batch_id").between(first, last)).agg(
        F.avg(residual).alias("residual_mean"),
        F.greatest(F.stddev_pop(residual), F.lit(S.EPSILON)).alias("residual_std"),
    )


METRIC_COLUMNS = (
    "batch_id",
    "row_count",
    "max_psi_feature",
    "max_psi",
    "density_segment_psi",
    "data_drift_signal_psi",
    "data_drift_signal_source",
    "data_drift_detected",
    "empirical_claim_rate",
    "mean_predicted_probability",
    "concept_residual",
    "concept_residual_delta",
    "concept_residual_z_score",
    "concept_drift_detected",
    "data_drift_ground_truth",
    "concept_drift_ground_truth",
    "overlap_ground_truth",
    "data_drift_eligible_fraction",
    "concept_drift_eligible_fraction",
)


def assemble_metrics(profile: DataFrame, strongest: DataFrame, residuals: DataFrame) -> DataFrame:
    """The 19-column metrics row per batch."""
    residual = F.col("empirical_claim_rate") - F.col("mean_predicted_probability")
    return (
        side_by_side(profile.join(strongest, "batch_id"), residuals)
        .withColumn("data_drift_signal_psi", F.greatest("max_psi", "density_segment_psi"))
        .withColumn("data_drift_signal_source", X.signal_source("density_segment_psi", "max_psi"))
        .withColumn("data_drift_detected", X.data_drift_triggered("data_drift_signal_psi"))
        .withColumn("concept_residual", residual)
        .withColumn("concept_residual_delta", residual - F.col("residual_mean"))
        .withColumn("concept_residual_z_score", F.abs("concept_residual_delta") / F.col("residual_std"))
        .withColumn(
            "concept_drift_detected",
            X.concept_drift_triggered("concept_residual_delta", "concept_residual_z_score"),
        )
        .select(*METRIC_COLUMNS)
    )


@dataclass(frozen=True)
class DriftReference:
    """What a monitor carries from batch to batch: edges, reference counts, residual stats."""

    edges: BinEdges
    numeric: DataFrame
    categorical: DataFrame
    residuals: DataFrame


def fit_reference(
    scored: DataFrame,
    first: int = S.REFERENCE_FIRST_BATCH,
    last: int = S.REFERENCE_LAST_BATCH,
) -> DriftReference:
    """Freeze the reference window of a scored stream."""
    reference = scored.filter(F.col("batch_id").between(first, last))
    edges = fit_edges(reference)
    profile = spool(batch_profile(reference, edges), "reference-profile")
    # Written once: every micro-batch reads these small tables again.
    return DriftReference(
        edges,
        spool(sum_reference(numeric_histogram(profile, edges), first, last), "reference-numeric"),
        spool(sum_reference(categorical_histogram(reference), first, last), "reference-categories"),
        spool(residual_reference(profile, first, last), "reference-residuals"),
    )


def score_profiles(profile: DataFrame, categorical: DataFrame, reference: DriftReference) -> DataFrame:
    """Metrics of any set of measured batches against a frozen reference.

    Both inputs are read by several branches of the plan; hold them (stored or cached)
    before, or every branch scans the batches again.
    """
    per_feature = feature_psi(
        numeric_histogram(profile, reference.edges),
        categorical,
        reference.numeric,
        reference.categorical,
    )
    return assemble_metrics(profile, strongest_feature(per_feature), reference.residuals)


def per_feature_psi(
    scored: DataFrame,
    first: int = S.REFERENCE_FIRST_BATCH,
    last: int = S.REFERENCE_LAST_BATCH,
    edges: BinEdges | None = None,
) -> DataFrame:
    """Index of every (batch, feature) with its warning level."""
    edges = edges or fit_edges(scored.filter(F.col("batch_id").between(first, last)))
    _, per_feature = _measured(scored, edges, first, last)
    return per_feature.withColumn("psi_level", X.psi_level("psi"))


def _measured(scored: DataFrame, edges: BinEdges, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Stored batch profile and the index of every feature: two passes over the batches.

    The profile is written (one row per batch) because its readers need different columns;
    pruned differently, they would each scan the batches.
    """
    profile = spool(batch_profile(scored, edges), "profile")
    categorical = spool(categorical_histogram(scored), "categories")
    numeric = numeric_histogram(profile, edges)
    return profile, feature_psi(
        numeric, categorical, sum_reference(numeric, first, last), sum_reference(categorical, first, last)
    )


def drift_metrics(
    scored: DataFrame,
    first: int = S.REFERENCE_FIRST_BATCH,
    last: int = S.REFERENCE_LAST_BATCH,
) -> DataFrame:
    """Whole-stream form: the reference counts come from the same histograms as the rest."""
    edges = fit_edges(scored.filter(F.col("batch_id").between(first, last)))
    profile, per_feature = _measured(scored, edges, first, last)
    return assemble_metrics(profile, strongest_feature(per_feature), residual_reference(profile, first, last))


def detection_evaluation(
    metrics: DataFrame,
    drift_type: str,
    start_batch: int,
    overlap: tuple[int, int] | None,
    latency: int = S.LATENCY_BATCHES,
) -> DataFrame:
    """First detection, latency, early alarms and detections inside the overlap."""
    batch = F.col("batch_id")
    hit = F.col(f"{drift_type}_drift_detected")
    inside = F.lit(False) if overlap is None else batch.between(*overlap)
    # One entry per batch number, so the lists are as long as the stream has batches.
    listed = lambda cond: F.sort_array(F.collect_list(F.when(cond, batch)))
    return metrics.agg(
        F.min(F.when(hit & (batch >= start_batch), batch)).alias("first_detected_batch"),
        listed(hit & (batch < start_batch)).alias("false_positive_batches"),
        listed(hit & inside).alias("overlap_detected_batches"),
    ).select(
        F.lit(drift_type).alias("drift_type"),
        F.lit(start_batch).alias("ground_truth_start_batch"),
        "first_detected_batch",
        (F.col("first_detected_batch") - start_batch).alias("detection_latency_batches"),
        F.coalesce(F.col("first_detected_batch") - start_batch <= latency, F.lit(False)).alias(
            "detected_within_provisional_threshold"
        ),
        "false_positive_batches",
        "overlap_detected_batches",
    )
