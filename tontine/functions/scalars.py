"""Row-level expressions shared by the batch, streaming and scoring paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from tontine import schemas as S


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def doubles(values: Iterable[float]) -> str:
    """SQL text of a double array; one parsed expression instead of one call per value."""
    return "array(" + ", ".join(f"{float(value)!r}D" for value in values) + ")"


def cap_upper(value: Column | str, cap: float | int) -> Column:
    """Clip from above; null stays null (``least`` would turn null into the cap)."""
    value = _col(value)
    return F.when(value > F.lit(cap), F.lit(cap)).otherwise(value)


def indicator(count: Column | str) -> Column:
    return (_col(count) > 0).cast("bigint")


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``num / den`` where the denominator is positive, otherwise 0.0."""
    denominator = _col(denominator)
    return F.when(denominator > 0, F.try_divide(_col(numerator), denominator)).otherwise(F.lit(0.0))


def fill_zero(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(0.0))


def density_log1p(density: Column | str = "Density") -> Column:
    return F.log1p(_col(density))


def band(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed fixed bands ``(a, b]``; the lowest edge belongs to the first band.

    ``edges`` holds the lower edges; the last band is open upwards. Values below the
    lowest edge, nulls and NaN have no band.
    """
    value = _col(value)
    expr = F.when(value.isNull() | F.isnan(value.cast("double")) | (value < F.lit(edges[0])), F.lit(None))
    for upper, label in zip(edges[1:], labels):
        expr = expr.when(value <= F.lit(upper), F.lit(label))
    return expr.otherwise(F.lit(labels[-1])).cast("string")


def named_band(band_name: str, value: Column | str | None = None) -> Column:
    source, edges, labels = S.BANDS[band_name]
    return band(source if value is None else value, edges, labels)


def high_density(band_column: Column | str = "Density_band") -> Column:
    return F.coalesce(_col(band_column).isin(*S.HIGH_DENSITY_BANDS), F.lit(False))


def high_bonus_malus(value: Column | str = "BonusMalus") -> Column:
    return F.coalesce(_col(value) >= F.lit(S.BONUS_MALUS_THRESHOLD), F.lit(False))


def normalized_gini(auc: Column | str) -> Column:
    return F.lit(2.0) * _col(auc) - F.lit(1.0)


def psi_level(psi: Column | str) -> Column:
    psi = _col(psi)
    return (
        F.when(psi >= S.PSI_TRIGGER, F.lit("trigger"))
        .when(psi >= S.PSI_WARNING, F.lit("warning"))
        .otherwise(F.lit("stable"))
    )


def signal_source(segment_psi: Column | str, max_psi: Column | str) -> Column:
    """The segment is named only where it is strictly above the whole-batch maximum."""
    return F.when(_col(segment_psi) > _col(max_psi), F.lit("density_segment_psi")).otherwise(
        F.lit("whole_batch_feature_psi")
    )


def data_drift_triggered(signal: Column | str) -> Column:
    return _col(signal) >= F.lit(S.PSI_TRIGGER)


def concept_drift_triggered(delta: Column | str, z_score: Column | str) -> Column:
    return (F.abs(_col(delta)) >= F.lit(S.RESIDUAL_DELTA_TRIGGER)) & (
        _col(z_score) >= F.lit(S.RESIDUAL_Z_TRIGGER)
    )


def triggering_detector(data: Column | str, concept: Column | str) -> Column:
    data, concept = _col(data), _col(concept)
    return (
        F.when(data & concept, F.lit("data_and_concept"))
        .when(data, F.lit("data"))
        .otherwise(F.lit("concept"))
    )


def overlap_start(data_start: Column | str, concept_start: Column | str, n_batches: Column | str) -> Column:
    start = F.greatest(_col(data_start), _col(concept_start))
    return F.when(start < _col(n_batches), start)


def overlap_end(data_start: Column | str, concept_start: Column | str, n_batches: Column | str) -> Column:
    start = overlap_start(data_start, concept_start, n_batches)
    return F.when(start.isNotNull(), _col(n_batches) - 1)


def parse_batch_ids(text: Column | str) -> Column:
    """``"8, 9,,10"`` -> ``[8, 9, 10]``; blank parts are dropped."""
    parts = F.transform(F.split(_col(text), ","), lambda part: F.trim(part))
    return F.transform(F.filter(parts, lambda part: part != ""), lambda part: part.cast("int"))


def format_batch_ids(ids: Column | str) -> Column:
    return F.array_join(F.transform(_col(ids), lambda item: item.cast("string")), ",")


def first_present(*values: Column | str) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*(F.nullif(_col(value), F.lit("")) for value in values))


def failure_reasons(checks: Iterable[str]) -> Column:
    """Names of the checks that do not hold, in the given order."""
    names = [F.when(~F.coalesce(F.col(name), F.lit(False)), F.lit(name)) for name in checks]
    return F.filter(F.array(*names), lambda name: name.isNotNull())


def cycle_source(selected: Column | str, served: Column | str) -> Column:
    return (
        F.when(_col(served), F.lit("phase9_served_retraining_cycle"))
        .when(_col(selected), F.lit("phase9_selected_unserved_retraining_event"))
        .otherwise(F.lit("phase8_retraining_event"))
    )


def cycle_id(source: Column | str, digest: Column | str, trigger: Column | str) -> Column:
    """Join key between decisions and model cycles; a null trigger drops its segment."""
    source = _col(source)
    prefix = (
        F.when(source == "phase7_reference_model", F.lit("phase7-reference"))
        .when(source == "phase9_retrained_candidate", F.lit("phase9"))
        .when(source == "env_override", F.lit("env-override"))
        .otherwise(source)
    )
    trigger = F.when(source == "phase9_retrained_candidate", _col(trigger).cast("string"))
    return F.concat_ws(":", prefix, trigger, _col(digest))


def typed_get(report: Column | str, key: str, kind: str) -> Column:
    """Value of one report field, or null where the key is absent or not of the kind."""
    text = F.get_json_object(_col(report), f"$.{key}")
    return text if kind == "string" else text.try_cast(kind)


def weighting_method(total_exposure: Column | str) -> Column:
    return F.when(_col(total_exposure) > 0, F.lit("exposure_weighted")).otherwise(
        F.lit("unweighted_zero_exposure_fallback")
    )


def scorecard(weights: dict[str, float], intercept: float) -> Column:
    """Apply phase of a logistic model on raw columns: sigma(b + sum w x)."""
    margin = F.lit(float(intercept))
    for name, weight in weights.items():
        margin = margin + F.col(name).cast("double") * F.lit(float(weight))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
