"""Request counters, histograms, rates, gauges and alerts as grouped queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tontine import schemas as S


def cumulative_buckets(value: Column | str, edges: Sequence[float]) -> list[Column]:
    """Counts at or below each edge, as a monitoring histogram keeps them."""
    value = F.col(value) if isinstance(value, str) else value
    return [F.count_if(value <= F.lit(float(edge))).alias(f"le_{i}") for i, edge in enumerate(edges)]


def histogram(df: DataFrame, by: Sequence[str | Column], value: str, edges: Sequence[float]) -> DataFrame:
    return df.groupBy(*by).agg(
        *cumulative_buckets(value, edges), F.count(F.lit(1)).alias("observations"), F.sum(value).alias("value_sum")
    )


def request_metrics(requests: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Requests by method, path, status and model source, with their latency histogram."""
    return histogram(requests, ["method", "path", "status_code", "model_source"], "latency", edges)


def score_histogram(scored: DataFrame, by: str, score: str = S.PROBABILITY) -> DataFrame:
    return histogram(scored, [by], score, S.SCORE_BUCKETS)


def windowed_requests(requests: DataFrame, edges: Sequence[float], width: str = "5 minutes") -> DataFrame:
    """Per window and path: count, errors, latency sum and cumulative latency buckets."""
    return (
        requests.groupBy(F.window("ts", width).alias("w"), "path")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.count_if(F.col("status_code") >= 500).alias("error_count"),
            F.sum("latency").alias("latency_sum"),
            *cumulative_buckets("latency", edges),
        )
        .select(F.col("w.start").alias("window_start"), "path", "request_count", "error_count", "latency_sum", *(
            f"le_{i}" for i in range(len(edges))
        ))
    )


def bucket_quantile(share: float, edges: Sequence[float], total: str = "request_count") -> Column:
    """Quantile interpolated inside the first bucket that reaches the wanted rank.

    Observations above the last edge report that edge.
    """
    rank = F.col(total).cast("double") * F.lit(share)
    result = F.lit(float(edges[-1]))
    for i in range(len(edges) - 1, -1, -1):
        low = float(edges[i - 1]) if i else 0.0
        below = F.col(f"le_{i - 1}") if i else F.lit(0)
        inside = F.col(f"le_{i}") - below
        spot = F.lit(low) + F.lit(float(edges[i]) - low) * F.try_divide(rank - below, inside)
        result = F.when(F.col(f"le_{i}") >= rank, F.coalesce(spot, F.lit(low))).otherwise(result)
    return F.when(F.col(total) > 0, result)


def rates(windowed: DataFrame, edges: Sequence[float], seconds: float = 300.0, share: float = 0.95) -> DataFrame:
    """Per window and path: requests per second and the interpolated latency quantile."""
    return windowed.select(
        "window_start",
        "path",
        "request_count",
        (F.col("request_count") / F.lit(seconds)).alias("rate"),
        bucket_quantile(share, edges).alias("latency_quantile"),
    )


def gauges(reports: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``gauge, value`` rows (0.0 or 1.0) of the seven state flags; null counts as 0."""
    cells = F.array(
        *(
            F.struct(F.lit(g).alias("gauge"), F.coalesce(F.col(g).cast("double"), F.lit(0.0)).alias("value"))
            for g in S.GAUGES
        )
    )
    return reports.select(*keep, F.inline(cells))


def alert_state(reports: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Firing alerts with their severity. ``reports`` has the gauges as 0/1 columns and
    ``trace_log_failures_total``."""
    numeric = reports.withColumns({g: F.coalesce(F.col(g).cast("int"), F.lit(0)) for g in S.GAUGES})
    cells = ", ".join(
        f"named_struct('alert', '{name}', 'severity', '{severity}', 'firing', {condition})"
        for name, severity, condition in S.ALERT_RULES
    )
    return numeric.selectExpr(*keep, f"inline(array({cells}))").filter("firing").drop("firing")
