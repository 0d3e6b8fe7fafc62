"""The candidates of all retraining events fitted together.

Every stream row is stored once, with the numbers of the events it trains; a row that is in an event's window and in its
replay sample carries that number twice. A Newton step of all events is one pass: a task folds gradient and curvature per
event, so what leaves it does not grow with the rows. The objective is that of the single fit (``fit_logistic``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import encoding, scoring
from tontine.operators.folding import array_sum
from tontine.operators.ordering import hash_sample_flag, rank_statistics
from tontine.sources.shared import spool

#: Newton steps at most, and the largest change of a weight at which an event is done.
STEPS, SETTLED = 40, 1e-9
#: A step's gain a row that is rounding.
ROUNDING = 1e-16
POINT = "events array<int>, y double, x array<double>"


def event_points(events: DataFrame, stream: DataFrame, encoder: PipelineModel, last_reference: int, fraction: float, seed: int):
    """``events, y, x`` of every row that trains any event, and the events' batches in order of their number."""
    triggers = [r["trigger_batch"] for r in events.select("trigger_batch").orderBy("trigger_batch").collect()]
    spark = stream.sparkSession
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(triggers)], "trigger_batch int, number int")
    listed = (
        events.select("trigger_batch", F.explode(X.parse_batch_ids("training_window_batches")).alias("batch_id"))
        .join(F.broadcast(numbers), "trigger_batch")
        .groupBy("batch_id")
        .agg(F.collect_list("number").alias("_window"))
    )  # a row per batch
    reference = F.col("batch_id").between(0, last_reference)
    size = lambda rows: F.bround(rows.cast("double") * fraction).cast("bigint")
    flagged = hash_sample_flag(stream.filter(reference), "IDpol", seed, size, "_replayed")
    flagged = flagged.unionByName(stream.filter(~reference).withColumn("_replayed", F.lit(False)))
    none = F.array().cast("array<int>")
    every = F.array(*(F.lit(i) for i in range(len(triggers)))) if triggers else none
    marked = flagged.join(F.broadcast(listed), "batch_id", "left").withColumn(
        "events", F.concat(F.coalesce("_window", none), F.when(F.col("_replayed"), every).otherwise(none))
    )
    inputs = scoring.model_inputs(marked.filter(F.size("events") > 0))
    encoded = encoding.encode(inputs, encoder)
    points = encoded.select("events", F.col(S.TARGET).cast("double").alias("y"), vector_to_array(encoding.FEATURES).alias("x"))
    return spool(points, "event-points"), triggers


def _by_event(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per event of a batch: its number, labels, features with a one in front, and how often each row counts."""
    if not batch.num_rows:
        return
    lists = batch.column(0)
    number = lists.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    y = batch.column(1).to_numpy()
    x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
    x = np.hstack((np.ones((len(x), 1)), x))
    for event in np.unique(number).tolist():
        if wanted is not None and not wanted[event]:
            continue
        rows, times = np.unique(row[number == event], return_counts=True)
        yield event, y[rows], x[rows], times.astype(np.float64)


def fit_events(points: DataFrame, n_events: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (intercept first) of every event, its rows and its positives; an event of one class has weights of NaN.

    An event is done once a step would lower its loss by less than rounding shows, relative to its rows: in directions that
    only the penalty bounds, the rounding of a long sum moves weights for ever. A curvature serves later steps while each
    of them gains a hundredth of the one before; done events are not measured again.
    """
    width = len(points.select("x").first()[0]) + 1
    block = width * width + width + 2
    weights, curvature = np.zeros((n_events, width)), np.zeros((n_events, width, width))
    spark = points.sparkSession
    penalty = np.diag([0.0, *np.ones(width - 1)])
    rows, positives = np.zeros(n_events), np.zeros(n_events)
    gained = np.full(n_events, np.inf)
    active, curved = np.ones(n_events, bool), np.ones(n_events, bool)
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((weights, active, curved))

        def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            at, wanted, bent = shared.value
            total = np.zeros((n_events, block))
            for batch in batches:
                for event, y, x, times in _by_event(batch, wanted):
                    p = 1.0 / (1.0 + np.exp(-np.clip(x @ at[event], -700, 700)))
                    if bent[event]:
                        total[event, : width * width] += ((x * (times * p * (1.0 - p))[:, None]).T @ x).ravel()
                    total[event, width * width : -2] += x.T @ (times * (p - y))
                    total[event, -2:] += times.sum(), (times * y).sum()
            return total.ravel()

        sums = array_sum(points, fold, n_events * block).reshape(n_events, block)
        shared.unpersist()
        rows[active], positives[active] = sums[active, -2], sums[active, -1]
        active &= (positives > 0) & (positives < rows)
        for event in np.flatnonzero(active).tolist():
            if curved[event]:
                curvature[event] = sums[event, : width * width].reshape(width, width) + penalty + 1e-12 * np.eye(width)
            slope = sums[event, width * width : -2] + penalty @ weights[event]
            step = np.linalg.solve(curvature[event], slope)
            gain = float(slope @ step)
            step *= min(1.0, 10.0 / max(float(np.abs(step).max()), 1e-300))
            weights[event] -= step
            active[event] = gain > ROUNDING * rows[event] and float(np.abs(step).max()) >= SETTLED
            curved[event] = gain > 0.01 * gained[event] or not np.isfinite(gained[event])
            gained[event] = gain
        if not active.any():
            break
    weights[(positives == 0) | (positives == rows)] = np.nan
    return weights, rows, positives


SCORED = "event int, y double, p double, times long"


def event_scores(points: DataFrame, weights: np.ndarray) -> DataFrame:
    """``event, y, p, times`` of every training row of every event that could be fitted."""
    shared = points.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("event", pa.int32()), ("y", pa.float64()), ("p", pa.float64()), ("times", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for event, y, x, times in _by_event(batch):
                if np.isfinite(shared.value[event]).all():
                    p = 1.0 / (1.0 + np.exp(-np.clip(x @ shared.value[event], -700, 700)))
                    columns = [np.full(len(y), event, np.int32), y, p, times.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return points.mapInArrow(score, SCORED)


def candidate_aucs(
    events: DataFrame,
    stream: DataFrame,
    encoder: PipelineModel,
    seed: int = S.SEED,
    last_reference: int = S.REFERENCE_LAST_BATCH,
    fraction: float = S.REPLAY_FRACTION,
) -> DataFrame:
    """``trigger_batch, training_rows, auc``: the training AUC of each event's candidate; null for a single class."""
    spark = events.sparkSession
    points, triggers = event_points(events, stream, encoder, last_reference, fraction, seed)
    fields = "event int, trigger_batch int, training_rows long"
    if not triggers:
        return spark.createDataFrame([], "trigger_batch int, training_rows long, auc double")
    weights, rows, _ = fit_events(points, len(triggers))
    table = spark.createDataFrame([(i, t, int(rows[i])) for i, t in enumerate(triggers)], fields)
    scored = spool(event_scores(points, weights), "event-scores")
    sums = rank_statistics(scored, ("event",), "p", F.col("y") == 1, times="times")
    auc = sums.select("event", F.try_divide("u", F.col("positives").cast("double") * F.col("negatives")).alias("auc"))
    return table.join(F.broadcast(auc), "event", "left").drop("event")
