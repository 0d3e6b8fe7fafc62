"""K-means for every k of a scan at once.

Each pass over the encoded policies finds every row's nearest centre for all k that still move: one matrix product with the
centres of all k side by side; the rows of every centre are then counted and added up inside the task, without a matrix of memberships. What leaves a task is
one row with the sums of all centres (for k = 10 .. 50 at most 1,230); rows are added up in rounds, and at most 64 reach the
driver. Features are fixed-point integers, so sums do not depend on how rows are dealt to tasks.

Centres start from k-means++ on a bounded sample; the first k draws of one sequence start the run of k. Of several sequences
each k takes the one with the least cost on the sample. The silhouette of every k is measured on one bounded sample, whose
distances are computed once for all k. Both sample sizes are parameters of the model itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Features are multiples of 2^-20.
UNIT = float(1 << 20)
POINT = "_point"
#: Rows of one matrix product, and of a task.
TILE, TASK_ROWS = 2048, 1 << 16
#: Parts that one task, or the driver, adds up.
FAN = 64
#: A k stops when no centre moves further than this share of the mean variance of a feature (squared distances).
TOLERANCE = 1e-4


class Centres(NamedTuple):
    """Centres of several k, one under the other: those of ``ks[i]`` begin at ``starts[i]``."""

    ks: tuple[int, ...]
    matrix: np.ndarray

    @property
    def starts(self) -> list[int]:
        return np.concatenate(([0], np.cumsum(self.ks)[:-1])).astype(int).tolist()

    def of(self, k: int) -> np.ndarray:
        start = self.starts[self.ks.index(k)]
        return self.matrix[start : start + k]


def fixed_point(features: str) -> Column:
    """A vector column as whole multiples of 2^-20."""
    return F.transform(vector_to_array(features), lambda x: F.round(x * UNIT).cast("int"))


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) / UNIT if len(column) else np.empty((0, 0))


def sample_matrix(sample: DataFrame) -> np.ndarray:
    """The points of a bounded sample as one matrix, in order of their bytes."""
    rows = np.array([r[0] for r in sample.select(POINT).collect()], np.int64)
    return rows[np.lexsort(rows.T[::-1])] / UNIT


def nearest(points: np.ndarray, centres: Centres) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre within each k and the squared distance (both: rows x number of k)."""
    # One product gives squared distances but for the point's own length; no other pass over rows x centres.
    lined = np.vstack((-2.0 * centres.matrix.T, (centres.matrix * centres.matrix).sum(axis=1)))
    gaps = np.hstack((points, np.ones((len(points), 1)))) @ lined
    best = np.empty((len(points), len(centres.ks)), np.int64)
    cost = np.empty(best.shape)
    lengths = (points * points).sum(axis=1)
    for at, (k, start) in enumerate(zip(centres.ks, centres.starts, strict=True)):
        part = gaps[:, start : start + k]
        best[:, at] = part.argmin(axis=1)
        cost[:, at] = np.maximum(lengths + part[np.arange(len(points)), best[:, at]], 0.0)
    return best, cost


def plus_plus(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ draws; a sample with fewer different points repeats some."""
    chosen = [points[rng.integers(len(points))]]
    gaps = ((points - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = gaps.sum()
        at = rng.choice(len(points), p=gaps / total) if total > 0 else rng.integers(len(points))
        chosen.append(points[at])
        gaps = np.minimum(gaps, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def starting_centres(points: np.ndarray, k_min: int, k_max: int, seed: int, tries: int = 3) -> Centres:
    ks = tuple(range(k_min, k_max + 1))
    drawn = [plus_plus(points, k_max, np.random.default_rng((seed, t))) for t in range(tries)]
    offered = [Centres(ks, np.concatenate([d[:k] for k in ks])) for d in drawn]
    costs = np.zeros((tries, len(ks)))
    for t, centres in enumerate(offered):
        for start in range(0, len(points), TILE):
            costs[t] += nearest(points[start : start + TILE], centres)[1].sum(axis=0)
    best = costs.argmin(axis=0)
    return Centres(ks, np.concatenate([offered[t].of(k) for t, k in zip(best, ks, strict=True)]))


class Sums(NamedTuple):
    """Rows, cost and sum of the rows of every centre; sums are whole numbers (in units of 2^-20), so they add up exactly."""

    counts: np.ndarray
    costs: np.ndarray
    sums: np.ndarray


PART = pa.schema([("counts", pa.binary()), ("costs", pa.binary()), ("sums", pa.binary())])
PART_FIELDS = "counts binary, costs binary, sums binary"


def _packed(part: Sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in part], schema=PART)


def _added(rows: Iterator[tuple], size: int, width: int) -> Sums:
    total = Sums(np.zeros(size, np.int64), np.zeros(size), np.zeros((size, width)))
    for counts, costs, sums in rows:
        np.add(total.counts, np.frombuffer(counts, np.int64), out=total.counts)
        np.add(total.costs, np.frombuffer(costs), out=total.costs)
        np.add(total.sums, np.frombuffer(sums).reshape(size, width), out=total.sums)
    return total


def centre_sums(points: DataFrame, centres: Centres, tasks: int) -> Sums:
    """The sums over all rows, which lie in ``tasks`` partitions: one part a task, added up ``FAN`` by ``FAN`` until few enough are left for the driver."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    size, width = centres.matrix.shape

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Centres = shared.value
        starts = np.array(held.starts)
        total = Sums(np.zeros(size, np.int64), np.zeros(size), np.zeros((size, width)))
        for batch in batches:
            whole = matrix_of(batch.column(0))
            for first in range(0, len(whole), TILE):
                rows = whole[first : first + TILE]
                best, cost = nearest(rows, held)
                place = (best + starts).ravel()
                for at, column in enumerate((rows * UNIT).T):  # whole numbers, exact in any order
                    total.sums[:, at] += np.bincount(place, weights=np.repeat(column, best.shape[1]), minlength=size)
                np.add(total.counts, np.bincount(place, minlength=size), out=total.counts)
                np.add(total.costs, np.bincount(place, weights=cost.ravel(), minlength=size), out=total.costs)
        yield _packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _packed(_added((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), size, width))

    parts = points.select(POINT).mapInArrow(fold, PART_FIELDS)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(add, PART_FIELDS)
    total = _added((tuple(r) for r in parts.collect()), size, width)
    shared.unpersist()
    return total


def stop_below(sample: np.ndarray) -> float:
    """The squared shift under which a centre counts as standing still."""
    return TOLERANCE * float(sample.var(axis=0).mean())


def fit_all(points: DataFrame, centres: Centres, max_iter: int, stop: float) -> tuple[Centres, dict[int, float]]:
    """Centres after at most ``max_iter`` passes, and the cost of each k under them. Empty centres stay where they are.

    A k leaves the passes once no centre of it has moved further than ``stop`` (squared), so it ends where it would alone.
    """
    tasks = points.rdd.getNumPartitions()
    fitted = {k: centres.of(k) for k in centres.ks}
    moving = centres.ks
    for _ in range(max_iter):
        if not moving:
            break
        now = Centres(moving, np.concatenate([fitted[k] for k in moving]))
        moved = now.matrix.copy()
        found = centre_sums(points, now, tasks)
        held = found.counts > 0
        moved[held] = found.sums[held] / (found.counts[held, None] * UNIT)
        shift = ((moved - now.matrix) ** 2).sum(axis=1)
        still = []
        for k, start in zip(now.ks, now.starts, strict=True):
            fitted[k] = moved[start : start + k]
            if shift[start : start + k].max() > stop:
                still.append(k)
        moving = tuple(still)
    final = Centres(centres.ks, np.concatenate([fitted[k] for k in centres.ks]))
    costs = centre_sums(points, final, tasks).costs
    return final, {k: float(costs[start : start + k].sum()) for k, start in zip(final.ks, final.starts, strict=True)}


def sample_silhouettes(spark: SparkSession, points: np.ndarray, centres: Centres, block: int = 256) -> dict[int, float]:
    """Mean Euclidean silhouette of a bounded sample for every k; NaN where fewer than two labels, or only single points, occur.

    A task measures a block of points against the whole sample once and sums the distances per label for each k.
    """
    labels = np.concatenate([nearest(points[at : at + TILE], centres)[0] for at in range(0, len(points), TILE)])
    shared = spark.sparkContext.broadcast((points, labels.astype(np.int16), centres.ks))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everything, labelled, ks = shared.value
        lengths = (everything * everything).sum(axis=1)
        members = []
        for at, k in enumerate(ks):
            member = np.zeros((len(everything), k))
            member[np.arange(len(everything)), labelled[:, at]] = 1.0
            members.append((member, member.sum(axis=0)))
        for batch in batches:
            for start in batch["id"]:
                rows = slice(start, start + block)
                scale = lengths[rows, None] + lengths
                squared = scale - 2.0 * (everything[rows] @ everything.T)
                squared[squared < 1e-13 * scale] = 0.0  # what rounding leaves of equal points
                gaps = np.sqrt(squared)
                scores = [block_score(gaps @ member, sizes, labelled[rows, at]) for at, (member, sizes) in enumerate(members)]
                yield pd.DataFrame({"k": list(ks), "total": scores})

    blocks = spark.range(0, len(points), block, numPartitions=max(1, min(-(-len(points) // block), 64)))
    totals = blocks.mapInPandas(measure, "k int, total double").groupBy("k").agg(F.sum("total").alias("total"))
    means = {r["k"]: r["total"] / len(points) for r in totals.collect()}
    for at, k in enumerate(centres.ks):
        distinct = len(np.unique(labels[:, at]))
        if distinct < 2 or distinct >= len(points):
            means[k] = float("nan")
    return means


def block_score(sums: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> float:
    """Sum of the silhouettes of a block from its distance sums per label; labels held by one point score zero."""
    pick = np.arange(len(own))
    inner = sums[pick, own] / np.maximum(sizes[own] - 1, 1)
    means = np.divide(sums, sizes, out=np.full(sums.shape, np.inf), where=sizes > 0)
    means[pick, own] = np.inf
    outer = means.min(axis=1)
    known = (sizes[own] > 1) & np.isfinite(outer)
    inner, outer = inner[known], outer[known]
    return float(((outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300)).sum())


def with_pools(encoded: DataFrame, centres: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` and ``pool_id``, the nearest of ``centres`` (the smaller number on a tie)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Centres((len(centres),), centres))
    kept = encoded.select(*columns, POINT)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix_of(batch.column(batch.num_columns - 1))
            best = [nearest(rows[at : at + TILE], shared.value)[0][:, 0] for at in range(0, len(rows), TILE)]
            pools = np.concatenate([np.empty(0, np.int64), *best]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pools)], names=[*columns, "pool_id"])

    fields = T.StructType([*kept.schema.fields[:-1], T.StructField("pool_id", T.IntegerType())])
    return kept.mapInArrow(label, fields)
