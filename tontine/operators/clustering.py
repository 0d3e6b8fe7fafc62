"""Pools from policy attributes: a scan over k, scored on a fixed sample; the silhouette of whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tontine import schemas as S
from tontine.functions import scalars as X
from tontine.operators import encoding, pool_scan, quality
from tontine.operators.sampling import fixed_sample
from tontine.sources.shared import spool


#: Passes over the policies at most, and rows that starting centres are drawn from (three mini-batches of 4,096).
MAX_PASSES, INIT_ROWS = 20, 12_288


class PoolConstruction(NamedTuple):
    frequency: DataFrame
    scan: DataFrame
    selected_k: int
    encoder: PipelineModel
    centres: np.ndarray


def pool_size_stats(pooled: DataFrame) -> DataFrame:
    sizes = pooled.groupBy("pool_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_pools"),
        F.min("n").alias("pool_size_min"),
        F.max("n").alias("pool_size_max"),
        F.avg("n").alias("pool_size_mean"),
    )


def label_centroids(points: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, summed map-side as whole vectors."""
    as_vector = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    return (
        points.select(label, as_vector.alias("_v"))
        .groupBy(label)
        .agg(Summarizer.mean(F.col("_v")).alias("_m"))
        .select(label, vector_to_array("_m").alias("centroid"))
    )


#: Centroids that reach a row as one array.
BLOCK_CENTROIDS = 1024


def assign_nearest(
    points: DataFrame, centroids: DataFrame, label: str, vector: str, block: int = BLOCK_CENTROIDS
) -> DataFrame:
    """Nearest centroid and squared distance of every point, the smaller label on a tie.

    Up to ``block`` centroids reach every row as one array. Any larger number is dealt into blocks of about that size: each
    is one scan of the points, which leaves the best of the block per point, and an aggregate takes the best of all blocks.
    No pair of point and centroid is ever a row.
    """
    blocks = -(-centroids.count() // block)
    if blocks <= 1:
        best = _best_in_block(points, centroids, label, vector)
        return best.select(*points.columns, F.col("_best.id").alias("nearest"), F.col("_best.sq_distance").alias("sq_distance"))
    numbered = spool(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    number = F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_block")
    dealt = spool(centroids.select(label, "centroid", number), "centroid-blocks", ["_block"])
    narrow = numbered.select("_row", vector)
    found = None
    for b in range(blocks):
        one = _best_in_block(narrow, dealt.filter(F.col("_block") == b), label, vector).select("_row", "_best")
        found = one if found is None else found.union(one)
        if b % 32 == 31:  # plans stay short
            found = spool(found.groupBy("_row").agg(F.min("_best").alias("_best")), "nearest-so-far")
    best = found.groupBy("_row").agg(F.min("_best").alias("_best"))
    return numbered.join(best, "_row").select(
        *points.columns, F.col("_best.id").alias("nearest"), F.col("_best.sq_distance").alias("sq_distance")
    )


def _best_in_block(points: DataFrame, centroids: DataFrame, label: str, vector: str) -> DataFrame:
    """``points`` with ``_best``, the smallest (squared distance, label) of a bounded set of centroids."""
    table = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("id"), "centroid")))).scalar()

    def measured(centre):
        gaps = F.zip_with(F.col(vector), centre["centroid"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        distance = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)
        return F.struct(distance.alias("sq_distance"), centre["id"].alias("id"))

    return points.withColumn("_centres", table).withColumn("_best", F.array_min(F.transform("_centres", measured))).drop("_centres")


def clustering_inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count(F.lit(1)).alias("n_points"), F.sum("sq_distance").alias("inertia"))


def silhouette_points(
    spark: SparkSession, vectors: np.ndarray, labels: np.ndarray, block: int = 256
) -> DataFrame:
    """Silhouette of each point of a bounded sample: ``position, label, silhouette``.

    The sample is a parameter of the scan (10 000 rows), small enough to ship to every
    task. A task measures a block of points against the whole sample and keeps only sums
    per label; pairs are never rows. Labels held by one point score zero.
    """
    n = len(labels)
    names, codes = np.unique(labels, return_inverse=True)
    shared = spark.sparkContext.broadcast((np.ascontiguousarray(vectors, dtype=np.float64), codes))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, own = shared.value
        sizes = np.bincount(own)
        member = np.zeros((len(own), len(sizes)))
        member[np.arange(len(own)), own] = 1.0
        for batch in batches:
            for start in batch["id"]:
                rows = np.arange(start, min(start + block, len(own)))
                squared = np.zeros((len(rows), len(own)))
                for column in range(points.shape[1]):
                    gap = points[rows, column][:, None] - points[:, column][None, :]
                    squared += gap * gap
                sums = np.sqrt(squared) @ member
                mine = own[rows]
                pick = np.arange(len(rows))
                alone = sizes[mine] == 1
                inner = sums[pick, mine] / np.maximum(sizes[mine] - 1, 1)
                means = sums / sizes
                means[pick, mine] = np.inf
                outer = means.min(axis=1)
                score = np.where(alone, 0.0, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300))
                yield pd.DataFrame({"position": rows, "code": mine, "silhouette": score})

    blocks = spark.range(0, n, block, numPartitions=max(1, min(-(-n // block), 64)))
    scored = blocks.mapInPandas(measure, "position long, code int, silhouette double")
    lookup = F.array(*(F.lit(name.item() if hasattr(name, "item") else name) for name in names))
    return scored.select("position", lookup[F.col("code")].alias("label"), "silhouette")


#: A cell of the silhouette's grid compares so many rows with as many; at least so many groups a side.
CELL_ROWS, LEAST_GROUPS = 1 << 14, 6
#: Distances that a task holds at a time: rows of one group by rows of the other.
TILE_ROWS, TILE_COLUMNS = 512, 2048


def _gap_sums(left: np.ndarray, right: np.ndarray, codes: tuple[np.ndarray, np.ndarray], names: tuple[int, int], both: bool):
    """Distances of every ``left`` row summed per label of ``right``; with ``both`` also the other way round. One tile of them at a time."""
    centre = right.mean(axis=0)
    left, right = left - centre, right - centre
    lengths, norms = np.einsum("ij,ij->i", left, left), np.einsum("ij,ij->i", right, right)
    forth = np.zeros((len(left), names[1]))
    back = np.zeros((len(right), names[0])) if both else None
    for at in range(0, len(left), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        own = codes[0][rows, None] == np.arange(names[0]) if both else None
        for start in range(0, len(right), TILE_COLUMNS):
            columns = slice(start, start + TILE_COLUMNS)
            scale = lengths[rows, None] + norms[columns]
            squared = scale - 2.0 * (left[rows] @ right[columns].T)
            # What is lost to rounding: equal vectors are exactly 0 apart.
            squared[squared < 1e-13 * scale] = 0.0
            gaps = np.sqrt(squared, out=squared)
            forth[rows] += gaps @ (codes[1][columns, None] == np.arange(names[1])).astype(np.float64)
            if both:
                back[columns] += gaps.T @ own.astype(np.float64)
    return forth, back


def _label_sums(key: str, label: str, vector: str):
    def table(own: pd.DataFrame, names: pd.Index, sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(
            {
                key: np.repeat(own[key].to_numpy(), len(names)),
                label: np.repeat(own[label].to_numpy(), len(names)),
                "other": np.tile(np.asarray(names), len(own)),
                "total": sums.ravel(),
            }
        )

    def measure(cell: pd.DataFrame) -> pd.DataFrame:
        first, second = cell["_i"].iloc[0], cell["_j"].iloc[0]
        sides = [cell[cell["_g"] == g].drop(columns=["_g", "_i", "_j"]) for g in (first, second)]
        if any(side.empty for side in sides):
            return table(cell[:0], cell[label][:0], np.zeros(0))
        coded = [pd.factorize(side[label], use_na_sentinel=False) for side in sides]
        left, right = (np.vstack(side[vector].to_numpy()).astype(np.float64) for side in sides)
        counts = (len(coded[0][1]), len(coded[1][1]))
        forth, back = _gap_sums(left, right, (coded[0][0], coded[1][0]), counts, first != second)
        found = table(sides[0], coded[1][1], forth)
        return found if back is None else pd.concat([found, table(sides[1], coded[0][1], back)], ignore_index=True)

    return measure


def silhouette_table(points: DataFrame, key: str, label: str, vector: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Euclidean silhouette of every row, measured against all rows: ``key, label, silhouette``.

    Rows are dealt by key hash into groups; a task compares two groups, both ways at once, and
    keeps sums per label, so pairs are never rows and nothing passes through the driver. A task
    holds its two groups and one tile of distances. The work is that of all pairs. Keys are unique; labels held by one point score zero, the only
    label of a table scores null.
    """
    groups = max(LEAST_GROUPS, -(-points.count() // cell_rows))
    dealt = points.select(key, label, vector, F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_g"))
    met = dealt.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sides = met.select(key, label, vector, "_g", F.least("_g", "_h").alias("_i"), F.greatest("_g", "_h").alias("_j"))
    kinds = dict(points.select(key, label).dtypes)
    fields = f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, other {kinds[label]}, total double"
    cells = sides.repartition(groups * (groups + 1) // 2, "_i", "_j").groupBy("_i", "_j")
    sums = cells.applyInPandas(_label_sums(key, label, vector), fields).groupBy(key, label, "other").agg(F.sum("total").alias("total"))
    sizes = points.groupBy(F.col(label).alias("_name")).agg(F.count(F.lit(1)).alias("n"))
    mine = F.col("other") == F.col(label)
    inner, outer, n = F.col("_a"), F.col("_b"), F.col("_n")
    return (
        sums.join(sizes, F.col("other").eqNullSafe(F.col("_name")))
        .groupBy(key, label)
        .agg(
            F.max(F.when(mine, F.col("n"))).alias("_n"),
            F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("_a"),
            F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("_b"),
        )
        .select(
            key,
            label,
            F.when(n == 1, 0.0)
            .when(F.greatest(inner, outer) == 0, 0.0)
            .when(inner.isNotNull() & outer.isNotNull(), (outer - inner) / F.greatest(inner, outer))
            .alias("silhouette"),
        )
    )


def squared_silhouette(points: DataFrame, key: str, label: str, vector: str, block: int = BLOCK_CENTROIDS) -> DataFrame:
    """Silhouette of every row by squared Euclidean distance: ``key, label, silhouette``.

    The mean squared distance to a label follows from its row count, mean vector and mean squared length, so one aggregate
    and one scan measure every row against all rows. Labels reach rows as arrays of ``block``; of more labels each block is
    a scan and an aggregate takes the nearest. Labels held by one point score zero, the only label of a table scores null.
    """
    x = lambda v: F.transform(v, lambda e: e.cast("double"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda t, e: t + e * e)
    rows = points.select(key, label, x(F.col(vector)).alias("_x")).withColumn("_xx", square(F.col("_x")))
    stats = spool(
        rows.select(label, array_to_vector("_x").alias("_v"), "_xx")
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("_m"), F.avg("_xx").alias("spread"))
        .select(label, "n", vector_to_array("_m").alias("mean"), "spread"),
        "label-stats",
    )

    def gap(mean: Column, spread: Column) -> Column:
        dot = F.aggregate(F.zip_with("_x", mean, lambda a, b: a * b), F.lit(0.0), lambda t, e: t + e)
        return F.greatest(F.col("_xx") - 2.0 * dot + spread, F.lit(0.0))

    own = stats.select(F.col(label).alias("_own"), "n", "mean", "spread")
    inner = F.when(F.col("n") > 1, gap(F.col("mean"), F.col("spread")) * F.col("n") / (F.col("n") - 1))
    scored = rows.join(own, F.col(label).eqNullSafe(F.col("_own"))).select(key, label, "_x", "_xx", "n", inner.alias("_a"))
    blocks = max(1, -(-stats.count() // block))

    def outer(held: DataFrame, b: int) -> DataFrame:
        part = stats.filter(F.pmod(F.xxhash64(label), F.lit(blocks)) == b)
        table = part.agg(F.collect_list(F.struct(F.col(label).alias("name"), "mean", "spread"))).scalar()
        others = F.filter("_labels", lambda c: ~c["name"].eqNullSafe(F.col(label)))
        return held.withColumn("_labels", table).withColumn("_b", F.array_min(F.transform(others, lambda c: gap(c["mean"], c["spread"])))).drop("_labels")

    if blocks == 1:
        measured = outer(scored, 0)
    else:
        held = spool(scored.withColumn("_row", F.monotonically_increasing_id()), "scored-points")
        found = None
        for b in range(blocks):
            one = outer(held, b).select("_row", "_b")
            found = one if found is None else found.union(one)
        measured = held.join(found.groupBy("_row").agg(F.min("_b").alias("_b")), "_row")
    a, b = F.col("_a"), F.col("_b")
    silhouette = F.when(F.col("n") == 1, 0.0).when(F.greatest(a, b) == 0, 0.0).when(a.isNotNull() & b.isNotNull(), (b - a) / F.greatest(a, b))
    return measured.select(key, label, silhouette.alias("silhouette"))


def silhouette(spark: SparkSession, vectors: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; NaN for fewer than two labels or one point per label."""
    distinct = len(np.unique(labels))
    if distinct < 2 or distinct >= len(labels):
        return float("nan")
    return float(silhouette_points(spark, vectors, labels).agg(F.avg("silhouette")).first()[0])


def best_k(scan: DataFrame) -> DataFrame:
    """k with the highest silhouette, the smaller k on a tie; NaN scores do not count."""
    valid = scan.filter(F.col("silhouette_score").isNotNull() & ~F.isnan("silhouette_score"))
    return valid.agg(
        F.max_by("k", F.struct("silhouette_score", -F.col("k"))).alias("selected_k"),
        F.max("silhouette_score").alias("silhouette_score"),
        F.count(F.lit(1)).alias("valid_k"),
    )


def clustering_frame(policies: DataFrame) -> DataFrame:
    return policies.withColumn("Density_log1p", X.density_log1p()).withColumns(
        {c: F.col(c).cast("string") for c in S.CATEGORICAL_ATTRIBUTES}
    )


def construct_pools(
    policies: DataFrame,
    k_min: int = S.K_MIN,
    k_max: int = S.K_MAX,
    seed: int = S.SEED,
    sample_size: int = S.SILHOUETTE_SAMPLE,
    max_iter: int = MAX_PASSES,
    init_size: int = INIT_ROWS,
) -> PoolConstruction:
    """Give each policy the pool of the best k-means over ``k_min .. k_max``.

    The encoded policies are written once; a pass over them moves the centres of all k. The
    centres of the winning k are the ones applied; they are not fitted a second time.
    """
    needed = [*(c for c in S.CLUSTERING_NUMERIC if c != "Density_log1p"), "Density", *S.CATEGORICAL_ATTRIBUTES]
    quality.expect_columns(policies, needed, "pool construction input")
    quality.expect_no_nulls(policies, needed, "pool construction input")
    rows = policies.count()
    if rows == 0:
        raise quality.DataQualityError("pool construction input has no rows")
    quality.guard_clustering(k_min, k_max, sample_size, rows)

    spark = policies.sparkSession
    frame = clustering_frame(policies)
    encoder = encoding.fit_encoder(frame, S.CLUSTERING_NUMERIC, S.CATEGORICAL_ATTRIBUTES)
    vectors = encoding.encode(frame, encoder)
    # A pass computes some 50,000 products a row, so tasks are cut by rows, not by bytes.
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // pool_scan.TASK_ROWS))
    dealt = vectors.repartition(tasks, "IDpol")
    encoded = spool(dealt.select(*policies.columns, pool_scan.fixed_point(encoding.FEATURES).alias(pool_scan.POINT)), "clustering")
    start = pool_scan.sample_matrix(fixed_sample(encoded, "IDpol", init_size, seed))
    first = pool_scan.starting_centres(start, k_min, k_max, seed)
    centres, costs = pool_scan.fit_all(encoded, first, max_iter, pool_scan.stop_below(start))
    measured = pool_scan.sample_matrix(fixed_sample(encoded, "IDpol", sample_size, seed + 1))
    scores = pool_scan.sample_silhouettes(spark, measured, centres)
    scan = [(k, None if np.isnan(scores[k]) else scores[k], costs[k]) for k in centres.ks]
    valid = [(score, -k) for k, score, _ in scan if score is not None]
    if not valid:
        raise quality.DataQualityError(f"no k of {k_min} .. {k_max} splits the sample of {len(measured)} rows")
    selected = -max(valid)[1]
    chosen = centres.of(selected)
    pooled = pool_scan.with_pools(encoded, chosen, policies.columns)
    table = spark.createDataFrame(scan, "k int, silhouette_score double, inertia double")
    return PoolConstruction(pooled, table, selected, encoder, chosen)
