"""Centroid clustering on bit planes: exact integer k-means by AND and popcount.

A vector of 64 integer components is kept as its two's-complement bit planes: plane ``i`` is one 64-bit word that holds bit
``i`` of all components. With the weights ``1, 2, 4, ... , -2^top`` the dot product of two vectors is the weighted sum of
``popcount(a_i & c_j)`` over all pairs of planes, and a squared distance is ``a.a - 2 a.c + c.c``; all of it is exact in
64-bit integers. Vectors are packed once and written; every round reads planes only (8 bytes a plane, against 256 bytes a
vector) and folds componentwise sums per cluster inside the tasks, which also come from the planes. What reaches the driver
is ``k`` rows of sums; floors of the means are taken there in Python integers.

Defined results
* vectors that are null, have another number of components than 64, or hold null or non-finite components take no part;
* repeated rows each take part; null ids take part but never start a centroid (they have no hash);
* ties: a vector as near to several centroids joins the smallest number; equal start hashes (repeated ids) are ordered by
  their vectors;
* fewer than ``k`` vectors with an id: as many centroids; no centroid, or an empty table: no rows;
* an integer component of 2^27 or more in size raises ``ComponentOverflow``: a ``long`` could not hold every distance;
* extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tontine.llm.arrowtools import arrow_schema
from tontine.sources.shared import spool

DIM, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Sizes of components that 64-bit distances can bear: 64 * (2 * 2^27)^2 = 2^62.
MOST_COMPONENT = 1 << 27
#: Rows whose popcounts are held at a time.
TILE = 1 << 14

ASSIGNED = "vec_id long, cluster int, distance long"
SUMMED = "cluster int, component int, n long, total long"


class ComponentOverflow(ValueError):
    """A component is too large for exact 64-bit distances."""


def sound_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part, ``v`` in integers."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))

    def whole(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * SCALE)
        message = F.lit(f"a component of {MOST_COMPONENT} or more in size: distances would not fit a long")
        small = F.abs(x.cast("double") * SCALE) < MOST_COMPONENT - 1
        return F.when(small, scaled.cast("int")).otherwise(F.raise_error(message).cast("int"))

    return vectors.filter((F.size(value) == DIM) & finite).select(F.col(key).cast("long").alias("vec_id"), F.transform(value, whole).alias("v"))


def weights(planes: int) -> np.ndarray:
    """Two's-complement weights of the planes, lowest first."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def planes_needed(most: int) -> int:
    """Planes that hold every integer of size ``most`` or less, sign included."""
    return int(most).bit_length() + 1


def pack(whole: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes (rows x planes, uint64) of an integer matrix (rows x 64)."""
    out = np.empty((len(whole), planes), np.uint64)
    for i in range(planes):
        bits = ((whole >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").reshape(len(whole), 8).view("<u8")[:, 0]
    return out


def component_bits(words: np.ndarray) -> np.ndarray:
    """The 64 bits of every word as a matrix (rows x 64)."""
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")


def dots(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact dot products (rows x centres) of packed vectors."""
    w = weights(rows.shape[1])
    out = np.zeros((len(rows), len(centres)), np.int64)
    columns = np.ascontiguousarray(rows.T)
    for c, centre in enumerate(centres):
        for j, word in enumerate(centre):
            if word:
                for i, column in enumerate(columns):
                    out[:, c] += (w[i] * w[j]) * np.bitwise_count(column & word).astype(np.int64)
    return out


def norms(rows: np.ndarray) -> np.ndarray:
    """Exact squared lengths of packed vectors; a pair of different planes counts twice."""
    w = weights(rows.shape[1])
    out = np.zeros(len(rows), np.int64)
    for i in range(rows.shape[1]):
        for j in range(i, rows.shape[1]):
            out += (w[i] * w[j] * (2 if i < j else 1)) * np.bitwise_count(rows[:, i] & rows[:, j]).astype(np.int64)
    return out


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance; the smaller number on a tie."""
    gaps = norms(centres)[None, :] - 2 * dots(rows, centres)
    best = gaps.argmin(axis=1)
    return best, norms(rows) + gaps[np.arange(len(rows)), best]


def packed_column(batch: pa.RecordBatch, name: str, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Tiles of the packed column: the first row, and words (rows x planes)."""
    column = batch.column(batch.schema.get_field_index(name))
    words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, planes)
    for start in range(0, len(words), TILE):
        yield start, words[start : start + TILE]


def pack_vectors(rows: DataFrame, planes: int) -> DataFrame:
    """``vec_id, words``: the planes as an array of longs."""

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            words = pack(whole, planes).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * planes), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=arrow_schema("vec_id long, words array<long>"))

    return rows.mapInArrow(packing, "vec_id long, words array<long>")


def assign(packed: DataFrame, centres: np.ndarray, planes: int) -> DataFrame:
    """``vec_id, cluster, distance`` for every packed vector; ``centres``: a bounded integer matrix (k x 64)."""
    words = pack(centres, planes)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, rows in packed_column(batch, "words", planes):
                best, gap = nearest(rows, words)
                columns = [batch.column(0).slice(start, len(rows)), pa.array(best.astype(np.int32)), pa.array(gap)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(ASSIGNED))

    return packed.mapInArrow(near, ASSIGNED)


def cluster_sums(packed: DataFrame, centres: np.ndarray, planes: int) -> DataFrame:
    """``cluster, component, n, total`` over all vectors; a task hands on one row per cluster and component."""
    words = pack(centres, planes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts, w = np.zeros((len(words), DIM), np.int64), np.zeros(len(words), np.int64), weights(planes)
        for batch in batches:
            for _, rows in packed_column(batch, "words", planes):
                best, _ = nearest(rows, words)
                order = np.argsort(best, kind="stable")
                found, starts = np.unique(best[order], return_index=True)
                for i in range(planes):
                    bits = component_bits(rows[order, i])
                    totals[found] += w[i] * np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                counts += np.bincount(best, minlength=len(words))
        kept = np.flatnonzero(counts)
        columns = [
            np.repeat(kept, DIM).astype(np.int32), np.tile(np.arange(DIM, dtype=np.int32), len(kept)),
            np.repeat(counts[kept], DIM), totals[kept].ravel(),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=arrow_schema(SUMMED))

    folded = packed.mapInArrow(fold, SUMMED)
    wide = F.sum(F.col("total").cast("decimal(38,0)"))
    return folded.groupBy("cluster", "component").agg(F.sum("n").alias("n"), wide.alias("total"))


def first_centres(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors of the smallest hashes of ``seed:vec_id``, in order of the hash."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    drawn = rows.filter(F.col("vec_id").isNotNull()).select(named.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r.v for r in drawn], np.int64).reshape(-1, DIM)


def digest_of(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def fit(rows: DataFrame, packed: DataFrame, planes: int, k: int = K, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres after ``rounds`` rounds; one that no vector is nearest to stays where it was."""
    centres = first_centres(rows, k, seed)
    for _ in range(rounds if len(centres) else 0):
        moved = centres.copy()
        for r in cluster_sums(packed, centres, planes).collect():  # k * 64 rows at most
            moved[r.cluster, r.component] = int(r.total) // r.n
        centres = moved
    return centres


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = 1
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part."""
    spark: SparkSession = vectors.sparkSession
    rows = sound_vectors(vectors, key, vector)
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    planes = planes_needed(most)
    packed = spool(pack_vectors(rows, planes), "planes")
    centres = fit(rows, packed, planes, k, rounds, seed)
    if not len(centres):
        return spark.createDataFrame([], f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = spool(assign(packed, centres, planes), "assigned")
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(sums.values())
    table = [(c, sums.get(c, 0), whole, digest_of(centre)) for c, centre in enumerate(centres)]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
